"""Queries by name, over the tables of a folder, and the same in DuckDB's SQL where SQL can say it.

Positions, rows and orders count from 0 unless a column says otherwise; symbols are code points; the sentinel is chr(1).
Texts are ``documents``, ``benchmark`` (short ones) and whole dialogs, the turns of each of ``conversations`` in order:
repetitive texts of some thousand symbols, all of whose suffixes SQL can sort.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import planning as P
from ..operators import strings as S
from ..operators import symbols as Y
from ..sources import texts as X
from ..sources.staging import shared_dir, staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def docs(spark, d):
    return X.table(spark, d, "documents")


def doc_blocks(spark, d):
    return X.blocks_of(docs(spark, d), "doc_id")


def short_blocks(spark, d):
    return X.blocks_of(X.table(spark, d, "benchmark"), "item_id")


def dialog_blocks(spark, d):
    turns = X.table(spark, d, "conversations").select(F.col("conv_id").cast("long").alias("block"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    whole = turns.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return whole.select("block", F.array_join(F.transform("turns", lambda t: t["text"]), "\n").alias("text"))


def dialog_bwt(spark, d):
    return B.bwt(dialog_blocks(spark, d)).select("block", "row", "sym")


# Shared parts of SQL: chars, transform, runs and lines.
CHARS = "ch AS (SELECT doc_id AS block, unnest(string_split(text, '')) AS sym, unnest(generate_series(0, len(string_split(text, '')) - 1)) AS pos FROM documents WHERE text <> '')"
DIALOGS = "dg AS (SELECT conv_id AS block, string_agg(coalesce(text, ''), chr(10) ORDER BY turn, role, text) AS text FROM conversations GROUP BY conv_id)"
ROWS = f"""{DIALOGS}, tx AS (SELECT block, text || chr(1) AS t, len(string_split(text, '')) + 1 AS n FROM dg),
ps AS (SELECT block, t, n, unnest(generate_series(1, n)) AS i FROM tx),
bw AS (SELECT block, CAST(row_number() OVER (PARTITION BY block ORDER BY substr(t, i)) - 1 AS BIGINT) AS row, CAST(i - 1 AS BIGINT) AS sa, CASE WHEN i = 1 THEN chr(1) ELSE substr(t, i - 1, 1) END AS sym FROM ps)"""
LF = "lf AS (SELECT block, row, sym, CAST(row_number() OVER (PARTITION BY block ORDER BY sym, row) - 1 AS BIGINT) AS lf FROM bw)"
RUNS = """m AS (SELECT *, CASE WHEN lag(sym) OVER (PARTITION BY block ORDER BY row) = sym THEN 0 ELSE 1 END AS new FROM lf),
mr AS (SELECT *, CAST(sum(new) OVER (PARTITION BY block ORDER BY row) - 1 AS BIGINT) AS run_id FROM m),
rt AS (SELECT block, run_id, sym, min(row) AS start, count(*) AS height, min(lf) AS lf_start FROM mr GROUP BY ALL)"""
LINES = """l0 AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
l1 AS (SELECT doc_id, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM l0),
li AS (SELECT doc_id, unnest(generate_series(0, len(p) - 1)) AS line_no, unnest(p) AS line FROM l1 WHERE len(p) > 0)"""
HI = "CAST(length(bin({0})) - 1 AS BIGINT)"

def spectrum(source: str, most: int = 100) -> str:
    """e (block, k, n, nodes, edges) of orders up to ``most``, 126 at most, of the texts of source (block, text).

    Windows of 128 symbols of the cyclic text, grown by doubling, are sorted; l and m are what each has in common with the
    one before and behind.  Windows of k + 1 equal symbols are neighbours, and their edge counts once if no other window
    has the same first k symbols, nor the last k: if l and m are below k at their ends, and at those of the windows one
    place on, which then lie side by side."""
    grown = ", ".join(f"w{j + 1} AS (SELECT block, n, i, s || lead(s, {1 << j}) OVER (PARTITION BY block ORDER BY i) AS s FROM w{j})" for j in range(7))
    common = ", ".join(f"p{j} AS (SELECT block, n, i, s, p, r, l + CASE WHEN substr(s, l + 1, {1 << j}) = substr(p, l + 1, {1 << j}) THEN {1 << j} ELSE 0 END AS l FROM p{j + 1})" for j in range(6, -1, -1))
    return f"""t0 AS (SELECT block, string_split(replace(text, chr(0), '') || chr(1), '') AS a FROM {source}),
t1 AS (SELECT block, len(a) AS n, CASE WHEN len(a) >= 128 THEN a || a[1:128] ELSE flatten(list_transform(range(128 // len(a) + 2), lambda x: a)) END AS aa FROM t0),
w0 AS (SELECT block, n, unnest(aa) AS s, unnest(generate_series(1, len(aa))) AS i FROM t1), {grown},
p7 AS (SELECT block, n, i, s, lag(s) OVER (PARTITION BY block ORDER BY s) AS p, row_number() OVER (PARTITION BY block ORDER BY s) AS r, 0 AS l FROM w7 WHERE i <= n), {common},
q AS (SELECT block, n, i, r, least(l, {most + 1}) AS l, least(coalesce(lead(l) OVER (PARTITION BY block ORDER BY r), 0), {most + 1}) AS m FROM p0),
x AS (SELECT a.block, a.r, a.l, a.m, b.l AS l2, b.m AS m2, b.r AS r2 FROM q a JOIN q b ON b.block = a.block AND b.i = a.i % a.n + 1),
y AS (SELECT *, unnest(generate_series(1, greatest(l, m) - 1)) AS k FROM x WHERE greatest(l, m) > 1),
z AS (SELECT *, sum(CASE WHEN l <= k THEN 1 ELSE 0 END) OVER (PARTITION BY block, k ORDER BY r) AS g FROM y),
fu0 AS (SELECT block, k, sum(c - 1) AS fused FROM (SELECT block, k, g, count(*) AS c FROM z GROUP BY ALL HAVING min(l) < k AND min(m) < k AND min(l2) < k AND min(m2) < k AND max(r2) - min(r2) = count(*) - 1) GROUP BY ALL),
h AS (SELECT block, n, l, count(*) AS c FROM q GROUP BY ALL),
nd AS (SELECT block, n, k, sum(c) FILTER (l < k) AS nodes FROM (SELECT *, unnest(generate_series(1, least(n, {most}))) AS k FROM h) GROUP BY ALL),
e AS (SELECT nd.block, CAST(nd.k AS BIGINT) AS k, n, CAST(nodes AS BIGINT) AS nodes, CAST(n - coalesce(fused, 0) AS BIGINT) AS edges FROM nd LEFT JOIN fu0 ON fu0.block = nd.block AND fu0.k = nd.k)"""


FEWEST = "CASE WHEN min(edges) < any_value(n) THEN arg_min(k, edges * 1000 + k) ELSE 1 END AS k, least(min(edges), any_value(n)) AS edges"
#: Of the first 126 orders, that with the fewest edges; the texts here have their least one at 66 at most.
BEST = f"""{ROWS}, {LF}, {spectrum("dg", 126)},
be AS (SELECT block, any_value(n) AS n, {FEWEST} FROM e GROUP BY block)"""
INDEX = f"""{BEST},
km AS (SELECT lf.block, lf.row, lf.sym, lf.lf, substr(t || t, bw.sa + 1, be.k) AS m FROM lf JOIN bw ON bw.block = lf.block AND bw.row = lf.row JOIN tx ON tx.block = lf.block JOIN be ON be.block = lf.block),
bo AS (SELECT *, CAST(CASE WHEN lag(m) OVER (PARTITION BY block ORDER BY row) = m THEN 0 ELSE 1 END AS BIGINT) AS bound FROM km),
gr AS (SELECT block, m, min(row) AS lo, max(row) AS up, count(DISTINCT sym) AS kinds, min(lf) AS lo_to, max(lf) AS up_to FROM bo GROUP BY ALL),
fu AS (SELECT a.* FROM gr a JOIN gr b ON b.block = a.block AND b.lo = a.lo_to AND b.up = a.up_to WHERE a.up > a.lo AND a.kinds = 1 AND a.up_to - a.lo_to = a.up - a.lo),
ix AS (SELECT bo.block, bo.row, bo.sym, bound, CAST(1 - count(i.lo) AS BIGINT) AS "inner", CAST(1 - count(o.lo) AS BIGINT) AS "outer" FROM bo
       LEFT JOIN fu i ON i.block = bo.block AND bo.row > i.lo AND bo.row <= i.up LEFT JOIN fu o ON o.block = bo.block AND bo.row > o.lo_to AND bo.row <= o.up_to GROUP BY ALL),
ia AS (SELECT block, sym, "outer", row_number() OVER (PARTITION BY block ORDER BY row) - 1 AS pos FROM ix WHERE "inner" = 1),
ib AS (SELECT block, "inner", row_number() OVER (PARTITION BY block ORDER BY row) - 1 AS pos FROM ix WHERE "outer" = 1),
ti AS (SELECT ia.block, ia.pos, ia.sym, ia."outer", ib."inner" FROM ia JOIN ib ON ib.block = ia.block AND ib.pos = ia.pos)"""
AT = "JOIN mr l ON l.block = c.block AND l.row = c.x JOIN rt r ON r.block = l.block AND r.run_id = l.run_id WHERE c.x + c.h <= r.start + r.height"
CHAINS = f"""{ROWS}, {LF}, {RUNS},
ch AS (SELECT block, run_id, height AS h, 1 AS step, lf_start AS x FROM rt WHERE height >= 2 UNION ALL SELECT c.block, c.run_id, c.h, c.step + 1, l.lf FROM ch c {AT}),
cc AS (SELECT c.block, c.run_id, c.h, c.step, r.run_id AS at, r.height AS hh FROM ch c {AT}),
la AS (SELECT block, run_id, h, max(step) FILTER (hh = h) AS last FROM cc GROUP BY ALL HAVING count(*) FILTER (hh = h) > 0),
co AS (SELECT cc.*, last FROM cc JOIN la ON la.block = cc.block AND la.run_id = cc.run_id WHERE step <= last),
kc AS (SELECT * FROM co WHERE NOT EXISTS (SELECT 1 FROM co o WHERE o.block = co.block AND o.at = co.run_id AND o.hh = o.h)),
iv AS (SELECT block, run_id AS run, h AS height, CAST(any_value(last) AS BIGINT) AS columns, CAST(sum({HI.format("hh")} - {HI.format("(hh - h + 1)")}) - {HI.format("h")} AS BIGINT) AS rating FROM kc GROUP BY block, run_id, h)"""


# Sources


@query("SELECT doc_id, text, lang, source, CAST(strlen(text) AS BIGINT) AS size FROM documents")
def scan_documents(spark, d):
    return docs(spark, d).select("doc_id", "text", "lang", "source", F.octet_length("text").cast("long").alias("size"))


@query("SELECT doc_id, replace(text, chr(0), '') || chr(1) AS text FROM documents")
def sentinel_text(spark, d):
    return docs(spark, d).select("doc_id", X.with_sentinel(F.col("text")).alias("text"))


@query("SELECT doc_id, regexp_replace(text, '[^ACGT]', '', 'g') AS bases FROM documents")
def symbol_filter(spark, d):
    return docs(spark, d).select("doc_id", F.regexp_replace("text", "[^ACGT]", "").alias("bases"))


@query(
    """SELECT 'documents' AS corpus, doc_id AS item, strlen(text) AS size FROM documents UNION ALL SELECT 'benchmark', item_id, strlen(text) FROM benchmark
UNION ALL SELECT 'pages', page_id, strlen(html) FROM pages UNION ALL SELECT 'conversations', conv_id, strlen(text) FROM conversations"""
)
def corpus_union(spark, d):
    parts = [X.table(spark, d, t).select(F.lit(t).alias("corpus"), F.col(k).alias("item"), F.octet_length(c).cast("long").alias("size")) for t, k, c in (("documents", "doc_id", "text"), ("benchmark", "item_id", "text"), ("pages", "page_id", "html"), ("conversations", "conv_id", "text"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"WITH {LINES} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line FROM li")
def line_scan(spark, d):
    return X.lines(docs(spark, d))


@query(
    """WITH s AS (SELECT doc_id, text, len(string_split(text, '')) AS n FROM documents), b AS (SELECT *, unnest(generate_series(0, greatest(CAST(ceil(n / 4096) AS BIGINT) - 1, 0))) AS block_id FROM s)
SELECT doc_id, CAST(block_id AS BIGINT) AS block_id, CAST(block_id * 4096 AS BIGINT) AS start, CAST(length(substr(text, block_id * 4096 + 1, 4096)) AS BIGINT) AS length, substr(text, block_id * 4096 + 1, 4096) AS block FROM b"""
)
def block_split(spark, d):
    return X.split_blocks(docs(spark, d), 4096)


@query(
    """WITH s AS (SELECT doc_id, text, len(string_split(text, '')) AS n FROM documents), b AS (SELECT *, unnest(generate_series(0, greatest(CAST(ceil(n / 4096) AS BIGINT) - 1, 0))) AS block_id FROM s),
e AS (SELECT doc_id, block_id, strlen(substr(text, block_id * 4096 + 1, 4096)) AS size, count(*) OVER (PARTITION BY doc_id) AS many FROM b)
SELECT doc_id, CAST(block_id AS BIGINT) AS block_id, CAST(8 * (many + 1) + sum(size) OVER (PARTITION BY doc_id ORDER BY block_id) AS BIGINT) AS stop, true AS rising FROM e"""
)
def block_header(spark, d):
    size = X.split_blocks(docs(spark, d), 4096).select("doc_id", "block_id", F.octet_length("block").alias("size"))
    w = Window.partitionBy("doc_id").orderBy("block_id")
    stop = 8 * (F.count("*").over(Window.partitionBy("doc_id")) + 1) + F.sum("size").over(w.rowsBetween(*Y.UPTO))
    head = size.select("doc_id", "block_id", stop.cast("long").alias("stop"))
    return head.withColumn("rising", F.coalesce(F.lag("stop").over(w) <= F.col("stop"), F.lit(True)))


# Profiles and lines


STATS = "fs AS (SELECT doc_id, lang, source, CAST(list_unique(regexp_extract_all(hex(encode(text)), '..')) AS BIGINT) AS sigma, CAST(strlen(text) - strlen(replace(text, chr(10), '')) + 1 AS BIGINT) AS newlines, strlen(text) AS size FROM documents)"


@query(f"WITH {STATS} SELECT * FROM fs")
def file_stats(spark, d):
    return Y.file_stats(docs(spark, d))


@query(f"WITH {STATS} SELECT lang, source, count(*) AS files, CAST(sum(size) AS BIGINT) AS size, CAST(sum(newlines) AS BIGINT) AS newlines, max(sigma) AS sigma FROM fs GROUP BY ROLLUP (lang, source)")
def file_stats_rollup(spark, d):
    return Y.file_stats(docs(spark, d)).rollup("lang", "source").agg(F.count("*").alias("files"), F.sum("size").alias("size"), F.sum("newlines").alias("newlines"), F.max("sigma").alias("sigma"))


@query(f"WITH {CHARS} SELECT block, sym, count(*) AS cnt FROM ch GROUP BY ALL")
def symbol_histogram(spark, d):
    return Y.histogram(doc_blocks(spark, d))


@query(f"WITH {CHARS}, h AS (SELECT block, sym, count(*) AS cnt FROM ch GROUP BY ALL) SELECT block, sym, cnt, CAST(coalesce(sum(cnt) OVER (PARTITION BY block ORDER BY sym ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS smaller FROM h")
def c_array(spark, d):
    return Y.c_array(doc_blocks(spark, d))


@query(f"WITH {CHARS}, h AS (SELECT DISTINCT block, sym FROM ch) SELECT block, sym, row_number() OVER (PARTITION BY block ORDER BY sym) - 1 AS comp FROM h")
def alphabet(spark, d):
    return Y.alphabet(doc_blocks(spark, d))


@query(f"WITH {CHARS}, h AS (SELECT block, sym, min(pos) AS pos FROM ch GROUP BY ALL) SELECT block, sym, row_number() OVER (PARTITION BY block ORDER BY pos) - 1 AS place FROM h")
def first_appearance_alphabet(spark, d):
    return Y.first_appearance(doc_blocks(spark, d))


@query(f"WITH {LINES} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line FROM li WHERE line <> '' AND NOT contains(line, chr(0))")
def clean_lines(spark, d):
    return X.lines(docs(spark, d)).where("line <> '' AND instr(line, chr(0)) = 0")


@query(f"WITH {LINES} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line FROM li WHERE strlen(line) >= 10")
def long_lines(spark, d):
    return X.lines(docs(spark, d)).where("octet_length(line) >= 10")


@query(f"WITH {LINES} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line FROM li ORDER BY line, doc_id, line_no")
def sorted_lines(spark, d):
    return X.lines(docs(spark, d)).orderBy("line", "doc_id", "line_no")


@query(f"WITH {LINES} SELECT doc_id, max(CAST(line_no AS BIGINT)) AS line_no, max_by(line, line_no) AS line FROM li GROUP BY doc_id")
def last_line(spark, d):
    return X.lines(docs(spark, d)).groupBy("doc_id").agg(F.max("line_no").alias("line_no"), F.max_by("line", "line_no").alias("line"))


@query(f"WITH {LINES} SELECT line, min(doc_id) AS doc_id, count(*) AS copies FROM li GROUP BY line")
def distinct_lines(spark, d):
    return X.lines(docs(spark, d)).groupBy("line").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(f"WITH {LINES} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, reverse(line) AS line FROM li")
def reverse_lines(spark, d):
    return X.lines(docs(spark, d)).withColumn("line", F.reverse("line"))


@query("WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) SELECT item_id AS record, (SELECT count(*) FROM l WHERE contains(l.line, b.text)) AS lines FROM benchmark b")
def grep_lines(spark, d):
    lines = X.lines(docs(spark, d)).select("doc_id", F.col("line").alias("text"))
    return S.lines_with(lines, X.table(spark, d, "benchmark").select(F.col("item_id").alias("record"), F.col("text").alias("pattern")))


@query(f"WITH {LINES} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(sum(len(string_split(line, ''))) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS stop FROM li WHERE line <> ''")
def expected_ends(spark, d):
    lines = X.lines(docs(spark, d)).where("line <> ''")
    return lines.select("doc_id", "line_no", F.sum(F.length("line")).over(Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(*Y.UPTO)).alias("stop"))


# De Bruijn graphs


#: The orders of the reference's benchmark (MAXK).
MOST_ORDERS = 100
SPECTRUM = f"WITH d AS (SELECT doc_id AS block, text FROM documents), {spectrum('d', MOST_ORDERS)}"


@query(f"{SPECTRUM} SELECT block, k, nodes, edges FROM e")
def edge_spectrum(spark, d):
    return B.edge_spectrum(doc_blocks(spark, d), MOST_ORDERS)


@query(f"WITH d AS (SELECT doc_id AS block, text FROM documents), {spectrum('d', 126)} SELECT block, {FEWEST} FROM e GROUP BY block")
def min_dbg(spark, d):
    """Over all orders; the SQL looks at the first 126."""
    return B.min_dbg(doc_blocks(spark, d))


def _edge_matrix(e: DataFrame) -> DataFrame:
    w = Window.partitionBy("block")
    low, high = F.min("edges").over(w), F.max("edges").over(w)
    return e.select("block", "k", F.when(high > low, F.round((F.col("edges") - low) / (high - low), 6)).otherwise(0.0).alias("share"))


def _edge_info(e: DataFrame) -> DataFrame:
    w = Window.partitionBy("block")
    return e.select("block", "k", "edges", F.min("edges").over(w).alias("fewest"), F.max("edges").over(w).alias("most"))


@query(f"{SPECTRUM} SELECT block, k, CASE WHEN max(edges) OVER w > min(edges) OVER w THEN round((edges - min(edges) OVER w) / (max(edges) OVER w - min(edges) OVER w), 6) ELSE 0.0 END AS share FROM e WINDOW w AS (PARTITION BY block)")
def edge_matrix(spark, d):
    return _edge_matrix(B.edge_spectrum(doc_blocks(spark, d), MOST_ORDERS))


@query(f"{SPECTRUM} SELECT block, k, edges, min(edges) OVER w AS fewest, max(edges) OVER w AS most FROM e WINDOW w AS (PARTITION BY block)")
def edge_info(spark, d):
    return _edge_info(B.edge_spectrum(doc_blocks(spark, d), MOST_ORDERS))


@query(
    f"""WITH {ROWS}, e AS (SELECT ps.block, substr(t || t, i + 1, 3) AS kmer, substr(t, i, 1) AS before FROM ps WHERE n >= 3)
SELECT block, kmer, count(*) AS cnt, count(DISTINCT before) AS lefts FROM e GROUP BY ALL"""
)
def left_extensions(spark, d):
    t = dialog_blocks(spark, d).select("block", X.with_sentinel(F.col("text")).alias("t")).where("length(t) >= 3")
    rows = t.select("block", "t", F.explode(F.sequence(F.lit(1), F.length("t"))).alias("i"))
    kmer = F.concat("t", "t").substr(F.col("i") + 1, F.lit(3))
    return rows.select("block", kmer.alias("kmer"), F.col("t").substr(F.col("i"), F.lit(1)).alias("before")).groupBy("block", "kmer").agg(F.count("*").alias("cnt"), F.countDistinct("before").alias("lefts"))


# Suffixes, transform and runs


@query(f"WITH {ROWS} SELECT block, row, sa FROM bw")
def suffix_array(spark, d):
    return B.suffix_array(dialog_blocks(spark, d))


@query(f"WITH {ROWS} SELECT block, row, sym FROM bw")
def bwt(spark, d):
    return dialog_bwt(spark, d)


@query()
def bwt_documents(spark, d):
    return B.bwt(doc_blocks(spark, d))


@query(f"WITH {ROWS} SELECT block, row AS idx FROM bw WHERE sa = 0")
def primary_index(spark, d):
    return B.suffix_array(dialog_blocks(spark, d)).where("sa = 0").select("block", F.col("row").alias("idx"))


@query(f"WITH {ROWS}, {LF} SELECT block, row, sym, lf FROM lf")
def lf_mapping(spark, d):
    return Y.lf(dialog_bwt(spark, d))


@query("SELECT doc_id AS block, text FROM documents")
def inverse_bwt(spark, d):
    return B.inverse_bwt(doc_blocks(spark, d))


@query(f"WITH {ROWS}, k AS (SELECT bw.block, row, substr(t || t || t || t, sa + 1, least(3, n)) AS m FROM bw JOIN tx ON tx.block = bw.block) SELECT block, row, CAST(CASE WHEN lag(m) OVER (PARTITION BY block ORDER BY row) = m THEN 0 ELSE 1 END AS BIGINT) AS bound FROM k")
def kmer_bounds(spark, d):
    return P.kmer_bounds(dialog_blocks(spark, d), 3)


@query(
    f"""WITH {ROWS}, b AS (SELECT block, row, CAST(sym = 'e' AS BIGINT) AS bit FROM bw), r AS (SELECT *, CAST(coalesce(sum(bit) OVER (PARTITION BY block ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rank1 FROM b)
SELECT block, row, bit, rank1, CASE WHEN bit = 1 THEN rank1 + 1 END AS select1 FROM r"""
)
def bit_rank_select(spark, d):
    return Y.rank_select(dialog_bwt(spark, d), "e")


@query(f"WITH {ROWS}, {LF}, {RUNS} SELECT block, run_id, sym, start, height, lf_start FROM rt")
def run_table(spark, d):
    return Y.runs(dialog_bwt(spark, d))


@query(f"WITH {ROWS}, {LF}, {RUNS} SELECT block, run_id, height, {HI.format('height')} AS chars FROM rt WHERE height > 1")
def run_chars(spark, d):
    return Y.runs(dialog_bwt(spark, d)).where("height > 1").select("block", "run_id", "height", Y.hi(F.col("height")).alias("chars"))


@query(f"WITH {ROWS}, {LF}, {RUNS} SELECT mr.block, mr.row, mr.run_id, rt.start FROM mr JOIN rt ON rt.block = mr.block AND rt.run_id = mr.run_id")
def run_of(spark, d):
    return Y.run_of(dialog_bwt(spark, d))


RLE = f"""q0 AS (SELECT *, CASE WHEN lag(sym) OVER (PARTITION BY block ORDER BY row) = sym THEN 0 ELSE 1 END AS new FROM bw WHERE sym <> chr(1)),
q1 AS (SELECT *, sum(new) OVER (PARTITION BY block ORDER BY row) AS g FROM q0), q2 AS (SELECT block, g, count(*) AS h FROM q1 GROUP BY ALL),
q3 AS (SELECT block, CAST(sum({HI.format("h")} + 1) AS BIGINT) AS n_rle FROM q2 GROUP BY block),
rl AS (SELECT w.block, w.runs, n_rle, n_rle - w.runs AS rc, w.tall FROM (SELECT block, count(*) AS runs, count(*) FILTER (height > 1) AS tall FROM rt GROUP BY block) w JOIN q3 ON q3.block = w.block)"""


@query(f"WITH {ROWS}, {LF}, {RUNS}, {RLE} SELECT block, runs, n_rle, rc, tall FROM rl")
def rle_len(spark, d):
    return Y.rle(dialog_bwt(spark, d))


WEIGHED = f"""{CHAINS}, {RLE},
wi AS (SELECT iv.*, runs, tall, CASE WHEN rc > 0 THEN 1 + log2(1 + runs / rc) ELSE 0 END AS weight, row_number() OVER (PARTITION BY iv.block ORDER BY rating DESC, run) AS n, count(*) OVER (PARTITION BY iv.block) AS many FROM iv JOIN rl ON rl.block = iv.block)"""


@query(f"WITH {ROWS}, x AS (SELECT block, row AS idx FROM bw WHERE sym = chr(1)) SELECT bw.block, row, CASE WHEN row < idx THEN row WHEN row > idx THEN row - 1 END AS indexed FROM bw JOIN x ON x.block = bw.block")
def idx_mapping(spark, d):
    rows = dialog_bwt(spark, d)
    at = rows.where(F.col("sym") == X.SENTINEL).select("block", F.col("row").alias("idx"))
    return rows.join(at, "block").select("block", "row", F.when(F.col("row") < F.col("idx"), F.col("row")).when(F.col("row") > F.col("idx"), F.col("row") - 1).alias("indexed"))


MTF = """c AS (SELECT item_id AS block, unnest(string_split(text, '')) AS sym, unnest(generate_series(0, len(string_split(text, '')) - 1)) AS pos FROM benchmark),
p AS (SELECT *, lag(pos) OVER (PARTITION BY block, sym ORDER BY pos) AS prev FROM c),
fa AS (SELECT block, sym, row_number() OVER (PARTITION BY block ORDER BY min(pos)) - 1 AS place FROM c GROUP BY block, sym),
mt AS (SELECT p.block, p.pos, p.sym, CAST(CASE WHEN prev IS NULL THEN place ELSE (SELECT count(DISTINCT q.sym) FROM c q WHERE q.block = p.block AND q.pos > p.prev AND q.pos < p.pos) END AS BIGINT) AS rank FROM p JOIN fa ON fa.block = p.block AND fa.sym = p.sym)"""


@query(f"WITH {MTF} SELECT block, pos, sym, rank FROM mt")
def mtf(spark, d):
    return B.mtf(short_blocks(spark, d))


RLE0 = """z0 AS (SELECT *, sum(CASE WHEN rank > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY block ORDER BY pos) AS g FROM mt),
z1 AS (SELECT block, g, min(pos) AS at, count(*) FILTER (rank = 0) AS z, max(rank) AS r FROM z0 GROUP BY block, g),
z2 AS (SELECT block, g, unnest(CASE WHEN r > 0 THEN [r + 1] ELSE [] END || CASE WHEN z > 0 THEN list_transform(list_reverse(string_split(substr(bin(z + 1), 2), '')), lambda b: CAST(b AS BIGINT)) ELSE [] END) AS symbol, unnest(generate_series(1, CASE WHEN r > 0 THEN 1 ELSE 0 END + CASE WHEN z > 0 THEN length(bin(z + 1)) - 1 ELSE 0 END)) AS j FROM z1),
rz AS (SELECT block, row_number() OVER (PARTITION BY block ORDER BY g, j) - 1 AS pos, symbol FROM z2)"""


@query(f"WITH {MTF}, {RLE0} SELECT block, pos, symbol FROM rz")
def rle0(spark, d):
    return B.rle0(short_blocks(spark, d))


@query(f"WITH {MTF}, {RLE0} SELECT block, count(*) AS symbols FROM rz GROUP BY block")
def rle0_len(spark, d):
    return Y.rle0_length(B.mtf(short_blocks(spark, d)))


@query(
    f"""WITH {MTF}, {RLE0}, k AS (SELECT block, count(DISTINCT symbol) AS kinds FROM rz GROUP BY block), o AS (SELECT rz.block, row_number() OVER (PARTITION BY rz.block, symbol ORDER BY pos) AS own, row_number() OVER (PARTITION BY rz.block ORDER BY pos) - 1 + kinds + 1 AS every FROM rz JOIN k ON k.block = rz.block)
SELECT block, round(sum(log2(every / own)), 4) AS bits FROM o GROUP BY block"""
)
def codelength_order0(spark, d):
    return Y.code_length(B.rle0(short_blocks(spark, d)))


@query("SELECT doc_id AS block, text FROM documents")
def mtf_roundtrip(spark, d):
    return B.mtf_roundtrip(doc_blocks(spark, d))


# Compacted index


@query(f'WITH {INDEX} SELECT block, row, bound, "inner", "outer" FROM ix')
def prefix_intervals(spark, d):
    return P.index_rows(dialog_blocks(spark, d))


@query(f'WITH {INDEX} SELECT block, pos, sym, "outer", "inner" FROM ti')
def tfm_index(spark, d):
    return P.fused_index(dialog_blocks(spark, d))


@query(f'WITH {INDEX} SELECT block, pos, 2 * "outer" + "inner" AS aux, "outer", "inner" FROM ti')
def tfm_aux_pack(spark, d):
    aux = (2 * F.col("outer") + F.col("inner")).alias("aux")
    return P.fused_index(dialog_blocks(spark, d)).select("block", "pos", aux, F.shiftright(aux, 1).alias("outer"), aux.bitwiseAND(1).alias("inner"))


@query(f"WITH {DIALOGS} SELECT block, text FROM dg")
def tfm_invert(spark, d):
    return P.invert_index(staged(P.fused_index(dialog_blocks(spark, d)), "index"))


@query(f"WITH {BEST} SELECT block, CAST(n AS BIGINT) AS n, k, edges AS symbols FROM be")
def tfm_stats(spark, d):
    return P.index_stats(dialog_blocks(spark, d))


@query()
def tfm_stats_documents(spark, d):
    return P.index_stats(doc_blocks(spark, d))


@query(f"WITH {DIALOGS} SELECT block, text FROM dg")
def twobit_roundtrip(spark, d):
    return P.coder_roundtrip(dialog_blocks(spark, d), "two_bits")


@query(f"WITH {DIALOGS} SELECT block, text FROM dg")
def zipped_index_roundtrip(spark, d):
    return P.coder_roundtrip(dialog_blocks(spark, d), "index")


# Sets of strings


@query(f"WITH {LINES}, dl AS (SELECT line, min(line_no) AS n FROM li WHERE line <> '' AND NOT contains(line, chr(0)) GROUP BY line) SELECT line, CAST(n AS BIGINT) AS line_no FROM dl a WHERE NOT EXISTS (SELECT 1 FROM dl b WHERE a.line <> b.line AND contains(a.line, b.line))")
def minimal_lines(spark, d):
    return S.minimal(X.lines(docs(spark, d)).select("line", "line_no"))


def urls(spark, d):
    return X.table(spark, d, "pages").where("url <> ''").groupBy(F.col("url").alias("string")).agg(F.min("page_id").alias("record"))


def url_nodes(spark, d):
    return staged(S.trie_nodes(urls(spark, d)), "nodes")


TRIE = """u AS (SELECT url AS string, min(page_id) AS record FROM pages WHERE url <> '' GROUP BY url),
pa AS (SELECT DISTINCT substr(string, 1, n) AS path FROM (SELECT string, unnest(generate_series(0, length(string))) AS n FROM u)),
nodes AS (SELECT path, CAST(dense_rank() OVER (ORDER BY reverse(path)) - 1 AS BIGINT) AS node_id, CAST(length(path) AS BIGINT) AS depth FROM pa)"""
EDGES = "edges AS (SELECT p.node_id, right(c.path, 1) AS sym, c.node_id AS child_id, row_number() OVER (PARTITION BY p.node_id ORDER BY right(c.path, 1)) = 1 AS first FROM nodes c JOIN nodes p ON p.path = left(c.path, c.depth - 1) AND c.depth > 0)"
LINKS = """cut AS (SELECT node_id, right(path, n) AS path FROM (SELECT node_id, path, unnest(generate_series(0, depth - 1)) AS n FROM nodes WHERE depth > 0)),
sl AS (SELECT cut.node_id, o.node_id AS other, o.depth AS length FROM cut JOIN nodes o ON o.path = cut.path)"""


@query(f"WITH {TRIE} SELECT * FROM nodes")
def trie_nodes(spark, d):
    return url_nodes(spark, d)


@query(f"WITH {TRIE}, {EDGES} SELECT * FROM edges")
def trie_edges(spark, d):
    return S.trie_edges(url_nodes(spark, d))


@query(f"WITH {TRIE}, {LINKS} SELECT nodes.node_id, arg_max(other, length) AS fail_id FROM nodes LEFT JOIN sl ON sl.node_id = nodes.node_id GROUP BY nodes.node_id")
def trie_failure(spark, d):
    return S.trie_failure(url_nodes(spark, d))


@query(f"WITH {TRIE} SELECT node_id, record FROM u JOIN nodes ON path = string")
def trie_leaves(spark, d):
    return S.trie_leaves(url_nodes(spark, d), urls(spark, d))


@query(f"WITH {TRIE}, {LINKS}, lv AS (SELECT nodes.node_id, count(other) AS level FROM nodes LEFT JOIN sl ON sl.node_id = nodes.node_id GROUP BY nodes.node_id) SELECT node_id, level + 1 - coalesce(lead(level) OVER (ORDER BY node_id), 0) AS closes FROM lv")
def trie_parens(spark, d):
    return S.trie_parens(url_nodes(spark, d))


@query(f"WITH {TRIE} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM u) AS strings, (SELECT CAST(sum(length(string)) AS BIGINT) FROM u) AS total, (SELECT CAST(max(length(string)) AS BIGINT) FROM u) AS longest")
def trie_stats(spark, d):
    size = F.length("string").cast("long")
    both = url_nodes(spark, d).select(F.lit(1).alias("node"), F.lit(None).cast("long").alias("size")).union(urls(spark, d).select(F.lit(None).cast("int"), size))
    return both.agg(F.count("node").alias("nodes"), F.count("size").alias("strings"), F.sum("size").alias("total"), F.max("size").alias("longest"))


@query(f"WITH {TRIE}, {EDGES}, {LINKS}, fl AS (SELECT node_id, arg_max(other, length) AS fail_id FROM sl GROUP BY node_id) SELECT nodes.node_id, (SELECT count(*) FROM edges WHERE edges.node_id = nodes.node_id) AS children, (SELECT count(*) FROM fl WHERE fl.fail_id = nodes.node_id) AS followers FROM nodes")
def trie_counts(spark, d):
    return S.trie_counts(url_nodes(spark, d))


#: Equal paths: nodes by their last k symbols; a node's way on is its set of next symbols, with '$' where a string ends.
MERGED = f"""{TRIE}, {EDGES}, wy AS (SELECT nodes.node_id, nodes.path, depth, list_sort(list(sym) FILTER (sym IS NOT NULL)) AS ways, min(child_id) AS child, count(u.string) > 0 AS ends
    FROM nodes LEFT JOIN edges ON edges.node_id = nodes.node_id LEFT JOIN u ON u.string = nodes.path GROUP BY ALL),
ks AS (SELECT *, right(path, k) AS tail FROM (SELECT *, unnest(generate_series(1, 20)) AS k FROM wy) WHERE depth >= k),
cl AS (SELECT k, tail, list_sort(list(node_id)) AS own, list_sort(list(child)) AS after, list(DISTINCT ways) AS ways, bool_or(ends) AS ends FROM ks GROUP BY ALL),
me AS (SELECT a.k, a.own, a.after, a.ways[1][1] AS sym FROM cl a JOIN cl b ON b.k = a.k AND b.own = a.after WHERE len(a.own) > 1 AND NOT a.ends AND len(a.ways) = 1 AND len(a.ways[1]) = 1),
gone AS (SELECT k, unnest(own) AS node_id FROM me),
al AS (SELECT k, node_id AS lo, 1 AS size, sym, child_id AS to_lo FROM edges, generate_series(1, 20) g(k) WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.k = g.k AND gone.node_id = edges.node_id)
       UNION ALL SELECT k, own[1], len(own), sym, after[1] FROM me)"""


def url_leaves(spark, d, nodes):
    return staged(S.trie_leaves(nodes, urls(spark, d)), "leaves")


@query(f"WITH {MERGED} SELECT CAST(k AS INT) AS k, count(*) AS edges, count(*) FILTER (size > 1) AS merged, CAST(coalesce(sum(size) FILTER (size > 1), 0) AS BIGINT) AS held FROM al GROUP BY k")
def txbwt_stats(spark, d):
    nodes = url_nodes(spark, d)
    return S.merged_orders(nodes, url_leaves(spark, d, nodes))


@query(f"WITH {MERGED}, bk AS (SELECT k FROM al GROUP BY k ORDER BY count(*), k LIMIT 1) SELECT lo, CAST(size AS BIGINT) AS size, sym, to_lo FROM al WHERE k = (SELECT k FROM bk)")
def txbwt_edges(spark, d):
    """Of the order with the fewest edges."""
    nodes = url_nodes(spark, d)
    leaves = url_leaves(spark, d, nodes)
    return S.merged_edges(nodes, leaves, [S.best_order(S.merged_orders(nodes, leaves))]).drop("k")


@query(f"WITH {MERGED}, bk AS (SELECT k FROM al GROUP BY k ORDER BY count(*), k LIMIT 1), on_ AS (SELECT lo, to_lo, size FROM al WHERE k = (SELECT k FROM bk)) SELECT node_id, (SELECT count(*) FROM on_ WHERE lo = node_id) AS dout, (SELECT count(*) FROM on_ WHERE to_lo = node_id) AS din FROM nodes")
def txbwt_shape(spark, d):
    """How many edges of the merged trie are stored at a node, and lead to it; 0 where a neighbour's edge stands for its own."""
    nodes = url_nodes(spark, d)
    leaves = url_leaves(spark, d, nodes)
    edges = staged(S.merged_edges(nodes, leaves, [S.best_order(S.merged_orders(nodes, leaves))]), "edges")
    out, into = edges.groupBy(F.col("lo").alias("node_id")).agg(F.count("*").alias("dout")), edges.groupBy(F.col("to_lo").alias("node_id")).agg(F.count("*").alias("din"))
    return nodes.select("node_id").join(out, "node_id", "left").join(into, "node_id", "left").na.fill(0)


FOUND = "hits AS (SELECT doc_id AS block, item_id AS record, unnest(list_filter(generate_series(1, length(d.text) - length(b.text) + 1), lambda i: substr(d.text, i, length(b.text)) = b.text)) + length(b.text) - 1 AS end_pos FROM documents d JOIN benchmark b ON contains(d.text, b.text))"


def patterns(spark, d):
    return X.table(spark, d, "benchmark").select(F.col("item_id").alias("record"), F.col("text").alias("pattern"))


@query(f"WITH {FOUND} SELECT block, CAST(end_pos AS BIGINT) AS end_pos, record FROM hits")
def mp_search(spark, d):
    return S.search(doc_blocks(spark, d), patterns(spark, d))


@query(f"WITH {FOUND} SELECT (SELECT count(*) FROM hits) AS found, (SELECT CAST(sum(length(text)) AS BIGINT) FROM documents) AS symbols")
def mp_search_stats(spark, d):
    blocks = doc_blocks(spark, d)
    hits = S.search(blocks, patterns(spark, d)).select(F.lit(1).alias("hit"), F.lit(None).cast("long").alias("size"))
    both = hits.union(blocks.select(F.lit(None).cast("int"), F.length("text").cast("long")))
    return both.agg(F.count("hit").alias("found"), F.sum("size").alias("symbols"))


@query(f"WITH {FOUND} SELECT block, CAST(end_pos AS BIGINT) AS end_pos, record FROM hits")
def txbwt_search(spark, d):
    """mp_search by a walk over the stored merged trie of the patterns."""
    path = f"{shared_dir(spark)}/trie-{uuid.uuid4().hex}"
    S.save_trie(path, patterns(spark, d).withColumnRenamed("pattern", "string"), "merged")
    return S.search_trie(doc_blocks(spark, d), path)


MISSING = """p AS (SELECT item_id AS record, text AS pattern, CASE WHEN item_id % 7 = 0 THEN reverse(text) ELSE text END AS put FROM benchmark WHERE text <> ''),
ex AS (SELECT CAST(sum(length(pattern)) OVER (ORDER BY record) AS BIGINT) AS end_pos, record FROM p), tx AS (SELECT string_agg(put, '' ORDER BY record) AS t FROM p),
fo AS (SELECT CAST(unnest(list_filter(generate_series(1, length(t) - length(pattern) + 1), lambda i: substr(t, i, length(pattern)) = pattern)) + length(pattern) - 1 AS BIGINT) AS end_pos, record FROM p, tx WHERE contains(t, pattern))"""


@query(f"WITH {MISSING} SELECT *, 'missing' AS side FROM (FROM ex EXCEPT ALL FROM fo) UNION ALL SELECT *, 'surplus' FROM (FROM fo EXCEPT ALL FROM ex)")
def mp_missing(spark, d):
    """Expected matches against found ones, both ways, in the concatenation of the patterns, every seventh of them damaged
    (reversed): those are missing."""
    p = staged(patterns(spark, d).where("pattern <> ''"), "patterns")
    at = F.sum(F.length("pattern")).over(Window.orderBy("record").rowsBetween(*Y.UPTO))
    expected = p.select(at.alias("end_pos"), "record")
    text = p.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("record", F.when(F.col("record") % 7 == 0, F.reverse("pattern")).otherwise(F.col("pattern")).alias("put")))), lambda s: s["put"]), "").alias("text")).withColumn("block", F.lit(0).cast("long"))
    found = S.search(text, p).select("end_pos", "record")
    return expected.exceptAll(found).withColumn("side", F.lit("missing")).union(found.exceptAll(expected).withColumn("side", F.lit("surplus")))


# Plans, fused transforms and codecs


@query(f"WITH RECURSIVE {CHAINS} SELECT block, run, height, columns FROM iv")
def prefix_interval_chains(spark, d):
    return P.chains(dialog_blocks(spark, d)).select("block", "run", "height", "columns")


@query(f"WITH RECURSIVE {CHAINS} SELECT block, run, rating FROM iv")
def interval_rating(spark, d):
    return P.chains(dialog_blocks(spark, d)).select("block", "run", "rating")


@query(f'WITH RECURSIVE {CHAINS} SELECT DISTINCT block, run_id AS run, kc.at AS "inner", hh AS inner_height FROM kc WHERE hh > h')
def overlap_graph(spark, d):
    return P.overlaps(dialog_blocks(spark, d))


@query()
def interval_rating_documents(spark, d):
    return P.chains(doc_blocks(spark, d))


@query(
    f"""WITH {ROWS}, {LF}, {RUNS}, {RLE}, c AS (SELECT rl.*, unnest([1, 2, 5, 10]) AS t, CASE WHEN rc > 0 THEN 1 + log2(1 + runs / rc) ELSE 0 END AS weight FROM rl)
SELECT block, CAST(t AS BIGINT) AS t, CAST(floor(t * weight + 0.5) AS BIGINT) AS benefit, round(CASE WHEN tall + 1 >= 4 * t + 2 THEN (t + 0.5) * (6 + 4 * log2((tall + 1) / (2 * t + 1) - 1)) ELSE 6 * (t + 0.5) END, 6) AS cost FROM c"""
)
def cost_model(spark, d):
    base = Y.rle(dialog_bwt(spark, d)).withColumn("t", F.explode(F.array(*[F.lit(t) for t in (1, 2, 5, 10)])))
    weight = F.when(F.col("rc") > 0, 1 + F.log2(1 + F.col("runs") / F.col("rc"))).otherwise(0)
    t = F.col("t")
    cost = F.when(F.col("tall") + 1 >= 4 * t + 2, (t + 0.5) * (6 + 4 * F.log2((F.col("tall") + 1) / (2 * t + 1) - 1))).otherwise(6 * (t + 0.5))
    return base.select("block", t.cast("long").alias("t"), F.floor(t * weight + 0.5).cast("long").alias("benefit"), F.round(cost, 6).alias("cost"))


@query("SELECT CAST(NULL AS BIGINT) AS block, CAST(NULL AS BIGINT) AS place, CAST(NULL AS BIGINT) AS run, CAST(NULL AS BIGINT) AS rating WHERE false")
def plan_none(spark, d):
    return P.plans(dialog_blocks(spark, d), ("none",)).drop("strategy")


MOST = f"""mp AS (SELECT *, least({HI.format("greatest(tall, 1)")} + 1, greatest(0, CAST(trunc((rating * weight - 2) / 4) AS BIGINT))) AS p FROM wi),
mt AS (SELECT *, CASE WHEN weight > 0 THEN trunc(greatest(0, (tall + 1) // (pow(2, p) + 2) - 0.5)) ELSE 0 END AS mt FROM mp),
mo AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY mt DESC) AS k FROM mt), tp AS (SELECT block, max(k) FILTER (mt >= k) AS top FROM mo GROUP BY block)"""


@query(f"WITH RECURSIVE {WEIGHED}, {MOST} SELECT mt.block, row_number() OVER (PARTITION BY mt.block ORDER BY rating DESC, run) - 1 AS place, run, rating FROM mt JOIN tp ON tp.block = mt.block WHERE mt >= top")
def plan_hirsch(spark, d):
    return P.plans(dialog_blocks(spark, d), ("hirsch",)).drop("strategy")


@query(
    f"""WITH RECURSIVE {WEIGHED}, ru AS (SELECT *, sum(rating) OVER (PARTITION BY block ORDER BY n) AS s FROM wi),
ga AS (SELECT *, floor(s * weight + 0.5) - CASE WHEN tall + 1 >= 4 * n + 2 THEN (n + 0.5) * (6 + 4 * log2((tall + 1) / (2 * n + 1) - 1)) ELSE 6 * (n + 0.5) END AS gain FROM ru WHERE weight > 0),
gb AS (SELECT block, min(n) AS t FROM ga WHERE gain > 0 AND gain = (SELECT max(gain) FROM ga g WHERE g.block = ga.block) GROUP BY block)
SELECT ga.block, n - 1 AS place, run, rating FROM ga JOIN gb ON gb.block = ga.block WHERE n <= t"""
)
def plan_greedy(spark, d):
    return P.plans(dialog_blocks(spark, d), ("greedy",)).drop("strategy")


@query(f"WITH RECURSIVE {WEIGHED} SELECT block, n - 1 AS place, run, rating FROM wi WHERE n <= many * 50 // 100")
def plan_bestp(spark, d):
    return P.plans(dialog_blocks(spark, d), ("best50",)).drop("strategy")


@query()
def plan_greedy_update(spark, d):
    return P.plans(doc_blocks(spark, d), ("update",)).drop("strategy")


@query()
def plans_documents(spark, d):
    return P.plans(doc_blocks(spark, d), ("hirsch", "greedy", "best10"))


@query()
def tunneled_bwt(spark, d):
    return P.fused_rows(doc_blocks(spark, d), "best100")


@query()
def aux_runs(spark, d):
    return P.aux_runs(P.fused_rows(doc_blocks(spark, d), "best100"))


@query()
def tunnel_stats(spark, d):
    return P.fused_stats(doc_blocks(spark, d))


@query(f"WITH {DIALOGS} SELECT block, text FROM dg")
def inverse_tunneled_bwt(spark, d):
    return P.fused_inverse(dialog_blocks(spark, d), "best100")


@query()
def plan_improvement(spark, d):
    """Of each strategy, what its plan gains over none, and how near to the best percentage."""
    gain = P.fused_stats(doc_blocks(spark, d)).withColumn("gain", F.when(F.col("tunnels") > 0, F.col("benefit") - F.col("cost")).otherwise(0.0))
    best = F.max("gain").over(Window.partitionBy("block"))
    return gain.select("block", "strategy", "tunnels", F.round("gain", 6).alias("gain"), F.when(best > 0, F.round(F.col("gain") / best, 6)).alias("share_of_best"))


def _roundtrip(name: str, of):
    """Over dialogs, and as name_documents over whole documents."""
    QUERIES[name] = lambda spark, d: of(dialog_blocks(spark, d))
    SQL[name] = f"WITH {DIALOGS} SELECT block, text FROM dg"
    _over_documents(name, of)


def _over_documents(name: str, of):
    QUERIES[f"{name}_documents"] = lambda spark, d: of(doc_blocks(spark, d))


_over_documents("tfm_invert", lambda b: P.invert_index(staged(P.fused_index(b), "index")))
_over_documents("twobit_roundtrip", lambda b: P.coder_roundtrip(b, "two_bits"))
_over_documents("zipped_index_roundtrip", lambda b: P.coder_roundtrip(b, "index"))
_over_documents("inverse_tunneled_bwt", lambda b: P.fused_inverse(b, "best100"))
_over_documents("codec_validate", P.damaged)


_roundtrip("range_roundtrip", lambda b: P.coder_roundtrip(b, "range32"))
_roundtrip("range64_roundtrip", lambda b: P.coder_roundtrip(b, "range64"))
_roundtrip("arith_roundtrip", lambda b: P.coder_roundtrip(b, "arith32"))
_roundtrip("arith64_roundtrip", lambda b: P.coder_roundtrip(b, "arith64"))
_roundtrip("codec_bw94", lambda b: P.codec_roundtrip(b, "greedy", "bw94"))
_roundtrip("codec_bcm", lambda b: P.codec_roundtrip(b, "greedy", "bcm"))
_roundtrip("codec_roundtrip", lambda b: P.coder_roundtrip(b, "container"))


@query(f"WITH {DIALOGS} SELECT block, true AS truncated, true AS enlarged FROM dg")
def codec_validate(spark, d):
    return P.damaged(dialog_blocks(spark, d))


@query()
def codec_block_sizes(spark, d):
    return P.codec_sizes(doc_blocks(spark, d))


@query()
def codec_xz(spark, d):
    return P.xz_sizes(doc_blocks(spark, d))


# Reports over results


def _sizes(spark, d):
    """By all methods that the reference's benchmark has a script for, but zpaq."""
    return P.codec_sizes(doc_blocks(spark, d), ("none", "hirsch", "greedy", "update"))


@query()
def bench_ratios(spark, d):
    """Bits per symbol, cut (not rounded) to three digits."""
    bits = F.col("coded") * 8 / F.greatest(F.col("size"), F.lit(1))
    return _sizes(spark, d).select("block", "method", (F.floor(bits * 1000) / 1000).alias("bps"))


@query()
def bench_best(spark, d):
    """The smallest method of each block; of equals the last by name."""
    return _sizes(spark, d).groupBy("block").agg(F.max_by("method", F.struct(-F.col("coded"), "method")).alias("best"), F.min("coded").alias("coded"))


@query(f"WITH {STATS}, g AS (SELECT doc_id, quality FROM labels) SELECT fs.doc_id, fs.size, fs.newlines, CAST(g.quality AS BIGINT) AS quality, CAST(floor(fs.newlines * 1000 / fs.size) / 1000 AS DOUBLE) AS density FROM fs LEFT JOIN g ON g.doc_id = fs.doc_id WHERE size > 0")
def bench_join(spark, d):
    stats = Y.file_stats(docs(spark, d)).where("size > 0").join(X.table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("quality")), "doc_id", "left")
    return stats.select("doc_id", "size", "newlines", "quality", (F.floor(F.col("newlines") * 1000 / F.col("size")) / 1000).alias("density"))


@query(f"WITH {STATS} SELECT doc_id, lang, round((size - min(size) OVER w) / (max(size) OVER w - min(size) OVER w + 1), 6) AS share, round(1 - (size - min(size) OVER w) / (max(size) OVER w - min(size) OVER w + 1), 6) AS rest FROM fs WINDOW w AS (PARTITION BY lang)")
def bench_matrix(spark, d):
    """Sizes between the least and the greatest of a language, and the rest to one; the divisor is never zero."""
    w = Window.partitionBy("lang")
    share = (F.col("size") - F.min("size").over(w)) / (F.max("size").over(w) - F.min("size").over(w) + 1)
    return Y.file_stats(docs(spark, d)).select("doc_id", "lang", F.round(share, 6).alias("share"), F.round(1 - share, 6).alias("rest"))
