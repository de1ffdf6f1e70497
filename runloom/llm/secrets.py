"""Secret scans through a ledger of content-addressed blobs; DataFrame functions only.

Every version of every path is reduced to the SHA-256 of its text.  Only pairs of blob and rule version that the
ledger does not hold are scanned, one copy of each blob; findings belong to blobs and are joined back to all paths.

Positions come from Java's own leftmost, non-overlapping matches: ``split`` gives the texts between the matches and
``regexp_extract_all`` the matches, so a running sum of their lengths gives where each begins (code points).

The ledger's path is an argument or the session's ``spark.runloom.ledger``: a later run over it scans what is new alone.
Without either, a run has a ledger of its own.  Findings by blob are written before they are joined, so that a small table
of them is broadcast and, of a large one, adaptive plans can split the rows of a blob with very many paths.

Null texts are empty ones, which hold nothing; null paths are kept; repeated rows each get their blob's findings, and one
of them is scanned; spans that begin together are in the order of the rules; texts of any length are matched whole; an
empty table gives none; other columns, whatever their names, stay out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Rule:
    """A pattern; of its matches those count whose ``group`` has at least ``least`` characters.  ``hint`` finds no fewer texts than the pattern and is cheap."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    version: int = 1
    hint: str | None = None

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


_WORD = "(?i:(password|passwd|secret|token|api_?key))"
BASE = (
    Rule("assign", _WORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, hint=_WORD + r"""["']?\x20*[:=]"""),
    Rule("access", r"AKIA[A-Z0-9]+", 20, hint=r"AKIA[A-Z0-9]{16}"),
    Rule("hex", r"[0-9a-f]+", 24, hint=r"[0-9a-f]{24}"),
)
_MORE = r"PRIVATE KEY|eyJ|gh[pousr]_|xox[abprs]-|AIza|://|earer\x20"
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", hint=_MORE),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint=_MORE),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", hint=_MORE),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", hint=_MORE),
    Rule("cloud", r"AIza[0-9A-Za-z_-]{35}", hint=_MORE),
    Rule("url", r"://[^/\s:@]{1,100}:[^/\s:@]{1,100}@", hint=_MORE),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/-]{20,}=*", hint=_MORE),
)
RULES = BASE + MORE


def _matches(text: Column, rule: Rule, number: int, wanted: Column) -> Column:
    """array<struct<rule, at, gap, size, ok>>: for each match what lies before it, how long it is and whether it counts."""
    pattern = F.lit(rule.pattern)
    zipped = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"),
        *([F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("value")] if rule.group else []),
    )
    found = F.transform(
        F.filter(zipped, lambda x: x["match"].isNotNull()),
        lambda x, i: F.struct(
            F.lit(number).alias("rule"), i.alias("at"), F.length(x["gap"]).cast("long").alias("gap"), F.length(x["match"]).cast("long").alias("size"),
            (F.length(x["value" if rule.group else "match"]) >= rule.least).alias("ok"),
        ),
    )
    return F.when(wanted, found)


class Ledger:
    """Blobs scanned so far with the rule versions they were scanned by, and findings, as tables under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        if not self._exists():
            spark.createDataFrame([], "blob string, rule string").write.parquet(f"{path}/scanned")
            spark.createDataFrame([], "blob string, rule string, kind string, number int, start long, stop long").write.parquet(f"{path}/findings")

    def _exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/findings/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def scanned(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/scanned")

    def findings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/findings")

    def unseen(self, versions: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
        """(blob, path, times, todo): one path of each blob that some rule version has not seen, how many rows have both,
        and those rules' keys."""
        every = F.array(*[F.lit(r.key) for r in rules])
        rows = versions.groupBy("blob", "path").agg(F.count("*").alias("times"))
        blobs = rows.groupBy("blob").agg(F.min(F.struct("path", "times")).alias("x")).select("blob", "x.*")
        seen = self.scanned().groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        todo = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
        return blobs.join(seen, "blob", "left").select("blob", "path", "times", todo.alias("todo")).where(F.size("todo") > 0)

    def update(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES, names: DataFrame | None = None) -> int:
        """Scans what is unseen in versions (path, text, blob) and appends it; names: their path and blob alone, if they
        are written already.  Findings go first: after a failure in between, the pairs are scanned again, and readers take
        findings as a set.  Gives the number of blobs scanned."""
        with common.scratch(self.spark) as stage:
            first = stage(self.unseen(versions.select("path", "blob") if names is None else names, rules), "unseen")
            sums = first.agg(F.count("*").alias("n"), F.coalesce(F.max("times"), F.lit(0)).alias("most")).first()
            if not sums.n:
                return 0
            rows = versions.join(first.hint("shuffle_hash"), ["blob", "path"])
            if sums.most > 1:
                rows = rows.where("times = 1").union(rows.where("times > 1").dropDuplicates(["blob", "path"]))
            # Each distinct hint is looked for once a text, whatever the number of rules that have it.
            hints = list(dict.fromkeys(r.hint or r.pattern for r in rules))
            rows = rows.select("blob", "text", "todo", F.array(*[F.col("text").rlike(h) for h in hints]).alias("hinted"))
            none = F.array().cast("array<struct<rule:int,at:int,gap:bigint,size:bigint,ok:boolean>>")
            cells = [F.coalesce(_matches(F.col("text"), r, k, F.get("hinted", F.lit(hints.index(r.hint or r.pattern))) & F.array_contains("todo", r.key)), none) for k, r in enumerate(rules)]
            found = rows.select("blob", F.explode(F.flatten(F.array(*cells))).alias("m")).select("blob", "m.*")
            before = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("blob", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
            keys, kinds = F.array(*[F.lit(r.key) for r in rules]), F.array(*[F.lit(r.kind) for r in rules])
            placed = found.withColumn("start", before).where("ok")
            placed.select("blob", keys[F.col("rule")].alias("rule"), kinds[F.col("rule")].alias("kind"), F.col("rule").alias("number"), "start", (F.col("start") + F.col("size")).alias("stop")).write.mode("append").parquet(f"{self.path}/findings")
            first.select("blob", F.explode("todo").alias("rule")).write.mode("append").parquet(f"{self.path}/scanned")
            return sums.n


def versions(docs: DataFrame) -> DataFrame:
    """(doc_id, path, text, blob): a document's identity is its path; blob is the SHA-256 of the text."""
    return common.documents(docs).select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("path"), "text", F.sha2("text", 256).alias("blob"))


def report(rows: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row (doc_id, blob): findings of its blob."""
    known = ledger.findings().where(F.col("rule").isin([r.key for r in rules])).distinct()
    span = F.concat_ws(":", "kind", "start", "stop")
    lists = known.select("blob", "kind", "number", F.struct("start", "number", span.alias("span")).alias("s"))
    base = [r.kind for r in BASE]
    of_blob = lists.groupBy("blob").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in base],
        F.sort_array(F.collect_list(F.when(F.col("kind").isin(base), F.col("s")))).alias("base"),
        F.sort_array(F.collect_list("s")).alias("all"),
    )
    joined = lambda c: F.concat_ws(",", F.transform(c, lambda s: s["span"]))
    of_blob = common.staged(of_blob.select("blob", *[f"n_{k}" for k in base], F.sha2(joined("base"), 256).alias("base_sha256"), joined("all").alias("spans")), "by-blob")
    return rows.join(of_blob, "blob", "left").select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in base],
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def ledger_of(spark: SparkSession, path: str | None = None) -> Ledger:
    return Ledger(spark, path or spark.conf.get("spark.runloom.ledger", None) or common.new_path(spark, "ledger"))


def scan(docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Brings the ledger up to date with docs and reports on all of them."""
    ledger = ledger_of(docs.sparkSession, ledger_path)
    every = versions(docs.select("doc_id", "text"))
    # Hashes are taken once for the names and once where a text goes to its scanner.
    names = common.staged(every.select("doc_id", "path", "blob"), "names")
    ledger.update(every.drop("doc_id"), rules, names)
    return report(names.select("doc_id", "blob"), ledger, rules)


def redact(docs: DataFrame, mark: str = "<secret>", ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every finding, overlapping ones together, replaced by ``mark``; n_chars, if docs has it, follows."""
    ledger = ledger_of(docs.sparkSession, ledger_path)
    ledger.update(versions(docs.select("doc_id", "text")).drop("doc_id"), rules)
    found = ledger.findings().where(F.col("rule").isin([r.key for r in rules])).select("blob", "start", "stop").distinct()
    order = Window.partitionBy("blob").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    joined = marked.withColumn("n", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("blob", "n").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    of_blob = common.staged(joined.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("cuts")), "cuts")
    text = F.col(common.place(docs, "text"))
    rows = common.numbered(docs).withColumn("blob", F.sha2(F.coalesce(text, F.lit("")), 256)).join(of_blob, "blob", "left")
    before = F.transform("cuts", lambda c, i: text.substr(F.when(i == 0, 0).otherwise(F.get("cuts", i - 1)["stop"]) + 1, c["start"] - F.when(i == 0, 0).otherwise(F.get("cuts", i - 1)["stop"])))
    last = F.element_at("cuts", -1)["stop"]
    clean = F.concat(F.array_join(before, mark), F.lit(mark), text.substr(last + 1, F.length(text)))
    rows = rows.withColumn(common.place(docs, "text"), F.when(F.col("cuts").isNull(), text).otherwise(clean))
    if "n_chars" in docs.columns:
        n = common.place(docs, "n_chars")
        rows = rows.withColumn(n, F.when(F.col("cuts").isNull(), F.col(n)).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType))
    return common.named(rows, docs)


def sql() -> str:
    """The same report over the table documents, for DuckDB."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    arms = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS number, {quoted(r.kind)} AS kind, string_split_regex(t, {quoted(r.pattern)}) AS p, regexp_extract_all(t, {quoted(r.pattern)}, 0) AS m, regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS v, {r.least} AS least FROM d WHERE regexp_matches(t, {quoted(r.pattern)})"
        for k, r in enumerate(RULES)
    )
    base = ", ".join(quoted(r.kind) for r in BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS ({arms}),
i AS (SELECT *, unnest(generate_series(1, len(m))) AS k FROM a),
s AS (SELECT doc_id, number, kind, length(m[k]) AS size, list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS start
      FROM i WHERE length(v[k]) >= least),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      coalesce(string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT), ',' ORDER BY start, number) FILTER (kind IN ({base})), '') AS base,
      string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT), ',' ORDER BY start, number) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""
