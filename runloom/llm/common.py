"""Tables, staged results and texts for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir, or where that is unset on one machine (tests) one of our own."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.runloom.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        known = f"file://{tempfile.mkdtemp(prefix='runloom-')}"
        spark.conf.set("spark.runloom.dir", known)
    return known.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df into the shared folder and reads it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def path_of(df: DataFrame) -> str:
    return df.inputFiles()[0].rsplit("/", 1)[0]


@contextmanager
def scratch(spark: SparkSession):
    """stage(df, name) as ``staged``; all are removed at the end."""
    paths = []

    def stage(df: DataFrame, name: str) -> DataFrame:
        paths.append(path := new_path(spark, name))
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield stage
    finally:
        for path in paths:
            remove(spark, path)


def documents(df: DataFrame) -> DataFrame:
    """Identity and text only; null texts are empty.  Other columns, whatever their names, stay out."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def place(docs: DataFrame, column: str) -> str:
    """The name that ``numbered`` gives to a column."""
    return f"_{docs.columns.index(column)}"


def numbered(docs: DataFrame) -> DataFrame:
    """docs with columns _0, _1 and on, so that none clashes with what is added; ``named`` undoes it."""
    return docs.toDF(*[f"_{k}" for k in range(len(docs.columns))])


def named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[f"_{k}" for k in range(len(docs.columns))]).toDF(*docs.columns)


def text_hash(text: str) -> Column:
    """What stands for a text in narrow tables; a null text is empty."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def chosen(docs: DataFrame, keepers: DataFrame) -> DataFrame:
    """Of docs one row for each (keeper, v), with all its columns: keeper is its id or null, v its text's hash; of repeats
    the least by the other columns.  Rows are moved once: the join's key is one hash, what it stands for is compared
    by conditions that are no keys, and the window goes by the join's partitions."""
    own, text = place(docs, "doc_id"), place(docs, "text")
    rows = numbered(docs)
    names = rows.columns
    rows = rows.withColumn("_v", text_hash(text)).withColumn("_id", F.col(own).cast("long")).withColumn("_h", F.xxhash64("_v", "_id"))
    marked = keepers.select("keeper", "v", F.xxhash64("v", "keeper").alias("h")).hint("shuffle_hash")
    same_id = (F.col("_id").isNull() & F.col("keeper").isNull()) | (F.col("_id").bitwiseXOR(F.col("keeper")) == 0)
    met = rows.join(marked, (F.col("_h") == F.col("h")) & (F.col("_v").bitwiseXOR(F.col("v")) == 0) & same_id)
    order = [F.col(text).asc_nulls_last(), *[F.col(c).cast("string") for c in names if c != text]]
    return named(met.withColumn("nth", F.row_number().over(Window.partitionBy("h", "v", "keeper").orderBy(*order))).where("nth = 1"), docs)


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """Long texts make Arrow batches large: fewer rows in each."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def parts(batch: pa.RecordBatch, column: str, most_bytes: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes of text each."""
    texts = batch.column(batch.schema.get_field_index(column))
    at, total, sizes = 0, 0, pc.binary_length(texts).to_pylist()
    for k, n in enumerate(sizes):
        if total and total + (n or 0) > most_bytes:
            yield batch.slice(at, k - at)
            at, total = k, 0
        total += n or 0
    if at < len(sizes):
        yield batch.slice(at)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list[np.ndarray], list[int]]]:
    """For input sorted by its first ``keys`` integer columns: columns, and the borders of the keys that are whole in
    them.  Only the rows of the last key of a batch wait for the next one."""
    rest = None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        now = now if rest is None else [np.concatenate(p) for p in zip(rest, now, strict=True)]
        if not len(now[0]):
            continue
        new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in now[:keys]])) + 1
        if len(new):
            yield now, [0, *new.tolist()]
        rest = [c[new[-1] if len(new) else 0 :] for c in now]
    if rest is not None:
        yield rest, [0, len(rest[0])]


def dealt(rows: DataFrame, keys: list[str], item: str, most: int, attach: DataFrame | None = None) -> DataFrame:
    """rows whose key has company, sorted by it within partitions and preceded by keys, c, d, own.  A key with more than
    ``most`` rows is split into chunks by the hash of ``item``, and each pair of chunks (c, d) becomes a key of its own,
    so that any two rows of a key meet in one task and no task needs more than two chunks; own is the row's chunk."""
    held = rows.groupBy(*keys).agg(F.count("*").alias("chunks")).where("chunks > 1").withColumn("chunks", F.ceil(F.col("chunks") / most).cast("int"))
    rest = [c for c in rows.columns if c not in keys]
    own = F.pmod(F.xxhash64(item), F.col("chunks")).cast("int")
    out = rows.join(held, keys).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    out = out.select(*keys, F.least("own", "other").alias("c"), F.greatest("own", "other").alias("d"), "own", *rest)
    out = out if attach is None else out.join(attach, item).select(*out.columns, *[c for c in attach.columns if c != item])
    return out.repartition(*keys, "c", "d").sortWithinPartitions(*keys, "c", "d")
