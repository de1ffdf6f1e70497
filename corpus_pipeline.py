"""From documents to packed sequences, each stage written and read again.

In every stage null texts count as empty; null ids, languages and sources are values like any other; repeated rows are rows
of their own until the near-duplicate stage, which leaves one; an empty table goes through all stages empty; columns other
than doc_id, text, lang, source and n_chars, whatever their names, stay as they are until packing; texts of any length are
read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runloom.llm import common, nearcopies, outliers, packing, ruleclassifier, secrets, simhash


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents whose score is at least 0.7 stay (a score of 0.7 too).  Empty and null texts have the score of
    their zero statistics; without labels every score is 0.5 and none stays."""
    return ruleclassifier.keep(docs, ruleclassifier.train(docs, common.table(spark, sf_dir, "labels")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that pass the base rules and are no outliers of their language and source stay; null and empty
    texts fail the base rules; a distance at the cut stays."""
    return outliers.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of documents whose five-word prints are within 3 bits one stays, that of the least id.  Prints of
    documents with a Jaccard similarity of 0.8 lie some ten bits apart, beyond pigeonhole blocks, so what is left is
    compared once more: of those whose five-word shingles have a similarity of at least 0.8 one stays."""
    return nearcopies.keep(docs, among=simhash.keepers(docs, width=5))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: all documents stay; secrets in them are replaced by a mark, and n_chars follows; null texts stay null."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one row for each placed piece; null and empty texts are their end id."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("packing", pack),
]

#: SQL can't express the classifier's fit, the concentration steps or the differencing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
