"""From raw documents to token ids: toxicity, line and near duplicates, benchmark passages, encoding.

Each stage takes (spark, docs, sf_dir), works on all documents its predecessor kept and returns a DataFrame;
``run`` writes each result as Parquet and reads it back. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm import bpe, decontaminate, line_dedup, near_dup, toxicity
from fieldspark.llm.queries import vocabulary_path
from fieldspark.llm.tables import store, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the model is fitted on the labelled rows of ``docs``."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, out="toxicity_score").filter("toxicity_score < 0.5").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many of them share; a text may become empty, a null one stays null."""
    kept = line_dedup.dedup_lines(docs).withColumn("text", F.col("lines.kept"))
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (five-word shingles, similarity 0.8)."""
    extra = near_dup.near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(extra, "doc_id", "left_anti").select(*COLUMNS)


def reject_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth are benchmark passages."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(~decontaminate.contaminated()).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the number of tokens and the digest of the decoded text."""
    coded = bpe.tokenize(docs.select("doc_id", "text", "lang", "source"), vocabulary_path())
    return coded.select(
        "doc_id", "lang", "source", F.size("tokens.ids").cast("bigint").alias("n_tokens"), F.col("tokens.ids").alias("token_ids"),
        F.sha2("tokens.decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", keep_one_of_each),
    ("decontamination", reject_contaminated),
    ("encoding", encode),
]

#: The model of the first stage and the links of the third are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
