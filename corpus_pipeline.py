"""The corpus pipeline: raw documents to packed batches in five stages.

Each stage takes all documents that the stage before kept, as written to
Parquet and read again. All but the last return the columns of ``documents``.

1. quality rules: the learned decision list drops documents it rejects. The
   list is learned on every labelled document, short ones included, so that the
   stage drops what was labelled bad and keeps short clean texts;
2. MinHash near-dedup: 5-word shingles, similarity 0.8, the smallest id stays;
3. substring dedup: passages of 50 words that an earlier document has are cut;
4. secret scans: every secret's span gives way to a mark;
5. packing: token-budget batches in optimal length buckets.

``n_chars`` follows the text. Other columns pass through as they are, whatever
their names. Null and empty texts and texts of a few words pass every stage (a
null text stays null); rows without an id are kept by near-dedup and lose no
passage; repeated rows fall in one class, of which near-dedup keeps the smallest
id with all its rows. Very long texts are read whole. Empty tables give no batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.llm import near_dup, packing, quality, secrets, substrings
from fieldweave.llm.common import scratch, stage


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now, where the table has that column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.deduplicate(docs, width=5, threshold=(80, 100))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(substrings.remove_repeats(docs, width=50, rounds=4, counts=False))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(secrets.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("secret scans", secret_spans),
    ("packing", packed),
]

#: Learned rules and the random field are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; of the tables between them the one that the result reads stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (_, last) = STAGES
    with scratch(spark) as kept:
        for name, step in first:
            with scratch(spark) as written:
                docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
                written.append(docs)
        kept.append(docs)
    return last(spark, docs, sf_dir)
