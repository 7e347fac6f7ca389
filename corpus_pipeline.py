"""A training-text pipeline: five stages, each written as Parquet and read again as the next one's documents.

All stages but the last return the columns of documents. Where an id is null or comes twice, the stages that compare
documents name rows by a key of their own, so that every row is a document for itself.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipscope.llm import byte_bpe, decontaminate, jaccard_join, quality, secret_scan
from slipscope.llm.shared import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def shielded(stage: Stage) -> Stage:
    """The stage with all columns but those of documents renamed meanwhile, so that no name of its own clashes."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        return stage(spark, docs.toDF(*[n if n in COLUMNS else f"_extra_{i}" for i, n in enumerate(names)]), sf_dir).toDF(*names)

    return run


@shielded
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tail probability selects them; the rest go.

    Null texts count as empty; repeated rows go or stay alike, whatever their ids; with fewer than two grades among the
    labels, or an empty table, nothing is dropped.
    """
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).where("selected").select(*docs.columns)


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs and the column that names its rows: doc_id, or a key written with them where an id is null or comes twice."""
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        return docs, "doc_id"
    return written(docs.withColumn("_row", F.monotonically_increasing_id()), "keyed"), "_row"


@shielded
def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by n-gram similarity, directly or through others, the one with the smallest id stays.

    Of linked rows that share this id, the one whose text has the least hash stays. Rows without an id all stay, and may
    link others. Null texts and texts without words are linked with nothing and stay; an empty table gives an empty one.
    """
    rows, key = keyed(docs)
    groups = jaccard_join.grouped(rows, key)
    if key == "doc_id":
        return rows.join(groups.where("doc_id = component_id").select("doc_id"), key, "left_semi").select(*docs.columns)
    parts = groups.select(F.col("doc_id").alias(key), F.col("component_id").alias("_part"))
    named = rows.where("doc_id is not null")
    order = F.struct("doc_id", F.xxhash64("text").alias("_text"), key)
    first = named.select(key, order.alias("_order")).join(parts, key).groupBy("_part").agg(F.min("_order").alias("_first")).select(F.col(f"_first.{key}").alias(key))
    return named.join(first, key, "left_semi").unionByName(rows.where("doc_id is null")).select(*docs.columns)


@shielded
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also with other numbers and names, go.

    Rows without an id, and rows that share one, are judged each by its own text. Null and empty texts hold nothing and
    stay; repeated rows go or stay alike; an empty table, or an empty benchmark, drops nothing.
    """
    rows, key = keyed(docs)
    found = decontaminate.leaks(rows.select(F.col(key).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.join(found.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").select(*docs.columns)


@shielded
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; all documents stay.

    Null and empty texts stay as they are; overlapping spans share one mark; repeated rows are redacted alike, ids play no
    part; an empty table gives an empty one.
    """
    found = secret_scan.scan(docs)
    text = secret_scan.redacted(F.col("text"), F.col("spans"))
    changed = found.withColumn("text", text).withColumn("n_chars", F.when(F.size("spans") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, the packed ids in base 64, and digests of the ids and of the decoded bytes.

    Null and empty texts have no tokens and digests of no bytes; repeated rows are encoded each for itself, ids may be
    null; an empty table gives an empty one.
    """
    vocabulary = byte_bpe.published_vocabulary()
    out = byte_bpe.encode(docs, vocabulary, keep=("doc_id", "lang", "source"), decoded="decoded")
    return out.select("doc_id", "lang", "source", "n_tokens", F.base64("ids").alias("ids"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", redact_secrets),
    ("byte-level BPE encoding and decoding", encode),
]

#: The first stage is a fitted model: SQL can't express it. tests/llm/test_pipeline.py holds the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
