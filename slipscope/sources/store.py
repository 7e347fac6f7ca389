"""Reading and writing the tables of a run."""

from __future__ import annotations

import atexit
import hashlib
import json
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import archive

_STRINGS = ["task_id", "domain", "prompt", "ground_truth"]
METADATA = "metadata STRUCT<aliases:ARRAY<STRING>, full_solution:STRING, correct_ending:STRING, label_idx:INT>"
TASKS = ", ".join(f"{c} STRING" for c in _STRINGS) + f", {METADATA}"
RESPONSES = TASKS + ", response STRING"
JUDGED = RESPONSES + ", is_correct BOOLEAN, extracted_answer STRING"
ACTIVATIONS = "task_id STRING, layer_idx INT, act ARRAY<FLOAT>"
PROBES = "layer_idx INT, accuracy DOUBLE, auc DOUBLE, n_train BIGINT, n_test BIGINT"
ISD = "task_id STRING, domain STRING, is_correct BOOLEAN, layer_scores MAP<INT,DOUBLE>, isd_score DOUBLE"
FEATURES = (
    "task_id STRING, domain STRING, n_boosters BIGINT, n_hedges BIGINT, booster_ratio DOUBLE, n_direct_evidence BIGINT, "
    "n_indirect_evidence BIGINT, n_bald_assertions BIGINT, claim_in_first_sentence BOOLEAN, n_concessive_structures BIGINT, "
    "definite_reference_ratio DOUBLE, declarative_ratio DOUBLE, active_voice_ratio DOUBLE, mean_sentence_length DOUBLE, "
    "n_sentences BIGINT, has_repetition BOOLEAN, lcs_score DOUBLE"
)
SCORED = "task_id STRING, domain STRING, is_correct BOOLEAN, isd_score DOUBLE, lcs_score DOUBLE, pei_score DOUBLE, pei_rank BIGINT"
EXTENDED = SCORED + ", pei_multiplicative DOUBLE"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Where it is unset, a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return folder.rstrip("/")


_swept: set[str] = set()


def removed(spark: SparkSession, path: str) -> None:
    """Remove a folder, wherever it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in this application's part of the shared folder; that part goes when Python ends, if Spark still runs then."""
    own = f"{shared_dir(spark)}/slipscope/{spark.sparkContext.applicationId}"
    if own not in _swept:
        _swept.add(own)
        atexit.register(_sweep, spark, own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def _sweep(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        removed(spark, path)


def staged(df: DataFrame, name: str = "stage", **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, and outlives executors. options: the writer's."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._slipscope_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables made by ``staged`` that nothing still to run reads."""
    for table in tables:
        removed(table.sparkSession, table._slipscope_path)


def write_jsonl(df: DataFrame, path: str, order: str | None = None) -> None:
    """JSON Lines; with ``order``, dealt by ranges, so that files and the lines in them follow that order."""
    out = df.orderBy(order) if order else df
    out.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines of a fixed schema; malformed rows and missing types fail. Integer map keys come back from text."""
    wanted = T._parse_datatype_string(schema)
    maps = [f.name for f in wanted if isinstance(f.dataType, T.MapType) and isinstance(f.dataType.keyType, T.IntegerType)]
    as_text = T.StructType([T.StructField(f.name, T.MapType(T.StringType(), f.dataType.valueType)) if f.name in maps else f for f in wanted])
    df = spark.read.schema(as_text).option("mode", "FAILFAST").json(path)
    for m in maps:
        df = df.withColumn(m, F.transform_keys(m, lambda k, v: k.cast("int")))
    return df


def write_activations(df: DataFrame, path: str) -> None:
    df.select("task_id", "layer_idx", "act").write.mode("overwrite").partitionBy("layer_idx").parquet(path)


def read_activations(spark: SparkSession, path: str) -> DataFrame:
    """Folders by layer: a filter on layer_idx reads only those."""
    return spark.read.parquet(path).select("task_id", F.col("layer_idx").cast("int").alias("layer_idx"), "act")


def import_npz(spark: SparkSession, path: str, task_ids: DataFrame | list[str]) -> DataFrame:
    """Activations from an archive of arrays ``layer_<k>``, read by tasks in ranges of rows.

    task_ids: the ids in the order of the rows, as a list or as a table (row from 0, task_id). Another number of ids than
    of rows is an error.
    """
    ids = task_ids if isinstance(task_ids, DataFrame) else spark.createDataFrame(list(enumerate(task_ids)), "row bigint, task_id string")
    n = ids.count()
    if wrong := {k: m for k, m in archive.lengths(path).items() if m != n}:
        raise ValueError(f"{n} ids, but rows by layer: {wrong}")
    return archive.read_npz(spark, path).join(ids.select("row", "task_id"), "row").select("task_id", "layer_idx", "act")


def write_report(spark: SparkSession, path: str, **tables: DataFrame) -> None:
    """Small tables (summaries, examples) as one indented JSON file, wherever Spark can write."""
    text = json.dumps({name: [r.asDict(recursive=True) for r in df.collect()] for name, df in tables.items()}, indent=2, default=str)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def fingerprint(spark: SparkSession, inputs: Iterable[DataFrame] = (), **settings: object) -> str:
    """A digest of settings and of the folders that tables are read from: names, lengths and times of change of their files."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    wanted = sorted({f for df in inputs for f in df.inputFiles()})
    files = []
    for folder in sorted({f.rsplit("/", 1)[0] for f in wanted}):
        at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        for s in at.getFileSystem(hadoop).listStatus(at):
            if s.isFile() and s.getPath().getName()[0] not in "._":
                files.append((folder, s.getPath().getName(), s.getLen(), s.getModificationTime()))
    return hashlib.sha256(json.dumps([wanted, sorted(files), settings], sort_keys=True, default=str).encode()).hexdigest()


_STAMP = "_made_of"


def stamped(spark: SparkSession, path: str) -> str | None:
    """The fingerprint beside a table that was written to its end; None without either."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    mark, done = (jvm.org.apache.hadoop.fs.Path(f"{path}/{n}") for n in (_STAMP, "_SUCCESS"))
    system = mark.getFileSystem(hadoop)
    if not system.exists(done) or not system.exists(mark):
        return None
    stream = system.open(mark)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def stamp(spark: SparkSession, path: str, value: str) -> None:
    """Put a fingerprint beside a table. Writing the table anew removes it, so that what fails midway is made again."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{_STAMP}")
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(value.encode()))
    out.close()


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame], inputs: Iterable[DataFrame] | None = None, **settings: object) -> DataFrame:
    """The table at the path if it was written to its end, else made and written first.

    With inputs or settings, only if it was made of the same: of tables whose files have not changed, and with equal
    settings.
    """
    told = inputs is not None or bool(settings)
    if told:
        wanted = fingerprint(spark, inputs or (), **settings)
        ready = stamped(spark, path) == wanted
    else:
        mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        ready = mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)
    if not ready:
        make().write.mode("overwrite").parquet(path)
        if told:
            stamp(spark, path, wanted)
    return spark.read.parquet(path)
