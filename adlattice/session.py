"""Session set-up and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Compressed input per range partition; what it grows to in memory still fits a task.
PARTITION_INPUT = 96 << 20
# The same where a task sorts or aggregates whole token rows: some millions of them, a few hundred MB.
ROW_INPUT = 16 << 20
# Catalyst's mark for a leaf that it can't measure lies above.
UNKNOWN_SIZE = 1 << 60


def build_session(
    app: str = "adlattice",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with adaptive execution and skew handling switched on."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset a local session gets a scratch folder; a cluster session is refused, because
    executors on other machines could not read a driver-local path.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        named = tempfile.mkdtemp(prefix="adlattice-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path inside the shared folder that no other job uses."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def _is_written(df: DataFrame) -> bool:
    """Whether the frame is a file table, or nothing but columns of one."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.nodeName() == "Project":
        columns = plan.projectList()
        if any(columns.apply(i).nodeName() != "AttributeReference" for i in range(columns.size())):
            return False
        plan = plan.child()
    return plan.nodeName() == "LogicalRelation"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder as Parquet and go on from there.

    Needed where a plan reads the outcome of a sampled range partitioning more than once: both
    readers must see the same partition borders, also after an executor is lost. A frame that is
    read straight from files is returned as it is.
    """
    if _is_written(df):
        return df
    spark = df.sparkSession
    path = fresh_path(spark, "kept")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts_by(df: DataFrame, keys: list[str]) -> int | None:
    """How many parts the rows are hash-partitioned into by exactly these columns; None where they aren't.

    Asked from the plan of an aggregation by them, which shuffles if they aren't.
    """
    plan = lambda frame: frame._jdf.queryExecution().executedPlan()
    asked = plan(df.groupBy(*keys).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("_row")))
    first = asked.initialPlan() if asked.nodeName() == "AdaptiveSparkPlan" else asked
    found = re.fullmatch(r"hashpartitioning\((.*), (\d+)\)", first.outputPartitioning().toString())
    if not found or asked.toString().count("Exchange ") > plan(df).toString().count("Exchange "):
        return None
    names = [re.sub(r"#\d+L?$", "", c.strip()) for c in found[1].split(",")]
    return int(found[2]) if names == list(keys) else None


def lies_by(df: DataFrame, keys: list[str], parts: int | None = None) -> bool:
    """Whether the rows are hash-partitioned by exactly these columns already (into ``parts``, if given)."""
    found = parts_by(df, keys)
    return found is not None and parts in (None, found)


def placed_by(df: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """``df`` hash-partitioned by the columns; rows that lie so already, as in a bucketed table, aren't moved."""
    if lies_by(df, keys, parts):
        return df
    return df.repartition(parts, *keys) if parts else df.repartition(*keys)


def colocated(df: DataFrame, keys: list[str], path: str | None = None, parts: int | None = None, folders: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once as a table bucketed by ``keys``, sorted by them, in the shared folder or ``path``.

    Joins, aggregations and windows by these keys on what is returned need no shuffle of it, nor of another table with as many
    buckets. The number of buckets follows the bytes read. ``folders`` are columns that divide the files. The files are plain Parquet;
    a note beside them lets ``read_colocated`` find the layout in another session.
    """
    spark = df.sparkSession
    parts = parts or partitions_for(df) or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = path or fresh_path(spark, "colocated")
    writer = placed_by(df, keys, parts).write.bucketBy(parts, *keys).sortBy(*keys).option("path", path)
    if folders:
        writer = writer.partitionBy(*folders)
    writer.saveAsTable(f"colocated_{uuid.uuid4().hex}")
    note = [(parts, ",".join(keys), ",".join(folders))]
    spark.createDataFrame(note, "parts int, keys string, folders string").coalesce(1).write.mode("overwrite").json(f"{path}.layout")
    return read_colocated(spark, path)


def read_colocated(spark: SparkSession, path: str) -> DataFrame:
    """A table that ``colocated`` wrote, with its layout."""
    note = spark.read.schema("parts int, keys string, folders string").json(f"{path}.layout").first()
    folders = [c for c in note["folders"].split(",") if c]
    fields = spark.read.parquet(path).schema
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    name = f"colocated_{uuid.uuid4().hex}"
    divided = f"PARTITIONED BY ({', '.join(folders)})" if folders else ""
    keys = note["keys"].replace(",", ", ")
    where = path.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet {divided} CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {note['parts']} BUCKETS LOCATION '{where}'"
    )
    if folders:
        spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``durable`` or ``colocated`` wrote and that nothing reads any more."""
    spark = df.sparkSession
    home = re.sub(r"^[a-z]+:/*", "", shared_dir(spark)).strip("/")
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"/{home}/" in path:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def partitions_for(df: DataFrame, input_bytes: int = PARTITION_INPUT) -> int | None:
    """Range partitions by the bytes of the tables that ``df`` reads.

    None while the session's own setting gives small enough ones; adaptive execution merges those
    that are too small, but splits none.
    """
    need = parts_of(df, input_bytes)
    return need if need > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def parts_of(df: DataFrame, input_bytes: int = PARTITION_INPUT) -> int:
    """How many parts of so many bytes the tables have that ``df`` reads."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return -(-sum(s for s in sizes if s < UNKNOWN_SIZE) // input_bytes)


def by_rows(df: DataFrame, keys: list[str], home: Sequence[str] = ("row_id",)) -> DataFrame:
    """Token rows in as many hash partitions by ``keys`` as their input needs, once the session's setting is too low.

    Rows that lie by ``home`` already aren't moved.
    """
    parts = partitions_for(df, ROW_INPUT)
    return df.repartition(parts, *keys) if parts and not lies_by(df, list(home)) else df
