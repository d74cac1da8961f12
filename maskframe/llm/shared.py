"""What the corpus operators share: the cluster's shared folder, Arrow batch maps and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder, as on one machine.
DEFAULT_SHARED = "/tmp/checkpoints"
#: Whole documents are long: ten thousand of them are held several times over on either side of the socket.
BATCH_ROWS, BATCH_BYTES = 2500, "12m"
#: Memory settings of workers: large buffers go back to the system when they are freed.
WORKER_ENV = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": str(2 << 20), "MALLOC_ARENA_MAX": "2"}
PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


_HELD: dict[str, object] = {}


def held(key: str, make: Callable[[], object]) -> object:
    """An object that a worker process keeps for its later tasks; it keeps one at a time."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Let go of what another operator has left in this worker process, and of the memory behind it."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def ensure_importable(spark: SparkSession) -> None:
    """Python workers of this session can import the package from where the driver has it, and get texts in batches
    of at most ``BATCH_ROWS`` rows and ``BATCH_BYTES``, unless the session asks for another number than Spark's own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    env = spark.sparkContext.environment
    for name, value in WORKER_ENV.items():
        env.setdefault(name, value)
    have = env.get("PYTHONPATH", "")
    if PACKAGE_ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (have, PACKAGE_ROOT) if x)
    if PACKAGE_ROOT not in sys.path:
        sys.path.append(PACKAGE_ROOT)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a default is set only where none is, and only on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = current.get() if current.isDefined() else DEFAULT_SHARED
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Folders that :func:`stored` has written and nothing has discarded yet.
_WRITTEN: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet to the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete folders that no frame reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is stored inside is deleted at the end: for work whose result is written before."""
    first = len(_WRITTEN)
    try:
        yield
    finally:
        discard(spark, *_WRITTEN[first:])
        del _WRITTEN[first:]


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names behind as many underscores as make them differ from all columns, whatever their case."""
    taken, mark = {c.lower() for c in columns}, "_"
    while any((mark + n).lower() in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ensure_importable(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            yield from f(b)

    return df.mapInArrow(run, schema)


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) with component the smallest reachable node, for every node of ``edges`` (a, b; long).

    Alternating large-star and small-star steps (Kiveris et al. 2014) on the edge table only; each round is
    two aggregations by node with map-side minima, so a node with very many neighbours is combined before it
    is shuffled. Rounds are written to the shared folder, which cuts the lineage.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = stored(e, "cc")
    before = None
    while True:
        # large-star: every neighbour above a node is linked to the smallest of the node and its neighbours
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small-star: a node and its smaller neighbours are linked to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("s")).select("s.a", "s.b").where("a <> b").distinct()
        e = stored(small, "cc")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    members = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
