"""Shared pieces of the corpus operators: table access, scratch space, packing, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.sources.scratch import scratch_root

#: A table is broadcast only below this many rows (a few MB of narrow rows).
BROADCAST_ROWS = 50_000
#: Edges up to which components are finished in one task (some ten MB there).
ONE_TASK_EDGES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended: the folder is then the cluster's to clean
        pass


class Scratch:
    """Written tables that cut lineage: an executor that is lost costs nothing that was written.

    Tables live below spark.checkpoint.dir until drop() or the end of the interpreter.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.n = spark, f"{scratch_root(spark)}/basalt-{uuid.uuid4().hex}", 0
        atexit.register(_delete, spark, self.base)

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/t{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        """Delete written tables, and let the cleaner remove shuffle files of finished jobs."""
        for df in dfs:
            if path := getattr(df, "_scratch_path", None):
                _delete(self.spark, path)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def narrow_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Send at most `rows` rows at a time to Python: the JVM's buffers for wide rows lie outside its heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def release() -> None:
    """Give memory that finished batches held back to the system: workers are kept for later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what is made of a batch stays small."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
        release()


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """Rows of each run of equal leading key columns, as column lists; the input is sorted by the keys."""
    last, held = None, None
    for whole in batches:
        for k in range(0, whole.num_rows, 256):  # wide rows: few at a time as Python objects
            for row in zip(*(c.to_pylist() for c in whole.slice(k, 256).columns)):
                if row[:keys] != last:
                    if held:
                        yield held
                    last, held = row[:keys], [[] for _ in row]
                for c, v in zip(held, row):
                    c.append(v)
    if held:
        yield held
    held = None
    release()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (root, vertex) that connect what the task's edges connect; a root is the smallest id of its tree."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = z = up[y]
            x = z
        return x

    def drain() -> pa.RecordBatch:
        pairs = [(find(x), x) for x in list(up)]
        a, b = [p for p, q in pairs if p != q], [q for p, q in pairs if p != q]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        if len(up) > 2 * ONE_TASK_EDGES:  # bounded memory: hand on what is known and start anew
            yield drain()
            up.clear()
    yield drain()
    up.clear()
    release()


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Connected components of edges (a long, b long): rows (id, comp), comp the smallest id reached.

    Alternating large-star and small-star steps (Kiveris et al. 2014): every step is one grouped
    minimum with map-side combine and one join, so that a vertex of huge degree is never gathered;
    the number of steps grows with the logarithm of the longest path.  Each task first reduces its own
    edges to a spanning forest; what is left, then or after a step, is finished in one task where it
    has at most ONE_TASK_EDGES edges, with the same result.
    """
    scratch = scratch or Scratch(spark)
    e = scratch.put(edges.where("a <> b").select("a", "b").mapInArrow(_forest, "a bigint, b bigint"))
    n, before = e.count(), None
    if n > ONE_TASK_EDGES:
        e = scratch.put(e.distinct())
        n = e.count()
    while n > ONE_TASK_EDGES:
        # large star: each vertex hands its larger neighbours to its smallest neighbour
        both = e.unionByName(e.selectExpr("b AS a", "a AS b"))
        m = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(m, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        large = scratch.put(large)
        # small star: each vertex hands its smaller neighbours and itself to the smallest one
        m = large.groupBy("b").agg(F.min("a").alias("m"))
        nxt = large.join(m, "b")
        small_ = nxt.selectExpr("m AS a", "a AS b").unionByName(nxt.selectExpr("m AS a", "b")).where("a <> b").distinct()
        small_ = scratch.put(small_)
        scratch.drop(e, large)
        e = small_
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == now:
            break
        n, before = now[0], now
    else:
        e = scratch.put(e.repartition(1).mapInArrow(_forest, "a bigint, b bigint"))
        return e.selectExpr("b AS id", "a AS comp").unionByName(e.selectExpr("a AS id", "a AS comp").distinct())
    roots = e.groupBy("b").agg(F.min("a").alias("comp")).withColumnRenamed("b", "id")
    out = roots.unionByName(e.select(F.col("a").alias("id"), F.col("a").alias("comp")).distinct())
    return out.groupBy("id").agg(F.min("comp").alias("comp"))
