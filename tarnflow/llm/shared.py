"""What several operators need: the shared work folder, narrowed inputs, joins on hot keys, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from functools import reduce
from typing import Any
from weakref import WeakKeyDictionary

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only for a local master without it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Rows of an Arrow batch that goes to a worker: they may hold long texts, of which JVM and worker each keep a copy.
BATCH_ROWS = 1_000


def text_batches(spark: SparkSession) -> None:
    """Have the session send rows of texts to workers in small batches, unless it sends even fewer at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


#: Folders of saved frames that discard() and clean() may delete.
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_WRITTEN: set[str] = set()


def save(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a frame once to the shared folder and read it back.

    The plan behind it is not run again, its non-deterministic columns stay as
    they were first drawn, and a lost executor costs a re-read of a file only.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/tarnflow-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    _WRITTEN.add(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _WRITTEN.discard(path)


def discard(*frames: DataFrame) -> None:
    """Delete the folders of saved frames that nothing reads any more, such as a loop's earlier rounds."""
    for df in frames:
        if path := _FOLDERS.pop(df, None):
            _delete(df.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Delete every folder that this process has saved; for when all results are written elsewhere."""
    for path in list(_WRITTEN):
        _delete(spark, path)


_KEPT: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task; one thing at a time."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    _KEPT.clear()


def give_back() -> None:
    """Hand freed memory back to the system. Workers live on between tasks, and allocators hold what a task has freed; Arrow's is left for the system's, which can be trimmed."""
    pa.default_memory_pool().release_unused()
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def tidy(run: Callable[[Iterator], Iterator], keeps: bool = False) -> Callable[[Iterator], Iterator]:
    """A map over batches that starts without what other operators kept in the worker (unless it keeps) and ends by giving memory back."""

    def task(batches: Iterator) -> Iterator:
        if not keeps:
            forget()
        give_back()
        yield from run(batches)
        give_back()

    return task


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Stretches of rows that hold about so many bytes of a text column, or one row with more."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    low = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(low, i - low)
            low, held = i, 0
        held += n
    if low < len(batch):
        yield batch.slice(low)


def narrowed(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under an operator's own names: narrowed(docs, doc_id="id"). Others can't clash."""
    return docs.select(*(docs[theirs].alias(ours) for ours, theirs in columns.items()))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unit(*columns: Column | str, seed: int = 0) -> Column:
    """A repeatable draw from [0, 1) for the values of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 11).cast("double") / F.lit(float(1 << 53))


#: A key is hot when it holds more than one of so many equal parts of all rows; so there are no more hot keys than that.
PARTS = 1_000


def heavy(counts: DataFrame, keys: list[str], total: int, n: str = "n") -> DataFrame:
    """Of counted keys the hot ones, at most PARTS, and the number of pieces that each is cut into."""
    each = max(1, -(-total // PARTS))
    return counts.where(F.col(n) > each).select(*keys, F.ceil(F.col(n) / each).cast("int").alias("pieces"))


def salted(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, salt: list[str], how: str = "inner") -> DataFrame:
    """left joined with right, where left's rows of a hot key go to pieces by a hash of their `salt` columns and right's rows to all of them.

    `hot` comes from heavy() and has PARTS rows at most, so it is broadcast. Rows of
    left without a key, which match nothing, are dealt evenly too.
    """
    few = F.broadcast(hot)
    none = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    deal = lambda n: F.pmod(F.xxhash64(*salt), n).cast("int")
    one = left.join(few, keys, "left").withColumn("piece", F.when(none, deal(F.lit(PARTS))).otherwise(deal(F.coalesce("pieces", F.lit(1))))).drop("pieces")
    all_ = right.join(few, keys, "left").withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1))).drop("pieces")
    return one.join(all_, [*keys, "piece"], how).drop("piece")


#: Bits of a hash that a sketch of keys goes by; it is a table of at most 2 ** (SKETCH - 6) rows.
SKETCH = 24


def marked(rows: DataFrame, keys: list[str], members: DataFrame, mark: str = "may") -> DataFrame:
    """The rows and whether their key may be one of some members' (never false for one that is).

    Nearly only members are marked while they are far fewer than 2 ** SKETCH. The sketch has a bounded
    number of rows at any size, so it is broadcast, and the rows aren't shuffled.
    """
    h = F.shiftrightunsigned(F.xxhash64(*keys, F.lit(5)), 64 - SKETCH)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    words = members.select(F.shiftright(h, 6).alias("sketch_word"), bit.alias("bit")).groupBy("sketch_word").agg(F.bit_or("bit").alias("sketch_bits"))
    out = rows.withColumn("sketch_word", F.shiftright(h, 6)).join(F.broadcast(words), "sketch_word", "left")
    return out.withColumn(mark, F.coalesce(F.col("sketch_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("sketch_word", "sketch_bits")


def without(rows: DataFrame, keys: list[str], gone: DataFrame) -> DataFrame:
    """The rows whose key isn't among some others. Only those that a sketch can't clear are shuffled for the exact join."""
    some = marked(rows, keys, gone, "sketch_may")
    return some.where("not sketch_may").drop("sketch_may").unionByName(some.where("sketch_may").drop("sketch_may").join(gone.select(*keys), keys, "left_anti"))


def labelled(rows: DataFrame, label: str, id_: str, least: str) -> DataFrame:
    """Saved rows with the smallest id of their label; null where the label is null."""
    own = save(rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.min(id_).alias(least), F.count("*").alias("n")), "labels")
    return salted(rows, own.drop("n"), [label], heavy(own, [label], rows.count()), [id_], "left")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (src, dst long): rows (node, root), root one node of each component.

    Every round each node joins the neighbour (or itself) of the smallest hash,
    and the edges are contracted to those; the number of nodes shrinks by a
    constant factor each round, whatever the shape. Rounds are written to the
    shared folder, and the one before is deleted. Nodes of many edges and roots of many nodes are
    dealt to several tasks. Nothing but counts reaches the driver.
    """
    pairs = lambda e: e.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    left = save(pairs(edges), "edges")
    node = save(left.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("root", F.col("node")), "nodes")
    key = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    nodes = node.count()
    while count := left.count():
        both = left.union(left.select("dst", "src"))
        to = both.groupBy("src").agg(F.min(key("dst")).alias("best"), F.count("*").alias("n"))
        to = save(to.select(F.col("src").alias("was"), F.least(key("src"), "best")["v"].alias("now"), "n"), "hook")
        hot, moved = heavy(to, ["was"], count), left
        for c, other in (("src", "dst"), ("dst", "src")):
            moved = salted(moved.withColumnRenamed(c, "was"), to.select("was", "now"), ["was"], hot, [other]).drop("was").withColumnRenamed("now", c)
        moved = save(pairs(moved), "edges")
        roots = heavy(node.groupBy("root").agg(F.count("*").alias("n")), ["root"], nodes)
        next_ = save(salted(node, to.select(F.col("was").alias("root"), "now"), ["root"], roots, ["node"], "left").select("node", F.coalesce("now", "root").alias("root")), "nodes")
        discard(left, node, to)
        left, node = moved, next_
    discard(left)
    return node
