"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space, which is what
#: ``bytes.split()`` yields.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only in a local session without the setting (tests, a laptop) a temporary folder is used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-marketloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Bytes that a task gathers before it writes a row group.
ROW_GROUP = 32 << 20


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    This cuts the lineage: a lost executor costs a reread, not a recomputation.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of the batches that go to Python workers.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Batches to Python workers hold at most BATCH_BYTES (or a single row) from now on, not
    10,000 rows of whatever length; a smaller setting of the session's own stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) not in range(1, BATCH_BYTES + 1):
        spark.conf.set(key, str(BATCH_BYTES))


_held: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]) -> object:
    """A worker process's one large object between tasks: another key's is let go first, and so is
    what batches of earlier operators have left."""
    if key not in _held:
        _held.clear()
        _trim()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """Frees what earlier tasks of this process have left, for operators that keep nothing."""
    if _held:
        _held.clear()
        _trim()


def _trim() -> None:
    """Gives freed memory back to the system, where allocators can."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class BoundedCache(dict):
    """A dictionary of strings or bytes that takes nothing more at about ``size`` bytes, and no key of ``longest`` or more."""

    ENTRY = 160  # objects and table slots of one entry

    def __init__(self, size: int, longest: int = 64):
        super().__init__()
        self.left, self.longest = size, longest

    def offer(self, key, value, weight: int) -> None:
        """Keeps ``value``, which takes ``weight`` bytes besides an entry's own, if there is room."""
        if self.left > 0 and len(key) < self.longest and key not in self:
            self[key] = value
            self.left -= self.ENTRY + len(key) + weight


#: Most bits (as a power of two) of a filter: 2 ** 20 words, 16 MB, whatever the input.
FILTER_BITS = 26


def parted(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose bigint column ``key`` is surely not in that of ``keys``, and the others, which hold all
    that are and a few that are not; nothing is shuffled. Null keys are surely not in it.

    The filter that is broadcast has 16 bits for each of ``keys``, FILTER_BITS at most; a full filter
    calls all rows likely, which costs a shuffle of them and changes no result.
    """
    size = 1 << min(FILTER_BITS, max(10, (16 * keys.count()).bit_length()))
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(size))
    word, bit = f"_w_{uuid.uuid4().hex}", f"_b_{uuid.uuid4().hex}"
    bit_of = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place(k), F.lit(64)).cast("int"))
    known = keys.where(F.col(key).isNotNull())
    bits = known.select(F.floor(place(key) / 64).cast("int").alias(word), bit_of(key).alias(bit)).groupBy(word).agg(F.bit_or(bit).alias(bit))
    met = rows.join(F.broadcast(bits), F.when(F.col(key).isNotNull(), F.floor(place(key) / 64).cast("int")) == F.col(word), "left")
    held = F.coalesce(F.col(bit).bitwiseAND(bit_of(key)) != 0, F.lit(False))
    return met.where(~held).drop(word, bit), met.where(held).drop(word, bit)


def crc32_mod(col: Column, n: int) -> Column:
    return F.crc32(col.cast("string").cast("binary")) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sampled(df: DataFrame, n: int, total: int, seed: int, *keys: str) -> DataFrame:
    """The ``n`` of ``total`` rows with the smallest keyed hash of ``keys``.

    A cut on the hash leaves about four times as many for the ordering, so that what meets in
    one task is bounded however many tasks there are.
    """
    h = F.xxhash64(*keys, F.lit(seed))
    near = F.pmod(h, F.lit(1 << 30)) <= int(min(1.0, (4 * n + 100) / max(total, 1)) * (1 << 30))
    return df.where(near).orderBy(F.pmod(h, F.lit(1 << 30)), *keys).limit(n)


def one_text_an_id(docs: DataFrame, ids: DataFrame, longest: int) -> DataFrame:
    """``ids`` (doc_id and more; few rows, once each) with a text of that id: the smallest of those of at
    most ``longest`` bytes. Repeated ids are merged map-side, so that what is gathered stays bounded."""
    near = docs.select("doc_id", "text").where(F.octet_length("text") <= longest).join(F.broadcast(ids), "doc_id")
    return near.groupBy(*ids.columns).agg(F.min("text").alias("text"))


def unsigned_crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


Query = Callable[[SparkSession, str], DataFrame]
