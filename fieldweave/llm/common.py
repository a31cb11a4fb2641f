"""Shared pieces of the corpus operators: staging, words, hashes, blocks of documents.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D, which is what
``bytes.split()`` returns on UTF-8 text.
"""

from __future__ import annotations

import atexit
import ctypes
import math
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

WORD = "[^\\x20\\x09-\\x0D]+"
GAP = "[\\x20\\x09-\\x0D]+"
#: Distinct words whose hashes a Python worker remembers before it starts anew.
REMEMBERED = 200_000
#: Bytes of a batch that are worked on at once.
SLICE = 2**22
#: A key is heavy if it has more than this part of all rows, and more than so many.
HEAVY_KEYS, LIGHT = 4096, 256


# --- staging -----------------------------------------------------------------
def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder.

    Only a session without one (a local test) gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="fieldweave-")
        atexit.register(shutil.rmtree, base, True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/fieldweave/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back; this cuts its lineage."""
    spark = df.sparkSession
    path = new_path(spark, label)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.staged_at = path
    if (scope := _SCOPE.get()) is not None:
        scope.append(path)
    return out


#: What the operator at work in this thread has staged; threads of one driver have scopes of their own.
_SCOPE: ContextVar[list[str] | None] = ContextVar("staged", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes what is staged inside once it is left, but for the tables put into the list that it gives.

    To be left when everything that reads the others has run. What stays passes to the scope around it.
    """
    kept: list[DataFrame] = []
    outer, mine = _SCOPE.get(), []
    token = _SCOPE.set(mine)
    try:
        yield kept
    finally:
        _SCOPE.reset(token)
        stay, place = {df.staged_at for df in kept}, spark._jvm.org.apache.hadoop.fs.Path
        for path in mine:
            if path not in stay:
                place(path).getFileSystem(spark._jsc.hadoopConfiguration()).delete(place(path), True)
            elif outer is not None:
                outer.append(path)


# --- joins on keys that many rows may share -------------------------------------
def lookup(rows: DataFrame, facts: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``facts`` other than ``n``; ``how`` is inner or left.

    Both are written tables. ``facts`` holds each key once and in ``n`` how many rows
    have it. Keys of more than a ``HEAVY_KEYS``-th of all rows are heavy: there are
    fewer than ``HEAVY_KEYS`` of them, so their facts are broadcast and their rows
    stay where they are. The others meet by a shuffled join, none of whose keys
    brings more than that share. Null keys find nothing and are not dealt to one task.
    """
    found, told = rows.where(F.col(key).isNotNull()), facts.drop("n")
    most = max(LIGHT, rows.count() // HEAVY_KEYS)
    if facts.where(F.col("n") > most).isEmpty():
        out = found.join(told, key, how)
    else:
        heavy = F.broadcast(facts.where(F.col("n") > most).drop("n"))  # fewer than HEAVY_KEYS rows
        light = found.join(heavy.select(key), key, "left_anti").join(told, key, how)
        out = light.unionByName(found.join(heavy, key))
    if how == "left":
        out = out.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)
    return out


# --- words and hashes -----------------------------------------------------------
class WordHashes(dict):
    """64-bit content hash of a word, remembered for the words of this worker."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


_MUL_A = np.uint64(0x9E3779B97F4A7C15)
_MUL_B = np.uint64(0xC2B2AE3D27D4EB4F)
_MUL_C = np.uint64(0x165667B19E3779F9)
_S29, _S32 = np.uint64(29), np.uint64(32)


def combine(left, right) -> np.ndarray:
    """Order-sensitive 64-bit mix of two hash arrays (arithmetic wraps)."""
    with np.errstate(over="ignore"):
        x = left * _MUL_A + right * _MUL_B + _MUL_C
        x ^= x >> _S32
        x *= _MUL_C
        x ^= x >> _S29
        return x * _MUL_A


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive entries, by doubling."""
    if len(h) < width:
        return np.empty(0, np.uint64)
    n, power, done, out, table = len(h) - width + 1, 1, 0, None, h
    while True:
        if width & power:
            part = table[done : done + n]
            out = part.copy() if out is None else combine(out, part)
            done += power
        power *= 2
        if power > width:
            return out
        table = combine(table[: len(table) - power // 2], table[power // 2 :])


# --- memory of workers --------------------------------------------------------------
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give back to the system what the last block or batch took: Python workers live on between tasks, and share an executor."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


# --- rows through Arrow -------------------------------------------------------
def texts_of(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def per_row(docs: DataFrame, columns: list[str], schema: str | StructType, make) -> DataFrame:
    """Map batches through ``make()(RecordBatch) -> dict of columns``; no shuffle.

    ``make`` is called once for each task, so that it can set up its tables.
    """

    arrow = to_arrow_schema(schema if isinstance(schema, StructType) else StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            step = max(1, batch.num_rows * SLICE // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                yield pa.RecordBatch.from_pydict(work(batch.slice(at, step)), schema=arrow)
            release()

    return docs.select(*columns).mapInArrow(run, schema)


# --- blocks of documents ----------------------------------------------------------
_ZSTD = pa.Codec("zstd", compression_level=1)


def planes(values: np.ndarray) -> bytes:
    """An array packed: its bytes by significance, so that alike ones stand together, compressed; the length goes before."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True) if raw else b""


def unplanes(packed, kind) -> np.ndarray:
    view = memoryview(packed)
    if not len(view):
        return np.empty(0, kind)
    raw = _ZSTD.decompress(view[8:], decompressed_size=int.from_bytes(view[:8], "little"))
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


class Blocks:
    """Documents dealt by hash to blocks of about ``block_bytes`` of text, in one shuffle.

    Every pass over the blocks starts from the same exchange, so Spark moves
    the text once. A block asks questions about its distinct keys (n-grams,
    windows, symbols); the keys travel to ``buckets`` ranges of the hash space,
    each of bounded size, and the answers travel back in the same order. Distinct
    keys within a block are sent once, whatever their frequency, so a frequent key
    weighs no more than the number of blocks. A row packs the sorted keys that a
    block sends to a bucket as differences; there are never more rows than keys.

    Rows are dealt by id, text and input partition: equal rows of one partition
    stay together, those of others do not, however many there are.
    """

    def __init__(self, docs: DataFrame, text: str, *, block_bytes: int, bucket_bytes: int, least_buckets: int = 1) -> None:
        total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        self.count = max(1, math.ceil(total / block_bytes))
        self.buckets = max(1, least_buckets, math.ceil(total / bucket_bytes))
        at_least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        keys = [c for c, kind in docs.dtypes if kind in ("bigint", "int", "string")]
        dealt = docs.withColumn("_block", F.pmod(F.xxhash64(*keys, F.spark_partition_id()), F.lit(self.count)))
        self.rows = dealt.repartition(min(self.count, max(at_least, self.count // 4)), "_block")

    def ask(self, emit, answers: DataFrame | None = None) -> DataFrame:
        """``emit(table[, answers]) -> [(keys, extra)]`` for each block; rows for ``answer``.

        ``keys`` is a sorted array of distinct hashes, ``extra`` an array of the same
        length or None.
        """
        buckets = self.buckets
        schema = "_bucket long, _block long, kind int, keys binary, extra binary"

        def rows(block: int, questions) -> pa.Table:
            out = {c: [] for c in ("_bucket", "_block", "kind", "keys", "extra")}
            for kind, (keys, extra) in enumerate(questions):
                if not len(keys):
                    continue
                of = bucket_of(keys, buckets)
                for lo, hi in runs(of):
                    out["_bucket"].append(int(of[lo]))
                    out["_block"].append(block)
                    out["kind"].append(kind)
                    out["keys"].append(planes(np.diff(keys[lo:hi], prepend=np.uint64(0))))
                    out["extra"].append(None if extra is None else planes(extra[lo:hi]))
            release()
            return pa.table(out, schema=_ASKED)

        if answers is None:

            def one(table: pa.Table) -> pa.Table:
                return rows(table.column("_block")[0].as_py(), emit(table))

            return self.rows.groupBy("_block").applyInArrow(one, schema)

        def two(table: pa.Table, told: pa.Table) -> pa.Table:
            if not table.num_rows:
                return rows(0, [])
            return rows(table.column("_block")[0].as_py(), emit(table, told))

        return self.rows.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(two, schema)

    @staticmethod
    def answer(asked: DataFrame, settle, extra_kind=None) -> DataFrame:
        """``settle(kind, key arrays, extra arrays of ``extra_kind``) -> answer arrays``, one for each asking block."""

        def run(table: pa.Table) -> pa.Table:
            bucket = table.column("_bucket")[0].as_py()
            block, kind, keys, extra = received(table, extra_kind)
            out: list = [None] * len(keys)
            for k in set(kind):
                mine = [i for i, x in enumerate(kind) if x == k]
                for i, reply in zip(mine, settle(k, [keys[i] for i in mine], [extra[i] for i in mine]), strict=True):
                    out[i] = planes(reply)
            release()
            return pa.table({"_block": block, "_bucket": [bucket] * len(out), "kind": kind, "reply": out}, schema=_TOLD)

        return asked.groupBy("_bucket").applyInArrow(run, "_block long, _bucket long, kind int, reply binary")

    @staticmethod
    def look_up(asked: DataFrame, facts: DataFrame, settle, extra_kind=None) -> DataFrame:
        """As ``answer``, but ``settle`` also gets the rows of ``facts`` (gram, ...) that lie in the bucket; both come by ``_bucket``."""
        shared = facts.withColumnRenamed("_bucket", "_of")

        def run(table: pa.Table, known: pa.Table) -> pa.Table:
            if not table.num_rows:
                return _TOLD.empty_table()
            bucket = table.column("_bucket")[0].as_py()
            block, kind, keys, extra = received(table, extra_kind)
            out = [planes(settle(k, key, more, known)) for k, key, more in zip(kind, keys, extra, strict=True)]
            return pa.table({"_block": block, "_bucket": [bucket] * len(out), "kind": kind, "reply": out}, schema=_TOLD)

        return asked.groupBy("_bucket").cogroup(shared.groupBy("_of")).applyInArrow(run, "_block long, _bucket long, kind int, reply binary")

    def in_buckets(self, facts: DataFrame, gram: str = "gram") -> DataFrame:
        """``facts`` with the ``_bucket`` that each key belongs to."""
        high = F.shiftrightunsigned(F.col(gram), 32)
        return facts.withColumn("_bucket", F.shiftrightunsigned(high * F.lit(self.buckets).cast("long"), 32))

    def finish(self, answers: DataFrame, fn, schema) -> DataFrame:
        """``fn(table, answers) -> table`` for each block."""

        def run(table: pa.Table, told: pa.Table) -> pa.Table:
            out = fn(table, told)
            release()
            return out

        return self.rows.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(run, schema)


_ASKED = pa.schema([("_bucket", pa.int64()), ("_block", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("extra", pa.binary())])
_TOLD = pa.schema([("_block", pa.int64()), ("_bucket", pa.int64()), ("kind", pa.int32()), ("reply", pa.binary())])


def received(table: pa.Table, extra_kind) -> tuple[list, list, list, list]:
    """(blocks, kinds, key arrays, extra arrays) of the rows that a bucket was sent."""
    keys = [np.cumsum(unplanes(x.as_buffer(), np.uint64)) for x in table.column("keys")]
    extra = [unplanes(x.as_buffer(), extra_kind) if x.is_valid else None for x in table.column("extra")]
    return table.column("_block").to_pylist(), table.column("kind").to_pylist(), keys, extra


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The range of the hash space that a key belongs to; it does not fall along sorted keys."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> _S32


def runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the stretches of equal values."""
    if not len(values):
        return []
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    return list(zip(np.r_[0, cut].tolist(), np.r_[cut, len(values)].tolist(), strict=True))


def replies(told: pa.Table, kind: int, answer) -> np.ndarray:
    """The answers of one kind as an array, in the order of the sorted keys that were asked."""
    bucket, kinds = told.column("_bucket").to_pylist(), told.column("kind").to_pylist()
    mine = sorted((b, i) for i, (b, k) in enumerate(zip(bucket, kinds, strict=True)) if k == kind)
    reply = told.column("reply")
    parts = [unplanes(reply[i].as_buffer(), answer) for _, i in mine]
    return np.concatenate(parts) if parts else np.empty(0, answer)


def hashed(table: pa.Table, text: str, memory: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts of a block, one after the other, and where each text starts."""
    parts, starts = [], [0]
    column = table.column(text)
    for at in range(0, table.num_rows, 512):
        for raw in texts_of(column.slice(at, 512)):
            parts.append(memory.of(raw.split()))
            starts.append(starts[-1] + len(parts[-1]))
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.array(starts, np.int64)
