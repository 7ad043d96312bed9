"""Shared pieces of the operators: staged tables, size-checked joins, Arrow buffers and fingerprints."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it was counted and has at most so many bytes.
BROADCAST_BYTES = 48 << 20

_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. In local mode, where it is unset, one below Spark's warehouse."""
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        set_dir = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    return set_dir.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: a cut of the lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/formlens-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _staged.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def clear_staged() -> None:
    """Deletes the staged tables of results that are no longer needed; also runs when Python ends."""
    while _staged:
        spark, path = _staged.pop()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended
            return


atexit.register(clear_staged)


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, which must be staged, with a broadcast hint if its counted rows of about row_bytes stay under BROADCAST_BYTES; beyond, Spark shuffles both sides and splits skewed keys."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def measured(rows: DataFrame) -> DataFrame:
    """small() for staged rows of strings and lists of strings: their bytes are added up."""
    text = [c for c, kind in rows.dtypes if kind == "string"]
    lists = [c for c, kind in rows.dtypes if kind == "array<string>"]
    size = sum((F.coalesce(F.octet_length(c).cast("long"), F.lit(0)) for c in text), F.lit(0).cast("long"))
    size = sum((F.octet_length(F.array_join(c, "/")).cast("long") + 16 * F.size(c) for c in lists), size)
    n, total = rows.agg(F.count("*"), F.sum(size)).first()
    return small(rows, 32 + 16 * len(rows.columns) + (total or 0) // max(1, n))


def sized(rows: DataFrame, items: str, item_bytes: int, row_bytes: int = 48) -> DataFrame:
    """small() for staged rows that hold a list: their items are counted too."""
    n, total = rows.agg(F.count("*"), F.sum(F.size(items).cast("long"))).first()
    return small(rows, row_bytes + item_bytes * (total or 0) // max(1, n))


def released(f: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """f, which maps the batches of a task, and after the task its memory goes back: workers wait for other tasks and would keep it."""

    @functools.wraps(f)
    def mapped(*args: object, **named: object) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(*args, **named)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass

    return mapped


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores, whichever df has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary or string column and the rows' offsets in them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about `most` bytes (a longer row alone): first row, end row, bytes, offsets."""
    data, offsets = flat(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


_BYTE = np.random.default_rng(20240607).integers(0, 2**64, 256, dtype=np.uint64)
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h *= _M2
    h ^= h >> np.uint64(27)
    h *= _M3
    h ^= h >> np.uint64(31)
    return h


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One fingerprint for each ordered pair of fingerprints."""
    h = a * _M1
    h += b
    h ^= h >> np.uint64(29)
    h *= _M2
    return h


def byte_marks(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def word_marks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words (runs without space, tab, LF, VT, FF, CR) of all rows, in order, and the rows' offsets in them."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    inner = ~blank
    starts = inner.copy()
    starts[1:] &= blank[:-1]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    starts[firsts] |= inner[firsts]
    at = np.flatnonzero(starts)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    # The sum of byte marks, each times a power that its place in the word sets: 64-bit, wraps around.
    word = np.cumsum(starts) - 1
    place = np.arange(len(data)) - at[np.maximum(word, 0)]
    marks = _BYTE[data] * _powers(int(place.max()) + 1 if len(place) else 1)[np.maximum(place, 0)]
    marks[blank] = 0
    sums = np.add.reduceat(marks, at)
    return mixed(sums), np.searchsorted(at, offsets)


def short_word_marks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As word_marks, faster for rows of few bytes in all: a word's sum is a difference of running sums, with the power of its start divided out."""
    if len(data) > SHORT:
        return word_marks(data, offsets)
    powers, inverse = _short_powers()
    inner = _WORD_BYTE[data] != 0
    starts, ends = inner.copy(), inner.copy()
    starts[1:] &= ~inner[:-1]
    ends[:-1] &= ~inner[1:]
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]  # words end where rows do
    starts[edges] |= inner[edges]
    ends[edges - 1] |= inner[edges - 1]
    at, last = np.flatnonzero(starts), np.flatnonzero(ends)
    terms = _WORD_BYTE[data] * powers[: len(data)]
    sums = np.cumsum(terms)
    return mixed((sums[last] - sums[at] + terms[at]) * inverse[at]), np.searchsorted(at, offsets)


def _powers_of(n: int, base: np.uint64 = _M1) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


#: The first powers of _M1 are kept; those for a longer word are made for it alone.
_POWERS = _powers_of(1024)


#: Bytes that short_word_marks takes together at most.
SHORT = 1 << 19
#: The marks of bytes, those of blanks zero.
_WORD_BYTE = _BYTE.copy()
_WORD_BYTE[[32, *range(9, 14)]] = 0


@functools.cache
def _short_powers() -> tuple[np.ndarray, np.ndarray]:
    """The powers of _M1 and of its inverse; only workers that need them hold them."""
    return _powers_of(SHORT), _powers_of(SHORT, np.uint64(pow(int(_M1), -1, 1 << 64)))


def _powers(n: int) -> np.ndarray:
    return _POWERS if n <= len(_POWERS) else _powers_of(n)


def whole_groups(batches: Iterator[pa.RecordBatch], column: int, rows: int) -> Iterator[pa.Table]:
    """Batches sorted by a column of longs as tables of about `rows` rows, or a longer group, that end between groups."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n <= rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        key = table.column(column).to_numpy()
        while len(key) > rows:
            end = int(np.searchsorted(key, key[rows], "left")) or int(np.searchsorted(key, key[0], "right"))
            if end == len(key):
                break
            yield table.slice(0, end)
            table, key = table.slice(end), key[end:]
        held, n = table.to_batches(), len(key)
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def numbered(rows: DataFrame, name: str, by: str, order: list[str], together: int = 20_000) -> DataFrame:
    """rows, which must be staged, with the long `name`: gapless numbers from 0 for each value of `by`.

    Rows are numbered in buckets of about `together` by hash of `order`, after the rows of the buckets before; so no
    value's rows have to meet, however many.
    """
    most = rows.groupBy(by).count().agg(F.max("count")).first()[0] or 0
    bucket, before, size = (fresh(rows, x) for x in ("_bucket", "_before", "_size"))
    rows = rows.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(max(1, -(-most // together)))))
    sizes = rows.groupBy(by, bucket).agg(F.count("*").alias(size))
    earlier = Window.partitionBy(by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(by, bucket, F.coalesce(F.sum(size).over(earlier), F.lit(0)).alias(before))
    within = Window.partitionBy(by, bucket).orderBy(*order)
    out = rows.withColumn(name, (F.row_number().over(within) - 1).cast("long")).join(small(stage(starts, "starts"), 32), [by, bucket])
    return out.withColumn(name, F.col(name) + F.col(before)).drop(bucket, before)
