"""What the operators of this subpackage share: a folder all executors see, tables written to it,
and numpy kernels that work on the UTF-8 bytes of a whole Arrow batch at once."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..storage import Scratch, delete, materialize, new_folder, shared_dir

__all__ = ["ALNUM", "NOT_SPACE", "SPACES", "Scratch", "as_bytes", "delete", "joined", "long_windows", "materialize", "mix", "new_folder", "one_of_repeated", "shared_dir", "table", "text_chunks", "tidied", "trimmed", "window_hash", "windows", "without", "word_hashes", "words", "workers"]

CHUNK_BYTES = 1 << 20
BROADCAST_IDS = 1_000_000  # ids of rows to be removed are broadcast up to so many
MOST_BITS = 1 << 28  # of the bitmap that parts the rows beyond
ARROW_ROWS = 1000
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 12, 13, 32]] = True
NOT_SPACE = ~SPACES
ALNUM = np.zeros(256, bool)
ALNUM[128:] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    ALNUM[_a:_b] = True


def workers(docs: DataFrame) -> SparkSession:
    """The session of docs, with this package on its executors. Texts are long: where Arrow batches have
    Spark's default of 10,000 rows, they get ARROW_ROWS."""
    spark = docs.sparkSession
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return ship(spark)


def tidied(run):
    """run, a function over batches, whose worker gives memory back before and after: Python workers are
    kept for later stages, and so is what their allocators hold."""

    def inner(batches):
        _give_back()
        try:
            yield from run(batches)
        finally:
            _give_back()

    return inner


def trimmed(run):
    """As tidied, for a function over the table of one group."""

    def inner(table):
        out = run(table)
        _give_back()
        return out

    return inner


def _give_back():
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(docs: DataFrame, gone: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """The rows of docs whose doc_id is not in gone (distinct doc_ids); null doc_ids stay. Up to `most` ids are
    broadcast. Beyond, a bitmap of bounded size lets pass the rows that can't be in gone, and only the others are
    shuffled to be joined."""
    gone = gone.select(F.col("doc_id").alias("__gone")).where("__gone is not null")
    many = gone.count()
    match = docs["doc_id"] == gone["__gone"]
    if many <= most:
        return docs.join(F.broadcast(gone), match, "left_anti") if many else docs
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(16, int(16 * many).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(bits))
    cells = gone.select(place("__gone").alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(b & 63))")).alias("v")).toArrow()
    field = np.zeros(bits // 64, np.int64)
    field[cells["w"].to_numpy()] = cells["v"].to_numpy()
    held = workers(docs).sparkContext.broadcast(field.view(np.uint8))

    def passing(want):
        def run(batches):
            for batch in batches:
                at = batch.column(batch.num_columns - 1)
                b = at.fill_null(0).to_numpy(zero_copy_only=False)
                hit = ((held.value[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool) & ~np.asarray(at.is_null())
                yield batch.select(range(batch.num_columns - 1)).filter(pa.array(hit == want))

        return run

    marked = docs.withColumn("__place", F.when(F.col("doc_id").isNotNull(), place("doc_id")))
    free, maybe = (marked.mapInArrow(tidied(passing(want)), docs.schema) for want in (False, True))
    return free.union(maybe.join(gone, maybe["doc_id"] == gone["__gone"], "left_anti"))


def one_of_repeated(docs: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """docs with one of the rows that are equal in doc_id and text (null or not). Texts are only shuffled for rows
    whose doc_id and hash of the text are repeated."""
    mark = F.xxhash64("text")
    twice = docs.groupBy(F.col("doc_id").alias("__d"), mark.alias("__h")).count().where("count > 1").select("__d", "__h")
    many = twice.count()
    if not many:
        return docs
    if many <= most:
        twice = F.broadcast(twice)
    hit = docs["doc_id"].eqNullSafe(twice["__d"]) & (mark == twice["__h"])
    return docs.join(twice, hit, "left_anti").union(docs.join(twice, hit, "left_semi").dropDuplicates(["doc_id", "text"]))


def text_chunks(column: pa.Array, target: int = CHUNK_BYTES):
    """Yield (first row, last row + 1, bytes, offsets) over runs of whole rows of about `target` bytes.
    Null rows have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    rows = len(column)
    if not rows:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + rows + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + target, "right")) - 1)
        hi = min(hi, rows)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """Starts, ends and row of every maximal run of word bytes; runs never cross rows."""
    inside = is_word[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    filled = offsets[1:] > offsets[:-1]
    before[offsets[:-1][filled]] = False
    after[offsets[1:][filled] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return start, end, row


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        run = np.full(max(n, CHUNK_BYTES + (1 << 18)), base, np.uint64)
        run[0] = 1
        if n > 2 * CHUNK_BYTES:
            return np.cumprod(run[:n])
        have = _powers[name] = np.cumprod(run)
    return have[:n]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, through prefix sums of a polynomial modulo 2**64."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _R, n), out=total[1:])
    return mix((total[end] - total[start]) * _power("down", _R_INV, n)[start] + (end - start).astype(np.uint64))


def windows(h: np.ndarray, row: np.ndarray, n: int):
    """Hash of every run of n consecutive words of one row, and the index of its first word."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = np.zeros(m, np.uint64)
    for k in range(n):
        acc = acc * _M3 + h[k : k + m]
    first = np.flatnonzero(row[:m] == row[n - 1 :])
    return mix(acc[first]), first


def window_hash(h: np.ndarray) -> np.uint64:
    """The hash that windows() gives a run of exactly these words."""
    acc = np.zeros(1, np.uint64)
    for x in h:
        acc = acc * _M3 + x
    return mix(acc)[0]


def long_windows(h: np.ndarray, row: np.ndarray, n: int):
    """As windows(), by prefix sums: the cost doesn't grow with n."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _power("up", _R, len(h)), out=total[1:])
    first = np.flatnonzero(row[:m] == row[n - 1 :])
    return mix((total[first + n] - total[first]) * _power("down", _R_INV, len(h))[first]), first


def as_bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def joined(column, dtype) -> np.ndarray:
    """One array out of a column of binary cells."""
    return np.frombuffer(b"".join(column), dtype)
