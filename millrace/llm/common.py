"""Shared pieces: intermediate tables, and array code over the bytes of a batch of texts.

Text operators get Arrow batches, cut them to a few megabytes of text (``text_chunks``), and work on all texts of a cut at once with
NumPy: no loop over characters or words, and memory bounded by the cut (or by one text, where a single text is longer).
"""

import ctypes
import functools
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes handled at once. Each byte takes up to about 110 bytes of working arrays, powers included.
CHUNK_BYTES = 1 << 19
#: The same for operators that sum up within a cut.
SUMMED_BYTES = 1 << 20
#: Rows of an Arrow batch: few, since a row may be a long text.
BATCH_ROWS = 1000

_MASK = (1 << 64) - 1
_U = np.uint64


def workspace(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table in the shared folder of spark.checkpoint.dir; in local mode a temporary folder where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/millrace/{name}-{uuid.uuid4().hex}"
    if _RECORDING:
        _OF_STAGES.append(path)
    return path


#: Intermediate tables of pipeline stages that are not dropped yet, and whether a stage is at work.
_OF_STAGES: list[str] = []
_RECORDING: list[bool] = []


def staged(stage):
    """A pipeline stage (spark, docs, sf_dir) that first drops the intermediate tables of the stages before it: their results are stored by then."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _OF_STAGES:
            path = spark._jvm.org.apache.hadoop.fs.Path(_OF_STAGES.pop())
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _RECORDING.append(True)
        try:
            return stage(spark, docs, sf_dir)
        finally:
            _RECORDING.pop()

    return functools.wraps(stage)(run)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, its lineage cut, safe when executors are lost."""
    path = workspace(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose texts will go to workers in batches of BATCH_ROWS rows (a setting of its session)."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


#: Of the C library, where it has it: free memory within its heap goes back to the system.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Free memory that Arrow and the C library hold for later goes back to the system, and so do the rollers' powers."""
    for roller in _ROLLERS:
        roller.forget()
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def tidy(run):
    """A function of batches that gives its memory back at its end: Spark keeps workers for later tasks, of other stages too, and what
    one of them holds free is no other's."""

    @functools.wraps(run)
    def tidied(batches):
        yield from run(batches)
        give_back()

    return tidied


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a cut has about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < n:
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right"))
            to = max(to, at + 1)
            yield batch.slice(at, to - at)
            at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) as one array, and the offsets of its rows (one more than rows)."""
    column = pc.fill_null(column, "")
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring offsets."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all others."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def mix_int(x: int) -> int:
    """``mix`` of one Python number."""
    return int(mix(np.array([x & _MASK], np.uint64))[0])


#: All rollers of this process: modules keep theirs, and so would every idle worker keep their powers (16 bytes for each byte of a cut).
_ROLLERS: weakref.WeakSet = weakref.WeakSet()


class Roller:
    """64-bit hashes of any byte ranges of an array, by prefix sums of a polynomial over random byte values (modulo 2^64).

    ``seed`` picks the byte values and the base; rollers with different seeds are independent. ``fold`` treats A-Z as a-z.
    """

    def __init__(self, seed: int, fold: bool = False):
        values = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
        if fold:
            values[65:91] = values[97:123]
        self.values = values
        self.base = (mix_int(seed + 77) & ~7 & _MASK) | 3
        self.forget()
        _ROLLERS.add(self)

    def forget(self) -> None:
        """Lets the powers go; they are found again when asked for."""
        self.pow = np.ones(1, np.uint64)
        self.inv = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.pow) < n:
            n = max(n, 1 << 16)
            self.pow = np.cumprod(np.concatenate([[_U(1)], np.full(n - 1, self.base, np.uint64)]), dtype=np.uint64)
            self.inv = np.cumprod(np.concatenate([[_U(1)], np.full(n - 1, pow(self.base, -1, 1 << 64), np.uint64)]), dtype=np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._reach(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.pow[: len(data)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end], length included."""
        return mix((prefix[end] - prefix[start]) * self.inv[start] + (end - start).astype(np.uint64) * _U(0x9E3779B97F4A7C15))

    def windows(self, prefix: np.ndarray, length: int) -> np.ndarray:
        """Hashes of all ranges of ``length`` bytes, by start."""
        n = max(0, len(prefix) - length)
        return mix((prefix[length:] - prefix[:n]) * self.inv[:n])


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


class Words:
    """The words ([^\\x20\\x09-\\x0D]+, or runs of bytes that are not ``outside``) of all texts of a cut: start, end (bytes), doc (row), and
    where each doc's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = _SPACE):
        inside = ~outside[data]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside
        before[offsets] = False
        after = np.zeros(len(data) + 1, bool)
        after[:-1] = inside
        after[offsets] = False
        self.inside = inside
        self.start = np.flatnonzero(inside & ~before[:-1])
        self.end = np.flatnonzero(inside & ~after[1:]) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)


_STEPS = np.random.default_rng(5).integers(1, 2**63, 64, dtype=np.uint64) | _U(1)
_PAD = _U(0xA5A5F00D1234ABCD)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word windows of each doc, and their offsets; a doc with fewer words gets its whole sequence as one."""
    counts = np.diff(first)
    each = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    offsets = np.concatenate([[0], np.cumsum(each)])
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], each) + np.repeat(first[:-1], each)
    last = np.repeat(first[1:], each)
    out = np.zeros(len(at), np.uint64)
    for j in range(size):
        there = at + j < last
        out += np.where(there, hashes[np.minimum(at + j, len(hashes) - 1)] if len(hashes) else _PAD, _PAD) * _STEPS[j]
    return mix(out), offsets


def binaries(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.large_binary()).cast(pa.binary())
