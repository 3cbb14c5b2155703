"""Removal of byte strings that occur twice, by a distributed difference-cover method.

Wanted: every start whose next ``length`` bytes also stand somewhere else. A sort of all suffixes would move many times the corpus;
their first ``length`` bytes are all that matters, and a difference cover finds equal ones from a sample:

1. Cover. Starts whose place modulo ``PERIOD`` is in ``COVER`` are sampled. Any two starts i, j have a shift k < PERIOD at which both
   i + k and j + k are sampled, so two equal strings of ``length`` bytes contain equal sampled tuples of ``length - PERIOD + 1`` bytes.
2. Sort of the sampled tuples. Tuples are named by fingerprints, dealt to buckets and sorted there; neighbours with one name repeat.
   A tuple whose name is unique settles all pairs that meet at it, and recursion goes on only where names repeat.
3. Merge of the remaining suffixes. Every start that has a repeated tuple within reach, sampled or not, gets the name of its first
   ``length`` bytes; these are sorted in buckets in turn and adjacent names compared. Equal neighbours are repeated starts.
4. The bytes under repeated starts are removed.

Texts travel once (packs of some megabytes, shuffled by text hash, each distinct text once a task); names travel in columns of 4 and 8
bytes, once per pack and name, so a passage that many texts share is one entry a pack; answers come back as bit masks in the order of
the names. Nothing is gathered on the driver.

Null and empty texts, and texts shorter than ``length``, lose nothing. Copies of a text of ``length`` bytes or more lose everything.
Repeated rows are copies of each other, null doc_ids included. An empty table gives no rows; extra columns are ignored.
Names of whole strings have 64 bits besides their bucket.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Roller, mix, stored, tidy

LENGTH = 200
#: A perfect difference set: every residue but 0 is a difference of two of these just once.
PERIOD = 91
COVER = (0, 1, 3, 9, 27, 49, 56, 61, 77, 81)
PACK_BYTES = 16 << 20
BUCKET_NAMES = 8 << 20
LEAST_PARTS = 64
_SEGMENT = 1 << 20
_U = np.uint64

_TUPLES, _WHOLE, _CHECK = Roller(61), Roller(62), Roller(63)
_SAMPLED = np.zeros(PERIOD, bool)
_SAMPLED[list(COVER)] = True


def names_at(roller: Roller, data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of data[s:s + length] for sorted starts, by segments of bounded size."""
    out = np.empty(len(starts), np.uint64)
    for low in range(0, len(data), _SEGMENT):
        a, b = np.searchsorted(starts, (low, low + _SEGMENT))
        if a < b:
            prefix = roller.prefix(data[low : low + _SEGMENT + length])
            at = starts[a:b] - low
            out[a:b] = mix((prefix[at + length] - prefix[at]) * roller.inv[at])
    return out


class Pack:
    """The distinct texts of a pack, in order of their hash, as one array of bytes."""

    def __init__(self, table: pa.Table, length: int):
        rows = dict(zip(table.column("h").to_pylist(), table.column("text").to_pylist(), strict=True))
        self.hashes = sorted(rows)
        self.data = np.frombuffer(b"".join(rows[h] for h in self.hashes), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(rows[h]) for h in self.hashes])]).astype(np.int64)
        self.length = length
        self.ends = np.repeat(self.offsets[1:], np.diff(self.offsets))  # of each byte, where its text ends

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """Sampled starts, and the names of their tuples."""
        size = self.length - PERIOD + 1
        at = np.arange(len(self.data))
        starts = at[np.resize(_SAMPLED, len(at)) & (at + size <= self.ends)]
        return starts, names_at(_TUPLES, self.data, starts, size)

    def candidates(self, starts: np.ndarray) -> np.ndarray:
        """Starts of whole strings that hold one of the sampled tuples."""
        edge = np.zeros(len(self.data) + 1, np.int32)
        first = np.maximum(starts - PERIOD + 1, self.offsets[np.searchsorted(self.offsets, starts, "right") - 1])
        np.add.at(edge, first, 1)
        np.add.at(edge, starts + 1, -1)
        at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        return at[at + self.length <= self.ends[at]]

    def names(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket hashes and names of the whole strings at ``starts``; independent of each other."""
        return names_at(_WHOLE, self.data, starts, self.length), names_at(_CHECK, self.data, starts, self.length)


class Dealt:
    """Names dealt to buckets, each once, in order; and where every entry's name is among them."""

    def __init__(self, buckets: np.ndarray, names: np.ndarray):
        order = np.lexsort((names, buckets))
        b, n = buckets[order], names[order]
        new = np.ones(len(b), bool)
        new[1:] = (b[1:] != b[:-1]) | (n[1:] != n[:-1])
        self.of = np.empty(len(b), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.names = n[new]
        self.twice = np.bincount(self.of, minlength=len(self.names)) > 1
        self.buckets, first = np.unique(b[new], return_index=True)
        self.first = np.append(first, len(self.names))

    def batch(self, pack: int, extra: bytes | None = None) -> pa.Table:
        rows = [self.names[a:b].tobytes() for a, b in zip(self.first[:-1], self.first[1:], strict=True)]
        buckets = self.buckets.astype(np.int64).tolist()
        if extra is not None:  # goes along to the answers of this pack
            buckets.append(-1 - pack)
            rows.append(extra)
        return pa.table({"bucket": pa.array(buckets, pa.int64()), "pack": pa.array([pack] * len(rows), pa.int64()), "names": pa.array(rows, pa.large_binary()).cast(pa.binary())})

    def repeated(self, answers: pa.Table) -> np.ndarray:
        """Of each entry, whether its name occurs twice, in this pack or over all."""
        out = self.twice.copy()
        place = {int(b): k for k, b in enumerate(self.buckets)}
        for bucket, bits in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True):
            if bucket >= 0:
                k = place[bucket]
                n = self.first[k + 1] - self.first[k]
                out[self.first[k] : self.first[k + 1]] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
        return out[self.of]


def _answers(dtype: str):
    """Of a bucket's names, which occur in two packs or more, as bits for each pack."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = key[0].as_py()
        packs, names = [], []
        for b in batches:
            packs.extend(b.column("pack").to_pylist())
            names.extend(b.column("names").to_pylist())
        if bucket < 0:
            bits = names
        else:
            names = [np.frombuffer(x, dtype) for x in names]
            every = np.sort(np.concatenate(names))
            twice = np.unique(every[1:][every[1:] == every[:-1]])
            if not len(twice):
                return
            bits = []
            for x in names:
                at = np.minimum(np.searchsorted(twice, x), len(twice) - 1)
                bits.append(np.packbits(twice[at] == x).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(packs, pa.int64()), pa.array([bucket] * len(packs), pa.int64()), pa.array(bits, pa.binary())], names=["pack", "bucket", "bits"])

    return run


def _first_in_task(packs: int, length: int):
    @tidy
    def run(batches):
        seen: set[bytes] = set()
        for b in batches:
            rows = []
            for h, text in zip(b.column("h").to_pylist(), b.column("text"), strict=True):
                if h not in seen:
                    seen.add(h)
                    rows.append((int.from_bytes(h[:6], "little") % packs, h, text.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["pack", "h", "text"])

    return run


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> _U(32)) % _U(buckets)


def deduplicate(docs: DataFrame, length: int = LENGTH, pack_bytes: int = PACK_BYTES, bucket_names: int = BUCKET_NAMES, least_parts: int = LEAST_PARTS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256. ``length`` is at least 2 * PERIOD."""
    if length < 2 * PERIOD:
        raise ValueError(f"length must be {2 * PERIOD} or more")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.select("doc_id", F.unhex(F.md5("text")).alias("h"), F.octet_length("text").cast("long").alias("n_bytes"), F.col("text").cast("binary").alias("text"))
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).first().n
    packs = max(least_parts, total // pack_bytes)
    buckets = max(least_parts, total * len(COVER) // PERIOD // bucket_names)

    texts = rows.where(F.col("n_bytes") >= length).select("h", "text").mapInArrow(_first_in_task(packs, length), "pack long, h binary, text binary")
    named, answered = "bucket long, pack long, names binary", "pack long, bucket long, bits binary"

    def deal_samples(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, names = Pack(table, length).samples()
        return Dealt(_bucket(names, buckets), names.astype(np.uint32)).batch(key[0].as_py())

    def deal_candidates(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        pack = Pack(table, length)
        starts, names = pack.samples()
        again = Dealt(_bucket(names, buckets), names.astype(np.uint32)).repeated(answers)
        starts = pack.candidates(starts[again])
        edges = np.flatnonzero(np.diff(np.concatenate([[-2], starts])) != 1)  # where runs of candidates begin
        runs = np.stack([starts[edges], np.diff(np.append(edges, len(starts)))]) if len(starts) else np.zeros((2, 0), np.int64)
        hashes, names = pack.names(starts)
        return Dealt(_bucket(hashes, buckets), names).batch(key[0].as_py(), runs.astype(np.uint32).tobytes())

    def remove(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        pack = Pack(table, length)
        sent = [x for b, x in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True) if b < 0]
        runs = np.frombuffer(sent[0] if sent else b"", np.uint32).reshape(2, -1).astype(np.int64)
        starts = np.repeat(runs[0] - (np.cumsum(runs[1]) - runs[1]), runs[1]) + np.arange(runs[1].sum())
        hashes, names = pack.names(starts)
        starts = starts[Dealt(_bucket(hashes, buckets), names).repeated(answers)]
        edge = np.zeros(len(pack.data) + 1, np.int32)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + length, -1)
        gone = np.cumsum(edge[:-1]) > 0
        before = np.zeros(len(gone), bool)
        before[1:] = gone[:-1]
        before[pack.offsets[:-1]] = False
        begins = gone & ~before
        out = []
        for h, a, b in zip(pack.hashes, pack.offsets[:-1], pack.offsets[1:], strict=True):
            n = int(gone[a:b].sum())
            if n:
                out.append((h, n, int(begins[a:b].sum()), hashlib.sha256(pack.data[a:b][~gone[a:b]].tobytes()).hexdigest()))
        cols = list(zip(*out, strict=True)) if out else [()] * 4
        types = (pa.binary(), pa.int64(), pa.int64(), pa.string())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("h", "n_removed", "n_spans", "kept_sha256"), cols, types, strict=True)})

    # The three uses of ``texts`` by pack are one exchange, which Spark reuses.
    first = texts.groupBy("pack").applyInArrow(deal_samples, named).groupBy("bucket").applyInArrow(_answers("<u4"), answered)
    second = texts.groupBy("pack").cogroup(first.groupBy("pack")).applyInArrow(deal_candidates, named).groupBy("bucket").applyInArrow(_answers("<u8"), answered)
    found = stored(texts.groupBy("pack").cogroup(second.groupBy("pack")).applyInArrow(remove, "h binary, n_removed long, n_spans long, kept_sha256 string"), "removed")

    own = rows.select("doc_id", "h", "n_bytes", F.sha2("text", 256).alias("own"))
    copies = own.where(F.col("n_bytes") >= length).groupBy("h").agg(F.count("*").alias("copies")).where("copies > 1")
    out = own.join(copies, "h", "left").join(found, "h", "left")
    copied = F.col("copies").isNotNull()
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "own")).alias("kept_sha256"),
    )
