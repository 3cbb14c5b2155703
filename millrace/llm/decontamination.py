"""Benchmark decontamination by spaced seeds.

A seed is a mask over ``SPAN`` consecutive words; only the words under its 1s are hashed, so a changed word under a 0 does not hide a
copy. The windows of every benchmark item and of every whole document are hashed under each mask and matched; around a hit, item and
document are laid side by side on its diagonal, and the overlap is real if some stretch of ``STRETCH`` words (the whole item, where that
is shorter) agrees in at least ``AGREE`` of its words. Words are compared with A-Z folded and without marks at their end.

Every overlap that the rule accepts is found: ``MASKS`` and ``COMPLETING`` together have, for each number of words from SPAN to STRETCH and
each placement of as many changed words as AGREE allows, a mask and a shift without a changed word under a 1 (other masks, or a stretch or
share below those, give no such warranty). Items shorter than SPAN words are cut into two blocks more than they may have changed words,
and looked up by masks of their whole length, one for each two blocks: two blocks at least are unchanged. Items under ``LEAST_WORDS`` words are too short to tell and
are ignored. The benchmark is taken in blocks of at most ``BLOCK_WORDS`` words, one pass over the documents each, stored before the next, so what
the driver and a worker hold, and the plan, are bounded at any size of the benchmark.

Null and empty texts and items match nothing; null item ids stay null in ``items``; repeated items count as one per item_id; repeated
documents get a row each. Empty tables are allowed, extra columns ignored.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import _STEPS, Roller, Words, mix, small_batches, stored, text_chunks, tidy, utf8

SPAN = 12
#: Weight 8 each; a shift and a mask with no changed word under a 1 is enough for a hit.
MASKS = ("111010010111", "110110101011", "101101110101")
#: Weight 6 each, for the placements of changed words that no mask above gets past; found by enumeration of all.
COMPLETING = ("1110111", "111000001011", "111111")
STRETCH = 24
AGREE = 0.8
LEAST_WORDS = 5
BLOCK_WORDS = 1_000_000

_TAIL = np.zeros(256, bool)
_TAIL[[ord(c) for c in ".,;:!?"]] = True
_ROLLER = Roller(23, fold=True)


def word_hashes(data: np.ndarray, words: Words) -> np.ndarray:
    end = words.end
    if len(end):
        end = end - (_TAIL[data[end - 1]] & (end - words.start > 1))
    return _ROLLER.ranges(_ROLLER.prefix(data), words.start, end)


def seed_hashes(hashes: np.ndarray, first: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows under one mask, and where they begin; windows stay within a document."""
    last = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(len(hashes)) + len(mask) <= last)
    out = np.full(len(at), np.uint64(len(mask)))
    for j, on in enumerate(mask):
        if on == "1":
            out += hashes[at + j] * _STEPS[j + 8]
    return mix(out), at


def whole_masks(n: int, agree: float) -> list[str]:
    """Masks over all of an item of n words, one of which has no 1 over a changed word if ``agree`` of the words are unchanged."""
    changed = n - int(np.ceil(agree * n))
    blocks = np.array_split(np.arange(n), min(changed + 2, n))
    kept = combinations(blocks, len(blocks) - changed)
    return ["".join("01"[i in on] for i in range(n)) for on in (set(np.concatenate(k).tolist()) for k in kept)]


class SeedIndex:
    """The seeds of a block of benchmark items."""

    def __init__(self, items: list[tuple[int | None, str]], masks=MASKS + COMPLETING, agree: float = AGREE):
        self.ids = [i for i, _ in items]
        data, offsets = utf8(pa.array([t for _, t in items], pa.string()))
        words = Words(data, offsets)
        self.words, self.first = word_hashes(data, words), words.first
        span = max(map(len, masks))
        short = sorted({int(n) for n in words.counts if LEAST_WORDS <= n < span})
        whole = [m for n in short for m in whole_masks(n, agree)]
        self.masks = [*masks, *whole]
        self.tables = []
        for i, mask in enumerate(self.masks):
            keys, at = seed_hashes(self.words, self.first, mask)
            if i < len(masks):
                here = np.repeat(words.counts >= span, words.counts)[at]
            else:  # the whole of an item of just this length
                here = np.isin(at, self.first[:-1][words.counts == len(mask)])
            keys, at = keys[here], at[here]
            order = np.argsort(keys, kind="stable")
            keys, at = keys[order], at[order]
            filter_ = np.zeros(1 << 20, bool)
            filter_[keys >> np.uint64(44)] = True
            self.tables.append((keys, at, filter_))
        self.item_of = np.repeat(np.arange(len(items)), words.counts)

    def diagonals(self, hashes: np.ndarray, words: Words) -> np.ndarray:
        """Distinct (doc, item, shift) of all hits; a document's word i lies beside the item's word i - shift."""
        found = []
        for mask, (keys, at, filter_) in zip(self.masks, self.tables, strict=True):
            seeds, where = seed_hashes(hashes, words.first, mask)
            maybe = np.flatnonzero(filter_[seeds >> np.uint64(44)])
            low, high = np.searchsorted(keys, seeds[maybe], "left"), np.searchsorted(keys, seeds[maybe], "right")
            n = high - low
            pos = np.repeat(where[maybe], n)
            hit = at[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - low, n)] if n.sum() else np.zeros(0, np.int64)
            doc, item = words.doc[pos], self.item_of[hit]
            found.append(np.stack([doc, item, (pos - words.first[doc]) - (hit - self.first[item])], 1))
        return np.unique(np.concatenate(found), axis=0)

    def overlap(self, doc: np.ndarray, item: int, shift: int, stretch: int, agree: float) -> tuple[int, int] | None:
        """The words of the document (first, end) that the item covers on a diagonal, or None if no stretch agrees."""
        other = self.words[self.first[item] : self.first[item + 1]]
        low, high = max(0, -shift), min(len(other), len(doc) - shift)
        if high <= low:
            return None
        same = np.concatenate([[0], np.cumsum(doc[low + shift : high + shift] == other[low:high])])
        size = min(stretch, len(other))
        if high - low < size:
            return None
        good = np.flatnonzero(same[size:] - same[:-size] >= np.ceil(agree * size))
        if not len(good):
            return None
        return int(low + shift + good[0]), int(low + shift + good[-1] + size)


def _append(block: list[tuple[int | None, str]], name: str, masks, stretch: int, agree: float):
    held: list[SeedIndex] = []

    @tidy
    def run(batches):
        if not held:
            held.append(SeedIndex(block, masks, agree))
        index = held[0]
        for cut in text_chunks(batches):
            data, offsets = utf8(cut.column("text"))
            words = Words(data, offsets)
            hashes = word_hashes(data, words)
            overlaps: list[list[tuple]] = [[] for _ in range(cut.num_rows)]
            for doc, item, shift in index.diagonals(hashes, words).tolist():
                part = index.overlap(hashes[words.first[doc] : words.first[doc + 1]], item, shift, stretch, agree)
                if part:
                    overlaps[doc].append({"item_id": index.ids[item], "first_word": part[0], "end_word": part[1]})
            yield pa.RecordBatch.from_arrays([*cut.columns, pa.array(overlaps, _OVERLAPS)], names=[*cut.schema.names, name])

    return run


_OVERLAPS = pa.list_(pa.struct([("item_id", pa.int64()), ("first_word", pa.int64()), ("end_word", pa.int64())]))
_FOUND = "array<struct<item_id: long, first_word: long, end_word: long>>"


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of bounded size, which stream to the driver one at a time; one empty block for an empty benchmark."""
    block, size, any_block = [], 0, False
    for row in benchmark.where(F.col("text").isNotNull()).select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        n = len(row.text.split())
        if size and size + n > block_words:
            yield block
            block, size, any_block = [], 0, True
        block.append((row.item_id, row.text))
        size += n
    if block or not any_block:
        yield block


def with_overlaps(docs: DataFrame, benchmark: DataFrame, column: str, masks=MASKS + COMPLETING, stretch: int = STRETCH, agree: float = AGREE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """All rows and columns of ``docs`` (none may start with ``column``) and ``column``: the verified overlaps (item_id, first_word, end_word) of each text."""
    out, found = small_batches(docs), None
    for block in _blocks(benchmark, block_words):
        if found is not None:  # the block before is worked off and let go
            out = stored(out.withColumn(column, found).select(*docs.columns, column), "overlaps")
        new = f"{column}_new"
        found = F.concat(column, new) if column in out.columns else F.col(new)
        schema = T.StructType([*out.schema.fields, T.StructField(new, T._parse_datatype_string(_FOUND))])
        out = out.mapInArrow(_append(block, new, masks, stretch, agree), schema)
    return out.withColumn(column, found).select(*docs.columns, column)


def search(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, contaminated, n_overlaps, items (sorted distinct item ids), overlaps (first:end words, sorted)."""
    rows = with_overlaps(docs.select("doc_id", "text"), benchmark, "overlaps", **options)
    spans = F.array_join(F.transform(F.array_sort(F.transform("overlaps", lambda o: F.struct(o.first_word, o.end_word, o.item_id))), lambda o: F.concat_ws(":", o.item_id, o.first_word, o.end_word)), ",")
    return rows.select(
        "doc_id",
        (F.size("overlaps") > 0).alias("contaminated"),
        F.size("overlaps").cast("long").alias("n_overlaps"),
        F.array_sort(F.array_distinct(F.transform("overlaps", lambda o: o.item_id))).alias("items"),
        spans.alias("overlaps"),
    )


def keep(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents (all their columns) without a verified overlap."""
    column = "overlaps"
    while any(c.startswith(column) for c in docs.columns):
        column = "_" + column
    return with_overlaps(docs, benchmark, column, **options).where(F.size(column) == 0).select(*docs.columns)
