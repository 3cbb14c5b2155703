"""Quality rules: base counts of a text, and how far its histograms lie from those of its language.

Distribution divergence: for each document a histogram of character classes and one of common words (``CHAR_CLASSES``,
``COMMON_WORDS`` and "any other word"). A language's reference is the mean of its documents' normalised histograms, over the whole
corpus. A document is rejected where the Jensen-Shannon distance (base 2, 0 to 1) to its language's reference exceeds a limit; texts
below the minimum lengths are not judged on that histogram. Languages outside ``LANGUAGES`` (null too) share one reference.

Null and empty texts: all counts 0, base_failed true. Ties and repeated rows: each row is judged alone. Extra columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Roller, Words, segment_sums, shingles, small_batches, stored, text_chunks, tidy, utf8

LANGUAGES = ("en", "de", "fr", "es")
CHAR_CLASSES = ("lower", "upper", "digit", "space", "punctuation", "symbol", "other")
#: Frequent function words of the languages.
COMMON_WORDS = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or an they which you had we "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es werden aus er hat dass sie nach wird bei "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec ou son "
    "el los y del se las por con no una su para al lo como más o pero sus le ya"
).split()
COMMON_WORDS = tuple(dict.fromkeys(COMMON_WORDS))

#: Production limits: distances above them reject; words and characters below them are not judged.
MAX_CHAR_DISTANCE = 0.33
MAX_WORD_DISTANCE = 0.50
MIN_CHARS = 200
MIN_WORDS = 50

_CLASS = np.full(256, 5, np.uint8)
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[32, *range(9, 14)]] = 3
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_CLASS[128:] = 6
_CONTINUATION = np.zeros(256, bool)
_CONTINUATION[0x80:0xC0] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_TAIL = np.zeros(256, bool)
_TAIL[[ord(c) for c in ".,;:!?"]] = True


def repeated(keys: np.ndarray, docs: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each (doc, key): whether it occurs twice or more in its doc; of each doc: how many occurrences come after a first one."""
    order = np.lexsort((keys, docs))
    k, d = keys[order], docs[order]
    same = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    twice = np.zeros(len(k), bool)
    twice[1:] |= same
    twice[:-1] |= same
    out = np.zeros(len(k), bool)
    out[order] = twice
    return out, np.bincount(d[1:][same], minlength=n_docs)


class TextStats:
    """Counts of each text of a cut."""

    roller = Roller(11)
    folded = Roller(11, fold=True)
    common: np.ndarray | None = None

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        words = Words(data, offsets)
        chars = ~_CONTINUATION[data]
        self.n_words = words.counts
        self.n_chars = segment_sums(chars, offsets)
        self.word_chars = segment_sums(chars & words.inside, offsets)
        self.n_symbols = segment_sums(_SYMBOL[data], offsets)
        doc_of_byte = np.repeat(np.arange(n), np.diff(offsets))[chars]
        self.classes = np.bincount(doc_of_byte * 7 + _CLASS[data[chars]], minlength=7 * n).reshape(n, 7)
        prefix = self.roller.prefix(data)
        # lines
        breaks = np.flatnonzero(data == 10)
        starts = np.union1d(np.concatenate([breaks + 1, offsets[:-1]]), [])
        starts = starts[starts < len(data)].astype(np.int64)
        ends = np.minimum.reduce([np.append(starts[1:], len(data)), len(data) + 0 * starts]) if len(starts) else starts
        ends = ends - (data[np.maximum(ends - 1, 0)] == 10) if len(starts) else ends
        line_doc = np.searchsorted(offsets, starts, "right") - 1
        inside = np.concatenate([[0], np.cumsum(words.inside)])
        real = inside[ends] > inside[starts]
        self.n_lines = np.bincount(line_doc[real], minlength=n)
        _, self.n_dup_lines = repeated(self.roller.ranges(prefix, starts[real], ends[real]), line_doc[real], n)
        # words
        hashes = self.roller.ranges(prefix, words.start, words.end)
        self.hashes = hashes
        _, again = repeated(hashes, words.doc, n)
        self.n_distinct = self.n_words - again
        long = np.flatnonzero(words.counts >= 3)
        keys, at = shingles(hashes, words.first, 3)
        each = np.diff(at)
        window_doc = np.repeat(np.arange(n), each)
        full = np.isin(window_doc, long)
        pos = (np.arange(len(keys)) - np.repeat(at[:-1], each) + np.repeat(words.first[:-1], each))[full]
        twice, _ = repeated(keys[full], window_doc[full], n)
        covered = np.zeros(len(hashes) + 3, bool)
        for j in range(3):
            covered[pos[twice] + j] = True
        self.n_repeat_words = segment_sums(covered[: len(hashes)], words.first)
        # common words, without one mark at the end
        cls = type(self)
        if cls.common is None:
            raw = [np.frombuffer(w.encode(), np.uint8) for w in COMMON_WORDS]
            cls.common = np.array([self.folded.ranges(self.folded.prefix(w), np.array([0]), np.array([len(w)]))[0] for w in raw])
            cls.common_order = np.argsort(cls.common)
        tail = words.end - (_TAIL[data[words.end - 1]] & (words.end - words.start > 1)) if len(words.end) else words.end
        folded = self.folded.ranges(self.folded.prefix(data), words.start, tail)
        known = cls.common[cls.common_order]
        at = np.minimum(np.searchsorted(known, folded), len(known) - 1)
        k = len(COMMON_WORDS)
        bins = np.where(known[at] == folded, cls.common_order[at], k)
        self.words = np.bincount(words.doc * (k + 1) + bins, minlength=(k + 1) * n).reshape(n, k + 1)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row of counts ``p`` to ``q`` (one row, or as many); 0 where either is all zero."""
    ps, qs = p.sum(-1, keepdims=True), q.sum(-1, keepdims=True)
    none = ((ps == 0) | (qs == 0))[..., 0]
    p, q = p / np.where(ps == 0, 1, ps), q / np.where(qs == 0, 1, qs)
    m = (p + q) / 2
    term = lambda a: np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0).sum(-1)
    return np.where(none, 0.0, np.sqrt(np.clip((term(p) + term(q)) / 2, 0, 1)))


_HISTOGRAMS = "doc_id long, language string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_chars long, char_hist array<int>, word_hist array<int>"


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel(), pa.int32()), rows.shape[1]).cast(pa.list_(pa.int32()))


def _histograms(batches):
    for cut in text_chunks(batches):
        stats = TextStats(*utf8(cut.column("text")))
        yield pa.RecordBatch.from_arrays(
            [cut.column("doc_id"), cut.column("language"), *(pa.array(x, pa.int64()) for x in (stats.n_words, stats.word_chars, stats.n_symbols, stats.n_dup_lines, stats.n_repeat_words, stats.n_chars)), _lists(stats.classes), _lists(stats.words)],
            names=["doc_id", "language", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "char_hist", "word_hist"],
        )


def _shares(column: str):
    """Of a task's rows the sum of the normalised histograms of each language, and how many there are."""

    @tidy
    def run(batches):
        sums: dict[str, np.ndarray] = {}
        counts: dict[str, int] = {}
        for b in batches:
            languages = np.array(b.column("language").to_pylist(), object)
            rows = b.column(column)
            hist = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1).astype(float)
            total = hist.sum(1)
            for language in set(languages[total > 0]):
                own = (languages == language) & (total > 0)
                sums[language] = sums.get(language, 0) + (hist[own] / total[own, None]).sum(0)
                counts[language] = counts.get(language, 0) + int(own.sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([counts[x] for x in sums], pa.int64()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["language", "n", "sums"])

    return run


def references(histograms: DataFrame, column: str) -> dict[str, np.ndarray]:
    """The mean normalised histogram of each language: five rows at most, of a fixed length; a task sends one row for each."""
    partial = histograms.select("language", column).mapInArrow(_shares(column), "language string, n long, sums array<double>")
    each = partial.select("language", "n", F.posexplode("sums").alias("bin", "sum"))
    out: dict[str, np.ndarray] = {}
    for row in each.groupBy("language", "bin").agg((F.sum("sum") / F.sum("n")).alias("share")).collect():
        out.setdefault(row.language, np.zeros(max(len(CHAR_CLASSES), len(COMMON_WORDS) + 1)))[row.bin] = row.share
    return out


def score(
    docs: DataFrame,
    max_char_distance: float = MAX_CHAR_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    min_chars: int = MIN_CHARS,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """One row per document: base counts, base_failed, char_distance, word_distance, kept."""
    language = F.when(F.col("lang").isin(*LANGUAGES), F.col("lang")).otherwise(F.lit("other"))
    hists = stored(small_batches(docs).select("doc_id", language.alias("language"), "text").mapInArrow(_histograms, _HISTOGRAMS), "histograms")
    chars, words = references(hists, "char_hist"), references(hists, "word_hist")
    k = len(COMMON_WORDS) + 1

    def judge(batches):
        for b in batches:
            counts = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("n_words", "n_chars", "n_repeat_words")}
            lang = b.column("language").to_pylist()
            arrays = []
            for column, refs, width, enough in (("char_hist", chars, 7, counts["n_chars"] >= min_chars), ("word_hist", words, k, counts["n_words"] >= min_words)):
                hist = b.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                ref = np.array([refs.get(x, np.zeros(width))[:width] for x in lang]).reshape(-1, width)
                arrays.append(np.round(np.where(enough, js_distance(hist, ref), 0.0), 6))
            failed = (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
            kept = ~failed & (arrays[0] <= max_char_distance) & (arrays[1] <= max_word_distance)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), *map(pa.array, arrays), pa.array(kept)],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"],
            )

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_distance double, word_distance double, kept boolean"
    return hists.mapInArrow(judge, schema)
