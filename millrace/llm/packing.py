"""Best-fit packing of tokenised documents into sequences of a fixed length.

1. ``pieces``: each whole text is tokenised (distinct words once per cut, by dictionary encoding), the end id appended, and documents
   over the capacity cut into pieces. Only lengths and a checksum travel on.
2. The length histogram (``capacity`` rows at most) goes to the driver. The configuration linear program  min sum x_p  with
   sum_p a_pL x_p >= n_L  over patterns p (of pieces above a sixteenth of a sequence) starts by multiplicative weights: a pattern of
   greatest weight is priced by knapsack dynamic programming, used as often as its scarcest length allows, and the weights of its
   lengths shrink by the share that it covers. The program over the patterns so far then sets the weights, until every length is
   covered and the uses are within ``GAP`` of the dual bound; lengths are counted in units, as fine as that asks for.
3. Rounding: patterns are used in whole numbers, rounded down; the pieces left re-enter the program until all of them have a place in a
   pattern. The room left in the sequences goes to the pieces up to a sixteenth of a sequence, by exact subset sums; what remains of
   those fills sequences of its own in the same way.
4. The packing is a table of slots (length, ranks, sequence, offset) of a size bounded by patterns and lengths. Pieces get a rank
   within their length by block counts (no window holds all pieces of one length) and find their slot by binary search.

Null and empty texts have the end id alone. Repeated rows are packed each; ties in length are interchangeable. An empty table gives no
rows; extra columns are ignored.
"""

import bisect
import os
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import Words, small_batches, stored, text_chunks, tidy, utf8

CAPACITY = 4096
END_ID = 1
#: The linear program is solved to this share above its lower bound.
GAP = 0.01
#: The finest division of a sequence into units: with places that take longer pieces too (WIDER), more gains next to nothing and takes
#: minutes (3,000 lengths: 7,819 uses at 512 units in 1 s, 7,812 at 1,024 in 10 s).
FINEST = 512
#: Rounds without any progress of uses or bound after which a program is taken as it is: it covers every length all the same.
STALLED = 2000
#: Units by which the piece in a place of a pattern may be longer than the place.
WIDER = 2
#: Text bytes tokenised at once: a cut's distinct words are looked up once.
CUT_BYTES = 1 << 20
#: Words whose ids a worker remembers in a task (some 150 bytes each), and those that it keeps for its next task: the first ones it met.
CACHE_WORDS = 400_000
KEPT_WORDS = 100_000

#: ASCII marks that, at the end of a word and after a letter, are a token run of their own (not ' and >, which may end other tokens).
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of words by a tokenizer that drops blanks and merges nothing across them; ids of a text are those of its words in order."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _encode(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _add(self, words: list[str]) -> None:
        """A word of letters alone is one run, so many are encoded as one text and told apart by the ids that end a run."""
        plain = [w for w in words if w.isalpha()]
        other = [w for w in words if not w.isalpha()]
        parts, sizes = [], []
        for i in range(0, len(plain), 2000):
            some = plain[i : i + 2000]
            ids = self._encode([" ".join(some)])[0]
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                parts.append(ids)
                sizes.append(np.diff(ends, prepend=0))
            else:
                each = self._encode(some)
                parts.extend(each)
                sizes.append(np.array([len(x) for x in each]))
        for i in range(0, len(other), 2000):  # what the tokenizer returns for a word takes many times its ids
            each = self._encode(other[i : i + 2000])
            parts.extend(each)
            sizes.append(np.array([len(x) for x in each], np.int64))
        first = len(self.starts) - 1
        for k, w in enumerate([*plain, *other]):
            self.place[w] = first + k
        self.flat = np.concatenate([self.flat, *parts])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate(sizes))])

    def shrink(self, most: int = KEPT_WORDS) -> None:
        """Forgets all words but the first ``most``: common words come early, and a worker's other tasks need its memory."""
        if len(self.place) > most:
            self.place = dict(islice(self.place.items(), most))
            self.starts = self.starts[: most + 1].copy()
            self.flat = self.flat[: self.starts[-1]].copy()

    def places(self, words: list[str]) -> np.ndarray:
        """Where the ids of each word are: indexes into ``starts``."""
        got = list(map(self.place.get, words))
        if None in got:
            new = [w for w, g in zip(words, got, strict=True) if g is None]
            if len(self.place) + len(new) > CACHE_WORDS:
                self._clear()
                new = words
            self._add(new)
            got = list(map(self.place.get, words))
        return np.array(got, np.int64)


_LOADED: dict[str, WordIds] = {}


def token_ids(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a cut's texts, and the offsets of its rows."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    known = _LOADED[path]
    data, offsets = utf8(column)
    words = Words(data, offsets)
    solid = np.arange(len(data), dtype=np.int32)
    solid[_MARK[data]] = 0
    np.maximum.accumulate(solid, out=solid)
    stem = solid[words.end - 1] + 1 if len(words.end) else words.end
    cut = (stem < words.end) & (stem > words.start)
    cut[cut] = _LETTER[data[stem[cut] - 1]]
    starts = np.sort(np.concatenate([words.start, stem[cut]]))
    sizes = np.sort(np.concatenate([words.end, stem[cut]])) - starts
    ends = np.concatenate([[0], np.cumsum(sizes)])
    plain = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[words.inside])))
    coded = plain.dictionary_encode()
    places = known.places(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
    codes = places[coded.indices.to_numpy(zero_copy_only=False)] if len(sizes) else places
    n = np.diff(known.starts)[codes]
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n - known.starts[codes], n)
    return known.flat[at], np.concatenate([[0], ends])[np.searchsorted(starts, offsets)]


def _pieces(path: str, capacity: int, end_id: int):
    @tidy
    def run(batches):
        for cut in text_chunks(batches, limit=CUT_BYTES):
            ids, offsets = token_ids(cut.column("text"), path)
            rows, piece, start, length, crc = [], [], [], [], []
            for i in range(cut.num_rows):
                doc = np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(doc), capacity)):
                    part = doc[at : at + capacity]
                    rows.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [cut.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        if path in _LOADED:
            _LOADED[path].shrink()

    return run


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    run = _pieces(tokenizer or default_tokenizer(), capacity, end_id)
    return small_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _knapsack(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each room up to len(weights) - 1: the greatest weight that fits, and the last size taken for it (0: none, as one less room)."""
    capacity = len(weights) - 1
    best = np.zeros(capacity + 1)
    pick = np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        gain = best[c - 1 :: -1][:c] + weights[1 : c + 1]
        k = int(gain.argmax())
        best[c], pick[c] = (gain[k], k + 1) if gain[k] > best[c - 1] else (best[c - 1], 0)
    return best, pick


def _taken(pick: np.ndarray, room: int) -> dict[int, int]:
    out: dict[int, int] = {}
    while room > 0:
        size = int(pick[room])
        if size:
            out[size] = out.get(size, 0) + 1
        room -= size or 1
    return out


def price(weights: np.ndarray) -> dict[int, int]:
    """Unbounded knapsack: the sizes (with numbers) of greatest weight that fit len(weights) - 1; weights[0] is unused."""
    return _taken(_knapsack(weights)[1], len(weights) - 1)


def _inverted(columns: np.ndarray) -> np.ndarray:
    """The inverse by Gauss-Jordan steps with row pivots. Element-wise work only: threaded linear algebra can stand still for ever in a
    process that was forked from one with threads."""
    n = len(columns)
    work = np.concatenate([columns, np.eye(n)], 1)
    for i in range(n):
        k = i + int(np.abs(work[i:, i]).argmax())
        if k != i:
            work[[i, k]] = work[[k, i]]
        work[i] /= work[i, i]
        factor = work[:, i].copy()
        factor[i] = 0
        rows = np.flatnonzero(factor)
        work[rows] -= factor[rows, None] * work[i]
    return work[:, n:]


class _Master:
    """The program over the patterns found so far, by the revised simplex method: min sum x, A x >= need, with prices of the sizes.

    No product of it goes through BLAS (see ``_inverted``): sums of element-wise products, and einsum without its optimizer.
    """

    def __init__(self, sizes: np.ndarray, need: np.ndarray, capacity: int):
        self.at = {int(n): i for i, n in enumerate(sizes)}
        self.need = need * (1 + 1e-7 * np.random.default_rng(0).random(len(need)))  # no two rows leave the basis at once
        self.basis: list[dict[int, int] | None] = [{int(n): capacity // int(n)} for n in sizes]
        self.rows = list(range(len(sizes)))  # the row of a surplus column
        self.pivots = 0
        self.inverse = np.diag(1 / np.array([capacity // int(n) for n in sizes], float))
        self._solve()

    def _column(self, i: int) -> np.ndarray:
        out = np.zeros(len(self.need))
        if self.basis[i] is None:
            out[self.rows[i]] = -1
        else:
            for n, a in self.basis[i].items():
                out[self.at[n]] = a
        return out

    def _solve(self) -> None:
        self.x = np.maximum(np.einsum("ij,j->i", self.inverse, self.need), 0)
        self.cost = np.array([float(p is not None) for p in self.basis])
        self.prices = np.einsum("i,ij->j", self.cost, self.inverse)

    def total(self) -> float:
        return float((self.cost * self.x).sum())

    def enter(self, pattern: dict[int, int] | None, row: int = 0, least: float = 1e-9) -> bool:
        """A pattern, or the surplus of a row, comes into the basis if it costs ``least`` less than its prices."""
        rows = [row] if pattern is None else [self.at[n] for n in pattern]
        values = np.array([-1.0] if pattern is None else list(pattern.values()), float)
        reduced = float(pattern is not None) - float((self.prices[rows] * values).sum())
        if not reduced <= -least:
            return False
        change = (self.inverse[:, rows] * values).sum(1)
        ratio = np.full(len(change), np.inf)
        up = change > 1e-9
        ratio[up] = self.x[up] / change[up]
        i = int(ratio.argmin())
        if not ratio[i] < np.inf:
            return False
        self.x = np.maximum(self.x - ratio[i] * change, 0)
        self.x[i] = ratio[i]
        new = self.inverse[i] / change[i]
        self.inverse -= np.outer(change, new)
        self.inverse[i] = new
        self.prices = self.prices + reduced * new
        self.basis[i], self.rows[i], self.cost[i] = pattern, row, float(pattern is not None)
        self.pivots += 1
        if self.pivots % 1000 == 0:
            self.inverse = _inverted(np.stack([self._column(k) for k in range(len(self.need))], 1))
            self._solve()
        return True


def _program(counts: np.ndarray, rounds: int, step: float, gap: float) -> tuple[list[tuple[dict[int, int], float]], np.ndarray]:
    """The patterns with their uses, and prices of the sizes; the uses sum to at most 1 + ``gap`` times the bound of the prices."""
    have = counts > 0
    have[0] = False
    if not have.any():
        return [], np.zeros(len(counts))
    capacity, sizes = len(counts) - 1, np.flatnonzero(have)
    weights = np.where(have, np.arange(len(counts)) / len(counts), -1.0)
    master = _Master(sizes, counts[sizes].astype(float), capacity)
    for _ in range(rounds):
        pattern = price(weights)
        amount = min(counts[n] / a for n, a in pattern.items())
        for n, a in pattern.items():
            weights[n] *= np.exp(-step * a * amount / counts[n])
        master.enter(pattern)
    bound, prices, idle = 0.0, np.zeros(len(counts)), 0
    while idle < STALLED:
        before = (master.total(), bound)
        low = int(master.prices.argmin())
        if master.prices[low] < -1e-9 and master.enter(None, low):
            idle = idle + 1 if master.total() >= before[0] - 1e-12 else 0
            continue
        weights = np.full(len(counts), -1.0)
        weights[sizes] = np.maximum(master.prices, 0)
        best, pick = _knapsack(weights)
        if (reached := float((counts[sizes] * weights[sizes]).sum()) / best[capacity]) > bound:
            bound, prices = reached, np.maximum(weights, 0) / best[capacity]
        if master.total() <= bound * (1 + gap) or best[capacity] <= 1 + 1e-9:
            break
        # The best pattern of each size by the same pricing, as long as it is worth half of what the best one was.
        value = weights[sizes] + best[capacity - sizes]
        for i in np.argsort(-value, kind="stable")[: int((value > 1 + (best[capacity] - 1) / 2).sum())]:
            pattern = _taken(pick, capacity - int(sizes[i]))
            pattern[int(sizes[i])] = pattern.get(int(sizes[i]), 0) + 1
            master.enter(pattern, least=(best[capacity] - 1) / 2)
        idle = idle + 1 if master.total() >= before[0] - 1e-12 and bound <= before[1] else 0
    return [(p, float(x)) for p, x in zip(master.basis, master.x, strict=True) if p is not None and x > 0], prices


def configuration_lp(counts: np.ndarray, rounds: int = 150, step: float = 0.4, gap: float = GAP / 4) -> list[tuple[dict[int, int], float]]:
    """Patterns and how often each is used, covering counts[size] pieces of each size in bins of len(counts) - 1.

    Multiplicative weights give the first patterns: every round prices one, uses it as often as its scarcest size allows, and shrinks
    the weights of its sizes by the share of them that it covers. The program over the patterns then sets the weights of the sizes, and
    patterns are priced until the uses are within ``gap`` of the bound that the weights give. Every size is covered.
    """
    return _program(counts, rounds, step, gap)[0]


def large_program(counts: np.ndarray, capacity: int, unit: int | None = None, gap: float = GAP) -> tuple[list[tuple[dict[int, int], float]], int, float]:
    """The program over pieces above a sixteenth of a sequence: patterns of sizes in units of tokens, the unit, and a lower bound of the
    uses in single tokens. The unit is halved until the uses are within ``gap`` of the bound or a sequence has FINEST units, unless it
    is given.
    """
    large = np.where(np.arange(len(counts)) > capacity // 16, counts, 0)
    at, given = unit or max(1, capacity // 256), unit is not None
    while capacity % at:
        at -= 1
    bound = float((large * np.arange(len(counts))).sum()) / capacity
    while True:
        sizes = -(-np.arange(len(counts)) // at)
        program, prices = _program(np.bincount(sizes, large, minlength=capacity // at + 1), 150, 0.4, gap / 4)
        weights = np.where(large > 0, prices[sizes], -1.0)
        if program:
            bound = max(bound, float((large * np.maximum(weights, 0)).sum()) / _knapsack(weights)[0][capacity])
        if given or at == 1 or capacity // at >= FINEST or sum(x for _, x in program) <= bound * (1 + gap):
            return program, at, bound
        at = next(n for n in range(at // 2, 0, -1) if capacity % n == 0)


class _Left:
    """The pieces not packed yet: numbers by length, and the lengths that there are, in order."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.copy()
        self.counts[0] = 0
        self.lengths = [int(n) for n in np.flatnonzero(self.counts)]

    def fill(self, room: int) -> dict[int, int]:
        """The pieces that fill ``room`` best: a subset of greatest sum, of long pieces rather than short ones.

        Each length enters as bundles of 1, 2, 4 ... pieces; the sums that bundles reach are the bits of one number.
        """
        bundles, sums, reached = [], [1], 1
        mask = (1 << room + 1) - 1
        for length in reversed(self.lengths[: bisect.bisect_right(self.lengths, room)]):
            number, size = min(int(self.counts[length]), room // length), 1
            while number:
                size = min(size, number)
                bundles.append((length, size))
                reached = (reached | reached << length * size) & mask
                sums.append(reached)
                number -= size
                size *= 2
            if reached >> room:
                break
        out: dict[int, int] = {}
        at = reached.bit_length() - 1
        for k in range(len(bundles), 0, -1):
            if not sums[k - 1] >> at & 1:
                length, size = bundles[k - 1]
                out[length] = out.get(length, 0) + size
                at -= length * size
        return out

    def times(self, pattern: dict[int, int]) -> int:
        return min(int(self.counts[n]) // a for n, a in pattern.items())

    def take(self, pattern: dict[int, int], times: int) -> None:
        for n, a in pattern.items():
            self.counts[n] -= a * times
            if not self.counts[n]:
                self.lengths.pop(bisect.bisect_left(self.lengths, n))


def _placed(left: _Left, places: dict[int, int], unit: int, capacity: int) -> tuple[dict[int, int], bool]:
    """Pieces for a pattern's places, and whether each place has one.

    A place takes a piece of its size or of up to WIDER more units: units round lengths up, so a pattern has room that only longer pieces
    use. The lengths with the greatest sum are taken; where more pieces of a length would be needed than are left, or a place has
    none, the longest of each size.
    """
    choices, sums, mask = [], [1], (1 << capacity + 1) - 1
    for size, number in sorted(places.items(), reverse=True):
        low, high = bisect.bisect_right(left.lengths, (size - 1) * unit), bisect.bisect_right(left.lengths, (size + WIDER) * unit)
        for _ in range(number):
            choices.append(left.lengths[low:high][::-1])
            reached = 0
            for length in choices[-1]:
                reached |= sums[-1] << length
            sums.append(reached & mask)
    pattern: dict[int, int] = {}
    at = sums[-1].bit_length() - 1
    for k in range(len(choices), 0, -1):
        length = next((n for n in choices[k - 1] if n <= at and sums[k - 1] >> at - n & 1 and pattern.get(n, 0) < left.counts[n]), None)
        if length is None:
            break
        pattern[length] = pattern.get(length, 0) + 1
        at -= length
    else:
        return pattern, True
    pattern, full = {}, True
    for size, number in sorted(places.items(), reverse=True):
        high = bisect.bisect_right(left.lengths, size * unit)
        while number and high and left.lengths[high - 1] > (size - 1) * unit:
            length = left.lengths[high - 1]
            take = min(number, int(left.counts[length]))
            pattern[length] = take
            number -= take
            high -= 1
        full = full and not number
    return pattern, full


def _large(counts: np.ndarray, capacity: int, unit: int | None) -> list[tuple[dict[int, int], int]]:
    """Whole sequences for all pieces above a sixteenth of a sequence.

    The program's uses are rounded down and taken; the pieces left re-enter the program. Where no use reaches one, the patterns of the
    greatest uses (half of the greatest one at least) are taken once; a place that no piece is left for goes to others that fit.
    """
    left, out = _Left(np.where(np.arange(len(counts)) > capacity // 16, counts, 0)), []
    while left.lengths:
        program, unit, _ = large_program(left.counts, capacity, unit)  # the unit found for all pieces serves what is left of them
        whole = [(p, int(x + 1e-6)) for p, x in program if x >= 1 - 1e-6]
        most = max(x for _, x in program)
        for places, wanted in whole or [(p, 1) for p, x in sorted(program, key=lambda p: -p[1]) if x >= most / 2]:
            while wanted > 0 and left.lengths:
                pattern, full = _placed(left, places, unit, capacity)
                if not (full or not whole and pattern):
                    break
                times = min(wanted, left.times(pattern))
                left.take(pattern, times)
                if not full:
                    more = left.fill(capacity - sum(n * a for n, a in pattern.items()))
                    left.take(more, 1)
                    pattern = {n: pattern.get(n, 0) + more.get(n, 0) for n in pattern | more}
                out.append((pattern, times))
                wanted -= times
    return out


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """The longest piece left that fits, again and again; what plans are measured against."""
    counts, out = counts.copy(), []
    while (lengths := np.flatnonzero(counts)).size:
        pattern: dict[int, int] = {}
        room = capacity
        for n in lengths[::-1].tolist():
            if take := min(int(counts[n]), room // n):
                pattern[n] = take
                room -= take * n
        times = min(int(counts[n]) // a for n, a in pattern.items())
        out.append((pattern, times))
        for n, a in pattern.items():
            counts[n] -= a * times
    return out


def rounded(counts: np.ndarray, capacity: int, unit: int | None = None) -> list[tuple[dict[int, int], int]]:
    """Patterns and how many sequences each makes; together they hold exactly ``counts``.

    Every piece above a sixteenth of a sequence has its place by the program. The shorter ones fill the room left, the fullest
    sequences first, and then sequences of their own.
    """
    sequences = sorted(_large(counts, capacity, unit), key=lambda p: -sum(n * a for n, a in p[0].items()))
    left, out = _Left(np.where(np.arange(len(counts)) <= capacity // 16, counts, 0)), []
    for pattern, wanted in sequences:
        room = capacity - sum(n * a for n, a in pattern.items())
        while wanted:
            if more := left.fill(room):
                times = min(wanted, left.times(more))
                left.take(more, times)
            else:
                times = wanted
            out.append((pattern | more, times))
            wanted -= times
    while left.lengths:
        pattern = left.fill(capacity)
        times = left.times(pattern)
        out.append((pattern, times))
        left.take(pattern, times)
    return out


def plan(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """The packing of all pieces, by the rounded program."""
    return rounded(counts, capacity)


def slots(patterns: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Rows (length, first rank, number in each sequence, first sequence, first offset), sorted by length and rank."""
    rows, ranks, sequence = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for length, a in sorted(pattern.items(), reverse=True):
            rows.append((length, ranks.get(length, 0), a, sequence, offset))
            ranks[length] = ranks.get(length, 0) + a * times
            offset += a * length
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "sequence", "offset"), table.T, strict=True))


def _place(table: dict[str, np.ndarray]):
    key = (table["length"] << np.int64(44)) + table["rank"]

    @tidy
    def run(batches):
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(key, (length << np.int64(44)) + rank, "right") - 1
            within, each = rank - table["rank"][at], table["each"][at]
            keep = [c for c in b.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), pa.array(table["sequence"][at] + within // each), pa.array(table["offset"][at] + within % each * length)],
                names=[*keep, "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    parts = stored(pieces(docs, tokenizer, capacity, end_id), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in parts.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    blocks = max(8, int(counts.sum()) // 20_000)
    parts = parts.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)))
    before = F.sum("count").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    first = parts.groupBy("length", "block").count().withColumn("first", F.coalesce(before, F.lit(0))).drop("count")
    nth = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = parts.withColumn("nth", nth).join(first, ["length", "block"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth") - 1).alias("rank"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(_place(slots(plan(counts, capacity))), schema)
