import itertools
import math
import random

import pyarrow as pa
import pytest

from millrace.llm import decontamination
from tests.llm.helpers import documents, empty, pairs, words


def _case(spark):
    rng = random.Random(11)
    items = [(i, words(rng, n, 5000)) for i, n in enumerate((30, 18, 45, 12, 7, 4))] + [(20, None), (None, words(rng, 20, 5000)), (0, words(rng, 25, 5000))]
    noise = lambda n: words(rng, n, 5000)
    changed = items[0][1].split()
    changed[7] = "sub"
    changed[21] = "other"
    rows = [
        (1, noise(50)), (2, noise(20) + " " + items[0][1] + " " + noise(20)), (3, noise(9) + "\n" + " ".join(changed) + " " + noise(3)), (4, items[1][1].upper() + "."), (5, noise(3) + " " + items[4][1] + " " + noise(3)),
        (6, " ".join(items[2][1].split()[:10]) + " " + noise(30)), (7, items[5][1]), (8, None), (9, ""), (10, noise(5) + " " + " ".join(items[2][1].split()[12:40])), (11, items[7][1]), (2, noise(4)), (None, items[3][1]),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def brute(text, items):
    """Every diagonal of every item, without seeds."""
    norm = lambda t: [w[:-1] if w[-1] in ".,;:!?" and len(w) > 1 else w for w in (t or "").lower().split()]
    doc, out = norm(text), set()
    for i, t in items:
        item = norm(t)
        size = min(decontamination.STRETCH, len(item))
        if len(item) < decontamination.LEAST_WORDS:
            continue
        for shift in range(-len(item), len(doc)):
            same = [0 <= k + shift < len(doc) and doc[k + shift] == item[k] for k in range(len(item))]
            inside = [0 <= k + shift < len(doc) for k in range(len(item))]
            if any(sum(same[k : k + size]) >= decontamination.AGREE * size and all(inside[k : k + size]) for k in range(len(item) - size + 1)):
                out.add(i)
    return out


@pytest.mark.parametrize("block", [10**6, 40])
def test_matches_brute_force(spark, block):
    docs, benchmark = _case(spark)
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    got = pairs(decontamination.search(docs, benchmark, block_words=block), "doc_id", "contaminated", "items")
    want = sorted(((r.doc_id, bool(f := brute(r.text, items)), sorted(f, key=lambda x: (x is None, x))) for r in docs.collect()), key=str)
    assert got == want
    assert {i for i, bad, _ in got if bad} == {2, 3, 4, 5, 10, 11, None}


def test_masks():
    assert all(len(m) == decontamination.SPAN and m.count("1") == 8 for m in decontamination.MASKS)


@pytest.mark.parametrize("n", range(5, 25))
def test_every_placement_of_allowed_changes_is_found(n):
    rng = random.Random(n)
    item = [f"x{i}" for i in range(n)]
    changed = n - math.ceil(decontamination.AGREE * n)
    texts = []
    for places in itertools.combinations(range(n), changed):
        texts.append(" ".join(["before", *("sub" if i in places else w for i, w in enumerate(item)), "after"]))
    texts += [" ".join("sub" if i in places else w for i, w in enumerate(item)) for places in (rng.sample(range(n), changed + 1) for _ in range(20))]
    block = [(1, " ".join(item))]
    run = decontamination._append(block, "overlaps", decontamination.MASKS + decontamination.COMPLETING, decontamination.STRETCH, decontamination.AGREE)
    found = [bool(x) for b in run([pa.RecordBatch.from_pydict({"text": texts})]) for x in b.column("overlaps").to_pylist()]
    assert found == [True] * (len(texts) - 20) + [False] * 20
    for i in rng.sample(range(len(texts)), min(len(texts), 30)):
        assert found[i] == bool(brute(texts[i], block))


def test_keep_and_hostile_rows(spark):
    _, benchmark = _case(spark)
    docs = documents(spark, extra=True)
    kept = decontamination.keep(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert decontamination.search(docs, benchmark.limit(0)).where("contaminated").count() == 0
    assert decontamination.search(empty(spark), benchmark).count() == 0
