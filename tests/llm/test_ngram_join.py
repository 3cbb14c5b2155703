import random
import re

import pytest

from millrace.llm import graph, ngram_join
from tests.llm.helpers import documents, empty, pairs, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def sets(rows, size):
    out = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(FOLD))
        out.append((i, frozenset(tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))) if w else frozenset()))
    return out


def want(rows, size, percent):
    docs = sets(rows, size)
    label = list(range(len(docs)))
    for a, (i, x) in enumerate(docs):
        for b, (j, y) in enumerate(docs[:a]):
            if x and y and i is not None and j is not None and 100 * len(x & y) >= percent * len(x | y):
                old, new = label[a], label[b]
                label = [new if k == old else k for k in label]
    least = {}
    for k, (i, _) in zip(label, docs):
        if i is not None:
            least[k] = min(least.get(k, i), i)
    return sorted(((i, len(x), least.get(k) if i is not None else None) for k, (i, x) in zip(label, docs)), key=str)


def near_copies(n=60, seed=5):
    rng = random.Random(seed)
    base = words(rng, 90).split()
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(7)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    return rows + [(n + i, words(rng, 60, 300)) for i in range(30)] + [(200, rows[0][1]), (201, rows[0][1].upper())]


@pytest.mark.parametrize("size,percent,tile,small", [(3, 90, 2000, 8), (5, 80, 7, 3), (3, 90, 5, 0)])
def test_groups_match_brute_force(spark, monkeypatch, size, percent, tile, small):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "SMALL", max(small, 1))
    rows = near_copies()
    got = pairs(ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), size, percent), "doc_id", "n_shingles", "component_id")
    assert got == want(rows, size, percent)


def test_hostile_rows(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = want(rows, 3, 90)
    assert pairs(ngram_join.join(docs, 3, 90), "doc_id", "n_shingles", "component_id") == expected
    assert pairs(ngram_join.join(documents(spark, extra=True), 3, 90), "doc_id", "n_shingles", "component_id") == expected


def test_keep_leaves_one_of_each_group(spark):
    docs = documents(spark, extra=True)
    kept = ngram_join.keep(docs, 5, 80)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [-5, 1, 4, 5, 6, 7, 8, 10, 11, 12, 13, 14] and ids.count(None) == 2


def test_empty_table(spark):
    assert ngram_join.join(empty(spark)).count() == 0
    assert ngram_join.keep(empty(spark)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.range(150).selectExpr("id as a", "id + 1 as b").union(spark.createDataFrame([(500, 400)], "a long, b long"))
    assert pairs(graph.components(edges), "node", "label") == sorted([(i, 0) for i in range(151)] + [(400, 400), (500, 400)], key=str)


def test_keep_with_repeated_ids(spark):
    a, b = words(random.Random(1), 60, 300), words(random.Random(2), 60, 300)
    near = b.split()
    near[30] = "changed"
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "x"), (2, " ".join(near), "x"), (None, a, "x"), (None, a, "x"), (3, "only here", "x"), (3, "only here", "y"), (3, "only here", None)]
    kept = ngram_join.keep(spark.createDataFrame(rows, "doc_id long, text string, extra string"), 5, 80).collect()
    ids = sorted(str(r.doc_id) for r in kept)
    assert ids == ["1", "2", "3", "None", "None"]
    assert {r.text for r in kept if r.doc_id == 2} <= {b, " ".join(near)}


def test_a_group_of_near_copies_makes_few_candidates(spark, monkeypatch):
    """Verified pairs grow with the nodes of a group, not with their square."""
    tried = []
    stored = ngram_join.stored

    def counting(df, name):
        out = stored(df, name)
        if name == "verified":
            tried.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "stored", counting)
    rng = random.Random(8)
    base = words(rng, 150, 5000).split()
    for n in (60, 240):
        tried.clear()
        rows = []
        for i in range(n):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(40)}"
            rows.append((i, " ".join(w)))
        got = pairs(ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90), "doc_id", "n_shingles", "component_id")
        assert got == want(rows, 3, 90) and sum(tried) < 6 * n


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_links_share_one_of_the_first_differences_from_a_hub(percent):
    """All but those between two sets that both link with the hub, whatever the order of the columns."""
    rng = random.Random(percent)

    def linked(a, b):
        return 100 * len(a & b) >= percent * len(a | b)

    def first(x, hub):
        delta = sorted(x ^ hub)
        return set(delta[: ngram_join.delta_prefix(len(x), len(hub), len(delta), percent)])

    seen = 0
    for _ in range(4000):
        base = rng.sample(range(400), rng.randrange(1, 30))
        hub, x = (set(base) ^ set(rng.sample(range(400), rng.randrange(9))) for _ in range(2))
        y = x ^ set(rng.sample(range(400), rng.randrange(7)))
        if not hub or not x or not y or not linked(x, y) or linked(x, hub) and linked(y, hub) or x == y:
            continue
        seen += 1
        assert first(x, hub) & first(y, hub), (hub, x, y)
    assert seen > 100


def test_rows_of_a_large_group_grow_with_its_nodes(spark, monkeypatch):
    """A group with many edits, most of which do not link, is dealt to tiles in rows that grow with it, not with its square."""
    monkeypatch.setattr(ngram_join, "TILE", 30)
    monkeypatch.setattr(ngram_join, "SMALL", 4)
    rows, of_tiles = spark.sparkContext.accumulator(0), ngram_join._tiles

    def counting(percent, forest):
        run = of_tiles(percent, forest)

        def counted(batches):
            def each():
                for b in batches:
                    rows.add(b.num_rows)
                    yield b

            return run(each())

        return counted

    monkeypatch.setattr(ngram_join, "_tiles", counting)
    rng, dealt = random.Random(12), []
    base = words(rng, 70, 5000).split()
    for n in (100, 400):
        docs = []
        for i in range(n):
            w = list(base)
            for _ in range(rng.randrange(12)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(3000)}"
            docs.append((i, " ".join(w)))
        before = rows.value
        got = pairs(ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string"), 3, 80), "doc_id", "n_shingles", "component_id")
        assert got == want(docs, 3, 80)
        dealt.append(rows.value - before)
    assert 0 < dealt[1] < 6 * dealt[0], dealt
