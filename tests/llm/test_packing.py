import random
import re
import threading
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from millrace.llm import packing
from tests.llm.helpers import documents, empty, pairs


def ids_of(texts):
    t = Tokenizer.from_file(packing.default_tokenizer())
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_token_ids_equal_the_tokenizers_own():
    rng = random.Random(1)
    parts = list("abzAÉéİß ñ'<>|.,!?#$%-_1٣́ \u3000 \n\tωΣς字") + ["<|endoftext|>", "<|startoftext|>", "'s", "'ll", "don't", "the", "</w>", "..", "\u00e9"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(2000)] + [None, "", "\x1c\x85 x"]
    ids, at = packing.token_ids(pa.array(texts), packing.default_tokenizer())
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == ids_of(texts)


def test_a_task_gives_its_memory_back():
    """Else an executor's Python workers hold it beside the next stages' own; a second giving back finds little left."""
    from millrace.llm.common import give_back

    def megabytes():
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"\nPss_Anon:\s+(\d+)", f.read())[1]) / 1024

    rng = random.Random(9)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(1500)) for _ in range(300)]
    batches = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(texts)], names=["doc_id", "text"])
    run = packing._pieces(packing.default_tokenizer(), 4096, 1)
    assert sum(b.num_rows for b in run(iter([batches]))) >= 300
    held = megabytes()
    give_back()
    assert held - megabytes() < 10


def test_an_idle_worker_keeps_no_powers():
    """A roller's powers are 16 bytes for each byte of the longest cut; each module has rollers of its own."""
    from millrace.llm import decontamination, ngram_join, quality_classifier, quality_rules

    text = " ".join(f"word{i} and" for i in range(20000))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["doc_id", "text"])
    index = decontamination._append([(1, "one two three four five six")], "found", decontamination.MASKS, 24, 0.8)
    before = None
    for _ in range(2):  # what is let go is found again
        rows = [list(run(iter([batch])))[0].to_pylist() for run in (ngram_join._whole_sets(5), quality_classifier._append("x"), index)]
        assert before in (None, rows)
        before = rows
        for roller in (ngram_join._ROLLER, decontamination._ROLLER, quality_rules.TextStats.roller, quality_rules.TextStats.folded):
            assert len(roller.pow) == len(roller.inv) == 1


def test_a_shrunk_memory_still_tells_the_ids():
    known = packing.WordIds(packing.default_tokenizer())
    texts = [f"word{i}x" for i in range(50)] + ["hello", "Ü!", "<|endoftext|>"]
    told = lambda: [known.flat[known.starts[i] : known.starts[i + 1]].tolist() for i in known.places(texts)]
    before = told()
    known.shrink(20)
    assert len(known.place) == 20 and len(known.flat) == known.starts[-1]
    assert told() == before == ids_of(texts)


@pytest.mark.parametrize("capacity", [64, 4096])
def test_pieces_and_places(spark, capacity):
    docs = documents(spark)
    rows = packing.pack(docs, capacity=capacity).collect()
    want = []
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    for (i, _), ids in zip(texts, ids_of([t for _, t in texts])):
        ids = [*ids, 1]
        want += [(i, k, s, len(p := ids[s : s + capacity]), zlib.crc32(np.array(p, "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    for sequence in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == sequence), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_all_pieces_in_few_sequences(seed):
    rng = np.random.default_rng(seed)
    counts = np.where(rng.random(257) < 0.5, rng.integers(0, 40, 257), 0)
    counts[0] = 0
    plan = packing.plan(counts, 256)
    held = np.zeros(257, np.int64)
    for pattern, times in plan:
        assert sum(n * a for n, a in pattern.items()) <= 256
        for n, a in pattern.items():
            held[n] += a * times
    assert (held == counts).all()
    assert sum(t for _, t in plan) <= 1.1 * -(-int((counts * np.arange(257)).sum()) // 256) + 2


def test_program_of_3000_sizes_ends_beside_a_live_session(spark):
    assert spark.range(1).count() == 1
    counts = np.zeros(4097, np.int64)
    counts[1000:4000] = np.arange(3000) % 7 + 1
    began = time.monotonic()
    done = threading.Event()
    plans = []
    threading.Thread(target=lambda: (plans.append(packing.plan(counts, 4096)), done.set()), daemon=True).start()
    assert done.wait(120), "the program did not end"
    assert time.monotonic() - began < 120
    assert held_by(plans[0]).tolist() == counts.tolist()


def test_inverse_without_blas():
    rng = np.random.default_rng(3)
    a = np.where(rng.random((60, 60)) < 0.1, rng.integers(-2, 5, (60, 60)), 0) + np.diag(rng.integers(6, 9, 60)).astype(float)
    assert np.abs(packing._inverted(a)[:, :] @ a - np.eye(60)).max() < 1e-9


def held_by(plan, capacity=4096):
    held = np.zeros(capacity + 1, np.int64)
    for pattern, times in plan:
        assert sum(n * a for n, a in pattern.items()) <= capacity
        for n, a in pattern.items():
            held[n] += a * times
    return held


def test_all_large_pieces_of_the_corpus_are_placed_by_patterns(spark):
    counts = np.zeros(4097, np.int64)
    for r in packing.pieces(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    large = packing._large(counts, 4096, None)
    assert held_by(large)[257:].tolist() == counts[257:].tolist() and held_by(large)[:257].sum() == 0
    plan = packing.plan(counts, 4096)
    assert held_by(plan).tolist() == counts.tolist()
    total = int((counts * np.arange(4097)).sum())
    assert sum(t for _, t in plan) <= sum(t for _, t in packing.best_fit(counts, 4096))
    assert sum(t for _, t in plan) == -(-total // 4096)


def test_pricing_is_an_exact_knapsack():
    weights = np.array([-1, 1.0, 2.1, 3.0, -1, 5.4])
    assert packing.price(weights) == {5: 1}
    weights[5] = -1
    assert packing.price(weights) == {2: 2, 1: 1}


def test_linear_program_covers_what_it_uses():
    counts = np.zeros(101, np.int64)
    counts[[60, 40, 30]] = [10, 10, 20]
    program = packing.configuration_lp(counts, rounds=300)
    covered = np.zeros(101)
    for pattern, x in program:
        for n, a in pattern.items():
            covered[n] += a * x
    assert (covered[[60, 40, 30]] >= 0.999 * counts[[60, 40, 30]]).all()


def test_linear_program_covers_every_length_and_meets_its_bound():
    for low, high, number in ((1025, 2048, 200), (257, 4097, 7)):
        counts = np.zeros(4097, np.int64)
        counts[low:high] = number  # no small pieces that could fill gaps
        program, unit, bound = packing.large_program(counts, 4096)
        covered = np.zeros(4096 // unit + 1)
        for pattern, x in program:
            assert sum(n * a for n, a in pattern.items()) <= 4096 // unit
            for n, a in pattern.items():
                covered[n] += a * x
        need = np.bincount(-(-np.arange(4097) // unit), counts, minlength=len(covered))
        assert (covered >= 0.9999 * need).all()
        assert sum(x for _, x in program) <= (1 + packing.GAP) * bound
        held = np.zeros(4097, np.int64)
        plan = packing.rounded(counts, 4096)
        for pattern, times in plan:
            assert sum(n * a for n, a in pattern.items()) <= 4096
            for n, a in pattern.items():
                held[n] += a * times
        assert (held == counts).all()
        assert sum(t for _, t in plan) <= 1.015 * bound


def test_extra_columns_and_empty_table(spark):
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert pairs(packing.pack(documents(spark, extra=True)), *columns) == pairs(packing.pack(documents(spark)), *columns)
    assert packing.pack(empty(spark)).count() == 0
