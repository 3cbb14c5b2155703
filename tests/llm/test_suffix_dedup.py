import hashlib
import random
from collections import Counter

from millrace.llm import suffix_dedup
from tests.llm.helpers import documents, empty, pairs

L = suffix_dedup.LENGTH


def want(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + L] for _, b in texts for k in range(len(b) - L + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - L + 1):
            if seen[b[k : k + L]] > 1:
                gone[k : k + L] = b"\1" * L
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_cover_has_every_difference():
    d = suffix_dedup.COVER
    assert {(a - b) % suffix_dedup.PERIOD for a in d for b in d} == set(range(suffix_dedup.PERIOD))


def test_matches_brute_force_on_planted_repeats(spark):
    rng = random.Random(7)
    junk = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = [junk(n) for n in (195, 199, 200, 201, 260, 700)]
    rows = [(i, junk(rng.randrange(300)) + rng.choice(shared) + junk(rng.randrange(90)) + rng.choice(shared) + junk(50)) for i in range(60)]
    rows += [(100, "ab" * 300), (101, "q" * 199), (102, "z" * 200), (103, "z" * 201), (104, junk(400)), (105, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert pairs(suffix_dedup.deduplicate(docs, pack_bytes=4096, bucket_names=512, least_parts=3), *COLUMNS) == want(rows)


def test_hostile_rows(spark):
    docs = documents(spark).where("n_chars is null or n_chars < 20000")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert pairs(suffix_dedup.deduplicate(docs), *COLUMNS) == want(rows)
    assert pairs(suffix_dedup.deduplicate(documents(spark, extra=True).where("n_chars is null or n_chars < 20000")), *COLUMNS) == want(rows)


def test_empty_table(spark):
    assert suffix_dedup.deduplicate(empty(spark)).count() == 0
