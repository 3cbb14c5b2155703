import hashlib
import math
import random
import re
import time

from millrace.llm import pii
from tests.llm.helpers import documents, empty, pairs

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    None, "", "a@b.co_x@d.e +1 (2) 3.4-5 678 90 4111 1111 1111 1111 1.2.3.4.5.6.7.8 0001.2.3.4 é@é a.@b..c.d 999.1.1.1 +123 +1234567 é +12345678", "write to joe.b@mail.example.com or me@x.org.", "4111111111111111,5500-0000-0000-0004 4111 1111 1111 1112 12345678901234567890",
    "10.0.0.255 10.0.0.256 1.2.3 000000255.1.1.1 99999999999999999999.1.1.1 .1.2.3.4.", "日本 +82 (2) 123-4567 文字 x@y.z", "9" * 5000, "a" * 50_000, "@" * 3000, "a@" * 3000, "+1" * 3000, "1." * 3000, "1 " * 4000, "+1 234 567 890 123 456 7",
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base(text):
    out = {}
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(p) > 255 for p in m[0].split("."))) or (kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits))) or (kind == "phone" and not 8 <= len(digits) <= 15):
                continue
            out.setdefault(kind, []).append((m.start(), m.end()))
    joined = ",".join(f"{k}:{a}:{b}" for k in PATTERNS for a, b in out.get(k, []))
    return *(len(out.get(k, [])) for k in PATTERNS), hashlib.sha256(joined.encode()).hexdigest(), joined


COLUMNS = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def test_base_spans_match_brute_force(spark):
    rows = list(enumerate(TEXTS)) + [(None, TEXTS[2])]
    got = pairs(pii.find(spark.createDataFrame(rows, "doc_id long, text string")), *COLUMNS)
    assert got == sorted(((i, *base(t)) for i, t in rows), key=str)


def _letters(spark):
    """One person in eight different notes that share a rare name; others have common words only."""
    notes = [(i, f"note{i} Zanzibarov met person x.y@corp.example.com at place{i} and the end") for i in range(8)]
    return notes + [(100 + i, f"met person at place{i} and the end of day {i}") for i in range(200)] + [(400 + i, "copy Raredog of one.two@corp.example.com and the end") for i in range(20)]


def test_terms_that_disclose_an_entity_become_spans(spark):
    rows = {r.doc_id: r for r in pii.find(spark.createDataFrame(_letters(spark), "doc_id long, text string")).collect()}
    assert rows[0].spans == "email:28:48,term:6:16" and rows[0].n_term == 1
    assert rows[0].base_sha256 == hashlib.sha256(b"email:28:48").hexdigest()
    assert all(rows[i].n_term == 0 for i in rows if i >= 100)  # copies of one line prove nothing


def test_sanitize_redacts_and_keeps_columns(spark):
    docs = documents(spark, extra=True).limit(0).unionByName(spark.createDataFrame(_letters(spark), "doc_id long, text string"), allowMissingColumns=True)
    out = pii.sanitize(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: r for r in out.collect()}
    assert texts[3].text == "note3 [TERM] met person [EMAIL] at place3 and the end" and texts[3].n_chars == len(texts[3].text) and texts[3].pii_email is None
    assert texts[105].text == "met person at place5 and the end of day 5"


def test_hostile_rows(spark):
    docs = documents(spark, extra=True)
    out = pii.sanitize(docs)
    assert out.columns == docs.columns and pairs(out, "doc_id", "text", "pii_email") == pairs(docs, "doc_id", "text", "pii_email")
    assert pii.find(docs).count() == docs.count()
    assert pii.find(empty(spark)).count() == 0 and pii.sanitize(empty(spark)).count() == 0


def test_overlapping_spans_are_redacted_once(spark):
    rows = [(1, "a 4111 1111 1111 1111 b +4111 1111 1111 111 c 1.2.3.4@x.org d")]
    assert pii.sanitize(spark.createDataFrame(rows, "doc_id long, text string")).first().text == "a [CARD] b [PHONE] c [EMAIL] d"


def _spans(text):
    """kind, start, end, value, words beside, of each valid base span, by kind."""
    out = []
    for kind, pattern in PATTERNS.items():
        all_matches = list(re.finditer(pattern, text))
        valid = {tuple(map(int, x.split(":")[1:])) for x in base(text)[-1].split(",") if x.startswith(kind + ":")}
        for n, m in enumerate(all_matches):
            if m.span() not in valid:
                continue
            before = text[all_matches[n - 1].end() if n else 0 : m.start()]
            after = text[m.end() : all_matches[n + 1].start() if n + 1 < len(all_matches) else len(text)]
            left, right = before.split("\n")[-1], after.split("\n")[0]
            left = left if len(left) < pii.CONTEXT_CHARS else re.sub(r"^\S*", "", left[-pii.CONTEXT_CHARS + 1 :]) if left[-pii.CONTEXT_CHARS] != " " else left[-pii.CONTEXT_CHARS + 1 :]
            out.append((kind, *m.span(), m[0], left.split()[-pii.CONTEXT_WORDS :] + right[: pii.CONTEXT_CHARS].split()[: pii.CONTEXT_WORDS]))
    return out


def _names(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "email":
        local, domain = value.lower().split("@")
        name = re.sub("[^a-z]", "", local)
        return {value.lower(), "@" + domain} | ({name} if len(name) >= 4 else set())
    return {value, ".".join(value.split(".")[:2])} if kind == "ip" else {digits, digits[: 6 if kind == "card" else 4]}


def _terms(texts):
    """The term spans of each text, by the definition."""
    contexts, pairs_, lines = {}, {}, [x for t in texts for x in t.split("\n")]
    for t in texts:
        for kind, _, _, value, words in _spans(t):
            for e in _names(kind, value):
                contexts.setdefault((kind, e), set()).add(tuple(words))
                for w in words:
                    seen = pairs_.setdefault((kind, e, w), (set(), set()))
                    seen[0].add(tuple(words))
                    seen[1].add(t)
    disclosing = set()
    for (kind, e, w), (some, where) in pairs_.items():
        if min(len(some), len(where)) >= pii.LEAST_CONTEXTS:
            n_term, n_entity = sum(w in x.split() for x in lines), len(contexts[kind, e])
            pmi = math.log2(len(some) / n_entity) - math.log2(max(n_term, len(some)) / len(lines))
            if pmi >= pii.DISCLOSURE * -math.log2(n_entity / len(lines)):
                disclosing.add((kind, e, w))
    out = []
    for t in texts:
        held = {(kind, e) for kind, _, _, value, _ in _spans(t) for e in _names(kind, value)}
        words = {w for k, e, w in disclosing if (k, e) in held}
        out.append([f"term:{m.start()}:{m.end()}" for m in re.finditer(r"\S+", t) if m[0] in words])
    return out


def test_terms_match_an_independent_count(spark):
    rng = random.Random(4)
    people = [(f"Name{k}", f"role{k}", f"person{'abcdef'[k]}.{k}@d{k % 2}.example.org", f"+1 (20{k}) 555-010{k}", f"10.{k}.3.7") for k in range(6)]
    texts = []
    for i in range(160):
        words = [f"w{int(rng.random() ** 2 * 90)}" for _ in range(rng.randrange(5, 60))]
        if i % 3 == 0:
            name, role, *values = rng.choice(people)
            at = rng.randrange(len(words))
            words[at:at] = [name, rng.choice(values), role] if rng.random() < 0.8 else [rng.choice(values)]
        for k in range(9, len(words), 13):
            words[k] += "\n" + "x" * rng.choice([0, 3, 150])
        texts.append(" ".join(words))
    want = _terms(texts)
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(map(len, want)) > 20
    for i, t in enumerate(want):
        assert [x for x in got[i].spans.split(",") if x.startswith("term:")] == t and got[i].n_term == len(t)


def test_many_matches_in_one_text_take_linear_time(spark):
    text = " ".join(f"10.{i % 250}.{i % 200}.{i % 99} via u{i}@h{i % 7}.example.org" for i in range(50_000))
    docs = spark.createDataFrame([(1, text), (2, "one line")], "doc_id long, text string")
    began = time.time()
    row = pii.find(docs).where("doc_id = 1").first()
    assert (row.n_email, row.n_ip) == (50_000, 50_000) and row.base_sha256 == base(text)[4]
    clean = pii.sanitize(docs).where("doc_id = 1").first().text
    assert re.sub(r"via|\[TERM\]", "", clean).split() == ["[IP]", "[EMAIL]"] * 50_000 and time.time() - began < 240
