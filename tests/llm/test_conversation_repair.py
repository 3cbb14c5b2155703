import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from millrace.llm import catalog, conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def least(rows):
    """(cost, audit, repaired) of (role, text, fault), by forward search over whole audits: the least for each prefix and final roles."""
    ways = {"": (0, "", ())}  # by the initials given so far, cut to what the rule needs

    def state(s):
        return s if s in ("", "s") else s[-1] + "!" if s else s

    def put(into, key, way):
        if key not in into or way < into[key]:
            into[key] = way

    def after(key, x):
        """The state after one more role initial, or None."""
        if x == "s":
            return "s" if key == "" else None
        if x == "u":
            return "u" if key in ("", "s", "a") else None
        return "a" if key == "u" and x == "a" else None

    def inserted(ways):
        for _ in range(3):
            for key, (c, a, r) in list(ways.items()):
                for role in ("user", "assistant"):
                    if (to := after(key, role[0])) is not None:
                        put(ways, to, (c + 3, a + "I", (*r, f"{role}:")))
        return ways

    ways = inserted(ways)
    for role, text, fault in rows:
        new = {}
        for key, (c, a, r) in ways.items():
            put(new, key, (c + 4, a + "D", r))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            if (to := after(key, role[:1])) is not None:
                put(new, to, (c + more, a + "K", (*r, f"{role}:{text}")))
            for other in ("user", "assistant"):
                if (to := after(key, other[0])) is not None:
                    put(new, to, (c + more + 3, a + "R", (*r, f"{other}:{text}")))
        ways = inserted(new)
    return min(w for k, w in ways.items() if k in ("", "a"))


def exhaustive(rows):
    """The same by trying every audit."""
    best = None
    for n in range(len(rows) + 1 + 3):
        for letters in itertools.product("DIKR", repeat=n):
            if sum(x != "I" for x in letters) != len(rows):
                continue
            cost, at, roles, told = 0, 0, "", []
            for x in letters:
                need = "assistant" if roles.endswith("u") else "user"
                if x == "I":
                    cost, roles = cost + 3, roles + need[0]
                    told.append(f"{need}:")
                    continue
                role, text, fault = rows[at]
                at += 1
                if x == "D":
                    cost += 4
                elif fault in ("blank", "duplicate"):
                    cost = 10**6
                else:
                    new = role if x == "K" else need
                    cost += 3 * (x == "R") + 3 * (fault == "truncated")
                    roles += new[:1] or "?"
                    told.append(f"{new}:{text}")
            if cost < 10**6 and re.fullmatch("(s?(ua)+)?", roles):
                best = min(best or (10**9,), (cost, "".join(letters), tuple(told)))
    return best


def faults(rows):
    """(role, text, fault) of rows (turn, role, text) in order."""
    out, seen = [], set()
    for _, role, text in rows:
        shown = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        fault = "blank" if not re.search(r"[^\x20\x09-\x0D]", text) else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))


def expected(table, damaged):
    """The result rows, from (conv_id, turn, role, text)."""
    out = []
    for conv in {r[0] for r in table}:
        rows = []
        for c, turn, role, text in table:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20 if damaged else 9
            if kind == 1:
                text = ""
            if kind == 2:
                text = re.sub("[.!?]", "", text)
            if kind == 4:
                role = "user"
            rows += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        rows = ordered(rows)
        told = faults(rows)
        turns = {r[0] for r in rows} - {None}
        cost, audit, repaired = least(told)
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
        n = [sum(f == k for _, _, f in told) for k in ("blank", "duplicate", "truncated")]
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *n, illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=str)


def some_rows(rng, conversations, longest):
    texts = ["Yes.", "No", "Well then! ", "a b c?", " \t", "", "Ünï.", "more", "x. y", None]
    roles = ["user", "assistant", "system", "tool", "", "User", None]
    return [(c, rng.choice([t, t, t, t + 1, None]), rng.choices(roles, (8, 8, 2, 1, 1, 1, 1))[0], rng.choice(texts) if rng.random() < 0.3 else f"t{rng.randrange(9)}" + rng.choice(".!? x")) for c in conversations for t in range(rng.randrange(longest))]


def test_the_search_of_the_test_is_exhaustive():
    rng = random.Random(1)
    for _ in range(60):
        rows = [(rng.choice(["user", "assistant", "system", "x"]), "t", rng.choice(["", "", "truncated", "blank", "duplicate"])) for _ in range(rng.randrange(5))]
        assert least(rows) == exhaustive(rows)


@pytest.mark.parametrize("seed", range(3))
def test_repairs_equal_brute_force(spark, seed):
    table = some_rows(random.Random(seed), [None, *range(60)], 14)
    assert got(conversation_repair.damaged_repairs(spark.createDataFrame(table, SCHEMA))) == expected(table, True)
    assert got(conversation_repair.repair(spark.createDataFrame(table, SCHEMA))) == expected(table, False)


def test_long_conversations_over_many_blocks_and_tasks(spark, monkeypatch):
    rng = random.Random(5)
    table = some_rows(rng, [1, 2], 3) + [(7, t // 2, rng.choice(["user", "assistant", "system"]), f"t{rng.randrange(3000)}" + rng.choice([".", "."]) * rng.randrange(2)) for t in range(5000)]
    table += [(7, 900, "user", "the same.")] * 2500 + [(8, None, None, None)] * 1500
    assert got(conversation_repair.repair(spark.createDataFrame(table, SCHEMA))) == expected(table, False)
    blocks = conversation_repair._coded(conversation_repair._keyed(spark.createDataFrame(table, SCHEMA)))
    order = ("conv_id", "turn", "role", "digest")
    sizes = [len(r.codes) for r in blocks.repartitionByRange(6, *order).sortWithinPartitions(*order).mapInArrow(conversation_repair._cut, conversation_repair._BLOCK_ROW + ", costs array<long>").collect() if r.conv_id == 7]
    assert sum(sizes) == 7500 and max(sizes) <= conversation_repair.BLOCK and len(sizes) > 7


def test_hand_made(spark):
    table = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Ho."), (2, 0, "assistant", "Ho."), (3, 0, "system", "S."), (4, 0, "user", "a b"), (4, 1, "assistant", "Ok."), (5, 0, "user", " ")]
    rows = {r.conv_id: (r.cost, r.audit) for r in conversation_repair.repair(spark.createDataFrame(table, SCHEMA)).collect()}
    assert rows == {1: (0, "KK"), 2: (3, "IK"), 3: (4, "D"), 4: (3, "KK"), 5: (4, "D")}


def test_odd_rows_empty_tables_and_extra_columns(spark):
    from pyspark.sql import functions as F

    table = [(1, 3, "user", "x" * 50_000 + "."), (1, 3, "user", "x" * 50_000 + "."), (1, None, None, None), (1, 4, "assistant", "é\n?"), (None, None, "user", None), (2, 2**40, "a", "b.")]
    df = spark.createDataFrame(table, SCHEMA)
    for c in ("part", "block", "kind", "codes", "digest", "copies", "fault", "cost", "state", "time"):
        df = df.withColumn(c, F.lit("own"))
    assert got(conversation_repair.damaged_repairs(df)) == expected(table, True)
    assert conversation_repair.damaged_repairs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sql_agrees_on_odd_rows(spark):
    table = [r for r in some_rows(random.Random(9), range(25), 9) if r[1] is not None]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", table)
    result = con.sql(catalog.ORACLES["op11_conversation_repair"])
    at = [result.columns.index(n) for n in NAMES]
    assert sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=str) == expected(table, True)
