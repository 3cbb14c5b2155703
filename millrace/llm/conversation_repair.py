"""Repair of conversation structure: the cheapest edits that give each conversation the roles  (system? (user assistant)+)?.

Edits: Keep 0, Rerole to user or assistant 3, Delete 4 (the only one for blank and duplicate rows), Insert an empty user or assistant row
3; a truncated row that stays adds 3. A conversation is a walk through four states (nothing yet, after system, after user, after
assistant), in which every edit has one follow-up state, so an audit (the initials of the edits) determines the repair.

Square-root checkpointed dynamic program, by blocks of ``BLOCK`` rows:

1. Rows become one byte each (class of role, fault). They are ordered by ranges of (conversation, turn, role, digest of text), so a long
   conversation is spread over many tasks, and cut into blocks. Of each block the 4 x 4 costs from entry to exit state are kept.
2. The blocks of a conversation are walked backward: the vector of costs to the end is stored at their ends only, as checkpoints.
3. Every block, on its own, recomputes its vectors from its checkpoint and walks forward from each of the four states, always along the
   ASCII-least edit that is tight (its cost plus the cost behind it is the cost of the state).
4. The rows stream past, sorted, behind the audits of their blocks: the state picks one of a block's four audits, the edits are
   applied, digests are updated. Nothing of a conversation is held but its audit, which is a value of the result.

No step holds a conversation's rows: a block has 1024 rows at most, and a conversation of a million rows has as many checkpoints as a
block has rows. Texts are shuffled once. The digest of a conversation in order must see its rows in order, in one task.

Null role and text are one space (so a null text is blank). Null conv_ids form one conversation. Null turns come first; rows of one turn are
ordered by role, then digest of the text. Repeated rows are duplicates of their first. An empty table gives no rows; other columns are
ignored, whatever their names.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import small_batches

BLOCK = 1024
RETELL, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of blocks handled at once; each takes about 100 bytes of working arrays.
CUT_ROWS = 200_000

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_NEVER = 1 << 40
#: The state behind an inserted or reroled row, by state; and behind a kept row, by class of role (s, u, a, other) and state.
_NEXT = np.array([USER, USER, ASSISTANT, USER])
_KEPT = np.full((4, 4), -1)
_KEPT[0, NOTHING] = SYSTEM
_KEPT[1, [NOTHING, SYSTEM, ASSISTANT]] = USER
_KEPT[2, USER] = ASSISTANT
#: Faults of a row: none, truncated, blank, duplicate; the last two must go.
_SOUND, _TRUNCATED, _BLANK, _DUPLICATE = range(4)
_ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
#: Edits of one row with the inserts before it, as ``_audits`` numbers them: letter + 3 * inserts.
_EDITS = [b"I" * n + e for n in range(3) for e in (b"D", b"K", b"R")]


def damage(conversations: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text), damaged by crc32("conv_id:turn") % 20: 0 drops the row, 1 empties its text, 2 removes
    its marks .!?, 3 repeats it, 4 makes its role user."""
    filled = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    rows = filled.withColumn("kind", kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("time")).drop("time")


def _keyed(rows: DataFrame) -> DataFrame:
    """The rows with the digest of their text, and blank texts left out (null)."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    return rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), F.when(~blank, F.col("text")).alias("text"))


def _coded(rows: DataFrame) -> DataFrame:
    """One narrow row for all copies of a row: the code of the first one, that of the others, and how many there are."""
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(F.col("text").isNull(), _BLANK).when(whole, _SOUND).otherwise(_TRUNCATED)
    narrow = rows.groupBy("conv_id", "turn", "role", "digest").agg(F.count("*").alias("copies"), F.first(fault).alias("fault"))
    same = F.unhex(F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary"), F.lit(":").cast("binary"), F.col("digest"), F.col("role").cast("binary")), 256))
    order = F.struct(F.coalesce(F.col("turn").isNotNull(), F.lit(False)).alias("told"), "turn")
    narrow = narrow.withColumn("same", same).withColumn("at", order)
    first = narrow.groupBy("same").agg(F.min("at").alias("first"))
    role = F.substring("role", 1, 1)
    kind = F.when(role == "s", 0).when(role == "u", 1).when(role == "a", 2).otherwise(3) * 4
    again = F.when(F.col("fault") == _BLANK, _BLANK).otherwise(_DUPLICATE)
    fault = F.when(F.col("at").eqNullSafe(F.col("first")), F.col("fault")).otherwise(again)
    return narrow.join(first, "same").select("conv_id", "turn", "role", "digest", (kind + fault).alias("code"), (kind + again).alias("again"), "copies")


def _back(codes: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Costs by state before rows of ``codes``, from the costs behind them (rows, state, ...), inserts before the row included."""
    fault, kind = codes % 4, codes // 4
    rows = np.arange(len(codes))
    stays = np.where(fault >= _BLANK, _NEVER, np.where(fault == _TRUNCATED, TRUNCATED, 0)).reshape((-1,) + (1,) * (behind.ndim - 2))
    out = behind + DELETE
    for state in range(4):
        np.minimum(out[:, state], behind[:, _NEXT[state]] + stays + RETELL, out=out[:, state])
        to = _KEPT[kind, state]
        kept = np.where((to >= 0).reshape(stays.shape), behind[rows, to] + stays, _NEVER)
        np.minimum(out[:, state], kept, out=out[:, state])
    return _inserted(out)


def _inserted(costs: np.ndarray) -> np.ndarray:
    """The costs where rows may be inserted first: two are enough, a third returns to the state of the first."""
    for _ in range(2):
        costs = np.minimum(costs, costs[:, _NEXT] + INSERT)
    return np.minimum(costs, _NEVER)


_END = _inserted(np.array([[0, _NEVER, _NEVER, 0]]))[0]


def _by_length(blocks: list[bytes]):
    """The blocks' indexes and their codes as columns, longest first, a bounded number of rows at once."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    at = 0
    while at < len(order):
        some = order[at : at + max(1, CUT_ROWS // max(1, len(blocks[order[at]])))]
        longest = len(blocks[some[0]])
        codes = np.frombuffer(b"".join(blocks[i].ljust(longest, b"\xff") for i in some), np.uint8).reshape(len(some), longest)
        yield some, codes.astype(np.int64), np.array([len(blocks[i]) for i in some])
        at += len(some)


def _vectors(codes: np.ndarray, sizes: np.ndarray, end: np.ndarray, keep: bool = False) -> np.ndarray:
    """Costs before the first row of each block (longest first) from those at its end; with ``keep`` those before each row and at the end."""
    now = end.copy()
    all_of = [now.copy()] if keep else None
    for i in range(codes.shape[1] - 1, -1, -1):
        n = int(np.searchsorted(-sizes, -i, "left"))  # the blocks that have a row i
        now[:n] = _back(codes[:n, i], now[:n])
        if keep:
            all_of.append(now.copy())
    return np.stack(all_of[::-1]) if keep else now


def _cut(batches):
    """Blocks of the sorted rows: the first row's order, where the block stands, its codes, and its costs from entry to exit state."""
    part, number, conv, first, codes = TaskContext.get().partitionId(), 0, None, None, bytearray()
    out: list[tuple] = []
    held = 0

    def flush():
        nonlocal held
        matrices = [None] * len(out)
        for some, columns, sizes in _by_length([r[-1] for r in out]):
            end = np.where(np.eye(4, dtype=bool), 0, _NEVER)[None].repeat(len(some), 0)
            for i, m in zip(some, _vectors(columns, sizes, end).reshape(len(some), 16).tolist(), strict=True):
                matrices[i] = m
        rows = list(zip(*out, strict=True)) if out else [()] * 6
        batch = [pa.array([part] * len(out), pa.int64()), *(pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()), strict=True)), pa.array(matrices, pa.list_(pa.int64()))]
        out.clear()
        held = 0
        return pa.RecordBatch.from_arrays(batch, names=["part", "block", "conv_id", "turn", "role", "digest", "codes", "costs"])

    def close():
        nonlocal number, held
        if codes:
            out.append((number, conv, *first, bytes(codes)))
            held += len(codes)
            number += 1
            codes.clear()

    for b in batches:
        for c, turn, role, digest, code, again, copies in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "digest", "code", "again", "copies")), strict=True):
            if c != conv:
                close()
            while copies:
                if not codes:
                    conv, first = c, (turn, role, digest)
                    codes.append(code)
                    copies, code = copies - 1, again
                else:
                    take = 1 if code != again else min(copies, BLOCK - len(codes))
                    codes.extend(bytes([code]) * take)
                    copies, code = copies - take, again
                if len(codes) >= BLOCK:
                    close()
            if held >= CUT_ROWS:
                yield flush()
    close()
    yield flush()


_BLOCK_ROW = "part long, block long, conv_id long, turn long, role string, digest binary, codes binary"


def _checkpoints(batches):
    """The blocks of each conversation from its end: the costs at their ends."""
    conv, now = object(), None
    for b in batches:
        ends = []
        for c, costs in zip(b.column("conv_id").to_pylist(), b.column("costs").to_pylist(), strict=True):
            if c != conv:
                conv, now = c, _END.tolist()
            ends.append(now)
            now = [min(costs[4 * s + x] + now[x] for x in range(4)) for s in range(4)]
        keep = [n for n in b.schema.names if n != "costs"]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(ends, pa.list_(pa.int64()))], names=[*keep, "ends"])


def _audits(codes: np.ndarray, sizes: np.ndarray, end: np.ndarray) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Of each block: the least audits from the four states, the states that they lead to, and the costs of the four states."""
    n, length = codes.shape
    before = _vectors(codes, sizes, end, keep=True)
    state = np.tile(np.arange(4), (n, 1))
    edits = np.zeros((n, 4, length), np.uint8)
    row = np.arange(n)[:, None]
    for i in range(length):
        live = int(np.searchsorted(-sizes, -i, "left"))
        at, r = state[:live], row[:live]
        # A block shorter than the longest of the cut has its end vector behind its last row, at every later place.
        here, behind = before[i][:live], before[i + 1][:live]
        code = codes[:live, i][:, None]
        fault = code % 4
        pen = np.where(fault == _TRUNCATED, TRUNCATED, 0)
        deletes = behind[r, at] + DELETE == here[r, at]
        inserts = np.zeros_like(at)
        for _ in range(2):
            more = ~deletes & (here[r, _NEXT[at]] + INSERT == here[r, at])
            at = np.where(more, _NEXT[at], at)
            inserts += more
            deletes |= more & (behind[r, at] + DELETE == here[r, at])
        to = _KEPT[code // 4, at]
        keeps = ~deletes & (fault < _BLANK) & (to >= 0) & (behind[r, to] + pen == here[r, at])
        edits[:live, :, i] = np.where(deletes, 0, np.where(keeps, 1, 2)) + 3 * inserts
        state[:live] = np.where(deletes, at, np.where(keeps, to, _NEXT[at]))
    audits = [[b"".join(map(_EDITS.__getitem__, edits[k, s, : sizes[k]].tolist())) for s in range(4)] for k in range(n)]
    return audits, state, before[0]


def _walked(batches):
    """Every block's audits, exits and costs for each state before it, from its checkpoint."""
    for b in batches:
        blocks = b.column("codes").to_pylist()
        ends = np.array(b.column("ends").to_pylist(), np.int64).reshape(-1, 4)
        audits, exits, costs = ([None] * len(blocks) for _ in range(3))
        for some, codes, sizes in _by_length(blocks):
            for i, a, x, c in zip(some, *(list(v) for v in _audits(codes, sizes, ends[some])), strict=True):
                audits[i], exits[i], costs[i] = a, x.tolist(), int(c[NOTHING])
        keep = [n for n in b.schema.names if n != "ends"]
        new = [pa.array(audits, pa.list_(pa.binary())), pa.array(exits, pa.list_(pa.int64())), pa.array(costs, pa.int64())]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), *new], names=[*keep, "audits", "exits", "cost"])


class _Repair:
    """One conversation as its blocks and rows stream past."""

    def __init__(self, conv):
        self.conv, self.state, self.cost, self.audit, self.at, self.walk = conv, NOTHING, None, bytearray(), 0, NOTHING
        self.faults = [0] * 4
        self.turns, self.low, self.high, self.illegal, self.before = 0, None, None, 0, None
        self.hash, self.any = hashlib.sha256(), False

    def block(self, codes: bytes, audits: list[bytes], exits: list[int], cost: int) -> None:
        if self.cost is None:
            self.cost = cost
        self.audit += audits[self.state]
        self.state = exits[self.state]
        for code in set(codes):
            self.faults[code % 4] += codes.count(code)

    def _told(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == ord("I"):
            self.walk = int(_NEXT[self.walk])
            self._told(_ROLE_OF[self.walk], "")
            self.at += 1

    def row(self, turn, role: str, text) -> None:
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        self._inserts()
        edit = chr(self.audit[self.at])
        self.at += 1
        if edit == "K":
            self.walk = int(_KEPT["sua".index(role[:1]), self.walk])
            self._told(role, text)
        elif edit == "R":
            self.walk = int(_NEXT[self.walk])
            self._told(_ROLE_OF[self.walk], text)

    def result(self) -> tuple:
        self.audit += {SYSTEM: b"II", USER: b"I"}.get(self.state, b"")
        self._inserts()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, self.faults[_BLANK], self.faults[_DUPLICATE], self.faults[_TRUNCATED], self.illegal, self.cost or 0, self.audit.decode(), self.hash.hexdigest())


_RESULT = {"conv_id": pa.int64(), "gaps": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(), "cost": pa.int64(), "audit": pa.string(), "repaired_sha256": pa.string()}


def _repaired(batches):
    """Streams, sorted: of each conversation a leading row, then blocks, each before its rows."""
    now: _Repair | None = None
    out: list[tuple] = []

    def flush():
        columns = list(zip(*out, strict=True)) if out else [()] * len(_RESULT)
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _RESULT.values(), strict=True)], names=list(_RESULT))
        out.clear()
        return batch

    for b in batches:
        for kind, conv, turn, role, text, codes, audits, exits, cost in zip(*(b.column(c).to_pylist() for c in ("kind", "conv_id", "turn", "role", "text", "codes", "audits", "exits", "cost")), strict=True):
            if kind == 0:
                if now:
                    out.append(now.result())
                now = _Repair(conv)
            elif kind == 1:
                now.block(codes, audits, exits, cost)
            else:
                now.row(turn, role, text)
        if len(out) > 5000:
            yield flush()
    if now:
        out.append(now.result())
    yield flush()


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Per conversation of ``conversations`` (default: those of ``rows``): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    keyed = _keyed(rows)
    order = ("conv_id", F.col("turn").asc_nulls_first(), "role", "digest")
    blocks = _coded(keyed).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_cut, _BLOCK_ROW + ", costs array<long>")
    backward = blocks.repartition("conv_id").sortWithinPartitions("conv_id", F.col("part").desc(), F.col("block").desc())
    ends = backward.mapInArrow(_checkpoints, _BLOCK_ROW + ", ends array<long>").repartition("conv_id", "part", "block")
    walked = ends.mapInArrow(_walked, _BLOCK_ROW + ", audits array<binary>, exits array<long>, cost long")
    lead = (rows if conversations is None else conversations).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    stream = walked.withColumn("kind", F.lit(1)).unionByName(keyed.withColumn("kind", F.lit(2)), allowMissingColumns=True).unionByName(lead.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    stream = small_batches(stream).repartition("conv_id")
    stream = stream.sortWithinPartitions("conv_id", F.col("kind") > 0, F.col("turn").asc_nulls_first(), "role", "digest", "kind", "part", "block")
    return stream.mapInArrow(_repaired, ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in _RESULT.items()))


def damaged_repairs(conversations: DataFrame) -> DataFrame:
    """The repairs of the damaged rows, for every conversation that there was."""
    return repair(damage(conversations), conversations)
