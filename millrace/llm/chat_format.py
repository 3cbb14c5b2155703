"""Chat formatting at token level.

Every turn becomes  HEADER role BODY text END.  The three marks are reserved ids above the vocabulary; role and text are encoded
separately, so nothing in a text can become a mark, nor merge with one. In the rendered string the marks are the strings of ``MARKS``;
these, and the control strings of other templates (``CONTROL``), are escaped in texts by a backslash after their first character (one more
where there are some already), which is undone exactly. The loss mask is 1 on the text ids of assistant turns: +1 at BODY, -1 at END,
and a running sum over the ids.

Output: one row per turn (conv_id, turn, seq, ids, loss_mask); ``seq`` orders the rows of a conversation by turn, then role, then text.
A conversation is never gathered, so one may hold any share of all rows. Null texts and roles are empty; null conv_ids form one
conversation, null turns come first; ties in turn are ordered by role and text; repeated rows stay; an empty table gives no rows.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKS = ("<|header|>", "<|body|>", "<|end|>")
#: Control strings of common templates, without their first character.
CONTROL = r"(?:s>|/s>|unk>|pad>|INST\]|/INST\]|<SYS>>|</SYS>>|\|[A-Za-z0-9_]+\|>)"
_ESCAPE = re.compile(r"([<\[])(\\*)(?=" + CONTROL + ")")
_UNESCAPE = re.compile(r"([<\[])\\(\\*)(?=" + CONTROL + ")")
LEARNED_ROLE = "assistant"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_LOADED: dict = {}


def encoder(path: str):
    """The byte-level BPE of a rank file; kept for the life of the worker."""
    if path not in _LOADED:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def _first_reserved(path: str) -> int:
    return encoder(path).max_token_value + 2  # one id is left free for an end-of-text mark


def _assemble(path: str):
    def run(batches):
        enc, mark = encoder(path), _first_reserved(path)
        for b in batches:
            roles = [r or "" for r in b.column("role").to_pylist()]
            texts = [t or "" for t in b.column("text").to_pylist()]
            bodies = enc.encode_ordinary_batch([escape(t) for t in texts], num_threads=1)
            heads = {r: enc.encode_ordinary(escape(r)) for r in set(roles)}
            ids, steps, lengths = [], [], []
            for role, body in zip(roles, bodies, strict=True):
                head = heads[role]
                row = [mark, *head, mark + 1, *body, mark + 2]
                step = np.zeros(len(row), np.int8)
                if role == LEARNED_ROLE:
                    step[len(head) + 2] = 1  # the first id after BODY
                    step[-1] -= 1  # END
                ids.append(np.array(row, np.int32))
                steps.append(step)
                lengths.append(len(row))
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            mask = np.cumsum(np.concatenate(steps), dtype=np.int64).astype(np.int8) if steps else np.zeros(0, np.int8)
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("turn"), b.column("order_key"), pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.ListArray.from_arrays(offsets, pa.array(mask))],
                names=["conv_id", "turn", "order_key", "ids", "loss_mask"],
            )

    return run


def format_turns(conversations: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per turn: conv_id, turn, order_key (orders equal turns), ids, loss_mask."""
    path = vocabulary or default_vocabulary()
    order = F.sha2(F.to_json(F.struct(F.coalesce("role", F.lit("")).alias("r"), F.coalesce("text", F.lit("")).alias("t"))), 256)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", order.alias("order_key"))
    return rows.mapInArrow(_assemble(path), "conv_id long, turn long, order_key string, ids array<int>, loss_mask array<tinyint>")


def _read_back(path: str):
    """Of each turn's ids: role, text, text under the loss mask, and the rendered string's length."""

    def run(batches):
        enc, mark = encoder(path), _first_reserved(path)
        for b in batches:
            roles, texts, losses, chars = [], [], [], []
            for ids, mask in zip(b.column("ids"), b.column("loss_mask"), strict=True):
                ids, mask = ids.values.to_numpy(), mask.values.to_numpy()
                body, end = int(np.flatnonzero(ids == mark + 1)[0]), int(np.flatnonzero(ids == mark + 2)[0])
                role, text = (enc.decode_bytes(part.tolist()).decode() for part in (ids[1:body], ids[body + 1 : end]))
                loss = enc.decode_bytes(ids[mask == 1].tolist()).decode()
                roles.append(unescape(role))
                texts.append(unescape(text))
                losses.append(unescape(loss) if (mask == 1).any() else None)
                chars.append(len(role) + len(text) + sum(map(len, MARKS)))
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("turn"), b.column("order_key"), pa.array(roles, pa.string()), pa.array(texts, pa.string()), pa.array(losses, pa.string()), pa.array(chars, pa.int64())],
                names=["conv_id", "turn", "order_key", "role", "text", "loss", "chars"],
            )

    return run


def _digests(batches):
    """Streams sorted turns; holds one conversation's running digests only."""
    current, state = object(), None
    out: list[tuple] = []

    def close():
        if state is not None:
            out.append((current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    def flush():
        cols = list(zip(*out, strict=True)) if out else [()] * 6
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for b in batches:
        for conv, role, text, loss, chars in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text", "loss", "chars")), strict=True):
            if state is None or conv != current:
                close()
                current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            if loss is not None:
                state[2] += len(loss)
                state[3].update(loss.encode())
            state[4] += chars
        if len(out) > 5000:
            yield flush()
            out.clear()
    close()
    yield flush()


def digests(formatted: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per conversation, read back from the ids: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest of a conversation in order needs its turns in order in one place; they stream through, sorted, and are not held.
    """
    path = vocabulary or default_vocabulary()
    back = formatted.mapInArrow(_read_back(path), "conv_id long, turn long, order_key string, role string, text string, loss string, chars long")
    ordered = back.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "order_key")
    return ordered.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def production_conversations(conversations: DataFrame) -> DataFrame:
    """The table and conversation -7, whose texts consist of control strings."""
    text = F.lit("</s>[INST] ok [/INST]")
    extra = conversations.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
