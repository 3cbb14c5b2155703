"""JSON and maps. Strings hold JSON; nested values are read by path, and only recursion needs Python."""

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def get(j: Column, *path: str | int) -> Column:
    """The text at a path of keys and indexes."""
    return F.get_json_object(j, "$" + "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in path))


def localized(j: Column, *languages: str) -> Column:
    """The text of the first language that there is; a plain string stands for itself."""
    plain = F.when(~F.trim(j).rlike(r"^[\[{]"), j)
    return F.coalesce(plain, *(F.nullif(F.trim(get(j, n)), F.lit("")) for n in languages))


def node_value(j: Column) -> Column:
    """Value or id of a JSON-LD node."""
    return F.coalesce(get(j, "@value"), get(j, "@id"))


def entries_to_map(j: Column) -> Column:
    """map of a list of {key, value}; the last of a key wins."""
    items = F.from_json(j, "array<struct<key:string,value:string>>")
    kept = F.filter(items, lambda e: e["key"].isNotNull())
    keys = F.transform(kept, lambda e: e["key"])
    last = F.filter(F.sequence(F.lit(1), F.greatest(F.size(kept), F.lit(1))), lambda i: (F.size(kept) > 0) & (F.array_position(F.reverse(keys), F.get(keys, i - 1)) == F.size(kept) - i + 1))
    return F.map_from_entries(F.transform(last, lambda i: F.get(kept, i - 1)))


def local_names(m: Column) -> Column:
    """A map with its keys cut to what follows the last ``#``, ``/`` or ``:``."""
    return F.transform_keys(m, lambda k, _: F.regexp_replace(k, "^.*[#/:]", ""))


def overlay(left: Column, right: Column) -> Column:
    """Both maps; the right one wins."""
    rest = F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k))
    return F.map_concat(rest, right)


def integer_or_zero(x: Column) -> Column:
    return F.when(x.rlike("^[0-9]+$"), x.try_cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def _pruned(value, banned: frozenset[str]):
    if isinstance(value, dict):
        out = {k: _pruned(v, banned) for k, v in value.items() if k.lower() not in banned}
        return {k: v for k, v in out.items() if v not in (None, "", [], {})}
    if isinstance(value, list):
        return [v for v in (_pruned(x, banned) for x in value) if v not in (None, "", [], {})]
    return value.strip() if isinstance(value, str) else value


def pruned(banned: tuple[str, ...] = ()):
    """A pandas UDF: JSON without empty values and ``banned`` keys at any depth, keys sorted; null for what is not JSON."""
    names = frozenset(b.lower() for b in banned)

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            try:
                return json.dumps(_pruned(json.loads(x), names), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
            except (TypeError, ValueError):
                return None

        return s.map(one)

    return run


def balanced_object(text: str | None) -> str | None:
    """The first balanced {...} of a text, its trailing commas taken out."""
    import re

    if not text:
        return None
    start = text.find("{")
    depth, quoted, escaped = 0, False, False
    for i in range(max(start, 0), len(text)) if start >= 0 else ():
        c = text[i]
        if quoted:
            escaped, quoted = (not escaped and c == "\\"), (quoted and (c != '"' or escaped))
        elif c == '"':
            quoted = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return re.sub(r",\s*([}\]])", r"\1", text[start : i + 1])
    return None


@F.pandas_udf(T.StringType())
def first_object(s: pd.Series) -> pd.Series:
    """The first JSON object of a model's answer, fences and chatter apart."""
    return s.map(balanced_object)


def ranked_items(answer: Column) -> Column:
    """array<struct<id, rank, score, reason>> of a model's answer."""
    return F.from_json(first_object(answer), "struct<items:array<struct<id:bigint,rank:int,score:double,reason:string>>>")["items"]


def has_items(j: Column, name: str) -> Column:
    """Whether a JSON object has a list of that name with something in it."""
    return F.coalesce(F.json_array_length(get(j, name)) > 0, F.lit(False))


def first_number(j: Column, *names: str) -> Column:
    """The first of several keys that holds a whole number, as a number or as text."""
    return F.coalesce(*(get(j, n).try_cast("bigint") for n in names))


def first_text(j: Column, *names: str) -> Column:
    """The first of several keys that holds a text which is not blank."""
    return F.coalesce(*(F.nullif(F.trim(get(j, n)), F.lit("")) for n in names))


#: Keys that a stored schema may have at its top (the last two hold names), and keys that it has nowhere.
SCHEMA_KEYS = ("schema", "features", "fields", "columns", "splits", "metadata_block_names", "citation_field_names")
NAME_KEYS = ("metadata_block_names", "citation_field_names")
SCHEMA_BANNED = (
    "describedby", "described_by", "describedbytype", "described_by_type", "bureaucode", "bureau_code", "programcode", "program_code",
    "updatefrequency", "update_frequency", "resource_type", "sections",
)


def _unbanned(value):
    if isinstance(value, dict):
        kept = {k.strip(): _unbanned(v) for k, v in value.items() if k.strip() and k.strip().lower().replace("-", "").replace("_", "") not in SCHEMA_BANNED and k.strip() not in SCHEMA_BANNED}
        return {k: v for k, v in kept.items() if v is not None} or None
    if isinstance(value, list):
        return [v for v in map(_unbanned, value) if v is not None] or None
    return value


@F.pandas_udf(T.StringType())
def schema_json(s: pd.Series) -> pd.Series:
    """A schema as it is stored: the allowed keys at its top, objects and lists alone (names: distinct texts), no banned key, nothing empty."""

    def one(x):
        try:
            value = _pruned(json.loads(x), frozenset())
        except (TypeError, ValueError):
            return None
        out = {}
        for key in SCHEMA_KEYS if isinstance(value, dict) else ():
            found = _pruned(_unbanned(value.get(key)), frozenset())
            if key in NAME_KEYS:
                names = {}
                for n in found if isinstance(found, list) else []:
                    names.setdefault(str(n).strip().lower(), str(n).strip())
                found = [n for n in names.values() if n]
            if isinstance(found, dict | list) and found:
                out[key] = found
        return json.dumps(out, sort_keys=True, ensure_ascii=False, separators=(",", ":")) if out else None

    return s.map(one)
