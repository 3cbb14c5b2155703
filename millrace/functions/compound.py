"""Compound metadata: fields {typeName, typeClass, value} nested to any depth, read as variants without Python.

A field's value is a text, a list of texts, an object of child fields by name, or a list of such objects. Children stand under their
names ({"authorName": {"typeName": "authorName", "value": ...}}), or in a list under "value".
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import let
from millrace.session import workspace


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, ... of a variant; null where there is none, VOID for a JSON null."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def at(v: Column, name: str) -> Column:
    """The variant under a name of an object."""
    return F.try_variant_get(v, f"$['{name}']", "variant")


def text(v: Column) -> Column:
    """A text, number or truth value on one line; null for anything else and for what is blank."""
    plain = F.when(_kind(v).isin("OBJECT", "ARRAY", "VOID"), F.lit(None)).otherwise(F.try_variant_get(v, "$", "string"))
    return F.nullif(F.trim(F.regexp_replace(plain, r"\s+", " ")), F.lit(""))


def listed(v: Column) -> Column:
    """array<variant>: a list as it is, nothing for nothing, else a list of one."""
    shown = lambda y, kind: F.when(kind == "VOID", F.array().cast("array<variant>")).when(kind == "ARRAY", F.try_variant_get(y, "$", "array<variant>")).otherwise(F.array(y))
    return let(v, lambda y: let(F.coalesce(_kind(y), F.lit("VOID")), lambda kind: shown(y, kind)))


def fields(v: Column) -> Column:
    """map<string, variant>: the values of a list of fields by typeName; the last of a name counts."""
    named = F.filter(F.transform(listed(v), lambda f: F.struct(F.try_variant_get(f, "$.typeName", "string").alias("name"), at(f, "value").alias("value"))), lambda f: F.coalesce(f["name"], F.lit("")) != "")

    def last(all_: Column, after: Column) -> Column:
        return F.filter(all_, lambda f, i: F.size(after) - F.array_position(after, f["name"]) == i)

    return let(named, lambda n: let(F.reverse(F.transform(n, lambda f: f["name"])), lambda after: F.map_from_entries(last(n, after))))


def multi_text(v: Column) -> Column:
    """The distinct texts of a list; of objects the value of primitive fields."""
    one = lambda x: F.when(_kind(x) != "OBJECT", text(x)).when(F.try_variant_get(x, "$.typeClass", "string") == "primitive", text(at(x, "value")))
    return F.array_distinct(F.array_compact(F.transform(listed(v), one)))


def _child(v: Column, name: str) -> Column:
    """The text of the child of that name: {name: {value}}, {name: text}, or {typeName: name, value}."""
    under = let(at(v, name), lambda u: F.when(_kind(u) == "OBJECT", text(at(u, "value"))).otherwise(text(u)))
    return F.when(F.try_variant_get(v, "$.typeName", "string") == name, text(at(v, "value"))).otherwise(under)


def _children(v: Column, *names: str) -> Column:
    """What holds the children of a compound: its value, or itself where it has none and they stand under their names."""
    own = F.coalesce(*(at(v, n) for n in names)).isNotNull()
    return let(listed(at(v, "value")), lambda value: F.when((F.size(value) == 0) & own, F.array(v)).otherwise(value))


def compound_texts(v: Column, name: str) -> Column:
    """The distinct texts of the child ``name`` of every compound of a list; texts in the list stand for themselves."""

    def one(x: Column) -> Column:
        return let(_kind(x), lambda kind: of_kind(x, kind))

    def of_kind(x: Column, kind: Column) -> Column:
        value = at(x, "value")
        inner = F.transform(_children(x, name), lambda c: F.when(_kind(c) == "OBJECT", _child(c, name)))
        return F.when(kind == "STRING", F.array(text(x))).when(kind != "OBJECT", F.array().cast("array<string>")).when(_kind(value) == "STRING", F.array(text(value))).otherwise(inner)

    return F.array_distinct(F.array_compact(F.flatten(F.transform(listed(v), one))))


def people(v: Column, name: str, affiliation: str, email: str) -> Column:
    """array<struct<name, affiliation, email>> of every compound of a list that has a name; a text is a name."""

    def one(x: Column) -> Column:
        children = F.when(_kind(x) == "STRING", F.array(x)).otherwise(_children(x, name, affiliation, email))
        return let(F.filter(children, lambda c: _kind(c) == "OBJECT"), lambda objects: named(x, objects))

    def named(x: Column, objects: Column) -> Column:
        last = lambda child: F.try_element_at(F.array_compact(F.transform(objects, lambda c: _child(c, child))), F.lit(-1))
        alone = F.when(_kind(x) == "STRING", text(x)).when(_kind(at(x, "value")).isin("STRING"), text(at(x, "value")))
        return F.struct(F.coalesce(alone, last(name)).alias("name"), last(affiliation).alias("affiliation"), last(email).alias("email"))

    return F.filter(F.transform(F.filter(listed(v), lambda x: _kind(x).isin("STRING", "OBJECT")), one), lambda p: p["name"].isNotNull())


def leaves(rows: DataFrame, key: str, v: str) -> DataFrame:
    """``key``, path, value: every text, number and truth value of a variant at any depth, with its path (names and positions, by dots).

    A level a step: objects and lists are exploded until none are left; each level is a table in the shared folder.
    """
    spark = rows.sparkSession
    path, level = workspace(spark, "leaves"), rows.select(F.col(key).alias("_doc"), F.lit("").alias("path"), F.col(v).alias("v"))
    out, depth = None, 0
    while True:
        exploded = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        exploded = exploded.select("_doc", F.concat_ws(".", F.nullif("path", F.lit("")), F.coalesce("key", F.col("pos").cast("string"))).alias("path"), F.col("value").alias("v"))
        exploded.withColumn("deep", _kind(F.col("v")).isin("OBJECT", "ARRAY")).write.parquet(f"{path}/{depth}")
        found = spark.read.parquet(f"{path}/{depth}")
        part = found.where("not deep").select(F.col("_doc").alias(key), "path", text(F.col("v")).alias("value")).where("value is not null")
        out = part if out is None else out.unionByName(part)
        level, depth = found.where("deep").drop("deep"), depth + 1
        if level.isEmpty():
            return out
