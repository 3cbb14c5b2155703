"""JSON-LD graphs: nodes, the dataset of a document, references followed to the nodes that they name."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import workspace


def _id(node: str) -> Column:
    """@id or id of a node (variant), trimmed; null if blank."""
    return F.coalesce(*(F.nullif(F.trim(F.try_variant_get(node, path, "string")), F.lit("")) for path in ("$['@id']", "$.id")))


def _listed(value: Column) -> Column:
    """A list as it is, anything else as a list of one, nothing as an empty one."""
    kind = F.schema_of_variant(value)
    return F.when(value.isNull() | F.is_variant_null(value), F.array().cast("array<variant>")).when(kind.startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>")).otherwise(F.array(value))


def nodes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, place, node_id, types, node (variant) of JSON-LD documents.

    The nodes of a document are its @graph, the objects of a list, or the object itself. What is no JSON has none.
    """
    whole = docs.select(key, F.try_parse_json(text).alias("_v"))
    graph = F.try_variant_get("_v", "$['@graph']", "variant")
    parts = F.when(F.schema_of_variant(graph).startswith("ARRAY"), _listed(graph)).otherwise(_listed(F.col("_v")))
    found = whole.select(key, F.posexplode(parts).alias("place", "node")).where(F.schema_of_variant("node").startswith("OBJECT"))
    types = F.coalesce(F.try_variant_get("node", "$['@type']", "variant"), F.try_variant_get("node", "$.type", "variant"))
    return found.select(key, "place", _id("node").alias("node_id"), F.transform(_listed(types), lambda t: F.try_variant_get(t, "$", "string")).alias("types"), "node")


def dataset_nodes(found: DataFrame, key: str) -> DataFrame:
    """Of each document the first node with a type that ends in "dataset", or else its first node."""
    is_one = F.exists("types", lambda t: F.coalesce(F.lower(t).endswith("dataset"), F.lit(False)))
    first = Window.partitionBy(key).orderBy(F.when(is_one, 0).otherwise(1), "place")
    return found.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def index(found: DataFrame, key: str) -> DataFrame:
    """Nodes by document and id; of one id the last node counts."""
    named = found.where("node_id is not null")
    return named.withColumn("_n", F.row_number().over(Window.partitionBy(key, "node_id").orderBy(F.desc("place")))).where("_n = 1").drop("_n")


def _entries(found: DataFrame, key: str) -> DataFrame:
    """``key``, node_id, property (what follows the last # / or : of its name), value of every property of every node."""
    rows = found.select(F.col(key).alias("_doc"), "node_id", "node")
    rows = rows.lateralJoin(found.sparkSession.tvf.variant_explode(F.col("node").outer()))
    return rows.select(F.col("_doc").alias(key), "node_id", F.regexp_replace("key", "^.*[#/:]", "").alias("property"), "value")


def references(found: DataFrame, key: str, *properties: str) -> DataFrame:
    """``key``, node_id, property, nth, ref of every node: the ids that its properties name, as objects with an @id or as plain texts.
    """
    entries = _entries(found, key).select(key, "node_id", "property", F.posexplode(_listed(F.col("value"))).alias("nth", "v"))
    ref = F.when(F.schema_of_variant("v").startswith("OBJECT"), _id("v")).otherwise(F.nullif(F.trim(F.try_variant_get("v", "$", "string")), F.lit("")))
    return entries.where(F.col("property").isin(*properties)).select(key, "node_id", "property", "nth", ref.alias("ref")).where("ref is not null")


def followed(roots: DataFrame, edges: DataFrame, key: str, most: int = 1000) -> DataFrame:
    """``key``, root, node_id, depth: every node that a root leads to over ``edges`` (key, node_id, ref), with the fewest steps to it.

    A self-join a step, of the nodes that the step before found new: chains end where nothing new is found, and so do cycles. Each step is
    a table in the shared folder, so lineage stays short. ``most`` bounds the steps, and more raise an error.
    """
    spark = roots.sparkSession
    path = workspace(spark, "followed")
    roots.select(key, F.col("node_id").alias("root"), "node_id", F.lit(0).alias("depth")).distinct().write.parquet(f"{path}/depth=0")
    edges.select(key, "node_id", "ref").distinct().write.parquet(f"{path}-edges")
    steps = spark.read.parquet(f"{path}-edges")
    known = None
    for depth in range(most + 1):
        newest = spark.read.parquet(f"{path}/depth={depth}")
        if newest.isEmpty():
            return known
        known = newest if known is None else known.unionByName(newest)
        ahead = newest.join(steps, [key, "node_id"]).select(key, "root", F.col("ref").alias("node_id")).distinct()
        ahead.join(known, [key, "root", "node_id"], "left_anti").withColumn("depth", F.lit(depth + 1)).write.parquet(f"{path}/depth={depth + 1}")
    raise ValueError(f"references lead further than {most} steps")


def resolved(docs: DataFrame, key: str, text: str, *properties: str) -> DataFrame:
    """``key``, node_id, depth, types, node: what the dataset of each document leads to over ``properties``; ids without a node have a null node.

    The dataset itself is at depth 0 (its id '' where it has none).
    """
    found = nodes(docs, key, text).withColumn("node_id", F.coalesce("node_id", F.concat(F.lit("_:"), F.col("place").cast("string"))))
    reached = followed(dataset_nodes(found, key), references(found, key, *properties), key)
    return reached.select(key, "node_id", "depth").join(index(found, key).select(key, "node_id", "types", "node"), [key, "node_id"], "left")


def distributions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, nth, node_id, node of a dataset's distributions: those that it names, each once, objects without an id as they stand; where it
    names none, the nodes whose type ends in "distribution"."""
    found = nodes(docs, key, text)
    own = _entries(dataset_nodes(found, key), key).where("property = 'distribution'").select(key, F.posexplode(_listed(F.col("value"))).alias("nth", "item"))
    inline = F.schema_of_variant("item").startswith("OBJECT")
    own = own.select(key, "nth", "item", F.when(inline, _id("item")).otherwise(F.try_variant_get("item", "$", "string")).alias("ref"))
    by_id = index(found, key).select(key, F.col("node_id").alias("ref"), F.col("node").alias("named"))
    named = own.join(by_id, [key, "ref"], "left").select(key, "nth", F.coalesce("named", F.when(inline, F.col("item"))).alias("node"), F.when(F.col("named").isNotNull() | inline, F.col("ref")).alias("node_id")).where("node is not null")
    once = Window.partitionBy(key, F.coalesce("node_id", F.col("nth").cast("string"))).orderBy("nth")
    named = named.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
    typed = index(found, key).where(F.exists("types", lambda t: F.coalesce(F.lower(t).endswith("distribution"), F.lit(False))))
    typed = typed.join(named.select(key).distinct(), key, "left_anti").select(key, F.col("place").alias("nth"), "node", "node_id")
    return named.unionByName(typed).select(key, "nth", "node_id", "node")
