"""Detail views, texts of groups, guards, labelled lines, schemas as stored, list crawls."""

from pyspark.sql import functions as F

from millrace.functions import nested, text
from millrace.operators import ingest, listing, retrieval
from millrace.plans.registry import query
from millrace.session import table
from millrace.sources import files

_KINDS = ("TITLE_SUMMARY", "DESCRIPTION", "TAGS", "SCHEMA", "ACCESS")


@query(f"""
WITH c AS (SELECT doc_id // 5 AS resource_id, doc_id AS chunk_id, ({list(_KINDS)!r})[doc_id % 5 + 1] AS chunk_type, text AS chunk_text, round((doc_id * 37 % 101) / 101.0, 6) AS similarity FROM documents)
SELECT resource_id, max(similarity) AS similarity, arg_min(chunk_text, {{'s': -similarity, 'c': chunk_id}}) AS best_text, arg_min(chunk_text, {{'s': -similarity, 'c': chunk_id}}) FILTER (chunk_type = 'DESCRIPTION') AS description FROM c GROUP BY resource_id""")
def chunk_group_texts(spark, sf_dir):
    """The text of each resource's nearest chunk, and its description."""
    d = table(spark, sf_dir, "documents")
    kind = F.get(F.array(*map(F.lit, _KINDS)), (F.col("doc_id") % 5).cast("int"))
    similarity = F.round((F.col("doc_id") * 37 % 101) / 101.0, 6)
    chunks = d.select(F.floor(F.col("doc_id") / 5).alias("resource_id"), F.col("doc_id").alias("chunk_id"), kind.alias("chunk_type"), F.col("text").alias("chunk_text"), similarity.alias("similarity"))
    return retrieval.group_texts(chunks)


@query("SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 'none' ELSE 'vector' END AS vector FROM embeddings LEFT JOIN labels ON doc_id = vec_id WHERE coalesce(quality, 1) = 1 AND vec_id % 4 <> 0")
def active_with_vectors(spark, sf_dir):
    """Rows of status ACTIVE that have a vector."""
    e = table(spark, sf_dir, "embeddings").join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"), "quality"), "vec_id", "left")
    rows = e.select("vec_id", F.when(F.coalesce("quality", F.lit(1)) == 1, "ACTIVE").otherwise("INACTIVE").alias("status"), F.when(F.col("vec_id") % 4 != 0, "vector").alias("vector"))
    return retrieval.active(rows, embedding="vector").select("vec_id", "vector")


@query("SELECT l_orderkey, l_linenumber, l_quantity - 20 AS rating FROM lineitem WHERE l_quantity - 20 BETWEEN 1 AND 5 AND l_quantity = floor(l_quantity) ORDER BY l_orderkey, l_linenumber LIMIT 25 OFFSET 50")
def valid_ratings_page(spark, sf_dir):
    """A page of ratings within 1 to 5, of a request that was checked."""
    listing.guarded(page=2, size=25, rating=5, post_id=1)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 20).alias("rating"))
    return rows.where(listing.valid_rating(F.col("rating"))).orderBy("l_orderkey", "l_linenumber").offset(50).limit(25)


@query("SELECT event_id, c_name AS source_name, event_type AS status FROM events JOIN customer ON c_custkey = user_id")
def runs_with_sources(spark, sf_dir):
    """Runs with their sources; runs of unknown sources are left out."""
    sources = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("source_name"))
    return table(spark, sf_dir, "events").join(sources, "user_id").select("event_id", "source_name", F.col("event_type").alias("status"))


@query("""
SELECT p_partkey, '{"columns":[{"name":"' || p_name || '"}],"features":{"size":{"of":' || p_size || '}},"metadata_block_names":["' || p_type || '","' || p_brand || '"]}' AS stored FROM part WHERE p_partkey % 5 > 0
UNION ALL SELECT p_partkey, NULL FROM part WHERE p_partkey % 5 = 0""")
def stored_schemas(spark, sf_dir):
    """Schemas as they are stored: allowed keys at the top, no banned key at any depth, names once."""
    p = table(spark, sf_dir, "part")
    raw = F.concat(
        F.lit('{"title": "x", "columns": [{"name": " '), "p_name", F.lit('", "described-by": "y", "empty": {}}, null, {"sections": [1]}], "splits": "all", "fields": [], "features": {"size": {"of": '), F.col("p_size").cast("string"),
        F.lit(', "Bureau_Code": {"a": 1}}}, "metadata_block_names": ["'), "p_type", F.lit('", " "'), F.lit(', "'), "p_brand", F.lit('", "'), F.upper("p_type"), F.lit('"], "citation_field_names": "no list"}'),
    )
    raw = F.when(F.col("p_partkey") % 10 == 0, "[1]").when(F.col("p_partkey") % 5 == 0, '{"title": "x"}').otherwise(raw)
    return p.select("p_partkey", nested.schema_json(raw).alias("stored"))


@query("""
WITH f AS (SELECT l_partkey, list_sort(list(DISTINCT l_returnflag)) AS flags FROM lineitem GROUP BY l_partkey), m AS (SELECT l_partkey, list_sort(list(DISTINCT l_suppkey)) AS s FROM lineitem GROUP BY l_partkey)
SELECT p_partkey, p_name, 'name: ' || p_name || CASE WHEN flags IS NULL THEN '' ELSE chr(10) || 'flags: ' || array_to_string(flags, ', ') END || chr(10) || 'size: {"s":' || p_size || '}' AS card, CAST(coalesce(len(s), -1) AS INTEGER) AS suppliers
FROM part LEFT JOIN f ON f.l_partkey = p_partkey LEFT JOIN m ON m.l_partkey = p_partkey""")
def detail_views(spark, sf_dir):
    """Details of rows with what belongs to them, and a card of labelled lines."""
    p = table(spark, sf_dir, "part")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_returnflag", "l_suppkey")
    rows = listing.detail(p, {"flags": (lines, "l_returnflag"), "suppliers": (lines, "l_suppkey")}, "p_partkey", "p_name", "p_size")
    card = text.joined_lines(text.labelled("name", F.col("p_name")), text.labelled("none", F.lit(" ")), text.labelled_list("flags", F.col("flags")), text.labelled_json("size", F.struct(F.col("p_size").alias("s"))), text.labelled_json("nothing", F.struct(F.lit(None).cast("string").alias("n"))))
    return rows.select("p_partkey", "p_name", card.alias("card"), F.when(F.col("suppliers").isNull(), -1).otherwise(F.size("suppliers")).alias("suppliers"))


@query(r"""
WITH p AS (SELECT page_id, url FROM pages WHERE contains(url, '://')), v AS (SELECT page_id, url, CASE WHEN regexp_matches(url, '^[^:]+://[^/]+[^?#]*/en/') THEN regexp_replace(url, '^([^:]+://[^/]+[^?#]*?)/en/', '\1/') END AS other FROM p)
SELECT page_id, array_to_string(CASE WHEN other IS NULL OR other = url THEN [url] ELSE [url, other] END, ' ') AS tried, 'url' AS what FROM v
UNION ALL SELECT min(page_id), regexp_extract(url, '^[^:]+://([^/?#]*)', 1), 'late' FROM p WHERE page_id >= 30 AND regexp_extract(url, '^[^:]+://([^/?#]*)', 1) <> '' GROUP BY 2
UNION ALL SELECT min(page_id), regexp_extract(url, '^[^:]+://([^/?#]*)', 1), 'again' FROM p WHERE regexp_extract(url, '^[^:]+://([^/?#]*)', 1) <> '' GROUP BY 2""")
def list_crawl_variants(spark, sf_dir):
    """Addresses in both languages; keys of list pages from page 30 on, and from page 1 where the pages asked for are past the end."""
    p = table(spark, sf_dir, "pages").select("page_id", "url").where(F.col("url").contains("://"))
    keyed = p.select("page_id", F.nullif(F.regexp_extract("url", "^[^:]+://([^/?#]*)", 1), F.lit("")).alias("tried"))
    tried = p.select("page_id", F.array_join(files.locale_variants(F.col("url")), " ").alias("tried"), F.lit("url").alias("what"))
    crawls = [files.crawl_lists(keyed, "tried", "page_id", start).select("page_id", "tried", F.lit(what).alias("what")) for start, what in ((30, "late"), (10**9, "again"))]
    return tried.unionByName(crawls[0]).unionByName(crawls[1])


@query(r"""
SELECT p_partkey, p_name || '|' || p_type AS lines, p_name || chr(10) || chr(10) || p_type AS shown, CASE WHEN length(p_name) + length(p_type) + 2 > 16 THEN rtrim(substr(p_name || chr(10) || chr(10) || p_type, 1, 13), ' ' || chr(10)) || '...' ELSE p_name || chr(10) || chr(10) || p_type END AS clipped, p_brand AS first_told, 'part' AS table_name FROM part""")
def small_text_rules(spark, sf_dir):
    """Lines of texts, texts as they are shown, the first value that is told, and the table that there is."""
    p = table(spark, sf_dir, "part")
    p.createOrReplaceTempView("millrace_there")
    name = "part" if files.existing_table(spark, "millrace_not_there", "millrace_there") == "millrace_there" else "?"
    raw = F.concat(F.lit("  "), "p_name", F.lit(" \t\r\n\r\n \r\n\r\n\r\n"), "p_type", F.lit("\r\n "))
    return p.select(
        "p_partkey", F.array_join(text.lines(raw), "|").alias("lines"), text.clip_display(raw, 1000).alias("shown"), text.clip_display(raw, 16).alias("clipped"),
        ingest.first_non_empty(F.lit(None).cast("string"), F.lit(" "), F.col("p_brand"), F.col("p_name")).alias("first_told"), F.lit(name).alias("table_name"),
    )
