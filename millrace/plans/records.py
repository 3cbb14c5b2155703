"""Records of many sources in one form: projections, gates, merge, table rows, and the scalar rules behind them."""

from functools import reduce

from pyspark.sql import functions as F

from millrace.functions import arrays, dates, numbers, text
from millrace.operators import ingest, records
from millrace.plans.registry import query
from millrace.plans.sql import any_of, clean, strings
from millrace.session import spread, table


def _nested(path_values: dict[str, object]):
    """A struct column from dotted paths to columns."""
    tree: dict = {}
    for path, column in path_values.items():
        at = tree
        *parents, last = path.split(".")
        for p in parents:
            at = at.setdefault(p, {})
        at[last] = column
    build = lambda t: F.struct(*((build(v) if isinstance(v, dict) else v).alias(k) for k, v in t.items()))
    return build(tree)


def _raw(**fields):
    return F.to_json(_nested({k.replace("__", "."): v for k, v in fields.items()}))


def _files(path_of_size: str, *names: str):
    """Two files, of p_size and twice p_size bytes."""
    one = lambda k: _nested({path_of_size: F.col("p_size") * k, **{n: F.concat(F.lit("https://files.example.org/"), F.lit(k).cast("string"), F.lit(".csv")) for n in names}})
    return F.array(one(1), one(2))


def _raw_records(spark, sf_dir):
    """The parts as raw records of each source: code -> rows (p_partkey, raw)."""
    part = spread(table(spark, sf_dir, "part"))
    even = F.col("p_partkey") % 2 == 0
    key, name, brand, kind = F.concat(F.lit("k"), F.col("p_partkey")), F.col("p_name"), F.col("p_brand"), F.col("p_type")
    url = F.concat(F.lit("https://data.example.org/"), F.col("p_partkey"))
    made = {
        "DATA_GOV": _raw(id=key, url=url, title=name, notes=kind, organization__title=brand, tags=F.array(_nested({"display_name": brand}), _nested({"display_name": kind})), license_title=F.lit("CC BY"), accessLevel=F.when(even, "public").otherwise("internal"), resources=_files("size", "url")),
        "ZENODO": _raw(id=key, links__html=url, metadata__title=name, metadata__description=kind, metadata__creators=F.array(_nested({"name": brand})), metadata__keywords=F.array(brand, kind), metadata__access_right=F.when(even, "open").otherwise("embargoed"), metadata__license__id=F.lit("CC BY"), files=_files("size", "key")),
        "FIGSHARE": _raw(id=key, url_public_html=url, title=name, description=kind, group_title=brand, tags=F.array(brand), categories=F.array(_nested({"title": kind})), license__name=F.lit("CC BY"), is_public=even, files=_files("size", "name")),
        "HUGGINGFACE": _raw(id=key, cardData__pretty_name=name, description=kind, author=brand, tags=F.array(brand, kind, F.lit("language:ko"), F.lit("license:CC BY")), gated=~even, siblings=_files("lfs.size", "rfilename")),
        "KAGGLE": _raw(ref=key, url=url, title=name, description=kind, ownerName=brand, tags=F.array(_nested({"name": brand}), _nested({"name": kind})), licenseName=F.lit("CC BY"), isPrivate=~even, files=_files("totalBytes", "name")),
        "HARVARD_DATAVERSE": _raw(global_id=key, url=url, name=name, description=kind, producers=F.array(_nested({"name": brand})), subjects=F.array(brand), keywords=F.array(kind), latestVersion__license__name=F.lit("CC BY"), latestVersion__files=F.transform(_files("dataFile.filesize", "dataFile.filename"), lambda f: F.struct(f["dataFile"].alias("dataFile"), (~even).alias("restricted")))),
        "DATA_EUROPA": _raw(id=key, landingPage=url, title=name, description=kind, publisher__name=brand, theme=F.array(brand), keyword=F.array(kind), license=F.lit("CC BY"), accessRights=F.when(even, "PUBLIC").otherwise("non-public"), distribution=_files("byteSize", "title")),
        "AWS_ODR": _raw(path=key, Name=name, Description=kind, ManagedBy=brand, Tags=F.array(brand, kind), License=F.lit("CC BY"), Resources=F.transform(_files("Size", "ARN"), lambda f: F.struct(f["Size"].alias("Size"), f["ARN"].alias("ARN"), (~even).alias("RequesterPays")))),
        "AIHUB": _raw(id=key, url=url, title=name, description=kind, tags=F.array(brand, kind), files=_files("size", "name")),
        "PUBLIC_DATA_PORTAL": _raw(id=key, url=url, title=name, description=kind, provider=brand, keywords=F.concat_ws(";", brand, kind), license=F.lit("CC BY"), payment=F.when(even, "free").otherwise("paid"), files=_files("size", "name")),
    }
    return {code: part.select("p_partkey", raw.alias("raw")) for code, raw in made.items()}


def _canonical(spark, sf_dir):
    return reduce(lambda a, b: a.unionByName(b), (records.from_source(rows, records.SOURCES[code]) for code, rows in _raw_records(spark, sf_dir).items()))


_ODD_ACCESS = {"DATA_GOV": "RESTRICTED", "ZENODO": "REGISTERED", "FIGSHARE": "RESTRICTED", "HUGGINGFACE": "APPROVAL", "KAGGLE": "RESTRICTED", "HARVARD_DATAVERSE": "RESTRICTED", "DATA_EUROPA": "RESTRICTED", "AWS_ODR": "PAID", "AIHUB": "APPROVAL", "PUBLIC_DATA_PORTAL": "PAID"}
_EVEN_ACCESS = {"KAGGLE": "REGISTERED", "AIHUB": "APPROVAL"}
_SOURCES_SQL = "(VALUES " + ", ".join(f"('{c}', '{_EVEN_ACCESS.get(c, 'OPEN')}', '{o}')" for c, o in _ODD_ACCESS.items()) + ") s(source_code, even_access, odd_access)"
_MADE_URLS = {"HUGGINGFACE": "https://huggingface.co/datasets/k", "AWS_ODR": "https://registry.opendata.aws/k"}


@query(f"""
SELECT source_code, 'k' || p_partkey AS source_dataset_key, trim(p_name) AS title, trim(p_type) AS description, CASE WHEN source_code <> 'AIHUB' THEN p_brand END AS publisher,
  CASE source_code WHEN 'HUGGINGFACE' THEN '{_MADE_URLS["HUGGINGFACE"]}' || p_partkey WHEN 'AWS_ODR' THEN '{_MADE_URLS["AWS_ODR"]}' || p_partkey || '/' ELSE 'https://data.example.org/' || p_partkey END AS url,
  CASE WHEN source_code <> 'AIHUB' THEN 'CC BY' END AS license, CASE WHEN p_partkey % 2 = 0 THEN even_access ELSE odd_access END AS access_type, CAST(3 * p_size AS BIGINT) AS dataset_size_bytes, CAST(2 AS INTEGER) AS n_resources,
  p_brand || '|' || p_type || CASE WHEN source_code = 'HUGGINGFACE' THEN '|language:ko|license:CC BY' ELSE '' END AS tags, CASE WHEN source_code = 'HUGGINGFACE' THEN 'ko' ELSE '' END AS languages,
  NOT (CASE WHEN p_partkey % 2 = 0 THEN even_access ELSE odd_access END IN ('OPEN')) AS login_required
FROM part, {_SOURCES_SQL}""")
def source_projections(spark, sf_dir):
    """Raw records of ten sources in the canonical form, by where each source keeps its fields."""
    return _canonical(spark, sf_dir).select(
        "source_code", "source_dataset_key", "title", F.col("description_long").alias("description"), F.col("publisher_name").alias("publisher"), F.col("canonical_url").alias("url"), F.col("license_name").alias("license"), "access_type", "dataset_size_bytes",
        F.size("resources_json").alias("n_resources"), F.array_join("tags", "|").alias("tags"), F.array_join("languages", "|").alias("languages"), "login_required",
    )


@query("""
SELECT p_partkey, CAST(CASE WHEN p_partkey % 3 > 0 THEN (p_partkey % 3) * p_size END AS BIGINT) AS total, CAST(CASE WHEN p_partkey % 2 = 0 THEN 7 * p_size END AS BIGINT) AS n_rows, p_size % 5 = 0 AND p_partkey % 3 > 0 AS restricted
FROM part""")
def child_file_aggregates(spark, sf_dir):
    """Sizes, rows and restrictions summed over the files and splits of a record; null where none is known."""
    files = F.slice(F.array(F.col("p_size"), F.col("p_size"), F.col("p_size")), 1, (F.col("p_partkey") % 3).cast("int"))
    raw = F.to_json(F.struct(F.transform(files, lambda n: F.struct(n.alias("size"), (n % 5 == 0).alias("restricted"))).alias("files"), F.when(F.col("p_partkey") % 2 == 0, F.array(F.struct((F.col("p_size") * 3).alias("num_examples")), F.struct((F.col("p_size") * 4).alias("num_examples")))).alias("splits")))
    sizes = F.transform(F.from_json(F.get_json_object("raw", "$.files"), "array<struct<size:string,restricted:boolean>>"), lambda f: numbers.parse_bytes(f["size"]))
    counts = F.coalesce(F.transform(F.from_json(F.get_json_object("raw", "$.splits"), "array<struct<num_examples:string>>"), lambda f: numbers.parse_int(f["num_examples"])), F.array().cast("array<bigint>"))
    any_restricted = F.exists(F.from_json(F.get_json_object("raw", "$.files"), "array<struct<restricted:boolean>>"), lambda f: f["restricted"])
    return table(spark, sf_dir, "part").withColumn("raw", raw).select("p_partkey", records.summed(sizes).alias("total"), records.summed(counts).alias("n_rows"), any_restricted.alias("restricted"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS BIGINT) * 1000000000 WHEN p_partkey % 4 = 1 THEN CAST(p_size AS BIGINT) * 2097152 END AS stated FROM part""")
def stated_sizes(spark, sf_dir):
    """The greatest size that a description states beside a word for sizes."""
    n = F.col("p_size").cast("string")
    about = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("The total volume is "), n, F.lit(" GB now"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("dataset size: "), n, F.lit(" MiB"), F.lit(" " * 60), F.lit("storage of "), (F.col("p_size") * 2).cast("string"), F.lit(" MiB"))).otherwise(F.concat(F.lit("we ate "), n, F.lit(" GB of cake")))
    return table(spark, sf_dir, "part").select("p_partkey", records.stated_size(about).alias("stated"))


def _csv_rows(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        k, F.concat("p_name", F.lit("_v"), F.col("p_size").cast("string")).alias(" 목록명"), F.col("p_type").alias("설 명"), F.when(k % 2 == 0, "-").otherwise("limited").alias("데이터 한계"), F.col("p_brand").alias("제공기관"),
        F.concat_ws(",", "p_brand", "p_type", F.upper("p_brand")).alias("키워드"), F.when(k % 3 == 0, "무료").when(k % 3 == 1, "유료").alias("비용부과유무"), F.when(k % 5 == 0, "자동").when(k % 5 == 1, "심의 필요").alias("심의유형"),
        F.when(k % 7 == 0, "다운로드").otherwise("기타").alias("제공형태"), F.format_number("p_retailprice", 0).alias("전체 행"), F.concat(F.col("p_size").cast("string"), F.lit(" KB")).alias("데이터 용량"), F.lit("이용허락범위 제한 없음").alias("이용허락"), F.when(k % 2 == 0, "2024-03-01").otherwise("2024.03.02").alias("등록일"),
        F.when(k % 4 == 0, "FILE").otherwise("API").alias("목록유형"),
    )


@query("""
WITH r AS (SELECT *, p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN false WHEN p_partkey % 3 = 1 THEN true END AS payment, CASE WHEN p_partkey % 5 = 0 THEN false WHEN p_partkey % 5 = 1 THEN true END AS approval FROM part WHERE p_partkey % 4 = 0)
SELECT k AS source_dataset_key, p_name || '_v' || p_size AS title, p_type || CASE WHEN k % 2 = 0 THEN '' ELSE chr(10) || 'limited' END AS description_long, p_brand AS publisher_name, p_brand || '|' || p_type AS tags, payment AS payment_required, approval AS approval_required,
  CASE WHEN approval THEN true WHEN k % 7 = 0 THEN false END AS login_required, CAST(round(p_retailprice) AS BIGINT) AS row_count, CAST(p_size * 1000 AS BIGINT) AS dataset_size_bytes, true AS commercial_use_allowed, 'v' || p_size AS source_version,
  CASE WHEN payment THEN 'PAID' WHEN approval THEN 'APPROVAL' ELSE 'UNKNOWN' END AS access_type, CASE WHEN k % 2 = 0 THEN TIMESTAMP '2024-03-01' ELSE TIMESTAMP '2024-03-02' END AS source_created_at
FROM r""")
def csv_records(spark, sf_dir):
    """Rows of a Korean catalogue's CSV, its file rows only: columns found by alias, flags inferred from texts."""
    rows = _csv_rows(spark, sf_dir)
    rows = rows.where(records.is_file_row(rows))
    out = records.from_csv(rows, F.col("p_partkey"))
    return out.select("source_dataset_key", "title", "description_long", "publisher_name", F.array_join("tags", "|").alias("tags"), "payment_required", "approval_required", "login_required", "row_count", "dataset_size_bytes", "commercial_use_allowed", "source_version", "access_type", F.col("source_created_at").cast("timestamp_ntz").alias("source_created_at"))


@query("""
WITH a AS (SELECT p_partkey AS k, p_name || '_v' || p_size AS title, p_brand, p_type, p_size FROM part WHERE p_partkey % 4 = 0),
b AS (SELECT p_partkey AS k, p_name, p_brand, p_type, p_size, p_partkey % 2 = 0 AS even FROM part WHERE p_partkey % 3 = 0)
SELECT 'k' || coalesce(a.k, b.k) AS source_dataset_key, coalesce(a.title, b.p_name) AS title, CASE WHEN b.k IS NOT NULL THEN 'https://data.example.org/' || b.k END AS canonical_url,
  coalesce(b.p_brand, a.p_brand) || '|' || coalesce(b.p_type, a.p_type) AS tags, coalesce(CAST(a.p_size * 1000 AS BIGINT), CAST(3 * b.p_size AS BIGINT)) AS dataset_size_bytes, CASE WHEN b.k IS NULL THEN 0 ELSE 2 END AS n_resources,
  CASE WHEN b.k IS NOT NULL THEN 'data.example.org' ELSE '' END AS domains, a.k IS NOT NULL AND b.k IS NOT NULL AS in_both
FROM a FULL JOIN b ON a.k = b.k""")
def merged_records(spark, sf_dir):
    """Records of a CSV and of a crawl, merged by key: what means something in the CSV wins, lists are united."""
    rows = _csv_rows(spark, sf_dir).where("p_partkey % 4 = 0")
    first = records.from_csv(rows, F.concat(F.lit("k"), F.col("p_partkey")))
    second = records.from_source(_raw_records(spark, sf_dir)["PUBLIC_DATA_PORTAL"].where("p_partkey % 3 = 0"), records.SOURCES["PUBLIC_DATA_PORTAL"]).drop("source_code")
    out = records.merge(first, second)
    number = F.substring("source_dataset_key", 2, 20).cast("bigint")
    return out.select("source_dataset_key", "title", "canonical_url", F.array_join("tags", "|").alias("tags"), "dataset_size_bytes", F.size("resources_json").alias("n_resources"), F.array_join("domains", "|").alias("domains"), ((number % 4 == 0) & (number % 3 == 0)).alias("in_both"))


@query("""
SELECT 'k' || p_partkey AS source_dataset_key, p_name AS title, p_type AS description_short, 'https://data.example.org/' || p_partkey AS landing_url, p_name || ' ' || chr(10) || p_type || ' ' || chr(10) || p_brand || ' ' || chr(10) || 'data.example.org' AS search_text, true AS commercial_use_allowed,
  true AS has_title, false AS has_subtitle, 2 AS n_tags, CASE WHEN p_size > 0 THEN 2 END AS n_resources, 64 AS hash_length, 'ACTIVE' AS status, '{"downloads":' || p_size || '.0}' AS metrics_json
FROM part""")
def catalogue_rows(spark, sf_dir):
    """Canonical records made rows of the catalogue: normalised texts and lists, search text, license, urls, hash, field presence."""
    rows = _raw_records(spark, sf_dir)["FIGSHARE"]
    extra = F.concat(F.substring(F.col("raw"), F.lit(1), F.char_length("raw") - 1), F.lit(', "x": 1}'))
    made = records.from_source(rows.withColumn("raw", extra), records.SOURCES["FIGSHARE"])
    made = made.withColumns({"metrics_json": F.to_json(F.create_map(F.lit("Downloads"), F.get_json_object(F.element_at("resources_json", 1), "$.size_bytes").cast("double"), F.lit("other"), F.lit(1.0))), "tasks": F.array("publisher_name"), "modalities": F.array().cast("array<string>"), "landing_url": F.lit("not a url")})
    out = records.table_rows(made)
    return out.select("source_dataset_key", "title", "description_short", "landing_url", "search_text", "commercial_use_allowed", F.col("field_presence.has")["title"].alias("has_title"), F.col("field_presence.has")["subtitle"].alias("has_subtitle"), F.col("field_presence.array_lengths")["tags"].alias("n_tags"), F.col("field_presence.array_lengths")["resources_json"].alias("n_resources"), F.char_length("record_hash").alias("hash_length"), "status", "metrics_json")


@query(f"""
WITH r AS (SELECT doc_id, {clean("text")} AS t, {clean("regexp_extract(text, '^[^' || chr(10) || ']*')")} AS h, CASE WHEN doc_id % 5 = 0 THEN 'PUBLIC_DATA_PORTAL' ELSE source END AS source FROM documents),
f AS (SELECT doc_id, source, coalesce(lower(h) IN ({strings(ingest.EMPTY_TEXTS)}) OR regexp_full_match(h, '[^\\p{{L}}\\p{{N}}]+') OR regexp_full_match(h, '(?i)https?://\\S+') OR (contains(h, '{{{{') AND contains(h, '}}}}')) OR regexp_full_match(h, '[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+') OR contains(h, '�')
    OR length(h) <= 2 OR (length(h) <= 8 AND NOT contains(h, ' ')) OR (length(h) >= 3 AND replace(h, substr(h, 1, 1), '') = '') OR (NOT regexp_matches(h, '[A-Za-z가-힣]') AND length(h) <= 20), true) AS bad_title,
  coalesce(lower(t) IN ({strings(ingest.EMPTY_TEXTS)}) OR regexp_full_match(t, '[^\\p{{L}}\\p{{N}}]+') OR regexp_full_match(t, '(?i)https?://\\S+') OR (contains(t, '{{{{') AND contains(t, '}}}}')) OR regexp_full_match(t, '[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+') OR contains(t, '�')
    OR length(t) <= 5 OR (length(t) <= 30 AND len(string_split(t, ' ')) <= 3) OR (len(regexp_extract_all(t, '(?i)https?://\\S+')) >= 2 AND length(t) <= 220) OR (len(regexp_extract_all(t, '(?i)https?://\\S+')) >= 1 AND length(t) <= 120)
    OR {any_of("lower(t)", ingest.SPAM)} OR ({any_of("lower(t)", ingest.PROMO)} AND contains(t, '|')) OR starts_with(lower(t), 'see the full description on the dataset page') OR (NOT regexp_matches(t, '[A-Za-z가-힣]') AND length(t) <= 80), true) AS bad_description FROM r)
SELECT doc_id, bad_title, bad_description, source <> 'PUBLIC_DATA_PORTAL' AND (bad_title OR bad_description) AS bad_record FROM f""")
def quality_gates(spark, sf_dir):
    """Titles, descriptions and records that are not taken."""
    head, t = F.regexp_extract("text", r"^[^\n]*", 0), F.col("text")
    source = F.when(F.col("doc_id") % 5 == 0, "PUBLIC_DATA_PORTAL").otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", ingest.bad_title(head).alias("bad_title"), ingest.bad_description(t).alias("bad_description"), ingest.bad_record(head, F.lit(None).cast("string"), t, source).alias("bad_record"))


@query(f"""
WITH c AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'AI Hub | ' || p_name WHEN 1 THEN p_name || ' input data output data' WHEN 2 THEN p_name WHEN 3 THEN 'aihub' ELSE p_name || ' ' || p_type END AS a, p_name || ' ' || p_brand AS b FROM part)
SELECT p_partkey, CASE p_partkey % 5 WHEN 2 THEN a WHEN 4 THEN CASE WHEN length(a) <= length(b) THEN a ELSE b END ELSE b END AS title, p_partkey % 5 IN (0, 3) AS generic, p_partkey % 5 = 1 AS noisy, p_partkey % 2 = 0 AS noisy_description FROM c""")
def picked_titles(spark, sf_dir):
    """The title among candidates: not the site's, not noise, the shortest; and whether a description is a page's end."""
    k, name = F.col("p_partkey"), F.col("p_name")
    a = F.when(k % 5 == 0, F.concat(F.lit("AI Hub | "), name)).when(k % 5 == 1, F.concat(name, F.lit(" input data output data"))).when(k % 5 == 2, name).when(k % 5 == 3, "aihub").otherwise(F.concat_ws(" ", "p_name", "p_type"))
    about = F.when(k % 2 == 0, F.concat(name, F.lit(" 이용약관 | 사이트맵"))).otherwise(F.concat(name, F.lit(" 이용약관")))
    return table(spark, sf_dir, "part").select("p_partkey", records.picked_title(F.array(a, F.concat_ws(" ", "p_name", "p_brand"))).alias("title"), records.generic_title(a).alias("generic"), records.noisy_title(a).alias("noisy"), records.noisy_description(about).alias("noisy_description"))


@query("""
SELECT p_partkey, 'datasetId=' || p_partkey || '; title=' || CASE WHEN length(p_name || p_type || p_name || p_brand) > 20 THEN substr(p_name || p_type || p_name || p_brand, 1, 17) || '...' ELSE p_name || p_type || p_name || p_brand END AS clipped_title,
  'openApiId=' || p_partkey || '; name=' || p_name || '; provider=' || CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '미상' END || '; auth=미상; tags=' || p_brand || ',' || p_type AS api_card,
  'datasetId=' || p_partkey || '; title=' || p_name || '; descLong=' || p_type || '; domains=-; access=OPEN; payment=' || CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END AS dataset_card, CASE WHEN p_partkey % 3 > 0 THEN 'ko' END AS language,
  CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_brand END AS site FROM part""")
def candidate_cards(spark, sf_dir):
    """Candidates as one line each for a ranking model; language code and site name of a record."""
    k, even = F.col("p_partkey"), F.col("p_partkey") % 2 == 0
    none = F.array().cast("array<string>")
    long = F.concat("p_name", "p_type", "p_name", "p_brand")
    card = records.dataset_card({"id": k, "title": F.col("p_name"), "description": F.col("p_type"), "domains": none, "access": F.lit("OPEN"), "payment": even})
    api = records.api_card({"id": k, "name": F.col("p_name"), "provider": F.when(even, F.col("p_brand")).otherwise(" "), "auth": F.lit(None).cast("string"), "tags": F.array("p_brand", "p_type")})
    language = records.language_code(F.when(k % 3 == 0, none).otherwise(F.array(F.lit(" ko "))))
    site = records.site_name(F.when(even, F.col("p_type")).otherwise("  "), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("datasetId="), k, F.lit("; title="), text.clip(long, 20)).alias("clipped_title"), api.alias("api_card"), card.alias("dataset_card"), language.alias("language"), site.alias("site"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'JSON' WHEN 1 THEN 'JSON+XML' WHEN 2 THEN 'XML' END AS response_format, p_partkey % 3 = 1 AS auth_required, CASE p_partkey % 3 WHEN 0 THEN false WHEN 1 THEN true END AS payment, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS approval,
  CASE p_partkey % 4 WHEN 0 THEN false WHEN 1 THEN true WHEN 3 THEN true END AS commercial FROM part""")
def service_terms(spark, sf_dir):
    """Response formats, keys, payment, approval and commercial use of services, inferred from what they say."""
    k = F.col("p_partkey")
    formats = F.when(k % 4 == 0, "json").when(k % 4 == 1, "XML, Json").when(k % 4 == 2, "xml").otherwise("CSV")
    auth = F.when(k % 3 == 0, " None ").when(k % 3 == 1, "API_KEY")
    payment = numbers.payment_required(F.when(k % 3 == 0, "무료 제공"), F.when(k % 3 == 1, "건당 10원"))
    approval = numbers.approval_required(F.when(k % 4 == 0, "심의 후").when(k % 4 == 1, "-"), F.when(k % 4 == 2, "활용신청").otherwise("기관"))
    use = numbers.commercial_hint(F.when(k % 4 == 0, "변경금지").when(k % 4 == 1, "상업적 이용 허용").when(k % 4 == 2, "technology").otherwise("yes"))
    return table(spark, sf_dir, "part").select("p_partkey", records.response_format(formats).alias("response_format"), numbers.auth_required(auth).alias("auth_required"), payment.alias("payment"), approval.alias("approval"), use.alias("commercial"))


@query("""
WITH n AS (SELECT o_orderkey, o_totalprice AS x, CAST(o_orderkey AS BIGINT) * 977 AS b FROM orders)
SELECT o_orderkey, CASE WHEN x >= 1000000 THEN regexp_replace(CAST(floor(x / 100000 + 0.5) / 10 AS VARCHAR), '\\.0$', '') || 'M' WHEN x >= 1000 THEN regexp_replace(CAST(floor(x / 100 + 0.5) / 10 AS VARCHAR), '\\.0$', '') || 'K' END AS compact, CAST(floor(x / 1000 * 1000 + 0.5) AS BIGINT) || 'ms' AS millis,
  CASE WHEN b >= 1073741824 THEN regexp_replace(CAST(CASE WHEN b / 1073741824.0 >= 10 THEN floor(b / 1073741824.0 + 0.5) ELSE floor(b / 1073741824.0 * 10 + 0.5) / 10 END AS VARCHAR), '\\.0$', '') || 'GB'
       WHEN b >= 1048576 THEN regexp_replace(CAST(CAST(CASE WHEN b / 1048576.0 >= 10 THEN floor(b / 1048576.0 + 0.5) ELSE floor(b / 1048576.0 * 10 + 0.5) / 10 END AS DOUBLE) AS VARCHAR), '\\.0$', '') || 'MB'
       WHEN b >= 1024 THEN regexp_replace(CAST(CAST(CASE WHEN b / 1024.0 >= 10 THEN floor(b / 1024.0 + 0.5) ELSE floor(b / 1024.0 * 10 + 0.5) / 10 END AS DOUBLE) AS VARCHAR), '\\.0$', '') || 'KB' WHEN b > 0 THEN b || 'B' END AS bytes,
  CASE o_orderkey % 3 WHEN 0 THEN '무료' WHEN 1 THEN '유료' ELSE '-' END AS price, CASE o_orderkey % 3 WHEN 0 THEN '가능' WHEN 1 THEN '불가능' ELSE '-' END AS possible, CAST(strftime(o_orderdate, '%Y%m%d') AS BIGINT) AS last_update
FROM n JOIN orders USING (o_orderkey)""")
def display_labels(spark, sf_dir):
    """Numbers, sizes, times, prices and dates as cards show them."""
    x, k = F.col("o_totalprice"), F.col("o_orderkey")
    flag = F.when(k % 3 == 0, F.lit(True)).when(k % 3 == 1, F.lit(False))
    day = F.date_format("o_orderdate", "yyyy. MM. dd")
    compact = F.when(x >= 1000, numbers.compact_number(x))
    return table(spark, sf_dir, "orders").select("o_orderkey", compact.alias("compact"), numbers.millis(x / 1000).alias("millis"), numbers.shown_bytes(k * 977).alias("bytes"), numbers.price_label(flag).alias("price"), numbers.yes_no_label(flag).alias("possible"), numbers.last_update_key(day).alias("last_update"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN floor(l_discount * 1000 + 0.5) / 10 WHEN l_linenumber % 3 = 1 THEN l_quantity ELSE floor(l_tax * 1000 + 0.5) / 10 END AS score, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber END AS as_int, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE -1 END AS as_float,
  format('{:,}', CAST(floor(l_extendedprice) AS BIGINT)) || '/day' AS daily FROM lineitem""")
def score_fallbacks(spark, sf_dir):
    """The first of several score fields that is a number, in percent; numbers that have to be nothing else; daily limits."""
    n = F.col("l_linenumber")
    score = numbers.first_score(F.when(n % 3 == 0, F.col("l_discount").cast("string")).otherwise("n/a"), F.when((n % 3 == 1) & (F.col("l_quantity") > 1), F.col("l_quantity").cast("string")).when(n % 3 == 1, (F.col("l_quantity") / 100).cast("string")), F.col("l_tax").cast("string"))
    as_text = F.when(n % 2 == 0, F.concat(F.lit(" "), n.cast("string"))).otherwise(F.concat(n.cast("string"), F.lit(" items")))
    float_text = F.when(n % 2 == 0, F.col("l_quantity").cast("string")).otherwise("many")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", score.alias("score"), numbers.strict_int(as_text).cast("int").alias("as_int"), numbers.strict_float(float_text, -1.0).alias("as_float"), numbers.daily_limit(F.col("l_extendedprice").cast("bigint")).alias("daily"))


@query("""
SELECT p_partkey, p_brand || '|' || p_type AS merged, p_brand AS first_key, CAST(2 AS INTEGER) AS n_columns, CASE WHEN length(p_name) <= length(p_type) THEN p_name ELSE p_type END AS shortest, CASE p_partkey % 3 WHEN 0 THEN p_brand || '|' || p_type WHEN 1 THEN p_brand ELSE '' END AS listed, true AS has_brand,
  'a.example.org|b.example.org' AS hosts, CAST(p_partkey % 3 AS INTEGER) AS n_results FROM part""")
def array_rules(spark, sf_dir):
    """Lists merged, listed, made of hosts; rows of a schema once each; the list of results wherever a payload keeps it."""
    brand, kind, k = F.col("p_brand"), F.col("p_type"), F.col("p_partkey")
    schema = F.array(*(F.struct(n.alias("name"), F.lit(d).alias("description"), F.lit("int").alias("data_type"), F.lit(None).cast("string").alias("max_length"), F.lit("").alias("unit")) for n, d in ((brand, "x"), (F.upper(brand), " X "), (kind, "x"), (F.lit(" "), "y"))))
    listed = F.when(k % 3 == 0, F.to_json(F.array(brand, kind))).when(k % 3 == 1, brand)
    urls = F.array(F.lit("https://a.example.org/x"), F.lit("http://B.example.org"), F.lit("HTTPS//no"), F.lit("https://A.example.org/y"))
    items = F.array_repeat(F.struct(k.alias("id")), (k % 3).cast("int"))
    payload = F.when(k % 2 == 0, F.to_json(F.struct(F.struct(items.alias("results")).alias("result")))).otherwise(F.to_json(F.struct(F.struct(items.alias("hits")).alias("hits"))))
    once = records.distinct_columns(schema)
    return spread(table(spark, sf_dir, "part")).select("p_partkey", F.array_join(arrays.merged(F.array(brand, kind), F.array(F.upper(kind), F.lit(None).cast("string"))), "|").alias("merged"), F.get(once, F.lit(0))["name"].alias("first_key"), F.size(once).alias("n_columns"), arrays.first_shortest(F.array("p_name", "p_type")).alias("shortest"), F.array_join(arrays.listed(listed), "|").alias("listed"), F.array_contains(F.array(brand, kind), brand).alias("has_brand"), F.array_join(arrays.hosts(urls), "|").alias("hosts"), F.size(records.result_list(payload)).alias("n_results"))


@query("""
SELECT p_partkey, 'a <b> & é ☃ &unknown; x' AS shown, p_name || ' for all' AS first_sentence, p_name AS stripped, p_partkey % 2 = 0 AS navigation, 'left tag,right' AS tags, p_brand || '|' || p_type AS terms FROM part""")
def text_rules(spark, sf_dir):
    """Character references, first sentences, navigation lines, hashtags and terms of texts."""
    name, even = F.col("p_name"), F.col("p_partkey") % 2 == 0
    shown = text.unescape(F.lit("a &lt;b&gt; &amp; &#233; &#x2603; &unknown; x"))
    bar = F.when(even, F.concat(name, F.lit(" 📑 Paper | Project Page | Released Resources | Repo"))).otherwise(name)
    sentence = text.first_sentence(F.concat(name, F.lit(" for all\n")))
    terms = F.when(even, F.concat_ws(";", "p_brand", "p_type")).otherwise(F.concat_ws(" - ", "p_brand", "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", shown.alias("shown"), sentence.alias("first_sentence"), text.without_navigation(bar).alias("stripped"), text.is_navigation(bar).alias("navigation"), F.array_join(text.hashtags(F.lit("say #left  tag #right")), ",").alias("tags"), F.array_join(text.split_terms(terms), "|").alias("terms"))


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN TIMESTAMP '2024-03-01 10:20:30' WHEN 1 THEN TIMESTAMP '2024-03-01 01:20:30' WHEN 2 THEN TIMESTAMP '2024-03-01' END AS parsed, CAST(CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN p_size / 60.0 WHEN 2 THEN p_size WHEN 3 THEN p_size * 24 END AS DOUBLE) AS hours,
  substr('k-' || p_partkey || '-small-ring', 1, 8) AS slug, p_name || '|' || 'https://x.example.org/' AS link FROM part""")
def dates_and_keys(spark, sf_dir):
    """Dates of many forms, relative times, slugs and markdown links."""
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    stamp = F.when(k % 3 == 0, "2024-03-01T10:20:30").when(k % 3 == 1, "2024-03-01T10:20:30+09:00").otherwise("March 1, 2024")
    ago = F.when(k % 4 == 0, "방금 전").when(k % 4 == 1, F.concat(n, F.lit("분 전"))).when(k % 4 == 2, F.concat(n, F.lit("시간 전"))).otherwise(F.concat(n, F.lit("일 전")))
    link = text.markdown_link(F.concat(F.lit("see ["), F.col("p_name"), F.lit("](https://x.example.org/) now")))
    return table(spark, sf_dir, "part").select("p_partkey", dates.parse_datetime(stamp).cast("timestamp_ntz").alias("parsed"), dates.relative_hours(ago).alias("hours"), text.slug(F.concat(F.lit("K "), k.cast("string"), F.lit(" Small -- Ring!")), 8).alias("slug"), F.concat(link["name"], F.lit("|"), link["url"]).alias("link"))
