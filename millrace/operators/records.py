"""Catalogue records: from each source's raw JSON (or CSV row) to one canonical form, merged, normalised, and made a table row.

A source is described by where its fields are (``Source``), not by code of its own; ``from_source`` builds one projection from the
description, which Catalyst prunes to the columns that are used. All functions are column expressions over whole tables.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import arrays, dates, nested, numbers, text
from millrace.operators import ingest

#: The canonical record: texts, flags, numbers, lists, lists of JSON objects, and JSON objects.
TEXTS = ("canonical_url", "landing_url", "title", "subtitle", "description_short", "description_long", "publisher_name", "license_name", "license_url", "access_type", "source_version", "status")
FLAGS = ("commercial_use_allowed", "login_required", "approval_required", "payment_required", "is_restricted")
NUMBERS = ("row_count", "dataset_size_bytes")
TIMES = ("source_created_at", "source_updated_at")
LISTS = ("domains", "tasks", "modalities", "tags", "languages")
OBJECT_LISTS = ("creators_json", "resources_json")
OBJECTS = ("schema_json", "metrics_json", "extra_json", "raw_json")
_TYPES = {**dict.fromkeys(TEXTS + OBJECTS, "string"), **dict.fromkeys(FLAGS, "boolean"), **dict.fromkeys(NUMBERS, "bigint"), **dict.fromkeys(TIMES, "timestamp"), **dict.fromkeys(LISTS + OBJECT_LISTS, "array<string>")}
FIELDS = tuple(_TYPES)


@dataclass(frozen=True)
class Source:
    """Where a source keeps what: JSON paths, the first with content counts. ``{key}`` in a url is the record's key."""

    code: str
    key: tuple[str, ...] = ("$.id",)
    url: tuple[str, ...] = ("$.url",)
    made_url: str | None = None
    title: tuple[str, ...] = ("$.title",)
    description: tuple[str, ...] = ("$.description",)
    publisher: tuple[str, ...] = ()
    tags: tuple[str, ...] = ("$.tags",)
    tasks: tuple[str, ...] = ("$.tags",)
    domains: tuple[str, ...] = ()
    languages: tuple[str, ...] = ("$.language",)
    tag_prefixes: dict[str, tuple[str, ...]] = field(default_factory=dict)
    license_name: tuple[str, ...] = ("$.license",)
    license_url: tuple[str, ...] = ("$.license_url",)
    created: tuple[str, ...] = ()
    updated: tuple[str, ...] = ()
    version: tuple[str, ...] = ("$.version",)
    rows: tuple[str, ...] = ()
    splits: str | None = None
    size: tuple[str, ...] = ()
    files: str = "$.files"
    file_size: tuple[str, ...] = ("$.size",)
    file_url: tuple[str, ...] = ("$.download_url",)
    file_name: tuple[str, ...] = ("$.name",)
    size_hints: bool = False
    metrics: dict[str, tuple[str, ...]] = field(default_factory=dict)
    creators: str | None = None
    #: (path, access type, words): the first whose value is one of the words decides; of a list, any of its values.
    access: tuple[tuple[str, str, tuple[str, ...]], ...] = ()
    #: Access of a record that says something else, and of one that says nothing.
    other_access: str = "OPEN"
    no_access: str = "OPEN"


_YES = ("true", "1", "yes")
#: Where the sources keep their fields, and what their words for access mean.
SOURCES = {
    s.code: s
    for s in (
        Source("DATA_GOV", key=("$.id", "$.name"), url=("$.url", "$.landingPage"), description=("$.notes",), title=("$.title", "$.name"), publisher=("$.organization.title", "$.author", "$.maintainer"), tags=("$.tags[*].display_name", "$.groups[*].display_name"), tasks=(), domains=("$.groups[*].display_name",), license_name=("$.license_title", "$.license_id"), created=("$.metadata_created",), updated=("$.metadata_modified", "$.revision_timestamp"), version=("$.revision_id", "$.state"), files="$.resources", file_url=("$.url",), access=(("$.accessLevel", "OPEN", ("public", "open")), ("$.isopen", "RESTRICTED", ("false",))), other_access="RESTRICTED"),
        Source("ZENODO", key=("$.id", "$.record_id"), url=("$.links.html", "$.doi_url", "$.links.self_html"), title=("$.metadata.title",), description=("$.metadata.description",), publisher=("$.metadata.publisher", "$.metadata.creators[0].name"), tags=("$.metadata.keywords", "$.metadata.communities[*].identifier", "$.metadata.subjects[*].term"), tasks=("$.metadata.keywords",), languages=("$.metadata.language",), license_name=("$.metadata.license.id", "$.metadata.license"), license_url=("$.links.license", "$.metadata.license.url"), created=("$.created", "$.metadata.publication_date"), updated=("$.updated",), version=("$.metadata.version", "$.revision"), rows=("$.metadata.num_rows", "$.metadata.record_count"), size=("$.size", "$.stats.size", "$.metadata.size"), file_url=("$.links.self", "$.links.download"), file_name=("$.key", "$.filename"), metrics={"downloads": ("$.stats.downloads",), "views": ("$.stats.views",)}, creators="$.metadata.creators", access=(("$.metadata.access_right", "OPEN", ("open",)), ("$.metadata.access_right", "REGISTERED", ("embargoed",)), ("$.metadata.access_right", "RESTRICTED", ("restricted", "closed")))),
        Source("FIGSHARE", url=("$.url_public_html", "$.figshare_url", "$.url"), publisher=("$.group_title", "$.institution_name", "$.owner.full_name", "$.authors[0].full_name"), tags=("$.tags", "$.keywords", "$.categories[*].title"), tasks=("$.tags", "$.keywords"), license_name=("$.license.name", "$.license_name"), license_url=("$.license.url", "$.license_url"), created=("$.published_date", "$.posted_date"), updated=("$.modified_date",), version=("$.version", "$.version_id", "$.resource_doi"), rows=("$.row_count",), size=("$.size",), file_name=("$.name", "$.supplied_filename"), metrics={"views": ("$.views", "$.views_count"), "downloads": ("$.downloads", "$.downloads_count"), "shares": ("$.shares", "$.shares_count"), "citations": ("$.cites", "$.citation_count")}, creators="$.authors", access=(("$.is_public", "RESTRICTED", ("false",)),)),
        Source("HUGGINGFACE", url=(), made_url="https://huggingface.co/datasets/{key}", title=("$.cardData.pretty_name",), description=("$.cardData.dataset_summary", "$.cardData.description", "$.description"), publisher=("$.author", "$.cardData.publisher.name"), tasks=("$.cardData.task_categories", "$.cardData.task_ids"), languages=(), tag_prefixes={"languages": ("language:",), "tasks": ("task_categories:", "task_ids:"), "domains": ("domain:", "benchmark:", "library:"), "modalities": ("modality:",), "license_name": ("license:",)}, license_name=("$.cardData.license", "$.license"), license_url=("$.cardData.license_link",), created=("$.createdAt", "$.created_at"), updated=("$.lastModified", "$.last_modified"), version=("$.sha", "$.lastModified"), rows=("$.cardData.dataset_info.dataset_num_rows", "$.cardData.dataset_num_rows"), splits="$.cardData.dataset_info.splits", size=("$.usedStorage", "$.used_storage", "$.cardData.dataset_info.dataset_size"), files="$.siblings", file_size=("$.size", "$.size_in_bytes", "$.lfs.size", "$.blob_size"), file_name=("$.rfilename",), metrics={"downloads": ("$.downloads",), "downloads_all_time": ("$.downloadsAllTime", "$.downloads_all_time"), "likes": ("$.likes",)}, access=(("$.gated", "APPROVAL", (*_YES, "auto", "manual")), ("$.private", "REGISTERED", _YES))),
        Source("KAGGLE", key=("$.ref",), made_url="https://www.kaggle.com/datasets/{key}", publisher=("$.ownerName", "$.creatorName"), tags=("$.tags[*].name", "$.keywords"), tasks=("$.tags[*].name", "$.keywords"), languages=(), license_name=("$.licenseName", "$.license_name"), license_url=(), created=("$.creationDate",), updated=("$.lastUpdated",), version=("$.currentVersionNumber",), size=("$.totalBytes",), file_size=("$.totalBytes", "$.size"), metrics={"download_count": ("$.downloadCount", "$.totalDownloads"), "vote_count": ("$.voteCount", "$.totalVotes"), "view_count": ("$.viewCount", "$.totalViews"), "usability_rating": ("$.usabilityRating",)}, access=(("$.isPrivate", "RESTRICTED", _YES),), other_access="REGISTERED", no_access="REGISTERED"),
        Source("HARVARD_DATAVERSE", key=("$.global_id", "$.id"), title=("$.name", "$.title"), publisher=("$.producers[0].name", "$.authors[0].name", "$.ownerName"), tags=("$.subjects", "$.keywords"), tasks=("$.keywords",), domains=("$.subjects",), languages=("$.languages",), license_name=("$.latestVersion.license.name",), license_url=("$.latestVersion.license.uri",), created=("$.published_at",), updated=("$.updatedAt",), version=("$.latestVersion.versionNumber",), files="$.latestVersion.files", file_size=("$.dataFile.filesize",), file_name=("$.dataFile.filename",), creators="$.authors", access=(("$.latestVersion.files[*].restricted", "RESTRICTED", _YES),)),
        Source("DATA_EUROPA", url=("$.landingPage", "$.url"), made_url="https://data.europa.eu/en/data/datasets/{key}", publisher=("$.publisher.name", "$.creator.name"), tags=("$.theme", "$.keyword"), tasks=("$.keyword",), domains=("$.theme",), license_name=("$.license", "$.rights"), license_url=("$.license",), created=("$.issued", "$.created"), updated=("$.modified",), version=("$.versionInfo", "$.version"), rows=("$.recordCount", "$.rows"), files="$.distribution", file_size=("$.byteSize", "$.size"), file_url=("$.downloadURL", "$.accessURL"), file_name=("$.title",), access=(("$.accessRights", "RESTRICTED", ("restricted", "non-public", "nonpublic", "private")), ("$.accessRights", "REGISTERED", ("registered",)), ("$.accessRights", "PAID", ("paid",)))),
        Source("AWS_ODR", key=("$.path",), url=(), made_url="https://registry.opendata.aws/{key}/", title=("$.Name",), description=("$.Description",), publisher=("$.ManagedBy", "$.Contact"), tags=("$.Tags", "$.ADXCategories"), tasks=("$.Tags", "$.ADXCategories"), domains=("$.ADXCategories",), languages=(), license_name=("$.License",), license_url=(), version=(), size=("$.SizeBytes", "$.DatasetSizeBytes"), files="$.Resources", file_size=("$.Size", "$.SizeBytes", "$.size"), file_url=("$.Explore", "$.ExploreUrl"), file_name=("$.ARN", "$.Arn"), size_hints=True, access=(("$.Resources[*].ControlledAccess", "RESTRICTED", _YES), ("$.Resources[*].RequesterPays", "PAID", _YES), ("$.Resources[*].AccountRequired", "REGISTERED", _YES))),
        Source("AIHUB", license_name=(), license_url=(), languages=(), no_access="APPROVAL", other_access="APPROVAL", updated=("$.updated",)),
        Source("PUBLIC_DATA_PORTAL", title=("$.title", "$.name"), publisher=("$.publisher.name", "$.provider"), tags=("$.keywords",), tasks=("$.keywords",), license_name=("$.license", "$.scope_of_use"), created=("$.registered",), updated=("$.edited",), rows=("$.all_rows",), access=(("$.payment", "OPEN", ("free", "무료")), ("$.payment", "PAID", ("paid", "유료")), ("$.provided", "APPROVAL", ("apply", "approval", "restricted")))),
    )
}

#: What each access type asks of a reader (login, approval, payment, restricted).
_ASKS = {"OPEN": (False, False, False, False), "REGISTERED": (True, False, False, True), "APPROVAL": (True, True, False, True), "PAID": (True, False, True, True), "RESTRICTED": (True, True, False, True)}


def _at(raw: Column, paths: tuple[str, ...]) -> Column:
    """The cleaned text of the first path with content."""
    found = [text.clean(F.get_json_object(raw, p)) for p in paths]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def _list_at(raw: Column, paths: tuple[str, ...]) -> Column:
    """All texts of all paths: lists, single values, and texts with ``;`` or ``,``; objects in lists are left out."""
    if not paths:
        return F.array().cast("array<string>")

    def texts(value: Column) -> Column:
        return F.when(F.trim(value).startswith("["), arrays.listed(value)).when(value.isNotNull(), text.split_keywords(value)).otherwise(F.array().cast("array<string>"))

    def one(path: str) -> Column:
        value = F.get_json_object(raw, path)
        if "[*]" in path:  # a single match comes without its list
            value = text.let(value, lambda v: F.when(v.startswith("["), v).otherwise(F.concat(F.lit("["), v, F.lit("]"))))
        return text.let(value, texts)

    return F.filter(arrays.merged(*map(one, paths)), lambda x: ~x.startswith("{"))


def _objects_at(raw: Column, path: str | None) -> Column:
    """The objects of a list, as JSON texts."""
    if path is None:
        return F.array().cast("array<string>")
    return F.coalesce(F.filter(F.from_json(F.get_json_object(raw, path), "array<string>"), lambda x: x.startswith("{")), F.array().cast("array<string>"))


def summed(sizes: Column) -> Column:
    """The sum of the sizes that are known; null if none is."""
    return text.let(F.filter(sizes, lambda n: n.isNotNull()), lambda known: F.when(F.size(known) > 0, F.aggregate(known, F.lit(0).cast("bigint"), lambda a, n: a + n)))


#: Words beside a size that make it the size of the data.
SIZE_HINTS = ("size", "dataset", "data", "storage", "volume", "compressed", "uncompressed")


def stated_size(x: Column, reach: int = 28) -> Column:
    """The greatest size that a text states near a word for sizes."""
    with_context = F.regexp_extract_all(x, F.lit(rf"(?is).{{0,{reach}}}\b[0-9]+(?:\.[0-9]+)?\s*(?:[KMGTP]i?B|B)\b.{{0,{reach}}}"), F.lit(0))
    near = F.filter(with_context, lambda c: F.lower(c).rlike("|".join(SIZE_HINTS)))
    return F.array_max(F.transform(near, lambda c: numbers.parse_bytes(F.regexp_extract(c, r"(?i)[0-9]+(?:\.[0-9]+)?\s*(?:[KMGTP]i?B|B)", 0))))


def access_of(raw: Column, source: Source) -> Column:
    """The access type by the source's own words."""
    found, said = F.lit(None).cast("string"), F.lit(False)
    for path, kind, words in reversed(source.access):
        value = F.get_json_object(raw, path)
        values = F.transform(arrays.listed(value), lambda v: F.lower(text.clean(v)))
        found = F.when(F.arrays_overlap(values, F.array(*map(F.lit, words))), kind).otherwise(found)
        said = said | (value.isNotNull() & (source.other_access != source.no_access) & F.lit(path == source.access[0][0]))
    return F.coalesce(found, F.when(said, source.other_access), F.lit(source.no_access))


def from_source(rows: DataFrame, source: Source, raw: str = "raw") -> DataFrame:
    """source_code, source_dataset_key and the canonical fields of every raw JSON record."""
    j = F.col("raw_json")
    none = F.array().cast("array<string>")
    size_of = lambda f: F.coalesce(*(numbers.parse_bytes(F.get_json_object(f, p)) for p in source.file_size))
    base = rows.select(F.col(raw).alias("raw_json")).select(
        "raw_json", _at(j, source.key).alias("_key"), _at(j, source.title).alias("_title"), _at(j, source.description).alias("_about"), _at(j, source.url).alias("_url"), _list_at(j, source.tags).alias("tags"), access_of(j, source).alias("access_type"),
        F.transform(_objects_at(j, source.files), lambda f: F.struct(_at(f, source.file_name).alias("name"), _at(f, source.file_url).alias("download_url"), size_of(f).alias("size_bytes"))).alias("_files"),
    )

    def by_prefix(name: str) -> Column:
        return F.concat(*(text.prefixed(F.col("tags"), p) for p in source.tag_prefixes.get(name, ())), none)

    key, files = F.col("_key"), F.col("_files")
    made = F.replace(F.lit(source.made_url), F.lit("{key}"), key) if source.made_url else F.lit(None).cast("string")
    total = F.nullif(summed(F.transform(files, lambda f: f["size_bytes"])), F.lit(0))
    counts = F.transform(_objects_at(j, source.splits), lambda s: F.coalesce(numbers.parse_int(F.get_json_object(s, "$.num_examples")), numbers.parse_int(F.get_json_object(s, "$.dataset_num_rows"))))
    title = F.coalesce("_title", F.regexp_extract(key, "[^/]+$", 0))
    names = F.concat_ws(" ", title, "_about", F.array_join("tags", " "), F.array_join(F.transform(files, lambda f: f["name"]), " "))
    metrics = F.to_json(F.create_map(*(c for n, p in source.metrics.items() for c in (F.lit(n), numbers.parse_float(_at(j, p)))))) if source.metrics else F.lit("{}")
    base = base.withColumns({"canonical_url": F.coalesce("_url", made), "title": title, "_names": names})
    values = {
        "landing_url": F.col("canonical_url"), "subtitle": F.lit(None), "description_short": F.col("_about"), "description_long": F.col("_about"), "publisher_name": _at(j, source.publisher),
        "license_name": F.coalesce(_at(j, source.license_name), F.get(by_prefix("license_name"), F.lit(0))), "license_url": _at(j, source.license_url), "source_version": _at(j, source.version), "status": F.lit("ACTIVE"),
        "commercial_use_allowed": F.lit(None), "row_count": F.coalesce(numbers.parse_int(_at(j, source.rows)), summed(counts)),
        "dataset_size_bytes": F.coalesce(total, numbers.parse_bytes(_at(j, source.size)), *([stated_size(F.col("_about"))] if source.size_hints else [])),
        "source_created_at": dates.parse_datetime(_at(j, source.created)), "source_updated_at": dates.parse_datetime(_at(j, source.updated)),
        "domains": arrays.merged(_list_at(j, source.domains), by_prefix("domains"), *([] if source.domains else [arrays.hosts(F.array("canonical_url"))])), "tasks": arrays.merged(by_prefix("tasks"), _list_at(j, source.tasks)),
        "modalities": arrays.merged(by_prefix("modalities"), numbers.modalities(F.col("_names"))), "languages": arrays.merged(by_prefix("languages"), _list_at(j, source.languages)),
        "creators_json": _objects_at(j, source.creators), "resources_json": F.transform(files, lambda f: F.to_json(f)), "schema_json": F.lit("{}"), "metrics_json": metrics, "extra_json": F.lit("{}"),
    }
    values |= {n: F.coalesce(*(F.when(F.col("access_type") == k, F.lit(a[i])) for k, a in _ASKS.items())) for i, n in enumerate(("login_required", "approval_required", "payment_required", "is_restricted"))}
    return base.select(F.lit(source.code).alias("source_code"), key.alias("source_dataset_key"), *((values[f] if f in values else F.col(f)).cast(_TYPES[f]).alias(f) for f in FIELDS))


#: Names of the columns of a Korean catalogue's CSV, for each field.
CSV_COLUMNS = {
    "title": ("목록명", "데이터셋명", "dataset_title", "title", "이름"),
    "description": ("설명", "개요", "설명요약", "description", "summary"),
    "limit": ("데이터한계", "data_limit"),
    "notice": ("기타유의사항", "notes", "other_notes"),
    "publisher": ("제공기관", "기관명", "소유기관", "publisher", "provider", "관리기관"),
    "keywords": ("키워드", "태그", "keywords", "tags"),
    "domains": ("분류체계", "분야", "category", "domain"),
    "languages": ("언어", "language", "languages"),
    "license": ("이용허락", "라이선스", "license", "license_name"),
    "license_url": ("라이선스URL", "license_url", "licenseLink"),
    "payment": ("비용부과유무", "비용부과", "비용", "payment", "fee"),
    "payment_note": ("비용부과기준및단위", "charge_standard"),
    "approval": ("심의유형", "심의단계", "승인", "approval", "approval_required"),
    "login": ("로그인필요", "login_required", "인증필요"),
    "provided": ("제공형태", "provided", "form_of_provision"),
    "rows": ("전체건수", "행수", "row_count", "rows", "데이터건수", "전체행"),
    "size": ("데이터용량", "용량", "size", "dataset_size", "파일용량"),
    "created": ("등록일", "생성일", "created_at", "등록일자"),
    "updated": ("수정일", "변경일", "updated_at", "수정일자"),
    "url": ("URL", "url", "landing_url", "목록URL"),
    "type": ("목록유형", "list_type", "type"),
}
LOGIN_WORDS, NO_LOGIN_WORDS = ("활용신청", "로그인", "신청", "회원"), ("다운로드", "바로", "기관자체")


def is_file_row(rows: DataFrame, kind: str = "FILE") -> Column:
    """Whether a CSV row lists a file (or an API)."""
    return F.upper(F.trim(ingest.pick(rows, *CSV_COLUMNS["type"]))) == kind


def from_csv(rows: DataFrame, key: Column) -> DataFrame:
    """The canonical fields of CSV rows whose columns are found by alias."""
    picked = {n: text.clean(ingest.pick(rows, *names)).alias(f"_{n}") for n, names in CSV_COLUMNS.items()}
    rows = rows.select(key.alias("_key"), F.to_json(F.struct(*(F.col(f"`{x}`") for x in rows.columns))).alias("_raw"), *picked.values())
    c = {n: F.col(f"_{n}") for n in CSV_COLUMNS}
    rows = rows.withColumns({"_long": F.nullif(F.array_join(F.filter(F.array(c["description"], c["limit"], c["notice"]), ingest.meaningful), "\n"), F.lit("")), "_pays": numbers.payment_required(c["payment"], c["payment_note"]), "_asks": numbers.approval_required(c["approval"], c["provided"]), "_tags": arrays.short_terms(text.split_terms(c["keywords"]))})
    none, empty = F.lit(None), F.array().cast("array<string>")
    long, payment, approval = F.col("_long"), F.col("_pays"), F.col("_asks")
    provided = F.lower(c["provided"])
    login = F.coalesce(numbers.parse_bool(c["login"]), F.when(approval, F.lit(True)), F.when(provided.rlike("|".join(LOGIN_WORDS)), F.lit(True)).when(provided.rlike("|".join(NO_LOGIN_WORDS)), F.lit(False)))
    keywords = F.col("_tags")
    at_least_zero = lambda n: F.when(n >= 0, n)
    values = {
        "canonical_url": c["url"], "landing_url": c["url"], "title": c["title"], "subtitle": none, "description_short": text.first_sentence(F.coalesce(c["description"], long), 10_000), "description_long": F.coalesce(long, c["description"]),
        "publisher_name": c["publisher"], "license_name": c["license"], "license_url": c["license_url"], "source_version": text.version_suffix(c["title"]), "status": F.lit("ACTIVE"),
        "access_type": numbers.access_type(none.cast("string"), payment, approval, none.cast("boolean"), login), "commercial_use_allowed": numbers.commercial_hint(c["license"]), "login_required": login, "approval_required": approval,
        "payment_required": payment, "is_restricted": none, "row_count": at_least_zero(numbers.parse_int(c["rows"])), "dataset_size_bytes": at_least_zero(numbers.parse_bytes(c["size"])),
        "source_created_at": dates.parse_datetime(c["created"]), "source_updated_at": dates.parse_datetime(c["updated"]), "domains": arrays.short_terms(text.split_terms(c["domains"])), "tasks": keywords,
        "modalities": numbers.modalities(F.concat_ws(" ", c["title"], c["description"], c["keywords"])), "tags": keywords, "languages": arrays.short_terms(text.split_terms(c["languages"]), 40), "creators_json": empty, "resources_json": empty,
        "schema_json": F.lit("{}"), "metrics_json": F.lit("{}"), "extra_json": F.lit("{}"), "raw_json": F.col("_raw"),
    }
    return rows.select(F.col("_key").alias("source_dataset_key"), *(F.coalesce(values[f].cast(_TYPES[f]), F.lit(None).cast(_TYPES[f])).alias(f) for f in FIELDS))


def merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """Records of two feeds by key: of texts, flags and numbers the first feed's if it means something, of lists both, of objects the first feed's entries over the second's."""
    a, b = first.alias("a"), second.alias("b")
    joined = a.join(b, F.col("a.source_dataset_key") == F.col("b.source_dataset_key"), "full_outer")
    pair = lambda f: (F.col(f"a.{f}"), F.col(f"b.{f}"))
    none = F.array().cast("array<string>")
    out = {"source_dataset_key": F.coalesce(*pair("source_dataset_key"))}
    for f in TEXTS:
        out[f] = F.when(ingest.meaningful(F.col(f"a.{f}")), F.col(f"a.{f}")).otherwise(F.col(f"b.{f}"))
    for f in FLAGS + NUMBERS + TIMES:
        out[f] = F.coalesce(*pair(f))
    for f, longest in (("domains", 80), ("tasks", 80), ("tags", 80), ("languages", 40)):
        out[f] = arrays.short_terms(F.concat(*(F.coalesce(c, none) for c in reversed(pair(f)))), longest, tasks=f == "tasks")
    formats = F.array_join(F.transform(F.coalesce(F.col("b.resources_json"), none), lambda r: F.coalesce(F.get_json_object(r, "$.format"), F.lit(""))), " ")
    out["modalities"] = arrays.merged(*reversed(pair("modalities")), numbers.modalities(F.concat_ws(" ", F.col("b.title"), F.col("b.description_short"), F.array_join(out["tags"], " "), formats)))
    for f in OBJECT_LISTS:
        out[f] = F.array_distinct(F.concat(*(F.coalesce(c, none) for c in reversed(pair(f)))))
    for f in OBJECTS:
        as_map = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
        out[f] = F.to_json(nested.overlay(as_map(F.col(f"b.{f}")), as_map(F.col(f"a.{f}"))))
    out["subtitle"] = F.lit(None).cast("string")
    urls = F.concat(F.array(out["canonical_url"], out["landing_url"]), F.transform(out["resources_json"], lambda r: F.get_json_object(r, "$.download_url")))
    out["domains"] = F.when(F.size(out["domains"]) > 0, out["domains"]).otherwise(arrays.hosts(urls))
    out["access_type"] = numbers.access_type(out["access_type"], out["payment_required"], out["approval_required"], out["is_restricted"], out["login_required"])
    out["status"] = F.coalesce(out["status"], F.lit("ACTIVE"))
    return joined.select(*(out[f].cast(_TYPES.get(f, "string")).alias(f) for f in ("source_dataset_key", *FIELDS)))


#: Most items and characters of each list of a table row, and whether sentences are left out.
_LIMITS = {"domains": (40, 120, True), "tasks": (64, 160, True), "modalities": (20, 80, False), "tags": (80, 200, True), "languages": (16, 40, False)}


def table_rows(records: DataFrame) -> DataFrame:
    """Normalised rows of the catalogue: texts without navigation, lists without noise, search text, license, urls, hash and field presence."""
    localized = {f: text.without_navigation(F.coalesce(nested.localized(F.col(f), "ko", "en", "uk"), F.col(f))) for f in ("title", "subtitle", "description_short", "description_long", "publisher_name")}
    rows = records.withColumns(localized)
    rows = rows.withColumn("description_short", F.coalesce("description_short", text.first_sentence(F.col("description_long"))))
    rows = rows.withColumns({f: arrays.term_list(F.coalesce(F.col(f), F.array().cast("array<string>")), *limit) for f, limit in _LIMITS.items()})
    pieces = F.concat(F.array("title", "subtitle", "description_short", "description_long", "publisher_name"), *(F.col(f) for f in LISTS))
    search = F.nullif(F.array_join(F.filter(arrays.unique_ci(pieces), lambda t: ~arrays.noise(t)), " \n"), F.lit(""))
    canonical, landing = ingest.cross_filled(F.col("canonical_url"), F.col("landing_url"))
    rows = rows.withColumns({
        "search_text": search,
        "commercial_use_allowed": F.coalesce("commercial_use_allowed", numbers.commercial_use(F.coalesce("license_name", F.lit("")), F.coalesce("license_url", F.lit("")))),
        "canonical_url": canonical,
        "landing_url": landing,
        "title": ingest.title_or_null(F.col("title"), F.col("source_dataset_key")),
        "metrics_json": metrics(F.col("metrics_json")),
        "status": F.coalesce("status", F.lit("ACTIVE")),
    })
    scalars = ("source_dataset_key", *TEXTS, *FLAGS, *NUMBERS, *TIMES, "search_text")
    hashed = F.struct(*(F.nullif(F.trim(F.col(f).cast("string")), F.lit("")).alias(f) if f in scalars else F.when(F.size(f) > 0, F.col(f)).alias(f) if f in LISTS + OBJECT_LISTS else F.nullif(F.col(f), F.lit("{}")).alias(f) for f in sorted((*scalars, *LISTS, *OBJECT_LISTS, *OBJECTS))))
    presence = ingest.field_presence({f: F.col(f) for f in scalars}, {f: F.col(f) for f in LISTS + OBJECT_LISTS}, {f: F.col(f) for f in ("schema_json", "metrics_json", "extra_json")})
    return rows.withColumns({"record_hash": F.sha2(F.to_json(hashed), 256), "field_presence": presence})


#: The metrics that a row keeps.
METRICS = ("downloads", "downloads_all_time", "likes", "views", "download_count", "view_count", "vote_count", "shares", "citations", "usability_rating", "request_count")


def metrics(j: Column) -> Column:
    """The known metrics of a JSON object that are numbers, under their usual names."""
    found = F.coalesce(F.from_json(j, "map<string,string>"), F.create_map().cast("map<string,string>"))
    entries = F.transform(F.map_entries(found), lambda e: F.struct(F.replace(F.replace(F.replace(F.lower(text.clean(e["key"])), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_")), F.lit("__"), F.lit("_")).alias("key"), e["value"].alias("value")))
    kept = F.filter(entries, lambda e: e["key"].isin(*METRICS) & e["value"].rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"))
    first = text.let(kept, lambda k: F.filter(k, lambda e, i: F.array_position(F.transform(k, lambda x: x["key"]), e["key"]) == i + 1))
    return F.to_json(F.map_from_entries(F.array_sort(F.transform(first, lambda e: F.struct(e["key"].alias("key"), e["value"].try_cast("double").alias("value"))))))


def _shown(x: Column, other: str) -> Column:
    return F.coalesce(text.blank_to_null(x), F.lit(other))


def dataset_card(r: dict[str, Column]) -> Column:
    """One line that describes a data set to a ranking model."""
    return F.concat_ws("; ", F.concat(F.lit("datasetId="), r["id"]), F.concat(F.lit("title="), text.clip(r["title"], 80)), F.concat(F.lit("descLong="), text.clip(r["description"], 400)), F.concat(F.lit("domains="), _shown(F.array_join(F.slice(r["domains"], 1, 3), ","), "-")), F.concat(F.lit("access="), r["access"]), F.concat(F.lit("payment="), r["payment"].cast("string")))


def api_card(r: dict[str, Column]) -> Column:
    """One line that describes an API to a ranking model."""
    return F.concat_ws("; ", F.concat(F.lit("openApiId="), r["id"]), F.concat(F.lit("name="), text.clip(r["name"], 120)), F.concat(F.lit("provider="), text.clip(_shown(r["provider"], "미상"), 80)), F.concat(F.lit("auth="), text.clip(_shown(r["auth"], "미상"), 40)), F.concat(F.lit("tags="), _shown(F.array_join(F.slice(r["tags"], 1, 6), ","), "-")))


def site_name(source_name: Column, publisher: Column) -> Column:
    return F.coalesce(text.blank_to_null(source_name), publisher)


def language_code(languages: Column) -> Column:
    return text.blank_to_null(F.substring(F.trim(F.get(languages, F.lit(0))), 1, 10))


def response_format(x: Column) -> Column:
    """JSON, XML, JSON+XML or null."""
    has_json, has_xml = F.upper(x).contains("JSON"), F.upper(x).contains("XML")
    return F.when(has_json & has_xml, "JSON+XML").when(has_json, "JSON").when(has_xml, "XML")


def error_summary(errors: Column, most: int = 20) -> Column:
    """The first errors of a run, and how many more there were; null without any."""
    more = F.when(F.size(errors) > most, F.concat(F.lit("\n... and "), F.size(errors) - most, F.lit(" more"))).otherwise("")
    return F.when(F.size(errors) > 0, F.concat(F.array_join(F.slice(errors, 1, most), "\n"), more))


#: Titles of a site rather than of a data set, and words of tables and page ends.
GENERIC_TITLES = ("aihub", "ai hub", "ai-hub", "인공지능허브")
TITLE_NOISE = ("input data", "output data", "data i/o", "성능 지표", "설명서", "어노테이션 포맷", "top-1 accuracy")
PAGE_NOISE = ("개인정보보호 책임자", "이용약관", "개인정보처리방침", "family site", "webwatch", "contact.", "한국지능정보사회진흥원", "사이트맵", "웹접근성")


def hits(x: Column, words: tuple[str, ...]) -> Column:
    """How many of the words a text has."""
    return sum((F.lower(x).contains(w).cast("int") for w in words), F.lit(0))


def generic_title(x: Column) -> Column:
    head = F.trim(F.regexp_extract(F.lower(x), "^[^|·:/]*", 0))
    return F.regexp_replace(F.lower(x), "[^a-z0-9가-힣]+", "").isin(*GENERIC_TITLES) | head.isin(*GENERIC_TITLES)


def noisy_title(x: Column) -> Column:
    return (F.char_length(x) > 180) | (hits(x, TITLE_NOISE) >= 2)


def noisy_description(x: Column) -> Column:
    n = hits(x, PAGE_NOISE)
    return (n >= 2) | ((F.char_length(x) > 1200) & (n >= 1))


def picked_title(candidates: Column) -> Column:
    """The shortest title that is neither the site's nor noise; else the shortest that is not the site's; else the first."""
    all_ = F.array_distinct(F.filter(F.transform(candidates, text.clean), lambda t: t.isNotNull()))
    own = F.filter(all_, lambda t: ~generic_title(t))
    plain = F.filter(own, lambda t: ~noisy_title(t))
    return F.when(F.size(own) == 0, F.get(all_, F.lit(0))).when(F.size(plain) > 0, arrays.first_shortest(plain)).otherwise(arrays.first_shortest(own))


def distinct_columns(columns: Column) -> Column:
    """Rows of a schema (structs of name, description, data_type, max_length, unit) that have a name, once each whatever their case."""
    named = F.filter(columns, lambda c: text.clean(c["name"]).isNotNull())
    key = lambda c: F.concat_ws("\x1f", *(F.lower(F.coalesce(text.clean(c[f]), F.lit(""))) for f in ("name", "description", "data_type", "max_length", "unit")))
    return text.let(named, lambda n: text.let(F.transform(n, key), lambda keys: F.filter(n, lambda c, i: F.array_position(keys, F.get(keys, i)) == i + 1)))


def result_list(payload: Column) -> Column:
    """The list of objects of a paged answer, wherever it is kept, as JSON texts."""
    paths = ("$.results", "$.items", "$.result.results", "$.data.results", "$.hits.hits")

    def objects(path: str) -> Column:
        items = F.from_json(F.get_json_object(payload, path), "array<string>")
        return text.let(items, lambda a: F.when((F.size(a) > 0) & F.forall(a, lambda x: x.startswith("{")), a))

    return F.coalesce(*map(objects, paths), F.array().cast("array<string>"))
