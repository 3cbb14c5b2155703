"""Readers and writers: sniffed CSV, pages of JSON services as files, YAML, HTML lists, tables and documentation, run summaries."""

import json
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sniff(line: str) -> str:
    """The separator that a header line has most of."""
    return max((",", "\t", ";", "|"), key=lambda s: (line.count(s), s == ","))


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", start: int = 0) -> DataFrame:
    """All columns as trimmed strings with trimmed names, and row_index from 1; rows before ``start`` are skipped.

    Files are split between tasks, by lines, unless a quoted value goes over a line's end: then a file is one task. The index numbers rows
    by file, block of the file and place in it, from counts of the blocks, without a sort of the rows.
    """
    lines = spark.read.option("encoding", encoding).text(path)
    head = lines.limit(1).collect()
    separator = sniff(head[0].value) if head else ","
    quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit('"')))
    whole = not lines.where(quotes % 2 == 1).isEmpty()
    raw = spark.read.csv(path, header=True, sep=separator, encoding=encoding, multiLine=whole, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    names = [c.replace("\ufeff", "").strip() for c in raw.columns]
    placed = raw.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(raw.columns, names, strict=True)), F.struct("_metadata.file_path", "_metadata.file_block_start").alias("_block"))
    return numbered(placed, "row_index", "_block").drop("_block").where(F.col("row_index") > start)


def numbered(rows: DataFrame, column: str, block: str | None = None) -> DataFrame:
    """``rows`` numbered from 1 in reading order: their places within blocks, and counts of the blocks before (a row for each block).

    A block is a partition, or what ``block`` names; blocks come in its order, and the rows of one in one partition.
    """
    placed = rows.withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33) if block is None else F.col(block)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), "_first")
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(column, F.col("_before") + F.col("_id") - F.col("_first") + 1).drop("_part", "_before", "_first", "_id")


def read_pages(spark: SparkSession, path: str, items: str = "$.items") -> DataFrame:
    """page, position, item of the pages ``<path>/<page>.json`` (or ``<path>/page=<page>/...``) of a paged JSON service, up to the first that is
    missing, empty or an error.

    ``items`` is the JSON path of the list in a page. Pages are read by Spark, one row each.
    """
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    number = F.regexp_replace(F.regexp_extract(F.col("_metadata.file_path"), "(?:[0-9]+[.]json|page=[0-9]+/[^/]*)$", 0), "^page=|[./].*$", "")
    return connected_pages(files.select(number.try_cast("int").alias("page"), "value"), items)


def connected_pages(pages: DataFrame, items: str) -> DataFrame:
    """page, position, item of pages (page, value), from the first one to the one before a gap."""
    pages = pages.select("page", F.from_json(F.get_json_object("value", items), "array<string>").alias("items"))
    good = pages.where((F.size("items") > 0) & F.col("page").isNotNull())
    nth = good.select("page", F.row_number().over(Window.orderBy("page")).alias("nth"))  # page numbers alone
    connected = nth.select("page", F.min("page").over(Window.partitionBy(F.lit(1))).alias("first"), "nth").where(F.col("page") - F.col("first") == F.col("nth") - 1).select("page")
    return good.join(F.broadcast(connected), "page", "left_semi").select("page", F.posexplode("items").alias("position", "item"))


def with_files(items: DataFrame, views: DataFrame, files: DataFrame, key: str, *fields: str) -> DataFrame:
    """A list enriched by views and by the number and size of its files; either may be missing."""
    sums = files.groupBy(key).agg(F.count("*").alias("n_files"), F.sum("size").alias("total_size"))
    return with_details(items, views, key, *fields).join(sums, key, "left").withColumn("n_files", F.coalesce("n_files", F.lit(0)))


def catalogue(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A catalogue that is kept in code."""
    return spark.createDataFrame(rows, schema)


def read_yaml(spark: SparkSession, path: str, name: str = "([^/]+)$") -> DataFrame:
    """path (the group of ``name`` in a file's path: the file's name), record (JSON) of YAML files; files that are no mapping are left out."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    found = files.select(F.regexp_extract(F.col("_metadata.file_path"), name, 1).alias("path"), yaml_to_json("value").alias("record"))
    return found.where("record is not null")


@F.pandas_udf(T.StringType())
def yaml_to_json(s: pd.Series) -> pd.Series:
    """A mapping in YAML as JSON."""
    import yaml

    def one(x):
        try:
            value = yaml.safe_load(x)
        except yaml.YAMLError:
            return None
        return json.dumps(value, ensure_ascii=False, default=str) if isinstance(value, dict) else None

    return s.map(one)


@F.pandas_udf(T.StringType())
def decoded(s: pd.Series) -> pd.Series:
    """Text of a page's bytes: Korean EUC, or UTF-8 where they are no EUC."""

    def one(b):
        try:
            return bytes(b).decode("euc-kr")
        except UnicodeDecodeError:
            return bytes(b).decode("utf-8", "replace")

    return s.map(lambda b: None if b is None else one(b))


def locale_variants(url: Column) -> Column:
    """The addresses to try for a list page: as given, and in the other language (with or without /en)."""
    path = F.regexp_extract(url, "^[^:]+://[^/]+([^?#]*)", 1)
    other = F.when(path.contains("/en/"), F.regexp_replace(url, "^([^:]+://[^/]+[^?#]*?)/en/", "$1/")).when(path.startswith("/tcs/"), F.regexp_replace(url, "^([^:]+://[^/]+)/", "$1/en/"))
    return F.array_distinct(F.array_compact(F.array(url, other)))


def crawl_lists(pages: DataFrame, key: str, page: str, start: int) -> DataFrame:
    """Keys of list pages from ``start`` on, each with its first page; from page 1 where ``start`` and what follows have none."""
    late = pages.where(F.col(page) >= start)
    any_late = late.agg((F.count(key) > 0).alias("_any"))
    seen = pages.join(F.broadcast(any_late), ~F.col("_any") | (F.col(page) >= start)).drop("_any")  # one row
    return seen.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(page).alias(page))


def detail_links(pages: DataFrame, column: str, pattern: str, key: str) -> DataFrame:
    """The distinct detail links of list pages, each with its key and the first page that has it."""
    found = links(pages, column, pattern).withColumn("source_key", F.regexp_extract("link", key, 1)).where("source_key <> ''")
    return found.groupBy("source_key").agg(F.min_by("link", F.struct("page_id", "link")).alias("link"), F.min("page_id").alias("page_id"))


def missing_embeddings(rows: DataFrame, chunks: DataFrame, key: str, again: bool = False, source: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows without chunks (all of them if ``again``), of one source if asked, the first ``limit`` by key."""
    if source is not None:
        rows = rows.where(F.col("source") == source)
    if not again:
        rows = rows.join(chunks.select(key), key, "left_anti")
    return rows if limit is None else rows.orderBy(key).limit(limit)


def after_key(rows: DataFrame, key: str, last: object, index: str = "row_index") -> DataFrame:
    """Rows that come after the one with key ``last``; all rows where that is unknown."""
    at = rows.where(F.col(key) == F.lit(last)).agg(F.coalesce(F.max(index), F.lit(0)).alias("_at"))
    return rows.join(F.broadcast(at), F.col(index) > F.col("_at")).drop("_at")


def existing_table(spark: SparkSession, preferred: str, fallback: str) -> str:
    """The table name that there is."""
    return preferred if spark.catalog.tableExists(preferred) else fallback


def write_known(rows: DataFrame, sources: DataFrame, path: str, source: str = "source") -> DataFrame:
    """Writes the rows of known sources, a folder each; returns how many rows of unknown ones were left out, by source."""
    write_by_source(rows.join(sources.select(source), source, "left_semi"), path, source)
    return rows.join(sources.select(source), source, "left_anti").groupBy(source).agg(F.count("*").alias("failed"))


def with_details(items: DataFrame, details: DataFrame, key: str, *fields: str) -> DataFrame:
    """A list enriched by details where there are any; the list's own fields stand in."""
    joined = items.alias("l").join(details.alias("d"), key, "left")
    rest = [F.col(f"l.{c}") for c in items.columns if c != key and c not in fields]
    return joined.select(key, *rest, *(F.coalesce(F.col(f"d.{f}"), F.col(f"l.{f}")).alias(f) for f in fields))


def links(pages: DataFrame, column: str, pattern: str) -> DataFrame:
    """page_id and each distinct link that fits ``pattern``."""
    found = F.array_distinct(F.regexp_extract_all(F.col(column), F.lit('href="([^"]*)"'), F.lit(1)))
    return pages.select("page_id", F.explode(F.filter(found, lambda u: u.rlike(pattern))).alias("link"))


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__()
        self.tables, self.cell = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.ArrayType(T.StringType()))))
def html_tables(s: pd.Series) -> pd.Series:
    """Tables, rows, cells of a page."""

    def one(x):
        parser = _Tables()
        parser.feed(x or "")
        return parser.tables

    return s.map(one)


class _Sections(HTMLParser):
    _KINDS = {**{f"h{i}": "heading" for i in range(1, 7)}, "p": "paragraph", "li": "paragraph", "pre": "code", "code": "code"}

    def __init__(self):
        super().__init__()
        self.found, self.open, self.text = [], [], []

    def handle_starttag(self, tag, attrs):
        if tag in self._KINDS:
            if not self.open:
                self.text = []
            self.open.append(tag)

    def handle_endtag(self, tag):
        if self.open and tag == self.open[-1]:
            self.open.pop()
            body = "".join(self.text)
            body = body.strip() if self._KINDS[tag] == "code" else " ".join(body.split())
            if not self.open and body:
                self.found.append({"kind": self._KINDS[tag], "text": body})

    def handle_data(self, data):
        if self.open:
            self.text.append(data)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())])))
def sections(s: pd.Series) -> pd.Series:
    """Headings, paragraphs and code of a documentation page, in order."""

    def one(x):
        parser = _Sections()
        parser.feed(x or "")
        return parser.found

    return s.map(one)


#: What the columns of a schema table are called.
HEADERS = {"name": ("항목명", "컬럼명", "column", "name"), "description": ("항목설명", "설명", "description"), "data_type": ("데이터타입", "타입", "type", "datatype"), "max_length": ("길이", "length", "maxlength"), "unit": ("단위", "unit")}


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in HEADERS])))
def schema_rows(s: pd.Series) -> pd.Series:
    """Rows of those tables of a page whose header names columns; cells go to the field that their header names."""
    import re

    names = {re.sub(r"[^0-9a-z가-힣]", "", a.lower()): n for n, all_ in HEADERS.items() for a in all_}

    def one(x):
        parser = _Tables()
        parser.feed(x or "")
        out = []
        for table in parser.tables:
            head = [names.get(re.sub(r"[^0-9a-z가-힣]", "", c.lower())) for c in (table[0] if table else [])]
            if "name" in head:
                out += [dict.fromkeys(HEADERS) | {h: c for h, c in zip(head, row) if h and c not in ("", "-")} for row in table[1:]]
        return out

    return s.map(one)


def last_json_line(lines: DataFrame, schema: str) -> DataFrame:
    """The summary that a run printed last: the last line that is a JSON object."""
    found = lines.where(F.trim("value").rlike(r"^\{.*\}$")).select("line_no", F.from_json("value", schema).alias("s")).where("s is not null")
    return found.orderBy(F.col("line_no").desc()).limit(1).select("s.*")


def event_lines(lines: DataFrame, name: str, schema: str) -> DataFrame:
    """Structured log lines ``<name> {json}``."""
    body = F.regexp_extract("value", rf"\b{name} (\{{.*\}})\s*$", 1)
    return lines.where(body != "").select(F.from_json(body, schema).alias("e")).select("e.*")


def write_by_source(rows: DataFrame, path: str, source: str = "source") -> None:
    """One folder for each source; the rows of a source are spread over tasks."""
    rows.write.mode("append").partitionBy(source).parquet(path)
