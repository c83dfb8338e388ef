"""Readers and writers for the file formats around a website corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import is_english_url, is_valid_url, snapshot_name
from ..storage import persisted

CHUNK_FIELDS = (
    "url", "title", "section", "source_section", "content_type", "parent_chunk_id", "split_index", "split_count",
    "source_file", "document_hash", "token_count", "chatbot_id", "namespace", "context_id", "tenant_id",
)
_CHUNK_JSON = (
    "chunk_id string, content string, raw_content string, heading_path array<string>, url string, title string, section string, source_section string, content_type string, "
    "parent_chunk_id string, split_index int, split_count int, source_file string, document_hash string, token_count int, chatbot_id string, namespace string, context_id string, tenant_id string"
)


def read_html_files(spark: SparkSession, folder: str, pattern: str = "*.html") -> DataFrame:
    """path, html of all files below the folder whose names fit; the order is that of the path."""
    raw = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(folder, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def read_chunks(spark: SparkSession, folder: str, overrides: dict[str, str] | None = None, prefix: str = "", pattern: str = "*.chunks.json") -> DataFrame:
    """Chunk records of JSON files: chunk_id, content, metadata.

    Files that aren't JSON lists of objects give nothing; records without id or
    content go; overrides replace metadata; a prefix goes before the id.
    """
    raw = spark.read.schema(_CHUNK_JSON).option("multiLine", "true").option("mode", "PERMISSIVE").option("pathGlobFilter", pattern).json(folder)
    rows = raw.where((F.coalesce(F.trim("chunk_id"), F.lit("")) != "") & (F.coalesce(F.trim("content"), F.lit("")) != ""))
    for k, v in (overrides or {}).items():
        rows = rows.withColumn(k, F.lit(v))
    chunk_id = F.concat(F.lit(f"{prefix}:"), "chunk_id") if prefix else F.col("chunk_id")
    return rows.select(chunk_id.alias("chunk_id"), "content", chunk_metadata().alias("metadata"))


def chunk_metadata() -> Column:
    """The scalar fields that aren't empty, and the heading path as one text."""
    path = F.array_join(F.filter("heading_path", lambda h: F.trim(h) != ""), " > ")
    pairs = [F.struct(F.lit(k).alias("k"), F.col(k).cast("string").alias("v")) for k in CHUNK_FIELDS]
    pairs.append(F.struct(F.lit("heading_path").alias("k"), path.alias("v")))
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["v"].isNotNull() & (p["v"] != "")))


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> ''")


def read_sitemap(spark: SparkSession, path: str, english_only: bool = False) -> DataFrame:
    """Distinct valid page URLs of sitemap files (one level; nested sitemaps are ``read_sitemap_index``)."""
    rows = spark.read.format("xml").option("rowTag", "url").schema("loc string").load(path)
    urls = rows.select(F.trim("loc").alias("url")).where(is_valid_url(F.col("url")))
    return (urls.where(is_english_url(F.col("url"))) if english_only else urls).distinct()


def read_sitemap_index(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", "sitemap").schema("loc string").load(path)
    return rows.select(F.trim("loc").alias("sitemap")).where(is_valid_url(F.col("sitemap"))).distinct()


def _locations(xml: Column, element: str) -> Column:
    found = F.regexp_extract_all(xml, F.lit(rf"(?s)<{element}\b[^>]*>\s*(?:<(?!loc\b)[^>]*>[^<]*</[^>]*>\s*)*<loc>\s*(.*?)\s*</loc>"), 1)
    return F.transform(found, lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))


def sitemap_tree(files: DataFrame, root: str, english_only: bool = False) -> DataFrame:
    """Distinct valid page URLs of the sitemap ``root`` and of all that it names, directly or through others.

    files: name, xml; a sitemap's name is the last part of its URL.  Each is
    visited once, so sitemaps may name each other; those that are missing or
    broken give nothing.
    """
    name = lambda url: F.regexp_extract(url, r"([^/?#]+)(?:[?#].*)?$", 1)
    files = persisted(files.select("name", _locations(F.col("xml"), "sitemap").alias("children"), _locations(F.col("xml"), "url").alias("pages")), "sitemaps")
    frontier = visited = files.sparkSession.createDataFrame([(root,)], "name string")
    while frontier.head() is not None:
        nxt = files.join(frontier, "name", "left_semi").select(F.explode("children").alias("u")).where(is_valid_url(F.col("u"))).select(name(F.col("u")).alias("name"))
        frontier = persisted(nxt.distinct().join(visited, "name", "left_anti"), "sitemap-frontier")
        visited = persisted(visited.unionByName(frontier), "sitemaps-visited")
    urls = files.join(visited, "name", "left_semi").select(F.explode("pages").alias("url")).where(is_valid_url(F.col("url")))
    return (urls.where(is_english_url(F.col("url"))) if english_only else urls).distinct()


def read_sitemap_tree(spark: SparkSession, folder: str, root: str, english_only: bool = False) -> DataFrame:
    """``sitemap_tree`` over the *.xml files of a folder."""
    raw = spark.read.option("pathGlobFilter", "*.xml").text(folder, wholetext=True)
    return sitemap_tree(raw.select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("xml")), root, english_only)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The crawl manifest, one JSON map keyed by URL, as rows; a broken file gives none."""
    entry = "map<string,struct<url:string,status:string,output_path:string,content_hash:string,last_crawled_at:string,tombstoned_at:string>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", entry).alias("m"))
    return raw.select(F.explode("m").alias("key", "e")).select(F.coalesce("e.url", "key").alias("url"), "e.status", "e.output_path", "e.content_hash", "e.last_crawled_at", "e.tombstoned_at")


def read_benchmark_queries(spark: SparkSession, path: str) -> DataFrame:
    """query, expected terms in lower case; incomplete entries go."""
    raw = spark.read.schema("query string, expected_terms array<string>").option("multiLine", "true").json(path)
    terms = F.transform(F.filter("expected_terms", lambda t: F.trim(t) != ""), lambda t: F.lower(F.trim(t)))
    return raw.select(F.trim("query").alias("query"), terms.alias("terms")).where((F.coalesce("query", F.lit("")) != "") & (F.size("terms") > 0))


def write_pages(pages: DataFrame, path: str) -> None:
    """url, html as snapshots with their file name, partitioned by host-independent name prefix."""
    named = pages.withColumn("file_name", snapshot_name(F.col("url"))).withColumn("bucket", F.substring(F.sha2("url", 256), 1, 2))
    named.write.mode("overwrite").partitionBy("bucket").parquet(path)


def append_audit(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def write_urls(urls: DataFrame, path: str) -> None:
    """Trimmed distinct URLs, in the order of their first position."""
    clean = urls.select(F.trim("url").alias("url"), "position").where("url <> ''")
    clean.groupBy("url").agg(F.min("position").alias("p")).orderBy("p").select("url").write.mode("overwrite").text(path)


def upsert_index(index: DataFrame, records: DataFrame, path: str) -> None:
    """The index with ``records`` in place of rows of the same chunk_id, as a new table."""
    rest = index.join(records.select("chunk_id"), "chunk_id", "left_anti")
    rest.unionByName(records).write.mode("overwrite").parquet(path)


def rebuild_index(records: DataFrame, path: str) -> None:
    """An index of ``records`` alone, the last of each chunk_id by ``position``; what was at the path goes."""
    last = records.groupBy("chunk_id").agg(F.max_by(F.struct("content", "metadata"), "position").alias("r"))
    last.select("chunk_id", "r.content", "r.metadata").write.mode("overwrite").parquet(path)


def export_rows(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """Documents or chunks as Parquet, or as JSON, one object to a line."""
    if kind not in ("parquet", "json"):
        raise ValueError(f"no export as {kind}")
    rows.write.mode("overwrite").format(kind).save(path)


def delete_where(index: DataFrame, **equal: str) -> DataFrame:
    """The index without rows whose metadata equals all the given values."""
    hit = F.lit(True)
    for k, v in equal.items():
        hit = hit & F.coalesce(F.element_at("metadata", k) == v, F.lit(False))
    return index.where(~hit)
