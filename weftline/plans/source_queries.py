"""Queries that write a table in one of the file formats and read it back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import files as S
from ..sources.keyed_table import KeyedTable
from ..storage import fresh_path, table

#: Records in one made JSON file.
PER_FILE = 100


def source_html_files(spark, sf):
    """Pages, one file each, as read back."""
    path = fresh_path(spark, "html-files")
    table(spark, sf, "pages").select("html").write.option("maxRecordsPerFile", 1).option("lineSep", "\u0000").text(path)
    read = S.read_html_files(spark, path, "*.txt").select(F.md5(F.replace("html", F.lit("\u0000"), F.lit(""))).alias("html_md5"))
    return read.groupBy("html_md5").agg(F.count(F.lit(1)).alias("n"))


def _arrays(df, group, record, path):
    """JSON arrays of at most PER_FILE records, one array to a file."""
    packed = df.groupBy(group.alias("g")).agg(F.to_json(F.collect_list(record)).alias("value"))
    packed.select("value").write.option("maxRecordsPerFile", 1).text(path)


def _chunk_files(spark, sf):
    path = fresh_path(spark, "chunk-files")
    record = F.struct(
        F.format_string("c%d", "doc_id").alias("chunk_id"), F.col("text").alias("content"), F.array(F.lit("Docs"), F.lit(" "), F.col("source")).alias("heading_path"),
        F.lit("").alias("title"), F.col("n_chars").cast("int").alias("token_count"), F.lit("own").alias("namespace"), F.lit(0).alias("split_index"),
    )
    d = table(spark, sf, "documents")
    _arrays(d, F.floor(F.col("doc_id") / PER_FILE), record, path)
    return S.read_chunks(spark, path, {"namespace": "all"}, "site", "*.txt")


def source_chunk_records(spark, sf):
    m = lambda k: F.element_at("metadata", k).alias(k)
    return _chunk_files(spark, sf).select("chunk_id", F.md5("content").alias("content_md5"), m("heading_path"), m("token_count"), m("namespace"), m("title"), F.size("metadata").alias("n_fields"))


def source_urls(spark, sf):
    """URLs with blanks and repeats around them, written and read."""
    path = fresh_path(spark, "urls")
    urls = table(spark, sf, "pages").select(F.explode(F.array(F.col("url"), F.concat(F.lit(" "), "url", F.lit(" ")), F.lit("  "))).alias("url"), F.col("page_id").alias("position"))
    S.write_urls(urls, path)
    return S.read_urls(spark, path)


def source_sitemap_tree(spark, sf):
    """Six sitemaps that name each other in a ring and one that nothing names; pages are dealt by their number."""
    path = fresh_path(spark, "sitemaps")
    host = "https://maps.example.com/"
    page = F.concat(F.lit("<url><lastmod>2024-01-01</lastmod><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url>"))
    part = F.floor(F.col("page_id") / PER_FILE)
    pages = table(spark, sf, "pages").groupBy((F.col("page_id") % 7).alias("k"), part.alias("part")).agg(F.array_join(F.collect_list(page), "\n").alias("xml"))
    leaf = pages.select(F.format_string("map%d-%d.xml", "k", "part").alias("name"), F.concat(F.lit("<urlset>"), "xml", F.lit("</urlset>")).alias("xml"), "k")
    loc = lambda n: F.concat(F.lit(f"<sitemap><loc>{host}"), n, F.lit("</loc></sitemap>"))
    index = leaf.groupBy("k").agg(F.array_join(F.collect_list(loc(F.col("name"))), "").alias("xml"))
    ring = index.select(F.format_string("ring%d.xml", "k").alias("name"), F.concat(F.lit("<sitemapindex>"), "xml", loc(F.format_string("ring%d.xml", (F.col("k") + 1) % 6)), F.lit("</sitemapindex>")).alias("xml"))
    leaf.select("name", "xml").unionByName(ring).write.partitionBy("name").text(path)
    files = spark.read.schema("value string, name string").text(path, wholetext=True)
    return S.sitemap_tree(files.select("name", F.col("value").alias("xml")), "ring0.xml")


def source_manifest(spark, sf):
    path = fresh_path(spark, "manifest")
    entry = F.struct(F.col("url").alias("key"), F.struct(F.when(F.col("page_id") % 3 > 0, F.col("url")).alias("url"), F.lit("ok").alias("status"), F.md5("html").alias("content_hash")).alias("value"))
    # a map holds a URL once: its further pages go to further files
    again = F.row_number().over(Window.partitionBy("g", "url").orderBy("page_id"))
    pages = table(spark, sf, "pages").withColumn("g", F.floor(F.col("page_id") / PER_FILE)).withColumn("again", again)
    pages = pages.groupBy("g", "again").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    pages.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return S.read_manifest(spark, path).select("url", "status", "content_hash", "tombstoned_at")


def source_benchmark_queries(spark, sf):
    path = fresh_path(spark, "benchmark-queries")
    words = F.split("text", " ")
    record = F.struct(F.concat(F.lit("  "), F.when(F.col("item_id") % 5 > 0, F.col("text")).otherwise(""), F.lit(" ")).alias("query"), F.array(F.lit(" "), F.upper(words[0]), F.lit("")).alias("expected_terms"))
    _arrays(table(spark, sf, "benchmark"), F.floor(F.col("item_id") / PER_FILE), record, path)
    return S.read_benchmark_queries(spark, path).select("query", F.array_join("terms", "|").alias("terms"))


def sink_snapshots(spark, sf):
    path = fresh_path(spark, "snapshots")
    S.write_pages(table(spark, sf, "pages").select("url", "html"), path)
    return spark.read.parquet(path).select("url", F.regexp_extract("file_name", r"_([0-9a-f]{10})\.html$", 1).alias("tail"), F.md5("html").alias("html_md5"))


def sink_audit(spark, sf):
    """Turns appended in two goes."""
    path = fresh_path(spark, "audit")
    turns = table(spark, sf, "conversations")
    for even in (0, 1):
        S.append_audit(turns.where(F.col("turn") % 2 == even).select("conv_id", "turn", "role", F.md5("text").alias("text_md5")), path)
    read = spark.read.schema("conv_id long, turn long, role string, text_md5 string").json(path)
    return read.select("conv_id", "turn", "role", "text_md5")


def _records(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content"), F.create_map(F.lit("source"), F.coalesce("source", F.lit("")), F.lit("lang"), "lang").alias("metadata"), F.col("doc_id").alias("position")
    )


def sink_index(spark, sf):
    """An index built, with every tenth record replaced and as many added, and then without French records."""
    first, second = fresh_path(spark, "index"), fresh_path(spark, "index")
    rows = _records(spark, sf)
    again = rows.withColumn("content", F.lit("older")).withColumn("position", F.lit(-1).cast("long"))
    S.rebuild_index(rows.unionByName(again), first)
    every = rows.where(F.col("position") % 10 == 0)
    changed = every.withColumn("content", F.lit("changed")).unionByName(every.withColumn("chunk_id", F.concat(F.lit("n"), "chunk_id")))
    S.upsert_index(spark.read.parquet(first), changed.drop("position"), second)
    left = S.delete_where(spark.read.parquet(second), lang="fr")
    return left.select("chunk_id", F.md5("content").alias("content_md5"))


def sink_keyed_table(spark, sf):
    """The changes of ``sink_index`` as generations of a keyed table, opened again between them, compacted in part."""
    path = fresh_path(spark, "keyed-table")
    rows = _records(spark, sf)
    again = rows.withColumn("content", F.lit("older")).withColumn("position", F.lit(-1).cast("long"))
    KeyedTable.create(rows.unionByName(again), path, "chunk_id", 16, F.col("position"))
    every = rows.where(F.col("position") % 10 == 0)
    KeyedTable.open(spark, path).upsert(every.withColumn("content", F.lit("draft")))
    KeyedTable.open(spark, path).upsert(every.withColumn("content", F.lit("changed")).unionByName(every.withColumn("chunk_id", F.concat(F.lit("n"), "chunk_id"))), compact_at=2)
    left = KeyedTable.open(spark, path).delete_where(F.element_at("metadata", F.lit("lang")) == "fr").read()
    return left.select("chunk_id", F.md5("content").alias("content_md5"))


def sink_export(spark, sf):
    """Documents as JSON lines and as Parquet."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", F.md5("text").alias("text_md5"))
    out = []
    for kind in ("json", "parquet"):
        path = fresh_path(spark, "export")
        S.export_rows(d, path, kind)
        out.append(spark.read.schema("doc_id long, lang string, source string, text_md5 string").format(kind).load(path).withColumn("kind", F.lit(kind)))
    return out[0].unionByName(out[1])


#: DuckDB maps each character to one; letters whose capitals are several, like ß, are spelled out.
_LOWER_OF_UPPER = "split_part(text, ' ', 1)"
for _c in filter(lambda c: len(c.upper()) > 1, map(chr, [*range(0xD800), *range(0xE000, 0x10000)])):
    _LOWER_OF_UPPER = f"replace({_LOWER_OF_UPPER}, '{_c}', '{_c.upper()}')"
_LOWER_OF_UPPER = f"lower(upper({_LOWER_OF_UPPER}))"

QUERIES = {
    "source_html_files": (source_html_files, "SELECT md5(html) AS html_md5, count(*) AS n FROM pages GROUP BY 1"),
    "source_chunk_records": (
        source_chunk_records,
        r"""SELECT 'site:c' || doc_id AS chunk_id, md5(text) AS content_md5, CASE WHEN trim(coalesce(source, '')) = '' THEN 'Docs' ELSE 'Docs > ' || source END AS heading_path,
        n_chars::VARCHAR AS token_count, 'all' AS namespace, NULL::VARCHAR AS title, (3 + (n_chars IS NOT NULL)::INT)::INT AS n_fields FROM documents WHERE trim(coalesce(text, ''), ' ') <> ''""",
    ),
    "source_urls": (source_urls, "SELECT DISTINCT trim(url) AS url FROM pages WHERE trim(url) <> ''"),
    "source_sitemap_tree": (source_sitemap_tree, "SELECT DISTINCT url FROM pages WHERE page_id % 7 < 6"),
    "source_manifest": (source_manifest, "SELECT url, 'ok' AS status, md5(html) AS content_hash, NULL::VARCHAR AS tombstoned_at FROM pages"),
    "source_benchmark_queries": (
        source_benchmark_queries,
        f"SELECT trim(text) AS query, {_LOWER_OF_UPPER} AS terms FROM benchmark WHERE item_id % 5 > 0 AND trim(text) <> '' AND split_part(text, ' ', 1) <> ''",
    ),
    "sink_snapshots": (sink_snapshots, "SELECT url, substr(sha256(url), 1, 10) AS tail, md5(html) AS html_md5 FROM pages"),
    "sink_audit": (sink_audit, "SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations"),
    "sink_index": (
        sink_index,
        """SELECT doc_id::VARCHAR AS chunk_id, md5(CASE WHEN doc_id % 10 = 0 THEN 'changed' ELSE text END) AS content_md5 FROM documents WHERE lang IS DISTINCT FROM 'fr'
        UNION ALL SELECT 'n' || doc_id, md5(text) FROM documents WHERE doc_id % 10 = 0 AND lang IS DISTINCT FROM 'fr'""",
    ),
    "sink_keyed_table": (
        sink_keyed_table,
        """SELECT doc_id::VARCHAR AS chunk_id, md5(CASE WHEN doc_id % 10 = 0 THEN 'changed' ELSE text END) AS content_md5 FROM documents WHERE lang IS DISTINCT FROM 'fr'
        UNION ALL SELECT 'n' || doc_id, md5(text) FROM documents WHERE doc_id % 10 = 0 AND lang IS DISTINCT FROM 'fr'""",
    ),
    "sink_export": (sink_export, "SELECT doc_id, lang, source, md5(text) AS text_md5, k AS kind FROM documents, (VALUES ('json'), ('parquet')) AS t(k)"),
}
