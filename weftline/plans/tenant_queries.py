"""Queries over tenants and their objects, made from customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import listing as L
from ..operators import tenants as N
from ..storage import table

_STATES = ("ready", "partially_ready", "paused", "failed", "odd")


def _objects(spark, sf):
    """Contexts of tenants: an order's number, its customer and a state."""
    o = table(spark, sf, "orders")
    state = F.element_at(F.array(*map(F.lit, _STATES)), (F.col("o_orderkey") % len(_STATES) + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("object_id"), F.col("o_custkey").alias("client_id"), F.when(F.col("o_orderkey") % 11 != 0, state).alias("status"), F.col("o_orderdate").alias("at"))


def _clients(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("client_id"), F.when(F.col("c_acctbal") < 0, "disabled").otherwise("active").alias("status"))


def context_readiness(spark, sf):
    return _objects(spark, sf).select("object_id", N.searchable_together(F.col("status")).alias("together"), N.searchable_alone(F.col("status")).alias("alone"))


def seed_url_lookup(spark, sf):
    """Contexts that share sites, asked for by URLs in another form, some of them unknown."""
    o, n = _objects(spark, sf), table(spark, sf, "nation")
    site = (F.col("client_id") % 20).cast("string")
    seed = F.when(F.col("object_id") % 3 == 0, F.lit("  ")).when(F.col("object_id") % 3 == 1, F.concat(F.lit(" https://SHOP"), site, F.lit(".example.com/a/ "))).otherwise(F.concat(F.lit("shop"), site))
    registry = o.select(F.col("object_id").alias("context_id"), "at", seed.alias("seed_url"))
    wanted = n.select(F.concat(F.lit("https://shop"), F.col("n_nationkey").cast("string"), F.lit(".example.com/a#top")).alias("wanted_url"))
    return L.find_by_seed_url(registry, wanted, "at")


def cascade_delete(spark, sf):
    tables = {"objects": _objects(spark, sf).select("client_id"), "clients": _clients(spark, sf).select("client_id")}
    left = N.cascade_delete(tables, _clients(spark, sf).where("status = 'disabled'"))
    rows = [t.groupBy("client_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "client_id", "n") for name, t in left.items()]
    return rows[0].unionByName(rows[1])


def disabled_objects(spark, sf):
    return N.disable_objects(_objects(spark, sf), _clients(spark, sf)).select("object_id", "client_id", "status")


def scope_backfill(spark, sf):
    o = _objects(spark, sf)
    key = F.when(F.col("client_id") % 10 == 0, F.lit(None)).when(F.col("client_id") % 10 == 1, F.lit("  ")).otherwise(F.concat(F.lit(" c"), F.col("client_id").cast("string")))
    return N.backfill_scope(o.select("object_id", key.cast("string").alias("client_id")), "main")


def quota_overrides(spark, sf):
    c = table(spark, sf, "customer")
    limit = F.element_at(F.array(F.lit("2000"), F.lit("2000.0"), F.lit("500"), F.lit("x")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return c.select("c_custkey", N.without_default(limit, 2000).alias("daily_limit"))


def latest_logs(spark, sf):
    d = table(spark, sf, "documents").select("source", F.col("doc_id").cast("string").alias("name"), (F.col("n_chars") % 1000).alias("modified"), F.coalesce("text", F.lit("")).alias("text"))
    r = N.latest_logs(d.withColumnRenamed("source", "context_id"))
    return r.select("context_id", "name", F.md5("preview").alias("preview_md5"))


def crawl_summary(spark, sf):
    p = table(spark, sf, "pages")
    status = F.element_at(F.array(*[F.lit(x) for x in ("saved", "blocked_domain", "blocked_robots", "error")]), (F.col("page_id") % 4 + 1).cast("int"))
    return N.crawl_summary(p.select(status.alias("status"), F.when(F.col("page_id") % 4 != 3, F.col("page_id") % 4 == 0).alias("success")))


def pair_checks(spark, sf):
    b = table(spark, sf, "benchmark")
    some = lambda n, r, x: F.when(F.col("item_id") % n == r, x).otherwise(F.col("text"))
    return b.select("item_id", N.pair_error(some(5, 0, F.lit("  ")), F.when(F.col("item_id") % 5 == 1, F.lit("")).otherwise(some(5, 2, F.lit(" ")))).alias("error"))


def ranking_checks(spark, sf):
    line = table(spark, sf, "lineitem")
    return N.ranking_holds(line.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), F.col("l_extendedprice").alias("score")))


def lengths(texts: list[str]) -> list[list[float]]:
    """Stands in for a model."""
    return [[float(len(t)), 1.0] for t in texts]


def embedded_questions(spark, sf):
    e = N.embed(table(spark, sf, "benchmark").select("item_id", "text"), "text", lengths, "query: ")
    return e.select("item_id", F.round(F.element_at("embedding", 1).cast("double"), 5).alias("x"), F.round(F.element_at("embedding", 2).cast("double"), 5).alias("y"))


def gateway_names(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.concat(F.lit(" HTTPS://WWW.Example.com:8443/A b/"), F.col("page_id").cast("string"), F.lit("/?q=1#top")).alias("u"))
    listed = F.array(F.lit("https://www.Example.com/x"), F.lit(" example.com:80 "), F.lit(""), F.concat(F.lit("Shop"), (F.col("page_id") % 3).cast("string"), F.lit(".org/a")))
    return p.select("page_id", U.gateway_url(F.col("u")).alias("url"), U.folder_name(F.col("u")).alias("folder"), F.array_join(U.domain_names(listed), ",").alias("domains"))


def tidy_texts(spark, sf):
    made = F.concat(F.lit("# A  \r\n\r\n\r\n\r\n"), F.coalesce("text", F.lit("")), F.lit("  \r\n\n\n\nend"))
    return table(spark, sf, "documents").select("doc_id", F.md5(T.tidy_markdown(made)).alias("markdown_md5"))


_OBJECTS = """o AS (SELECT o_orderkey AS object_id, o_custkey AS client_id, CASE WHEN o_orderkey % 11 <> 0 THEN ['ready', 'partially_ready', 'paused', 'failed', 'odd'][o_orderkey % 5 + 1] END AS status FROM orders)"""

QUERIES = {
    "context_readiness": (
        context_readiness,
        f"WITH {_OBJECTS} SELECT object_id, coalesce(status IN ('ready', 'partially_ready'), FALSE) AS together, coalesce(status NOT IN ('paused', 'failed'), TRUE) AS alone FROM o",
    ),
    "seed_url_lookup": (
        seed_url_lookup,
        """SELECT 'https://shop' || n_nationkey || '.example.com/a#top' AS wanted_url,
        (SELECT arg_min(o_orderkey, (o_orderdate, o_orderkey)) FROM orders WHERE o_orderkey % 3 = 1 AND o_custkey % 20 = n_nationkey) AS context_id FROM nation""",
    ),
    "cascade_delete": (
        cascade_delete,
        """WITH r AS (SELECT 'objects' AS name, o_custkey AS client_id FROM orders UNION ALL SELECT 'clients', c_custkey FROM customer)
        SELECT name, client_id, count(*) AS n FROM r WHERE client_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1, 2""",
    ),
    "disabled_objects": (
        disabled_objects,
        f"WITH {_OBJECTS} SELECT object_id, client_id, CASE WHEN client_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 'disabled' ELSE status END AS status FROM o",
    ),
    "scope_backfill": (
        scope_backfill,
        "SELECT o_orderkey AS object_id, CASE WHEN o_custkey % 10 < 2 THEN 'main' ELSE 'c' || o_custkey END AS client_id FROM orders",
    ),
    "quota_overrides": (quota_overrides, "SELECT c_custkey, CASE c_custkey % 4 WHEN 2 THEN '500' WHEN 3 THEN 'x' END AS daily_limit FROM customer"),
    "latest_logs": (
        latest_logs,
        """SELECT source AS context_id, doc_id::VARCHAR AS name, md5(right(coalesce(text, ''), 4000)) AS preview_md5 FROM documents
        QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars % 1000 DESC, doc_id::VARCHAR DESC) = 1""",
    ),
    "crawl_summary": (
        crawl_summary,
        """SELECT count(*) FILTER (page_id % 4 = 0) AS succeeded, count(*) FILTER (page_id % 4 <> 0) AS failed, count(*) FILTER (page_id % 4 = 1) AS blocked_domain,
        count(*) FILTER (page_id % 4 = 2) AS blocked_robots FROM pages""",
    ),
    "pair_checks": (
        pair_checks,
        "SELECT item_id, CASE item_id % 5 WHEN 0 THEN 'query must not be empty' WHEN 1 THEN 'text is missing' WHEN 2 THEN 'invalid pair' END AS error FROM benchmark",
    ),
    "ranking_checks": (
        ranking_checks,
        """SELECT query_id, NOT bool_or(coalesce(score > before, FALSE)) AS sorted FROM (SELECT l_orderkey AS query_id, l_extendedprice AS score,
        lag(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice DESC) AS before FROM lineitem) GROUP BY 1""",
    ),
    "embedded_questions": (
        embedded_questions,
        """SELECT item_id, round(((7 + length(text)) / sqrt((7 + length(text)) ** 2 + 1))::FLOAT::DOUBLE, 5) AS x, round((1 / sqrt((7 + length(text)) ** 2 + 1))::FLOAT::DOUBLE, 5) AS y FROM benchmark""",
    ),
    "gateway_names": (
        gateway_names,
        """SELECT page_id, 'https://example.com/A b/' || page_id || '?q=1' AS url,
        substr(regexp_replace(' https---www-example-com-8443-a-b-' || page_id || '--q-1-top', '^[ -]+|-+$', '', 'g'), 1, 40) AS folder, 'example.com,shop' || page_id % 3 || '.org' AS domains FROM pages""",
    ),
    "tidy_texts": (
        tidy_texts,
        r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(chr(35) || ' A  ' || chr(13) || chr(10) || repeat(chr(13) || chr(10), 3) || coalesce(text, '') || '  ' || chr(13) || repeat(chr(10), 4) || 'end',
        chr(13) || chr(10), chr(10)), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10)) || chr(10)) AS markdown_md5 FROM documents""",
    ),
    # The name under which whole texts were first compared.
    "tidy_whole_texts": (
        tidy_texts,
        r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(chr(35) || ' A  ' || chr(13) || chr(10) || repeat(chr(13) || chr(10), 3) || coalesce(text, '') || '  ' || chr(13) || repeat(chr(10), 4) || 'end',
        chr(13) || chr(10), chr(10)), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10)) || chr(10)) AS markdown_md5 FROM documents""",
    ),
}
