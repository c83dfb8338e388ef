"""Queries over token events, tenants and lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import listing as L
from ..operators import usage as U
from ..operators.paging import PageIndex
from ..storage import fresh_path, table

#: The day that counts as today, and the time that counts as now.
TODAY, NOW = "2024-01-20", "2024-01-20 12:00:00"


def _today():
    return F.lit(TODAY).cast("date")


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _events(spark, sf):
    return U.token_events(table(spark, sf, "events"))


def usage_rollup(spark, sf):
    return U.rollup_days(_events(spark, sf))


def usage_hourly(spark, sf):
    return U.rollup_hours(_events(spark, sf))


def usage_hourly_dense(spark, sf):
    return U.dense_hours(_events(spark, sf), _today())


def usage_window_7d(spark, sf):
    return U.usage_window(_events(spark, sf), _today(), 7)


def usage_window_30d(spark, sf):
    return U.usage_window(_events(spark, sf), _today(), 30)


def _clients(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("client_id")).distinct()
    return e.select(
        "client_id",
        F.when(F.col("client_id") % 3 == 0, F.lit(0)).when(F.col("client_id") % 3 == 1, F.lit(100)).otherwise(F.lit(250)).alias("daily_limit"),
        F.when(F.col("client_id") % 2 == 0, F.lit(60)).otherwise(F.lit(None).cast("int")).alias("cooldown_minutes"),
        F.when(F.col("client_id") % 10 == 7, "suspended").otherwise("active").alias("status"),
    )


def quota_status(spark, sf):
    return U.quota_status(_events(spark, sf), _clients(spark, sf), _today(), _now())


def expired_cooldowns(spark, sf):
    q = quota_status(spark, sf).select("client_id", "status", "cooldown_until")
    return U.expired_cooldowns(q, F.lit("2024-01-20 14:00:00").cast("timestamp_ntz"))


def prune_events(spark, sf):
    left = U.prune(_events(spark, sf), _now(), 14)
    return left.agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"), F.min("recorded_at").alias("oldest"))


def usage_totals(spark, sf):
    return U.totals(_events(spark, sf), _today())


def dashboard_summary(spark, sf):
    limit = 100_000
    t = _events(spark, sf).agg(
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("requests"),
        F.sum(F.when(F.col("day") == _today(), F.col("tokens")).otherwise(0)).alias("tokens_today"), F.countDistinct("client_id").alias("clients"),
    )
    return t.withColumn("usage_percent", F.round(F.col("tokens_today") / limit * 100, 2))


def prune_client(spark, sf):
    gone = _clients(spark, sf).where("status = 'suspended'")
    return U.drop_client(_events(spark, sf), gone).groupBy("client_id").agg(F.sum("tokens").alias("tokens"))


def _tenants(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("n_name").alias("client_name"),
        F.lower("c_mktsegment").alias("status"), F.col("c_acctbal").cast("long").alias("balance"),
    )


def admin_list_page(spark, sf):
    t = _tenants(spark, sf)
    found = L.search(t, "1", ["id", "name", "client_name"]).where("status = 'building'")
    return L.page(found, [L.text_order("balance", True), F.col("id")], 2, 10)


def client_list_page(spark, sf):
    return L.clamped_page(_tenants(spark, sf), [L.text_order("name", False), F.col("id")], 1000, 25)


def admin_stats(spark, sf):
    c, o, s = table(spark, sf, "customer"), table(spark, sf, "orders"), table(spark, sf, "supplier")
    a = c.agg(F.count(F.lit(1)).alias("users"), F.count_if(F.col("c_acctbal") < 0).alias("suspended"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("admins"))
    b = o.agg(F.count(F.lit(1)).alias("contexts"), F.count_if(F.col("o_orderstatus") == "F").alias("ready"))
    return a.crossJoin(b).crossJoin(s.agg(F.count(F.lit(1)).alias("bots")))  # one row each


def client_lookups(spark, sf):
    """user with counts of two kinds of objects and usage: every side is aggregated before it is joined."""
    c = table(spark, sf, "customer")
    contexts = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("contexts"))
    usage = _events(spark, sf).groupBy("client_id").agg(F.sum("tokens").alias("tokens"), F.sum(F.when(F.col("day") == _today(), F.col("tokens")).otherwise(0)).alias("today"))
    j = c.join(contexts, c.c_custkey == contexts.o_custkey, "left").join(usage, c.c_custkey == usage.client_id, "left")
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return j.select("c_custkey", zero("contexts"), zero("tokens"), zero("today"))


def anti_unconfigured(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").where("o_orderstatus = 'F'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


def bound_objects(spark, sf):
    """Objects bound to a key: as their own or as a member of their list."""
    o = table(spark, sf, "orders").withColumn("members", F.array(F.col("o_custkey") + 1, F.col("o_custkey") + 2))
    return o.where((F.col("o_custkey") == 7) | F.array_contains("members", F.lit(7).cast("long"))).select("o_orderkey", "o_custkey")


def settings_precedence(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    own = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.round("c_acctbal", 2).alias("own"))
    of_nation = n.where("n_regionkey < 3").select(F.col("n_nationkey").alias("nk"), (F.col("n_regionkey") * 100.0).alias("shared"))
    j = c.join(own, F.col("c_custkey") == F.col("k"), "left").join(of_nation, F.col("c_nationkey") == F.col("nk"), "left")
    return j.select("c_custkey", F.coalesce("own", "shared", F.lit(-1.0)).alias("setting"))


def capped_clients(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("client")).agg(F.count(F.lit(1)).alias("n"))
    most = F.when(F.col("client") % 2 == 0, F.lit(0)).otherwise(F.lit(12))
    return o.select("client", "n", ((most == 0) | (F.col("n") < most)).alias("may_add"))


def status_progress(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "indexed").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("context_id"), status.alias("status"))
    return L.progress(o, "context_id")


def snapshot_tombstones(spark, sf):
    p = table(spark, sf, "pages").select("url", F.lit("success").alias("status"), F.sha2("html", 256).alias("hash"))
    before = p.where(F.length("url") % 5 != 0)
    now = p.where(F.length("url") % 3 != 0)
    return L.snapshot_diff(before, now, "url", _now())


def upsert_latest(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return L.last_written(e, "user_id", "event_id")


def registry_upsert(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    new = c.where("id % 4 = 0").select((F.col("id") + 2).alias("id"), F.upper("name").alias("name"), F.lit(None).cast("string").alias("segment"))
    return L.upsert(c, new, "id")


def last_accessed(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("last_at"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))


_E = "e AS (SELECT event_id, user_id AS client_id, greatest(coalesce(floor(value), 0), 0)::BIGINT AS tokens, ts AS recorded_at, ts::DATE AS day, hour(ts)::INT AS hour FROM events)"
_Q = f"""{_E}, u AS (SELECT client_id, sum(tokens)::BIGINT AS tokens FROM e WHERE day = DATE '{TODAY}' GROUP BY 1),
c AS (SELECT DISTINCT user_id AS client_id, CASE user_id % 3 WHEN 0 THEN 100000 WHEN 1 THEN 100 ELSE 250 END AS l, CASE WHEN user_id % 2 = 0 THEN 60 ELSE 1440 END AS m, user_id % 10 = 7 AS s FROM events),
j AS (SELECT c.*, coalesce(tokens, 0) AS t FROM c LEFT JOIN u USING (client_id)),
q AS (SELECT *, CASE WHEN s THEN 'suspended' WHEN t >= l THEN 'cooldown' WHEN t / l * 100 >= 90 THEN 'limited' ELSE 'active' END AS status FROM j),
k AS (SELECT client_id, t AS tokens_used, l::BIGINT AS daily_limit, greatest(l - t, 0)::BIGINT AS tokens_left, round(t::DOUBLE / l * 100, 2) AS usage_percent, status,
  CASE WHEN status = 'cooldown' THEN TIMESTAMP '{NOW}' + m * INTERVAL 1 MINUTE END AS cooldown_until, status NOT IN ('suspended', 'cooldown') AS allowed FROM q)"""
_WINDOW = """WITH {e}, g AS (SELECT DISTINCT client_id, d::DATE AS day FROM e, (SELECT unnest(generate_series(DATE '{t}' - {n}, DATE '{t}', INTERVAL 1 DAY)) AS d)),
u AS (SELECT client_id, day, sum(tokens)::BIGINT AS tokens, count(*) AS requests FROM e GROUP BY 1, 2)
SELECT client_id, day, coalesce(tokens, 0) AS tokens, coalesce(requests, 0) AS requests FROM g LEFT JOIN u USING (client_id, day)"""
_T = "t AS (SELECT c_custkey AS id, c_name AS name, n_name AS client_name, lower(c_mktsegment) AS status, trunc(c_acctbal)::BIGINT AS balance FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)"

DEEP_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def deep_list_page(spark, sf):
    """Page 1,000 of all items by a column of three values, read from the ranges that hold it."""
    rows = table(spark, sf, "lineitem").select("l_returnflag", *DEEP_ORDER)
    return PageIndex.build(rows, fresh_path(spark, "page-index"), "l_returnflag", list(DEEP_ORDER), descending=True).page(1000, 25)


QUERIES = {
    "deep_list_page": (
        deep_list_page,
        """WITH r AS (SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, count(*) OVER () AS total,
        row_number() OVER (ORDER BY lower(l_returnflag) DESC NULLS LAST, l_orderkey NULLS FIRST, l_linenumber NULLS FIRST, l_partkey NULLS FIRST, l_suppkey NULLS FIRST, l_extendedprice NULLS FIRST) AS n FROM lineitem),
        p AS (SELECT *, greatest(1, ceil(total / 25))::INT AS pages, least(1000, greatest(1, ceil(total / 25)))::INT AS page FROM r)
        SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, total, page, pages FROM p WHERE n > (page - 1) * 25 AND n <= page * 25""",
    ),
    "usage_rollup": (usage_rollup, f"WITH {_E} SELECT day, client_id, sum(tokens)::BIGINT AS tokens, count(*) AS requests FROM e GROUP BY 1, 2"),
    "usage_hourly": (usage_hourly, f"WITH {_E} SELECT day, client_id, hour, sum(tokens)::BIGINT AS tokens, count(*) AS requests FROM e GROUP BY 1, 2, 3"),
    "usage_hourly_dense": (
        usage_hourly_dense,
        f"""WITH {_E}, d AS (SELECT * FROM e WHERE day = DATE '{TODAY}'), g AS (SELECT DISTINCT client_id, h::INT AS hour FROM d, range(24) r(h)),
        u AS (SELECT client_id, hour, sum(tokens)::BIGINT AS tokens, count(*) AS requests FROM d GROUP BY 1, 2)
        SELECT client_id, hour, coalesce(tokens, 0) AS tokens, coalesce(requests, 0) AS requests FROM g LEFT JOIN u USING (client_id, hour)""",
    ),
    "usage_window_7d": (usage_window_7d, _WINDOW.format(e=_E, t=TODAY, n=6)),
    "usage_window_30d": (usage_window_30d, _WINDOW.format(e=_E, t=TODAY, n=29)),
    "quota_status": (quota_status, f"WITH {_Q} SELECT * FROM k"),
    "expired_cooldowns": (
        expired_cooldowns,
        f"""WITH {_Q} SELECT client_id, CASE WHEN status = 'cooldown' AND cooldown_until <= TIMESTAMP '2024-01-20 14:00:00' THEN 'active' ELSE status END AS status,
        CASE WHEN cooldown_until > TIMESTAMP '2024-01-20 14:00:00' THEN cooldown_until END AS cooldown_until FROM k""",
    ),
    "prune_events": (
        prune_events,
        f"WITH {_E} SELECT count(*) AS n, sum(event_id)::BIGINT AS ids, min(recorded_at) AS oldest FROM e WHERE recorded_at >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY OR recorded_at IS NULL",
    ),
    "usage_totals": (
        usage_totals,
        f"""WITH {_E} SELECT client_id, sum(tokens)::BIGINT AS tokens, count(*) AS requests, sum(CASE WHEN day = DATE '{TODAY}' THEN tokens ELSE 0 END)::BIGINT AS tokens_today,
        count(*) FILTER (day = DATE '{TODAY}') AS requests_today FROM e GROUP BY ROLLUP (client_id)""",
    ),
    "dashboard_summary": (
        dashboard_summary,
        f"""WITH {_E}, a AS (SELECT sum(tokens)::BIGINT AS tokens, count(*) AS requests, sum(CASE WHEN day = DATE '{TODAY}' THEN tokens ELSE 0 END)::BIGINT AS tokens_today,
        count(DISTINCT client_id) AS clients FROM e) SELECT *, round(tokens_today::DOUBLE / 100000 * 100, 2) AS usage_percent FROM a""",
    ),
    "prune_client": (prune_client, f"WITH {_E} SELECT client_id, sum(tokens)::BIGINT AS tokens FROM e WHERE client_id % 10 <> 7 GROUP BY 1"),
    "admin_list_page": (
        admin_list_page,
        f"""WITH {_T} SELECT * FROM t WHERE contains(lower(id || ' ' || name || ' ' || coalesce(client_name, '')), '1') AND status = 'building'
        ORDER BY lower(balance::VARCHAR) DESC NULLS LAST, id LIMIT 10 OFFSET 10""",
    ),
    "client_list_page": (
        client_list_page,
        f"""WITH {_T}, n AS (SELECT count(*) AS total, greatest(1, ceil(count(*) / 25))::INT AS pages FROM t)
        SELECT t.*, total, least(1000, pages) AS page, pages FROM t, n ORDER BY lower(name) NULLS FIRST, id LIMIT 25 OFFSET (SELECT (least(1000, pages) - 1) * 25 FROM n)""",
    ),
    "admin_stats": (
        admin_stats,
        """SELECT (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS suspended, (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS admins,
        (SELECT count(*) FROM orders) AS contexts, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS ready, (SELECT count(*) FROM supplier) AS bots""",
    ),
    "client_lookups": (
        client_lookups,
        f"""WITH {_E}, o AS (SELECT o_custkey, count(*) AS contexts FROM orders GROUP BY 1), u AS (SELECT client_id, sum(tokens)::BIGINT AS tokens, sum(CASE WHEN day = DATE '{TODAY}' THEN tokens ELSE 0 END)::BIGINT AS today FROM e GROUP BY 1)
        SELECT c_custkey, coalesce(contexts, 0) AS contexts, coalesce(tokens, 0) AS tokens, coalesce(today, 0) AS today FROM customer LEFT JOIN o ON c_custkey = o_custkey LEFT JOIN u ON c_custkey = client_id""",
    ),
    "anti_unconfigured": (anti_unconfigured, "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"),
    "bound_objects": (bound_objects, "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (7, 6, 5)"),
    "settings_precedence": (
        settings_precedence,
        """SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(c_acctbal, 2) WHEN n_regionkey < 3 THEN n_regionkey * 100.0::DOUBLE ELSE -1.0::DOUBLE END AS setting
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    ),
    "capped_clients": (capped_clients, "SELECT o_custkey AS client, count(*) AS n, o_custkey % 2 = 0 OR count(*) < 12 AS may_add FROM orders GROUP BY 1"),
    "status_progress": (
        status_progress,
        """WITH c AS (SELECT o_custkey AS context_id, count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus = 'F') AS indexed,
        count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) AS failed FROM orders GROUP BY 1)
        SELECT *, total - pending AS processed, CASE WHEN pending = 0 AND indexed > 0 THEN 'ready' WHEN indexed > 0 THEN 'partially_ready' ELSE 'ingesting' END AS state FROM c""",
    ),
    "snapshot_tombstones": (
        snapshot_tombstones,
        f"""WITH p AS (SELECT url, sha256(html) AS hash, length(url) % 5 <> 0 AS b, length(url) % 3 <> 0 AS n FROM pages)
        SELECT url, CASE WHEN n THEN 'success' ELSE 'tombstoned' END AS status, hash, CASE WHEN NOT n THEN TIMESTAMP '{NOW}' END AS tombstoned_at FROM p WHERE b OR n""",
    ),
    "upsert_latest": (upsert_latest, "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1"),
    "registry_upsert": (
        registry_upsert,
        """WITH c AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer), n AS (SELECT id + 2 AS id, upper(name) AS name FROM c WHERE id % 4 = 0)
        SELECT coalesce(n.id, c.id) AS id, coalesce(n.name, c.name) AS name, c.segment FROM c FULL JOIN n ON c.id = n.id""",
    ),
    "last_accessed": (last_accessed, "SELECT user_id, max(ts) AS last_at, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1"),
}
