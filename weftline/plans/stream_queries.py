"""Queries that run streams to the end of their input, and discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.discovery import discover
from ..storage import fresh_path, table
from ..streaming import buffer as B
from ..streaming import ingest as I
from ..streaming import lifecycle as L
from ..streaming import usage as S


def stream_usage_rollup(spark, sf):
    return S.run_to_table(S.rollup_stream(S.read_stream(spark, f"{sf}/events.parquet")), ["day", "client_id"], "rollup")


def stream_quota(spark, sf):
    return S.run_to_table(S.quota_stream(S.read_stream(spark, f"{sf}/events.parquet"), 250), ["client_id"], "quota")


def stream_dedup(spark, sf):
    docs = S.dedup_stream(S.read_stream(spark, f"{sf}/documents.parquet")).select("hash")
    return S.run_to_table(docs.withColumn("n", F.lit(1)), ["hash"], "dedup").select("hash")


def stream_cooldown_sweep(spark, sf):
    """Cooldowns of ten seconds, until all have ended by their timers: who was in one, and the state of each client then."""
    path = fresh_path(spark, "cooldowns")
    out = L.sweep(L.cooldown_stream(S.read_stream(spark, f"{sf}/events.parquet"), 250, 10_000), path, f"{path}-checkpoint")
    return out.select("client_id", "day", "tokens", "status", "swept")


def stream_expiring_rollup(spark, sf):
    """The rollup from state that goes 90 days after a client's day was last touched."""
    path = fresh_path(spark, "expiring-rollup")
    return L.merged_rollup(L.run(L.expiring_rollup(S.read_stream(spark, f"{sf}/events.parquet")), path, f"{path}-checkpoint"))


def stream_ingest(spark, sf):
    path = fresh_path(spark, "ingest")
    I.ingest(S.read_stream(spark, f"{sf}/pages.parquet"), path, f"{path}-checkpoint")
    return I.index(spark, path).select("source_file", "chunk_id", "token_count", F.md5("content").alias("content_md5"))


def _letters(texts: list[str]) -> list[list[float]]:
    return [[t.count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]


def stream_embedding_buffer(spark, sf):
    """Documents through the buffer, encoded by their letters; the first source is paused, stopped with the run, and resumed in a second one.

    One row for each content of a source: how often it was embedded and met again, its vector, whether flushes kept their size, and the state of the source.
    """
    path = fresh_path(spark, "embedding-buffer")
    docs, told = table(spark, sf, "documents"), f"{path}-commands"
    first = docs.agg(F.min("source")).head()[0]
    records = S.read_stream(spark, f"{sf}/documents.parquet").select(
        F.col("source").alias("context_id"), F.col("doc_id").alias("page_id"), F.lit(1).alias("n_chunks"), F.format_string("d%d", "doc_id").alias("chunk_id"), F.col("text").alias("content")
    )
    B.command(spark, told, [(first, "pause")])
    commands = spark.readStream.schema(B.COMMAND).parquet(told)
    stream = B.embedding_stream(records, commands, _letters, hold_ms=2_000)
    held_back = docs.where(F.col("source") == F.lit(first)).count()
    rows = docs.count()
    B.run(stream, path, f"{path}-checkpoint", lambda done: done.count() >= rows - held_back)
    B.command(spark, told, [(first, "resume")])
    done = B.run(stream, path, f"{path}-checkpoint", lambda done: done.count() >= rows)
    state = B.readiness(done, docs.groupBy(F.col("source").alias("context_id")).agg(F.count_distinct("doc_id").alias("total_pages")), spark.read.schema(B.COMMAND).parquet(told))
    per = done.groupBy("context_id", "digest").agg(
        F.count_if(F.col("outcome") == "embedded").alias("embedded"), F.count_if(F.col("outcome") != "embedded").alias("others"), F.array_join(F.transform(F.first("vector", True), lambda x: x.cast("long").cast("string")), ",").alias("letters"),
        F.bool_and(F.coalesce(F.col("flush_size") <= B.FLUSH, F.lit(True)) & ~F.coalesce((F.col("reason") == "full") & (F.col("flush_size") < B.FLUSH), F.lit(False))).alias("sizes_kept"),
    )
    return per.join(state.select(F.col("context_id").alias("c"), "status"), F.col("context_id").eqNullSafe(F.col("c")), "left").drop("c")


def discovery_levels(spark, sf):
    o = table(spark, sf, "lineitem")
    links = o.select((F.col("l_suppkey") % 500).alias("source"), (F.col("l_partkey") % 997).alias("target")).where("source <> target").distinct()
    links = links.select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"))
    seeds = spark.createDataFrame([("1",)], "url string")
    return discover(links, seeds, 3)


QUERIES = {
    "stream_usage_rollup": (
        stream_usage_rollup,
        "SELECT ts::DATE AS day, user_id AS client_id, sum(greatest(coalesce(floor(value), 0), 0)::BIGINT)::BIGINT AS tokens, count(*) AS requests FROM events GROUP BY 1, 2",
    ),
    "stream_quota": (
        stream_quota,
        """WITH d AS (SELECT user_id AS client_id, strftime(ts, '%Y-%m-%d') AS day, sum(greatest(coalesce(floor(value), 0), 0)::BIGINT)::BIGINT AS tokens FROM events GROUP BY 1, 2),
        l AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY day DESC) = 1)
        SELECT client_id, day, tokens, CASE WHEN tokens >= 250 THEN 'cooldown' WHEN tokens * 100 >= 90 * 250 THEN 'limited' ELSE 'active' END AS status FROM l""",
    ),
    "stream_cooldown_sweep": (
        stream_cooldown_sweep,
        """WITH d AS (SELECT user_id AS client_id, strftime(ts, '%Y-%m-%d') AS day, sum(greatest(coalesce(floor(value), 0), 0)::BIGINT)::BIGINT AS tokens FROM events WHERE ts IS NOT NULL GROUP BY 1, 2),
        l AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY day DESC) = 1)
        SELECT client_id, day, tokens, CASE WHEN tokens < 250 AND tokens * 100 >= 90 * 250 THEN 'limited' ELSE 'active' END AS status, tokens >= 250 AS swept FROM l""",
    ),
    "stream_expiring_rollup": (
        stream_expiring_rollup,
        "SELECT strftime(ts, '%Y-%m-%d') AS day, user_id AS client_id, sum(greatest(coalesce(floor(value), 0), 0)::BIGINT)::BIGINT AS tokens, count(*) AS requests FROM events GROUP BY 1, 2",
    ),
    "stream_dedup": (stream_dedup, r"SELECT DISTINCT sha256(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))) AS hash FROM documents"),
    "stream_embedding_buffer": (
        stream_embedding_buffer,
        r"""WITH d AS (SELECT source, CASE WHEN NOT regexp_full_match(coalesce(text, ''), '[ \t\n\r\x0B\f]*') THEN text END AS t FROM documents),
        s AS (SELECT source, CASE WHEN count(t) > 0 THEN 'ready' ELSE 'failed' END AS status FROM d GROUP BY 1)
        SELECT d.source AS context_id, sha256(t) AS digest, (t IS NOT NULL)::BIGINT AS embedded, count(*) - (t IS NOT NULL)::BIGINT AS others, any_value(status) AS status, true AS sizes_kept,
        array_to_string(list_transform(string_split('a b c d e f g h i j k l m n o p q r s t u v w x y z', ' '), lambda c: length(t) - length(replace(t, c, ''))), ',') AS letters
        FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source GROUP BY d.source, t""",
    ),
    "stream_ingest": (stream_ingest, None),
    "discovery_levels": (
        discovery_levels,
        """WITH RECURSIVE l AS (SELECT DISTINCT (l_suppkey % 500)::VARCHAR AS s, (l_partkey % 997)::VARCHAR AS t FROM lineitem WHERE l_suppkey % 500 <> l_partkey % 997),
        r(url, depth) AS (SELECT '1', 0 UNION SELECT t, depth + 1 FROM r JOIN l ON url = s WHERE depth < 3)
        SELECT url, min(depth)::INT AS depth FROM r GROUP BY 1""",
    ),
}
