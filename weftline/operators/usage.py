"""Usage analytics over a log of token events.

Events: event_id, client_id, tokens, recorded_at (UTC).  "Now" and "today" are
parameters, so results don't depend on the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAILY_LIMIT = 100_000
COOLDOWN_MINUTES = 1440
#: Share of the limit from which a client counts as limited.
LIMITED_AT = 90
KEEP_DAYS = 90


def token_events(events: DataFrame) -> DataFrame:
    """The event table as token events: negative or missing tokens count as 0."""
    tokens = F.greatest(F.coalesce(F.floor("value"), F.lit(0)), F.lit(0)).cast("long")
    return events.select(
        "event_id",
        F.col("user_id").alias("client_id"),
        tokens.alias("tokens"),
        F.col("ts").alias("recorded_at"),
        F.to_date("ts").alias("day"),
        F.hour("ts").alias("hour"),
    )


def rollup_hours(events: DataFrame) -> DataFrame:
    return events.groupBy("day", "client_id", "hour").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("requests"))


def rollup_days(events: DataFrame) -> DataFrame:
    return events.groupBy("day", "client_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("requests"))


def dense_hours(events: DataFrame, day: Column) -> DataFrame:
    """24 rows for each client of the day, hours without events with zeros."""
    of_day = rollup_hours(events.where(F.col("day") == day))
    clients = of_day.select("client_id").distinct()
    grid = clients.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return grid.join(of_day, ["client_id", "hour"], "left").select(
        "client_id", "hour", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("requests", F.lit(0)).alias("requests")
    )


def usage_window(events: DataFrame, today: Column, days: int = 7) -> DataFrame:
    """A row for each client and each of the ``days`` days that end today, oldest first."""
    days = max(1, days)
    first = F.date_sub(today, days - 1)
    per_day = rollup_days(events.where(F.col("day").between(first, today)))
    clients = events.select("client_id").distinct()
    grid = clients.withColumn("day", F.explode(F.sequence(first, today)))
    return grid.join(per_day, ["client_id", "day"], "left").select(
        "client_id", "day", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("requests", F.lit(0)).alias("requests")
    )


def quota_state(tokens: Column, limit: Column, status: Column) -> Column:
    """suspended stays; at the limit cooldown; from 90 % limited; else active."""
    return (
        F.when(status == "suspended", "suspended")
        .when(tokens >= limit, "cooldown")
        .when(tokens / limit * 100 >= LIMITED_AT, "limited")
        .otherwise("active")
    )


def effective(value: Column, default: int) -> Column:
    """A positive setting, or the default."""
    v = value.try_cast("double")
    return F.when(v > 0, v).otherwise(F.lit(float(default)))


def quota_status(events: DataFrame, clients: DataFrame, today: Column, now: Column) -> DataFrame:
    """Per client: usage of today, what is left, status, end of the cooldown, whether requests are allowed.

    clients: client_id, daily_limit, cooldown_minutes, status.
    """
    used = rollup_days(events.where(F.col("day") == today)).select("client_id", "tokens")
    c = clients.join(used, "client_id", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    limit = effective(F.col("daily_limit"), DAILY_LIMIT)
    state = quota_state(F.col("tokens"), limit, F.col("status"))
    minutes = effective(F.col("cooldown_minutes"), COOLDOWN_MINUTES)
    return c.select(
        "client_id",
        F.col("tokens").alias("tokens_used"),
        limit.cast("long").alias("daily_limit"),
        F.greatest(limit - F.col("tokens"), F.lit(0.0)).cast("long").alias("tokens_left"),
        F.round(F.col("tokens") / limit * 100, 2).alias("usage_percent"),
        state.alias("status"),
        F.when(state == "cooldown", F.timestamp_add("MINUTE", minutes.cast("int"), now)).alias("cooldown_until"),
        (~state.isin("suspended", "cooldown")).alias("allowed"),
    )


def expired_cooldowns(clients: DataFrame, now: Column) -> DataFrame:
    """Cooldowns that have ended become active; everything else stays."""
    over = (F.col("status") == "cooldown") & (F.col("cooldown_until") <= now)
    return clients.withColumns(
        {
            "status": F.when(over, "active").otherwise(F.col("status")),
            "cooldown_until": F.when(~F.coalesce(over, F.lit(False)), F.col("cooldown_until")),
        }
    )


def prune(events: DataFrame, now: Column, keep_days: int = KEEP_DAYS) -> DataFrame:
    """Events of the last ``keep_days`` days; events without a time stay."""
    cutoff = now - F.make_dt_interval(F.lit(max(1, keep_days)))
    return events.where((F.col("recorded_at") >= cutoff) | F.col("recorded_at").isNull())


def totals(events: DataFrame, today: Column) -> DataFrame:
    """Per client and over all (client_id null): tokens and requests, all time and today."""
    now = F.col("day") == today
    per = events.rollup("client_id").agg(
        F.sum("tokens").alias("tokens"),
        F.count(F.lit(1)).alias("requests"),
        F.sum(F.when(now, F.col("tokens")).otherwise(0)).alias("tokens_today"),
        F.count_if(now).alias("requests_today"),
    )
    return per


def drop_client(events: DataFrame, clients: DataFrame) -> DataFrame:
    """Everything but the rows of the given clients."""
    return events.join(clients.select("client_id"), "client_id", "left_anti")
