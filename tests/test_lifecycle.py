"""Timers and state that expires, over runs that stop and start again."""

import time
from datetime import datetime

import pytest

from weftline.streaming import lifecycle as L

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, value double"
PLACE = [0]


def add(spark, folder, rows):
    PLACE[0] += 1
    rows = [(PLACE[0] * 1000 + i, ts and datetime.fromisoformat(ts), user, value) for i, (ts, user, value) in enumerate(rows)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).parquet(str(folder))


def states(df):
    return {r["client_id"]: (r["tokens"], r["status"], r["swept"]) for r in df.collect()}


def test_cooldown_ends_without_an_event(spark, tmp_path):
    """Run one begins a cooldown and stops; run two gets no event of that client, and its timer fires."""
    src, out, check = (str(tmp_path / x) for x in ("events", "out", "check"))
    day = "2024-01-01T10:00:00"
    add(spark, src, [(day, 1, 60.0), (day, 1, 50.9), (day, 2, 95.0), (day, 3, 5.0), (day, 4, -7.0), (day, None, 200.0), (None, 5, 1.0)])
    first = L.newest_states(L.run(L.cooldown_stream(stream(spark, src), 100, 45_000), out, check))
    assert states(first) == {1: (110, "cooldown", False), 2: (95, "limited", False), 3: (5, "active", False), 4: (0, "active", False), None: (200, "cooldown", False)}
    assert {r["cooldown_until"] - r["changed"] for r in L.changes(spark, out, L.cooldown_stream(stream(spark, src)).schema).where("status = 'cooldown'").collect()} == {45_000}
    time.sleep(1)
    add(spark, src, [(day, 3, 1.0)])
    second = L.sweep(L.cooldown_stream(stream(spark, src), 100, 45_000), out, check, patience=200)
    assert states(second) == {1: (110, "active", True), 2: (95, "limited", False), 3: (6, "active", False), 4: (0, "active", False), None: (200, "active", True)}
    # a new day, and a cooldown again
    add(spark, src, [("2024-01-02T00:00:00", 1, 130.0), ("2024-01-01T09:00:00", 2, 50.0)])
    third = L.newest_states(L.run(L.cooldown_stream(stream(spark, src), 100, 600_000), out, check))
    assert states(third)[1][:2] == (130, "cooldown") and states(third)[2][:2] == (145, "cooldown")


@pytest.mark.parametrize("keep", [1500, 10**9])
def test_rollup_state_expires_and_late_events_count(spark, tmp_path, keep):
    """Rounds of new days: with a short life the state empties after each round, and the sums are the same."""
    src, out, check = (str(tmp_path / x) for x in ("events", "out", "check"))
    rows, held = [], []
    for i in range(3):
        new = [(f"2024-01-{1 + d:02d}T12:00:00", u, 10.0) for d in range(5 * i, 5 * i + 5) for u in (1, 2)] + [("2024-01-01T08:00:00", 1, 7.0)]
        rows += new
        add(spark, src, new)

        def note(query):
            held.append(sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"]))
            return keep != 1500 or held[-1] == 0

        got = L.run(L.expiring_rollup(stream(spark, src), keep), out, check, note, patience=60)
        time.sleep(2)
    want = {}
    for ts, u, v in rows:
        t, n = want.get((ts[:10], u), (0, 0))
        want[ts[:10], u] = (t + int(v), n + 1)
    assert {(r["day"], r["client_id"]): (r["tokens"], r["requests"]) for r in L.merged_rollup(got).collect()} == want
    lives = got.where("day = '2024-01-01' AND client_id = 1").select("life").distinct().count()
    if keep == 1500:
        assert lives == 3 and held[-1] == 0
    else:
        assert lives == 1 and held[-1] >= 30


def test_the_session_keeps_its_store(spark):
    before = spark.conf.get(L.STORE, None)
    with pytest.raises(KeyError), L.rocksdb(spark):
        assert spark.conf.get(L.STORE) == L.ROCKSDB
        raise KeyError
    assert spark.conf.get(L.STORE, None) == before


def test_reading_the_input_takes_as_long_as_it_takes(spark, tmp_path):
    """Patience is for the end of cooldowns and the like, not for a micro-batch that has much to read."""
    src, out, check = (str(tmp_path / x) for x in ("events", "out", "check"))
    add(spark, src, [("2024-01-01T10:00:00", 1, 60.0), (None, 1, 5.0), ("2024-01-01T11:00:00", None, 2.5), ("2024-01-01T12:00:00", 1, -3.0)])
    got = L.merged_rollup(L.run(L.expiring_rollup(stream(spark, src)), out, check, patience=0.01))
    assert {(r["day"], r["client_id"]): (r["tokens"], r["requests"]) for r in got.collect()} == {("2024-01-01", 1): (60, 2), (None, 1): (5, 1), ("2024-01-01", None): (2, 1)}
