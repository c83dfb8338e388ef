"""The embedding buffer over runs that stop, pause and go on; readiness against what was sent."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.streaming import buffer as B


def encoder():
    """Made within a function, so that it travels by value: workers don't import tests."""

    def encode(texts):
        assert 0 < len(texts) <= 8
        return [[len(t), 1.0] for t in texts]

    return encode


def send(spark, folder, rows):
    spark.createDataFrame(rows, B.RECORD).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder, told, hold_ms):
    read = lambda schema, path: spark.readStream.schema(schema).parquet(path)
    return B.embedding_stream(read(B.RECORD, folder), read(B.COMMAND, told), encoder(), lanes=2, flush=8, hold_ms=hold_ms)


def pages(context, ids, chunks=3):
    return [(context, p, chunks, f"{p}-{i}", f"{context} page {p} chunk {i}") for p in ids for i in range(chunks)]


def states(spark, done, totals, told):
    registry = spark.createDataFrame(list(totals.items()), "context_id string, total_pages long")
    return {r["context_id"]: r for r in B.readiness(done, registry, spark.read.schema(B.COMMAND).parquet(told)).collect()}


def check(done):
    """Every content of a context is embedded once, and flushes have the size that their reason allows."""
    rows = done.collect()
    once = Counter((r["context_id"], r["digest"]) for r in rows if r["outcome"] == "embedded")
    assert set(once.values()) <= {1}
    flushes = Counter((r["context_id"], r["lane"], r["flush"], r["flush_size"], r["reason"]) for r in rows if r["outcome"] == "embedded")
    for (_, _, _, size, reason), n in flushes.items():
        assert n == size and (size == 8 if reason == "full" else size < 8)
    return rows


def test_pause_in_mid_run_and_restart(spark, tmp_path):
    src, told, out, point = (str(tmp_path / x) for x in ("records", "commands", "out", "check"))
    totals = {"a": 20, None: 5, "b": 2, "c": 1, "d": 3}
    one = [*pages("a", range(10)), *pages(None, range(5)), ("b", 1, 1, "x", " \n"), ("b", 2, 1, "y", None), ("c", 1, 1, "z", "")]
    send(spark, src, one + [("a", 90, 1, "again", "a page 3 chunk 1")])
    B.command(spark, told, [("nobody", "resume")])
    # nothing is old enough for a timer: what doesn't fill a flush is held when the run stops
    first = B.run(stream(spark, src, told, 10**9), out, point)
    rows = check(first)
    assert {r["reason"] for r in rows if r["outcome"] == "embedded"} == {"full"} and sum(r["outcome"] == "seen" for r in rows) == 1
    now = states(spark, first, totals, told)
    # the empty pages of b and c are done
    assert (now["a"]["status"], now["b"]["status"], now["c"]["status"], now["d"]["status"]) == ("partially_ready", "failed", "failed", "discovering")
    # new pages come with a pause: what is held is flushed, nothing new is taken
    B.command(spark, told, [("a", "pause"), (None, "pause")])
    send(spark, src, pages("a", range(10, 20)) + pages("a", [3]))
    second = B.run(stream(spark, src, told, 10**9), out, point)
    rows = check(second)
    assert {r["page_id"] for r in rows if r["context_id"] == "a"} == {*range(10), 90}
    ended = {(r["context_id"], r["page_id"]) for r in B.pages_done(second).collect()}
    assert {(r["context_id"], r["page_id"]) for r in rows} == ended  # no page is half done
    assert {r["reason"] for r in rows if r["number"] > max(r["number"] for r in first.collect())} == {"pause"}
    now = states(spark, second, totals, told)
    assert now["a"]["status"] == "paused" and now[None]["status"] == "ready"
    # resumed: only what waited is embedded, the rest by the timer
    B.command(spark, told, [("a", "pause"), ("a", "resume")])
    third = B.run(stream(spark, src, told, 1_000), out, point, lambda done: done.count() >= len(one) + 34, patience=120)
    rows = check(third)
    assert {r["reason"] for r in rows if r["context_id"] == "a" and r["outcome"] == "embedded"} == {"full", "pause", "timer"}
    assert {r["digest"] for r in rows if r["outcome"] == "embedded" and r["context_id"] == "a"} == {B._digest(c) for *_, c in pages("a", range(20))}
    assert third.where("outcome = 'embedded'").where(F.col("vector")[1] != 1.0).count() == 0
    totals["a"] = 21
    last = states(spark, third, totals, told)
    assert (last["a"]["status"], last["a"]["pages"], last["a"]["indexed"]) == ("ready", 21, 21)
    assert last["a"]["partial_at"] < last["a"]["ready_at"] == third.where("context_id = 'a'").agg(F.max("number")).head()[0]
    assert [last[c]["status"] for c in "bcd"] == ["failed", "failed", "discovering"]


def test_commands_are_named(spark, tmp_path):
    with pytest.raises(ValueError, match="stop"):
        B.command(spark, str(tmp_path / "c"), [("a", "stop")])


class _State:
    """State of one key in memory, with the number of calls that asked it for a digest."""

    def __init__(self):
        self.map, self.asked = {}, 0

    def exists(self):
        return bool(self.map)

    def containsKey(self, key):  # noqa: N802
        self.asked += 1
        return key in self.map

    def updateValue(self, key, value):  # noqa: N802
        assert key not in self.map  # embedded once
        self.map[key] = value


@pytest.mark.parametrize("known, asked", [(10**6, 0), (15, 32)])
def test_new_lanes_ask_the_state_for_nothing(monkeypatch, known, asked):
    """Each content twice: seen the second time, whether the lane still holds its digests (then without a call to the state) or asks."""
    monkeypatch.setattr(B, "KNOWN", known, raising=False)
    buffer = B.Buffer(encoder(), 8, 1000)
    buffer.embedded, buffer.flushes = _State(), 0
    buffer.known = None if buffer.embedded.exists() else set()
    records = [(i, 1, str(i), f"text {i % 24}") for i in range(48)]
    held = []
    rows = [r for df in buffer._take(("a", 0), held, records) for r in df["outcome"]]
    assert rows.count("embedded") == 24 and rows.count("seen") == 24 and held == []
    assert buffer.embedded.asked == asked
    # with a history the state is asked
    buffer.known = None if buffer.embedded.exists() else set()
    again = [r for df in buffer._take(("a", 0), held, records[:8]) for r in df["outcome"]]
    assert again == ["seen"] * 8 and buffer.embedded.asked == asked + 8
