"""Streams that end without a later row of their key, and logs that are still being written."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.sources import log
from tessera.streaming import monitors, timeouts

ROWS = "agent_id long, id long, type string, ts timestamp"


def bus_rows(n=160):
    """(agent, id, type, second) over two hours, then one row of an agent of its own a day later, which moves the watermark past all."""
    rng = random.Random(7)
    rows = [(rng.randint(1, 6), i, rng.choice(["start", "stop", "seen", "start", "other"]), rng.randint(0, 7200)) for i in range(n)]
    return sorted(rows, key=lambda r: r[3]) + [(99, 9_999, "other", 90_000)]


def table(spark, rows):
    return spark.createDataFrame([(a, i, k, float(t)) for a, i, k, t in rows], "agent_id long, id long, type string, t double").select("agent_id", "id", "type", F.timestamp_seconds("t").alias("ts"))


def feed(spark, rows, folder, shares):
    """The rows in `shares` files; within 300 s they are out of order, across files too."""
    rng = random.Random(3)
    mixed = sorted(rows, key=lambda r: r[3] + (rng.uniform(0, 280) if r[3] < 80_000 else 0))
    for k in range(shares):
        part = mixed[k * len(mixed) // shares : (k + 1) * len(mixed) // shares]
        table(spark, part).coalesce(1).write.mode("append").parquet(f"{folder}/{k:02}")


def source(spark, folder):
    return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def test_timers_fire_without_a_later_row_and_survive_a_restart(spark, tmp_path):
    rows = bus_rows()
    make = lambda: timeouts.timer_stream(source(spark, f"{tmp_path}/in"), {"start": 600}, "stop", "seen", "5 minutes")
    feed(spark, rows[:80], f"{tmp_path}/in", 2)
    first = timeouts.last_outcomes(timeouts.drained(make(), f"{tmp_path}/run")).count()
    feed(spark, rows[80:], f"{tmp_path}/in/later", 2)
    got = timeouts.last_outcomes(timeouts.drained(make(), f"{tmp_path}/run")).collect()
    want = monitors.timer_log(table(spark, rows), {"start": 600}, "stop", "seen").filter("status <> 'active'").collect()
    assert 0 < first < len(got)
    assert {(r["agent_id"], r["id"], r["status"]) for r in got} == {(r["agent_id"], r["id"], r["status"]) for r in want}
    assert {r["status"] for r in got} == {"fired", "cancelled", "acknowledged"}


def test_timer_state_is_dropped():
    t = timeouts.Timers(None, {"start": 10}, "stop", "seen", 60)
    t.add(1_000_000, 1, "start")
    t.add(5_000_000, 2, "other")
    assert t.until(2_000_000) == [] and t.next() == 11_000_000
    again = timeouts.Timers(t.told(), {"start": 10}, "stop", "seen", 60)
    assert again.until(11_000_000) == [] and again.until(11_000_001) == [(1, "start", 11_000_000, "fired")]
    assert again.next() == 71_000_000 and again.until(71_000_001) == [] and again.next() is None
    # A cancel at the very end is too late, one at the very start too early.
    for at, status in ((11_000_000, "fired"), (10_999_999, "cancelled"), (1_000_000, "fired")):
        t = timeouts.Timers(None, {"start": 10}, "stop", "seen", 60)
        t.add(1_000_000, 1, "start")
        t.add(at, 2, "stop")
        assert [x[3] for x in t.until(60_000_000)] == [status]


def test_lost_messages_leave_the_join(spark, tmp_path):
    rows = [(a, i, k, t) for a, i, k, t in bus_rows() if k in ("start", "seen")] + [(98, 7_000, "start", 90_000), (99, 8_000, "seen", 90_000)]
    make = lambda: (lambda m: timeouts.acknowledgement_stream(m.filter("type = 'start'"), m.filter("type = 'seen'"), "INTERVAL 400 SECONDS", "5 minutes"))(source(spark, f"{tmp_path}/in"))
    feed(spark, rows[:40], f"{tmp_path}/in", 2)
    timeouts.drained(make(), f"{tmp_path}/run")
    feed(spark, rows[40:], f"{tmp_path}/in/later", 2)
    got = {r["id"]: r["acked_at"] and int(r["acked_at"].timestamp()) for r in timeouts.drained(make(), f"{tmp_path}/run").collect()}
    want = {i: min((u for b, _, k2, u in rows if k2 == "seen" and b == a and t < u <= t + 400), default=None) for a, i, k, t in rows if k == "start" and i != 7_000}
    shift = {got[i] - want[i] for i in got if got[i] is not None and want[i] is not None}
    assert len(shift) <= 1 and {i: x is None for i, x in got.items()} == {i: x is None for i, x in want.items()}


def lines(rows):
    return sorted((r["file"], r["offset"], r["line"]) for r in rows)


def test_log_defers_half_a_line_and_goes_on(spark, tmp_path):
    (tmp_path / "in").mkdir()
    a, out = tmp_path / "in" / "a.jsonl", f"{tmp_path}/run"
    a.write_bytes(b'{"id": 1}\n\n{"id": 2}\r\nnot json\n{"id": "x"}\n{"id"')
    (tmp_path / "in" / "b.txt").write_bytes(b"of no concern\n")
    read = lambda: timeouts.drained(log.read_log(spark, f"{tmp_path}/in", stream=True), out)
    assert [x[2] for x in lines(read().collect())] == ['{"id": 1}', "", '{"id": 2}', "not json", '{"id": "x"}']
    with a.open("ab") as f:
        f.write(b': 3}\n{"id": 4')
    (tmp_path / "in" / "c.jsonl").write_bytes('{"id": "é"}\n'.encode())
    found = read()
    assert [x[2] for x in lines(found.collect())] == ['{"id": 1}', "", '{"id": 2}', "not json", '{"id": "x"}', '{"id": 3}', '{"id": "é"}']
    assert lines(found.collect()) == lines(log.read_log(spark, f"{tmp_path}/in").collect())
    got = log.parsed(found, "id long").collect()
    assert sorted(r["id"] for r in got if r["quarantined"] is None) == [1, 2, 3]
    assert sorted(r["quarantined"] for r in got if r["id"] is None) == ["not json", '{"id": "x"}', '{"id": "é"}']
    read()
    assert read().count() == 7


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_log_ranges_share_out_lines(tmp_path, size):
    rng = random.Random(size)
    data = b"".join(b"x" * rng.choice([0, 1, 2, 5, 40]) + b"\n" for _ in range(60))
    (tmp_path / "a").write_bytes(data + b"half")
    files = log.Files(str(tmp_path), "")
    end = files.ends({})
    assert end == {"a": len(data)}
    got = [x for r in log.ranges({}, end, size) for x in files.lines(r.name, r.low, r.high, r.end)]
    want, at = [], 0
    for line in data.split(b"\n")[:-1]:
        want.append((at, line))
        at += len(line) + 1
    assert got == want
    (tmp_path / "a").write_bytes(b"cut\n")
    with pytest.raises(ValueError):
        files.ends(end)


def test_empty_log(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert log.parsed(log.read_log(spark, f"{tmp_path}/in"), "id long").count() == 0


def test_first_sightings(spark, tmp_path):
    """Repeats of an id within the delay are dropped."""
    rows = [(1, 1, "a", 0), (1, 1, "a", 60), (1, 2, "a", 90), (2, 1, "b", 120)]
    table(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    m = source(spark, f"{tmp_path}/in")
    name = f"seen_{uuid.uuid4().hex}"
    q = monitors.first_sightings(m, "10 minutes").writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["id"] for r in spark.table(name).collect()) == [1, 2]
