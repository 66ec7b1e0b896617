"""Message-bus monitors: expiry, subscription, epochs, staleness, rate limits, breakers, timers, acknowledgements.

State machines are step functions (state, row) -> (state, output rows). `ordered`
runs one over a log: rows are dealt by key and sorted, and a task streams through them
with one key's state at a time. `stateful_stream` runs the same function in Structured
Streaming, each micro-batch in the order of (ts, id).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans import Catalog, table
from tessera.plans.bind import MESSAGES, messages

catalog = Catalog()

Step = Callable[[Any, dict], tuple[Any, list[dict]]]


def ordered(rows: DataFrame, key: str, order: list[str], step: Step, schema: str) -> DataFrame:
    """The outputs of step over each key's rows in order; a task holds one key's state and a batch of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_dict("records"):
                if row[key] != now:
                    now, state = row[key], None
                state, found = step(state, row)
                out += found
            if out:
                yield pd.DataFrame(out)

    names = [x.split()[0] for x in schema.split(",")]
    return rows.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInPandas(lambda b: (x[names] for x in run(b)), schema)


def stateful_stream(rows: DataFrame, key: str, order: list[str], step: Step, schema: str) -> DataFrame:
    """The same over a stream; the state is kept as JSON per key."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    names = [x.split()[0] for x in schema.split(",")]

    def run(_: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(held.get[0]) if held.exists else None
        rows_ = pd.concat(list(batches)).sort_values(order)
        out: list[dict] = []
        for row in rows_.to_dict("records"):
            state, found = step(state, row)
            out += found
        held.update((json.dumps(state),))
        if out:
            yield pd.DataFrame(out)[names]

    return rows.groupBy(key).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.NoTimeout)


# State machines.


def rate_limit(most: int, window: float) -> Step:
    """Admit a call if fewer than `most` admitted calls lie in (ts - window, ts]; refused calls don't count."""

    def step(state: list[float] | None, row: dict) -> tuple[list[float], list[dict]]:
        live = [x for x in state or [] if x > row["at"] - window]
        ok = len(live) < most
        if ok:
            live.append(row["at"])
        return live, [{"key": row["key"], "id": row["id"], "admitted": ok}]

    return step


def breaker(failures: int = 5, cooldown: float = 60.0) -> Step:
    """closed -> open at so many failures in a row; the first call after the cool-down is half open: success closes, failure opens again."""

    def step(state: list | None, row: dict) -> tuple[list, list[dict]]:
        name, count, since = state or ["closed", 0, 0.0]
        before = name
        if name == "open" and row["at"] - since >= cooldown:
            name = "half_open"
            out = [{"key": row["key"], "id": row["id"], "before": before, "after": name}]
            before = name
        else:
            out = []
        if name == "open":
            return [name, count, since], out
        if row["ok"]:
            name, count = "closed", 0
        else:
            count += 1
            if name == "half_open" or count >= failures:
                name, since, count = "open", row["at"], 0
        if name != before:
            out.append({"key": row["key"], "id": row["id"], "before": before, "after": name})
        return [name, count, since], out

    return step


def timers(timeout: float) -> Step:
    """A start sets a key's timer, a cancel clears it; the first later row at or after its end reports that it fired."""

    def step(state: list | None, row: dict) -> tuple[list | None, list[dict]]:
        out = []
        if state and row["at"] >= state[1]:
            out.append({"key": row["key"], "id": state[0], "fired_at": state[1]})
            state = None
        if row["kind"] == "start" and state is None:
            state = [row["id"], row["at"] + timeout]
        elif row["kind"] == "cancel":
            state = None
        return state, out

    return step


def _calls(s, d) -> DataFrame:
    m = table(s, d, "events")
    return m.select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").cast("double").alias("at"), (F.col("event_type") != "error").alias("ok"), F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "purchase", "cancel").otherwise("other").alias("kind"), F.col("user_id").cast("string").alias("user"))


ADMITTED = "key string, id long, admitted boolean"
MOVES = "key string, id long, before string, after string"
FIRED = "key string, id long, fired_at double"
catalog.add("stream_rate_limit")(lambda s, d: ordered(_calls(s, d), "key", ["at", "id"], rate_limit(2, 86_400.0), ADMITTED))
catalog.add("stream_breaker")(lambda s, d: ordered(_calls(s, d).withColumn("key", F.col("user")).withColumn("ok", F.col("id") % 3 == 0), "key", ["at", "id"], breaker(3, 3600.0), MOVES))
catalog.add("stream_timers")(lambda s, d: ordered(_calls(s, d).withColumn("key", F.col("user")), "key", ["at", "id"], timers(43_200.0), FIRED))


# Log queries.

_ASOF = "(SELECT max(ts) FROM messages)"


def as_of(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows.agg(F.max("ts").alias("as_of")))


def unexpired(m: DataFrame) -> DataFrame:
    """Messages whose ts + ttl is not before the last message."""
    return m.join(as_of(m)).filter(F.unix_micros("ts") + F.col("ttl").cast("long") * 1_000_000 >= F.unix_micros("as_of")).drop("as_of")


catalog.add("bus_unexpired", f"WITH {MESSAGES} SELECT id, channel FROM messages WHERE ts + to_seconds(ttl) >= {_ASOF}")(lambda s, d: unexpired(messages(s, d)).select("id", "channel"))
catalog.add("bus_subscription", f"WITH {MESSAGES} SELECT id, type, priority FROM messages WHERE type IN ('error', 'purchase') AND priority >= 2 AND team = 'team1'")(
    lambda s, d: messages(s, d).filter(F.col("type").isin("error", "purchase") & (F.col("priority") >= 2) & (F.col("team") == "team1")).select("id", "type", "priority")
)
catalog.add("bus_hourly_epochs", f"WITH {MESSAGES} SELECT date_trunc('hour', ts) AS epoch, count(*) AS n, count(DISTINCT agent_id) AS agents FROM messages GROUP BY 1")(
    lambda s, d: messages(s, d).groupBy(F.window("ts", "1 hour")["start"].cast("timestamp_ntz").alias("epoch")).agg(F.count("*").alias("n"), F.count_distinct("agent_id").alias("agents"))
)
catalog.add("bus_compaction", f"WITH {MESSAGES} SELECT channel, count(*) AS before, count(*) FILTER (ts + to_seconds(ttl * 100) >= {_ASOF}) AS after, sum(strlen(body))::BIGINT AS bytes_before FROM messages GROUP BY channel")(
    lambda s, d: (lambda m: m.join(as_of(m)).groupBy("channel").agg(F.count("*").alias("before"), F.count_if(F.unix_micros("ts") + F.col("ttl").cast("long") * 100_000_000 >= F.unix_micros("as_of")).alias("after"), F.sum(F.octet_length("body")).alias("bytes_before")))(messages(s, d))
)
catalog.add("bus_stale_agents", f"WITH {MESSAGES} SELECT agent_id, max(ts) AS seen, max(ts) < {_ASOF} - INTERVAL 12 HOUR AS stale FROM messages GROUP BY agent_id")(
    lambda s, d: (lambda m: m.groupBy("agent_id").agg(F.max("ts").alias("seen")).join(as_of(m)).select("agent_id", F.col("seen").cast("timestamp_ntz").alias("seen"), (F.col("seen") < F.col("as_of") - F.expr("INTERVAL 12 HOURS")).alias("stale")))(messages(s, d))
)
catalog.add("bus_heartbeat_gaps", f"WITH {MESSAGES}, g AS (SELECT agent_id, id, ts - lag(ts) OVER (PARTITION BY agent_id ORDER BY ts, id) AS gap FROM messages) SELECT agent_id, count(*) AS gaps FROM g WHERE gap > INTERVAL 1 DAY GROUP BY agent_id")(
    lambda s, d: messages(s, d).withColumn("before", F.lag("ts").over(Window.partitionBy("agent_id").orderBy("ts", "id"))).filter(F.col("ts") > F.col("before") + F.expr("INTERVAL 1 DAY")).groupBy("agent_id").agg(F.count("*").alias("gaps"))
)


def acknowledged(sent: DataFrame, acks: DataFrame, within: str) -> DataFrame:
    """(agent_id, id, acked): whether an acknowledgement of the same agent follows within the interval."""
    j = sent.alias("s").join(acks.alias("a"), (F.col("s.agent_id") == F.col("a.agent_id")) & (F.col("a.ts") > F.col("s.ts")) & (F.col("a.ts") <= F.col("s.ts") + F.expr(within)), "left")
    return j.groupBy(F.col("s.agent_id").alias("agent_id"), F.col("s.id").alias("id")).agg((F.count("a.id") > 0).alias("acked"))


catalog.add("bus_acknowledgements", f"WITH {MESSAGES} SELECT s.agent_id, s.id, count(a.id) > 0 AS acked FROM (SELECT * FROM messages WHERE type = 'click') s LEFT JOIN (SELECT * FROM messages WHERE type = 'purchase') a ON s.agent_id = a.agent_id AND a.ts > s.ts AND a.ts <= s.ts + INTERVAL 6 HOUR GROUP BY 1, 2")(
    lambda s, d: acknowledged(messages(s, d).filter("type = 'click'"), messages(s, d).filter("type = 'purchase'"), "INTERVAL 6 HOURS")
)
catalog.add("bus_latest_status", f"WITH {MESSAGES} SELECT agent_id, arg_max(type, (ts, id)) AS status, max(ts) AS at FROM messages GROUP BY agent_id")(
    lambda s, d: messages(s, d).groupBy("agent_id").agg(F.max_by("type", F.struct("ts", "id")).alias("status"), F.max("ts").cast("timestamp_ntz").alias("at"))
)
catalog.add("bus_changes_only", f"WITH {MESSAGES}, x AS (SELECT agent_id, id, type, lag(type) OVER (PARTITION BY agent_id ORDER BY ts, id) AS before FROM messages) SELECT agent_id, id, type FROM x WHERE type IS DISTINCT FROM before")(
    lambda s, d: messages(s, d).withColumn("before", F.lag("type").over(Window.partitionBy("agent_id").orderBy("ts", "id"))).filter(~F.col("type").eqNullSafe(F.col("before"))).select("agent_id", "id", "type")
)
catalog.add("bus_window_snapshots", f"WITH {MESSAGES} SELECT channel, date_trunc('day', ts) AS day, count(*) AS n, round(avg(value), 6) AS mean, round(avg((type = 'error')::INT), 6) AS error_rate, CASE WHEN avg((type = 'error')::INT) > 0.3 THEN 'critical' WHEN avg((type = 'error')::INT) > 0.2 THEN 'warning' ELSE 'ok' END AS level FROM messages GROUP BY 1, 2")(
    lambda s, d: snapshots(messages(s, d))
)


def snapshots(m: DataFrame) -> DataFrame:
    """Daily load and error rate of each channel with an alert level; works on streams alike."""
    e = F.avg((F.col("type") == "error").cast("double"))
    return m.groupBy("channel", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(e, 6).alias("error_rate"), F.when(e > 0.3, "critical").when(e > 0.2, "warning").otherwise("ok").alias("level")).select("channel", F.col("w.start").cast("timestamp_ntz").alias("day"), "n", "mean", "error_rate", "level")


catalog.add("bus_key_values", f"WITH {MESSAGES}, l AS (SELECT team AS ns, channel AS key, arg_max(body, (ts, id)) AS value, arg_max(ttl, (ts, id)) AS ttl, max(ts) AS seen FROM messages GROUP BY 1, 2) SELECT ns, key, value FROM l WHERE seen + to_seconds(ttl * 20) >= {_ASOF}")(
    lambda s, d: (lambda m: m.groupBy(F.col("team").alias("ns"), F.col("channel").alias("key")).agg(F.max_by("body", F.struct("ts", "id")).alias("value"), F.max_by("ttl", F.struct("ts", "id")).alias("ttl"), F.max("ts").alias("at")).join(as_of(m)).filter(F.unix_micros("at") + F.col("ttl").cast("long") * 20_000_000 >= F.unix_micros("as_of")).select("ns", "key", "value"))(messages(s, d))
)
catalog.add("bus_lifecycle_feed", f"WITH {MESSAGES} SELECT id, type, agent_id FROM messages WHERE type IN ('signup', 'error') ORDER BY ts DESC, id DESC LIMIT 50")(
    lambda s, d: messages(s, d).filter(F.col("type").isin("signup", "error")).orderBy(F.desc("ts"), F.desc("id")).select("id", "type", "agent_id").limit(50)
)
catalog.add("bus_phase_order", f"WITH {MESSAGES}, p AS (SELECT agent_id, min(ts) FILTER (type = 'signup') AS a, min(ts) FILTER (type = 'view') AS b, min(ts) FILTER (type = 'purchase') AS c FROM messages GROUP BY 1) SELECT agent_id, coalesce(a <= b AND b <= c, false) AS in_order FROM p")(
    lambda s, d: messages(s, d).groupBy("agent_id").agg(*[F.min(F.when(F.col("type") == k, F.col("ts"))).alias(n) for n, k in (("a", "signup"), ("b", "view"), ("c", "purchase"))]).select("agent_id", F.coalesce((F.col("a") <= F.col("b")) & (F.col("b") <= F.col("c")), F.lit(False)).alias("in_order"))
)


def read_log(spark, path: str, schema: str) -> DataFrame:
    """A stream of JSON lines appended to a folder; lines that don't parse go to the column _corrupt."""
    return spark.readStream.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def first_sightings(m: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream without repeats of an id that come within the delay, and without later rows."""
    return m.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"])


# Timers, acknowledgements and health over a whole log.


def next_after(rows: DataFrame, key: str, wanted: Column, from_: Column, least: int = 1) -> DataFrame:
    """rows with next_at (microseconds): the first later time, by at least `least` microseconds, of a row of the key that is wanted; null where from_ is not set.

    One sort per key, latest first, so that each row sees the running minimum of what comes after it.
    """
    w = Window.partitionBy(key).orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, -least)
    return rows.withColumn("next_at", F.when(from_, F.min(F.when(wanted, F.col("at"))).over(w)))


def timer_log(m: DataFrame, timeouts: dict[str, int], cancel: str, ack: str) -> DataFrame:
    """(agent_id, id, type, expires, status) of every timer that a row of a type in timeouts (seconds) starts, as of the last row of the log.

    A timer is cancelled by a later cancel row of its agent before it expires, and has else fired if it expired; a fired one is
    acknowledged by an ack row at or after its end. All others are active. No later row of the agent is needed to fire one.
    """
    start = F.col("type").isin(*timeouts)
    seconds = F.lit(0)
    for kind, n in timeouts.items():
        seconds = F.when(F.col("type") == kind, F.lit(n)).otherwise(seconds)
    rows = next_after(m.select("agent_id", "id", "type", F.unix_micros("ts").alias("at")), "agent_id", F.col("type") == cancel, start)
    begun = rows.filter(start).withColumn("expires", F.col("at") + seconds.cast("long") * 1_000_000).withColumn("cancelled", F.coalesce(F.col("next_at") < F.col("expires"), F.lit(False)))
    ends = begun.select("agent_id", "id", "type", F.col("expires").alias("at"), F.lit(True).alias("timer"), "cancelled").unionByName(rows.filter(F.col("type") == ack).select("agent_id", "id", "type", "at", F.lit(False).alias("timer"), F.lit(False).alias("cancelled")))
    ended = next_after(ends, "agent_id", ~F.col("timer"), F.col("timer"), least=0).filter("timer")
    # A broadcast of one row.
    now = m.agg(F.unix_micros(F.max("ts")).alias("now"))
    status = F.when(F.col("cancelled"), "cancelled").when(F.col("at") > F.col("now"), "active").when(F.col("next_at").isNotNull(), "acknowledged").otherwise("fired")
    return ended.join(F.broadcast(now)).select("agent_id", "id", "type", F.timestamp_micros("at").cast("timestamp_ntz").alias("expires"), status.alias("status"))


_TIMERS = f"""{MESSAGES}, t AS (SELECT agent_id, id, type, ts, ts + CASE type WHEN 'signup' THEN INTERVAL 12 HOUR ELSE INTERVAL 24 HOUR END AS expires FROM messages WHERE type IN ('signup', 'error')),
c AS (SELECT t.id, min(m.ts) AS cancel FROM t JOIN messages m ON m.agent_id = t.agent_id AND m.type = 'purchase' AND m.ts > t.ts GROUP BY t.id),
k AS (SELECT t.id, min(m.ts) AS ack FROM t JOIN messages m ON m.agent_id = t.agent_id AND m.type = 'click' AND m.ts >= t.expires GROUP BY t.id),
l AS (SELECT t.agent_id, t.id, t.type, t.expires, CASE WHEN coalesce(cancel < expires, false) THEN 'cancelled' WHEN expires > {_ASOF} THEN 'active' WHEN ack IS NOT NULL THEN 'acknowledged' ELSE 'fired' END AS status FROM t LEFT JOIN c ON t.id = c.id LEFT JOIN k ON t.id = k.id)"""
_timers = lambda s, d: timer_log(messages(s, d), {"signup": 43_200, "error": 86_400}, "purchase", "click")
catalog.add("bus_timer_log", f"WITH {_TIMERS} SELECT * FROM l")(_timers)
catalog.add("bus_timer_summary", f"WITH {_TIMERS} SELECT status, type, count(*) AS n FROM l GROUP BY 1, 2")(lambda s, d: _timers(s, d).groupBy("status", "type").agg(F.count("*").alias("n")))


def ack_statistics(m: DataFrame, sent: str, ack: str, wait: int, retries: int = 3) -> DataFrame:
    """Per team: messages sent, acknowledged by their agent within (1 + retries) waits of `wait` seconds, still pending, failed; the retries that they took and the mean wait.

    A message is sent again after each wait without an acknowledgement, `retries` times at most.
    """
    rows = next_after(m.select("agent_id", "team", "type", F.unix_micros("ts").alias("at")), "agent_id", F.col("type") == ack, F.col("type") == sent)
    now = m.agg(F.unix_micros(F.max("ts")).alias("now"))
    x = rows.filter(F.col("type") == sent).join(F.broadcast(now))
    took = (F.col("next_at") - F.col("at")) / 1_000_000
    x = x.withColumn("took", F.when(took <= wait * (1 + retries), took)).withColumn("age", (F.col("now") - F.col("at")) / 1_000_000)
    x = x.withColumn("tries", F.least(F.lit(retries), F.floor(F.coalesce("took", "age") / wait)).cast("int"))
    lost = F.col("took").isNull() & (F.col("age") > wait * (1 + retries))
    return x.groupBy("team").agg(
        F.count("*").alias("sent"), F.count("took").alias("acknowledged"), F.count_if(lost).alias("failed"), F.count_if(F.col("took").isNull() & ~lost).alias("pending"),
        F.sum("tries").alias("retries"), F.round(F.avg("took"), 4).alias("mean_seconds"),
    )


catalog.add("bus_ack_statistics", f"""WITH {MESSAGES}, a AS (SELECT s.id, s.team, s.ts, min(a.ts) AS ack FROM messages s LEFT JOIN messages a ON a.agent_id = s.agent_id AND a.type = 'purchase' AND a.ts > s.ts WHERE s.type = 'click' GROUP BY ALL),
b AS (SELECT team, (epoch_us(ack) - epoch_us(ts)) / 1000000 AS took, (epoch_us({_ASOF}) - epoch_us(ts)) / 1000000 AS age FROM a),
x AS (SELECT team, CASE WHEN took <= 172800 THEN took END AS took, age FROM b)
SELECT team, count(*) AS sent, count(took) AS acknowledged, count(*) FILTER (took IS NULL AND age > 172800) AS failed, count(*) FILTER (took IS NULL AND age <= 172800) AS pending,
 sum(least(3, floor(coalesce(took, age) / 43200)))::BIGINT AS retries, round(avg(took), 4) AS mean_seconds FROM x GROUP BY team""")(lambda s, d: ack_statistics(messages(s, d), "click", "purchase", 43_200))


def window_percentiles(m: DataFrame, span: str, seconds: int) -> DataFrame:
    """Per channel and window: messages per second, 50th, 95th and 99th percentile of value, the share of retries (priority 3) and the level that these give."""
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    retry = F.avg((F.col("priority") == 3).cast("double"))
    x = m.groupBy("channel", F.window("ts", span).alias("w")).agg(F.round(F.count("*") / seconds, 6).alias("per_second"), p.alias("p"), F.round(retry, 6).alias("retry_share"))
    level = F.when(F.col("retry_share") > 0.6, "critical").when(F.col("retry_share") > 0.4, "warning").otherwise("ok")
    return x.select("channel", F.col("w.start").cast("timestamp_ntz").alias("start"), "per_second", *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p50", "p95", "p99"))], "retry_share", level.alias("level"))


catalog.add("bus_window_percentiles", f"WITH {MESSAGES}, x AS (SELECT channel, date_trunc('hour', ts) AS start, round(count(*) / 3600, 6) AS per_second, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg((priority = 3)::INT), 6) AS retry_share FROM messages GROUP BY 1, 2) SELECT *, CASE WHEN retry_share > 0.6 THEN 'critical' WHEN retry_share > 0.4 THEN 'warning' ELSE 'ok' END AS level FROM x")(
    lambda s, d: window_percentiles(messages(s, d), "1 hour", 3600)
)


def agent_health(m: DataFrame, done: str, dead: str, stale_after: int, dead_after: int) -> DataFrame:
    """(agent_id, health): done or dead by an agent's last status, dead or stale by the age of its last row in seconds, else ok."""
    x = m.groupBy("agent_id").agg(F.max_by("type", F.struct("ts", "id")).alias("status"), F.max("ts").alias("seen")).join(as_of(m))
    age = F.unix_micros("as_of") - F.unix_micros("seen")
    return x.select("agent_id", F.when(F.col("status") == done, "done").when((F.col("status") == dead) | (age > dead_after * 1_000_000), "dead").when(age > stale_after * 1_000_000, "stale").otherwise("ok").alias("health"))


catalog.add("bus_agent_health", f"WITH {MESSAGES}, x AS (SELECT agent_id, arg_max(type, (ts, id)) AS status, epoch_us({_ASOF}) - epoch_us(max(ts)) AS age FROM messages GROUP BY agent_id) SELECT agent_id, CASE WHEN status = 'purchase' THEN 'done' WHEN status = 'error' OR age > 86400000000 THEN 'dead' WHEN age > 21600000000 THEN 'stale' ELSE 'ok' END AS health FROM x")(
    lambda s, d: agent_health(messages(s, d), "purchase", "error", 21_600, 86_400)
)
