"""Event-time time-outs in streams: timers that fire, and messages that count as lost, without a later row of their key.

`timer_stream` keeps each agent's open timers and the rows that the watermark hasn't passed. Rows are taken in the order of (ts, id) once
the watermark is beyond them, so the outcome doesn't hang on how they were dealt to micro-batches; time-outs come with the watermark. An agent
without open timers or waiting rows has no state. `acknowledgement_stream` is an outer join of two streams: a message whose wait is over
without an acknowledgement leaves the join's state as lost.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans import Catalog
from tessera.plans.bind import MESSAGES, messages
from tessera.plans.loop import folder

catalog = Catalog()

OUTCOMES = "agent_id long, id long, type string, expires timestamp, status string"


class Timers:
    """One agent's timers: open ones, fired ones that may still be acknowledged, and rows that wait for the watermark. Times in microseconds."""

    def __init__(self, told: str | None, timeouts: dict[str, int], cancel: str, ack: str, ack_within: int) -> None:
        self.open, self.fired, self.waiting = json.loads(told) if told else ([], [], [])
        self.timeouts, self.cancel, self.ack, self.ack_within = timeouts, cancel, ack, ack_within * 1_000_000

    def told(self) -> str:
        return json.dumps([self.open, self.fired, self.waiting])

    def add(self, at: int, id: int, kind: str) -> None:
        if kind in self.timeouts or kind in (self.cancel, self.ack):
            self.waiting.append([at, id, kind])

    def until(self, watermark: int) -> list[tuple[int, str, int, str]]:
        """(id, type, expires, status) of what happens before the watermark."""
        out = []
        ready = sorted(x for x in self.waiting if x[0] < watermark)
        self.waiting = [x for x in self.waiting if x[0] >= watermark]
        for at, id, kind in ready:
            out += self._expire(at)
            if kind == self.cancel:
                gone = [t for t in self.open if t[0] < at]
                self.open = [t for t in self.open if t[0] >= at]
                out += [(i, k, end, "cancelled") for _, i, k, end in gone]
            if kind == self.ack:
                out += [(i, k, end, "acknowledged") for _, i, k, end in self.fired]
                self.fired = []
            if kind in self.timeouts:
                self.open.append([at, id, kind, at + self.timeouts[kind] * 1_000_000])
        return out + self._expire(watermark - 1)

    def _expire(self, now: int) -> list[tuple[int, str, int, str]]:
        ended = sorted((t for t in self.open if t[3] <= now), key=lambda t: (t[3], t[1]))
        self.open = [t for t in self.open if t[3] > now]
        self.fired = [t for t in self.fired + ended if t[3] + self.ack_within > now]
        return [(i, k, end, "fired") for _, i, k, end in ended]

    def next(self) -> int | None:
        """When something happens next, if no row comes."""
        times = [x[0] for x in self.waiting] + [t[3] for t in self.open] + [t[3] + self.ack_within for t in self.fired]
        return min(times, default=None)


def timer_stream(m: DataFrame, timeouts: dict[str, int], cancel: str, ack: str, delay: str = "1 hour", ack_within: int = 7 * 86_400) -> DataFrame:
    """A stream of what becomes of each timer, as `timer_log` has it: `cancelled`; `fired` once the watermark is past its end; then `acknowledged`, if an ack comes within `ack_within` seconds.

    m: a stream of agent_id, id, type, ts. Rows later than the delay are dropped; null types and ids start nothing.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        timers = Timers(held.get[0] if held.exists else None, timeouts, cancel, ack, ack_within)
        for batch in batches:
            for at, id, kind in zip(batch["at"], batch["id"], batch["type"]):
                timers.add(int(at), int(id), kind)
        watermark = held.getCurrentWatermarkMs()
        found = timers.until(watermark * 1000)
        if (due := timers.next()) is None:
            if held.exists:
                held.remove()
        else:
            held.update((timers.told(),))
            # The first whole millisecond by which the watermark is past it.
            held.setTimeoutTimestamp(max(due // 1000 + 1, watermark + 1))
        if found:
            ids, kinds, ends, statuses = zip(*found)
            yield pd.DataFrame({"agent_id": key[0], "id": ids, "type": kinds, "expires": pd.to_datetime(pd.Series(ends), unit="us"), "status": statuses})

    rows = m.filter("agent_id IS NOT NULL AND id IS NOT NULL AND type IS NOT NULL").withWatermark("ts", delay)
    rows = rows.select("agent_id", "id", "type", "ts", F.unix_micros("ts").alias("at"))
    return rows.groupBy("agent_id").applyInPandasWithState(run, OUTCOMES, "told string", "append", GroupStateTimeout.EventTimeTimeout)


def last_outcomes(outcomes: DataFrame) -> DataFrame:
    """One row per timer: an acknowledged one has also fired before."""
    return outcomes.groupBy("agent_id", "id", "type", "expires").agg(F.min("status").alias("status"))  # acknowledged < cancelled < fired


def acknowledgement_stream(sent: DataFrame, acks: DataFrame, within: str, delay: str = "1 hour") -> DataFrame:
    """A stream of (agent_id, id, sent_at, acked_at): the first acknowledgement by the message's agent after it and within the interval; null once the watermark is past all that could come.

    Both are streams of agent_id, id, ts. The join keeps a message until its wait is over, the sum until its join has ended.
    """
    s = sent.select("agent_id", "id", F.col("ts").alias("sent_at")).withWatermark("sent_at", delay)
    a = acks.select(F.col("agent_id").alias("by"), F.col("ts").alias("acked_at")).withWatermark("acked_at", delay)
    held = (F.col("agent_id") == F.col("by")) & (F.col("acked_at") > F.col("sent_at")) & (F.col("acked_at") <= F.col("sent_at") + F.expr(within))
    return s.join(a, held, "left_outer").groupBy("agent_id", "id", "sent_at").agg(F.min("acked_at").alias("acked_at"))


def drained(stream: DataFrame, checkpoint: str | None = None) -> DataFrame:
    """All that a stream has given for what lay at its source so far, as a table under spark.checkpoint.dir; with the same checkpoint the next call goes on where the last one ended."""
    spark = stream.sparkSession
    root = checkpoint or f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def _stream(s, d) -> DataFrame:
    """The events as a stream of messages, from the table's files."""
    events = s.read.parquet(f"{d}/events.parquet")
    raw = s.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(f"{d}/events.parque[t]")
    return raw.select(F.col("user_id").alias("agent_id"), F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.col("ts").cast("timestamp").alias("ts"))


# As the watermark stands at the end: an hour before the last message; what is not before it hasn't happened yet.
_MARK = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM messages)"
_LOG = f"""{MESSAGES}, t AS (SELECT agent_id, id, type, ts, ts + CASE type WHEN 'signup' THEN INTERVAL 12 HOUR ELSE INTERVAL 24 HOUR END AS expires FROM messages WHERE type IN ('signup', 'error') AND ts < {_MARK}),
c AS (SELECT t.id, min(m.ts) AS cancel FROM t JOIN messages m ON m.agent_id = t.agent_id AND m.type = 'purchase' AND m.ts > t.ts WHERE m.ts < {_MARK} GROUP BY t.id),
k AS (SELECT t.id, min(m.ts) AS ack FROM t JOIN messages m ON m.agent_id = t.agent_id AND m.type = 'click' AND m.ts >= t.expires AND m.ts < t.expires + INTERVAL 7 DAY WHERE m.ts < {_MARK} GROUP BY t.id),
l AS (SELECT t.agent_id, t.id, t.type, t.expires, CASE WHEN coalesce(cancel < expires, false) THEN 'cancelled' WHEN expires >= {_MARK} THEN 'active' WHEN ack IS NOT NULL THEN 'acknowledged' ELSE 'fired' END AS status FROM t LEFT JOIN c ON t.id = c.id LEFT JOIN k ON t.id = k.id)"""
catalog.add("stream_timer_outcomes", f"WITH {_LOG} SELECT * FROM l WHERE status <> 'active'")(
    lambda s, d: last_outcomes(drained(timer_stream(_stream(s, d), {"signup": 43_200, "error": 86_400}, "purchase", "click"))).withColumn("expires", F.col("expires").cast("timestamp_ntz"))
)
catalog.add("stream_acknowledgements", f"""WITH {MESSAGES}, a AS (SELECT s.agent_id, s.id, s.ts AS sent_at, min(a.ts) AS acked_at FROM messages s LEFT JOIN messages a ON a.agent_id = s.agent_id AND a.type = 'purchase' AND a.ts > s.ts AND a.ts <= s.ts + INTERVAL 6 HOUR
  WHERE s.type = 'click' GROUP BY ALL) SELECT * FROM a WHERE sent_at + INTERVAL 7 HOUR < (SELECT min(x) FROM (SELECT max(ts) AS x FROM messages WHERE type IN ('click', 'purchase') GROUP BY type))""")(
    lambda s, d: (lambda m: drained(acknowledgement_stream(m.filter("type = 'click'"), m.filter("type = 'purchase'"), "INTERVAL 6 HOURS")).select("agent_id", "id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("sent_at", "acked_at")]))(_stream(s, d))
)
