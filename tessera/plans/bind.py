"""How the operators' inputs come from the test tables: as DataFrames, and as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans import table


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Documents as catalogue entries."""
    n = F.col("doc_id")
    return table(spark, d, "documents").select(
        F.concat(F.lit("DOC-"), F.lpad(n.cast("string"), 7, "0")).alias("id"),
        n.alias("numeric_id"),
        F.col("source").alias("resource_type"),
        F.left(F.substring_index("text", "\n", 1), F.lit(80)).alias("title"),
        F.left("text", F.lit(200)).alias("summary"),
        F.col("lang").alias("category"),
        F.element_at(F.array(*map(F.lit, ("active", "draft", "archived"))), (n % 3 + 1).cast("int")).alias("status"),
        F.date_add(F.lit("2024-01-01").cast("date"), (n % 365).cast("int")).alias("created"),
        F.concat(F.lit("team"), (n % 7).cast("string")).alias("team"),
        F.col("n_chars").alias("char_count"),
        F.col("text").alias("body"),
    )


ENTRIES = """entries AS (SELECT 'DOC-' || lpad(doc_id::VARCHAR, 7, '0') AS id, doc_id AS numeric_id, source AS resource_type,
  left(string_split(text, chr(10))[1], 80) AS title, left(text, 200) AS summary, lang AS category,
  ['active', 'draft', 'archived'][(doc_id % 3 + 1)::INT] AS status, DATE '2024-01-01' + (doc_id % 365)::INT AS created,
  'team' || (doc_id % 7)::VARCHAR AS team, n_chars AS char_count, text AS body FROM documents)"""


def baskets(spark: SparkSession, d: str) -> DataFrame:
    """(entry_id, tag): the distinct parts of each order."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entry_id"), F.col("l_partkey").alias("tag")).distinct()


BASKETS = "tags AS (SELECT DISTINCT l_orderkey AS entry_id, l_partkey AS tag FROM lineitem)"

STRENGTHS = ("strong", "medium", "weak")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, weight 0..10, strength, reasons): parts that follow each other in an order, by line number."""
    from pyspark.sql import Window

    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_suppkey", "l_extendedprice")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    hops = lines.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), "l_quantity", "l_returnflag").filter("dst IS NOT NULL AND src <> dst")
    e = hops.groupBy("src", "dst").agg(F.least(F.floor(F.sum("l_quantity") / 5), F.lit(10)).cast("int").alias("weight"), F.array_sort(F.collect_set(F.concat(F.lit("flag "), F.col("l_returnflag")))).alias("reasons"))
    strength = F.when(F.col("weight") >= 7, "strong").when(F.col("weight") >= 4, "medium").otherwise("weak")
    return e.select("src", "dst", "weight", strength.alias("strength"), "reasons")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """(id, domain, tags) of parts."""
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("domain"), F.array_sort(F.array_distinct(F.concat(F.split("p_name", " "), F.array(F.lower("p_type"))))).alias("tags"))


GRAPH = """edges AS (SELECT src, dst, least(floor(sum(q) / 5), 10)::INT AS weight,
    CASE WHEN least(floor(sum(q) / 5), 10) >= 7 THEN 'strong' WHEN least(floor(sum(q) / 5), 10) >= 4 THEN 'medium' ELSE 'weak' END AS strength,
    list_sort(list(DISTINCT 'flag ' || f)) AS reasons
  FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst,
    l_quantity AS q, l_returnflag AS f FROM lineitem) WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst),
nodes AS (SELECT p_partkey AS id, p_brand AS domain, list_sort(list_distinct(list_append(string_split(p_name, ' '), lower(p_type)))) AS tags FROM part)"""


def routes(spark: SparkSession, d: str) -> DataFrame:
    """(agent, day, route, outcome): a user's event types of a day in order; the last one decides the outcome."""
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", "event_type")
    r = e.groupBy("user_id", "day").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))["event_type"].alias("route"))
    last = F.element_at("route", -1)
    return r.select(F.col("user_id").alias("agent"), "day", "route", F.when(last == "purchase", "success").when(last == "error", "failure").otherwise("open").alias("outcome"))


ROUTES = """routes AS (SELECT user_id AS agent, ts::DATE AS day, list(event_type ORDER BY ts, event_id) AS route,
  CASE arg_max(event_type, (ts, event_id)) WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failure' ELSE 'open' END AS outcome
  FROM events GROUP BY 1, 2)"""


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Events as bus messages."""
    n = F.col("event_id")
    return table(spark, d, "events").select(
        n.alias("id"), F.col("event_type").alias("type"), F.concat(F.lit("ch"), (n % 5).cast("string")).alias("channel"), F.concat(F.lit("team"), (F.col("user_id") % 7).cast("string")).alias("team"),
        F.col("user_id").alias("agent_id"), F.col("ts").cast("timestamp").alias("ts"), (60 + n % 10 * 600).cast("int").alias("ttl"), F.col("props").alias("body"), (n % 4).cast("int").alias("priority"), F.col("value"),
    )


MESSAGES = """messages AS (SELECT event_id AS id, event_type AS type, 'ch' || (event_id % 5)::VARCHAR AS channel, 'team' || (user_id % 7)::VARCHAR AS team,
  user_id AS agent_id, ts, (60 + event_id % 10 * 600)::INT AS ttl, props AS body, (event_id % 4)::INT AS priority, value FROM events)"""


def prices(spark: SparkSession, d: str) -> DataFrame:
    """(ticker, month, revenue, volume): monthly sales of each brand."""
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    j = li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("ticker"), F.to_date(F.trunc(F.to_date("l_shipdate"), "month")).alias("month"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"))
    return j.groupBy("ticker", "month").agg(F.round(F.avg("price"), 4).alias("close"), F.round(F.max("price"), 4).alias("high"), F.round(F.min("price"), 4).alias("low"), F.round(F.sum("quantity"), 2).alias("volume"))


PRICES = """prices AS (SELECT p_brand AS ticker, date_trunc('month', l_shipdate)::DATE AS month, round(avg(l_extendedprice), 4) AS close,
  round(max(l_extendedprice), 4) AS high, round(min(l_extendedprice), 4) AS low, round(sum(l_quantity), 2) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""

#: Tokens of a text in DuckDB, as tessera.functions.text.tokens has them.
def sql_tokens(text: str, least: int = 2) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{{least},}}'))"
