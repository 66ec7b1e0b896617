"""Aggregations, rankings, set operations and change capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.operators.ranks import counted_values, with_summary
from tessera.plans import Catalog, table
from tessera.plans.bind import BASKETS, ENTRIES, GRAPH, MESSAGES, ROUTES, baskets, edges, entries, messages, nodes, routes

catalog = Catalog()
docs = lambda spark, d: table(spark, d, "documents")

# Summaries.
catalog.add("agg_type_summary", f"WITH {ENTRIES} SELECT resource_type, count(*) AS n, max(created) AS latest, count(DISTINCT category) AS categories FROM entries GROUP BY resource_type")(
    lambda s, d: entries(s, d).groupBy("resource_type").agg(F.count("*").alias("n"), F.max("created").alias("latest"), F.count_distinct("category").alias("categories"))
)
catalog.add("agg_category_counts", f"WITH {ENTRIES} SELECT resource_type, category, count(*) AS n FROM entries GROUP BY ALL")(lambda s, d: entries(s, d).groupBy("resource_type", "category").agg(F.count("*").alias("n")))
catalog.add("agg_tag_cloud", f"WITH {BASKETS} SELECT tag, count(*) AS n FROM tags GROUP BY tag")(lambda s, d: baskets(s, d).groupBy("tag").agg(F.count("*").alias("n")))
catalog.add("agg_nested_arrays", f"WITH {BASKETS} SELECT entry_id, list_sort(list(tag)) AS tags, count(*) AS n FROM tags GROUP BY entry_id")(
    lambda s, d: baskets(s, d).groupBy("entry_id").agg(F.array_sort(F.collect_list("tag")).alias("tags"), F.count("*").alias("n"))
)
catalog.add("graph_summary", f"WITH {GRAPH} SELECT strength, weight, count(*) AS n FROM edges GROUP BY GROUPING SETS ((strength), (weight))")(
    lambda s, d: edges(s, d).groupingSets([[F.col("strength")], [F.col("weight")]], "strength", "weight").agg(F.count("*").alias("n"))
)
catalog.add("graph_reason_counts", f"WITH {GRAPH}, r AS (SELECT unnest(reasons) AS reason FROM edges) SELECT reason, count(*) AS n FROM r GROUP BY reason")(
    lambda s, d: edges(s, d).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
)


def snapshot_metrics(n: DataFrame, e: DataFrame) -> DataFrame:
    """One row: counts, share of strong edges, orphans, weight statistics."""
    ends = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    orphans = n.join(ends, "id", "left_anti").agg(F.count("*").alias("orphans"))
    stats = e.agg(F.count("*").alias("edges"), F.round(F.avg((F.col("strength") == "strong").cast("double")), 6).alias("strong_share"), F.round(F.avg("weight"), 6).alias("mean_weight"), F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight"))
    return stats.join(orphans).join(n.agg(F.count("*").alias("nodes")))


catalog.add("graph_snapshot_metrics", f"""WITH {GRAPH} SELECT (SELECT count(*) FROM nodes) AS nodes, count(*) AS edges, round(avg((strength = 'strong')::INT), 6) AS strong_share, round(avg(weight), 6) AS mean_weight, min(weight) AS min_weight, max(weight) AS max_weight,
 (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)) AS orphans FROM edges""")(lambda s, d: snapshot_metrics(nodes(s, d), edges(s, d)))


# Routes.


def hops(r: DataFrame) -> DataFrame:
    """(agent, day, outcome, pos, src, dst): consecutive stops of each route."""
    stops = r.select("agent", "day", "outcome", F.posexplode(F.arrays_zip(F.col("route").alias("a"), F.slice("route", 2, 1_000_000).alias("b"))).alias("pos", "h"))
    return stops.select("agent", "day", "outcome", "pos", F.col("h.a").alias("src"), F.col("h.b").alias("dst")).filter("dst IS NOT NULL")


HOPS = f"{ROUTES}, hops AS (SELECT agent, day, outcome, i AS pos, route[i + 1] AS src, route[i + 2] AS dst FROM routes, unnest(range(0, len(route) - 1)) AS u(i))"
catalog.add("route_edge_outcomes", f"WITH {HOPS} SELECT src, dst, count(*) FILTER (outcome = 'success') AS success, count(*) FILTER (outcome = 'failure') AS failure, count(*) FILTER (outcome = 'open') AS open FROM hops GROUP BY src, dst")(
    lambda s, d: hops(routes(s, d)).groupBy("src", "dst").agg(*[F.count_if(F.col("outcome") == x).alias(x) for x in ("success", "failure", "open")])
)
catalog.add("route_entry_exit", f"WITH {ROUTES} SELECT route[1] AS entry, route[-1] AS exit, count(*) AS n, round(avg((outcome = 'success')::INT), 6) AS success_rate FROM routes GROUP BY 1, 2")(
    lambda s, d: routes(s, d).groupBy(F.col("route")[0].alias("entry"), F.element_at("route", -1).alias("exit")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("outcome") == "success").cast("double")), 6).alias("success_rate"))
)


def route_patterns(r: DataFrame, task: str, top: int = 3) -> DataFrame:
    """Per task the signatures ranked by count times success rate."""
    p = r.groupBy(task, F.concat_ws(">", "route").alias("signature")).agg(F.count("*").alias("n"), F.avg((F.col("outcome") == "success").cast("double")).alias("rate"))
    w = Window.partitionBy(task).orderBy(F.desc(F.col("n") * F.col("rate")), F.desc("n"), "signature")
    return p.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select(task, "signature", "n", F.round("rate", 6).alias("rate"), "rank")


catalog.add("route_patterns", f"""WITH {ROUTES}, p AS (SELECT route[1] AS task, array_to_string(route, '>') AS signature, count(*) AS n, avg((outcome = 'success')::INT) AS rate FROM routes GROUP BY 1, 2)
SELECT task, signature, n, round(rate, 6) AS rate, row_number() OVER (PARTITION BY task ORDER BY n * rate DESC, n DESC, signature) AS rank FROM p QUALIFY rank <= 3""")(
    lambda s, d: route_patterns(routes(s, d).withColumn("task", F.col("route")[0]), "task")
)
catalog.add("route_top_from_entry", f"WITH {ROUTES} SELECT array_to_string(route, '>') AS signature, count(*) AS n, count(*) FILTER (outcome = 'success') AS success FROM routes WHERE route[1] = 'view' GROUP BY 1 ORDER BY n DESC, signature LIMIT 10")(
    lambda s, d: routes(s, d).filter(F.col("route")[0] == "view").groupBy(F.concat_ws(">", "route").alias("signature")).agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "success").alias("success")).orderBy(F.desc("n"), "signature").limit(10)
)


def recommended_route(r: DataFrame) -> DataFrame:
    """(entry, signature, tier): the best pattern with some success (tier 1), else the commonest pattern (tier 2)."""
    p = r.groupBy(F.col("route")[0].alias("entry"), F.concat_ws(">", "route").alias("signature")).agg(F.count("*").alias("n"), F.avg((F.col("outcome") == "success").cast("double")).alias("rate"))
    tier = F.when(F.col("rate") > 0, 1).otherwise(2)
    w = Window.partitionBy("entry").orderBy(tier, F.desc(F.col("n") * F.greatest("rate", F.lit(1e-9))), "signature")
    return p.withColumn("tier", tier).withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("entry", "signature", "tier")


catalog.add("route_recommendation", f"""WITH {ROUTES}, p AS (SELECT route[1] AS entry, array_to_string(route, '>') AS signature, count(*) AS n, avg((outcome = 'success')::INT) AS rate FROM routes GROUP BY 1, 2)
SELECT entry, signature, CASE WHEN rate > 0 THEN 1 ELSE 2 END AS tier FROM p QUALIFY row_number() OVER (PARTITION BY entry ORDER BY CASE WHEN rate > 0 THEN 1 ELSE 2 END, n * greatest(rate, 1e-9) DESC, signature) = 1""")(lambda s, d: recommended_route(routes(s, d)))
catalog.add("route_risky_edges", f"""WITH {HOPS}, m AS (SELECT src, dst, count(*) AS n, avg((outcome = 'failure')::INT) AS failure FROM hops WHERE outcome <> 'open' GROUP BY src, dst) SELECT src, dst, n, round(failure, 6) AS failure FROM m WHERE n >= 2 AND failure > 0.3""")(
    lambda s, d: hops(routes(s, d)).filter("outcome <> 'open'").groupBy("src", "dst").agg(F.count("*").alias("n"), F.avg((F.col("outcome") == "failure").cast("double")).alias("f")).filter("n >= 2 AND f > 0.3").select("src", "dst", "n", F.round("f", 6).alias("failure"))
)
catalog.add("status_rollup", "SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS slowest, count(*) FILTER (o_totalprice < 50000) AS below FROM orders GROUP BY o_orderstatus")(
    lambda s, d: table(s, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("slowest"), F.count_if(F.col("o_totalprice") < 50000).alias("below"))
)
catalog.add("load_report", f"WITH {MESSAGES}, l AS (SELECT team, count(*) AS load FROM messages WHERE type = 'error' GROUP BY team) SELECT count(*) AS teams, sum(load)::BIGINT AS total, round(avg(load), 6) AS mean, coalesce(list_sort(list(team) FILTER (load > 280)), []) AS overloaded FROM l")(
    lambda s, d: messages(s, d).filter("type = 'error'").groupBy("team").agg(F.count("*").alias("load")).agg(F.count("*").alias("teams"), F.sum("load").alias("total"), F.round(F.avg("load"), 6).alias("mean"), F.array_sort(F.collect_list(F.when(F.col("load") > 280, F.col("team")))).alias("overloaded"))
)


def exact_percentiles(rows: DataFrame, group: str, value: str, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Values at 0-based index floor(n * p / 100), clamped, with count, min, max and mean, of the rows with a value."""
    at = {f"p{p}": F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1) for p in percents}
    found = with_summary(counted_values(rows, group, value), group, value, at)
    return found.select(group, "n", *at, "least", "most", F.round("mean", 6).alias("mean"))


_PCT = ", ".join(f"max(value) FILTER (i = least(n * {p} // 100, n - 1)) AS p{p}" for p in (50, 95, 99))
catalog.add("latency_percentiles", f"WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, count(*) AS n, {_PCT}, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean FROM r GROUP BY event_type")(
    lambda s, d: exact_percentiles(table(s, d, "events"), "event_type", "value")
)
catalog.add("merge_topics", "SELECT p_type AS category, list_sort(list(DISTINCT lower(p_name))) AS techniques, count(DISTINCT p_brand) AS sources, round(avg(p_size), 4) AS mean_size FROM part GROUP BY p_type")(
    lambda s, d: table(s, d, "part").groupBy(F.col("p_type").alias("category")).agg(F.array_sort(F.collect_set(F.lower("p_name"))).alias("techniques"), F.count_distinct("p_brand").alias("sources"), F.round(F.avg("p_size"), 4).alias("mean_size"))
)
catalog.add("coverage_gaps", "SELECT c.x AS p_type, t.x AS p_brand FROM (SELECT DISTINCT p_type AS x FROM part) c, (SELECT DISTINCT p_brand AS x FROM part) t WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_type = c.x AND p_brand = t.x AND p_size > 45)")(
    lambda s, d: coverage_gaps(table(s, d, "part").filter("p_size > 45"), table(s, d, "part"), "p_type", "p_brand")
)


def coverage_gaps(covered: DataFrame, everything: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of known values of a and b that covered lacks: per a, the set of all b less those covered."""
    all_b = everything.agg(F.collect_set(b).alias("all"))  # the known values of one column
    have = covered.groupBy(a).agg(F.collect_set(b).alias("have"))
    grid = everything.select(a).distinct().join(have, a, "left").join(F.broadcast(all_b))
    return grid.select(a, F.explode(F.array_except("all", F.coalesce("have", F.array().cast("array<string>")))).alias(b))


catalog.add("overlap_confirmed", "SELECT p_name, count(DISTINCT p_brand) > 1 AS confirmed, count(DISTINCT p_brand) AS teams FROM part GROUP BY p_name")(
    lambda s, d: table(s, d, "part").groupBy("p_name").agg(F.count_distinct("p_brand").alias("teams")).select("p_name", (F.col("teams") > 1).alias("confirmed"), "teams")
)
catalog.add("bus_summary", f"WITH {MESSAGES} SELECT channel, team, type, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM messages GROUP BY GROUPING SETS ((channel), (team), (type), ())")(
    lambda s, d: messages(s, d).groupingSets([[F.col("channel")], [F.col("team")], [F.col("type")], []], "channel", "team", "type").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
)
_BAND = "CASE WHEN n <= 2 THEN 'tiny' WHEN n <= 5 THEN 'small' WHEN n <= 10 THEN 'medium' WHEN n <= 15 THEN 'large' ELSE 'huge' END"
catalog.add("size_bands", f"WITH b AS (SELECT user_id, ts::DATE AS day, count(*) AS n, avg((event_type <> 'error')::INT) AS eff FROM events GROUP BY 1, 2) SELECT {_BAND} AS band, count(*) AS groups, round(avg(eff), 6) AS efficiency, count(*) FILTER (n > 15 AND eff < 0.5) AS weak FROM b GROUP BY 1")(
    lambda s, d: table(s, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.avg((F.col("event_type") != "error").cast("double")).alias("eff"))
    .groupBy(F.when(F.col("n") <= 2, "tiny").when(F.col("n") <= 5, "small").when(F.col("n") <= 10, "medium").when(F.col("n") <= 15, "large").otherwise("huge").alias("band"))
    .agg(F.count("*").alias("groups"), F.round(F.avg("eff"), 6).alias("efficiency"), F.count_if((F.col("n") > 15) & (F.col("eff") < 0.5)).alias("weak"))
)


def evenness(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Sample deviation over mean, 0 for fewer than two values or a mean of 0."""
    return rows.groupBy(group).agg(F.round(F.when((F.count(value) < 2) | (F.avg(value) == 0), 0.0).otherwise(F.stddev_samp(value) / F.avg(value)), 6).alias("cv"))


catalog.add("evenness_cv", "SELECT event_type, round(CASE WHEN count(n) < 2 OR avg(n) = 0 THEN 0 ELSE stddev_samp(n) / avg(n) END, 6) AS cv FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")(
    lambda s, d: evenness(table(s, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n")), "event_type", "n")
)
catalog.add("link_index", r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS url FROM pages) SELECT url, count(DISTINCT page_id) AS referenced_by, min(page_id) AS first_page FROM l GROUP BY url""")(
    lambda s, d: table(s, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("url")).groupBy("url").agg(F.count_distinct("page_id").alias("referenced_by"), F.min("page_id").alias("first_page"))
)
catalog.add("category_rollup", "SELECT p_type, p_brand, list(p_partkey ORDER BY p_retailprice DESC, p_partkey)[1:5] AS best, count(*) AS n FROM part GROUP BY 1, 2")(
    lambda s, d: table(s, d, "part").groupBy("p_type", "p_brand").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("p_retailprice")).alias("x"), "p_partkey")))["p_partkey"], 1, 5).alias("best"), F.count("*").alias("n"))
)
catalog.add("strategy_comparison", f"WITH {ROUTES} SELECT route[1] AS strategy, round(avg((outcome = 'success')::INT), 6) AS success_rate, round(avg(CASE WHEN outcome = 'success' THEN len(route) - 1 END), 6) AS mean_hops FROM routes GROUP BY 1")(
    lambda s, d: routes(s, d).groupBy(F.col("route")[0].alias("strategy")).agg(F.round(F.avg((F.col("outcome") == "success").cast("double")), 6).alias("success_rate"), F.round(F.avg(F.when(F.col("outcome") == "success", F.size("route") - 1)), 6).alias("mean_hops"))
)
catalog.add("roadmap_groups", "SELECT o_orderstatus AS category, o_orderpriority AS priority, count(*) AS n, count(DISTINCT o_custkey) AS teams FROM orders GROUP BY 1, 2 ORDER BY 2, 1")(
    lambda s, d: table(s, d, "orders").groupBy(F.col("o_orderstatus").alias("category"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("teams")).orderBy("priority", "category")
)
catalog.add("source_statistics", "SELECT source, count(*) AS n, round(avg(n_chars), 4) AS mean_chars, count(*) FILTER (n_chars >= 2000) AS long FROM documents GROUP BY source")(
    lambda s, d: docs(s, d).groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.count_if(F.col("n_chars") >= 2000).alias("long"))
)

# Rankings and windows.
catalog.add("recent_entries", f"WITH {ENTRIES} SELECT id, created FROM entries ORDER BY created DESC, id DESC LIMIT 10")(lambda s, d: entries(s, d).select("id", "created").orderBy(F.desc("created"), F.desc("id")).limit(10))


def success_trend(rows: DataFrame, group: str, order: list[Column], good: Column, recent: int = 20) -> DataFrame:
    """Mean of the last `recent` rows against all: improving (> 0.05), declining (< -0.05) or stable."""
    w = Window.partitionBy(group).orderBy(*order)
    r = rows.select(group, good.cast("double").alias("g"), F.row_number().over(w).alias("rn")).groupBy(group).agg(F.avg("g").alias("a"), F.avg(F.when(F.col("rn") <= recent, F.col("g"))).alias("b"))
    delta = F.col("b") - F.col("a")
    return r.select(group, F.round("a", 6).alias("overall"), F.round("b", 6).alias("recent"), F.when(delta > 0.05, "improving").when(delta < -0.05, "declining").otherwise("stable").alias("trend"))


catalog.add("success_trend", "WITH r AS (SELECT user_id, (event_type <> 'error')::INT AS g, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events), x AS (SELECT user_id, avg(g) AS a, avg(g) FILTER (rn <= 20) AS b FROM r GROUP BY user_id) SELECT user_id, round(a, 6) AS overall, round(b, 6) AS recent, CASE WHEN b - a > 0.05 THEN 'improving' WHEN b - a < -0.05 THEN 'declining' ELSE 'stable' END AS trend FROM x")(
    lambda s, d: success_trend(table(s, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], F.col("event_type") != "error")
)
catalog.add("route_hop_pairs", f"WITH {HOPS} SELECT src, dst, count(*) AS n, round(avg(pos), 6) AS mean_pos FROM hops GROUP BY src, dst")(lambda s, d: hops(routes(s, d)).groupBy("src", "dst").agg(F.count("*").alias("n"), F.round(F.avg("pos"), 6).alias("mean_pos")))
catalog.add("route_ngrams", f"""WITH {ROUTES}, g AS (SELECT array_to_string(route[i + 1:i + n], '>') AS gram FROM routes, unnest([2, 3]) AS k(n), unnest(range(0, greatest(len(route) - n + 1, 0))) AS u(i)) SELECT gram, count(*) AS n FROM g GROUP BY gram""")(lambda s, d: path_ngrams(routes(s, d), "route").groupBy("gram").agg(F.count("*").alias("n")))


def path_ngrams(rows: DataFrame, path: str, sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """(gram): all runs of those lengths of each path."""
    grams = lambda n: F.when(F.size(path) >= n, F.transform(F.sequence(F.lit(1), F.size(path) - (n - 1)), lambda i: F.array_join(F.slice(path, i, F.lit(n)), ">"))).otherwise(F.array().cast("array<string>"))
    return rows.select(F.explode(F.concat(*map(grams, sizes))).alias("gram"))


catalog.add("next_ids", "SELECT source, max(doc_id) + 1 AS next_id, count(*) AS n FROM documents GROUP BY source")(lambda s, d: docs(s, d).groupBy("source").agg((F.max("doc_id") + 1).alias("next_id"), F.count("*").alias("n")))
catalog.add("priority_batch", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS claim FROM orders QUALIFY claim <= 3")(
    lambda s, d: table(s, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderdate", "o_orderkey")).alias("claim")).filter("claim <= 3")
)
catalog.add("rank_min_score", "SELECT p_partkey, round(p_retailprice / p_size, 4) AS score FROM part WHERE p_retailprice / p_size >= 100 ORDER BY score DESC, p_partkey LIMIT 25")(
    lambda s, d: table(s, d, "part").filter(F.col("p_retailprice") / F.col("p_size") >= 100).select("p_partkey", F.round(F.col("p_retailprice") / F.col("p_size"), 4).alias("score")).orderBy(F.desc("score"), "p_partkey").limit(25)
)
catalog.add("hub_ranking", f"WITH {GRAPH}, d AS (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) SELECT id, count(*) AS degree FROM d GROUP BY id ORDER BY degree DESC, id LIMIT 10")(
    lambda s, d: edges(s, d).select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "id").limit(10)
)
catalog.add("step_winner", f"WITH {GRAPH} SELECT src, dst, weight FROM edges QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) = 1")(
    lambda s, d: edges(s, d).groupBy("src").agg(F.max_by(F.struct("dst", "weight"), F.struct("weight", -F.col("dst"))).alias("w")).select("src", "w.dst", "w.weight")
)


# Vector clocks: maps from agent to count, absent is 0.


def clock_before(a: Column, b: Column) -> Column:
    pairs = F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(y, F.lit(0)) - F.coalesce(x, F.lit(0))))
    return F.forall(pairs, lambda x: x >= 0) & F.exists(pairs, lambda x: x > 0)


def clock_merge(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def _clocks(s, d) -> DataFrame:
    """Messages with a clock of two agents' counts; every seventh is delivered late."""
    n = F.col("event_id")
    return table(s, d, "events").select("user_id", "event_id", "ts", F.create_map(F.lit("a"), (n % 11).cast("int"), F.lit("b"), (n % 7).cast("int")).alias("clock"))


catalog.add("clock_out_of_order", "WITH e AS (SELECT user_id, event_id, event_id % 11 AS a, event_id % 7 AS b, lag(event_id % 11) OVER w AS pa, lag(event_id % 7) OVER w AS pb FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, event_id FROM e WHERE a <= pa AND b <= pb AND (a < pa OR b < pb)")(
    lambda s, d: _clocks(s, d).withColumn("before", F.lag("clock").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).filter(clock_before(F.col("clock"), F.col("before"))).select("user_id", "event_id")
)
catalog.add("clock_causal_sort", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 11 + event_id % 7, ts, event_id) AS place FROM events")(
    lambda s, d: _clocks(s, d).select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.aggregate(F.map_values("clock"), F.lit(0), lambda x, y: x + y), "ts", "event_id")).alias("place"))
)
catalog.add("clock_relations", "WITH e AS (SELECT user_id, event_id, event_id % 11 AS a, event_id % 7 AS b, lag(event_id % 11) OVER w AS pa, lag(event_id % 7) OVER w AS pb FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, CASE WHEN a = pa AND b = pb THEN 'equal' WHEN pa <= a AND pb <= b THEN 'before' WHEN a <= pa AND b <= pb THEN 'after' ELSE 'concurrent' END AS relation, greatest(a, pa)::INT AS merged_a FROM e WHERE pa IS NOT NULL")(
    lambda s, d: _clocks(s, d).withColumn("p", F.lag("clock").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).filter("p IS NOT NULL")
    .select("event_id", F.when(clock_before(F.col("p"), F.col("clock")), "before").when(clock_before(F.col("clock"), F.col("p")), "after").when(F.forall(F.map_values(F.map_zip_with("p", "clock", lambda _, x, y: x == y)), lambda x: x), "equal").otherwise("concurrent").alias("relation"), clock_merge(F.col("p"), F.col("clock"))["a"].alias("merged_a"))
)


# Set operations and versions: two date cuts of the orders are two snapshots.


def snapshot_diff(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change, before, after): rows added, removed and changed from a to b."""
    j = a.select(key, F.col(value).alias("before"), F.lit(1).alias("_a")).join(b.select(key, F.col(value).alias("after"), F.lit(1).alias("_b")), key, "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return j.select(key, change.alias("change"), "before", "after").filter("change IS NOT NULL")


def _cut(s, d, first: str, last: str) -> DataFrame:
    return table(s, d, "orders").filter(F.col("o_orderdate").between(first, last)).groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


_CUT = "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate BETWEEN '{}' AND '{}' GROUP BY 1"
_A, _B = ("1995-01-01", "1998-01-01"), ("1996-01-01", "1999-01-01")
catalog.add("snapshot_diff", f"WITH a AS ({_CUT.format(*_A)}), b AS ({_CUT.format(*_B)}) SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN a.o_custkey IS NULL THEN 'added' WHEN b.o_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change, a.total AS before, b.total AS after FROM a FULL JOIN b ON a.o_custkey = b.o_custkey WHERE a.total IS DISTINCT FROM b.total")(
    lambda s, d: snapshot_diff(_cut(s, d, *_A), _cut(s, d, *_B), "o_custkey", "total")
)
catalog.add("structure_hash")(lambda s, d: edges(s, d).agg(F.sum(F.xxhash64("src", "dst", "weight").cast("decimal(38,0)")).alias("edge_hash"), F.count("*").alias("edges")))
catalog.add("change_log", "WITH y AS (SELECT DISTINCT o_custkey, year(o_orderdate) AS y FROM orders), p AS (SELECT o_custkey, y, lag(y) OVER (PARTITION BY o_custkey ORDER BY y) AS before, lead(y) OVER (PARTITION BY o_custkey ORDER BY y) AS after FROM y) SELECT y::INT AS y, count(*) FILTER (before IS DISTINCT FROM y - 1) AS added, count(*) FILTER (after IS DISTINCT FROM y + 1) AS leaving, count(*) AS n FROM p GROUP BY y")(
    lambda s, d: version_changes(table(s, d, "orders").select("o_custkey", F.year("o_orderdate").alias("y")).distinct(), "o_custkey", "y")
)


def version_changes(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Per version: members, those absent from the version before, those absent from the next."""
    w = Window.partitionBy(key).orderBy(version)
    p = rows.withColumns({"_b": F.lag(version).over(w), "_a": F.lead(version).over(w)})
    return p.groupBy(version).agg(F.count_if(~F.col("_b").eqNullSafe(F.col(version) - 1)).alias("added"), F.count_if(~F.col("_a").eqNullSafe(F.col(version) + 1)).alias("leaving"), F.count("*").alias("n"))


def change_feed(before: DataFrame, after: DataFrame, key: str, kind: str, title: str) -> DataFrame:
    """(entry_id, change_type, summary): a row per row inserted, updated (any column) or deleted between two states of a table."""
    rest = [c for c in before.columns if c != key]
    a, b = (x.select(F.col(key).alias("entry_id"), F.struct(*rest).alias(n)) for x, n in ((before, "old"), (after, "new")))
    j = a.join(b, "entry_id", "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))
    change = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").otherwise("update")
    verb = F.when(F.col("old").isNull(), "New ").when(F.col("new").isNull(), "Deleted ").otherwise("Updated ")
    told = F.coalesce("new", "old")
    return j.select("entry_id", change.alias("change_type"), F.concat(verb, told[kind], F.lit(": "), told[title]).alias("summary"))


catalog.add("change_feed", "WITH a AS (SELECT p_partkey, p_type, p_name, p_size FROM part WHERE p_partkey % 11 <> 3), b AS (SELECT p_partkey, p_type, p_name, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 13 <> 5) SELECT coalesce(a.p_partkey, b.p_partkey) AS entry_id, CASE WHEN a.p_partkey IS NULL THEN 'insert' WHEN b.p_partkey IS NULL THEN 'delete' ELSE 'update' END AS change_type, CASE WHEN a.p_partkey IS NULL THEN 'New ' WHEN b.p_partkey IS NULL THEN 'Deleted ' ELSE 'Updated ' END || coalesce(b.p_type, a.p_type) || ': ' || coalesce(b.p_name, a.p_name) AS summary FROM a FULL JOIN b ON a.p_partkey = b.p_partkey WHERE a.p_partkey IS NULL OR b.p_partkey IS NULL OR a.p_size <> b.p_size")(
    lambda s, d: (lambda p: change_feed(p.filter("p_partkey % 11 <> 3"), p.filter("p_partkey % 13 <> 5").withColumn("p_size", F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))), "p_partkey", "p_type", "p_name"))(table(s, d, "part").select("p_partkey", "p_type", "p_name", "p_size"))
)
catalog.add("merge_citations", r"SELECT coalesce(nullif(regexp_replace(lower(url), '[?#].*$', ''), ''), 'x') AS key, min(page_id) AS first_page, count(*) AS n FROM pages GROUP BY 1")(
    lambda s, d: table(s, d, "pages").groupBy(F.coalesce(F.nullif(F.regexp_replace(F.lower("url"), "[?#].*$", ""), F.lit("")), F.lit("x")).alias("key")).agg(F.min("page_id").alias("first_page"), F.count("*").alias("n"))
)
catalog.add("never_visited", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")(lambda s, d: table(s, d, "part").join(table(s, d, "lineitem").filter("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey"))
catalog.add("visit_frequency", "SELECT l_partkey, count(*) AS visits FROM lineitem GROUP BY 1")(lambda s, d: table(s, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("visits")))


def record_diff(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, path, before, after): fields that differ between two versions of the same records."""
    flat = lambda x, name: x.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("path"), F.col(c).cast("string").alias(name)) for c in columns])).alias("f")).select(key, "f.*")
    return flat(a, "before").join(flat(b, "after"), [key, "path"], "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))


catalog.add("record_diff", "SELECT p_partkey, 'p_size' AS path, p_size::VARCHAR AS before, (p_size + 1)::VARCHAR AS after FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, 'p_type', p_type, lower(p_type) FROM part")(
    lambda s, d: record_diff(table(s, d, "part").select("p_partkey", "p_size", "p_type", "p_brand"), table(s, d, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"), F.lower("p_type").alias("p_type"), "p_brand"), "p_partkey", ["p_size", "p_type", "p_brand"])
)
catalog.add("baseline_regressions", "WITH a AS (SELECT event_type, avg(value) AS base FROM events WHERE ts < '2024-01-16' GROUP BY 1), b AS (SELECT event_type, avg(value) AS cur FROM events WHERE ts >= '2024-01-16' GROUP BY 1) SELECT event_type, round(base, 6) AS base, round(cur, 6) AS cur, CASE WHEN cur > base * 1.5 THEN 'critical' WHEN cur > base * 1.2 THEN 'regressed' ELSE 'ok' END AS verdict FROM a JOIN b USING (event_type)")(
    lambda s, d: baseline_regressions(table(s, d, "events").filter("ts < '2024-01-16'"), table(s, d, "events").filter("ts >= '2024-01-16'"), "event_type", "value")
)


def baseline_regressions(base: DataFrame, current: DataFrame, group: str, value: str, percent: float = 20.0) -> DataFrame:
    """Lower is better: worse by more than percent is a regression, by more than 50 critical."""
    a, b = base.groupBy(group).agg(F.avg(value).alias("base")), current.groupBy(group).agg(F.avg(value).alias("cur"))
    verdict = F.when(F.col("cur") > F.col("base") * 1.5, "critical").when(F.col("cur") > F.col("base") * (1 + percent / 100), "regressed").otherwise("ok")
    return a.join(b, group).select(group, F.round("base", 6).alias("base"), F.round("cur", 6).alias("cur"), verdict.alias("verdict"))


catalog.add("iteration_regressions", "WITH i AS (SELECT user_id, ts::DATE - DATE '2024-01-01' AS it, avg((event_type <> 'error')::INT) AS q FROM events GROUP BY 1, 2), j AS (SELECT *, lag(q) OVER (PARTITION BY user_id ORDER BY it) AS before FROM i) SELECT user_id, it::INT AS it, CASE WHEN q = 0 AND before = 0 THEN 'still broken' WHEN q = 0 THEN 'broken' ELSE 'dropped' END AS issue FROM j WHERE before IS NOT NULL AND (q = 0 OR q < before - 0.5)")(
    lambda s, d: iteration_regressions(table(s, d, "events").groupBy("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("it")).agg(F.avg((F.col("event_type") != "error").cast("double")).alias("q")))
)


def iteration_regressions(rows: DataFrame) -> DataFrame:
    """(user_id, it, issue) from quality q per iteration it."""
    r = rows.withColumn("before", F.lag("q").over(Window.partitionBy("user_id").orderBy("it"))).filter("before IS NOT NULL AND (q = 0 OR q < before - 0.5)")
    return r.select("user_id", "it", F.when((F.col("q") == 0) & (F.col("before") == 0), "still broken").when(F.col("q") == 0, "broken").otherwise("dropped").alias("issue"))


# Routes by strength and domain, teams by size.


def success_by_strength(h: DataFrame, e: DataFrame) -> DataFrame:
    """(strength, hops, success_rate) of route hops (src, dst, outcome) by the strength of their edges; 'unknown' where there is no edge."""
    strengths = e.select("src", "dst", "strength")
    return h.join(strengths, ["src", "dst"], "left").groupBy(F.coalesce("strength", F.lit("unknown")).alias("strength")).agg(F.count("*").alias("hops"), F.round(F.avg((F.col("outcome") == "success").cast("double")), 6).alias("success_rate"))


def hop_edges(h: DataFrame, strong: float = 1.05, medium: float = 0.95) -> DataFrame:
    """(src, dst, strength): edges between stops, strong and medium by how many hops they carry next to the mean edge; edges of a tenth of the mean or less are left out."""
    n = h.groupBy("src", "dst").agg(F.count("*").alias("n"))
    # A broadcast of one row.
    x = n.join(F.broadcast(n.agg(F.avg("n").alias("mean")))).filter(F.col("n") > F.col("mean") / 10)
    return x.select("src", "dst", F.when(F.col("n") > strong * F.col("mean"), "strong").when(F.col("n") > medium * F.col("mean"), "medium").otherwise("weak").alias("strength"))


catalog.add("route_strength_success", f"""WITH {HOPS}, n AS (SELECT src, dst, count(*) AS n FROM hops GROUP BY 1, 2), e AS (SELECT src, dst, CASE WHEN n > 1.05 * m THEN 'strong' WHEN n > 0.95 * m THEN 'medium' ELSE 'weak' END AS strength FROM n, (SELECT avg(n) AS m FROM n) WHERE n > m / 10)
SELECT coalesce(strength, 'unknown') AS strength, count(*) AS hops, round(avg((outcome = 'success')::INT), 6) AS success_rate FROM hops LEFT JOIN e ON hops.src = e.src AND hops.dst = e.dst GROUP BY 1""")(lambda s, d: (lambda h: success_by_strength(h, hop_edges(h)))(hops(routes(s, d))))


def reliability_by_domain(h: DataFrame, e: DataFrame, default: float = 0.8) -> DataFrame:
    """(domain, edges, untried, reliability): mean success of the edges (src, dst, domain) by the hops over them that succeeded or failed; `default` for edges never tried."""
    tried = h.filter(F.col("outcome").isin("success", "failure")).groupBy("src", "dst").agg(F.avg((F.col("outcome") == "success").cast("double")).alias("p"))
    x = e.join(tried, ["src", "dst"], "left")
    return x.groupBy("domain").agg(F.count("*").alias("edges"), F.count_if(F.col("p").isNull()).alias("untried"), F.round(F.avg(F.coalesce("p", F.lit(default))), 6).alias("reliability"))


catalog.add("route_domain_reliability", f"""WITH {HOPS}, e AS (SELECT DISTINCT src, dst, src AS domain FROM hops), t AS (SELECT src, dst, avg((outcome = 'success')::INT) AS p FROM hops WHERE outcome IN ('success', 'failure') GROUP BY 1, 2)
SELECT domain, count(*) AS edges, count(*) FILTER (p IS NULL) AS untried, round(avg(coalesce(p, 0.8)), 6) AS reliability FROM e LEFT JOIN t ON e.src = t.src AND e.dst = t.dst GROUP BY 1""")(
    lambda s, d: (lambda h: reliability_by_domain(h, h.select("src", "dst", F.col("src").alias("domain")).distinct()))(hops(routes(s, d)))
)


def weak_teams(teams: DataFrame, most: int = 15, least: float = 0.5) -> DataFrame:
    """(team, size, efficiency, issue, blockers): teams with a poor outcome, or of more than `most` members whose efficiency lies below `least`."""
    issue = F.when(F.col("outcome") == "poor", "poor outcome").when((F.col("size") > most) & (F.col("efficiency") < least), "oversized")
    return teams.select("team", "size", F.round("efficiency", 6).alias("efficiency"), issue.alias("issue"), F.size("blockers").alias("blockers")).filter("issue IS NOT NULL")


def _teams(s, d) -> DataFrame:
    """A channel's day as a team: its users, the share of their purchases and clicks, the kinds of errors' users as blockers."""
    m = messages(s, d)
    good = F.avg(F.col("type").isin("purchase", "click").cast("double"))
    x = m.groupBy(F.concat_ws("/", "channel", F.to_date("ts").cast("string")).alias("team")).agg(F.count_distinct("agent_id").alias("size"), good.alias("efficiency"), F.array_sort(F.collect_set(F.when(F.col("type") == "error", F.concat(F.lit("p"), F.col("priority").cast("string"))))).alias("blockers"))
    return x.withColumn("outcome", F.when(F.col("efficiency") < 0.3, "poor").otherwise("fair"))


_TEAMS = f"{MESSAGES}, t AS (SELECT channel || '/' || ts::DATE::VARCHAR AS team, count(DISTINCT agent_id) AS size, avg((type IN ('purchase', 'click'))::INT) AS eff, coalesce(list(DISTINCT 'p' || priority::VARCHAR) FILTER (type = 'error'), []) AS blockers FROM messages GROUP BY 1)"
catalog.add("team_weak_links", f"WITH {_TEAMS} SELECT team, size, round(eff, 6) AS efficiency, CASE WHEN eff < 0.3 THEN 'poor outcome' ELSE 'oversized' END AS issue, len(blockers)::INT AS blockers FROM t WHERE eff < 0.3 OR (size > 15 AND eff < 0.5)")(lambda s, d: weak_teams(_teams(s, d)))
catalog.add("team_blocker_counts", f"WITH {_TEAMS}, b AS (SELECT unnest(blockers) AS blocker, eff FROM t) SELECT blocker, count(*) AS teams, round(avg(eff), 6) AS efficiency FROM b GROUP BY 1")(
    lambda s, d: _teams(s, d).select(F.explode("blockers").alias("blocker"), "efficiency").groupBy("blocker").agg(F.count("*").alias("teams"), F.round(F.avg("efficiency"), 6).alias("efficiency"))
)
