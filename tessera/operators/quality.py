"""Scores, classification, data-quality gates and alerts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.plans import Catalog, table
from tessera.plans.bind import ENTRIES, GRAPH, edges, entries, nodes

catalog = Catalog()

#: Patterns of a source's description by tier, and the tiers' scores.
AUTHORITY = (
    (1.0, (r"\.gov\b", r"rfc\d+", r"official\s+doc", "specification", "standard", "ieee", "w3c", "ietf", r"iso\s?\d+")),
    (0.85, ("arxiv", r"doi\.org", "pubmed", "scholar", "journal", "proceedings", "conference", "peer.review", "academic", "university", r"\.edu\b", r"semantic\s*scholar", "openalex")),
    (0.7, (r"github\.com", "stackoverflow", "microsoft", "google", "mozilla", "apple", "aws", "documentation")),
    (0.6, ("wikipedia", "wikidata", "encyclopedia", "handbook")),
    (0.5, ("reuters", "bbc", "guardian", "nytimes", "news", "report", "analysis")),
    (0.3, ("blog", r"medium\.com", r"dev\.to", "tutorial", "hackernews", r"hacker\s*news", "reddit", "forum")),
    (0.1, ("unknown", "unverified", "rumor")),
)


def authority(hints: Column, tiers=AUTHORITY, default: float = 0.4) -> Column:
    """The score of the highest tier with a pattern in the description of a source (its URL, type, publisher and so on, joined)."""
    out = F.lit(default)
    for score, patterns in reversed(tiers):
        out = F.when(F.lower(hints).rlike("|".join(patterns)), F.lit(score)).otherwise(out)
    return out


def freshness(day: Column, as_of: Column) -> Column:
    """1.0, 0.9, 0.8, 0.7, 0.6, 0.4 up to 7, 30, 90, 180, 365, 730 days, then linear decay to 0.1; 0.5 without a date."""
    age = F.datediff(as_of, day)
    out = F.greatest(F.lit(0.1), 0.4 - (age - 730) / 3650.0)
    for days, score in ((730, 0.4), (365, 0.6), (180, 0.7), (90, 0.8), (30, 0.9), (7, 1.0)):
        out = F.when(age <= days, F.lit(score)).otherwise(out)
    return F.when(day.isNull(), F.lit(0.5)).otherwise(out)


def completeness(fields: Sequence[str], key_fields: Sequence[str]) -> Column:
    """Share of filled fields plus 0.03 per filled key field (0.2 at most), 1 at most."""
    filled = lambda c: F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "", 1).otherwise(0)
    share = sum(map(filled, fields), F.lit(0)) / len(fields)
    return F.least(F.lit(1.0), share + F.least(F.lit(0.2), 0.03 * sum(map(filled, key_fields), F.lit(0))))


#: More citations than this give this score.
CITATIONS = ((100, 1.0), (50, 0.85), (20, 0.7), (5, 0.5), (0, 0.3))


def citation_score(citations: Column, references: Column, corroborations: Column, sources: Column) -> Column:
    """By citations, or by what references (0.1 each, 0.6 at most), corroborations (0.2, 0.8) or two sources and more (0.15, 0.7) give if that is more; 0.2 without any."""
    base = F.lit(0.0)
    for least, score in reversed(CITATIONS):
        base = F.when(citations > least, F.lit(score)).otherwise(base)
    best = F.greatest(base, F.least(F.lit(0.6), references * 0.1), F.least(F.lit(0.8), corroborations * 0.2), F.when(sources > 1, F.least(F.lit(0.7), sources * 0.15)).otherwise(0.0))
    return F.when(best > 0, best).otherwise(0.2)


def weighted(parts: dict[str, float]) -> Column:
    return sum((F.col(c) * w for c, w in parts.items()), F.lit(0.0))


_AUTH = "CASE " + " ".join(f"WHEN regexp_matches(lower(url || ' ' || html), '{'|'.join(ps)}') THEN {score}" for score, ps in AUTHORITY) + " ELSE 0.4 END"
_hints = lambda: F.concat_ws(" ", "url", "html")
catalog.add("score_authority", f"SELECT page_id, ({_AUTH})::DOUBLE AS score FROM pages")(lambda s, d: table(s, d, "pages").select("page_id", authority(_hints()).alias("score")))
_FRESH = "CASE WHEN created IS NULL THEN 0.5 WHEN age <= 7 THEN 1.0 WHEN age <= 30 THEN 0.9 WHEN age <= 90 THEN 0.8 WHEN age <= 180 THEN 0.7 WHEN age <= 365 THEN 0.6 WHEN age <= 730 THEN 0.4 ELSE greatest(0.1, 0.4 - (age - 730) / 3650.0) END"
catalog.add("score_freshness", f"WITH {ENTRIES}, a AS (SELECT id, created, (SELECT max(created) FROM entries) - created AS age FROM entries) SELECT id, ({_FRESH})::DOUBLE AS score FROM a")(
    lambda s, d: entries(s, d).join(F.broadcast(entries(s, d).agg(F.max("created").alias("as_of")))).select("id", freshness(F.col("created"), F.col("as_of")).alias("score"))
)
catalog.add("score_completeness", f"WITH {ENTRIES}, f AS (SELECT id, (CASE WHEN trim(title) <> '' THEN 1 ELSE 0 END) AS a, (CASE WHEN trim(summary) <> '' THEN 1 ELSE 0 END) AS b, CASE WHEN category <> '' THEN 1 ELSE 0 END AS c FROM entries) SELECT id, round(least(1.0, (a + b + c) / 3 + least(0.2, 0.03 * (a + c))), 6)::DOUBLE AS score FROM f")(
    lambda s, d: entries(s, d).select("id", F.round(completeness(["title", "summary", "category"], ["title", "category"]), 6).alias("score"))
)
catalog.add("score_citations", """WITH x AS (SELECT p_partkey, count(l_orderkey) AS n, count(DISTINCT l_returnflag) AS refs, count(DISTINCT l_linenumber) // 3 AS corr, count(DISTINCT l_suppkey) AS sources FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1),
y AS (SELECT p_partkey, greatest(CASE WHEN n > 100 THEN 1.0 WHEN n > 50 THEN 0.85 WHEN n > 20 THEN 0.7 WHEN n > 5 THEN 0.5 WHEN n > 0 THEN 0.3 ELSE 0 END, least(0.6, refs * 0.1), least(0.8, corr * 0.2), CASE WHEN sources > 1 THEN least(0.7, sources * 0.15) ELSE 0 END) AS s FROM x)
SELECT p_partkey, round(CASE WHEN s > 0 THEN s ELSE 0.2 END, 6)::DOUBLE AS score FROM y""")(
    lambda s, d: table(s, d, "part").join(table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"), F.count_distinct("l_returnflag").alias("refs"), F.floor(F.count_distinct("l_linenumber") / 3).alias("corr"), F.count_distinct("l_suppkey").alias("sources")), "p_partkey", "left").na.fill(0, ["n", "refs", "corr", "sources"])
    .select("p_partkey", F.round(citation_score(F.col("n"), F.col("refs"), F.col("corr"), F.col("sources")), 6).alias("score"))
)
catalog.add("score_weighted_total", f"WITH a AS (SELECT page_id, ({_AUTH})::DOUBLE AS a, least(length(html) / 10000.0, 1.0)::DOUBLE AS b FROM pages) SELECT page_id, round(0.3 * a + 0.7 * b, 6) AS score FROM a")(
    lambda s, d: table(s, d, "pages").select("page_id", authority(_hints()).alias("a"), F.least(F.length("html") / 10000.0, F.lit(1.0)).alias("b")).select("page_id", F.round(weighted({"a": 0.3, "b": 0.7}), 6).alias("score"))
)


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def banded(value: Column, bands: Sequence[tuple[float, float]], default: float) -> Column:
    """The score of the first band (least value, score) that value reaches."""
    out = F.lit(default)
    for least, score in reversed(bands):
        out = F.when(value >= least, F.lit(score)).otherwise(out)
    return out


def research_grades(reports: DataFrame) -> DataFrame:
    """(report, score, grade) from mean references, distinct techniques, mean words and digits per hundred words of each report."""
    c = banded(F.col("refs"), ((5, 100), (3, 85), (2, 75), (1, 65)), 40)
    v = banded(F.col("techniques"), ((20, 100), (12, 85), (6, 75), (3, 65)), 40)
    d = banded(F.col("words"), ((300, 100), (150, 85), (75, 75), (30, 65)), 40)
    sp = banded(F.col("specific"), ((70, 100), (50, 85), (30, 75), (15, 65)), 40)
    score = c * 0.3 + v * 0.25 + d * 0.25 + sp * 0.2
    return reports.select("report", F.round(score, 4).alias("score"), grade(score).alias("grade"))


_bands = lambda v, bands: "CASE " + " ".join(f"WHEN {v} >= {a} THEN {b}" for a, b in bands) + " ELSE 40 END"
_GRADE = f"0.3 * {_bands('refs', ((5, 100), (3, 85), (2, 75), (1, 65)))} + 0.25 * {_bands('techniques', ((20, 100), (12, 85), (6, 75), (3, 65)))} + 0.25 * {_bands('words', ((300, 100), (150, 85), (75, 75), (30, 65)))} + 0.2 * {_bands('specific', ((70, 100), (50, 85), (30, 75), (15, 65)))}"
catalog.add("research_grades", f"WITH r AS (SELECT source AS report, avg(len(string_split(text, chr(10)))) AS refs, count(DISTINCT left(text, 20)) AS techniques, avg(len(string_split(text, ' '))) AS words, avg(length(text) - length(regexp_replace(text, '[0-9]', '', 'g'))) AS specific FROM documents GROUP BY 1), s AS (SELECT report, {_GRADE} AS score FROM r) SELECT report, round(score, 4)::DOUBLE AS score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM s")(
    lambda s, d: research_grades(table(s, d, "documents").groupBy(F.col("source").alias("report")).agg(F.avg(F.size(F.split("text", "\n"))).alias("refs"), F.count_distinct(F.left("text", F.lit(20))).alias("techniques"), F.avg(F.size(F.split("text", " "))).alias("words"), F.avg(F.length("text") - F.length(F.regexp_replace("text", "[0-9]", ""))).alias("specific")))
)
catalog.add("result_set_quality", "SELECT source, round(least(count(*) / 50.0, 1) * 30 + least(count(DISTINCT lang) / 4.0, 1) * 30 + least(avg(n_chars) / 2500.0, 1) * 40, 4)::DOUBLE AS quality FROM documents GROUP BY source")(
    lambda s, d: table(s, d, "documents").groupBy("source").agg(F.round(F.least(F.count("*") / 50.0, F.lit(1)) * 30 + F.least(F.count_distinct("lang") / 4.0, F.lit(1)) * 30 + F.least(F.avg("n_chars") / 2500.0, F.lit(1)) * 40, 4).alias("quality"))
)
catalog.add("article_usefulness", "WITH p AS (SELECT page_id, length(html) AS n, len(regexp_extract_all(html, 'href=')) AS links FROM pages), s AS (SELECT page_id, CASE WHEN n > 6000 THEN 4 WHEN n > 3000 THEN 3 WHEN n > 1000 THEN 2 ELSE 1 END + least(links, 4) AS score FROM p) SELECT page_id, score::INT AS score, CASE WHEN score >= 7 THEN 'A' WHEN score >= 5 THEN 'B' WHEN score >= 3 THEN 'C' ELSE 'D' END AS tier FROM s")(
    lambda s, d: table(s, d, "pages").select("page_id", (F.when(F.length("html") > 6000, 4).when(F.length("html") > 3000, 3).when(F.length("html") > 1000, 2).otherwise(1) + F.least(F.regexp_count("html", F.lit("href=")), F.lit(4))).cast("int").alias("score")).select("page_id", "score", F.when(F.col("score") >= 7, "A").when(F.col("score") >= 5, "B").when(F.col("score") >= 3, "C").otherwise("D").alias("tier"))
)

# Gates: named checks, each an aggregate between 0 and 1.

VALIDATORS: dict[str, Callable[..., Column]] = {}


def validator(name: str) -> Callable:
    """Register a check under a name; it takes its parameters and returns an aggregate Column."""

    def register(check: Callable[..., Column]) -> Callable[..., Column]:
        VALIDATORS[name] = check
        return check

    return register


@validator("required_fields")
def required_fields(fields: Sequence[str]) -> Column:
    return F.avg(sum((F.when(F.col(f).isNotNull() & (F.col(f).cast("string") != ""), 1).otherwise(0) for f in fields), F.lit(0)) / len(fields))


@validator("min_count")
def min_count(least: int) -> Column:
    return F.least(F.count("*") / least, F.lit(1.0))


@validator("unique")
def unique(field: str) -> Column:
    return F.count_distinct(field) / F.greatest(F.count("*"), F.lit(1))


@validator("type_match")
def type_match(field: str, kind: str) -> Column:
    return F.avg(F.when(F.col(field).cast("string").try_cast(kind).isNotNull(), 1.0).otherwise(0.0))


def quality_gate(rows: DataFrame, group: str, checks: Sequence[tuple[str, dict, float]], threshold: float) -> DataFrame:
    """(group, score, passed): weighted mean of the named checks, each clamped to [0, 1]."""
    total = sum(w for _, _, w in checks)
    parts = [(F.greatest(F.lit(0.0), F.least(F.lit(1.0), VALIDATORS[n](**p))) * w) for n, p, w in checks]
    out = rows.groupBy(group).agg((sum(parts, F.lit(0.0)) / total).alias("s"))
    return out.select(group, F.round("s", 6).alias("score"), (F.col("s") >= threshold).alias("passed"))


catalog.add("quality_gate", "SELECT o_orderstatus, round((avg((o_totalprice IS NOT NULL)::INT) * 2 + least(count(*) / 6000.0, 1) + count(DISTINCT o_custkey) / count(*) + avg((TRY_CAST(left(o_orderpriority, 1) AS INT) IS NOT NULL)::INT)) / 5, 6)::DOUBLE AS score, (avg((o_totalprice IS NOT NULL)::INT) * 2 + least(count(*) / 6000.0, 1) + count(DISTINCT o_custkey) / count(*) + avg((TRY_CAST(left(o_orderpriority, 1) AS INT) IS NOT NULL)::INT)) / 5 >= 0.8 AS passed FROM orders GROUP BY 1")(
    lambda s, d: quality_gate(table(s, d, "orders").withColumn("p", F.left("o_orderpriority", F.lit(1))), "o_orderstatus", [("required_fields", {"fields": ["o_totalprice"]}, 2.0), ("min_count", {"least": 6000}, 1.0), ("unique", {"field": "o_custkey"}, 1.0), ("type_match", {"field": "p", "kind": "int"}, 1.0)], 0.8)
)


def schema_issues(rows: DataFrame, key: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """(key, issue): a row per rule (name, condition of a fault) that a row breaks."""
    return rows.select(key, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))).alias("issue"))


catalog.add("schema_issues", "SELECT c_custkey, unnest(list_filter([CASE WHEN c_acctbal < 0 THEN 'negative balance' END, CASE WHEN NOT regexp_full_match(c_name, 'Customer#[0-9]{9}') THEN 'name pattern' END, CASE WHEN c_mktsegment NOT IN ('HOUSEHOLD', 'MACHINERY', 'FURNITURE', 'BUILDING') THEN 'segment' END], lambda x: x IS NOT NULL)) AS issue FROM customer")(
    lambda s, d: schema_issues(table(s, d, "customer"), "c_custkey", [("negative balance", F.col("c_acctbal") < 0), ("name pattern", ~F.col("c_name").rlike("^Customer#[0-9]{9}$")), ("segment", ~F.col("c_mktsegment").isin("HOUSEHOLD", "MACHINERY", "FURNITURE", "BUILDING"))])
)


def repaired(rows: DataFrame, key: str) -> DataFrame:
    """Entries with a version filled in, titles cut at 40 characters, one row per key (the first), and what was done."""
    first = rows.groupBy(key).agg(F.min_by(F.struct("title", "version"), F.col("ordinal")).alias("r"), F.count("*").alias("n"))
    actions = F.array_compact(F.array(F.when(F.col("r.version").isNull(), "version"), F.when(F.length("r.title") > 40, "title"), F.when(F.col("n") > 1, "duplicates")))
    return first.select(key, F.left("r.title", F.lit(40)).alias("title"), F.coalesce("r.version", F.lit("1.0")).alias("version"), F.array_join(actions, ",").alias("actions"))


catalog.add("repair_entries", "WITH r AS (SELECT doc_id // 2 AS k, string_split(text, chr(10))[1] AS title, CASE WHEN doc_id % 3 = 0 THEN '2.0' END AS version, doc_id AS ordinal FROM documents), f AS (SELECT k, first(title ORDER BY ordinal) AS title, first(version ORDER BY ordinal) AS version, count(*) AS n FROM r GROUP BY k) SELECT k, left(title, 40) AS title, coalesce(version, '1.0') AS version, concat_ws(',', CASE WHEN version IS NULL THEN 'version' END, CASE WHEN length(title) > 40 THEN 'title' END, CASE WHEN n > 1 THEN 'duplicates' END) AS actions FROM f")(
    lambda s, d: repaired(table(s, d, "documents").select(F.floor(F.col("doc_id") / 2).alias("k"), F.substring_index("text", "\n", 1).alias("title"), F.when(F.col("doc_id") % 3 == 0, "2.0").alias("version"), F.col("doc_id").alias("ordinal")), "k")
)


def best_category(words: Column, categories: dict[str, Sequence[str]]) -> Column:
    """The category with the most of its keywords among words, the first by name of equals; 'uncategorised' without any."""
    scored = F.array(*[F.struct(F.size(F.array_intersect(words, F.array(*map(F.lit, ks)))).alias("n"), F.lit(-i).alias("o"), F.lit(c).alias("c")) for i, (c, ks) in enumerate(sorted(categories.items()))])
    best = F.array_max(scored)
    return F.when(best["n"] > 0, best["c"]).otherwise("uncategorised")


_CATS = {"metal": ["bolt", "anvil", "gear"], "colour": ["red", "blue", "green"], "size": ["small", "large"]}
_cat = lambda k: f"len(list_intersect(string_split(p_name, ' '), {_CATS[k]}))"
catalog.add("category_assignment", f"SELECT p_partkey, CASE WHEN greatest({_cat('colour')}, {_cat('metal')}, {_cat('size')}) = 0 THEN 'uncategorised' WHEN {_cat('colour')} >= {_cat('metal')} AND {_cat('colour')} >= {_cat('size')} THEN 'colour' WHEN {_cat('metal')} >= {_cat('size')} THEN 'metal' ELSE 'size' END AS category FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", best_category(F.split("p_name", " "), _CATS).alias("category"))
)


def edge_strength(weight: Column, reasons: Column, same_domain: Column) -> Column:
    """strong from 7, medium from 4, else weak; a tier up with two reasons or more across domains."""
    tier = F.when(weight >= 7, 2).when(weight >= 4, 1).otherwise(0) + F.when((F.size(reasons) >= 2) & ~same_domain, 1).otherwise(0)
    return F.element_at(F.array(F.lit("weak"), F.lit("medium"), F.lit("strong"), F.lit("strong")), (tier + 1).cast("int"))


_ENDS = "JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id"


def with_domains(e: DataFrame, n: DataFrame) -> DataFrame:
    """Edges with the domains and tags of both ends."""
    ends = n.select("id", "domain", "tags")
    return e.join(ends.select(F.col("id").alias("src"), F.col("domain").alias("src_domain"), F.col("tags").alias("src_tags")), "src").join(ends.select(F.col("id").alias("dst"), F.col("domain").alias("dst_domain"), F.col("tags").alias("dst_tags")), "dst")


catalog.add("edge_classification", f"WITH {GRAPH} SELECT ['weak', 'medium', 'strong', 'strong'][CASE WHEN weight >= 7 THEN 2 WHEN weight >= 4 THEN 1 ELSE 0 END + CASE WHEN len(reasons) >= 2 AND a.domain <> b.domain THEN 1 ELSE 0 END + 1] AS class, strength, count(*) AS n FROM edges {_ENDS} GROUP BY 1, 2")(
    lambda s, d: with_domains(edges(s, d), nodes(s, d)).groupBy(edge_strength(F.col("weight"), F.col("reasons"), F.col("src_domain") == F.col("dst_domain")).alias("class"), "strength").agg(F.count("*").alias("n"))
)
catalog.add("strength_audit", f"WITH {GRAPH} SELECT strength, CASE WHEN weight >= 7 THEN 'strong' WHEN weight >= 4 THEN 'medium' WHEN weight >= 2 THEN 'weak' ELSE 'none' END AS expected, count(*) AS n FROM edges GROUP BY 1, 2")(
    lambda s, d: edges(s, d).groupBy("strength", F.when(F.col("weight") >= 7, "strong").when(F.col("weight") >= 4, "medium").when(F.col("weight") >= 2, "weak").otherwise("none").alias("expected")).agg(F.count("*").alias("n"))
)


def alerts(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """(name, value, level): PASS, WARN or FAIL by each metric's thresholds (higher is worse), SKIP without a value."""
    level = F.when(F.col("value").isNull(), "SKIP").when(F.col("value") >= F.col("fail"), "FAIL").when(F.col("value") >= F.col("warn"), "WARN").otherwise("PASS")
    return rules.join(metrics, "name", "left").select("name", F.round("value", 6).alias("value"), level.alias("level"))


catalog.add("threshold_alerts", "WITH m AS (SELECT event_type AS name, avg(value) AS value FROM events GROUP BY 1), r AS (SELECT event_type AS name, approx AS warn, approx + 0.5 AS fail FROM (SELECT event_type, (length(event_type) * 1.0 + 1) AS approx FROM events GROUP BY 1)) SELECT r.name, round(value, 6) AS value, CASE WHEN value IS NULL THEN 'SKIP' WHEN value >= fail THEN 'FAIL' WHEN value >= warn THEN 'WARN' ELSE 'PASS' END AS level FROM r LEFT JOIN m ON r.name = m.name")(
    lambda s, d: alerts(table(s, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.avg("value").alias("value")), table(s, d, "events").select(F.col("event_type").alias("name")).distinct().select("name", (F.length("name") + 1.0).alias("warn"), (F.length("name") + 1.5).alias("fail")))
)
catalog.add("penalty_health", "SELECT source, greatest(0, 100 - sum(CASE WHEN contains(lower(text), 'token') THEN 10 WHEN contains(text, '###') THEN 5 WHEN contains(text, '!!') THEN 2 ELSE 0 END))::BIGINT AS health FROM documents GROUP BY source")(
    lambda s, d: table(s, d, "documents").groupBy("source").agg(F.greatest(F.lit(0), 100 - F.sum(F.when(F.lower("text").contains("token"), 10).when(F.col("text").contains("###"), 5).when(F.col("text").contains("!!"), 2).otherwise(0))).alias("health"))
)
catalog.add("pick_validation", "WITH p AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'short' ELSE 'long' END AS direction, l_extendedprice AS entry, l_extendedprice * (1 + l_discount - l_tax) AS target FROM lineitem) SELECT direction, count(*) FILTER (entry <= 0 OR target <= 0) AS bad_price, count(*) FILTER ((direction = 'long' AND target <= entry) OR (direction = 'short' AND target >= entry)) AS bad_order FROM p GROUP BY direction")(
    lambda s, d: table(s, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", "short").otherwise("long").alias("direction"), F.col("l_extendedprice").alias("entry"), (F.col("l_extendedprice") * (1 + F.col("l_discount") - F.col("l_tax"))).alias("target"))
    .groupBy("direction").agg(F.count_if((F.col("entry") <= 0) | (F.col("target") <= 0)).alias("bad_price"), F.count_if(((F.col("direction") == "long") & (F.col("target") <= F.col("entry"))) | ((F.col("direction") == "short") & (F.col("target") >= F.col("entry")))).alias("bad_order"))
)
# The billionth keeps means that lie on a rounding edge off it, whatever the order of the sum.
_JAC = "CASE WHEN len(list_distinct(list_concat(a.tags, b.tags))) = 0 THEN 0 ELSE len(list_intersect(a.tags, b.tags)) / len(list_distinct(list_concat(a.tags, b.tags))) END"
catalog.add("path_quality", f"WITH {GRAPH} SELECT src, round(avg({_JAC}) + 1e-9, 6) AS coherence, sum(weight)::BIGINT AS total_weight, count(*) FILTER (a.domain = b.domain) AS revisits FROM edges {_ENDS} GROUP BY src")(
    lambda s, d: with_domains(edges(s, d), nodes(s, d)).groupBy("src").agg(F.round(F.avg(t.jaccard(F.col("src_tags"), F.col("dst_tags"))) + 1e-9, 6).alias("coherence"), F.sum("weight").alias("total_weight"), F.count_if(F.col("src_domain") == F.col("dst_domain")).alias("revisits"))
)


# Verdicts, stale entries, classes of edges by their reasons.


def health_verdict(scores: DataFrame, weights: dict[str, float], group: str) -> DataFrame:
    """(group, overall, health, passed, warned, failed): FAIL or WARN if a metric has that level, and the mean of the values (0 to 1) by weight of the metrics that have one.

    scores: group, name, value, level (PASS, WARN, FAIL or SKIP).
    """
    weight = F.create_map(*[x for n, w in weights.items() for x in (F.lit(n), F.lit(w))])[F.col("name")]
    x = scores.withColumn("w", F.when((F.col("level") != "SKIP") & F.col("value").isNotNull(), F.coalesce(weight, F.lit(0.0))))
    n = lambda level: F.count_if(F.col("level") == level)
    return x.groupBy(group).agg(
        F.when(n("FAIL") > 0, "FAIL").when(n("WARN") > 0, "WARN").otherwise("PASS").alias("overall"), F.round(F.coalesce(F.sum(F.col("w") * F.col("value")) / F.nullif(F.sum("w"), F.lit(0.0)), F.lit(0.0)) + 1e-9, 3).alias("health"),
        n("PASS").alias("passed"), n("WARN").alias("warned"), n("FAIL").alias("failed"),
    )


#: Weights of the metrics of a network's health.
HEALTH_WEIGHTS = {"connectivity": 0.25, "strength_coverage": 0.20, "route_success": 0.20, "path_efficiency": 0.15, "tag_coherence": 0.10, "orphan_rate": 0.10}


def domain_metrics(e: DataFrame, n: DataFrame) -> DataFrame:
    """(domain, name, value, level) of the edges that leave each domain: shares of nodes with edges, of strong edges, of two reasons, of other domains reached, tag coherence, and of nodes that nothing reaches."""
    x = with_domains(e, n)
    out = x.groupBy(F.col("src_domain").alias("domain")).agg(
        F.count_distinct("src").alias("sources"), F.avg((F.col("strength") == "strong").cast("double")).alias("strength_coverage"), F.avg((F.size("reasons") >= 2).cast("double")).alias("route_success"),
        F.avg((F.col("src_domain") != F.col("dst_domain")).cast("double")).alias("path_efficiency"), F.least(F.avg(t.jaccard(F.col("src_tags"), F.col("dst_tags"))) / 0.5, F.lit(1.0)).alias("tag_coherence"),
    )
    reached = n.join(e.select(F.col("dst").alias("id")).distinct().withColumn("hit", F.lit(1)), "id", "left").groupBy("domain").agg(F.count("*").alias("nodes"), F.count("hit").alias("hits"))
    j = reached.join(out, "domain", "left").withColumns({"connectivity": F.coalesce("sources", F.lit(0)) / F.col("nodes"), "orphan_rate": F.col("hits") / F.col("nodes")})
    long = j.select("domain", F.explode(F.array(*[F.struct(F.lit(m).alias("name"), F.col(m).cast("double").alias("value")) for m in HEALTH_WEIGHTS])).alias("m")).select("domain", "m.name", "m.value")
    v = F.round("value", 9)
    return long.withColumn("level", F.when(v.isNull(), "SKIP").when(v < 0.2, "FAIL").when(v < 0.5, "WARN").otherwise("PASS"))


catalog.add("health_verdict", f"""WITH {GRAPH}, x AS (SELECT a.domain AS domain, src, strength, reasons, b.domain AS other, {{jac}} AS j FROM edges {_ENDS}),
o AS (SELECT domain, count(DISTINCT src) AS sources, avg((strength = 'strong')::INT) AS sc, avg((len(reasons) >= 2)::INT) AS rs, avg((domain <> other)::INT) AS pe, least(avg(j) / 0.5, 1.0) AS tc FROM x GROUP BY 1),
r AS (SELECT domain, count(*) AS nodes, count(*) FILTER (id IN (SELECT dst FROM edges)) AS hits FROM nodes GROUP BY 1),
l AS (SELECT r.domain, unnest([coalesce(sources, 0) / nodes, sc, rs, pe, tc, hits / nodes]) AS v, unnest([0.25, 0.2, 0.2, 0.15, 0.1, 0.1]) AS w FROM r LEFT JOIN o ON r.domain = o.domain),
g AS (SELECT *, CASE WHEN v IS NULL THEN 'SKIP' WHEN round(v, 9) < 0.2 THEN 'FAIL' WHEN round(v, 9) < 0.5 THEN 'WARN' ELSE 'PASS' END AS level FROM l)
SELECT domain, CASE WHEN count(*) FILTER (level = 'FAIL') > 0 THEN 'FAIL' WHEN count(*) FILTER (level = 'WARN') > 0 THEN 'WARN' ELSE 'PASS' END AS overall, round(coalesce(sum(w::DOUBLE * v) / sum(w::DOUBLE) FILTER (v IS NOT NULL), 0) + 1e-9, 3) AS health,
 count(*) FILTER (level = 'PASS') AS passed, count(*) FILTER (level = 'WARN') AS warned, count(*) FILTER (level = 'FAIL') AS failed FROM g GROUP BY domain""".replace("{jac}", _JAC))(
    lambda s, d: health_verdict(domain_metrics(edges(s, d), nodes(s, d)), HEALTH_WEIGHTS, "domain")
)


def reasoned_class(weight: Column, reasons: Column, pair: Column, upgrades: Sequence[str], bridge: str) -> Column:
    """Class of an edge by weight, reason types and domain pair ('A|B', sorted): primary, supporting, related or tangential.

    Primary from weight 7, supporting from 5, related from 2; at 4 an explicit reference, or category and tags together, support; at 1 a tag
    bridge, an explicit reference or the pair `bridge` relate. An explicit reference lifts what is not related or primary by one
    class in the pairs `upgrades`.
    """
    has = lambda r: F.array_contains(reasons, r)
    both = has("category_affinity") & has("shared_tags")
    tier = F.when(weight >= 7, 3).when(weight >= 5, 2).when(weight == 4, F.when(both | has("explicit_reference"), 2).otherwise(1)).when(weight >= 2, 1)
    tier = tier.when((weight == 1) & (has("tag_bridge") | has("explicit_reference") | (pair == bridge)), 1).otherwise(0)
    tier = tier + F.when(pair.isin(*upgrades) & has("explicit_reference") & tier.isin(0, 2), 1).otherwise(0)
    return F.element_at(F.array(*map(F.lit, ("tangential", "related", "supporting", "primary"))), (tier + 1).cast("int"))


#: How the tables' line flags stand for reason types.
_TYPES = (("flag A", "explicit_reference"), ("flag N", "shared_tags"), ("flag R", "category_affinity"))
_UPGRADES, _BRIDGE = ("Brand#1|Brand#2", "Brand#3|Brand#4"), "Brand#5|Brand#6"


def _reasoned(s, d) -> DataFrame:
    types = F.array_compact(F.array(*[F.when(F.array_contains("reasons", a), b) for a, b in _TYPES]))
    pair = F.array_join(F.array_sort(F.array("src_domain", "dst_domain")), "|")
    return with_domains(edges(s, d), nodes(s, d)).withColumn("class", reasoned_class(F.col("weight"), types, pair, _UPGRADES, _BRIDGE)).groupBy(pair.alias("pair"), "class").agg(F.count("*").alias("n"))


catalog.add("edge_reason_classes", f"""WITH {GRAPH}, x AS (SELECT weight, list_contains(reasons, 'flag A') AS e, list_contains(reasons, 'flag N') AS s, list_contains(reasons, 'flag R') AS c, least(a.domain, b.domain) || '|' || greatest(a.domain, b.domain) AS pair FROM edges {_ENDS}),
y AS (SELECT *, CASE WHEN weight >= 7 THEN 3 WHEN weight >= 5 THEN 2 WHEN weight = 4 THEN CASE WHEN e OR (s AND c) THEN 2 ELSE 1 END WHEN weight >= 2 THEN 1 WHEN weight = 1 AND (e OR pair = '{_BRIDGE}') THEN 1 ELSE 0 END AS tier FROM x)
SELECT pair, ['tangential', 'related', 'supporting', 'primary'][tier + CASE WHEN e AND pair IN {_UPGRADES} AND tier IN (0, 2) THEN 1 ELSE 0 END + 1] AS class, count(*) AS n FROM y GROUP BY 1, 2""")(_reasoned)


def stale_entries(e: DataFrame, as_of: Column, days: int, faults: str, fixes: str) -> DataFrame:
    """(id, issue): entries left in draft for more than `days` days, and those whose text speaks of a fault and of no fix."""
    text = F.lower(F.coalesce("body", F.lit("")))
    issues = [F.when((F.col("status") == "draft") & (F.datediff(as_of, F.col("created")) > days), "stale draft"), F.when(text.rlike(faults) & ~text.rlike(fixes), "open fault")]
    return e.select("id", F.explode(F.array_compact(F.array(*issues))).alias("issue"))


_FAULTS, _FIXES = r"\b(bug|broken|error|fail)", r"\b(fix|solved|resolved|worked)"
catalog.add("stale_entries", f"WITH {ENTRIES}, x AS (SELECT id, status = 'draft' AND DATE '2024-12-31' - created > 180 AS s, regexp_matches(lower(coalesce(body, '')), '{_FAULTS}') AND NOT regexp_matches(lower(coalesce(body, '')), '{_FIXES}') AS f FROM entries) SELECT id, 'stale draft' AS issue FROM x WHERE s UNION ALL SELECT id, 'open fault' FROM x WHERE f")(
    lambda s, d: stale_entries(entries(s, d), F.lit("2024-12-31").cast("date"), 180, _FAULTS, _FIXES)
)
catalog.add("pick_issues", "WITH p AS (SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN l_returnflag = 'R' THEN 'short' ELSE 'long' END AS direction, l_extendedprice AS entry, l_extendedprice * (1 + l_discount - l_tax) AS target FROM lineitem) SELECT l_orderkey, l_linenumber, unnest(list_filter([CASE WHEN l_returnflag NOT IN ('A', 'R') THEN 'method' END, CASE WHEN entry <= 0 OR target <= 0 THEN 'price' END, CASE WHEN (direction = 'long' AND target <= entry) OR (direction = 'short' AND target >= entry) THEN 'order' END], lambda x: x IS NOT NULL)) AS issue FROM p")(
    lambda s, d: pick_issues(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("method"), F.when(F.col("l_returnflag") == "R", "short").otherwise("long").alias("direction"), F.col("l_extendedprice").alias("entry"), (F.col("l_extendedprice") * (1 + F.col("l_discount") - F.col("l_tax"))).alias("target")), ["l_orderkey", "l_linenumber"], ["A", "R"])
)


def pick_issues(picks: DataFrame, key: Sequence[str], methods: Sequence[str]) -> DataFrame:
    """A row per fault of a pick: a method that isn't known, a price that isn't positive, a target on the wrong side of the entry."""
    wrong = ((F.col("direction") == "long") & (F.col("target") <= F.col("entry"))) | ((F.col("direction") == "short") & (F.col("target") >= F.col("entry")))
    issues = [F.when(~F.col("method").isin(*methods), "method"), F.when((F.col("entry") <= 0) | (F.col("target") <= 0), "price"), F.when(wrong, "order")]
    return picks.select(*key, F.explode(F.array_compact(F.array(*issues))).alias("issue"))


def name_hints(rows: DataFrame, key: str, name: str, known: Sequence[str], most: int = 3) -> DataFrame:
    """(key, name, hint): names that aren't known, with the nearest known one within `most` edits, the first by name of equals."""
    near = F.array_min(F.array(*[F.struct(F.levenshtein(F.col(name), F.lit(k)).alias("d"), F.lit(k).alias("k")) for k in sorted(known)]))
    x = rows.filter(F.col(name).isNotNull() & ~F.col(name).isin(*known)).withColumn("_n", near)
    return x.select(key, name, F.when(F.col("_n.d") <= most, F.col("_n.k")).alias("hint"))


catalog.add("name_hints", "WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN substr(p_type, 2) WHEN p_partkey % 7 = 0 THEN p_type || 'x' ELSE p_type END AS name FROM part), k AS (SELECT unnest(['ECONOMY', 'PROMO', 'STANDARD', 'LARGE', 'SMALL', 'MEDIUM']) AS k), h AS (SELECT p_partkey, name, min((levenshtein(name, k), k)) AS b FROM x, k WHERE name NOT IN (SELECT k FROM k) GROUP BY 1, 2) SELECT p_partkey, name, CASE WHEN b[1] <= 3 THEN b[2] END AS hint FROM h")(
    lambda s, d: name_hints(table(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.expr("substr(p_type, 2)")).when(F.col("p_partkey") % 7 == 0, F.concat("p_type", F.lit("x"))).otherwise(F.col("p_type")).alias("name")), "p_partkey", "name", ["ECONOMY", "PROMO", "STANDARD", "LARGE", "SMALL", "MEDIUM"])
)


def result_richness() -> Column:
    """0 to 100 from results (1 each, 30 at most), sources (2, 20), rich texts (2, 20), corroborated ones (3, 10), citations (1 per hundred, 5) and active methods (3, 15)."""
    cap = lambda c, per, most: F.least(F.col(c) * per, F.lit(most))
    return F.least(cap("results", 1, 30) + cap("sources", 2, 20) + cap("rich", 2, 20) + cap("corroborated", 3, 10) + F.least(F.floor(F.col("citations") / 100), F.lit(5)) + cap("methods", 3, 15), F.lit(100))


catalog.add("result_richness", "WITH d AS (SELECT doc_id, source, lang, text, n_chars, count(*) OVER (PARTITION BY sha256(text)) > 1 AS c FROM documents), g AS (SELECT lang, count(*) AS r, count(DISTINCT source) AS s, count(*) FILTER (length(text) > 50) AS t, count(*) FILTER (c) AS c, sum(n_chars) AS n FROM d GROUP BY lang) SELECT lang, least(least(r, 30) + least(s * 2, 20) + least(t * 2, 20) + least(c * 3, 10) + least(n // 100, 5) + least(s * 3, 15), 100)::BIGINT AS score FROM g")(
    lambda s, d: (lambda x: x.groupBy("lang").agg(F.count("*").alias("results"), F.count_distinct("source").alias("sources"), F.count_distinct("source").alias("methods"), F.count_if(F.length("text") > 50).alias("rich"), F.count_if("repeated").alias("corroborated"), F.sum("n_chars").alias("citations")).select("lang", result_richness().cast("long").alias("score")))(
        (lambda docs: docs.join(docs.groupBy("h").agg((F.count("*") > 1).alias("repeated")), "h"))(table(s, d, "documents").select("lang", "source", "text", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("h")))
    )
)
