"""Scans, projections and filters over entries, pages and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.plans import Catalog, table
from tessera.plans.bind import BASKETS, ENTRIES, MESSAGES, baskets, entries, messages, sql_tokens

catalog = Catalog()


# Sources and sinks.


def unified_index(parts: dict[str, DataFrame]) -> DataFrame:
    """One index (id, domain, title, tags, category) of several normalised tables."""
    out = None
    for domain, df in parts.items():
        part = df.select(F.col("id").cast("string").alias("id"), F.lit(domain).alias("domain"), "title", "tags", "category")
        out = part if out is None else out.unionByName(part)
    return out


def _index_parts(spark, d) -> dict[str, DataFrame]:
    p, s = table(spark, d, "part"), table(spark, d, "supplier")
    return {
        "part": p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.split("p_name", " ").alias("tags"), F.col("p_type").alias("category")),
        "supplier": s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.array(F.concat(F.lit("nation"), F.col("s_nationkey").cast("string"))).alias("tags"), F.lit("SUPPLIER").alias("category")),
    }


_INDEX = """idx AS (SELECT p_partkey::VARCHAR AS id, 'part' AS domain, p_name AS title, string_split(p_name, ' ') AS tags, p_type AS category FROM part
 UNION ALL SELECT s_suppkey::VARCHAR, 'supplier', s_name, ['nation' || s_nationkey::VARCHAR], 'SUPPLIER' FROM supplier)"""
catalog.add("index_unified", f"WITH {_INDEX} SELECT domain, category, count(*) AS entries FROM idx GROUP BY domain, category")(
    lambda spark, d: unified_index(_index_parts(spark, d)).groupBy("domain", "category").agg(F.count("*").alias("entries"))
)
catalog.add("index_tags", f"WITH {_INDEX}, x AS (SELECT id, domain, unnest(tags) AS tag FROM idx) SELECT tag, domain, count(DISTINCT id) AS entries FROM x GROUP BY tag, domain")(
    lambda spark, d: unified_index(_index_parts(spark, d)).select("id", "domain", F.explode("tags").alias("tag")).groupBy("tag", "domain").agg(F.count_distinct("id").alias("entries"))
)

catalog.add(
    "source_normalise_records",
    """SELECT 'page' AS source_type, url, left(html, 300) AS snippet, 2 AS tier, 0.7 AS weight FROM pages
 UNION ALL SELECT 'document', 'doc:' || doc_id::VARCHAR, left(text, 300), 1, 1.0 FROM documents UNION ALL SELECT 'chat', 'conv:' || conv_id::VARCHAR || '/' || turn::VARCHAR, left(text, 300), 3, 0.4 FROM conversations""",
)(
    lambda spark, d: table(spark, d, "pages").select(F.lit("page").alias("source_type"), "url", F.left("html", F.lit(300)).alias("snippet"), F.lit(2).alias("tier"), F.lit(0.7).alias("weight"))
    .unionByName(table(spark, d, "documents").select(F.lit("document").alias("source_type"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("url"), F.left("text", F.lit(300)).alias("snippet"), F.lit(1).alias("tier"), F.lit(1.0).alias("weight")))
    .unionByName(table(spark, d, "conversations").select(F.lit("chat").alias("source_type"), F.concat(F.lit("conv:"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("url"), F.left("text", F.lit(300)).alias("snippet"), F.lit(3).alias("tier"), F.lit(0.4).alias("weight")))
)


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Insert-or-replace: the last row of each key in that order."""
    value = F.struct(*[F.col(c) for c in rows.columns])
    last = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by(value, F.struct(*order)).alias("v"))
    return last.select("v.*")


catalog.add("load_insert_or_replace", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")(
    lambda spark, d: latest_per_key(table(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).drop("ts")
)
catalog.add("load_derived_columns", "SELECT doc_id, left(text, 200) AS summary, sha256(text) AS content_hash, length(text)::BIGINT AS char_count, (length(text) // 4)::BIGINT AS token_estimate, len(string_split(text, chr(10)))::INT AS lines FROM documents")(
    lambda spark, d: table(spark, d, "documents").select("doc_id", F.left("text", F.lit(200)).alias("summary"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), F.length("text").cast("long").alias("char_count"), t.token_estimate(F.col("text")).alias("token_estimate"), F.size(F.split("text", "\n")).alias("lines"))
)
catalog.add("index_tier_summary", f"WITH {ENTRIES} SELECT resource_type, count(*) AS entries, list_sort(list(DISTINCT category)) AS categories, max(created) AS last_date, min(numeric_id) AS first_id, max(numeric_id) AS last_id FROM entries GROUP BY resource_type")(
    lambda spark, d: entries(spark, d).groupBy("resource_type").agg(F.count("*").alias("entries"), F.array_sort(F.collect_set("category")).alias("categories"), F.max("created").alias("last_date"), F.min("numeric_id").alias("first_id"), F.max("numeric_id").alias("last_id"))
)


def zipped_rows(rows: DataFrame, key: str, arrays: list[str], most: int | None = None) -> DataFrame:
    """Parallel arrays as rows, the first `most` of each key."""
    out = rows.select(key, F.posexplode(F.arrays_zip(*arrays)).alias("pos", "_z"))
    out = out if most is None else out.filter(F.col("pos") < most)
    return out.select(key, "pos", *[F.col(f"_z.{a}").alias(a) for a in arrays])


catalog.add(
    "source_parallel_arrays",
    """WITH a AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS parts, list(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS quantities FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)
SELECT l_orderkey, i::INT AS pos, parts[i + 1] AS parts, quantities[i + 1] AS quantities FROM a, unnest(range(0, least(len(parts), 2))) AS u(i)""",
)(
    lambda spark, d: zipped_rows(
        table(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"))).alias("r")).select("l_orderkey", F.col("r.l_partkey").alias("parts"), F.col("r.l_quantity").alias("quantities")),
        "l_orderkey", ["parts", "quantities"], 2,
    )
)


def rebuild_text(positions: DataFrame, key: str) -> DataFrame:
    """(key, text) from (key, map of word to positions)."""
    placed = F.flatten(F.transform(F.map_entries("positions"), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("pos"), e["key"].alias("word")))))
    w = positions.select(key, placed.alias("placed")).filter(F.size("placed") > 0)
    return w.groupBy(key).agg(F.array_join(F.array_sort(F.flatten(F.collect_list("placed")))["word"], " ").alias("text"))


@catalog.add("source_inverted_text", f"SELECT doc_id, array_to_string({sql_tokens('text', 1)}, ' ') AS text FROM documents WHERE len({sql_tokens('text', 1)}) > 0")
def _inverted(spark, d):
    # Texts are dealt by document once; their words then stay where they are.
    w = table(spark, d, "documents").select("doc_id", "text").repartition("doc_id").select("doc_id", F.posexplode(t.tokens(F.col("text"), 1)).alias("pos", "word"))
    maps = w.groupBy("doc_id", "word").agg(F.collect_list("pos").alias("at")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("positions"))
    return rebuild_text(maps, "doc_id")


def page_parts(pages: DataFrame) -> DataFrame:
    """page_id, title, headings, links, code blocks and clean text of HTML pages."""
    html = F.regexp_replace("html", r"(?is)<!--.*?-->", " ")
    bare = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer|aside|noscript)\b[^>]*>.*?</\1>", " ")
    strip = lambda c: F.trim(F.regexp_replace(_unescape(F.regexp_replace(c, r"(?s)<[^>]+>", " ")), r"\s+", " "))
    return pages.select(
        "page_id",
        strip(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"),
        F.transform(F.regexp_extract_all(bare, F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), 1), strip).alias("headings"),
        F.regexp_extract_all(bare, F.lit(r"""(?is)<a\b[^>]*\bhref=["']([^"']*)["']"""), 1).alias("links"),
        F.transform(F.regexp_extract_all(bare, F.lit(r"(?is)<pre[^>]*>(.*?)</pre>"), 1), strip).alias("code_blocks"),
        strip(F.regexp_extract(bare, r"(?is)<body[^>]*>(.*?)(?:</body>|\z)", 1)).alias("text"),
    )


def _unescape(c: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


catalog.add("page_parts")(lambda spark, d: page_parts(table(spark, d, "pages")))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, label): anchors of the pages."""
    found = F.regexp_extract_all("html", F.lit(r"""(?is)<a\b[^>]*\bhref=["'][^"']*["'][^>]*>.*?</a>"""), 0)
    a = pages.select("page_id", F.explode(found).alias("a"))
    return a.select("page_id", F.regexp_extract("a", r"""(?is)\bhref=["']([^"']*)["']""", 1).alias("url"), F.trim(F.regexp_replace("a", r"(?s)<[^>]+>", "")).alias("label"))


catalog.add(
    "page_links",
    r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref=["''][^"'']*["''][^>]*>.*?</a>')) AS a FROM pages)
SELECT page_id, regexp_extract(a, '(?is)\bhref=["'']([^"'']*)["'']', 1) AS url, trim(regexp_replace(a, '(?s)<[^>]+>', '', 'g')) AS label FROM a""",
)(lambda spark, d: page_links(table(spark, d, "pages")))

catalog.add("series_latest_observation", "SELECT event_type, arg_max(value, (ts, event_id)) AS latest, max(ts) AS at FROM events GROUP BY event_type")(
    lambda spark, d: table(spark, d, "events").groupBy("event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("latest"), F.max("ts").alias("at"))
)


# Projections and filters.

catalog.add("entry_list", f"WITH {ENTRIES} SELECT id, title, status FROM entries WHERE resource_type = 'src3' ORDER BY id")(lambda spark, d: entries(spark, d).filter("resource_type = 'src3'").select("id", "title", "status").orderBy("id"))


def entry_with_lists(rows: DataFrame, tags: DataFrame) -> DataFrame:
    """Entries with their tags as an array (empty if none)."""
    a = tags.groupBy("entry_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return rows.join(a, rows["id"] == a["entry_id"], "left").select(rows["*"], F.coalesce("tags", F.array().cast(a.schema["tags"].dataType)).alias("tags"))


catalog.add("entry_read", f"WITH {BASKETS}, t AS (SELECT entry_id, list_sort(list(tag)) AS tags FROM tags GROUP BY 1) SELECT o_orderkey AS id, o_orderstatus, coalesce(t.tags, []) AS tags FROM orders LEFT JOIN t ON o_orderkey = entry_id")(
    lambda spark, d: entry_with_lists(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus"), baskets(spark, d))
)
catalog.add("filter_all_tags", "SELECT p_partkey FROM part WHERE list_has_all(string_split(p_name, ' '), ['red', 'bolt'])")(lambda spark, d: table(spark, d, "part").filter(F.size(F.array_except(F.array(F.lit("red"), F.lit("bolt")), F.split("p_name", " "))) == 0).select("p_partkey"))
catalog.add("filter_any_tag", "SELECT p_partkey FROM part WHERE list_has_any(string_split(p_name, ' '), ['red', 'bolt'])")(lambda spark, d: table(spark, d, "part").filter(F.arrays_overlap(F.split("p_name", " "), F.array(F.lit("red"), F.lit("bolt")))).select("p_partkey"))
catalog.add("filter_category_dates", f"WITH {ENTRIES} SELECT id, created FROM entries WHERE lower(category) = lower('EN') AND resource_type IN ('src1', 'src2') AND created BETWEEN DATE '2024-02-01' AND DATE '2024-06-30'")(
    lambda spark, d: entries(spark, d).filter((F.lower("category") == F.lower(F.lit("EN"))) & F.col("resource_type").isin("src1", "src2") & F.col("created").between("2024-02-01", "2024-06-30")).select("id", "created")
)
catalog.add("filter_compound", f"WITH {ENTRIES} SELECT id FROM entries WHERE (resource_type = 'src0' AND status = 'active') OR (resource_type <> 'src0' AND status <> 'archived' AND char_count > 1000)")(
    lambda spark, d: entries(spark, d).filter(((F.col("resource_type") == "src0") & (F.col("status") == "active")) | ((F.col("resource_type") != "src0") & (F.col("status") != "archived") & (F.col("char_count") > 1000))).select("id")
)
catalog.add("filter_messages", f"WITH {MESSAGES} SELECT id, channel, body FROM messages WHERE contains(lower(team), 'team3') AND channel ILIKE '%ch1%' AND (body->>'$.k')::INT > 50 AND ts >= TIMESTAMP '2024-01-10'")(
    lambda spark, d: messages(spark, d).filter(F.lower("team").contains("team3") & F.col("channel").ilike("%ch1%") & (F.get_json_object("body", "$.k").cast("int") > 50) & (F.col("ts") >= F.lit("2024-01-10").cast("timestamp"))).select("id", "channel", "body")
)


def best_paragraph(body: Column, words: list[str], most: int = 200) -> Column:
    """The paragraph (split at blank lines) with the most query words, the first of equals, cut at a word's end within `most` characters."""
    parts = F.transform(F.split(body, r"\n[ \t]*\n"), lambda p, i: F.struct(sum((F.when(F.lower(p).contains(w), 1).otherwise(0) for w in words), F.lit(0)).alias("hits"), (-i).alias("i"), F.trim(p).alias("p")))
    best = F.array_max(parts)["p"]
    cut = F.regexp_replace(F.left(best, F.lit(most)), r"\s+\S*$", "")
    return F.when(F.length(best) > most, F.concat(cut, F.lit("..."))).otherwise(best)


catalog.add("snippet_best_paragraph")(lambda spark, d: table(spark, d, "documents").select("doc_id", best_paragraph(F.col("text"), ["the", "thing"]).alias("snippet")))


def within_budget(rows: DataFrame, group: list[str], order: list[Column], cost: Column, budget: int) -> DataFrame:
    """Rows of each group, in order, as long as the running cost stays within budget."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(cost).over(w)).filter(F.col("running") <= budget)


catalog.add("budget_rows", f"WITH {ENTRIES} SELECT id, team, running FROM (SELECT id, team, sum(char_count // 4) OVER (PARTITION BY resource_type, team ORDER BY created, id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM entries) WHERE running <= 4000")(
    lambda spark, d: within_budget(entries(spark, d), ["resource_type", "team"], [F.col("created"), F.col("id")], F.floor(F.col("char_count") / 4), 4000).select("id", "team", "running")
)
catalog.add("url_normalise", r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '^www\.', ''), '[?#].*$', ''), '/+$', '') AS key FROM pages")(lambda spark, d: table(spark, d, "pages").select("page_id", t.url_key(F.col("url")).alias("key")))
catalog.add("url_host", r"SELECT regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#:]+)', 1), '^www\.', '') AS host, count(*) AS pages FROM pages GROUP BY 1")(lambda spark, d: table(spark, d, "pages").groupBy(t.url_host(F.col("url")).alias("host")).agg(F.count("*").alias("pages")))
catalog.add("text_normalise", r"SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || '  (' || p_brand || ')'), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS norm, lower(regexp_replace(p_brand, '[-_]', ' ', 'g')) AS name FROM part")(
    lambda spark, d: table(spark, d, "part").select("p_partkey", t.normalized(F.concat("p_name", F.lit("  ("), "p_brand", F.lit(")"))).alias("norm"), t.plain_name(F.col("p_brand")).alias("name"))
)
catalog.add("text_tokens", f"SELECT doc_id, len({sql_tokens('text')})::INT AS words, len(list_distinct({sql_tokens('text', 4)}))::INT AS keywords FROM documents")(
    lambda spark, d: table(spark, d, "documents").select("doc_id", F.size(t.tokens(F.col("text"))).alias("words"), F.size(t.keywords(F.col("text"))).alias("keywords"))
)
catalog.add("text_trigrams", "SELECT p_partkey, len(list_distinct(list_transform(range(1, length(p_name) - 1), lambda i: substr(p_name, i, 3))))::INT AS grams FROM part")(lambda spark, d: table(spark, d, "part").select("p_partkey", F.size(t.char_grams(F.col("p_name"))).alias("grams")))
catalog.add(
    "text_shingles",
    f"""WITH t AS (SELECT doc_id, {sql_tokens('text', 1)} AS w FROM documents), w AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM t),
s AS (SELECT doc_id, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS s FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i))
SELECT t.doc_id, count(DISTINCT s)::INT AS shingles FROM t LEFT JOIN s ON t.doc_id = s.doc_id GROUP BY t.doc_id""",
)(
    lambda spark, d: table(spark, d, "documents").select("doc_id", F.size(t.word_shingles(t.tokens(F.col("text"), 1))).alias("shingles"))
)
_DATES = "CASE doc_id % 5 WHEN 0 THEN strftime(dt, '%Y-%m-%d') WHEN 1 THEN strftime(dt, '%d.%m.%Y') WHEN 2 THEN strftime(dt, '%m/%d/%Y') WHEN 3 THEN strftime(dt, '%Y-%m-%dT10:00:00Z') ELSE 'no date' END"
catalog.add("date_normalise", "SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN NULL ELSE DATE '2024-01-01' + (doc_id % 300)::INT END AS day FROM documents")(
    lambda spark, d: table(spark, d, "documents")
    .withColumn("dt", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")))
    .withColumn("raw", F.when(F.col("doc_id") % 5 == 0, F.date_format("dt", "yyyy-MM-dd")).when(F.col("doc_id") % 5 == 1, F.date_format("dt", "dd.MM.yyyy")).when(F.col("doc_id") % 5 == 2, F.date_format("dt", "MM/dd/yyyy")).when(F.col("doc_id") % 5 == 3, F.concat(F.date_format("dt", "yyyy-MM-dd"), F.lit("T10:00:00Z"))).otherwise("no date"))
    .select("doc_id", t.any_date(F.col("raw")).alias("day"))
)
catalog.add("id_parts", f"WITH {ENTRIES} SELECT id, string_split(id, '-')[1] AS prefix, regexp_extract(id, '-(\\d+)$', 1)::BIGINT AS number FROM entries")(lambda spark, d: entries(spark, d).select("id", t.id_prefix(F.col("id")).alias("prefix"), t.numeric_id(F.col("id")).alias("number")))
RULES = [("(?i)license|copyright", "legal"), ("(?i)token|password|key", "secret"), (r"\|", "table"), ("!!", "shout")]
catalog.add("category_rules", r"SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)license|copyright') THEN 'legal' WHEN regexp_matches(text, '(?i)token|password|key') THEN 'secret' WHEN regexp_matches(text, '\|') THEN 'table' WHEN regexp_matches(text, '!!') THEN 'shout' ELSE 'other' END AS category FROM documents")(
    lambda spark, d: table(spark, d, "documents").select("doc_id", t.first_match(F.col("text"), RULES, "other").alias("category"))
)
catalog.add("tags_from_list", "SELECT p_partkey, list_sort(list_distinct(string_split(lower(p_name || ' ' || p_type || ' ' || p_name), ' '))) AS tags FROM part")(
    lambda spark, d: table(spark, d, "part").select("p_partkey", F.array_sort(t.listed_tags(F.replace(F.concat_ws(" ", "p_name", "p_type", "p_name"), F.lit(" "), F.lit(", ")))).alias("tags"))
)
catalog.add("section_from_alias_keys", "SELECT event_id, coalesce(props->>'$.findings', props->>'$.summary', props->>'$.k') AS section FROM events")(
    lambda spark, d: table(spark, d, "events").select("event_id", F.coalesce(*[F.get_json_object("props", f"$.{k}") for k in ("findings", "summary", "k")]).alias("section"))
)
catalog.add("json_path_reads", "SELECT event_id, (props->>'$.k')::INT AS k FROM events WHERE (props->>'$.k') IS NOT NULL")(lambda spark, d: table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).filter("k IS NOT NULL"))
catalog.add("filter_results", "SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id HAVING count(*) >= 3 AND bool_or(role = 'assistant')")(
    lambda spark, d: table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.bool_or(F.col("role") == "assistant").alias("a")).filter("turns >= 3 AND a").drop("a")
)
catalog.add("naming_rules", "SELECT p_partkey, regexp_full_match(p_brand, 'Brand#[0-9]{2}') AS ok, CASE WHEN NOT regexp_full_match(p_brand, 'Brand#[0-9]{2}') THEN regexp_replace(p_brand, '#([0-9])$', '#0\\1') END AS suggested FROM part")(
    lambda spark, d: table(spark, d, "part").withColumn("ok", F.col("p_brand").rlike("^Brand#[0-9]{2}$")).select("p_partkey", "ok", F.when(~F.col("ok"), F.regexp_replace("p_brand", "#([0-9])$", "#0$1")).alias("suggested"))
)
catalog.add("message_size_check", f"WITH {MESSAGES} SELECT id, (strlen(body) + strlen(type) + 64)::INT AS bytes, (strlen(body) + strlen(type) + 64) <= 80 AS fits, regexp_replace(upper(channel) || '/x y', '[^A-Za-z0-9_-]', '_', 'g') AS channel FROM messages")(
    lambda spark, d: messages(spark, d).withColumn("bytes", (F.octet_length("body") + F.octet_length("type") + 64).cast("int")).select("id", "bytes", (F.col("bytes") <= 80).alias("fits"), F.regexp_replace(F.concat(F.upper("channel"), F.lit("/x y")), "[^A-Za-z0-9_-]", "_").alias("channel"))
)
catalog.add("markdown_section")(
    lambda spark, d: table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("## "), "role", F.lit("\n"), "text").alias("s"))))["s"], "\n").alias("body")).select("conv_id", t.markdown_section(F.col("body"), "assistant").alias("section"))
)
catalog.add("nested_field_reads", "SELECT event_id, json_extract_string(json_object('a', json_object('k', props->'$.k', 'items', json_array(event_type, user_id))), '$.a.items[0]') AS first_item FROM events")(
    lambda spark, d: table(spark, d, "events").select("event_id", F.get_json_object(F.to_json(F.struct(F.struct(F.get_json_object("props", "$.k").alias("k"), F.array(F.col("event_type"), F.col("user_id").cast("string")).alias("items")).alias("a"))), "$.a.items[0]").alias("first_item"))
)
