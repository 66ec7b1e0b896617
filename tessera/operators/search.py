"""Text search and ranking: TF-IDF, BM25, weighted keyword scores, postings, vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as t
from tessera.plans import Catalog, table
from tessera.plans.bind import ENTRIES, entries, sql_tokens
from tessera.plans.loop import kept

catalog = Catalog()


#: Documents, whose words are counted together by a task.
COUNTED_ROWS = 1_000


def term_counts(docs: DataFrame, id_col: str, words: Column) -> DataFrame:
    """(id, term, tf, length): occurrences of each term and the number of all words of the document.

    A document's words are counted where its row is, so no word is shuffled; only if ids occur twice are the counts of their rows added.
    """
    w = docs.select(F.col(id_col).alias("id"), words.alias("w"))
    kinds = T.StructType([w.schema["id"], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("length", T.IntegerType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, COUNTED_ROWS):
                ids, lists = (batch.column(k).slice(begin, COUNTED_ROWS) for k in (0, 1))
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                terms = lists.flatten().dictionary_encode(null_encoding="encode")
                if not len(terms):
                    continue
                codes = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                keys, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * len(terms.dictionary) + codes, return_counts=True)
                row, code = np.divmod(keys, len(terms.dictionary))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), terms.dictionary.take(pa.array(code)), pa.array(tf), pa.array(sizes[row].astype(np.int32))], names=["id", "term", "tf", "length"])

    found = w.mapInArrow(count, kinds)
    if docs.groupBy(id_col).agg(F.count("*").alias("n")).filter("n > 1").head(1):
        return found.groupBy("id", "term").agg(F.sum("tf").alias("tf"), F.first("length").alias("length"))
    return found


#: Terms that are sent to workers, the commonest of them; rarer ones meet by a shuffle.
SENT_TERMS = 2_000_000


def term_documents(terms: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(term, df): the number of rows of each term that has more than one, and of the asked ones (term) that have any; written."""
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    if asked is None:
        return kept(df.filter("df > 1"), "term-documents")
    df = df.join(F.broadcast(asked.select("term", F.lit(True).alias("_asked"))), "term", "left")
    return kept(df.filter("df > 1 OR _asked").select("term", "df"), "term-documents")


def with_documents(terms: DataFrame, df: DataFrame) -> DataFrame:
    """terms (term, ..) with the df of term_documents; most terms stand in one document, so those that df lacks have 1."""
    terms = terms.filter("term IS NOT NULL")
    one = lambda x: x.withColumn("df", F.coalesce("df", F.lit(1)))
    if df.count() <= SENT_TERMS:
        return one(terms.join(F.broadcast(df), "term", "left"))
    place = F.sum("n").over(Window.orderBy(F.desc("df")))  # a row per df
    held = df.groupBy("df").agg(F.count("*").alias("n")).withColumn("sent", place <= SENT_TERMS).filter("sent").agg(F.min("df")).first()[0]
    sent = df.filter(F.col("df") >= held) if held is not None else df.limit(0)
    rare = terms.join(F.broadcast(sent.select("term")), "term", "left_anti").join(df.join(F.broadcast(sent.select("term")), "term", "left_anti"), "term", "left")
    return terms.join(F.broadcast(sent), "term").unionByName(one(rare))


def tfidf(terms: DataFrame, documents: int | Column) -> DataFrame:
    """(id, term, weight): tf / length times ln((N + 1) / (df + 1)) + 1."""
    n = F.lit(documents) if isinstance(documents, int) else documents
    idf = F.log((n + 1) / (F.col("df") + 1)) + 1
    return with_documents(terms, term_documents(terms)).select("id", "term", (F.col("tf") / F.col("length") * idf).alias("weight"))


def tfidf_search(docs: DataFrame, id_col: str, text_col: str, query: str, top: int = 10) -> DataFrame:
    """(id, score): the top documents by cosine of TF-IDF vectors; the query counts as one of the N documents for the IDF."""
    spark = docs.sparkSession
    q = spark.createDataFrame([(query,)], "q string").select(F.explode(t.tokens(F.col("q"))).alias("term"))
    q = q.groupBy("term").agg(F.count("*").alias("qtf")).withColumn("qn", F.sum("qtf").over(Window.partitionBy()))  # a row per query word
    terms = term_counts(docs, id_col, t.tokens(F.col(text_col)))
    n = docs.agg((F.count("*") + 1).alias("n"))
    df = term_documents(terms, q)
    idf = F.log((F.col("n") + 1) / (F.col("df") + F.when(F.col("qtf").isNotNull(), 1).otherwise(0) + 1)) + 1
    valued = lambda x, how: x.join(F.broadcast(q), "term", how).join(F.broadcast(n)).withColumns({"idf": idf, "qw": F.col("qtf") / F.col("qn") * idf})
    weights = valued(with_documents(terms, df), "left").withColumn("w", F.col("tf") / F.col("length") * F.col("idf"))
    scored = weights.groupBy("id").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    # Query words that no document has weigh in the query's norm alone, with a document frequency of 1 for the query.
    qnorm = valued(q.select("term").join(df, "term", "left").fillna(0, ["df"]), "inner").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    return scored.filter("dot > 0").join(F.broadcast(qnorm)).select("id", F.round(F.col("dot") / (F.col("norm") * F.col("qnorm")), 6).alias("score")).orderBy(F.desc("score"), "id").limit(top)


QUERY = "the thing of idiot with onerti and that"

catalog.add(
    "search_tfidf_cosine",
    f"""WITH d AS (SELECT doc_id AS id, {sql_tokens('text')} AS w FROM documents),
x AS (SELECT id, len(w) AS length, unnest(w) AS term FROM d), tf AS (SELECT id, term, count(*) AS tf, any_value(length) AS length FROM x GROUP BY id, term),
q AS (SELECT term, count(*) AS qtf, sum(count(*)) OVER () AS qn FROM (SELECT unnest({sql_tokens(f"'{QUERY}'")}) AS term) GROUP BY term),
n AS (SELECT count(*) + 1 AS n FROM documents),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
i AS (SELECT coalesce(df.term, q.term) AS term, qtf, qn, ln((n + 1) / (coalesce(df, 0) + CASE WHEN qtf IS NULL THEN 0 ELSE 1 END + 1)) + 1 AS idf FROM df FULL JOIN q ON df.term = q.term, n),
s AS (SELECT tf.id, sum(tf / length * idf * qtf / qn * idf) AS dot, sqrt(sum((tf / length * idf) ** 2)) AS norm FROM tf JOIN i USING (term) GROUP BY tf.id)
SELECT id, round(dot / (norm * (SELECT sqrt(sum((qtf / qn * idf) ** 2)) FROM i)), 6) AS score FROM s WHERE dot > 0 ORDER BY score DESC, id LIMIT 10""",
)(lambda spark, d: tfidf_search(table(spark, d, "documents"), "doc_id", "text", QUERY))


@catalog.add(
    "search_tfidf_weights",
    f"""WITH x AS (SELECT doc_id AS id, len({sql_tokens('text')}) AS length, unnest({sql_tokens('text')}) AS term FROM documents),
tf AS (SELECT id, term, count(*) AS tf, any_value(length) AS length FROM x GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT id, count(*) AS terms, round(sum(tf / length * (ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1)), 5) AS total
FROM tf JOIN df USING (term) GROUP BY id""",
)
def _tfidf_weights(spark, d):
    docs = table(spark, d, "documents")
    n = docs.agg(F.count("*").alias("n"))
    terms = term_counts(docs, "doc_id", t.tokens(F.col("text")))
    w = with_documents(terms, term_documents(terms)).join(F.broadcast(n)).withColumn("weight", F.col("tf") / F.col("length") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1))
    return w.groupBy("id").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 5).alias("total"))


def bm25(docs: DataFrame, id_col: str, fields: dict[str, float], query: Sequence[str], k1: float = 1.2, b: float = 0.75, top: int = 10) -> DataFrame:
    """(id, score): the top documents by BM25 with a weight per field; a field's occurrences count that often, lengths alike."""
    words = {f: t.tokens(F.col(f), 1) for f in fields}
    rows = docs.select(F.col(id_col).alias("id"), *[w.alias(f) for f, w in words.items()])
    length = sum((F.size(f) * w for f, w in fields.items()), F.lit(0.0))
    terms = F.array(*map(F.lit, query))
    tf = lambda term: sum((F.size(F.filter(F.col(f), lambda x: x == term)) * w for f, w in fields.items()), F.lit(0.0))
    # Lengths and hits are small and read three times; the texts are cut into words once.
    rows = kept(rows.select("id", length.alias("length"), F.filter(F.transform(terms, lambda q: F.struct(q.alias("term"), tf(q).alias("tf"))), lambda x: x["tf"] > 0).alias("hits")), "field-hits")
    corpus = rows.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    hits = rows.select("id", "length", F.inline("hits"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # a row per query term
    h = hits.join(F.broadcast(df), "term").join(F.broadcast(corpus))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return h.groupBy("id").agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.desc("score"), "id").limit(top)


BM25_TERMS = ["thing", "moron", "ention", "einheit"]
_field = lambda f: f"len(list_filter({f}, lambda x: x = term))"
catalog.add(
    "search_bm25_fields",
    f"""WITH {ENTRIES}, e AS (SELECT id, {sql_tokens('title', 1)} AS a, {sql_tokens('summary', 1)} AS b, {sql_tokens('body', 1)} AS c FROM entries),
l AS (SELECT *, len(a) * 10.0 + len(b) * 5.0 + len(c) * 1.0 AS length FROM e),
h AS (SELECT id, length, term, {_field('a')} * 10.0 + {_field('b')} * 5.0 + {_field('c')} * 1.0 AS tf FROM l, (SELECT unnest({BM25_TERMS}) AS term)),
f AS (SELECT * FROM h WHERE tf > 0), df AS (SELECT term, count(*) AS df FROM f GROUP BY term)
SELECT id, round(sum(ln(((SELECT count(*) FROM l) - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / (SELECT avg(length) FROM l)))), 6) AS score
FROM f JOIN df USING (term) GROUP BY id ORDER BY score DESC, id LIMIT 10""",
)(lambda spark, d: bm25(entries(spark, d), "id", {"title": 10.0, "summary": 5.0, "body": 1.0}, BM25_TERMS))


def keyword_score(words: Sequence[str], weights: dict[str, float], all_must_hit: bool = True) -> Column:
    """Sum over words of the weight of every field that contains the word; 0 unless all words hit somewhere."""
    per_word = [sum((F.when(F.lower(F.col(f).cast("string")).contains(w.lower()), F.lit(x)).otherwise(F.lit(0.0)) for f, x in weights.items()), F.lit(0.0)) for w in words]
    total = sum(per_word, F.lit(0.0))
    if not all_must_hit:
        return total
    hit = F.lit(True)
    for p in per_word:
        hit &= p > 0
    return F.when(hit, total).otherwise(F.lit(0.0))


def _has(f: str, w: str, x: float) -> str:
    return f"CASE WHEN contains(lower({f}::VARCHAR), '{w}') THEN {x} ELSE 0.0 END"


_KW = {"id": 10.0, "team": 5.0, "title": 3.0, "summary": 1.0}
_per = [" + ".join(_has(f, w, x) for f, x in _KW.items()) for w in ("team3", "the")]
catalog.add(
    "search_keyword_fields",
    f"WITH {ENTRIES}, s AS (SELECT id, {_per[0]} AS x, {_per[1]} AS y FROM entries) SELECT id, x + y AS score FROM s WHERE x > 0 AND y > 0",
)(lambda spark, d: entries(spark, d).select("id", keyword_score(["team3", "the"], _KW).alias("score")).filter("score > 0"))


catalog.add(
    "search_substring_score",
    f"""WITH {ENTRIES} SELECT id, (CASE WHEN contains(lower(title), 'there') THEN 10 ELSE 0 END + CASE WHEN contains(lower(id), '00') THEN 8 ELSE 0 END
  + CASE WHEN contains(lower(summary), 'there') THEN 5 ELSE 0 END + CASE WHEN contains(lower(body), 'there') THEN 2 ELSE 0 END
  + 3 * (len(list_filter(['there', 'ing'], lambda p: contains(lower(title), p)))))::INT AS score FROM entries""",
)(
    lambda spark, d: entries(spark, d).select(
        "id",
        (
            F.when(F.lower("title").contains("there"), 10).otherwise(0) + F.when(F.lower("id").contains("00"), 8).otherwise(0) + F.when(F.lower("summary").contains("there"), 5).otherwise(0)
            + F.when(F.lower("body").contains("there"), 2).otherwise(0) + 3 * F.size(F.filter(F.array(F.lit("there"), F.lit("ing")), lambda p: F.lower(F.col("title")).contains(p)))
        ).cast("int").alias("score"),
    )
)


def location_score(text: Column, phrase: str) -> Column:
    """Phrase found: 10; each word: its occurrences (5 at most), 3 more in the first 200 characters, 1 more in the first 500."""
    low = F.lower(text)
    score = F.when(low.contains(phrase.lower()), F.lit(10)).otherwise(F.lit(0))
    for w in phrase.lower().split():
        score += F.least(t.occurrences(low, w), F.lit(5)) + F.when(F.left(low, F.lit(200)).contains(w), 3).otherwise(0) + F.when(F.left(low, F.lit(500)).contains(w), 1).otherwise(0)
    return score.cast("long")


_loc = " + ".join(
    f"least((length(t) - length(replace(t, '{w}', ''))) // {len(w)}, 5) + CASE WHEN contains(left(t, 200), '{w}') THEN 3 ELSE 0 END + CASE WHEN contains(left(t, 500), '{w}') THEN 1 ELSE 0 END"
    for w in ("and", "the")
)
catalog.add("search_location_score", f"SELECT doc_id, (CASE WHEN contains(t, 'and the') THEN 10 ELSE 0 END + {_loc})::BIGINT AS score FROM (SELECT doc_id, lower(text) AS t FROM documents)")(
    lambda spark, d: table(spark, d, "documents").select("doc_id", location_score(F.col("text"), "and the").alias("score"))
)


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, id, tf, positions) of all words."""
    w = docs.select(F.col(id_col).alias("id"), F.posexplode(t.tokens(F.col(text_col), 1)).alias("pos", "term"))
    return w.groupBy("term", "id").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def all_words(docs: DataFrame, id_col: str, text_col: str, words: Sequence[str]) -> DataFrame:
    """(id, score): documents that have every word; the score is the number of all hits."""
    p = docs.select(F.col(id_col).alias("id"), F.explode(F.filter(t.tokens(F.col(text_col), 1), lambda w: w.isin(*words))).alias("term"))
    return p.groupBy("id").agg(F.count_distinct("term").alias("n"), F.count("*").alias("score")).filter(F.col("n") == len(set(words))).select("id", "score")


catalog.add(
    "search_boolean_and",
    f"WITH x AS (SELECT doc_id AS id, unnest({sql_tokens('text', 1)}) AS term FROM documents) SELECT id, count(*) AS score FROM x WHERE term IN ('the', 'with', 'for') GROUP BY id HAVING count(DISTINCT term) = 3",
)(lambda spark, d: all_words(table(spark, d, "documents"), "doc_id", "text", ["the", "with", "for"]))

catalog.add("search_phrase", "SELECT doc_id, 10 AS score FROM documents WHERE contains(lower(text), 'of the')")(
    lambda spark, d: table(spark, d, "documents").filter(F.lower("text").contains("of the")).select("doc_id", F.lit(10).alias("score"))
)

catalog.add(
    "search_postings",
    f"WITH x AS (SELECT doc_id AS id, unnest({sql_tokens('text', 1)}) AS term FROM documents) SELECT term, count(DISTINCT id) AS documents, count(*) AS occurrences FROM x GROUP BY term HAVING count(DISTINCT id) >= 20",
)(lambda spark, d: postings(table(spark, d, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("documents"), F.sum("tf").alias("occurrences")).filter("documents >= 20"))

catalog.add(
    "search_topic_overlap",
    f"""WITH {ENTRIES} SELECT id, (3 * len(list_intersect(list_distinct({sql_tokens('title')}), ['the', 'and', 'thing', 'ention'])) + len(list_intersect(list_distinct({sql_tokens('summary')}), ['the', 'and', 'thing', 'ention'])))::INT AS relevance FROM entries""",
)(
    lambda spark, d: entries(spark, d).select(
        "id",
        (3 * F.size(F.array_intersect(t.tokens(F.col("title")), F.array(*map(F.lit, ("the", "and", "thing", "ention"))))) + F.size(F.array_intersect(t.tokens(F.col("summary")), F.array(*map(F.lit, ("the", "and", "thing", "ention")))))).cast("int").alias("relevance"),
    )
)


def expansion_terms(docs: DataFrame, text_col: str, query: Sequence[str], top: int = 20, least: int = 2) -> DataFrame:
    """(term, n): the commonest words of at least four letters that the query lacks."""
    w = docs.select(F.explode(t.tokens(F.col(text_col), 4)).alias("term")).filter(~F.col("term").isin(*query))
    return w.groupBy("term").agg(F.count("*").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "term").limit(top)


catalog.add(
    "search_expansion_terms",
    f"SELECT term, count(*) AS n FROM (SELECT unnest({sql_tokens('text', 4)}) AS term FROM documents) WHERE term NOT IN ('that', 'with') GROUP BY term HAVING count(*) >= 2 ORDER BY n DESC, term LIMIT 20",
)(lambda spark, d: expansion_terms(table(spark, d, "documents"), "text", ["that", "with"]))


def distance2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, query: DataFrame, top: int = 10) -> DataFrame:
    """(vec_id, distance): the vectors nearest to the one row of query (a column `query`)."""
    scored = vectors.join(F.broadcast(query.limit(1))).select("vec_id", F.round(F.sqrt(distance2(F.col("embedding"), F.col("query"))), 6).alias("distance"))
    return scored.orderBy("distance", "vec_id").limit(top)


def nearest_of_each(vectors: DataFrame, queries: DataFrame, top: int = 10, rows: int = 2_000, asked: int = 200) -> DataFrame:
    """(query_id, vec_id, distance): the top nearest of vectors (vec_id, embedding) for each of queries (query_id, embedding), exactly.

    Blocks of queries meet blocks of vectors; each pair of blocks gives its own top, of which the best are taken.
    """

    def blocks(df: DataFrame, key: str, size: int, name: str) -> DataFrame:
        count = max(1, -(-df.count() // size))
        return df.groupBy(F.pmod(F.xxhash64(key), F.lit(count)).alias("_b")).agg(F.collect_list(F.struct(F.col(key).alias("id"), F.col("embedding").cast("array<double>").alias("v"))).alias(name)).drop("_b")

    def meet(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            for x, y in zip(batch["x"], batch["y"]):
                ids, who = np.array([r["id"] for r in x]), np.array([r["id"] for r in y])
                v, q = np.stack([r["v"] for r in x]), np.stack([r["v"] for r in y])
                for i, one in zip(who, q):
                    d = np.sqrt(((v - one) ** 2).sum(axis=1)).round(6)
                    near = np.lexsort((ids, d))[:top]
                    yield pd.DataFrame({"query_id": i, "vec_id": ids[near], "distance": d[near]})

    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {vectors.schema['vec_id'].dataType.simpleString()}, distance double"
    pairs = blocks(vectors, "vec_id", rows, "x").crossJoin(blocks(queries, "query_id", asked, "y"))  # of blocks, not of rows
    found = pairs.repartition(max(8, vectors.sparkSession.sparkContext.defaultParallelism)).mapInPandas(meet, kinds)
    best = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= top).drop("r")


catalog.add(
    "search_vector_knn",
    "SELECT q.vec_id AS query_id, v.vec_id, round(sqrt(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2))), 6) AS distance FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0 AND v.label >= 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY distance, v.vec_id) <= 10",
)(lambda spark, d: nearest_of_each(table(spark, d, "embeddings").filter("label >= 0"), table(spark, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")))


def fuse_ranks(first: DataFrame, second: DataFrame, k: int = 60, top: int = 10) -> DataFrame:
    """(id, score): reciprocal rank fusion of two ranked lists (id, score) of a few rows each."""
    by_score = Window.orderBy(F.desc("score"), "id")
    ranked = lambda x: x.select("id", (1 / (F.row_number().over(by_score) + k)).alias("r"))
    return ranked(first).unionByName(ranked(second)).groupBy("id").agg(F.round(F.sum("r"), 8).alias("score")).orderBy(F.desc("score"), "id").limit(top)


@catalog.add("search_hybrid")
def _hybrid(spark, d):
    """Vectors stand for the documents of the same number; the lists are fused by reciprocal rank."""
    docs = table(spark, d, "documents")
    words = bm25(docs, "doc_id", {"text": 1.0}, ["thing", "moron", "ention"], top=50)
    near = _vectors = nearest(table(spark, d, "embeddings"), table(spark, d, "embeddings").filter("vec_id = 7").select(F.col("embedding").alias("query")), 50)
    return fuse_ranks(words, near.select(F.col("vec_id").alias("id"), (-F.col("distance")).alias("score")), top=20)


def line_hits(docs: DataFrame, id_col: str, text_col: str, words: Sequence[str], around: int = 1) -> DataFrame:
    """(id, line_no, line, score, context): lines with any of the words, scored by how many they have, with the lines around."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"), F.split(text_col, "\n").alias("_all"))
    low = F.lower("line")
    score = sum((F.when(low.contains(w), 1).otherwise(0) for w in words), F.lit(0))
    context = F.slice("_all", F.greatest(F.col("line_no") + 1 - around, F.lit(1)), F.least(F.col("line_no") + 1, F.lit(around + 1)) + around)
    return lines.select("id", "line_no", "line", score.alias("score"), F.array_join(context, "\n").alias("context")).filter("score > 0")


_LINES = "l AS (SELECT doc_id AS id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, string_split(text, chr(10)) AS ls FROM documents)"
_LSCORE = "(CASE WHEN contains(lower(line), 'idiot') THEN 1 ELSE 0 END + CASE WHEN contains(lower(line), 'license') THEN 1 ELSE 0 END)"
catalog.add(
    "search_lines_context",
    f"WITH {_LINES} SELECT id, line_no::INT AS line_no, line, {_LSCORE}::INT AS score, array_to_string(ls[greatest(line_no, 1):line_no + 2], chr(10)) AS context FROM l WHERE {_LSCORE} > 0",
)(lambda spark, d: line_hits(table(spark, d, "documents"), "doc_id", "text", ["idiot", "license"]))

catalog.add(
    "search_documents_by_lines",
    f"WITH {_LINES}, h AS (SELECT id, {_LSCORE} AS score FROM l WHERE lang = 'en') SELECT id, count(*) AS lines, sum(score)::BIGINT AS total, max(score)::INT AS best FROM h WHERE score > 0 GROUP BY id ORDER BY total DESC, id LIMIT 20",
)(
    lambda spark, d: line_hits(table(spark, d, "documents").filter("lang = 'en'"), "doc_id", "text", ["idiot", "license"])
    .groupBy("id").agg(F.count("*").alias("lines"), F.sum("score").alias("total"), F.max("score").alias("best")).orderBy(F.desc("total"), "id").limit(20)
)

catalog.add(
    "search_catalogue_filters",
    f"WITH {ENTRIES} SELECT id, title FROM entries WHERE lower(category) = 'en' AND char_count BETWEEN 500 AND 5000 AND contains(lower(title || ' ' || summary), 'thing') AND team IN ('team1', 'team2')",
)(
    lambda spark, d: entries(spark, d)
    .filter((F.lower("category") == "en") & F.col("char_count").between(500, 5000) & F.lower(F.concat("title", F.lit(" "), "summary")).contains("thing") & F.col("team").isin("team1", "team2"))
    .select("id", "title")
)
