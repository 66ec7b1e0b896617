"""Column functions on text, URLs, dates and JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A small English stop list, the default of tokens() callers that ask for one.
STOP_WORDS = ("the", "and", "of", "to", "in", "is", "it", "for", "on", "with", "as", "by", "that", "this", "be", "are", "was", "at", "an", "or", "from")


def tokens(text: Column, least: int = 2, stop: Sequence[str] = ()) -> Column:
    """ASCII words of at least `least` letters in lower case, in order; a word that touches another letter, digit or underscore doesn't count."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+")
    words = F.filter(parts, lambda w: w.rlike(f"^[a-z]{{{least},}}$"))
    return F.filter(words, lambda w: ~w.isin(*stop)) if stop else words


def keywords(text: Column, least: int = 4) -> Column:
    """Distinct tokens of at least `least` letters."""
    return F.array_distinct(tokens(text, least))


def normalized(text: Column) -> Column:
    """Lower case, letters and digits (ASCII) and single spaces only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " "), " +", " "))


def squeezed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def plain_name(text: Column) -> Column:
    """Hyphens and underscores as spaces, lower case."""
    return F.lower(F.regexp_replace(text, "[-_]", " "))


def char_grams(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams; a shorter text is its own gram, an empty one has none."""
    size = F.length(text)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.substring(text, i, F.lit(n))))
    return F.when(size >= n, grams).when(size > 0, F.array(text)).otherwise(F.array().cast("array<string>"))


def word_shingles(words: Column, k: int = 5) -> Column:
    """Distinct runs of k words, joined by spaces; none if there are fewer words."""

    def runs(w: Column) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(k)), " "))
        return F.when(F.size(w) >= k, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(words), runs)[0]  # the words are worked out once, not once per run


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values, 0 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    all_ = F.size(a) + F.size(b) - both
    return F.when(all_ > 0, both / all_).otherwise(F.lit(0.0))


def url_key(url: Column) -> Column:
    """A URL without scheme, www., query, fragment and slashes at its end, in lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), "^[a-z][a-z0-9+.-]*://", ""), r"^www\.", "")
    return F.regexp_replace(F.regexp_replace(bare, "[?#].*$", ""), "/+$", "")


def url_host(url: Column) -> Column:
    """The host of a URL without www., in lower case; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def occurrences(text: Column, part: Column | str) -> Column:
    """How often part stands in text, without overlaps."""
    part = F.lit(part) if isinstance(part, str) else part
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(text) / 4).cast("long")


def any_date(value: Column) -> Column:
    """A date from ISO text (with or without time), day.month.year, month/day/year, 'Month d, yyyy' or epoch seconds; null if none fits."""
    head = F.regexp_extract(value, r"^(\d{4}-\d{2}-\d{2})", 1)
    return F.coalesce(
        F.try_to_date(F.nullif(head, F.lit("")), "yyyy-MM-dd"),
        F.when(value.rlike(r"^\d{4}/\d{2}/\d{2}$"), F.try_to_date(value, "yyyy/MM/dd")),
        F.when(value.rlike(r"^\d{2}\.\d{2}\.\d{4}$"), F.try_to_date(value, "dd.MM.yyyy")),
        F.when(value.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_date(value, "MM/dd/yyyy")),
        F.when(value.rlike(r"^[A-Z][a-z]+ \d{1,2}, \d{4}$"), F.try_to_date(value, "MMMM d, yyyy")),
        F.when(value.rlike(r"^\d{9,10}(\.\d+)?$"), F.to_date(F.timestamp_seconds(value.try_cast("double")))),
    )


def numeric_id(value: Column) -> Column:
    """The number behind the last hyphen of PREFIX-0001; null if there is none."""
    return F.regexp_extract(value, r"-(\d+)$", 1).try_cast("long")


def id_prefix(value: Column) -> Column:
    return F.split_part(value, F.lit("-"), F.lit(1))


def first_match(text: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """The result of the first rule (pattern, result) whose pattern is found in text."""
    out = F.lit(default)
    for pattern, result in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(result)).otherwise(out)
    return out


def listed_tags(value: Column, most: int = 10) -> Column:
    """Distinct lower-case tags of a comma-separated text, the first `most`."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda t: F.lower(F.trim(t)))
    return F.slice(F.array_distinct(F.filter(parts, lambda t: t != "")), 1, most)


def markdown_section(body: Column, name: str) -> Column:
    """The text under the heading `## name` (else the first heading that contains name) up to the next `##`."""
    import re

    exact = F.regexp_extract(body, rf"(?is)(?:^|\n)##[ ]+{re.escape(name)}[ ]*\n(.*?)(?=\n##|\z)", 1)
    partial = F.regexp_extract(body, rf"(?is)(?:^|\n)##[^\n]*{re.escape(name)}[^\n]*\n(.*?)(?=\n##|\z)", 1)
    return F.btrim(F.coalesce(F.nullif(exact, F.lit("")), F.nullif(partial, F.lit(""))), F.lit(" \t\r\n"))


def front_matter(text: Column) -> tuple[Column, Column]:
    """(map of key to value, body) of a text that may begin with a `---` block."""
    head = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---\n?", 1)
    body = F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n?", "")
    lines = F.filter(F.split(head, "\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")))
    first = F.filter(pairs, lambda p: p["key"] != "")
    return F.map_from_entries(F.filter(first, lambda p: F.element_at(F.filter(first, lambda q: q["key"] == p["key"]), -1)["value"] == p["value"])), body


def bracket_list(value: Column) -> Column:
    """The items of `[a, b]` (quotes taken off), or the value itself as the only item."""
    inner = F.regexp_extract(value, r"^\[(.*)\]$", 1)
    items = F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", ""))
    return F.when(value.rlike(r"^\[.*\]$"), F.filter(items, lambda x: x != "")).otherwise(F.array(value))
