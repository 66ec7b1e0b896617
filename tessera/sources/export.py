"""Sinks: tables as CSV, TSV, JSON or aligned text, and a token-lean text form with URL prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans import Catalog, table

catalog = Catalog()


def write_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Write df as csv, tsv or json."""
    if kind == "json":
        df.write.json(path)
    else:
        df.write.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(path)


def aligned(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """(line): columns cut or padded to their widths, two spaces apart."""
    cells = [F.rpad(F.left(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(w)), w, " ") for c, w in widths.items()]
    return df.select(F.rtrim(F.concat_ws("  ", *cells)).alias("line"))


def short_url(url: Column, prefixes: dict[str, str]) -> Column:
    """A URL with the first matching prefix replaced by its short form."""
    out = url
    for prefix, short in prefixes.items():
        out = F.when(out.startswith(prefix), F.concat(F.lit(short), F.substring(out, F.lit(len(prefix) + 1), F.length(out)))).otherwise(out)
    return out


def compact_lines(df: DataFrame, fields: list[str]) -> DataFrame:
    """(line): the non-empty fields of each row, joined by '|'."""
    filled = [F.nullif(F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit("")) for f in fields]
    return df.select(F.concat_ws("|", *filled).alias("line"))


PREFIXES = {"https://": "s:", "http://": "h:"}
catalog.add("export_compact", "SELECT page_id::VARCHAR || '|' || CASE WHEN starts_with(url, 'https://') THEN 's:' || substr(url, 9) WHEN starts_with(url, 'http://') THEN 'h:' || substr(url, 8) ELSE url END AS line FROM pages")(
    lambda s, d: compact_lines(table(s, d, "pages").select("page_id", short_url(F.col("url"), PREFIXES).alias("url")), ["page_id", "url"])
)
catalog.add("export_aligned", "SELECT rtrim(rpad(left(p_partkey::VARCHAR, 6), 6, ' ') || '  ' || rpad(left(p_name, 12), 12, ' ') || '  ' || rpad(left(p_brand, 9), 9, ' ')) AS line FROM part")(
    lambda s, d: aligned(table(s, d, "part"), {"p_partkey": 6, "p_name": 12, "p_brand": 9})
)
