"""Records from JSON files of several shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys under which a file may hold its list of records.
LISTS = ("findings", "results", "entries", "data", "items")


def read_records(spark: SparkSession, path: str, schema: str, lists: Sequence[str] = LISTS) -> DataFrame:
    """Rows of the files' records: a list of objects, an object that holds such a list under one of `lists` (else it is the record), or an object per line.

    Lines that are no objects are skipped, and so are empty files. A file is one row until its records are told apart, as JSON may span lines.
    """
    files = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v")).filter("v <> ''")
    whole = F.try_parse_json("v")
    kind = F.schema_of_variant(whole)
    wrapped = F.from_json("v", "struct<" + ", ".join(f"`{k}`: array<string>" for k in lists) + ">")
    inner = F.coalesce(*[wrapped[k] for k in lists], F.array("v"))
    lines = F.split("v", r"\n")
    full = F.filter(lines, lambda x: F.trim(x) != "")
    by_line = (F.size(full) > 1) & F.try_parse_json(full[0]).isNotNull() & F.trim(full[0]).startswith("{")  # a whole object and more
    records = F.when(by_line, lines).when(kind.startswith("ARRAY"), F.from_json("v", "array<string>")).when(kind.startswith("OBJECT"), inner).otherwise(lines)
    rows = files.select(F.explode(records).alias("r")).filter(F.trim("r").startswith("{"))
    return rows.select(F.from_json("r", schema, {"mode": "PERMISSIVE"}).alias("x"), F.try_parse_json("r").alias("ok")).filter("ok IS NOT NULL").select("x.*")
