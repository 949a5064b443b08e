"""What a reading gives to others: fields with their trust, issues and text as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.functions import codec, dates
from zonalis.functions.validate import GUARDS, issues, trust


def read_fields(df: DataFrame, reference_year: int, states: list[str], line1: str = "line1", line2: str = "line2") -> DataFrame:
    """df with doc (parsed) and found (issues). They are columns, so that later expressions don't work them out again."""
    return df.withColumns({"doc": codec.parse(F.col(line1), F.col(line2)), "found": issues(F.col(line1), F.col(line2), reference_year, states)})


def field_rows(reference_year: int) -> Column:
    """Array of (key, value, raw, guard, status) over the columns doc and found. A date's value is the ISO date where there is one, any other's is the raw text, with fillers shown as blanks."""
    rows = []
    for name, (guard, _) in GUARDS.items():
        field = F.col("doc")[name]
        raw = codec.clean(field)
        value = F.coalesce(dates.iso_date(field, reference_year, name == "birth_date"), raw) if name in ("birth_date", "expiry_date") else raw
        rows.append(F.struct(F.lit(name).alias("key"), value.alias("value"), raw.alias("raw"), F.lit(guard).alias("guard"), trust(name, F.col("found")).alias("status")))
    return F.array(*rows)


def field_of(fields: Column, key: str) -> Column:
    """The field with that key, of an array of them; an error without one."""
    return F.coalesce(F.get(F.filter(fields, lambda x: x["key"] == key), F.lit(0)), F.raise_error(F.lit(f"no field {key}")))


def as_payload(df: DataFrame, reference_year: int, states: list[str], line1: str = "line1", line2: str = "line2", confidence: str | None = None) -> DataFrame:
    """df with payload: JSON of the fields, the issues, the lines, whether all is valid, whether the composite digit is right, whether the document has expired, and the reader's confidence if df has it."""
    read = read_fields(df, reference_year, states, line1, line2).withColumn("fields", field_rows(reference_year))
    broken = F.exists("found", lambda x: x["field"] == "composite_cd")
    expiry = dates.iso_date(F.col("doc")["expiry_date"], reference_year, False)
    lines = F.struct(F.col(line1).alias("line1"), F.col(line2).alias("line2"))
    parts = [F.col(confidence).alias("confidence")] if confidence else []
    body = F.struct((F.size("found") == 0).alias("valid"), *parts, lines.alias("mrz"), "fields", F.col("found").alias("issues"), (~broken).alias("composite_ok"), dates.is_expired(expiry, reference_year).alias("expired"))
    return read.withColumn("payload", F.to_json(body)).drop("doc", "found", "fields")
