"""JSON text as column expressions: types and canonical text of VARIANT values, quoting, truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_type(v: Column) -> Column:
    """The type label of a VARIANT."""
    s = F.schema_of_variant(v)
    wide = F.when(s.startswith("DECIMAL"), F.expr("false"))
    big = F.try_variant_get(v, "$", "decimal(38,0)").between(F.lit("9223372036854775808").cast("decimal(38,0)"), F.lit("18446744073709551615").cast("decimal(38,0)"))
    u64 = s.isin("DECIMAL(19,0)", "DECIMAL(20,0)") & F.coalesce(big, wide, F.lit(False))
    return (
        F.when(s == "VOID", "null")
        .when(s == "BOOLEAN", "boolean")
        .when((s == "BIGINT") | u64, "integer")
        .when(s == "STRING", "string")
        .when(s.startswith("ARRAY<"), "array")
        .when(s.startswith("OBJECT<"), "object")
        .otherwise("number")
    )


def number_text(d: Column) -> Column:
    """Shortest decimal text of a double: positional between 1e-5 and 1e16, else like ``1.5e20``."""
    size = F.abs(d)
    fixed = F.rtrim(d.cast("decimal(38,22)").cast("string"), F.lit("0"))
    fixed = F.when(fixed.endswith("."), F.concat(fixed, F.lit("0"))).otherwise(fixed)
    power = F.regexp_replace(F.regexp_replace(d.cast("string"), r"\.0E", "e"), "E", "e")
    return F.when(d == 0, "0.0").when((size >= 1e16) | (size < 1e-5), power).otherwise(fixed)


def value_text(v: Column, kind: Column) -> Column:
    """The raw string of strings, canonical JSON text of all else."""
    return (
        F.when(kind == "string", F.try_variant_get(v, "$", "string"))
        .when(kind == "number", number_text(F.try_variant_get(v, "$", "double")))
        .when(kind == "null", "null")
        .otherwise(F.to_json(v))
    )


def quote(text: Column) -> Column:
    """A JSON string literal with lower-case escapes."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    full = out
    short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    for code in range(32):
        full = F.replace(full, F.lit(chr(code)), F.lit(short.get(code, f"\\u{code:04x}")))
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x1f]"), full).otherwise(out), F.lit('"'))


def truncate_utf8(text: Column, limit: int) -> Column:
    """At most ``limit`` bytes of ``text``, cut between characters."""
    raw = F.encode(text, "UTF-8")
    cuts = [F.try_validate_utf8(F.substring(raw, 1, max(limit - k, 0)).cast("string")) for k in range(4)]
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.coalesce(*cuts, F.lit("")))


def truncated(text: Column, limit: int) -> Column:
    return (F.octet_length(text) > limit).cast("int")
