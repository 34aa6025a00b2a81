"""Column expressions on SQL and JSON text; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Quoted text (kept), comments and white space (dropped). Possessive groups keep
#: the matcher iterative, so long literals do not exhaust the stack.
_SQL_NOISE = (
    r"('(?:[^'\\]|\\.)*+(?:'|\z)|\"(?:[^\"\\]|\\.)*+(?:\"|\z)|`[^`]*+(?:`|\z))"
    r"|--[^\n\r]*+|/\*[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/|\z)|\s+"
)


def sql_core(code: Column | str) -> Column:
    """SQL text without comments and white space outside quoted text; null stays null."""
    return F.regexp_replace(F.col(code) if isinstance(code, str) else code, "(?s)" + _SQL_NOISE, "$1")


def keep_last_duplicate_keys(spark: SparkSession) -> None:
    """JSON objects with a repeated key are valid texts; the last value counts."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def strict_variant(text: str) -> Column:
    """Variant of a column that holds exactly one valid JSON text, else null.

    The parser stops after the first value, so trailing text is found by parsing
    the text inside an array and inside an object: no text closes both early.
    """
    wrapped = f"try_parse_json(concat('[', {text}, ']'))"
    closed = f"try_parse_json(concat('{{\"v\":', {text}, '}}'))"
    return F.expr(f"CASE WHEN {closed} IS NOT NULL THEN try_variant_get({wrapped}, '$[0]', 'variant') END")


def json_core(text: str) -> Column:
    """Canonical text of a JSON value: keys sorted, escapes and white space gone.

    Numbers equal in value get one form (``1``, ``1.0``, ``1e0``); texts that are
    not JSON stand for themselves, marked so that they equal no JSON value.
    """
    plain = F.regexp_replace(
        F.to_json(strict_variant(text)), r'("(?:[^"\\]|\\.)*+")|(?<=\d)\.0(?![0-9E])', "$1"
    )
    return F.coalesce(plain, F.concat(F.lit("!"), F.col(text)))


def blank_to_zero(text: str, kind: str) -> Column:
    """Number printed as text in any notation; null, blank and unreadable count as 0."""
    return F.coalesce(F.expr(f"try_cast(trim(`{text}`) AS {kind})"), F.lit(0).cast(kind))
