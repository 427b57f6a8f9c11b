"""Landed bar and quote pages: JSON to typed records with their fetch envelope.

Each page keeps its envelope columns beside the exploded records. The page is parsed
once into raw record texts, each record once into typed fields. The identity used for
exact duplicates is the whole record as canonical JSON (sorted keys, time replaced by
its instant), so fields nobody asked for still take part in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import event_ns

_PAGE = "symbol string, next_page_token string, records array<string>"
# A string or boolean in a numeric field does not parse and becomes NULL. Optional fields are read as variants, so that
# a value of another type is told apart from a field that is not there.
_QUOTE = (
    "t string, bp double, ap double, bs double, `as` double, bx string, ax string, c variant, z string, "
    "symbol string, S string"
)
_BAR = "t string, o double, h double, l double, c double, v double, n variant, vw variant, symbol string, S string"


def _page_records(pages: DataFrame, payload: str, schema: str) -> DataFrame:
    """One row per raw record: envelope columns, ``_raw`` text and typed ``_r``."""
    kept = [c for c in pages.columns if c != payload]
    parsed = pages.select(*kept, F.from_json(payload, _PAGE).alias("_page"))
    # the outer form keeps Spark from parsing the page again for an inferred size filter
    raw = parsed.select(*kept, F.explode_outer("_page.records").alias("_raw")).filter(F.col("_raw").isNotNull())
    typed = raw.select(*kept, "_raw", F.from_json("_raw", schema, {"caseSensitive": "true"}).alias("_r"))
    return typed.withColumn("event_ns", event_ns(F.col("_r.t")))


def record_identity() -> Column:
    """Digest of the whole record with the time replaced by its instant."""
    without_time = F.regexp_replace("_raw", r'"t"\s*:\s*"[^"]*"', '"t":0')
    canonical = F.coalesce(F.to_json(F.try_parse_json(without_time)), F.col("_raw"))
    return F.sha2(F.concat_ws("|", F.col("event_ns").cast("string"), canonical), 256)


def _declared_symbol(columns: list[str]) -> Column:
    """The symbol a record names: the one that differs from the fetch's, if either does."""
    names = [F.col("_r.symbol"), F.col("_r").getField("S")]
    if "symbol" not in columns:
        return F.coalesce(*names)
    wrong = F.coalesce(*[F.when(n != F.col("symbol"), n) for n in names])
    return F.coalesce(wrong, *names)


_NUMBERS = ("BIGINT", "DOUBLE", "FLOAT")


def _is_number(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return kind.isin(*_NUMBERS) | F.startswith(kind, F.lit("DECIMAL"))


def _number(value: Column) -> Column:
    return F.when(_is_number(value), F.try_variant_get(value, "$", "double"))


def _not_a_number(value: Column) -> Column:
    """Present, but no number (a string, a boolean, a null)."""
    return value.isNotNull() & ~F.coalesce(_is_number(value), F.lit(False))


def _conditions(value: Column) -> Column:
    """The list of condition codes; NULL unless every element is a string."""
    items = F.try_variant_get(value, "$", "array<variant>")
    whole = F.forall(items, lambda x: F.schema_of_variant(x) == "STRING")
    return F.when(F.coalesce(whole, F.lit(False)), F.try_variant_get(value, "$", "array<string>"))


def _conditions_shape(value: Column) -> Column:
    return F.when(value.isNull(), "missing").when(_conditions(value).isNotNull(), "list_of_strings").otherwise("malformed")


def parse_quotes(pages: DataFrame, payload: str = "payload") -> DataFrame:
    records = _page_records(pages, payload, _QUOTE)
    kept = [c for c in pages.columns if c != payload]
    return records.select(
        *kept, "event_ns",
        F.col("_r.bp").alias("bid"), F.col("_r.ap").alias("ask"), F.col("_r.bs").alias("bid_size"),
        F.col("_r.as").alias("ask_size"), F.col("_r.bx").alias("bid_exchange"), F.col("_r.ax").alias("ask_exchange"),
        _conditions(F.col("_r.c")).alias("conditions"), F.col("_r.z").alias("tape"), _declared_symbol(kept).alias("record_symbol"),
        _conditions_shape(F.col("_r.c")).alias("conditions_shape"), record_identity().alias("identity"),
    )


def parse_bars(pages: DataFrame, payload: str = "payload") -> DataFrame:
    records = _page_records(pages, payload, _BAR)
    kept = [c for c in pages.columns if c != payload]
    return records.select(
        *kept, "event_ns", *[F.col(f"_r.{c}").alias(c) for c in ("o", "h", "l", "c", "v")],
        *[_number(F.col(f"_r.{c}")).alias(c) for c in ("n", "vw")],
        *[_not_a_number(F.col(f"_r.{c}")).alias(f"{c}_not_a_number") for c in ("n", "vw")],
        _declared_symbol(kept).alias("record_symbol"),
    )


def envelope_summary(pages: DataFrame, by: list[str], payload: str = "payload") -> DataFrame:
    """Pages, records and completeness per fetch: complete when its last page has no next token."""
    parsed = pages.select(*by, F.from_json(payload, _PAGE).alias("_page"))
    return parsed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum(F.coalesce(F.size("_page.records"), F.lit(0))).alias("records"),
        F.bool_or(F.col("_page.next_page_token").isNull()).alias("complete"),
        F.count_if(F.col("_page.records").isNull()).alias("unreadable_pages"),
    )
