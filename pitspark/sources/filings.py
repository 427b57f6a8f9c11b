"""Company-facts documents to fundamental records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digest import content_id
from ..functions.reasons import finite, reason_array, require_zero
from ..functions.times import after_local_date

# Accepted forms, filing time zone, labels.
FORMS = ("10-K", "10-Q", "20-F", "40-F")
ZONE = "America/New_York"
SOURCE = "sec-companyfacts"
BASIS = "filing_date_end_america_new_york"

_OBSERVATION = "struct<start: string, `end`: string, val: double, accn: string, fy: int, fp: string, form: string, filed: string, frame: string>"
_FACTS = f"facts struct<`us-gaap`: map<string, struct<units: map<string, array<{_OBSERVATION}>>>>>"


def parse_company_facts(documents: DataFrame, payload: str = "payload", concepts: list[str] | None = None) -> DataFrame:
    """One row per reported observation: concept, unit and observation exploded.

    Other forms and observations without filing date, end or accession are not facts.
    A present but malformed value or date stays and is caught by ``fact_checks``.
    """
    # from_json evaluates its argument interpreted. A payload that is used twice stays a column of a projection below, whose
    # own expressions are compiled; an empty one has no facts either way.
    parsed_payload = F.when(F.length(payload) > 0, F.from_json(payload, _FACTS))
    instrument = F.concat(F.lit("US:"), F.upper("ticker"))
    kept = ["instrument_id"]
    parsed = documents.select(instrument.alias("instrument_id"), parsed_payload.alias("_d"))
    by_concept = parsed.select(*kept, F.explode("_d.facts.us-gaap").alias("metric", "_c"))
    if concepts:
        by_concept = by_concept.filter(F.col("metric").isin(*concepts))
    by_unit = by_concept.select(*kept, "metric", F.explode("_c.units").alias("unit", "_o"))
    rows = by_unit.select(*kept, "metric", "unit", F.explode("_o").alias("o"))
    facts = rows.filter(
        F.col("o.form").isin(*FORMS, *[f"{form}/A" for form in FORMS])
        & (F.coalesce(F.length("o.filed"), F.lit(0)) > 0)
        & (F.coalesce(F.length("o.end"), F.lit(0)) > 0)
        & (F.coalesce(F.length("o.accn"), F.lit(0)) > 0)
    )
    filed = F.col("o.filed").try_cast("date")
    available = after_local_date(filed, ZONE)
    typed = facts.select(
        "instrument_id", "metric",
        F.col("o.start").try_cast("date").alias("period_start"), F.col("o.end").try_cast("date").alias("period_end"),
        F.col("o.val").alias("value"), "unit", F.col("o.form").alias("form"), F.col("o.accn").alias("accession_number"),
        available.alias("filed_at"), available.alias("available_at"), F.lit(SOURCE).alias("source"),
        F.col("o.fy").alias("fiscal_year"), F.col("o.fp").alias("fiscal_period"), F.col("o.frame").alias("frame"),
        F.lit(BASIS).alias("availability_basis"), filed.alias("filed_date"),
        (F.col("o.start").isNotNull() & F.col("o.start").try_cast("date").isNull()).alias("_bad_start"),
    )
    return typed.withColumn("record_id", record_id())


def record_id() -> Column:
    """Identity of one economic fact."""
    return content_id(
        [F.col("source"), F.col("instrument_id"), F.col("metric"), F.col("period_start").cast("string"),
         F.col("period_end").cast("string"), F.col("unit"), F.col("accession_number")]
    )


def fact_checks() -> list:
    return [
        ("value_nonfinite", F.col("value").isNotNull() & ~finite(F.col("value"))),
        ("date_invalid", F.col("period_end").isNull() | F.col("filed_date").isNull() | F.col("_bad_start")),
        ("period_starts_after_it_ends", F.coalesce(F.col("period_start") > F.col("period_end"), F.lit(False))),
        ("filed_before_period_end", F.coalesce(F.col("filed_date") < F.col("period_end"), F.lit(False))),
    ]


def with_reasons(facts: DataFrame) -> DataFrame:
    return facts.withColumn("reasons", reason_array(fact_checks()))


def unique_facts(facts: DataFrame) -> DataFrame:
    """One row per record id; repeated frame metadata does not make two facts."""
    payload = [c for c in facts.columns if c != "record_id"]
    merged = facts.groupBy("record_id").agg(
        F.min(F.struct(*payload)).alias("_f"), *conflict_columns("value")
    )
    return merged.select("record_id", "_f.*", "conflict")


def conflict_columns(value: str) -> list[Column]:
    """``conflict``: the rows of a group disagree on the value (NULL included)."""
    v = F.col(value)
    differs = (F.min(v) != F.max(v)) | ((F.count(v) > 0) & (F.count(v) < F.count(F.lit(1))))
    return [F.coalesce(differs, F.lit(False)).alias("conflict")]


def require_facts(facts: DataFrame) -> DataFrame:
    """Validated, de-duplicated facts; any bad or conflicting one fails the batch."""
    require_zero(facts, dict(fact_checks()))
    merged = unique_facts(facts)
    require_zero(merged, {"conflicting values in one accession": F.col("conflict")})
    return merged.drop("conflict", "filed_date", "_bad_start")
