"""Identity resolution: descriptors are grouped, never merged or invented."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digest import content_id
from ..functions.reasons import require_unique, require_zero
from .cutoffs import known_strict

ATTRIBUTES = ["source", "instrument_id", "symbol", "asset_class", "primary_exchange"]
ROW_FIELDS = [
    "instrument_id", "symbol", "asset_class", "primary_exchange", "valid_from", "valid_to", "available_at",
    "ingested_at", "source",
]
RESOLVED = ("SINGLE_ASSERTION", "EQUIVALENT_ASSERTIONS")


def assertion_checks(cutoff: Column, mode: str = "local_observed") -> dict[str, Column]:
    empty = F.lit(False)
    checks = {f"{c}_missing": F.col(c).isNull() | (F.col(c) == "") for c in ("instrument_id", "symbol", "asset_class", "source")}
    checks["exchange_empty"] = F.coalesce(F.col("primary_exchange") == "", empty)
    checks["not_strictly_known"] = ~known_strict(cutoff, mode)
    checks["interval_empty"] = F.coalesce(F.col("valid_to") <= F.col("valid_from"), empty)
    checks["not_effective"] = (F.col("valid_from") > cutoff) | F.coalesce(F.col("valid_to") <= cutoff, empty)
    return checks


def require_assertions(rows: DataFrame, cutoff: Column, mode: str = "local_observed", record: tuple[str, ...] = ()) -> DataFrame:
    """Valid assertions, none delivered twice.

    ``record`` names the source's record key where it has one: different records may then assert the same.
    """
    require_zero(rows, assertion_checks(cutoff, mode))
    require_unique(rows.select(content_id([*record, *ROW_FIELDS]).alias("assertion_id")), ["assertion_id"], "identity assertion")
    return rows


def resolve(rows: DataFrame, instruments: DataFrame, incomplete: DataFrame | None = None) -> DataFrame:
    """Status per requested instrument: TRUNCATED, MISSING, AMBIGUOUS, SINGLE or EQUIVALENT.

    Assertions are first counted per descriptor (combined before the shuffle), so a
    heavily asserted instrument never gathers its assertions in one place.
    ``incomplete`` lists instruments whose assertion set was cut off.
    """
    per_descriptor = rows.groupBy(*ATTRIBUTES).agg(F.count(F.lit(1)).alias("_n"))
    descriptor = F.struct(*ATTRIBUTES)
    grouped = per_descriptor.groupBy("instrument_id").agg(
        F.sum("_n").alias("assertion_count"), F.count(F.lit(1)).alias("group_count"), F.min(descriptor).alias("_first")
    )
    asked = instruments.select("instrument_id").distinct()
    joined = asked.join(grouped, "instrument_id", "left")
    cut = F.lit(False)
    if incomplete is not None:
        flags = incomplete.select("instrument_id").distinct().withColumn("_cut", F.lit(True))
        joined = joined.join(flags, "instrument_id", "left")
        cut = F.coalesce(F.col("_cut"), F.lit(False))
    count = F.coalesce(F.col("assertion_count"), F.lit(0))
    groups = F.coalesce(F.col("group_count"), F.lit(0))
    status = (
        F.when(cut, "TRUNCATED").when(count == 0, "MISSING").when(groups > 1, "AMBIGUOUS")
        .when(count == 1, "SINGLE_ASSERTION").otherwise("EQUIVALENT_ASSERTIONS")
    )
    out = joined.select(
        "instrument_id", status.alias("status"), count.alias("assertion_count"), groups.alias("group_count"), "_first"
    )
    return out.withColumn(
        "resolved", F.when(F.col("status").isin(*RESOLVED), F.col("_first"))
    ).drop("_first")


def resolution_mismatches(archived: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Instruments whose archived resolution differs from one rebuilt from raw assertions."""
    columns = ["status", "assertion_count", "group_count", "resolved"]
    left = archived.select("instrument_id", F.struct(*columns).alias("_a"))
    right = rebuilt.select("instrument_id", F.struct(*columns).alias("_b"))
    return left.join(right, "instrument_id", "full").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("instrument_id")


def binding(current: DataFrame, catalog: DataFrame, catalog_generated_at: Column, cutoff: Column) -> DataFrame:
    """Whether current and catalogued identity agree, in gate order."""
    left = current.select("instrument_id", F.col("status").alias("current_status"), F.col("resolved").alias("_cur"))
    right = catalog.select("instrument_id", F.col("status").alias("catalog_status"), F.col("resolved").alias("_cat"))
    joined = left.join(right, "instrument_id", "left")
    supported = (
        (F.col("_cur.source") == "yahoo") & (F.col("_cur.asset_class") == "equity")
        & (F.col("_cur.instrument_id") == F.concat(F.lit("YF:"), F.col("_cur.symbol")))
    )
    status = (
        F.when(catalog_generated_at >= cutoff, "CATALOG_UNAVAILABLE_AT_CUTOFF")
        .when(~F.col("current_status").isin(*RESOLVED), "CURRENT_IDENTITY_UNRESOLVED")
        .when(~F.coalesce(F.col("catalog_status"), F.lit("MISSING")).isin(*RESOLVED), "CATALOG_IDENTITY_UNRESOLVED")
        .when(~F.col("_cur").eqNullSafe(F.col("_cat")), "SOURCE_DESCRIPTION_MISMATCH")
        .when(supported, "MATCHED_SOURCE_DESCRIPTION")
        .otherwise("UNSUPPORTED_SOURCE_OR_ASSET")
    )
    return joined.select("instrument_id", "current_status", "catalog_status", status.alias("binding_status"))


def mask_market(features: DataFrame, bindings: DataFrame) -> DataFrame:
    """Market features of an unbound instrument become IDENTITY_BLOCKED; ``unmasked_status`` keeps theirs."""
    joined = features.join(bindings.select("instrument_id", "binding_status"), "instrument_id", "left")
    blocked = F.col("feature").startswith("market.") & ~F.coalesce(
        F.col("binding_status") == "MATCHED_SOURCE_DESCRIPTION", F.lit(False)
    )
    return joined.withColumns(
        {
            "unmasked_status": F.col("status"),
            "status": F.when(blocked, "IDENTITY_BLOCKED").otherwise(F.col("status")),
            "value": F.when(~blocked, F.col("value")),
        }
    ).drop("binding_status")
