"""Evidence snapshots: five sections known strictly before a cutoff.

Sections work for all instruments at once; ``row`` numbers follow the section
order, so a limit of N reads N+1 rows per section and reports truncation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.digest import canonical_json, canonical_number, combine_words, kind_id, word_sums
from ..functions.reasons import ValidationError, finite, ohlc_checks, reason_array, require_zero
from ..functions.times import utc_text
from .cutoffs import known_strict, latest_version
from .warehouse import observed_daily

# Fields of an evidence record per section.
FIELDS = {
    "identity": [
        "instrument_id", "symbol", "asset_class", "primary_exchange", "valid_from", "valid_to", "available_at",
        "ingested_at", "source",
    ],
    "market": [
        "instrument_id", "event_time", "interval", "open", "high", "low", "close", "volume", "available_at",
        "ingested_at", "source", "data_version",
    ],
    "fundamentals": [
        "record_id", "instrument_id", "metric", "period_start", "period_end", "value", "unit", "form",
        "accession_number", "filed_at", "available_at", "ingested_at", "source", "fiscal_year", "fiscal_period",
        "frame", "availability_basis",
    ],
    "macro": [
        "series_id", "observation_date", "value", "vintage_date", "available_at", "ingested_at", "source",
        "availability_basis",
    ],
    "news": [
        "event_id", "published_at", "first_seen_at", "available_at", "ingested_at", "source", "title_hash",
        "entity_ids", "quality_flags",
    ],
}
ENTITY_OF = {
    "identity": "instrument_id", "market": "instrument_id", "fundamentals": "instrument_id", "macro": "series_id",
    "news": "entity",
}


def identity_section(instruments: DataFrame, cutoff: Column, mode: str = "local_observed") -> DataFrame:
    """Assertions known and effective at the cutoff (half-open validity)."""
    effective = (F.col("valid_from") <= cutoff) & (F.col("valid_to").isNull() | (F.col("valid_to") > cutoff))
    return instruments.filter(known_strict(cutoff, mode) & effective)


def market_section(bars: DataFrame, cutoff: Column, mode: str = "local_observed") -> DataFrame:
    """Latest known version of each completed daily bar."""
    complete = F.timestamp_add("DAY", F.lit(1), F.col("event_time")) <= cutoff
    known = observed_daily(bars).filter(known_strict(cutoff, mode) & complete)
    return latest_version(
        known, ["instrument_id", "event_time", "interval", "source"],
        [F.desc("available_at"), F.desc("ingested_at"), F.desc("data_version")],
    )


def fundamentals_section(facts: DataFrame, cutoff: Column, mode: str = "local_observed") -> DataFrame:
    known = facts.filter(
        known_strict(cutoff, mode) & (F.col("filed_at") < cutoff) & (F.col("period_end") <= F.to_date(cutoff))
    )
    return latest_version(
        known, ["instrument_id", "metric", "period_start", "period_end", "unit", "source"],
        [
            F.desc("filed_at"), F.desc_nulls_last("accession_number"), F.desc("available_at"), F.desc("ingested_at"),
            F.desc("record_id"),
        ],
    )


def macro_section(macro: DataFrame, cutoff: Column, series: list[str] | None = None, mode: str = "local_observed"):
    wanted = macro if series is None else macro.filter(F.col("series_id").isin(*series))
    day = F.to_date(cutoff)
    known = wanted.filter(
        known_strict(cutoff, mode) & (F.col("observation_date") <= day) & (F.col("vintage_date") <= day)
    )
    return latest_version(
        known, ["series_id", "observation_date", "source"],
        [F.desc("vintage_date"), F.desc("available_at"), F.desc("ingested_at")],
    )


def entities_malformed(column: str = "entity_ids") -> Column:
    """TRUE unless the text is a JSON array whose every element is a string."""
    items = f"try_variant_get(try_parse_json({column}), '$', 'array<variant>')"
    return ~F.coalesce(F.expr(f"forall({items}, x -> schema_of_variant(x) = 'STRING')"), F.lit(False))


def flags_malformed(column: str = "quality_flags") -> Column:
    """TRUE unless the text is a JSON object."""
    kind = F.schema_of_variant(F.try_parse_json(F.col(column)))
    return ~F.coalesce(F.startswith(kind, F.lit("OBJECT")), F.lit(False))


def time_eligible_news(news: DataFrame, cutoff: Column, mode: str = "local_observed") -> DataFrame:
    return news.filter(
        known_strict(cutoff, mode) & (F.col("published_at") < cutoff) & (F.col("first_seen_at") < cutoff)
    )


def require_wellformed_entities(eligible: DataFrame) -> DataFrame:
    """Fail when an eligible row cannot prove whether it mentions an entity, or its flags are no object."""
    return require_zero(eligible, {"malformed news entities": entities_malformed(), "malformed news flags": flags_malformed()})


def news_section(news: DataFrame, cutoff: Column, entity: str | None = None, mode: str = "local_observed"):
    """Eligible rows per mentioned entity: exact, case-sensitive array membership."""
    eligible = time_eligible_news(news, cutoff, mode)
    names = F.from_json("entity_ids", "array<string>")
    if entity is not None:
        return eligible.filter(F.array_contains(names, entity)).withColumn("entity", F.lit(entity))
    return eligible.withColumn("entity", F.explode(F.array_distinct(names)))


SECTION_ORDER = {
    "identity": lambda: [F.desc("valid_from"), F.asc("source"), F.desc("available_at"), F.desc("ingested_at")],
    "market": lambda: [F.desc("event_time"), F.asc("source"), F.desc("data_version")],
    "fundamentals": lambda: [
        F.desc("period_end"), F.desc_nulls_last("period_start"), F.asc("metric"), F.asc_nulls_last("unit"),
        F.asc("source"), F.desc("record_id"),
    ],
    "macro": lambda: [F.desc("observation_date"), F.asc("source"), F.desc("vintage_date")],
    "news": lambda: [F.desc("published_at"), F.desc("available_at"), F.desc("ingested_at"), F.asc("event_id")],
}


def limited(section: DataFrame, kind: str, max_records: int) -> DataFrame:
    """Adds ``row`` and keeps N+1 rows per entity; row N+1 is the truncation sentinel."""
    window = W.partitionBy(ENTITY_OF[kind]).orderBy(*SECTION_ORDER[kind]())
    return section.withColumn("row", F.row_number().over(window)).filter(F.col("row") <= max_records + 1)


def section_summary(
    entities: DataFrame, section: DataFrame, kind: str, cutoff: Column, max_records: int, requested: bool = True
) -> DataFrame:
    """Status, count, truncation, age and warning count per requested entity; empty ones stay.

    ``section`` comes from ``limited``. Status is MISSING without rows, PARTIAL with
    any warning, else AVAILABLE; an unrequested section is NOT_REQUESTED.
    """
    entity = ENTITY_OF[kind]
    within = F.col("row") <= max_records
    null_value = F.col("value").isNull() if "value" in section.columns else F.lit(False)
    stats = section.groupBy(entity).agg(
        F.count_if(within).alias("count"),
        (F.max("row") > max_records).alias("truncated"),
        F.max(F.when(within, F.col("available_at"))).alias("latest_available_at"),
        F.coalesce(F.max(F.when(within, null_value.cast("int"))), F.lit(0)).alias("_nulls"),
        F.count(F.lit(1)).alias("_all"),
    )
    joined = entities.select(entity).distinct().join(stats, entity, "left")
    count = F.coalesce(F.col("count"), F.lit(0))
    warnings = (
        F.coalesce(F.col("truncated"), F.lit(False)).cast("int")
        + (count == 0).cast("int")
        + F.coalesce(F.col("_nulls"), F.lit(0))
        + (F.lit(kind == "news") & (count > 0)).cast("int")
        + (F.lit(kind == "identity") & (F.coalesce(F.col("_all"), F.lit(0)) > 1)).cast("int")
    )
    if not requested:
        status, count, warnings = F.lit("NOT_REQUESTED"), F.lit(0).cast("bigint"), F.lit(1)
    else:
        status = F.when(count == 0, "MISSING").when(warnings > 0, "PARTIAL").otherwise("AVAILABLE")
    latest = F.col("latest_available_at")
    return joined.select(
        F.lit(kind).alias("section"),
        F.col(entity).alias("entity"),
        status.alias("status"),
        count.alias("count"),
        F.coalesce(F.col("truncated"), F.lit(False)).alias("truncated"),
        latest.alias("latest_available_at"),
        ((F.unix_micros(cutoff) - F.unix_micros(latest)) / 1e6).alias("availability_age_seconds"),
        warnings.cast("bigint").alias("warnings"),
    )


def row_checks(kind: str, cutoff: Column, mode: str = "local_observed") -> list:
    """Reason codes of a record that must not be in a section, whatever produced it."""
    day = F.to_date(cutoff)
    checks = [("not_strictly_available", ~known_strict(cutoff, mode)), ("source_missing", F.col("source").isNull() | (F.col("source") == ""))]
    if kind == "identity":
        checks.append(
            ("not_effective", (F.col("valid_from") > cutoff) | F.coalesce(F.col("valid_to") <= cutoff, F.lit(False)))
        )
    elif kind == "market":
        end = F.timestamp_add("DAY", F.lit(1), F.col("event_time"))
        observed = (F.col("source") == "yahoo") & (F.col("interval") == "1d") & F.col("data_version").startswith("snapshot-v2:")
        checks += [
            ("not_observed_daily_snapshot", ~observed),
            ("incomplete_or_premature_bar", (end > cutoff) | (end > F.col("available_at"))),
            *ohlc_checks(0.0),
        ]
    elif kind in ("fundamentals", "macro"):
        checks.append(("value_nonfinite", F.col("value").isNotNull() & ~finite(F.col("value"))))
        if kind == "fundamentals":
            checks += [
                ("available_before_filed", F.col("filed_at") > F.col("available_at")),
                ("period_invalid", (F.col("period_end") > day) | F.coalesce(F.col("period_start") > F.col("period_end"), F.lit(False))),
            ]
        else:
            checks += [
                ("future_observation_or_vintage", F.greatest("observation_date", "vintage_date") > day),
                ("available_before_vintage", F.col("vintage_date") > F.to_date("available_at")),
            ]
    elif kind == "news":
        checks += [
            ("entities_malformed", entities_malformed()),
            ("flags_malformed", flags_malformed()),
            ("title_hash_invalid", ~F.col("title_hash").rlike("^[a-fA-F0-9]{64}$")),
            ("available_before_seen", F.greatest("published_at", "first_seen_at") > F.col("available_at")),
        ]
    return checks


def validated(section: DataFrame, kind: str, cutoff: Column, mode: str = "local_observed") -> DataFrame:
    return section.withColumn("reasons", reason_array(row_checks(kind, cutoff, mode)))


def require_valid_rows(section: DataFrame, kind: str, cutoff: Column, mode: str = "local_observed") -> DataFrame:
    return require_zero(section, dict(row_checks(kind, cutoff, mode)))


def normalised(section: DataFrame, kind: str) -> list[Column]:
    """Stored values as canonical JSON scalars: instants become UTC microsecond text, doubles their shortest decimal."""
    types = dict(section.dtypes)
    forms = {"timestamp": utc_text, "double": canonical_number}
    return [forms.get(types[c], lambda x: x)(F.col(c)).alias(c) for c in FIELDS[kind] if c in types]


def normalisation_violations(section: DataFrame) -> dict[str, Column]:
    """Non-finite doubles may not be stored in a packet."""
    return {
        name: F.col(name).isNotNull() & ~finite(F.col(name)) for name, kind in section.dtypes if kind == "double"
    }


def with_evidence_id(section: DataFrame, kind: str) -> DataFrame:
    return section.withColumn("evidence_id", kind_id(kind, normalised(section, kind)))


def packet_records(sections: dict[str, DataFrame]) -> DataFrame:
    """One long table (section, entity, evidence_id, available_at) for a whole packet."""
    result = None
    for kind, df in sections.items():
        rows = with_evidence_id(df, kind).select(
            F.lit(kind).alias("section"), F.col(ENTITY_OF[kind]).alias("entity"), "evidence_id", "available_at"
        )
        result = rows if result is None else result.unionByName(rows)
    return result


def snapshot_hash(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Order-free digest of all evidence ids, optionally per section or entity."""
    keyed = records.withColumn("_h", F.sha2(F.concat_ws(":", "section", "entity", "evidence_id"), 256))
    grouped = keyed.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("rows"), *word_sums(F.col("_h")))
    return grouped.select(*(by or []), "rows", combine_words().alias("snapshot_hash"))


# ---- packets ----------------------------------------------------------------

SECTION_FIELDS = ["section", "entity", "status", "count", "truncated", "latest_us", "warnings", "snapshot_hash"]


@dataclass(frozen=True)
class Packet:
    """An archived snapshot: records with their ids per kind, one row per (section, entity), and one row with the hash."""

    records: dict[str, DataFrame]
    sections: DataFrame
    hash: DataFrame


def packet_hash(sections: DataFrame, request: str) -> DataFrame:
    """One row: digest over the request text and all section rows, in any order of rows."""
    row = F.sha2(canonical_json(SECTION_FIELDS), 256)
    whole = sections.withColumn("_h", row).agg(F.count(F.lit(1)).alias("rows"), *word_sums(F.col("_h")))
    return whole.select(F.sha2(F.concat_ws(":", F.sha2(F.lit(request), 256), combine_words()), 256).alias("packet_hash"))


def build_packet(
    asked: dict[str, DataFrame], sections: dict[str, DataFrame], cutoff: Column, limits: dict[str, int], request: str
) -> Packet:
    """Records within their limits, section rows for every requested entity, and the packet's hash.

    ``asked`` and ``sections`` hold the requested entities and the section rows per kind.
    """
    records, rows = {}, None
    for kind, section in sections.items():
        held = limited(section, kind, limits[kind])
        summary = section_summary(asked[kind], held, kind, cutoff, limits[kind])
        records[kind] = with_evidence_id(held.filter(F.col("row") <= limits[kind]).drop("row"), kind)
        rows = summary if rows is None else rows.unionByName(summary)
    stamped = rows.withColumn("latest_us", F.unix_micros("latest_available_at"))
    joined = stamped.join(_record_hashes(records).drop("rows"), ["section", "entity"], "left")
    table = joined.select(*SECTION_FIELDS)
    return Packet(records, table, packet_hash(table, request))


def _record_hashes(records: dict[str, DataFrame]) -> DataFrame:
    result = None
    for kind, df in records.items():
        rows = df.select(F.lit(kind).alias("section"), F.col(ENTITY_OF[kind]).alias("entity"), "evidence_id")
        result = rows if result is None else result.unionByName(rows)
    return snapshot_hash(result, ["section", "entity"])


def packet_violations(packet: Packet, cutoff: Column, limits: dict[str, int], request: str, mode: str = "local_observed") -> DataFrame:
    """(section, entity, reason, rows) of everything in an archived packet that does not follow from its records.

    Records: ids that do not recompute, repeated ids, rows that may not be in the section. Sections: counts, latest
    availability, status, warnings, truncation and digests against the records. The packet's hash against the request and
    the section rows as they are. No row: the packet is intact, whatever today's tables hold.
    """
    found, states = None, None
    for kind, df in packet.records.items():
        entity = F.col(ENTITY_OF[kind])
        bare = df.drop("evidence_id")
        fresh = kind_id(kind, normalised(bare, kind))
        repeat = F.count(F.lit(1)).over(W.partitionBy("evidence_id")) > 1  # as many rows as copies of one record
        reasons = F.concat(
            reason_array([("record_hash_mismatch", ~F.col("evidence_id").eqNullSafe(fresh)), ("duplicate_record", F.col("_repeat"))]),
            reason_array(row_checks(kind, cutoff, mode)),
        )
        tagged = df.withColumn("_repeat", repeat).select(F.lit(kind).alias("section"), entity.alias("entity"), F.explode(reasons).alias("reason"))
        found = tagged if found is None else found.unionByName(tagged)
        empty = F.coalesce(F.max(F.col("value").isNull().cast("int")), F.lit(0)) if "value" in df.columns else F.lit(0)
        state = df.groupBy(F.lit(kind).alias("section"), entity.alias("entity")).agg(
            F.count(F.lit(1)).alias("_count"), F.unix_micros(F.max("available_at")).alias("_latest"), empty.cast("bigint").alias("_nulls")
        )
        states = state if states is None else states.unionByName(state)
    states = states.join(_record_hashes(packet.records).select("section", "entity", F.col("snapshot_hash").alias("_hash")), ["section", "entity"])
    joined = packet.sections.join(states, ["section", "entity"], "full")
    count, truncated = F.coalesce("_count", F.lit(0)), F.coalesce("truncated", F.lit(False))
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]), F.col("section"))
    several = (F.col("section") == "identity") & ((count > 1) | truncated)
    flags = [truncated, count == 0, (F.col("section") == "news") & (count > 0), several]
    warnings = sum((f.cast("bigint") for f in flags), F.coalesce("_nulls", F.lit(0).cast("bigint")))
    status = F.when(count == 0, "MISSING").when(warnings > 0, "PARTIAL").otherwise("AVAILABLE")
    checks = [
        ("section_missing", F.col("status").isNull()),
        ("count_mismatch", F.col("count") != count),
        ("count_over_limit", count > limit),
        ("truncation_inconsistent", truncated & (F.col("count") != limit)),
        ("latest_mismatch", ~F.col("latest_us").eqNullSafe(F.col("_latest"))),
        ("status_inconsistent", F.col("status") != status),
        ("warnings_inconsistent", F.col("warnings") != warnings),
        ("snapshot_hash_mismatch", ~F.col("snapshot_hash").eqNullSafe(F.col("_hash"))),
    ]
    of_sections = joined.select("section", "entity", F.explode(reason_array([(name, F.coalesce(test, F.lit(False))) for name, test in checks])).alias("reason"))
    rebuilt = packet_hash(packet.sections, request).withColumnRenamed("packet_hash", "_fresh")
    of_packet = packet.hash.crossJoin(rebuilt).filter("NOT (packet_hash <=> _fresh)").select(  # one row each
        F.lit("packet").alias("section"), F.lit(None).cast("string").alias("entity"), F.lit("packet_hash_mismatch").alias("reason")
    )
    return found.unionByName(of_sections).unionByName(of_packet).groupBy("section", "entity", "reason").agg(F.count(F.lit(1)).alias("rows"))


def require_intact(packet: Packet, cutoff: Column, limits: dict[str, int], request: str, mode: str = "local_observed") -> Packet:
    violations = packet_violations(packet, cutoff, limits, request, mode).limit(5).collect()
    if violations:
        raise ValidationError(f"evidence packet is not intact: {[tuple(v) for v in violations]}")
    return packet


def packet_mismatches(archived: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """(section, entity, evidence_id) whose multiplicity differs between archive and rebuild."""
    keys = ["section", "entity", "evidence_id"]
    left = archived.groupBy(*keys).agg(F.count(F.lit(1)).alias("archived"))
    right = rebuilt.groupBy(*keys).agg(F.count(F.lit(1)).alias("rebuilt"))
    return left.join(right, keys, "full").na.fill(0, ["archived", "rebuilt"]).filter(
        (F.col("archived") != F.col("rebuilt")) | (F.col("archived") > 1)
    )


def source_coverage(section: DataFrame, kind: str) -> DataFrame:
    """Rows, latest availability and latest event or observation per entity."""
    event = {"identity": "valid_from", "market": "event_time", "macro": "observation_date",
             "fundamentals": "period_end", "news": "published_at"}[kind]
    return section.groupBy(F.col(ENTITY_OF[kind]).alias("entity")).agg(
        F.lit(kind).alias("section"), F.count(F.lit(1)).alias("count"),
        F.max("available_at").alias("latest_available_at"),
        F.max(F.col(event).cast("timestamp")).alias("latest_event"),
    )
