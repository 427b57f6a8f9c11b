"""Create-only sinks, a manifest that is written last and checked before reading, and batches that appear at once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.digest import canonical_json, dataset_digest
from ..functions.reasons import ValidationError

MANIFEST = "_manifest"


def _row_digest(df: DataFrame):
    return F.sha2(canonical_json(sorted(df.columns)), 256)


def write_new(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, **options) -> None:
    """Publish to a path that must not exist yet."""
    writer = df.write.mode("errorifexists").format(fmt).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def publish(parts: dict[str, DataFrame], root: str) -> DataFrame:
    """Write every part, then the manifest with its row counts and content digests.

    Digests are computed from what was written, so a reader checks the stored rows.
    Without a manifest the publication does not exist.
    """
    spark = next(iter(parts.values())).sparkSession
    manifest = None
    for name, df in parts.items():
        write_new(df, f"{root}/{name}")
        stored = spark.read.parquet(f"{root}/{name}")
        entry = dataset_digest(stored, _row_digest(stored)).select(F.lit(name).alias("part"), "rows", "digest")
        manifest = entry if manifest is None else manifest.unionByName(entry)
    write_new(manifest.coalesce(1), f"{root}/{MANIFEST}")
    return spark.read.parquet(f"{root}/{MANIFEST}")


def verify(spark: SparkSession, root: str) -> DataFrame:
    """Manifest entries with ``matches``: row count and digest recomputed from the stored rows."""
    manifest = spark.read.parquet(f"{root}/{MANIFEST}")
    checks = None
    for row in manifest.collect():  # one row per part
        stored = spark.read.parquet(f"{root}/{row['part']}")
        found = dataset_digest(stored, _row_digest(stored)).select(
            F.lit(row["part"]).alias("part"), F.col("rows").alias("found_rows"), F.col("digest").alias("found_digest")
        )
        checks = found if checks is None else checks.unionByName(found)
    same = (F.col("rows") == F.col("found_rows")) & (F.col("digest") == F.col("found_digest"))
    return manifest.join(checks, "part", "left").withColumn("matches", F.coalesce(same, F.lit(False)))


def read_verified(spark: SparkSession, root: str, part: str) -> DataFrame:
    """A part of a publication, after every part matched its manifest."""
    bad = [r["part"] for r in verify(spark, root).filter(~F.col("matches")).select("part").collect()]
    if bad:
        raise ValidationError(f"artifacts differ from the manifest: {bad}")
    return spark.read.parquet(f"{root}/{part}")


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Out-of-sample predictions as CSV with a header."""
    write_new(predictions, path, "csv", header=True)


# ---- batches ----------------------------------------------------------------


def publish_batch(parts: dict[str, DataFrame], root: str, request: str) -> int:
    """All parts of a batch and its audit rows become readable together, or not at all; the new version's number.

    Every part is a partition of one write job in a folder of its own. What was written is counted and digested, and one
    small append names the folder: until it commits, readers see the version before, and a job that was killed leaves
    nothing that a later batch could meet. There is one writer at a time; a second one that took the same number raises.
    """
    spark = next(iter(parts.values())).sparkSession
    folder, rows = f"{root}/data/{uuid.uuid4().hex}", None
    for name, df in parts.items():
        boxed = df.select(F.lit(name).alias("part"), F.struct(*df.columns).alias(name))
        rows = boxed if rows is None else rows.unionByName(boxed, allowMissingColumns=True)
    write_new(rows, folder, partition_by=["part"])
    stored = spark.read.schema(rows.schema).parquet(folder)
    audit = None
    for name, df in parts.items():
        written = stored.where(F.col("part") == name).select(f"{name}.*")
        entry = dataset_digest(written, _row_digest(df)).select(F.lit(name).alias("part"), "rows", "digest")
        audit = entry if audit is None else audit.unionByName(entry)
    version = (_newest(spark, root) or 0) + 1
    pointer = audit.select(F.lit(version).alias("version"), F.lit(folder).alias("folder"), F.lit(request).alias("request"), "part", "rows", "digest")
    pointer.coalesce(1).write.mode("append").parquet(f"{root}/versions")
    named = pointers(spark, root).where(F.col("version") == version).select("folder").distinct().count()
    if named > 1:
        raise ValidationError(f"another writer published version {version}")
    return version


POINTERS = "version int, folder string, request string, part string, rows bigint, digest string"


def pointers(spark: SparkSession, root: str) -> DataFrame:
    """Audit rows of all published versions: request, and per part the rows and content digest."""
    spark.createDataFrame([], POINTERS).write.mode("append").parquet(f"{root}/versions")  # an empty table where there is none
    return spark.read.schema(POINTERS).parquet(f"{root}/versions")


def _newest(spark: SparkSession, root: str) -> int | None:
    return pointers(spark, root).agg(F.max("version")).first()[0]


def read_batch(spark: SparkSession, root: str, part: str, schema: T.StructType, version: int | None = None) -> DataFrame:
    """One part of the newest (or given) version, with ``schema`` as its columns."""
    wanted = version or _newest(spark, root)
    row = pointers(spark, root).where((F.col("version") == F.lit(wanted)) & (F.col("part") == part)).first()
    if row is None:
        raise ValidationError(f"no published {part} in {root}")
    boxed = T.StructType([T.StructField(part, schema), T.StructField("part", T.StringType())])
    return spark.read.schema(boxed).parquet(row.folder).where(F.col("part") == part).select(f"{part}.*")
