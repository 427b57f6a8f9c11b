"""Operator 3: URL rules and, where no rule fits, a logistic regression on hashed character n-grams.

All steps are DataFrame expressions and Spark ML stages; the model is fitted on a small labelled table of URLs.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK, ALLOW = "block", "allow"
# (verdict, host and path of the rule)
RULES = ((BLOCK, "com/en/"), (ALLOW, "example.com/en/7"), (ALLOW, "net/de/"), (BLOCK, "example.net/de/8"), (BLOCK, "org/es/"))
N_GRAM = 3
FEATURES = 1 << 12
TRAINING_ROWS = 4000  # bound of the labelled table when it is drawn from URLs that a rule decides


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add host (A-Z lower-cased, after the first ``://``) and path; both empty for a null or a URL without ``://``."""
    pattern = r"(?s)://([^/?#]*)([^?#]*)"
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(text, pattern, 1), string.ascii_uppercase, string.ascii_lowercase)
    return df.withColumns({"host": host, "path": F.regexp_extract(text, pattern, 2)})


def _split(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.lower(), slash + path


def rule_of(rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits (host, path), as a struct of rule and verdict, else null.

    Rules are a short list that is part of the query. Of rules of one length the one with the longer host wins.
    """
    ranked = sorted(rules, key=lambda r: (len(r[1]), len(_split(r[1])[0])), reverse=True)
    out = None
    for verdict, rule in ranked:
        host, path = _split(rule)
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        found = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    if out is None:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    return out


def _n_grams(text: Column, mark: str) -> Column:
    marked = F.concat(F.lit("^"), text, F.lit("$"))
    last = F.greatest(F.char_length(marked) - N_GRAM + 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.concat(F.lit(mark), F.substring(marked, i, F.lit(N_GRAM))))


def with_features(df: DataFrame) -> DataFrame:
    """Add ``features``: hashed n-grams of host and path, told apart by a mark."""
    terms = df.withColumn("_terms", F.concat(_n_grams(F.col("host"), "h"), _n_grams(F.col("path"), "p")))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="_terms", outputCol="features").transform(terms).drop("_terms")


def fit(labelled: DataFrame) -> PipelineModel | None:
    """Logistic regression from a small table (url, label: 1 to block); None if it has no usable row.

    Rows are put in order in one partition, so that a fit does not depend on how the table is dealt.
    """
    rows = labelled.where(F.col("label").isNotNull()).select(F.col("url").cast("string").alias("url"), F.col("label").cast("double").alias("label"))
    ready = with_features(with_parts(rows)).coalesce(1).sortWithinPartitions("url", "label")
    if not ready.take(1):
        return None
    model = LogisticRegression(maxIter=60, regParam=0.002, featuresCol="features", labelCol="label").fit(ready)
    return PipelineModel([model])


def labelled_by_rules(df: DataFrame, rules: Sequence[tuple[str, str]] = RULES, most: int = TRAINING_ROWS) -> DataFrame:
    """A labelled table of at most ``most`` distinct URLs that a rule decides: those of smallest hash."""
    decided = with_parts(df.select(F.col("url").cast("string").alias("url"))).withColumn("_rule", rule_of(rules)).where("_rule IS NOT NULL")
    rows = decided.select("url", (F.col("_rule.verdict") == BLOCK).cast("double").alias("label")).distinct()
    return rows.orderBy(F.xxhash64("url"), "url").limit(most)


def judge(df: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: DataFrame | None = None, id_column: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict and block_probability of every row of ``df`` (page_id, url).

    The rule's verdict stands; else the model's at probability 0.5. ``labelled`` (url, label) defaults to the URLs that
    rules decide. Without any labelled row URLs without a rule are allowed. Repeated rows and null page_ids stay; other
    columns of ``df`` are not read.
    """
    source = df.select(F.col(id_column).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    model = fit(labelled if labelled is not None else labelled_by_rules(source, rules))
    ready = with_features(with_parts(source).withColumn("_rule", rule_of(rules)))
    if model is None:
        scored = ready.withColumn("block_probability", F.lit(0.0))
    else:
        from pyspark.ml.functions import vector_to_array

        scored = model.transform(ready).withColumn("block_probability", vector_to_array("probability")[1])
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("block_probability") >= 0.5, BLOCK).otherwise(ALLOW))
    return scored.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "block_probability")
