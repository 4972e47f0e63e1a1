"""Text and record-level rules as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boxes import col


def to_double(s, strict: bool = False) -> Column:
    """Trimmed text to DOUBLE; blank -> null. Garbage is null, or an error when ``strict``."""
    s = F.nullif(F.trim(col(s).cast("string")), F.lit(""))
    return s.cast("double") if strict else s.try_cast("double")


def slug(s, fallback: str | None = None) -> Column:
    """Lower case, spaces to ``_``, everything outside ``[a-z0-9_-]`` dropped."""
    out = F.regexp_replace(F.replace(F.lower(col(s)), F.lit(" "), F.lit("_")), r"[^a-z0-9_\-]", "")
    return out if fallback is None else F.coalesce(F.nullif(out, F.lit("")), F.lit(fallback))


def phrase_to_term(p, terms) -> Column:
    """0-based index of the term a model phrase stands for, or null.

    An exact match (trimmed, lower case) wins; else the first term where either
    text contains the other.
    """
    p = F.lower(F.trim(col(p)))
    cleaned = F.transform(col(terms), lambda term: F.lower(F.trim(term)))
    exact = F.array_position(cleaned, p)
    hits = F.transform(cleaned, lambda term: F.contains(p, term) | F.contains(term, p))
    partial = F.array_position(hits, F.lit(True))
    return F.coalesce(F.nullif(exact, F.lit(0)), F.nullif(partial, F.lit(0))).cast("int") - 1


def basename(path) -> Column:
    return F.regexp_extract(col(path), "[^/]+$", 0)


def output_name(path, prefix: str) -> Column:
    """``dir/name`` -> ``dir/<prefix>name``."""
    path = col(path)
    return F.concat(F.regexp_extract(path, "^(.*/)?", 0), F.lit(prefix), basename(path))


REJECT = "reject_reason"


def check_requests(df: DataFrame) -> DataFrame:
    """Clean segmentation requests and add ``reject_reason`` (null when accepted).

    Prompts are trimmed, blank ones dropped, and an empty list becomes null. Missing
    ``overlap_ratio`` / thresholds take their defaults (0.2, 0.1, 0.1).
    """
    prompts = F.filter(
        F.transform(F.col("text_prompts"), lambda prompt: F.trim(prompt)),
        lambda prompt: prompt.isNotNull() & (prompt != ""),
    )
    df = (
        df.withColumn("text_prompts", F.when(F.size(prompts) > 0, prompts))
        .withColumn("overlap_ratio", F.coalesce("overlap_ratio", F.lit(0.2)))
        .withColumn("threshold", F.coalesce("threshold", F.lit(0.1)))
        .withColumn("mask_threshold", F.coalesce("mask_threshold", F.lit(0.1)))
    )
    c = F.col
    has_text = c("text_prompts").isNotNull()
    has_point = c("x").isNotNull() & c("y").isNotNull()

    def outside(name: str) -> Column:
        return (c(name) < 0) | (c(name) > 1)

    reason = (
        F.when((c("patch_size") <= 0) | (c("crop_size") <= 0), "patch_size/crop_size must be > 0")
        .when((c("overlap_ratio") < 0) | (c("overlap_ratio") >= 1), "overlap_ratio must be in [0, 1)")
        .when(outside("threshold") | outside("mask_threshold"), "thresholds must be in [0, 1]")
        .when(c("patch_size") != c("crop_size"), "patch_size and crop_size differ")
        .when(~has_text & ~has_point, "neither prompts nor a point given")
        .when(has_text & has_point, "give prompts or a point, not both")
    )
    return df.withColumn("effective_patch", F.coalesce("patch_size", "crop_size")).withColumn(REJECT, reason)


def validate_requests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``reject_reason``)."""
    checked = check_requests(df)
    return checked.filter(F.col(REJECT).isNull()).drop(REJECT), checked.filter(F.col(REJECT).isNotNull())
