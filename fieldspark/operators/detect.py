"""From raw detector output to the detection table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as bx
from ..functions import text
from ..functions.numbers import round_to
from ..scale import bind, bounded_broadcast
from .suppress import Preset, guarded_parts, preset


def search_terms(configs: DataFrame) -> DataFrame:
    """All search terms in order, repeats kept: ``term, class_name, prediction_value, cfg_ord, term_ord``.

    ``configs``: ``cfg_ord, class_name, search_terms array<string>, prediction_value``.
    """
    return configs.select(
        "cfg_ord", "class_name", "prediction_value", F.posexplode("search_terms").alias("term_ord", "term")
    ).select("term", "class_name", "prediction_value", "cfg_ord", "term_ord")


def first_config(terms: DataFrame) -> DataFrame:
    """Per term the first config in list order that contains it."""
    first = F.min_by(F.struct("class_name", "prediction_value"), F.struct("cfg_ord", "term_ord")).alias("_c")
    return terms.groupBy("term").agg(first).select("term", "_c.class_name", "_c.prediction_value")


def map_terms(df: DataFrame, terms: DataFrame, term: str = "term") -> DataFrame:
    """Adds ``class_name, prediction_value``; rows whose term no config contains are dropped."""
    return df.join(bounded_broadcast(first_config(terms)).withColumnRenamed("term", term), term)


def name_phrases(df: DataFrame, terms: DataFrame, phrase: str = "phrase") -> DataFrame:
    """Model phrases to search terms (exact, else first containment); unmatched rows are dropped.

    The term list is one array (it is the detector's prompt, a config-sized table).
    """
    listed = terms.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("cfg_ord", "term_ord", "term"))), lambda t: t["term"]).alias("_terms")
    )
    # every distinct phrase is resolved once
    seen = df.select(phrase).distinct().join(F.broadcast(listed))
    resolved = seen.withColumn("term", F.get("_terms", text.phrase_to_term(phrase, "_terms")))
    resolved = resolved.filter(F.col("term").isNotNull()).select(phrase, "term")
    return df.join(bounded_broadcast(resolved), phrase)


def finalize_detections(
    raw: DataFrame, images: DataFrame, terms: DataFrame, preset_: str | Preset = "owlv2",
    confidence: float | None = None, letterboxed: bool = False, **plan,
) -> DataFrame:
    """Raw boxes to ``img, prediction, label, confidence, bounding_box``, and ``latency`` if ``raw`` has it.

    ``raw``: ``img, ord, box`` (960-pixel letterbox coordinates when ``letterboxed``), ``score`` and the search
    ``term``, or a model's ``phrase`` that is first resolved to one; ``images``: ``img, width, height``.
    Boxes are suppressed per term text: a term listed twice is one group.
    """
    if "term" not in raw.columns:
        raw = name_phrases(raw, terms).drop("phrase")
    p = preset(preset_)
    limit = p.confidence if confidence is None else confidence
    sized = raw.join(bounded_broadcast(images.select("img", "width", "height")), "img")
    if letterboxed:
        sized = bind(sized, _meta=bx.letterbox("width", "height"))
        sized = bind(sized, box=bx.unletterbox("box", "_meta")).drop("_meta")
    kept, untouched = guarded_parts(sized, p, **plan)
    if untouched is not None:
        # survivors are rounded already
        untouched = bind(untouched, box=bx.make_box(*[round_to(F.col("box")[n], 2) for n in bx.EDGES]))
        kept = kept.unionByName(untouched)
    b = F.col("box")
    if p.max_side is not None:
        kept = kept.filter(F.greatest(b["x2"] - b["x1"], b["y2"] - b["y1"]) <= p.max_side)
    if p.reject_large:
        kept = kept.filter(~bx.too_large("box", "width", "height"))
    if p.grow_tiny:
        kept = kept.withColumn("box", bx.min_visible("box", "width", "height"))
    kept = bind(kept, confidence=round_to("score", 2))
    kept = kept.filter(F.col("confidence") > limit if p.strict_confidence else F.col("confidence") >= limit)
    named = map_terms(kept, terms)
    return named.select(
        "img", "ord", F.col("prediction_value").alias("prediction"), F.col("class_name").alias("label"),
        "confidence", bx.to_array("box").alias("bounding_box"), *[c for c in ("latency",) if c in raw.columns],
    )
