"""Small tables with the awkward rows that every operator must take."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, **extra):
    """A documents table of (id, text) pairs or texts; ``extra`` columns hold constants."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    from pyspark.sql import functions as F

    return df.withColumns({k: F.lit(v) for k, v in extra.items()}) if extra else df


AWKWARD = [None, "", " \t\n", "a", "word " * 30_000, "x" * 100_000, "Ä ö ß 日本 \U0001f600", "same text here", "same text here"]
