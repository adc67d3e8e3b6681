"""Arrow-vectorised functions for what no built-in expression can do, and their SQL names."""

from __future__ import annotations

from unicodedata import normalize

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions import characters as ch
from foliospark.functions.bidi import is_rtl, reorder


@F.pandas_udf(T.StringType())
def normalize_nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def bidi_reorder(text: pd.Series, rtl: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else reorder(t, bool(r)) for t, r in zip(text, rtl, strict=True)])


@F.pandas_udf(T.StringType())
def logical_text(visual: pd.Series) -> pd.Series:
    """Visual order to clean logical text: digits unified, reordered, then normalised."""
    return visual.map(lambda t: None if t is None else ch.finish(reorder(ch.unify_digits(t), is_rtl(t))))


@F.pandas_udf(T.StringType())
def unify_digits(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else ch.unify_digits(t))


@F.pandas_udf(T.BooleanType())
def is_mark(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else ch.is_mark(t))


@F.pandas_udf(T.StringType())
def merge_overlay(host: pd.Series, overlay: pd.Series) -> pd.Series:
    """The host with the composed letter of an overlay; null where that is ambiguous."""

    def one(h: str | None, o: str | None) -> str | None:
        base = ch.composed_base(o) if o else None
        return ch.merge_composed(h, base, o) if h is not None and base else None

    return pd.Series([one(h, o) for h, o in zip(host, overlay, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def glyph_name_text(name: pd.Series) -> pd.Series:
    from foliospark.functions.glyph_names import glyph_name_text as text

    return name.map(text)


def register(spark: SparkSession) -> None:
    """Makes the functions known to SQL."""
    for name, f in (("normalize_nfkc", normalize_nfkc), ("bidi_reorder", bidi_reorder), ("logical_text", logical_text), ("unify_digits", unify_digits), ("glyph_name_text", glyph_name_text)):
        spark.udf.register(name, f)
