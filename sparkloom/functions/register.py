"""The engine's functions for use from SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import html, serp, text, urls


@F.pandas_udf(T.ArrayType(T.StringType()))
def _windows(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: text.windows(text.sentences(t)))


@F.udtf(returnType="position int, window string")
class SplitChunks:
    """The sentence windows of a text, a row each: ``FROM docs, LATERAL split_chunks(text)``."""

    def eval(self, body: str):
        yield from enumerate(text.windows(text.sentences(body)))


FUNCTIONS = {
    "canonical_url": urls.canonicalize,
    "robots_rules": urls.parse_robots,
    "is_private_address": urls.is_private,
    "split_sentences": text.split_sentences,
    "sentence_windows": _windows,
    "parse_html": html.parse_html,
    "highlight": serp.highlighted,
}


def register(spark: SparkSession) -> list[str]:
    """Register all functions with the session; their names."""
    for name, f in FUNCTIONS.items():
        spark.udf.register(name, f)
    spark.udtf.register("split_chunks", SplitChunks)
    return [*FUNCTIONS, "split_chunks"]
