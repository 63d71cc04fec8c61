"""Operators for SQL text: Arrow functions and a table function under their own names."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.evaluation import ALIGNED, _aligned


#: deletion_variants as SQL: the text, then all strings with one and with two characters deleted, each once.
_SHORTER = "transform(sequence(1, greatest(length({0}), 1)), {1} -> concat(left({0}, {1} - 1), substring({0}, {1} + 1)))"
_ONCE = f"IF(k >= 1 AND length(t) > 0, {_SHORTER.format('t', 'i')}, array())"
_TWICE = f"IF(k >= 2 AND length(t) > 1, flatten(transform({_SHORTER.format('t', 'i')}, s -> {_SHORTER.format('s', 'j')})), array())"


class Cuts:
    """Table function: a reading cut in two at every place."""

    def eval(self, reading: str) -> Iterator[tuple[int, str, str]]:
        for i in range(1, len(reading or "")):
            yield i, reading[:i], reading[i:]


def register(spark: SparkSession) -> None:
    """align_tokens(ref, hyp), deletion_variants(text, k) and cuts(reading) in SQL."""
    spark.udf.register("align_tokens", F.pandas_udf(_aligned, ALIGNED))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION deletion_variants(t STRING, k INT) RETURNS ARRAY<STRING> RETURN array_distinct(concat(array(t), {_ONCE}, {_TWICE}))")
    spark.udtf.register("cuts", F.udtf(Cuts, returnType="cut int, a string, b string"))
