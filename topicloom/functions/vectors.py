"""Vector arithmetic on arrays of numbers, in double precision.

Native higher-order functions serve row-wise work. Work on many pairs goes
through block products (``operators.nearest``) instead.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    squares = F.aggregate(as_doubles(vector), F.lit(0.0), lambda total, x: total + x * x)
    return F.sqrt(squares)


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 when either vector is zero; unequal lengths are an error."""
    lengths_differ = F.size(a) != F.size(b)
    scale = norm(a) * norm(b)
    message = F.concat(
        F.lit("vectors differ in length: "), F.size(a).cast("string"),
        F.lit(" and "), F.size(b).cast("string"),
    )
    return (
        F.when(lengths_differ, F.raise_error(message).cast("double"))
        .when(scale == 0, F.lit(0.0))
        .otherwise(dot(a, b) / scale)
    )


def cosine_distance(a: Column, b: Column) -> Column:
    """1 (maximally far) when either vector is zero."""
    return F.lit(1.0) - cosine_similarity(a, b)


def unit(vector: Column) -> Column:
    """Scale to length one; a zero vector stays as it is."""
    length = norm(vector)
    scaled = F.transform(as_doubles(vector), lambda x: x / length)
    return F.when(length == 0, as_doubles(vector)).otherwise(scaled)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x + y)


def divide(vector: Column, by: Column) -> Column:
    return F.transform(as_doubles(vector), lambda x: x / by)


def format_vector(vector: Column) -> Column:
    """``[a,b,...]`` as sent to a vector store."""
    return F.concat(F.lit("["), F.array_join(vector.cast("array<string>"), ","), F.lit("]"))


def parse_vector(text: Column) -> Column:
    inner = F.regexp_replace(text, r"^\[|\]$", "")
    return F.split(inner, ",").cast("array<double>")


def checked_dimension(vector: Column, dimension: int) -> Column:
    """The vector itself, or an error if it has not ``dimension`` entries."""
    message = F.concat(
        F.lit(f"expected {dimension} dimensions, got "), F.size(vector).cast("string")
    )
    fits = F.size(vector) == dimension
    return F.when(fits, vector).otherwise(F.raise_error(message).cast("array<double>"))


def mean_by(df: DataFrame, keys: list[str], vector_col: str, out_col: str = "centroid",
            count_col: str = "member_count") -> DataFrame:
    """Element-wise mean and row count per key.

    Partial sums are merged map-side, so a key with most of the rows costs one
    buffer per task, not one task.
    """
    summed = df.groupBy(*keys).agg(
        Summarizer.mean(array_to_vector(F.col(vector_col))).alias("_mean"),
        F.count(F.lit(1)).alias(count_col),
    )
    return summed.select(*keys, vector_to_array("_mean").alias(out_col), count_col)


def mean_of_all(df: DataFrame, vector_col: str) -> DataFrame:
    """Mean of every row's vector; the summarizer rejects an empty input."""
    row = df.agg(
        Summarizer.mean(array_to_vector(F.col(vector_col))).alias("_mean"),
        F.count(F.lit(1)).alias("member_count"),
    )
    return row.select(vector_to_array("_mean").alias("centroid"), "member_count")
