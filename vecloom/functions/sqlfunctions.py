"""The vector arithmetic as SQL functions of a session: expressions that the optimizer inlines, no Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name: (parameters, result, body)
FUNCTIONS = {
    "vec_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "vec_l2sq": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)"),
    "vec_norm": ("a ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(a, 0D, (s, x) -> s + x * x))"),
    "vec_normalize": ("a ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "transform(a, x -> x / if(sqrt(aggregate(a, 0D, (s, y) -> s + y * y)) < 1e-10D, 1D, sqrt(aggregate(a, 0D, (s, y) -> s + y * y))))"),
    "vec_centre": ("a ARRAY<DOUBLE>, m ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "zip_with(a, m, (x, y) -> x - y)"),
}


def register(spark: SparkSession) -> None:
    """Make vec_dot, vec_l2sq, vec_norm, vec_normalize and vec_centre known to the session's SQL."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
