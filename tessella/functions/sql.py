"""The vector functions for SQL texts, as temporary SQL functions; Catalyst inlines them."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name and parameters, and the body.
FUNCTIONS = {
    "vdot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v)",
    "vnorm(a ARRAY<DOUBLE>)": "sqrt(aggregate(a, 0D, (s, v) -> s + v * v))",
    "vl2(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, v) -> s + v))",
    "sigmoid(x DOUBLE)": "1 / (1 + exp(-x))",
}


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in the session; gives their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS DOUBLE RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]
