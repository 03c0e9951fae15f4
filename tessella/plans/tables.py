"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import vector as V


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vectors(spark: SparkSession, sf: str, key: str = "id") -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias(key), V.doubles("embedding").alias("v"), F.col("label").alias("fam"))


def vector_of(spark: SparkSession, sf: str, vec_id: int):
    """One vector as a literal."""
    row = table(spark, sf, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return V.literal_vector(row[0])


def font_meta(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("location"), F.col("p_type").alias("file"), (F.col("p_size") > 25).alias("paid"))


#: SQL for a double dot product of two lists, and for a vector in doubles.
DOT = "list_inner_product({}::DOUBLE[], {}::DOUBLE[])"
