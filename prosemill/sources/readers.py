"""Where documents come from. All of it is read by Spark, wherever it lies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.policy import Policy


def tables(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def inline(spark: SparkSession, texts: list[str | None], lang: str | None = None) -> DataFrame:
    """doc_id, text, lang of texts at hand."""
    return spark.createDataFrame([(i, t, lang) for i, t in enumerate(texts)], "doc_id long, text string, lang string")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, name, text: each UTF-8 file as one document; name is the file's without folder and ending."""
    name = F.regexp_extract("path", "([^/]+?)(?:\\.[^./]*)?$", 1)
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text")).select("path", name.alias("name"), "text")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """name, lang, genre, text_type of the passages that a JSON manifest lists."""
    schema = "passages array<struct<name: string, lang: string, genre: string, text_type: string>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.inline("passages"))


def corpus(spark: SparkSession, manifest_path: str, files: str) -> DataFrame:
    """The passages of a manifest with their texts; a passage without a file has a null text."""
    return manifest(spark, manifest_path).join(text_files(spark, files).select("name", "text"), "name", "left")


def policy(spark: SparkSession, path: str) -> Policy:
    """A policy from a JSON file of some of its fields."""
    return Policy.from_json(spark.read.text(path, wholetext=True).first()["value"])


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """lang, word, zipf, is_stop from a table of any format that Spark tells by its ending."""
    kind = path.rstrip("/").rpartition(".")[2]
    reader = spark.read.option("header", True).schema("lang string, word string, zipf double, is_stop boolean")
    return (reader.csv(path) if kind == "csv" else reader.json(path) if kind == "json" else spark.read.parquet(path)).select(
        "lang", "word", F.col("zipf").cast("double"), F.coalesce(F.col("is_stop").cast("boolean"), F.lit(False)).alias("is_stop")
    )
