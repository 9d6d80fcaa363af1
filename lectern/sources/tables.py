"""Documents from tables, and the sinks: Parquet, XML, JSON, word lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import text as X


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, titre, texte, rubrique) of (doc_id, text, source): the first line is the title."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select("doc_id", X.first_line(text).alias("titre"), X.other_lines(text).alias("texte"), F.col("source").alias("rubrique"))


#: The characters that XML 1.0 forbids, and carriage returns, which its readers turn into line feeds.
NOT_XML = r"[^\x09\x0A\x20-\uD7FF\uE000-\uFFFD\x{10000}-\x{10FFFF}]"


def printable(text: Column) -> Column:
    """text with a blank for each character that XML cannot give back."""
    return F.regexp_replace(text, NOT_XML, " ")


def write_xml(documents: DataFrame, folder: str) -> None:
    """A folder of XML files, a `document` element for each row below a `corpus` root. Characters that XML cannot give back are blanks."""
    columns = [c for c in ("fichier", "bulletin", "date", "rubrique", "titre", "auteur", "texte", "images", "contact", "has_image", "doc_id") if c in documents.columns]
    shown = documents.select(*[printable(F.col(c)).alias(c) if documents.schema[c].dataType == T.StringType() else F.col(c) for c in columns])
    if "images" in columns:
        shown = shown.withColumn("images", F.struct(F.col("images").alias("image")))
    if "has_image" in columns:
        shown = shown.withColumn("has_image", F.col("has_image").cast("int"))
    shown.write.mode("overwrite").format("xml").option("rootTag", "corpus").option("rowTag", "document").option("nullValue", "").save(folder)


def read_xml(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "document").option("ignoreSurroundingSpaces", "false").schema(schema).load(folder)


def write_terms(terms: DataFrame, folder: str) -> None:
    """Distinct terms, one a line, in order."""
    terms.select("term").distinct().orderBy("term").write.mode("overwrite").text(folder)


def read_terms(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.text(folder).select(F.trim("value").alias("term")).where("term <> ''").distinct()


def write_json(frame: DataFrame, folder: str) -> None:
    frame.write.mode("overwrite").json(folder)
