"""Readers and writers of decisions, cases and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

GOLD = "array<struct<start:int,end:int,text:string,entity:string,kind:string>>"
KEEP = "array<struct<text:string,kind:string,count:int>>"
PROVENANCE = "struct<hf_dataset:string,revision:string,file:string,row_group:int,file_row_number:int,content_hash:string>"
CASE = (
    "id string, court string, language string, docket string, decision_date string, legal_area string, source_url string, "
    f"text string, gold {GOLD}, keep {KEEP}, published_text string, license string, provenance {PROVENANCE}"
)
SOURCE = (
    "decision_id string, court string, language string, docket_number string, decision_date string, legal_area string, "
    f"source_url string, full_text string, provenance {PROVENANCE}"
)
#: Bytes of result files whose rows one task sorts.
PART_BYTES = 16 * 2**20


def _stem() -> Column:
    return F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^/.]+)?$", 1)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's name), text, language and legal_area (unknown) of plain text files."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(_stem().alias("doc_id"), F.col("value").alias("text"), F.lit("").alias("language"), F.lit("").alias("legal_area"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The same of JSON documents, one a file; missing fields are empty."""
    rows = spark.read.schema("text string, language string, legal_area string").json(path, multiLine=True)
    return rows.select(_stem().alias("doc_id"), "text", F.coalesce("language", F.lit("")).alias("language"), F.coalesce("legal_area", F.lit("")).alias("legal_area"))


def read_cases(spark: SparkSession, *paths: str) -> DataFrame:
    """Benchmark cases of JSON lines, gzipped or not."""
    return spark.read.schema(CASE).json(list(paths))


def read_sources(spark: SparkSession, *paths: str) -> DataFrame:
    """Published decisions of JSON lines."""
    return spark.read.schema(SOURCE).json(list(paths))


def read_results(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Published results by id: rows without an id go, of several with one id the last row of the last file stays."""
    place = ("_metadata.file_path", "_metadata.file_block_start")
    rows = spark.read.schema(schema).json(path)
    names = rows.columns
    rows = rows.select(*names, F.struct(*map(F.col, place), F.monotonically_increasing_id()).alias("__place")).where("id is not null")
    # As many parts as the files ask for: each is sorted by one task.
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if (parts := size // PART_BYTES) > int(spark.conf.get("spark.sql.shuffle.partitions")):
        rows = rows.repartition(parts, "id")
    last = Window.partitionBy("id").orderBy(F.desc("__place"))
    return rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").select(*names)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Hand labels of a TSV file with a header and doubled quotes."""
    schema = "no int, case string, entity string, mentions int, label string, context string"
    return spark.read.schema(schema).csv(path, sep="\t", header=True, quote='"', escape='"')


def to_dicts(rows: DataFrame) -> DataFrame:
    """One JSON object a row, in a column ``value``; fields without a value are left out."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def from_dicts(lines: DataFrame, schema: str | StructType) -> DataFrame:
    """The rows of JSON objects in a column ``value``; missing fields are null."""
    return lines.select(F.from_json("value", schema).alias("row")).select("row.*")


def write_redacted(applied: DataFrame, path: str) -> None:
    """Redacted texts and their logs as JSON lines, one a document, in as many files as there are tasks."""
    applied.select("doc_id", "output", "edits").write.mode("overwrite").json(path)


def append_results(results: DataFrame, path: str) -> None:
    """More result rows as JSON lines; rows with an error count as done."""
    results.write.mode("append").json(path)


def todo(cases: DataFrame, path: str, id_col: str = "id") -> DataFrame:
    """Cases that have no result yet, error or not."""
    spark = cases.sparkSession
    try:
        done = spark.read.schema(f"{id_col} string").json(path).select(id_col).distinct()
        return cases.join(done, id_col, "left_anti")
    except Exception as e:  # nothing was written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return cases


def write_summary(summary: DataFrame, path: str) -> None:
    """A summary of a few rows as one JSON file."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def write_splits(cases: DataFrame, path: str) -> None:
    """Cases as JSON lines in a folder for each split."""
    cases.write.mode("overwrite").partitionBy("split").json(path)
