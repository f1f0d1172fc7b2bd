"""Readers. All go through Spark, so any file system that Spark reads will do."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions import text as T
from .jsonl import jsonl_with_lineage, status_counts  # noqa: F401  part of the readers


def filings(spark: SparkSession, *folders: str, only: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """document_id of the .pdf and .txt files of the folders, each once, in order; perhaps only some, and the first so many."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(folders)).select("path")
    name = F.regexp_extract("path", r"([^/]+)\.(?:pdf|txt)$", 1)
    out = files.select(name.alias("document_id")).where("document_id <> ''").distinct()
    out = out.where(F.col("document_id").isin(only)) if only is not None else out
    return out.orderBy("document_id").limit(limit) if limit else out


def text_pages(files: DataFrame, strict: bool = True) -> DataFrame:
    """Pages of text filings (document_id, text): split at form feeds, a blank last part dropped, each cleaned; with metadata and section.

    Strict: a filing without a form feed has one row with error instead of pages.
    """
    parts = F.split("text", "\f")
    parts = F.when(T.strip(F.element_at(parts, -1)) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    unpaged = ~F.contains(F.col("text"), F.lit("\f")) & F.lit(strict)
    out = files.withColumn("error", F.when(unpaged, "no page boundaries")).withColumn("_parts", F.when(unpaged, F.array(F.lit(""))).otherwise(parts))
    out = out.select("document_id", "error", F.posexplode("_parts").alias("_i", "_text")).withColumn("text", T.clean_text(F.col("_text")))
    return with_metadata(out).select("document_id", "company", "year", "filing_type", (F.col("_i") + 1).alias("page"), "text", T.section_hint(F.col("text")).alias("section"), "error")


def with_metadata(frame: DataFrame, document: str = "document_id") -> DataFrame:
    d = F.col(document)
    return frame.withColumns({"company": T.company_name(d), "year": T.filing_year(d), "filing_type": T.filing_type(d)})


def pdf_pages(files: DataFrame) -> DataFrame:
    """path, page, text of binary PDF files (path, content); a file that cannot be read, or a missing reader, gives no page."""

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        try:
            from pypdf import PdfReader
        except ImportError:
            PdfReader = None
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    texts = [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages] if PdfReader else []
                except Exception:  # a broken file is as good as an empty one
                    texts = []
                rows += [(path, i, t) for i, t in enumerate(texts, 1)]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    return files.select("path", "content").mapInPandas(pages, "path string, page int, text string")


def jsonl(spark: SparkSession, path, schema: str | Ty.StructType) -> DataFrame:
    """JSON lines; a malformed line fails the read, blank lines do not count."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_map(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """key and value of each entry of one JSON object per file."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{value_schema}>")).alias("key", "value"))


def json_splits(spark: SparkSession, path: str, row_schema: str) -> DataFrame:
    """split and the row's columns, from an object of arrays."""
    return json_map(spark, path, f"array<{row_schema}>").select(F.col("key").alias("split"), F.explode("value").alias("r")).select("split", "r.*")


def id_list(spark: SparkSession, path: str, comments: bool = True) -> DataFrame:
    """id of each line that is not blank; lines that start with # may be comments."""
    rows = spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''")
    return rows.where(~F.col("id").startswith("#")) if comments else rows


def csv_table(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """A CSV file with a header that must have the required columns."""
    have = spark.read.option("header", True).csv(path).columns
    if missing := sorted(set(required) - set(have)):
        raise ValueError("missing columns: " + ", ".join(missing))
    typed = {f.name: f.dataType for f in Ty._parse_datatype_string(schema).fields}
    return spark.read.option("header", True).csv(path).select(*[F.col(c).cast(typed.get(c, "string")).alias(c) for c in have])


def manifest(spark: SparkSession, path, most: int = 64 << 20) -> DataFrame:
    """path, bytes and sha256 of each file; files beyond ``most`` bytes are listed without a hash, and their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small = files.where(F.col("length") <= most).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > most).select("path", F.col("length").alias("bytes"), F.lit(None).cast("string").alias("sha256"))
    return small.unionByName(large)
