"""Folders of files as tables of text, and the index on disk."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import text as X
from corpusloom.functions.tables import EXTENSIONS
from corpusloom.operators import chunking
from corpusloom.operators.corpus import LEAST_TERMS, extension, file_tags, metadata_hash
from corpusloom.sources import snapshots
from corpusloom.sources.pdf import pdf_text

MOST_DEPTH = 10
VERSION = 2
LEAST_TEXT = 50
#: A file without extension is read if its name is shorter.
BARE_NAME = 30


#: What a path must not mean as a pattern.
_PATTERN = re.compile(r"[\\\[\]{}*?]")


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """path, rel, name, ext, length, modificationTime of readable files; only the folder is listed, no file is opened."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "modificationTime", "length")
    return _told(raw, folder).where(_wanted())


def _told(raw: DataFrame, folder: str) -> DataFrame:
    root = folder.rstrip("/") + "/"
    rel = F.regexp_replace(F.substr("path", F.instr("path", root) + len(root)), "^/+", "")
    return raw.withColumn("rel", rel).withColumn("name", F.element_at(F.split("rel", "/"), -1)).withColumn("ext", extension(F.col("name")))


def _wanted() -> Column:
    known = F.col("ext").isin(EXTENSIONS) | (~F.contains("name", F.lit(".")) & (F.length("name") < BARE_NAME))
    shown = ~F.col("rel").rlike(r"(^|/)(\.|node_modules(/|$)|__pycache__(/|$))")
    return known & shown & (F.size(F.split("rel", "/")) <= MOST_DEPTH + 1)


def scan(spark: SparkSession, folder: str, only: list[str] | None = None) -> DataFrame:
    """Readable files under a folder: path, relative path, name, extension, size, time, content.

    The folder is listed first, as Spark lists any input; only files that depth,
    names and extensions let pass are opened.  ``only`` names the files to look
    at, without a listing.
    """
    paths = [r[0] for r in listed(spark, folder).select("path").collect()] if only is None else only  # the driver lists inputs anyway
    if not paths:
        empty = T.StructType.fromDDL("path string, modificationTime timestamp, length bigint, content binary")
        return _told(spark.createDataFrame([], empty), folder)
    return _told(spark.read.format("binaryFile").load([_PATTERN.sub(r"\\\g<0>", p) for p in paths]), folder).where(_wanted())


def file_text(ext: Column, content: Column) -> Column:
    """Text by kind of file; null for broken notebooks and for PDFs that cannot be read."""
    raw = F.try_validate_utf8(F.decode(content, "UTF-8"))
    cells = F.try_variant_get(F.try_parse_json(raw), "$.cells", "array<variant>")
    part = lambda c, path, kind: F.try_variant_get(c, path, kind)
    source = lambda c: F.coalesce(F.array_join(part(c, "$.source", "array<string>"), ""), part(c, "$.source", "string"), F.lit(""))
    told = F.transform(cells, lambda c: F.concat(F.lit("["), F.coalesce(part(c, "$.cell_type", "string"), F.lit("undefined")), F.lit("]\n"), source(c)))
    notebook = F.when(F.try_parse_json(raw).isNotNull(), F.array_join(F.coalesce(told, F.array().cast("array<string>")), "\n\n"))
    return (
        F.when(ext == "pdf", X.clean_pdf_text(pdf_text(F.when(ext == "pdf", content))))
        .when(ext.isin("html", "htm", "xhtml"), X.strip_html(raw))
        .when(ext == "ipynb", notebook)
        .when(ext == "json", _pretty(F.when(ext == "json", raw)))
        .otherwise(raw)
    )


@F.pandas_udf(T.StringType())
def _pretty(raw: pd.Series) -> pd.Series:
    """JSON with keys in their order, indented by two; what is no JSON as it is."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            data = json.loads(text, parse_float=lambda x: int(v) if (v := float(x)).is_integer() and abs(v) < 1e21 else v, parse_constant=_refuse)
        except (ValueError, RecursionError):
            return text
        return json.dumps(data, indent=2, ensure_ascii=False)

    return raw.map(one, na_action="ignore")


def _refuse(name: str) -> None:
    raise ValueError(name)


def read_folder(spark: SparkSession, folder: str, captured: DataFrame | None = None, only: list[str] | None = None) -> DataFrame:
    """``scan`` with text; ``captured`` (path, text) has what another parser read from PDF files and goes before our own reading."""
    found = scan(spark, folder, only)
    own = file_text(F.col("ext"), F.col("content"))
    if captured is None:
        return found.withColumn("text", own)
    pdf = captured.select("path", X.clean_pdf_text("text").alias("__pdf"))
    return found.join(pdf, "path", "left").withColumn("text", F.coalesce(F.when(F.col("ext") == "pdf", F.col("__pdf")), own)).drop("__pdf")


def ingest(
    spark: SparkSession, folder: str, library_id: str, size: int = 4000, captured: DataFrame | None = None, only: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(files, chunks) of a folder, or of those files of it that ``only`` names; chunks with few terms are left out, numbering kept.

    A file's ``chunk_count`` is the number before those are left out; a chunk's
    ``word_count`` counts its terms, stems included.
    """
    found = read_folder(spark, folder, captured, only).where(F.length(X.trim("text")) >= LEAST_TEXT)
    mtime = (F.unix_millis("modificationTime")).cast("long")
    files = found.select(
        F.lit(library_id).alias("library_id"), F.col("path").alias("file_path"), F.col("name").alias("file_name"), F.col("rel").alias("file_rel_path"),
        F.col("ext").alias("file_type"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"),
        metadata_hash(F.col("path"), F.col("length"), mtime).alias("metadata_hash"), F.sha2("content", 256).alias("content_hash"),
        file_tags(F.col("name")).alias("tags"), X.count_words("text").alias("word_count"), "text", F.xxhash64("path").alias("doc_id"),
    )
    parts = chunking.smart_chunks(files, size)
    counts = parts.groupBy("doc_id").agg(F.count("*").cast("int").alias("chunk_count"))
    kept = parts.withColumn("word_count", F.size(X.terms("text"))).where(F.col("word_count") >= LEAST_TERMS)
    told = kept.join(files.select("doc_id", "library_id", "file_path", "file_name", "file_rel_path", "file_type"), "doc_id")
    return files.drop("text").join(counts, "doc_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0))), told


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """file_path and metadata_hash (path, size, time) of the files of a folder; none is opened."""
    found = listed(spark, folder)
    return found.select(F.col("path").alias("file_path"), metadata_hash(F.col("path"), F.col("length"), F.unix_millis("modificationTime")).alias("metadata_hash"))


def contents(spark: SparkSession, folder: str, captured: DataFrame | None = None) -> DataFrame:
    """file_path and content_hash of the files that ``ingest`` would index; nothing is chunked."""
    found = read_folder(spark, folder, captured).where(F.length(X.trim("text")) >= LEAST_TEXT)
    return found.select(F.col("path").alias("file_path"), F.sha2("content", 256).alias("content_hash"))


def save(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> None:
    """A new snapshot of an index; what lies at ``path`` may be what the tables are read from."""
    snapshots.commit(spark, path, tables, VERSION, by="library_id")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """The tables that ``save`` wrote last; nothing if there are none or the version is another one."""
    found = snapshots.newest(spark, path)
    return found[1] if found is not None and found[0] == VERSION else None
