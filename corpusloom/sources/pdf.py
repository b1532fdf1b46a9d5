"""PDF files as columns: text, pages and properties, pictures."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import pdf

#: What stands after each page of a text.
MARK = "\n-- {} of {} --\n\n"
#: Files whose texts or pictures are handed on at once.
FILES = 64


def _told(data: bytes | None) -> tuple[str | None, int | None, str | None]:
    """Text, pages and properties; nulls for a file that is null, no PDF, encrypted or broken."""
    if data is None:
        return None, None, None
    try:
        pages, info = pdf.read(data)
    except pdf.BROKEN:
        return None, None, None
    return "".join(t + MARK.format(k, len(pages)) for k, t in enumerate(pages, 1)), len(pages), json.dumps(info)


def _pictures(data: bytes | None) -> list[tuple]:
    try:
        return [] if data is None else pdf.images(data)
    except pdf.BROKEN:
        return []


@F.arrow_udf(T.StringType())
def _text(content: pa.Array) -> pa.Array:
    return pa.array((_told(x.as_py())[0] for x in content), pa.string())


def pdf_text(content: Column) -> Column:
    """Text of a PDF's bytes, with a line between pages; null if they cannot be read."""
    return _text(content)


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, FILES):
            yield b.slice(k, FILES)


def captured(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with the columns text, pages and info (a map) that ``extract.extract_pdf`` takes, in place of the bytes.

    Files that are null, no PDF, encrypted or broken have null in all three; an
    empty PDF has an empty page.  Columns of these names are replaced.  Rows go
    through tasks as batches of bytes, none waits beside its file's text.
    """
    given = files.drop(*[c for c in ("text", "pages", "info") if c != content])
    other = [c for c in given.columns if c != content]

    def run(batches):
        for b in _few(batches):
            got = [_told(x.as_py()) for x in b.column(len(other))]
            told = [pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(other)], *told], [*other, "text", "pages", "info"])

    schema = T.StructType([given.schema[c] for c in other]).add("text", T.StringType()).add("pages", T.IntegerType()).add("info", T.StringType())
    return given.select(*other, content).mapInArrow(run, schema).withColumn("info", F.from_json("info", "map<string,string>"))


def pictures(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key, number, page, format, width, height, data: at most 20 pictures a file, from 50 pixels and 200 bytes, in order of pages."""
    names = ("number", "page", "format", "width", "height", "data")
    kinds = (T.IntegerType(), T.IntegerType(), T.StringType(), T.IntegerType(), T.IntegerType(), T.BinaryType())
    arrow = (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.binary())

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):  # a file at a time, for pictures may be large
                got = [(number, *p) for number, p in enumerate(_pictures(b.column(1)[k].as_py()), 1)]
                if got:
                    rows = pa.array([k] * len(got), pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column(0).take(rows), *(pa.array([g[i] for g in got], a) for i, a in enumerate(arrow))], [key, *names])

    schema = T.StructType([files.schema[key], *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))])
    return files.select(key, content).mapInArrow(run, schema)
