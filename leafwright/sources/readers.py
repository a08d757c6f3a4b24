"""Files in: forms for a decoder, page content, truth records, reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: What a decoder yields per page: its text lines and controls.
PAGE = (
    "path string, page int, lines array<struct<line:int,x0:double,y0:double,x1:double,y1:double,text:string>>, "
    "controls array<struct<ctrl:int,x:double,y:double,w:double,h:double,kind:string,selected:boolean,conf:double>>"
)


def files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, length, content) of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "length", "content")


def decoded(binary: DataFrame, decoder: Callable[[str, bytes], list[dict]]) -> DataFrame:
    """Pages of ``files``; ``decoder`` makes each file's pages (dicts of the
    columns of PAGE without the path).  No decoder comes with this library."""
    schema = to_arrow_schema(StructType.fromDDL(PAGE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows = [{"path": path.as_py(), **page} for page in decoder(path.as_py(), content.as_py())]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return binary.select("path", "content").mapInArrow(run, PAGE)


def first_text(pages: DataFrame, tiers: list[str]) -> DataFrame:
    """``pages`` with ``lines`` of the first tier (columns of lines, as from the
    text layer and from recognisers) that has any, and ``text_source``: native
    for the first, ocr for the others, none without lines."""
    source = F.coalesce(*(F.when(F.size(t) > 0, "native" if i == 0 else "ocr") for i, t in enumerate(tiers)), F.lit("none"))
    return pages.withColumn("text_source", source).withColumn("lines", F.coalesce(*(F.when(F.size(t) > 0, F.col(t)) for t in tiers)))


def rasterised(binary: DataFrame, render: Callable[[bytes, int], list[tuple[int, int, bytes]]], dpi: int = 300) -> DataFrame:
    """(path, page, image) of ``files``; ``render`` makes each file's pages
    (width, height, grey bytes).  No renderer comes with this library."""
    kind = "path string, page int, image struct<width:int,height:int,data:binary>"
    schema = to_arrow_schema(StructType.fromDDL(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                for n, (width, height, data) in enumerate(render(content.as_py(), dpi)):
                    # one page a batch: a raster is some megabytes
                    yield pa.RecordBatch.from_pylist([{"path": path.as_py(), "page": n, "image": {"width": width, "height": height, "data": data}}], schema=schema)

    return binary.select("path", "content").mapInArrow(run, kind)


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("path").agg(F.count("*").alias("pages"))


def page_lines(pages: DataFrame) -> DataFrame:
    """(path, page_no, line, x0, y0, x1, y1, text)."""
    return pages.select("path", F.col("page").alias("page_no"), F.inline("lines"))


def page_controls(pages: DataFrame) -> DataFrame:
    return pages.select("path", F.col("page").alias("page_no"), F.inline("controls"))


def lines_of_words(words: DataFrame) -> DataFrame:
    """(page, block, line, x0, y0, x1, y1, text) of words with the same."""
    each = F.array_sort(F.collect_list(F.struct("x0", "word")))
    return words.groupBy("page", "block", "line").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.array_join(F.transform(each, lambda w: w["word"]), " ").alias("text"))


def records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One row per JSON file."""
    reader = spark.read.option("multiLine", True).option("recursiveFileLookup", True)
    return (reader.schema(schema) if schema else reader).json(path).withColumn("path", F.col("_metadata.file_path"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(form_type, pdf, json) of a manifest {form type: [{pdf, json}]}."""
    listed = "map<string,array<struct<pdf:string,json:string>>>"
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", listed)).alias("form_type", "entries"))
    return whole.select("form_type", F.inline("entries"))


def table_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)
