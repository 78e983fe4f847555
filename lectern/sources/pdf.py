"""PDF files as a source: whole documents, or one row a page.

Files come through Spark's own ``binaryFile`` source, so they may lie in any store that Spark reads; a
partition takes a group of files. They are read by :mod:`lectern.sources.pdf_text`, or by another reader.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from lectern.operators.assemble import paged
from lectern.sources.pdf_text import page_texts, read_pdf

#: From a file's bytes to its pages' texts and what it says of itself (title, author, subject, creator).
Reader = Callable[[bytes], tuple[list[str], dict[str, str]]]
PARSED = "path string, pages array<string>, title string, author string, subject string, creator string, error string"


def _parsed(reader: Reader):
    def one(path: str, content: bytes) -> dict:
        try:
            pages, about = reader(content)
            return {"path": path, "pages": pages, **{k: about.get(k, "") for k in ("title", "author", "subject", "creator")}, "error": None}
        except Exception as error:  # noqa: BLE001  a broken file must not end the job: its error is its result
            return {"path": path, "pages": [], "title": None, "author": None, "subject": None, "creator": None, "error": f"Failed to parse PDF: {error}"}

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [one(p, c) for p, c in zip(batch["path"], batch["content"])]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARSED.split(", ")])

    return parsed


def read_pdfs(files: DataFrame, reader: Reader = read_pdf) -> DataFrame:
    """(path, n_pages, text, title, author, subject, creator, error) of ``binaryFile`` rows (path, content).

    Pages stand in order under page headings. A file that can't be read has an error, no pages and a null text.
    """
    found = files.select("path", "content").mapInPandas(_parsed(reader), PARSED)
    text = F.when(F.col("error").isNull(), paged(F.col("pages")))
    return found.select("path", F.size("pages").alias("n_pages"), text.alias("text"), "title", "author", "subject", "creator", "error")


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """The PDF files of a folder and its sub-folders, one row a file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)


def read_pages(files: DataFrame, key: str = "path", pages: Callable[[bytes], Iterator[str]] = page_texts) -> DataFrame:
    """(key, page_no, text, error): one row a page, from 1 on, of rows (key, content).

    Pages are handed on one at a time, so a long file doesn't fill a row. A file that can't be read has one
    row with an ``error``, behind the pages that could be; a null content is such a file, a file without pages has no row.
    """

    def found(content: bytes | None) -> Iterator[tuple[int | None, str | None, str | None]]:
        try:
            for k, text in enumerate(pages(content or b"")):
                yield k + 1, text, None
        except Exception as error:  # noqa: BLE001  a broken file must not end the job: its error is its result
            yield None, None, f"Failed to parse PDF: {error}"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, content in enumerate(batch.column(1)):
                rows, held = [], 0

                def full(k=k):
                    at, text, error = zip(*rows)
                    keys = batch.column(0).take(pa.array([k] * len(rows)))
                    return pa.RecordBatch.from_arrays([keys, pa.array(at, pa.int32()), pa.array(text, pa.string()), pa.array(error, pa.string())], ["key", "page_no", "text", "error"])

                for row in found(content.as_py()):
                    rows.append(row)
                    held += len(row[1] or "")
                    if held > 1 << 20 or len(rows) == 256:
                        yield full()
                        rows, held = [], 0
                if rows:
                    yield full()

    named = files.select(F.col(key).alias("key"), "content")
    out = StructType([StructField("key", named.schema["key"].dataType), StructField("page_no", IntegerType()), StructField("text", StringType()), StructField("error", StringType())])
    return named.mapInArrow(read, out).withColumnRenamed("key", key)
