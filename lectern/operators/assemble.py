"""From files to one text a session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assemble(files: DataFrame, thread: str, name: str, text: str) -> DataFrame:
    """(thread, n_docs, parsed_text): a session's texts under headings, in upload order (column ``ord``)."""
    part = F.concat(F.lit("===== Document "), F.col("ord").cast("string"), F.lit(": "), F.col(name), F.lit(" =====\n"), F.coalesce(text, F.lit("")))
    grouped = files.select(thread, "ord", part.alias("part")).groupBy(thread).agg(F.sort_array(F.collect_list(F.struct("ord", "part"))).alias("parts"))
    return grouped.select(thread, F.size("parts").alias("n_docs"), F.array_join(F.col("parts.part"), "\n\n").alias("parsed_text"))


def parsed_or_error(text, error):
    """A document's text, or what its parser said in its place: the review goes on with that."""
    return F.when(error.isNotNull(), F.concat(F.lit("Error parsing PDF: "), error)).otherwise(text)


def paged(pages, first: int = 1):
    """A Column: the array of page texts under page headings."""
    return F.array_join(F.transform(pages, lambda p, k: F.concat(F.lit("--- Page "), (k + first).cast("string"), F.lit(" ---\n"), p)), "\n\n")
