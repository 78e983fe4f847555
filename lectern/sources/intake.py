"""Gates that uploads pass before anything else reads them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import safe_filename, valid_thread_id

MAX_FILES, LEAST_BYTES, MOST_BYTES = 3, 100, 50 * 1024 * 1024


def valid_name(filename: Column, content_type: Column) -> Column:
    kind = F.coalesce(content_type, F.lit(""))
    return F.coalesce(F.lower(filename).endswith(".pdf"), F.lit(False)) & ((kind == "") | kind.startswith("application/pdf"))


def valid_bytes(content: Column) -> Column:
    return F.length(content).between(LEAST_BYTES, MOST_BYTES) & (F.substring(content, 1, 4) == F.lit(b"%PDF"))


def intake_gate(uploads: DataFrame, batch: str, filename: str, content_type: str) -> DataFrame:
    """One row per batch: ``n_files`` and ``accepted``; one bad file rejects its batch."""
    return uploads.groupBy(batch).agg(
        F.count(F.lit(1)).alias("n_files"),
        (F.bool_and(valid_name(F.col(filename), F.col(content_type))) & (F.count(F.lit(1)) <= MAX_FILES)).alias("accepted"),
    )


def stored_names(accepted: DataFrame, thread: str, order: str, name: str) -> DataFrame:
    """Adds ``stored``: safe names that end in .pdf, made unique within a thread by ``_1``, ``_2`` ..., in upload order.

    The first suffix that is free is taken, and a name's own ending keeps its case. A thread has at most
    ``MAX_FILES`` files, so its names are folded as one short array; a suffixed name may clash with a
    later one, which then gets a suffix of its own.
    """
    given = F.coalesce(F.nullif(F.col(name), F.lit("")), F.concat(F.lit("document_"), F.col(order).cast("string"), F.lit(".pdf")))
    safe = accepted.select(thread, order, name, safe_filename(given).alias("safe"))
    files = safe.groupBy(thread).agg(F.sort_array(F.collect_list(F.struct(order, name, "safe"))).alias("files"))
    # a dot that begins a name belongs to its stem, and so does one that ends it
    ending = "regexp_extract(f.safe, '^.+([.][^.]+)$', 1)"
    stem = f"left(f.safe, length(f.safe) - length({ending}))"
    kept = f"if(lower({ending}) = '.pdf', {ending}, '.pdf')"
    tries = f"concat(array(concat({stem}, {kept})), transform(sequence(1, {MAX_FILES}), k -> concat({stem}, '_', k, {kept})))"
    fold = f"aggregate(files, cast(array() as array<string>), (a, f) -> concat(a, array(element_at(filter({tries}, t -> not array_contains(a, t)), 1))))"
    named = files.select(thread, F.posexplode(F.arrays_zip("files", F.expr(fold).alias("stored"))).alias("k", "x"))
    return named.select(thread, F.col(f"x.files.{order}").alias(order), F.col(f"x.files.{name}").alias(name), F.col("x.stored").alias("stored"))


def picked_files(files: DataFrame, mime: str) -> DataFrame:
    """What a drop or a picker lets through: files whose type is exactly PDF's."""
    return files.where(F.col(mime) == "application/pdf")


def pending_files(pending: Column, added: Column) -> Column:
    """Struct (files, overflow): new files behind the pending ones, of which the first ``MAX_FILES`` stay."""
    both = F.concat(pending, added)
    return F.struct(F.slice(both, 1, MAX_FILES).alias("files"), (F.size(both) > MAX_FILES).alias("overflow"))


def without_file(pending: Column, at: Column) -> Column:
    """The pending files without the one at an index from 0; an index that isn't there changes nothing."""
    return F.filter(pending, lambda x, k: k != at)


def new_threads(rows: DataFrame, thread: str = "thread_id") -> DataFrame:
    """Adds a random session id (UUID 4); write the result before it is used twice."""
    return rows.withColumn(thread, F.uuid())


def existing_sessions(sessions: DataFrame, files: DataFrame, thread: str, name: str) -> DataFrame:
    """The sessions that have a valid id and a stored file with the ending .pdf in any case."""
    stored = files.where(F.col(name).rlike("(?i)^.+[.]pdf$")).select(thread).distinct()
    return sessions.where(valid_thread_id(F.col(thread))).join(stored, thread, "left_semi")


def first_files(documents: DataFrame, thread: str, order: str, most: int = MAX_FILES) -> DataFrame:
    """The first files of each thread, with ``ord`` from 1; each task keeps its own first few before the shuffle."""
    w = Window.partitionBy(thread).orderBy(order)
    return documents.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= most)
