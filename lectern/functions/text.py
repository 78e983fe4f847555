"""Text helpers as Column expressions; lengths and positions are in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = "`" * 3


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def prefix(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def _between(text: Column, mark: str) -> Column:
    """What stands after the first ``mark``, up to the next one."""
    return F.get(F.split(text, mark, -1), F.lit(1))


def fenced_body(text: Column) -> Column:
    """The body of the first json fence, else of the first fence, else the text as it is."""
    tagged = F.split(_between(text, FENCE + "json"), FENCE, -1)[0]
    return F.when(F.contains(text, F.lit(FENCE + "json")), strip(tagged)).when(F.contains(text, F.lit(FENCE)), strip(_between(text, FENCE))).otherwise(text)


def compiled_body(text: Column) -> Column:
    """The body of a compiler's answer: as :func:`fenced_body`, always stripped, from the first ``{`` to the last ``}``."""
    return brace_trim(strip(fenced_body(text)))


def brace_trim(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; an end without its brace stays."""
    first = F.locate("{", text)
    opened = F.when(first > 0, F.substring(text, first, F.length(text))).otherwise(text)
    last = F.length(opened) - F.locate("}", F.reverse(opened)) + 1
    return F.when(F.locate("}", opened) > 0, F.substring(opened, F.lit(1), last)).otherwise(opened)


def safe_filename(name: Column, fallback: str = "document.pdf", longest: int = 255) -> Column:
    """The last part of a path with safe characters only, bounded in length."""
    base = F.element_at(F.split(F.rtrim(name, F.lit("/")), "/", -1), -1)
    clean = F.ltrim(F.regexp_replace(base, "[^a-zA-Z0-9._-]", "_"), F.lit("."))
    tail = F.right(clean, F.lit(50))
    short = F.when(F.length(clean) > longest, F.concat(F.left(clean, F.lit(200)), F.when(F.contains(tail, F.lit(".")), tail).otherwise(".pdf"))).otherwise(clean)
    return F.when(F.coalesce(short, F.lit("")) == "", fallback).otherwise(short)


def redact_error(message: Column, generic: str = "Invalid file format or size") -> Column:
    """Messages that may hold a path become a generic one."""
    return F.when(F.lower(message).contains("path") | message.contains("/") | message.contains("\\"), generic).otherwise(message)


def markdown_class(line: Column) -> Column:
    """Struct (kind, text) of one line of a chat message; headings, bullets, paragraphs and blanks."""
    t = strip(line)
    bullet = (t.startswith("*") & ~t.startswith("**")) | (t.startswith("-") & ~t.startswith("--"))
    kind = F.when(t.startswith("### "), "h3").when(t.startswith("## "), "h2").when(t.startswith("# "), "h1").when(bullet, "bullet").when(t == "", "blank").otherwise("paragraph")
    body = F.when(kind.isin("h1", "h2", "h3"), F.regexp_replace(t, "^#+ ", "")).when(kind == "bullet", strip(F.substring(t, F.lit(2), F.length(t)))).otherwise(t)
    return F.struct(kind.alias("kind"), body.alias("text"))


def markdown_lines(text: Column) -> Column:
    """Array of (kind, text) of a message's lines; a blank last line is dropped, an empty text has none."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    # the last line is looked at by itself, so that no line is classed more than once within the array
    blank = markdown_class(F.element_at(lines, -1))["kind"] == "blank"
    return F.transform(F.when(blank, F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines), markdown_class)


def bold_parts(text: Column) -> Column:
    """Array of (bold, text): the parts of a line, cut at ``**...**`` spans; empty parts are dropped.

    ``**name:** **`` is mended to ``**name:**`` first. Marks without a partner are plain text.
    """
    mended = F.regexp_replace(text, r"\*\*([^*]+):\*\*\s*\*\*", "**$1:**")
    span = r"\*\*[^*]+\*\*"
    plain, bold = F.split(mended, span, -1), F.regexp_extract_all(mended, F.lit(span), F.lit(0))
    part = lambda is_bold, x: F.struct(F.lit(is_bold).alias("bold"), x.alias("text"))
    pairs = F.zip_with(plain, bold, lambda p, b: F.array(part(False, p), part(True, F.substring(b, F.lit(3), F.length(b) - 4))))
    return F.filter(F.flatten(pairs), lambda x: F.coalesce(x["text"], F.lit("")) != "")


def valid_thread_id(text: Column) -> Column:
    """Whether a text is a UUID: 32 hexadecimal digits, with or without dashes, braces and the urn prefix."""
    bare = F.regexp_replace(F.btrim(F.regexp_replace(text, "urn:|uuid:", ""), F.lit("{}")), "-", "")
    return F.coalesce(bare.rlike("^[0-9a-fA-F]{32}$"), F.lit(False))


def upload_message(n_files: Column, first_name: Column) -> Column:
    """Struct (content, file_name): what the user is shown to have asked with an upload."""
    many = n_files > 1
    # Fixed values
    content = F.when(many, F.concat(F.lit("Please analyze these procurement documents ("), n_files.cast("string"), F.lit(" files)"))).otherwise("Please analyze this procurement document")
    name = F.when(many, F.concat(first_name, F.lit(" +"), (n_files - 1).cast("string"), F.lit(" more"))).otherwise(first_name)
    return F.struct(content.alias("content"), name.alias("file_name"))


def follow_up(status: Column) -> Column:
    """The question that is asked after a verdict, by its status."""
    return F.when(status == "FAIL", "Which steps, in which order, would mend the findings and reach compliance?").otherwise("How is compliance kept up, and what else is good practice here?")


def http_error(status: Column, status_text: Column, body: Column) -> Column:
    """The text of a failed response: its error, else its detail, else the status line."""
    said = lambda key: F.nullif(F.get_json_object(body, f"$.{key}"), F.lit(""))
    return F.coalesce(said("error"), said("detail"), F.concat(F.lit("HTTP "), status.cast("string"), F.lit(": "), status_text))


def presentation_title(thread: Column) -> Column:
    """A presentation is named after the first 8 characters of its session."""
    return F.concat(F.lit("Procurement Analysis Report - "), prefix(thread, 8))


def presentation_link(response: Column, base: str) -> Column:
    """The address in a presentation service's JSON answer: url, webUrl, docUrl, or built from the id; null if it has none."""
    said = lambda key: F.get_json_object(response, f"$.{key}")
    return F.coalesce(said("url"), said("webUrl"), said("docUrl"), F.concat(F.lit(base.rstrip("/") + "/"), said("id")))
