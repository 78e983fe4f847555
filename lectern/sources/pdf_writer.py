"""PDF files of plain lines, as reports are handed out."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

#: The page in points, its margins, the size of the text and the distance of lines.
PAGE, LEFT, TOP, SIZE, LEADING = (595, 842), 40, 800, 10, 12
#: Every code is a UTF-16 unit, so any text can be read back.
_UNICODE = b"""/CIDInit /ProcSet findresource begin 12 dict begin begincmap /CMapName /Units def /CMapType 2 def
1 begincodespacerange <0000> <FFFF> endcodespacerange
1 beginbfrange <0000> <FFFF> <0000> endbfrange
endcmap end end"""


def pdf_bytes(pages: list[list[str]], title: str = "") -> bytes:
    """A file with the lines of each page, one below the other."""
    out, places = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), {}

    def put(number: int, body: bytes) -> None:
        places[number] = len(out)
        out.extend(b"%d 0 obj\n%b\nendobj\n" % (number, body))

    def stream(data: bytes) -> bytes:
        packed = zlib.compress(data, 1)
        return b"<< /Length %d /Filter /FlateDecode >>\nstream\n%b\nendstream" % (len(packed), packed)

    heads = range(7, 7 + 2 * len(pages), 2)
    put(1, b"<< /Type /Catalog /Pages 2 0 R >>")
    put(2, b"<< /Type /Pages /Count %d /Kids [%b] /Resources << /Font << /F 3 0 R >> >> /MediaBox [0 0 %d %d] >>" % (len(pages), b" ".join(b"%d 0 R" % n for n in heads), *PAGE))
    put(3, b"<< /Type /Font /Subtype /Type0 /BaseFont /Helvetica /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 5 0 R >>")
    put(4, b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Helvetica /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /DW 500 >>")
    put(5, stream(_UNICODE))
    put(6, b"<< /Title <FEFF%b> >>" % title.encode("utf-16-be").hex().encode())
    for n, lines in zip(heads, pages):
        put(n, b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (n + 1))
        shown = b" T*\n".join(b"<%b> Tj" % line.encode("utf-16-be", "replace").hex().encode() for line in lines)
        put(n + 1, stream(b"BT /F %d Tf %d TL %d %d Td\n%b\nET" % (SIZE, LEADING, LEFT, TOP, shown)))
    at = len(out)
    out.extend(b"xref\n0 %d\n0000000000 65535 f \n" % (len(places) + 1))
    out.extend(b"".join(b"%010d 00000 n \n" % places[n] for n in sorted(places)))
    out.extend(b"trailer\n<< /Size %d /Root 1 0 R /Info 6 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(places) + 1, at))
    return bytes(out)


def write_pdfs(reports: DataFrame, key: str, pages: str) -> DataFrame:
    """(key, content): a PDF file for each row, whose ``pages`` are arrays of lines. Null pages and lines are empty."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = [[line or "" for line in page or []] for page in batch.column(1)[k].as_py() or []]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([pdf_bytes(found)], pa.binary())], ["key", "content"])

    named = reports.select(F.col(key).alias("key"), pages)
    return named.mapInArrow(written, StructType([StructField("key", named.schema["key"].dataType), StructField("content", BinaryType())])).withColumnRenamed("key", key)
