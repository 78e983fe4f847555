"""Search, brand names, merges of partial results and PDF texts against plain loops."""

import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from lectern.operators import analysis, brands, search
from lectern.plans.queries import ORACLES, QUERIES
from lectern.sources import pdf, pdf_text
from lectern.sources.pdf_writer import pdf_bytes, write_pdfs
from pyspark.sql import functions as F

# --- search ------------------------------------------------------------------------------------------


def best_pages(pages, queries, top):
    """BM25 of every page for every query."""
    terms = {p: [t for t in re.split(r"[\W_]+", (x or "").lower()) if t] for p, x in pages}
    df = Counter(t for own in terms.values() for t in set(own))
    mean = sum(map(len, terms.values())) / max(len(terms), 1)
    out = []
    for q, words in queries:
        scores = {}
        for p, own in terms.items():
            tf = Counter(own)
            for t in {t for t in re.split(r"[\W_]+", (words or "").lower()) if t} & set(own):
                idf = math.log(1 + (len(terms) - df[t] + 0.5) / (df[t] + 0.5))
                scores[p] = scores.get(p, 0) + math.floor(search.STEPS * idf * tf[t] * (search.K1 + 1) / (tf[t] + search.K1 * (1 - search.B + search.B * len(own) / mean)))
        out += [(q, p, s, k + 1) for k, (p, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:top])]
    return sorted(out)


@pytest.mark.parametrize("top", [1, 3, 50])
def test_the_best_pages(spark, top):
    rng = random.Random(top)
    words = ["the"] * 20 + ["Fan", "fan", "été", "日本", "x1", "pump", "pipe", "r2d2"]
    pages = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for k in range(80)] + [(90 + k, "same text here") for k in range(9)] + [(200, None), (201, ""), (202, "pump " * 5000)]
    queries = [(1, "The pump, the PIPE!"), (2, "same here"), (3, ""), (4, None), (5, "nowhere"), (6, "the"), (7, "日本 été x1 x1")]
    table = spark.createDataFrame([(*p, 1, 2) for p in pages], "id long, body string, score int, term int").repartition(4)
    asked = spark.createDataFrame(queries, "q long, words string")
    assert sorted(map(tuple, search.top_pages(table, asked, "id", "body", "q", "words", top).collect())) == best_pages(pages, queries, top)
    assert search.top_pages(table.limit(0), asked, "id", "body", "q", "words").count() == 0
    assert search.top_pages(table, asked.limit(0), "id", "body", "q", "words").count() == 0


@pytest.mark.parametrize("asked_bound", [search.ASKED, 0])
def test_a_search_task_keeps_a_bounded_number_of_sums(spark, monkeypatch, asked_bound):
    """As many tasks as the sums of pages and queries need, however many shuffle partitions there are; with queries broadcast or joined."""
    monkeypatch.setattr(search, "PAIRS", 40)
    monkeypatch.setattr(search, "ASKED", asked_bound)
    rng = random.Random(5)
    pages = [(k, " ".join(rng.choices(["the", "a", "b", "c", "c c", "d", ""], k=rng.randrange(0, 9)))) for k in range(150)]
    queries = [(k, " ".join(rng.choices(["the", "a", "b", "d", "e"], k=3))) for k in range(12)]
    table, asked = spark.createDataFrame(pages, "id long, body string"), spark.createDataFrame(queries, "q long, words string")
    found = search.top_pages(table, asked, "id", "body", "q", "words")
    assert sorted(map(tuple, found.collect())) == best_pages(pages, queries, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = [(by, int(n)) for by, n in re.findall(r"Exchange hashpartitioning\((.*?), (\d+)\), REPARTITION_BY_NUM", plan)]
    assert dealt and all(n > 20 for _, n in dealt)
    if asked_bound:
        assert all(by.startswith("page#") for by, _ in dealt) and not re.search(r"hashpartitioning\(query#\d+L, page#", plan)


def test_plan_of_search(spark):
    """Nothing is scored but pages that share a term with a query."""
    pages = spark.createDataFrame([(k, f"word{k} common") for k in range(50)], "id long, body string")
    plan = search.top_pages(pages, spark.createDataFrame([(1, "word3")], "q long, words string"), "id", "body", "q", "words")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "WindowGroupLimit" in plan


def test_page_text_and_market_data(spark):
    html = "<p>a&amp;lt; <!-- no\n --><script type='x'>var a = '<b>';</script>b<br>c</p><style>p{}</style>&quot;d&quot; &#39;"
    found = spark.createDataFrame([(1, html), (2, None)], "k int, html string").select("k", search.page_text(F.col("html")).alias("t"))
    assert {r.k: r.t.split() for r in found.collect()} == {1: ["a&lt;", "b", "c", '"d"', "'"], 2: []}
    hits = spark.createDataFrame([(1, 10, 5, 1), (1, 11, 4, 2)], "q int, page int, score long, rank int")
    pages = spark.createDataFrame([(10, "T", "x" * 300), (11, None, None)], "page int, title string, body string")
    assert search.market_data(hits, pages, "q", "page", "title", "body").first().market_data == f"Search results:\n- T: {'x' * 200}\n- : \n"


# --- brands ------------------------------------------------------------------------------------------


def mentions(documents, names):
    lower = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x or "")
    names = {" ".join(lower(n).split()) for n in names} - {""}
    out = []
    for key, text in documents:
        for number, clause in enumerate(re.split(r"[.;\n]+", lower(text))):
            words = [w for w in (w.strip(",:()[]\"'!?") for w in re.split(r"[ \t\n\x0b\f\r]+", clause)) if w]
            open_ = bool(re.search(r"\bor (an )?(approved )?(equivalent|equal)\b", clause))
            for name in names:
                n = sum(words[k : k + len(name.split())] == name.split() for k in range(len(words)))
                if n:
                    out.append((key, number, name, n, open_))
    return sorted(out)


@pytest.mark.parametrize("bound", [brands.BOUND, 0])
def test_brands(spark, bound):
    rng = random.Random(3)
    names = ["Acme", "acme pump", "ACME  Pump X-1", "b#2", "b#25", "Größe", "a", "a a", "", None, " "]
    words = ["acme", "Acme", "pump", "PUMP,", "(x-1)", "X-1", "b#2", "b#25.", "größe", "Größe", "a", "or equivalent", "or an equal", "or an approved equivalent", "orequivalent", ";", "\n", "the", '"acme"']
    documents = [(k, " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for k in range(150)] + [(900, None), (901, ""), (902, "acme pump " * 20_000)]
    table = spark.createDataFrame([(*d, "x", 2) for d in documents], "doc long, body string, brand string, n int").repartition(3)
    known = spark.createDataFrame([(n,) for n in names], "name string")
    got = brands.brand_mentions(table, known, "doc", "body", "name", bound)
    assert sorted(map(tuple, got.collect())) == mentions(documents, [n for n in names if n])
    summary = {r.doc: (r.n_brands, r.n_restrictive, r.severity) for r in brands.restrictive(got, "doc").collect()}
    for doc in {d for d, *_ in mentions(documents, [n for n in names if n])}:
        own = [m for m in mentions([d for d in documents if d[0] == doc], [n for n in names if n])]
        closed = {m[2] for m in own if not m[4]}
        assert summary[doc] == (len({m[2] for m in own}), len(closed), "high" if closed else "low")
    assert brands.brand_mentions(table.limit(0), known, "doc", "body", "name", bound).count() == brands.brand_mentions(table, known.limit(0), "doc", "body", "name", bound).count() == 0


def test_equal_lines_of_an_order_stand_in_the_order_of_their_texts(spark, tmp_path):
    """The SQL leaves open which of two lines of the same order, number and part comes first; here it doesn't hang on how rows are dealt."""
    rng = random.Random(5)
    parts = [(7, "red ring", "Brand#1"), (8, "blue bolt", "Brand#12")]
    lines = [(order, rng.randrange(1, 3), rng.choice((7, 8)), rng.choice("NRA")) for order in range(40) for _ in range(5)]
    said = {"N": "", "R": " or equivalent", "A": ", or an approved equal"}
    wanted = []
    for order in range(40):
        own = sorted((number, part, said[flag]) for o, number, part, flag in lines if o == order)
        wanted += [(order, k, name.lower(), 1, end != "") for k, (_, part, end) in enumerate(own) for p in parts if p[0] == part for name in p[1:]]
    for deal in range(3):
        rng.shuffle(lines)
        folder = f"{tmp_path}/{deal}"
        spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string").repartition(1 + 2 * deal).write.parquet(f"{folder}/lineitem.parquet")
        spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string").write.parquet(f"{folder}/part.parquet")
        assert sorted(map(tuple, QUERIES["brand_mentions"](spark, folder).collect())) == sorted(wanted)


def test_lines_without_a_number_or_name_keep_their_clause(spark, tmp_path):
    """Such a line keeps its other name, and those behind it their number; the SQL also gives a row without a brand, which no text can mention."""
    import duckdb

    parts = [(1, "red ring", "Brand#1"), (2, None, "Brand#2"), (3, "blue bolt", None), (4, None, None)]
    lines = [(10, 1, 2, "N"), (10, 2, 1, "R"), (11, 1, 3, "A"), (11, 3, 1, "N"), (12, None, 1, "R"), (12, 7, 3, "N"), (12, None, 2, "N"), (13, 1, 4, "N"), (13, 2, 1, "N")]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    tables = duckdb.connect()
    for name in ("lineitem", "part"):
        tables.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    named = tables.execute(f"select * from ({ORACLES['brand_mentions']}) where brand is not null").fetchall()
    assert sorted(map(tuple, QUERIES["brand_mentions"](spark, str(tmp_path)).collect())) == sorted(named)
    assert sorted(map(tuple, QUERIES["brand_restrictions"](spark, str(tmp_path)).collect())) == sorted(tables.execute(ORACLES["brand_restrictions"]).fetchall())


# --- merges ------------------------------------------------------------------------------------------


def folded(updates):
    states = defaultdict(dict)
    for thread, _, update in sorted(updates, key=lambda u: (str(u[0]), u[1])):
        try:
            right = json.loads(update or "")
        except ValueError:
            right = {}
        left = states[thread]
        for key, value in (right if isinstance(right, dict) else {}).items():
            left[key] = {**left[key], **value} if isinstance(left.get(key), dict) and isinstance(value, dict) else value
    out = []
    for thread, state in states.items():
        for section, value in state.items():
            if isinstance(value, dict) and value:
                out += [(thread, section, k, v) for k, v in value.items()]
            else:
                out.append((thread, section, None, value))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 7])
def test_updates_are_folded_in_order(spark, parts):
    rng = random.Random(9)
    values = [1, 2.5, "x", "é\"", None, True, [1, {"a": None}], {"deep": {"x": 1}}]
    section = lambda: rng.choice([{}, {rng.choice("abc"): rng.choice(values) for _ in range(2)}, {rng.choice("abc"): rng.choice(values)}, *values[:7]])
    updates = [(rng.choice((1, 2, None)), k, json.dumps({rng.choice("pqr"): section() for _ in range(rng.randrange(3))})) for k in range(400)]
    updates += [(1, 500, None), (1, 501, "[1]"), (2, 502, "no json"), (3, 503, "{}"), (2, 504, "5"), (4, 1, '{"s": {"a": null}}'), (4, 2, '{"s": {"b": 1}}')]
    rng.shuffle(updates)
    table = spark.createDataFrame([(*u, 7) for u in updates], "t long, o long, u string, section int").repartition(parts)
    got = sorted(((r.t, r.section, r.field, json.loads(r.value)) for r in analysis.fold_updates(table, "t", "o", "u").collect()), key=str)
    assert got == folded(updates)


# --- PDF ---------------------------------------------------------------------------------------------

PAGES = [["One line", "émile ß – 日本 😀"], [], ["  spaces  kept ", "x" * 500], ["(brackets) \\ <hex>"]]


def test_written_pages_are_read():
    assert pdf_text.read_pdf(pdf_bytes(PAGES, "A title é")) == (["\n".join(p) for p in PAGES], {"title": "A title é", "author": "", "subject": "", "creator": ""})
    assert list(pdf_text.page_texts(pdf_bytes([]))) == []


def _file(objects, trailer=b"<< /Root 1 0 R >>", table=True):
    out, places = bytearray(b"%PDF-1.4\n"), []
    for k, body in enumerate(objects):
        places.append(len(out))
        out += b"%d 0 obj %b endobj\n" % (k + 1, body)
    at = len(out)
    if table:
        out += b"xref\n0 %d\n0000000000 65535 f \n%b" % (len(objects) + 1, b"".join(b"%010d 00000 n \n" % p for p in places))
    return bytes(out + b"trailer " + trailer + b"\nstartxref\n%d\n%%%%EOF" % (at if table else 7))


def _stream(data, more=b""):
    return b"<< /Length %d %b >> stream\n%b\nendstream" % (len(data), more, data)


CONTENT = rb"""q BT /F1 12 Tf 1 0 0 1 50 700 Tm (Hello \(w\157rld\)) Tj 0 -14 Td [(Ge) 20 (ns) -400 (gap)] TJ T* 14 TL (A\
B) ' 3 1 (C D) " ET Q BT /F1 12 Tf 50 600 Td <41 42 4> Tj ET
BI /W 1 /H 1 ID abc EI BT /F2 10 Tf 50 500 Td (a\001b) Tj ET /X1 Do BT /F1 12 Tf 300 500 Td (right) Tj ET"""
WANT = "Hello (world)\nGens gap\nAB\nC D\nAB@\naéb\nform\nright"


def _objects(content, more=b""):
    return [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F1 5 0 R /F2 6 0 R >> /XObject << /X1 7 0 R >> >> >>",
        b"<< /Type /Page /Parent 2 0 R /Contents [4 0 R] >>", _stream(content, more),
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>", b"<< /Type /Font /Subtype /Type1 /Encoding << /Differences [1 /eacute] >> >>",
        _stream(b"BT /F1 9 Tf 50 450 Td (form) Tj ET", b"/Type /XObject /Subtype /Form"),
    ]


def test_operators_and_filters():
    import base64

    want = [WANT]
    assert list(pdf_text.page_texts(_file(_objects(CONTENT)))) == want
    for data, name in ((zlib.compress(CONTENT), b"/FlateDecode"), (CONTENT.hex().encode() + b">", b"/ASCIIHexDecode"), (base64.a85encode(CONTENT) + b"~>", b"/ASCII85Decode"), (base64.a85encode(zlib.compress(CONTENT)) + b"~>", b"[/ASCII85Decode /FlateDecode]")):
        assert list(pdf_text.page_texts(_file(_objects(data, b"/Filter " + name)))) == want
    width = 7
    rows = CONTENT + b" " * (-len(CONTENT) % width)
    for how in range(3):
        last, out = bytes(width), b""
        for at in range(0, len(rows), width):
            row = rows[at : at + width]
            out += bytes([how]) + bytes((c - (row[k - 1] if how == 1 and k else last[k] if how == 2 else 0)) & 255 for k, c in enumerate(row))
            last = row
        assert list(pdf_text.page_texts(_file(_objects(zlib.compress(out), b"/Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 7 >>")))) == want


def test_broken_cross_references_are_searched():
    whole = _file(_objects(CONTENT))
    for broken in (_file(_objects(CONTENT), table=False), whole.replace(b"startxref", b"startxxxx"), re.sub(rb"\d{10} 00000 n", b"0000000003 00000 n", whole), whole.replace(b"/Length", b"/Lengte")):
        assert list(pdf_text.page_texts(broken)) == [WANT]


def test_compressed_objects():
    own = _objects(CONTENT)
    packed = {1: own[0], 2: own[1], 3: own[2], 5: own[4], 6: own[5]}
    heads, body = [], b""
    for n, o in packed.items():
        heads.append(b"%d %d" % (n, len(body)))
        body += o + b" "
    head = b" ".join(heads) + b" "
    out, places = bytearray(b"%PDF-1.5\n"), {}
    for n, o in ((4, own[3]), (7, own[6]), (8, _stream(zlib.compress(head + body), b"/Type /ObjStm /N %d /First %d /Filter /FlateDecode" % (len(packed), len(head))))):
        places[n] = len(out)
        out += b"%d 0 obj %b endobj\n" % (n, o)
    at = len(out)
    rows = b"\0\0\0\0"
    for n in range(1, 10):
        rows += b"\2\0\x08" + bytes([list(packed).index(n)]) if n in packed else b"\1" + (places.get(n, at)).to_bytes(2, "big") + b"\0"
    out += b"9 0 obj " + _stream(zlib.compress(rows), b"/Type /XRef /Size 10 /W [1 2 1] /Root 1 0 R /Filter /FlateDecode") + b" endobj\nstartxref\n%d\n%%%%EOF" % at
    assert list(pdf_text.page_texts(bytes(out))) == [WANT]
    assert list(pdf_text.page_texts(bytes(out).replace(b"startxref", b"startxxxx"))) == [WANT]


@pytest.mark.parametrize("content,why", [(b"", "header"), (b"words", "header"), (b"%PDF-1.4\nnothing", "catalog"), (_file(_objects(CONTENT), b"<< /Root 1 0 R /Encrypt 9 0 R >>"), "encrypted"), (_file(_objects(CONTENT, b"/Filter /Secret")), "Secret")])
def test_files_that_cannot_be_read(content, why):
    with pytest.raises(pdf_text.Broken, match=why):
        list(pdf_text.page_texts(content))


def test_damaged_files_end():
    """Whatever a byte is changed to, reading ends, with texts or an error that names the fault."""
    rng = random.Random(6)
    for whole in (_file(_objects(CONTENT)), pdf_bytes(PAGES)):
        for _ in range(400):
            data = bytearray(whole)
            for _ in range(rng.randrange(1, 6)):
                at = rng.randrange(len(data))
                data[at : at + rng.randrange(3)] = bytes(rng.choices(b"<>[]()/ 0123456789R%\xff", k=rng.randrange(3)))
            try:
                list(pdf_text.page_texts(bytes(data)))
            except Exception as error:  # noqa: BLE001
                assert not isinstance(error, (RecursionError, MemoryError))


def test_pages_of_tables(spark):
    rows = [(1, pdf_bytes(PAGES)), (1, pdf_bytes([["again"]])), (2, b"broken"), (3, None), (None, pdf_bytes([["no key"]])), (5, pdf_bytes([])), (6, pdf_bytes([[f"page {k}"] for k in range(600)]))]
    table = spark.createDataFrame([(k, c, 0) for k, c in rows], "file long, content binary, page_no int").repartition(3)
    got = Counter((r.file, r.page_no, r.text, r.error) for r in pdf.read_pages(table, "file").collect())
    want = Counter((1, k + 1, "\n".join(p), None) for k, p in enumerate(PAGES)) + Counter([(1, 1, "again", None), (None, 1, "no key", None)]) + Counter((6, k + 1, f"page {k}", None) for k in range(600))
    assert got == want + Counter([(2, None, None, "Failed to parse PDF: no PDF header"), (3, None, None, "Failed to parse PDF: no PDF header")])
    assert pdf.read_pages(table.limit(0), "file").count() == 0
    made = write_pdfs(spark.createDataFrame([(1, [["a", None], None]), (2, None)], "k int, pages array<array<string>>"), "k", "pages").collect()
    assert {r.k: list(pdf_text.page_texts(bytes(r.content))) for r in made} == {1: ["a\n", ""], 2: []} or {r.k: list(pdf_text.page_texts(bytes(r.content))) for r in made} == {1: ["a", ""], 2: []}


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.pdf").write_bytes(pdf_bytes([["a"], ["b"]], "T"))
    (tmp_path / "sub" / "b.PDF").write_bytes(b"%PDF-1.4 nothing in it")
    found = {r.path.rsplit("/", 1)[1]: r for r in pdf.read_pdfs(pdf.pdf_files(spark, str(tmp_path))).collect()}
    assert (found["a.pdf"].n_pages, found["a.pdf"].title, found["a.pdf"].text) == (2, "T", "--- Page 1 ---\na\n\n--- Page 2 ---\nb")
    assert found["b.PDF"].error == "Failed to parse PDF: no catalog" and found["b.PDF"].text is None


def test_folding_broadcasts_nothing(spark):
    table = spark.createDataFrame([(1, 1, '{"a": {"x": 1}, "b": {}}'), (2, 1, '{"a": 5}')], "t int, o int, u string")
    found = analysis.fold_updates(table, "t", "o", "u")
    assert len(found.collect()) == 3
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_lines_of_a_page_are_read_at_once(monkeypatch):
    calls, value = [0], pdf_text.Lexer.value

    def counted(self, depth=0):
        calls[0] += 1
        return value(self, depth)

    monkeypatch.setattr(pdf_text.Lexer, "value", counted)
    lines = [f"line {k} é" for k in range(1000)]
    assert list(pdf_text.page_texts(pdf_bytes([lines]))) == ["\n".join(lines)]
    assert calls[0] < 500


def test_common_tokens_are_read_like_others():
    lexer = pdf_text.Lexer(b"%Tj <41> BT\n<4 1> <414><> Tj T*[true]null%x")
    assert [lexer.value() for _ in range(8)] == [b"A", b"A@", b"", b"Tj", b"T*", [True], None, pdf_text.END]
    assert isinstance(lexer.value(), pdf_text.Word)
