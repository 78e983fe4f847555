import json
import re

import pytest
from conftest import SMALL, same_rows
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.strict_json import flat_content, strict_json
from lectern.operators import analysis, assemble, chat, model, progress, review, verdict
from lectern.plans.queries import ORACLES, QUERIES
from lectern.sources import intake, pdf
from lectern.sources.settings import Settings
from lectern.sources.shared import shared_folder
from lectern.streaming import events

FENCE = T.FENCE


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, oracle, name):
    same_rows(QUERIES[name](spark, SMALL).toPandas(), oracle.sql(ORACLES[name]).df())


def test_stream_equals_batch(spark):
    got = QUERIES["stream_log_tail"](spark, SMALL)
    assert got.count() == got.select("event_id").distinct().count() == spark.read.parquet(f"{SMALL}/events.parquet").count()


def test_stream_of_part_files_in_any_order(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.unionByName(events.limit(50)).repartitionByRange(130, events.ts.desc()).write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["stream_log_tail"](spark, str(tmp_path))
    assert got.count() == got.select("event_id").distinct().count() == events.select("event_id").distinct().count()


def _column(spark, values, f):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x string")
    return [r[0] for r in rows.orderBy("k").select(f(F.col("x"))).collect()]


def test_fences(spark):
    cases = {
        f'pre {FENCE}json\n{{"a":1}}\n{FENCE} post': '{"a":1}', f'{FENCE}\n{{"a":1}}\n{FENCE}': '{"a":1}', f'{FENCE}python\n{{"a":1}}\n{FENCE}': 'python\n{"a":1}',
        f'{FENCE}json\n{{"a":1}}': '{"a":1}', ' {"a":1} ': ' {"a":1} ', f"A {FENCE}jsonx{FENCE} B {FENCE}jsony{FENCE}": "x",
    }
    assert _column(spark, cases, T.fenced_body) == list(cases.values())


def test_strict_json(spark):
    texts = ['{"a": 1}', '{"a": 1} x', "{'a': 1}", '{"a": 1,}', "[1]", "5", "null", "", "words", '{"a": 1, "a": 2}', None]

    def python(x):
        try:
            return json.dumps(json.loads(x), separators=(",", ":"))
        except (TypeError, ValueError):
            return None

    assert _column(spark, texts, strict_json) == [python(x) for x in texts]


def test_file_names(spark):
    cases = {"../we ird.pdf": "we_ird.pdf", ".hidden.pdf": "hidden.pdf", "a\\b.pdf": "a_b.pdf", "é.pdf": "_.pdf", "...": "document.pdf", "": "document.pdf", "dir/": "dir"}
    cases["a" * 300 + ".pdf"] = "a" * 200 + "a" * 46 + ".pdf"
    assert _column(spark, cases, T.safe_filename) == list(cases.values())


def test_intake(spark):
    rows = [(1, "a.PDF", None), (2, "a.pdf", "application/pdf; x=1"), (3, "a.txt", ""), (4, "a.pdf", "text/plain"), (5, None, None)] + [(6, "a.pdf", "")] * 4
    got = intake.intake_gate(spark.createDataFrame(rows, "b int, n string, t string"), "b", "n", "t")
    assert {r.b for r in got.collect() if r.accepted} == {1, 2}
    sizes = spark.createDataFrame([(b"%PDF" + b"x" * 95,), (b"%PDF" + b"x" * 96,), (b"PK" + b"x" * 198,), (b"%PDF" + b"x" * (50 * 1024 * 1024 - 3),)], "c binary")
    assert [r[0] for r in sizes.select(intake.valid_bytes(F.col("c"))).collect()] == [False, True, False, False]


def test_stored_names(spark):
    rows = [("t", 1, "a.pdf"), ("t", 2, "a.pdf"), ("t", 3, "a_1.pdf"), ("u", 1, "a.pdf"), ("u", 2, "a.pdf"), ("u", 3, "a.pdf"), ("v", 1, "x.PDF"), ("v", 2, "x.PDF"), ("w", 1, ".pdf"), ("w", 2, ""), ("w", 3, "a.tar.gz")]
    got = intake.stored_names(spark.createDataFrame(rows, "t string, o int, n string"), "t", "o", "n")
    assert {(r.t, r.o): r.stored for r in got.collect()} == {
        ("t", 1): "a.pdf", ("t", 2): "a_1.pdf", ("t", 3): "a_1_1.pdf", ("u", 1): "a.pdf", ("u", 2): "a_1.pdf", ("u", 3): "a_2.pdf", ("v", 1): "x.PDF", ("v", 2): "x_1.PDF",
        ("w", 1): "pdf.pdf", ("w", 2): "document_2.pdf", ("w", 3): "a.tar.pdf",
    }


def test_merge_maps(spark):
    row = spark.sql("select map('s', map('a', 1, 'b', 1)) l, map('s', map('a', cast(null as int)), 't', map('c', 3)) r")
    assert row.select(analysis.merge_maps(F.col("l"), F.col("r"))).first()[0] == {"s": {"a": None, "b": 1}, "t": {"c": 3}}


def test_frames_and_lanes(spark):
    frames = [": c\r\nevent: a\r\nevent: b\r\ndata: 1\r\ndata:2", "data: x", ""]
    assert [tuple(x) for x in _column(spark, frames, chat.parse_frame)] == [("b", "1\n2"), ("message", "x"), ("message", None)]
    logs = spark.createDataFrame([(1, "t", "PDF", "m1"), (2, "t", "PDF", "m2"), (3, "t", "Spec", "m3"), (4, "t", "Spec", "m4")], "seq long, t string, agent string, message string")
    got = {r.agent: (r.message, r.lane, r.status) for r in progress.agent_lanes(logs, "t", "agent").collect()}
    assert got == {"PDF": ("m2", 1, "complete"), "Spec": ("m4", 2, "active")}


def test_json_that_cannot_be_read(spark):
    """Nesting without end and numbers without end take the second fallback; other bad JSON the first."""
    rows = [(0, "spec_check", "[" * 200_000, None), (1, "green", "9" * 5000, None), (2, "lcca", "{'a': 1}", None), (3, "lcca", "[1]", "timeout"), (4, "compliance", None, None), (5, "lcca", "[NaN]", None), (6, "lcca", '{"severity": "high"}', None)]
    got = {r.k: r for r in analysis.recover(spark.createDataFrame(rows, "k int, analyzer string, response string, error string")).collect()}
    assert [got[k].parsed for k in range(7)] == [False] * 5 + [True] * 2
    assert [got[k].severity for k in range(7)] == ["high", "medium", "medium", "high", "low", None, "high"]
    assert json.loads(got[0].record)["issues"][0].startswith("Analysis error: maximum recursion") and json.loads(got[3].record)["missing_considerations"] == ["Analysis error: timeout"]
    for k, analyzer, *_ in rows[:5]:
        at = 2 if k in (0, 1, 3) else 1
        want = {name: v[at] for name, v in analysis.RECORDS[analyzer].items()}
        assert {n: v for n, v in json.loads(got[k].record).items() if "error: " not in str(v)} == {n: v for n, v in want.items() if "{}" not in str(v)}


def test_compiled_verdicts(spark):
    answers = ['Sure: {"status":"PASS","title":"t"} ok', f'x {FENCE}json\n {{"status": "F", "title": ""}} {FENCE}', '{"status":"PASS"}', "no json", "[1]", "5", '["status", "title"]', "[" * 200_000, None]
    rows = spark.createDataFrame([(k, a) for k, a in enumerate(answers)], "k int, response string").withColumn("error", F.lit(None).cast("string"))
    got = [r.verdict for r in verdict.compile_verdicts(rows).orderBy("k").collect()]
    titles = ["t", "", "Analysis Incomplete", "Analysis Incomplete", "Analysis Incomplete", "System Error During Analysis", None, "System Error During Analysis", "Analysis Incomplete"]
    assert [v.title if v else None for v in got] == titles
    assert [v.confidence for v in got if v and v.findings] == [50, 50, 50, 0, 0, 50]


def test_bold_and_markdown(spark):
    parts = lambda x: [(p.bold, p.text) for p in x]
    cases = {"a ** b": [(False, "a ** b")], "**x:** ** y": [(True, "x:"), (False, " y")], "p **q** r": [(False, "p "), (True, "q"), (False, " r")], "": []}
    assert [parts(x) for x in _column(spark, cases, T.bold_parts)] == list(cases.values())
    lines = {"# H": ["h1"], "#H": ["paragraph"], "* x\n\n": ["bullet", "blank"], "***x": ["paragraph"], "---": ["paragraph"], "": [], "a\n\nb\n  ": ["paragraph", "blank", "paragraph"]}
    assert [[c.kind for c in x] for x in _column(spark, lines, T.markdown_lines)] == list(lines.values())


def test_contents(spark):
    cases = {None: "", '"a"': "a", '[{"text": "b"}, {"content": ["c", null]}, 5, true]': "bc5True", '{"text": 1}': "", "plain": "plain", "[" * 200_000: "[" * 200_000}
    assert _column(spark, cases, flat_content) == list(cases.values())


def test_model_is_asked_once_for_equal_prompts(spark):
    asked = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            asked.add(len(b))
            yield b[["prompt_hash"]].assign(response=b["prompt"].str.upper(), error=None)

    rows = spark.createDataFrame([(k, f"p{k % 3}") for k in range(30)], "k int, prompt string")
    got = model.run_model(rows, count)
    assert {(r.k, r.response) for r in got.collect()} == {(k, f"P{k % 3}") for k in range(30)} and got.count() == 30 and asked.value == 3
    replayed = model.stub_model(spark.createDataFrame([(1, "r", None)], "k int, response string, error string"), rows, ["k"])
    assert {r.k: (r.response, r.error) for r in replayed.where("k < 3").collect()} == {0: (None, "no answer recorded"), 1: ("r", None), 2: (None, "no answer recorded")}


def test_template_values_are_not_looked_at_again(spark):
    assert _column(spark, ["{query} %s"], lambda c: model.chat_prompt(c, F.lit("{document}"), F.lit("q")))[0].count("q\n") == 1


def test_chat_stream_equals_batch(spark, tmp_path):
    rows = [("m", -1, "start", None, 5), ("m", 0, "delta", "He", 6), ("m", 1, "delta", "", 6), ("n", -1, "start", None, 7), ("m", 2, "delta", "llo", 8), ("m", 3, "complete", None, 9), ("n", 0, "delta", "x", 9), ("n", 1, "gone", None, 9), ("o", -1, "start", None, 1), ("o", 0, "error", "died", 2)]
    schema = "message_id string, seq long, kind string, delta string, timestamp long"
    for k in range(0, len(rows), 3):  # several micro-batches
        spark.createDataFrame(rows[k : k + 3], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    events.chat_sink(stream, f"{tmp_path}/out", once=True).awaitTermination()
    got = sorted((json.loads(r.data)["message_id"], r.seq, r.event, r.data) for r in events.events_of(spark, f"{tmp_path}/out").collect())
    assert [(m, e) for m, _, e, _ in got] == [("m", "chat_start"), ("m", "chat_delta"), ("m", "chat_delta"), ("m", "chat_complete"), ("n", "chat_start"), ("n", "chat_delta"), ("o", "chat_start"), ("o", "error")]
    assert json.loads(got[3][3])["response"] == "Hello" and json.loads(got[-1][3])["error"] == "died"


def test_replayed_log_stream_is_the_same(spark, tmp_path):
    """A reconnect reads from the start again: after removal of repeated ids nothing changes."""
    logs = spark.read.parquet(f"{SMALL}/events.parquet").select(F.col("event_id").alias("seq"), "user_id")
    to_events = lambda batch: batch.select("user_id", "seq", chat.event("thinking_log", id=F.col("seq")).alias("e")).select("user_id", "seq", "e.*")
    for _ in range(2):
        logs.write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(logs.schema).parquet(f"{tmp_path}/in")
    events.event_sink(stream, to_events, f"{tmp_path}/out", once=True).awaitTermination()
    sent = events.events_of(spark, f"{tmp_path}/out").drop("batch")
    assert sent.count() == 2 * logs.count() and progress.first_by_id(sent, "seq", "user_id").count() == logs.count()


def test_sessions_time_out_on_the_clock(spark, tmp_path):
    import time

    spark.createDataFrame([("a", False), ("b", False), ("b", True)], "thread string, over boolean").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("thread string, over boolean").parquet(f"{tmp_path}/in")
    query = events.timeouts(stream, "thread", "over", seconds=2).writeStream.format("memory").queryName("timed").outputMode("append").trigger(processingTime=events.POLL).start()
    try:
        until = time.time() + 60
        while spark.table("timed").count() < 2 and time.time() < until:
            time.sleep(0.5)
        assert {(r.thread, r.event) for r in spark.table("timed").collect()} == {("a", "error"), ("b", "complete")}
    finally:
        query.stop()


def test_pdf_source(spark, tmp_path):
    for name, content in (("a.PDF", b"one|two"), ("b.pdf", b"broken"), ("c.txt", b"x")):
        (tmp_path / name).write_bytes(content)

    def reader(content):
        if content == b"broken":
            raise ValueError("no pages")
        return content.decode().split("|"), {"title": "t"}

    got = {r.path.rsplit("/", 1)[1]: r for r in pdf.read_pdfs(pdf.pdf_files(spark, str(tmp_path)), reader).collect()}
    assert set(got) == {"a.PDF", "b.pdf"} and got["a.PDF"].text == "--- Page 1 ---\none\n\n--- Page 2 ---\ntwo" and (got["a.PDF"].n_pages, got["a.PDF"].title) == (2, "t")
    assert got["b.pdf"].error == "Failed to parse PDF: no pages" and got["b.pdf"].text is None
    text = spark.createDataFrame([("t", None), (None, "e")], "t string, e string").select(assemble.parsed_or_error(F.col("t"), F.col("e"))).collect()
    assert [r[0] for r in text] == ["t", "Error parsing PDF: e"]


def test_settings_and_sessions(spark):
    assert Settings.of(environment={"LECTERN_TIMEOUT_SECONDS": "7", "LECTERN_OTHER": "x"}) == Settings(timeout_seconds=7)
    ids = ["0" * 32, "{12345678-1234-1234-1234-123456789abc}", "urn:uuid:12345678123412341234123456789ABC", "12345", "", None, "z" * 32]
    assert _column(spark, ids, T.valid_thread_id) == [True, True, True, False, False, False, False]
    assert intake.new_threads(spark.range(3)).where(T.valid_thread_id(F.col("thread_id"))).count() == 3
    assert shared_folder(spark) == shared_folder(spark)


def test_the_settings_choose_the_model(spark):
    docs = spark.createDataFrame([(1, "brand X only")], "t int, x string")
    model.register_provider("Mine", lambda documents, thread, text: documents.select(thread, F.lit("lcca").alias("analyzer"), F.upper(text).alias("response"), F.lit(None).cast("string").alias("error")))
    try:
        assert [r.response for r in model.provider_responses(docs, "t", "x", Settings(model_provider="MINE")).collect()] == ["BRAND X ONLY"]
        spark.conf.set("spark.lectern.model_provider", "mine")
        assert model.provider_responses(docs, "t", "x").count() == 1
        spark.conf.unset("spark.lectern.model_provider")
        assert model.provider_responses(docs, "t", "x").count() == 6
        with pytest.raises(ValueError, match="there are mine, rules"):
            model.provider_responses(docs, "t", "x", Settings(model_provider="none"))
    finally:
        del model.PROVIDERS["mine"]


def test_waiting_sessions(spark):
    found = spark.createDataFrame([(1, "PASS"), (2, "FAIL"), (3, "PASS")], "t int, status string").withColumn("state", F.lit(review.AWAITING))
    reviews = spark.createDataFrame([(1, "generate_gamma"), (1, "chat_only"), (2, "chat_only")], "t int, action string")
    assert {(r.t, r.state, r.route) for r in review.resume(found, reviews, "t").collect()} == {(1, "complete", "presentation"), (2, "complete", "end"), (3, "awaiting_review", None)}


def test_incomplete_session_has_a_finding(spark):
    rows = analysis.recover(spark.createDataFrame([(1, "lcca", "{}", None)], "t int, analyzer string, response string, error string"))
    got = verdict.verdicts(analysis.merge_sessions(rows, "t"), "t").first()
    assert (got.status, got.title, got.confidence, got.findings[0].category, got.findings[0].severity) == ("FAIL", "Analysis Incomplete", 50, "System Error", "high")


def test_pages_of_one_url_are_sessions_of_their_own(spark, tmp_path):
    spark.range(30).selectExpr("id AS page_id", "'http://x.org' AS url").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["sessions_existing"](spark, str(tmp_path)).collect()
    assert sorted(r.page_id for r in got) == [k for k in range(30) if k % 5 < 3 and k % 2 == 0]


def test_rules_are_tried_once_a_text(spark):
    docs = spark.range(1).selectExpr("id AS t", "'x' AS x")
    fields = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plan = analysis.recover(model.rules_responses(docs.repartition(2), "t", "x"))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", fields)
    assert plan.lower().count("rlike(") == sum(map(len, model.RULES.values()))


def test_rules_find_what_their_patterns_match(spark):
    parts = ["brand", "MODEL NO", "only", "Exclusively", "must be made by", "or an Equivalent", "or equivalent", "maintenance", "spare parts", "warranty", "ENERGY", "consumables", "operating cost",
             "disposal", "end of life", "budget", "ABC", "contract price", "sole supplier", "Sole Source", "energy-efficient", "energy efficiency", "recycled", "emissions", "low carbon", "domestic preference",
             "local Content", "local supplier", "imported only", "bidding", "shopping", "negotiated", "direct contracting", "split contracts", "splitting of contract"]
    texts = [*parts, *[f"İé {p}, ß" for p in parts], *[p[:-1] for p in parts], *[f"x{p}x" for p in parts], "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "t int, x string")
    for r in model.rules_responses(docs, "t", "x").collect():
        hits = [(s[0] == "-", name) for name, p, s in model.RULES[r.analyzer] if (re.search(p, texts[r.t] or "", re.ASCII) is None) == (s[0] == "-")]
        assert json.loads(r.response)[model._LISTS[r.analyzer]] == [f"{'missing' if w else 'found'}: {name}" for w, name in hits]
