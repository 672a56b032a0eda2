"""Operators on tiny layouts; whole queries are held against SQL by test_queries."""

import os
import random

import pytest
from pyspark.sql import functions as F

from formweave.api import Engine
from formweave.functions.present import table_pivot, value_class
from formweave.functions.sql import aligned
from formweave.operators import edit, extract as X, fields as K, learn as L, phrases as P, rows as R
from formweave.operators.oracle import IMAGE_FIELDS, IMAGE_METADATA, IMAGE_PHRASES, ModelOracle, ReplayOracle, RuleOracle, call_cost, http_model, keyword_prompt, metadata_row_prompt, pair_prompt
from formweave.plans import template as T
from formweave.plans.template import Node
from formweave.sources import artifacts as S
from formweave.streaming.stream import extract_stream, read_phrase_stream

SCHEMA = R.PHRASES


def layout(spark, lines, doc="d", page=1, step=20, width=50):
    """Phrases from rows of (text, column) or texts in columns 0, 1, ..."""
    out = []
    for r, line in enumerate(lines):
        for c, cell in enumerate(line):
            if cell is None:
                continue
            text, at = cell if isinstance(cell, tuple) else (cell, c * 100)
            out.append((doc, len(out), page, text, float(at), float(r * step), float(at + width), float(r * step + 10)))
    return spark.createDataFrame(out, SCHEMA)


FORM = (Node("kv", ("Name", "City"), 0), Node("table", ("A", "B", "C"), 1))
LINES = [["Name", "Ann", "City", "Rome"], ["A", "B", "C"], ["1", "2", "3"], ["4", None, "6"], ["Name", "Bob", "City"], ["A", "B", "C"], ["7", "8", "9"]]


def test_extracts_records_blocks_and_cells(spark):
    cells = X.extract_cells(layout(spark, LINES), FORM)
    table = {(r.record_id, r.row_no, r.key): r.value for r in cells.where("block_type = 'table'").collect()}
    assert table == {(0, 1, "A"): "1", (0, 1, "B"): "2", (0, 1, "C"): "3", (0, 2, "A"): "4", (0, 2, "B"): None, (0, 2, "C"): "6", (1, 1, "A"): "7", (1, 1, "B"): "8", (1, 1, "C"): "9"}
    kv = {(r.record_id, r.key): r.value for r in cells.where("block_type = 'kv'").collect()}
    assert kv == {(0, "Name"): "Ann", (0, "City"): "Rome", (1, "Name"): "Bob", (1, "City"): None}
    nested = {r.id: r.content for r in X.nest(cells).collect()}
    assert [b.type for b in nested[0]] == ["kv", "table"]
    assert nested[0][1].content[1] == {"A": "4", "B": "missing", "C": "6"}
    assert table_pivot(cells, ["A", "B"]).where("record_id = 0 and row_no = 2").first().B == "missing"


def test_inner_table_rows_return_to_the_outer_header(spark):
    nested = (Node("table", ("A", "B", "C"), 0, child=1), Node("table", ("X", "Y"), 1))
    lines = [["A", "B", "C"], ["1", "2", "3"], [("X", 310), ("Y", 410)], [("x", 310), ("y", 410)], ["4", "5", "6"]]
    cells = X.extract_cells(layout(spark, lines), nested).collect()
    assert {(c.block_id, c.row_no, c.key, c.value) for c in cells if c.key in "AX"} == {(0, 1, "A", "1"), (0, 2, "A", "4"), (1, 1, "X", "x")}


def test_boundless_document_and_empty_input(spark):
    lone = layout(spark, [["q", "w"], ["e", "r"]])
    assert X.records(R.visual_rows(lone), FORM).select("record_id").distinct().collect()[0][0] == 0
    assert X.extract_cells(spark.createDataFrame([], SCHEMA), FORM).count() == 0


def test_rows_join_only_if_all_members_overlap(spark):
    rows = [("d", k, 1, t, 0.0, float(a), 1.0, float(b)) for k, (t, a, b) in enumerate((("x", 0, 10), ("y", 5, 12), ("z", 11, 20)))]
    found = R.visual_rows(spark.createDataFrame(rows, SCHEMA)).orderBy("row_id").collect()
    assert [[c.text for c in r.cells] for r in found] == [["x", "y"], ["z"]]


def test_alignment_of_rows(spark):
    """A value under two headers, a header over two values, and values outside of the headers' range do not stand under them."""
    kind = "array<struct<text:string,x0:double,x1:double>>"
    row = lambda *x: [(f"t{i}", float(a), float(b)) for i, (a, b) in enumerate(x)]
    keys = row((0, 10), (20, 30), (40, 50))
    cases = [
        (keys, row((2, 8), (22, 28), (42, 60)), True), (keys, row((2, 8), (45, 50)), True), (keys, row((8, 22)), False), (keys, row((0, 3), (6, 9), (20, 30)), False),
        (keys, row((60, 70), (80, 90), (42, 50)), False), (keys, row((60, 70), (42, 50)), True), (row((0, 10)), row((0, 4), (6, 9)), False), (keys, row((12, 18)), True),
    ]
    frame = spark.createDataFrame([(i, k, v) for i, (k, v, _) in enumerate(cases)], f"i int, k {kind}, v {kind}")
    got = {x.i: x.ok for x in frame.select("i", F.expr(aligned("k", "v")).alias("ok")).collect()}
    assert got == {i: ok for i, (_, _, ok) in enumerate(cases)}


def test_position_matches(spark):
    frame = spark.createDataFrame([([0, 10, 20], [3, 13, 24], True), ([0, 10, 20], [3, 13, 25], False), ([0, 10], [0, 10, 20], False)], "a array<int>, b array<int>, y boolean")
    assert all(r.m == r.y for r in frame.select("y", K.matches(F.col("a"), F.col("b")).alias("m")).collect())
    part = frame.select(K.partial_match(F.col("a"), F.col("b")).alias("m")).collect()
    assert part[2].m


def test_replies_and_costs(spark):
    assert K.clean_reply("name | Foo|CITY", ["Name", "City"]) == ["name", "CITY"]
    assert K.reply_flags("Name|12", ["Name", "12", "x"]) == [1, 0, 0]
    assert K.reply_flags("no", ["Name"]) == [0]
    cost = spark.range(1).select(call_cost(F.lit("gpt-4o-mini"), F.lit(1000), F.lit(100), F.lit(0)).alias("c"), call_cost(F.lit("other"), F.lit(1), F.lit(1), F.lit(0)).alias("d")).first()
    assert cost.c == pytest.approx(0.00054) and cost.d == 0
    oracle = ReplayOracle({keyword_prompt(["Name", "z"]): "name", keyword_prompt(["12"]): "NO", pair_prompt("Name", "Ann"): "Yes", metadata_row_prompt(["Page", "1"]): "no"})
    assert oracle.keywords(["Name", "z"]) == ["Name"] and oracle.keywords(["12"]) == [] and oracle.is_pair("Name", "Ann") and not oracle.is_metadata_row(["Page", "1"])
    paid = oracle.cost
    assert paid > 0 and oracle.is_pair("Name", "Ann") and oracle.cost == paid
    with pytest.raises(KeyError):
        oracle.is_pair("a", "b")
    with pytest.raises(ValueError):
        ReplayOracle({}, "another")


def test_token_counts_of_prompts(spark):
    from formweave.functions.tokens import DEFAULT_RANKS, PATTERN, read_ranks, token_counter

    tiktoken = pytest.importorskip("tiktoken")
    if not os.path.exists(DEFAULT_RANKS):
        pytest.skip("no vocabulary")
    exact = tiktoken.Encoding("x", pat_str=PATTERN, mergeable_ranks=read_ranks(), special_tokens={})
    texts = ["Order Key|Customer", "", None, "it's 12 é\n\n <|endoftext|>", "a b " * 500]
    count = token_counter(spark)
    got = {r.i: r.n for r in spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", count("text").alias("n")).collect()}
    assert got == {i: len(exact.encode_ordinary(t or "")) for i, t in enumerate(texts)}


def test_quantiles():
    assert K.student_quantile(1) == pytest.approx(12.7062047, abs=1e-5)
    assert K.student_quantile(30) == pytest.approx(2.0422725, abs=1e-6)


def test_intervals_of_large_groups(spark):
    frame = spark.range(200 + 201 + 1000).selectExpr("CASE WHEN id < 200 THEN 200 WHEN id < 401 THEN 201 ELSE 1000 END AS g", "CAST(id % 2 AS DOUBLE) AS v")
    for r in K.confidence(frame, ["g"], "v").collect():
        share = r.mean * (1 - r.mean) * r.n / (r.n - 1)
        assert r.half == pytest.approx(K.student_quantile(r.n - 1) * (share / r.n) ** 0.5, rel=1e-8)


def test_labelling_is_optimal():
    r = random.Random(5)
    for _ in range(60):
        n = r.randint(1, 5)
        p = [{t: r.choice([0.001, 0.2, 0.5, 0.9]) + r.random() / 1000 for t in L.TAGS} for _ in range(n)]
        pairs = {(i, j) for i in range(n) for j in range(i + 1, n) if r.random() < 0.4}
        from itertools import product
        from math import log

        def fits(x, pairs=pairs, n=n):
            return all((t != "K" or any((i, j) in pairs and x[j] == "V" for j in range(n))) and (t != "V" or any((j, i) in pairs and x[j] == "K" for j in range(n))) for i, t in enumerate(x))

        value = lambda x, p=p: sum(log(p[i][t]) for i, t in enumerate(x))
        got = L.best_labels(p, pairs)
        assert fits(got)
        assert value(got) == pytest.approx(max(value(x) for x in product(L.TAGS, repeat=n) if fits(x)))


def test_labelling_of_many_rows():
    """Two thousand rows that one header holds together, and sixty that tie in a chain."""
    import time

    p = [{"K": 0.9, "V": 0.001, "KV": 0.05, "M": 0.001}]
    p += [{"K": 0.001, "V": 0.6, "KV": 0.3, "M": 0.001} if k % 7 else {"K": 0.5, "V": 0.4, "KV": 0.1, "M": 0.001} for k in range(1, 2000)]
    start = time.time()
    labels = L.best_labels(p, {(0, j) for j in range(1, 2000)})
    assert labels[0] == "K" and set(labels[1:]) == {"V"} and time.time() - start < 20
    labels = L.best_labels([{"K": 0.5, "V": 0.499, "KV": 0.498, "M": 0.001} for _ in range(60)], {(i, i + 1) for i in range(59)})
    assert labels == ["K", "V"] * 30


def test_scores_of_a_row():
    judge = RuleOracle(frozenset({"Name", "City"}))
    assert L.row_scores(["Name", "Ann", "City", "Rome"], judge) == {"K": 0.5, "V": 0.5, "KV": 1.0} and L.row_scores([], judge) == {"K": 0.0, "V": 0.0, "KV": 0.0}


def test_ties_fall_to_the_label_that_rows_bear_out():
    box = lambda *texts: [(t, 100.0 * k, 100.0 * k + 50) for k, t in enumerate(texts)]
    rows = [box("A", "B", "x"), box("1", "2", "3"), box("A", "q", "B")]
    tie = lambda *top: {t: 0.334 if t in top else 0.001 for t in L.TAGS}
    p = [tie("K", "V"), {"K": 0.001, "V": 1.001, "KV": 0.001, "M": 0.001}, tie("V", "KV")]
    L.refine_ties(rows, p, {(0, 1), (0, 2)}, RuleOracle(frozenset({"A", "B", "x"})))
    assert p[0]["K"] > p[0]["V"] and p[2]["KV"] > p[2]["V"]
    p = [tie("K", "V"), {"K": 0.001, "V": 1.001, "KV": 0.001, "M": 0.001}]
    L.refine_ties(rows[:2], p, set(), RuleOracle(frozenset({"A", "B", "x"})))
    assert p[0]["V"] > p[0]["K"]


def test_a_page_of_many_phrases(spark):
    """Five thousand phrases of one page: rows, neighbours below and merged lines in seconds."""
    import time

    phrases = spark.range(5000).selectExpr("'d' AS doc_id", "CAST(id AS INT) AS phrase_idx", "1 AS page", "concat('t', id) AS text", "CAST(id % 5 * 100 AS DOUBLE) AS x0", "CAST(id div 5 * 20 AS DOUBLE) AS y0", "CAST(id % 5 * 100 + 50 AS DOUBLE) AS x1", "CAST(id div 5 * 20 + 10 AS DOUBLE) AS y1")
    start = time.time()
    assert R.visual_rows(phrases).count() == 1000
    assert P.next_overlaps(phrases).count() == 4995
    assert P.merge_by_distance(phrases, 10.0).count() == 5 and P.merge_by_ground(phrases, ["t0 t5 t10", "x t7"]).count() == 4998
    assert time.time() - start < 60


def test_words_that_drift_part_from_the_first_word(spark):
    """Each word lies 3 below the last: a phrase goes on while its first word is within 4."""
    words = [("d", i, 1, f"w{i}", 30.0 * i, 3.0 * i, 30.0 * i + 25, 3.0 * i + 10) for i in range(6)]
    frame = spark.createDataFrame(words, "doc_id string, word_idx int, page int, text string, x0 double, y0 double, x1 double, y1 double")
    assert [r.text for r in P.words_to_phrases(frame).orderBy("phrase_idx").collect()] == ["w0 w1", "w2 w3", "w4 w5"]
    parity = P.words_to_phrases(frame, parity=True).orderBy("phrase_idx").collect()
    assert [(r.text, r.y0, r.y1, r.x1) for r in parity] == [("w0 w1", 0.0, 10.0, 55.0), ("w2 w3", 6.0, 16.0, 115.0)]


def test_engine_with_a_model_counts_its_cost(spark):
    """Recorded replies for each kind of question; equal questions are paid once, extraction asks nothing."""
    lines = []
    for k in range(8):
        lines += [["Name", f"n{k}a", "City", f"c{k}b"], ["A", "B", "C"], *[[f"{k}{i}1", f"{k}{i}2", f"{k}{i}3"] for i in range(k % 3 + 1)]]
    phrases = layout(spark, lines).withColumn("page", F.expr("1 + CAST(y0 AS INT) div 200"))
    fields = {"Name", "City", "A", "B", "C"}
    asked = []

    def ask(prompt, image):
        asked.append(prompt)
        if image:
            return {IMAGE_FIELDS: "Name|Zip", IMAGE_METADATA: "Head|Foot", IMAGE_PHRASES: "Name|City"}[prompt]
        named = [x for x in prompt.rsplit(": ", 1)[1].split("|") if x in fields]
        return ("|".join(named) or "NO") if prompt.startswith("Which") else "yes" if named[:1] else "no"

    engine = Engine(oracle=ModelOracle(ask))
    cells, template, cost = engine.transform(phrases)
    assert [(n.type, set(n.fields)) for n in template] == [("kv", {"Name", "City"}), ("table", {"A", "B", "C"})] and cost > 0
    before = len(asked)
    assert cells.select("record_id").distinct().count() == 8 and len(asked) == before == len(set(asked))
    assert engine.transform(phrases)[2] == 0.0
    assert engine.predict_field(phrases, image="page.jpg") and engine.oracle.fields_in("page.jpg") == ["Name", "Zip"]
    assert Engine(oracle=ModelOracle(ask)).oracle.phrases_in("page.jpg") == ["Name", "City"] and engine.oracle.metadata_in("p.jpg") == ["Head", "Foot"]
    assert Engine().transform(phrases, vision=["Name"])[2] == 0.0
    with pytest.raises(ValueError):
        Engine().predict_field(phrases, image="page.jpg")


def test_rows_that_a_model_calls_no_header(spark):
    lines = [["Name"], ["Report", "1"], *[["Name", f"v{k}"] for k in range(3)]]
    phrases = layout(spark, lines)
    reply = lambda word: ModelOracle(lambda prompt, image: word if prompt.startswith("Is this row") else "no")
    seen = L.predict_template(phrases, ["Name"], reply("yes"), ["Report 1"])[1]
    assert seen == [["Report", "1"]] and L.predict_template(phrases, ["Name"], reply("no"), ["Report 1"])[1] == []


def test_learns_from_several_documents(spark):
    """A document too short to show every field twice is read on into the next one."""
    head = [["Name", "a", "City", "b"], ["A", "B", "C"], ["1", "2", "3"]]
    two = layout(spark, head, doc="d1").union(layout(spark, head * 3, doc="d2"))
    template = Engine().predict_template(two, ["Name", "City", "A", "B", "C"])
    assert [(n.type, n.fields) for n in template] == [("kv", ("Name", "City")), ("table", ("A", "B", "C"))]
    assert Engine(documents=1).sample(two).select("doc_id").distinct().count() == 1


def test_model_over_http(tmp_path):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            got = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            content = got["messages"][0]["content"]
            text = content if isinstance(content, str) else content[1]["image_url"]["url"][:22]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": f"{got['model']} {text}"}}]}).encode())

        def log_message(self, *args):
            pass

    service = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=service.serve_forever, daemon=True).start()
    (tmp_path / "p.jpg").write_bytes(b"x")
    ask = http_model(f"http://127.0.0.1:{service.server_port}/chat", "key")
    assert ask("hello", None) == "gpt-4o-mini hello" and ask("look", str(tmp_path / "p.jpg")).endswith("data:image/jpeg;base64")
    service.shutdown()


def test_service_runs_stages_edits_and_files(spark, tmp_path):
    import json
    import threading
    import urllib.request

    from formweave.service import Service, serve

    rows = ["text,x0,y0,x1,y1,page"]
    for k in range(8):
        lines = [["Name", f"n{k}a", "City", f"c{k}b"], ["Aa", "Bb", "Cc"], *[[f"{k}{i}1", f"{k}{i}2", f"{k}{i}3"] for i in range(k % 3 + 1)]]
        for r, line in enumerate(lines):
            rows += [f"{t},{c * 100},{(k % 4) * 100 + r * 20},{c * 100 + 20},{(k % 4) * 100 + r * 20 + 10},{k // 4 + 1}" for c, t in enumerate(line)]
    (tmp_path / "words").mkdir()
    (tmp_path / "words" / "doc.csv").write_text("\n".join(rows))
    run = Service(spark, str(tmp_path / "run"))
    ask = lambda route, **body: run.handle("POST", route, body)
    assert run.handle("GET", "/nowhere")[0] == 404 and ask("/process/fields")[0] == 404 and ask("/process/phrase")[0] == 400
    assert ask("/process/phrase", path=str(tmp_path / "words"))[1]["documents"] == [{"doc_id": "doc", "phrases": len(rows) - 1, "pages": 2}]
    assert set(ask("/process/fields")[1]["fields"]) == {"Name", "City", "Aa", "Bb", "Cc"}
    assert ask("/api/remove_fields", fields=["City", "Zip"])[1]["not_found"] == ["Zip"]
    assert "City" in ask("/api/add_fields", fields=["City"])[1]["fields"]
    template = ask("/process/template")[1]["template"]
    assert [n["type"] for n in template] == ["kv", "table"]
    whole = ask("/process/extract")[1]
    assert whole["count"] == 8 and whole["records"][0]["content"][1]["content"][0] == {"Aa": "001", "Bb": "002", "Cc": "003"}
    assert ask("/api/modify_template_node", node_id=1, type="table", fields=["A", "B"])[1]["template"][1]["fields"] == ("A", "B")
    assert len(ask("/api/remove_template_node", node_ids=[1])[1]["template"]) == 1 and len(ask("/save/template", template=template)[1]["template"]) == 2
    assert run.handle("GET", "/files")[1]["files"] == ["phrases", "fields", "template", "extracted"]
    server = serve(run)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/files/bounding-box?doc_id=doc&page=1") as answer:
        assert json.load(answer)["phrases"][0] == {"text": "Name", "bbox": {"x0": 0.0, "y0": 0.0, "x1": 20.0, "y1": 10.0, "page": 1}}
    server.shutdown()
    assert json.loads(run.handle("GET", "/file/read", {"name": "template"})[1]["content"])[0]["type"] == "kv" and run.handle("GET", "/file/read", {"name": "phrases"})[0] == 400
    assert ask("/cleanup")[1]["deleted"] == ["phrases", "fields", "template", "extracted"] and run.handle("GET", "/files")[1]["files"] == []


def test_pdf_files_through_an_opener(spark, tmp_path):
    """Pages and words of an opener's making; without a library the message says what is missing."""
    from formweave.sources.pdf import page_images, pdf_words, plumber

    (tmp_path / "two.pdf").write_bytes(b"alpha beta|gamma")
    (tmp_path / "other.txt").write_bytes(b"no")

    def opener(stream):
        class Image:
            def __init__(self, text):
                self.text = text

            def save(self, out, format):
                out.write(f"{format} {self.text}".encode())

        class Page:
            def __init__(self, text):
                self.text = text

            def extract_words(self):
                return [{"text": w, "x0": 30.0 * k, "x1": 30.0 * k + 25, "top": 5.0, "bottom": 15.0} for k, w in enumerate(self.text.split())]

            def to_image(self, resolution):
                return Image(self.text)

        class File:
            pages = [Page(t) for t in stream.read().decode().split("|")]

        return File()

    words = pdf_words(spark, str(tmp_path), opener=opener).orderBy("word_idx").collect()
    assert [(w.doc_id, w.word_idx, w.page, w.text, w.y1) for w in words] == [("two", 0, 1, "alpha", 15.0), ("two", 1, 1, "beta", 15.0), ("two", 2, 2, "gamma", 15.0)]
    assert [r.text for r in P.words_to_phrases(pdf_words(spark, str(tmp_path), 1, opener)).collect()] == ["alpha beta"]
    assert [r.text for r in Engine().extract_folder(spark, str(tmp_path), opener=opener).orderBy("phrase_idx").collect()] == ["alpha beta", "gamma"]
    assert [bytes(r.content) for r in page_images(spark, str(tmp_path), 1, opener=opener).collect()] == [b"JPEG alpha beta"]
    try:
        import pdfplumber  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="pdfplumber"):
            plumber(None)


def test_boxes_in_any_form(spark):
    payloads = ['[{"text":"a","bbox":{"x0":1,"y0":2,"x1":3,"y1":4,"page":2}},{"text":"b","x0":5}]', '{"text":"c","page":3}', 'text,x0,y0,x1,y1,page\n"d, ""e""",1,2,3,4,5\n f ,,,,x,\n\n', "", None]
    got = S.parse_boxes(spark.createDataFrame(list(enumerate(payloads)), "i int, p string"), "i", "p").orderBy("i", "phrase_idx").collect()
    assert [(r.i, r.phrase_idx, r.page, r.text, r.x0, r.y1) for r in got] == [(0, 0, 2, "a", 1.0, 4.0), (0, 1, 1, "b", 5.0, 0.0), (1, 0, 3, "c", 0.0, 0.0), (2, 0, 5, 'd, "e"', 1.0, 4.0), (2, 1, 1, "f", 0.0, 0.0)]


def test_exchange_files(spark, tmp_path):
    """Everything a run writes is read back, in order, and goes when deleted."""
    path = lambda name: str(tmp_path / name)
    phrases = layout(spark, LINES)
    S.write_phrases(phrases, path("csv"))
    assert [r.text for r in S.read_phrases(spark, path("csv/doc_id=d/*.csv")).orderBy("phrase_idx").collect()] == [r.text for r in phrases.orderBy("phrase_idx").collect()]
    S.write_lines(spark.createDataFrame([(2, "City"), (1, "Name")], "n int, text string"), path("fields"), order="n")
    assert [r.text for r in S.read_lines(spark, path("fields")).orderBy("line_no").collect()] == ["Name", "City"]
    assert {r.text for r in S.ground_phrases(spark, path("fields")).collect()} == {"Name", "City"}
    S.write_metadata_rows(spark, [["Head", "1"], ["Foot"]], path("rows"))
    assert S.read_metadata_rows(spark, path("rows")) == [["Head", "1"], ["Foot"]]
    S.write_string(spark, "Head|Foot", path("meta"))
    assert S.read_metadata(spark, path("meta")) == ["Head", "Foot"]
    S.write_nested(X.nest(X.extract_cells(phrases, FORM)), path("nested"))
    assert spark.read.json(path("nested")).count() == 2
    S.write_records(phrases.select("text", "page"), path("records"))
    assert spark.read.text(path("records")).where("value LIKE '{\"text\":\"Name\",\"page\":1}'").count() == 2
    assert S.read_files(spark, str(tmp_path), "*.csv").count() >= 1
    assert S.artifact_path("out/", ["/b/z.pdf", "/a/y.pdf"], "template") == "out/y_z/y_z_template.json"
    assert S.delete_artifact(spark, path("rows")) and not S.delete_artifact(spark, path("rows"))
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "one.csv").write_text("text,x0,y0,x1,y1,page\nGrant,0,0,25,10,1\nReport,28,0,58,10,1\n")
    assert [r.text for r in Engine().extract_phrase(S.read_words(spark, path("w")), pages=1).collect()] == ["Grant Report"]


def test_sampled_pairs(spark):
    pairs = spark.range(200).selectExpr("CAST(id AS INT) AS a", "id % 2 = 0 AS is_positive")
    one, two = (sorted(r.a for r in P.sample_pairs(pairs, 50, 3).collect()) for _ in range(2))
    assert one == two and len(set(one)) == 50 and all(a % 2 for a in one) and P.sample_pairs(pairs, 500).count() == 100


def test_fields_of_a_single_page_come_from_vision(spark):
    found = K.predict_field(layout(spark, [["Name", "x"], ["City", "y"]]), RuleOracle(), vision=["City", "Zip"]).collect()
    assert [(r.field, r.position) for r in found] == [("City", 2)]


def test_learns_the_template_and_transforms(spark):
    lines = []
    for k in range(8):
        lines += [["Name", f"n{k}a", "City", f"c{k}b"], ["A", "B", "C"], *[[f"{k}{i}1", f"{k}{i}2", f"{k}{i}3"] for i in range(k % 3 + 1)]]
    phrases = layout(spark, lines)
    engine = Engine()
    template = engine.predict_template(phrases, ["Name", "City", "A", "B", "C"])
    assert [(n.type, n.fields, n.child) for n in template] == [("kv", ("Name", "City"), T.LEAF), ("table", ("A", "B", "C"), T.LEAF)]
    assert engine.extract_data(phrases, template).select("record_id").distinct().count() == 8
    with pytest.raises(ValueError):
        engine.predict_template(phrases.where("false"), ["Name"])


def test_template_edits_and_json():
    two = (Node("kv", ("a",), 0, child=1), Node("table", ("b",), 1))
    assert T.remove_nodes(two, [1]) == (Node("kv", ("a",), 0),)
    assert T.modify_node(two, 1, "kv", ["z"])[1] == Node("kv", ("z",), 1)
    assert T.toggle_type(T.delete_field(T.add_field(T.set_field(two, 0, 0, "q"), 0, "r"), 0, 0), 0)[0] == Node("table", ("r",), 0, child=1)
    assert T.insert_node(two, 1, Node("kv", ("n",)))[1].node_id == 2
    assert T.from_json(T.to_json(two)) == two
    assert T.from_json('[{"fields": ["x"]}]') == (Node("kv", ("x",), 0),)


def test_field_edits(spark):
    phrases = layout(spark, LINES)
    assert edit.add_fields(["Name"], ["city", "Nope"], phrases) == (["Name", "city"], ["Nope"])
    assert edit.remove_fields(["Name", "City"], ["city", "Name"], phrases) == (["City"], ["city"])


def test_words_and_wrapped_lines(spark):
    words = [("d", i, 1, t, x0, 0.0, x1, 10.0) for i, (t, x0, x1) in enumerate([("Grant", 0.0, 25.0), ("Report", 28.0, 58.0), (":", 59.0, 60.0), ("x", 61.0, 66.0), ("far", 200.0, 215.0)])]
    frame = spark.createDataFrame(words, "doc_id string, word_idx int, page int, text string, x0 double, y0 double, x1 double, y1 double")
    assert [r.text for r in P.words_to_phrases(frame).orderBy("phrase_idx").collect()] == ["Grant Report", "x", "far"]
    assert [r.text for r in P.line_phrases(frame).orderBy("phrase_idx").collect()][0] == "Grant"
    wrapped = layout(spark, [["long"], ["title"], ["next"]], step=12)
    assert [r.text for r in P.merge_by_ground(wrapped, ["a long title"]).orderBy("phrase_idx").collect()] == ["long title", "next"]
    assert [r.text for r in P.merge_by_distance(wrapped, 3.0).collect()] == ["long title next"]
    assert P.apply_rules(wrapped, ["a long title"]).count() == 2
    three = spark.range(1).select(*[F.struct(F.lit(t).alias("text"), F.lit(1.0 * k).alias("x0"), F.lit(0.0).alias("y0"), F.lit(k + 1.0).alias("x1"), F.lit(1.0).alias("y1"), F.lit(1).alias("page")).alias(t) for k, t in enumerate("abc")])
    row = three.select(P.join_three(F.col("a"), F.col("b"), F.col("c")).alias("j")).first().j
    assert row.text == "a b c" and row.x1 == 3.0


def test_value_classes(spark):
    values = spark.createDataFrame([("N/A",), (None,), ("(cid:3)",), ("https://x",), ("y",)], "v string")
    assert [r[0] for r in values.select(value_class(F.col("v"))).collect()] == ["missing", "missing", "undecoded", "url", "text"]


def test_files_round_trip_and_stream(spark, tmp_path):
    csv = tmp_path / "one.csv"
    csv.write_text('text,x0,y0,x1,y1,page\n"Total, net",1,2,3,4,1\n b ,5,6,7,8,2.0\n')
    got = S.read_phrases(spark, str(csv)).orderBy("phrase_idx").collect()
    assert [(r.doc_id, r.text, r.page) for r in got] == [("one", "Total, net", 1), ("one", "b", 2)]
    S.write_template(spark, FORM, str(tmp_path / "t"))
    assert S.read_template(spark, str(tmp_path / "t")) == FORM
    (tmp_path / "m.txt").write_text("Head | Foot\nnote|\n```\n")
    assert S.read_metadata(spark, str(tmp_path / "m.txt")) == ["Head", "Foot note"]
    assert S.merged_name(["/b/z.pdf", "/a/y.pdf"]) == "y_z"
    layout(spark, LINES).write.parquet(str(tmp_path / "in"))
    run = extract_stream(read_phrase_stream(spark, str(tmp_path / "in")), FORM, str(tmp_path / "out"), str(tmp_path / "ck"))
    run.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == X.extract_cells(layout(spark, LINES), FORM).count()


def test_predicts_fields_by_position(spark):
    lines = [["Sheet", None]]
    for k in range(6):
        lines += [["Name", f"n{k}", "City", f"c{k}"], ["Zip", f"z{k}", "Land", f"l{k}"]]
    found = K.predict_field(layout(spark, lines).withColumn("page", F.expr("1 + phrase_idx div 20")), RuleOracle()).orderBy("position").collect()
    assert [r.field for r in found] == ["Name", "City", "Zip", "Land"]
