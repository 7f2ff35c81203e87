import email.message
import io
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from siftstone.operators.report import summary
from siftstone.plans.scan import chunked, image_findings, scan
from siftstone.sources import extract, files, model
from siftstone.streaming import landing


@pytest.fixture
def tree(tmp_path):
    for name, data in {"a.txt": b"hello", "sub/b.py": b"x = 1", "sub/c.log": b"log", "big.md": b"y" * 5000, "empty.txt": b"", "node_modules/d.js": b"z", "pic.PNG": b"\x89PNG....", "noext": b"?"}.items():
        file = tmp_path / "in" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(data)
    (tmp_path / "in" / files.IGNORE_FILE).write_text("# c\n\n*.log\nnode_modules\n")
    return str(tmp_path / "in")


def test_discover(spark, tree):
    found, skipped = files.discover(spark, tree, 1000, ["text"], files.ignore_patterns(tree))
    assert sorted(r["path"].rsplit("/", 1)[-1] for r in found.collect()) == ["a.txt", "b.py"]
    assert {r["reason"]: r["n"] for r in skipped.collect()} == {"ignored": 2, "too large": 1, "other kind": 1, "unknown kind": 1}
    with pytest.raises(Exception):
        files.discover(spark, tree + "/missing")[0].count()


@pytest.mark.parametrize("pattern, path, want", [("node_modules", "a/node_modules/b", True), ("*.pyc", "a/b.pyc", True), ("*.pyc", "a/b.py", False), ("src/**/test.py", "src/a/b/test.py", True), ("**/file.txt", "x/file.txt", True), ("build/", "a/build/b", True), (".env", ".env", True), ("foo*", "foobar", False), ("src/foo.py", "src/foo.py", False)])
def test_ignored(spark, pattern, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(files.ignored(F.col("p"), [pattern])).first()[0] is want
    assert spark.createDataFrame([(path,)], "p string").select(files.ignored(F.col("p"), [])).first()[0] is False


def test_kinds(spark):
    rows = spark.createDataFrame([("a.PDF", b""), ("a.jpg", b""), ("a.pst", b""), ("a", bytearray.fromhex("FFD8FF00")), ("a.zzz", b"x")], "p string, c binary")
    assert [r[0] for r in rows.select(files.kind_of(F.col("p"), F.col("c"))).collect()] == ["text", "image", "email", "image", "unknown"]


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\nbroken\n{"a": 2}\n')
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny ""q"""\n')
    (tmp_path / "a.lst").write_text("# c\nx\n\ny\n")
    assert sorted(r["a"] for r in files.json_lines(spark, str(tmp_path / "a.jsonl"), "a int").collect()) == [1, 2]
    assert files.csv_rows(spark, str(tmp_path / "a.csv"), "a int, b string").first()[:] == (1, 'x\ny "q"')
    assert files.plain_lines(spark, str(tmp_path / "a.lst")).count() == 2 and files.plain_lines(spark, str(tmp_path / "a.lst"), 1).count() == 1
    with pytest.raises(ValueError):
        files.one_text(spark, " ")
    assert files.one_text(spark, "x").first()["path"] == "<stdin>"


def _zip(**parts):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/"), text)
    return data.getvalue()


def test_office(spark):
    slide = lambda x: f"<p:sld><a:t>{x}</a:t></p:sld>"
    pptx = _zip(**{"ppt__slides__slide1.xml": slide("one"), "ppt__slides__slide2.xml": slide("two")})
    xlsx = _zip(**{"xl__workbook.xml": '<sheet name="S" sheetId="1"/>', "xl__sharedStrings.xml": "<sst><si><t>hi</t></si></sst>", "xl__worksheets__sheet1.xml": '<row r="1"><c t="s"><v>0</v></c><c><v>5</v></c></row><row r="2"></row>'})
    rows = spark.createDataFrame([("docx", _zip(**{"word__document.xml": "<w:t>A</w:t><w:t>B</w:t>"})), ("pptx", pptx), ("xlsx", xlsx), ("docx", b"junk"), ("docx", None)], "e string, c binary")
    assert [r[0] for r in rows.select(extract.office("e", "c")).collect()] == ["A B", "[Slide 1]\none\n\n[Slide 2]\ntwo", "[Sheet: S]\nhi\t5", None, None]
    assert spark.createDataFrame([(b"\x00\x01abcd\x02ef\x03ghijk",)], "c binary").select(files.printable_runs(F.col("c"))).first()[0] == "abcd ghijk"


def test_mail(spark):
    m = email.message.EmailMessage()
    m["From"], m["To"], m["Subject"] = "a@x.org", "b@x.org", "Hi"
    m.set_content("body")
    m.add_attachment(b"attached", maintype="text", subtype="plain", filename="n.txt")
    rows = extract.mail(spark.createDataFrame([("p", m.as_bytes())], "path string, content binary")).orderBy("part_no").collect()
    assert [(r["part_no"], r["name"]) for r in rows] == [(0, "Hi"), (1, "n.txt")] and "body" in rows[0]["text"] and rows[1]["text"].strip() == "attached"


def test_ocr(spark):
    rows = spark.createDataFrame([("p", 1, 1, 1, 90.0, "a"), ("p", 2, 1, 1, 80.0, "b"), ("p", 3, 1, 2, 70.0, "c"), ("p", 4, 2, 1, 60.0, "d"), ("p", 5, 2, 1, -1.0, "no")], "path string, word_no int, block int, line int, conf double, word string")
    assert extract.ocr_text(rows).first()[:] == ("p", "a b\nc\n\nd", 75.0)


def test_model_and_scan(spark):
    class Flaky:
        """Refuses once, fails for some texts, answers otherwise."""

        def __init__(self):
            self.calls = 0

        def chat(self, prompt):
            self.calls += 1
            if self.calls == 1:
                raise model.Refused(429, 0)
            if "broken" in prompt:
                raise RuntimeError("no answer")
            return '[{"category": "pii", "subcategory": "pii.identity", "severity": "high"}]'

    docs = spark.createDataFrame([(1, "fine"), (2, "broken"), (3, "password = abcdefgh1"), (4, "")], "doc_id int, text string")
    asked = model.ask(chunked(docs).coalesce(1), Flaky, "look")
    answers = {r["doc_id"]: (r["response"] is not None, r["error"]) for r in asked.collect()}
    assert answers[1] == (True, None) and answers[2] == (False, "no answer")
    got = {r["doc_id"]: [f["subcategory"] for f in r["findings"]] for r in scan(docs, asked.where("error IS NULL")).collect()}
    assert got == {1: ["pii.identity"], 2: ["safe.documentation"], 3: ["pii.identity", "credentials.password"], 4: got[4]} and got[4][0].split(".")[0] in ("safe", "pii")
    plain = scan(docs)
    assert {r["doc_id"]: r["findings"][0]["category"] for r in plain.collect()} == {1: "safe", 2: "safe", 3: "credentials", 4: "safe"}
    assert summary(plain).first()["flagged"] == 1
    replayed = model.replay(chunked(docs), spark.createDataFrame([(1, 0, "[]")], "doc_id int, chunk_no int, response string"))
    assert replayed.where("response IS NOT NULL").count() == 1 and replayed.count() == 4


def test_calls_wait_side_by_side(spark):
    class Slow:
        def chat(self, prompt):
            time.sleep(0.5)
            return prompt[-2:]

    chunks = spark.range(16).selectExpr("id AS doc_id", "0 AS chunk_no", "lpad(id, 2, '0') AS chunk").coalesce(1)
    model.ask(chunks.limit(1), Slow, "q").collect()  # the worker is up
    began = time.monotonic()
    got = model.ask(chunks, Slow, "q", model.Limits(at_once=8)).collect()
    assert time.monotonic() - began < 5  # 8 s one after another
    assert [(r["doc_id"], r["response"], r["error"]) for r in got] == [(i, f"{i:02d}", None) for i in range(16)]


def test_hung_calls_end_as_errors():
    calls = []

    class Hung:
        def chat(self, prompt):
            calls.append(prompt)
            if prompt in ("3", "4", "9"):
                time.sleep(2)
                raise model.Refused(503)
            return prompt

    asking = model.Asking(Hung, model.Limits(at_once=2, seconds=0.3), None)
    got = asking.answers([lambda c, i=i: c.chat(str(i)) for i in range(10)])
    late = (None, "no answer within 0.3 seconds")
    assert got == [late if i in (3, 4, 9) else (str(i), None) for i in range(10)]
    time.sleep(2.5)
    assert sorted(calls) == sorted(map(str, range(10)))  # what was given up isn't tried again
    assert asking.answers([]) == [] and asking.answers([lambda c: c.chat("x")]) == [("x", None)]


def test_a_client_serves_one_call_at_a_time_and_may_fail_to_start():
    class Own:
        made = 0

        def __init__(self):
            Own.made += 1
            self.busy = False

        def chat(self, prompt):
            assert not self.busy
            self.busy = True
            time.sleep(0.005)
            self.busy = False
            return prompt

    got = model.Asking(Own, model.Limits(at_once=4), None).answers([lambda c, i=i: c.chat(str(i)) for i in range(100)])
    assert got == [(str(i), None) for i in range(100)] and Own.made <= 5

    def no_server():
        raise ConnectionError("refused")

    assert model.Asking(no_server, model.Limits(), None).answers([lambda c: c.chat("x")] * 2) == [(None, "refused")] * 2


def test_the_rate_is_shared_by_tasks(spark):
    class Clock:
        def chat(self, prompt):
            return str(time.time())

    chunks = spark.range(24).selectExpr("id AS doc_id", "0 AS chunk_no", "'c' AS chunk")
    got = model.ask(chunks, Clock, "q", model.Limits(per_second=8, tasks=2)).collect()
    times = sorted(float(r["response"]) for r in got)
    # Two tasks of 4 a second each; both may begin one call at once.
    assert len(times) == 24 and all(b - a > 0.9 for a, b in zip(times, times[10:]))


def test_images_and_their_text_are_asked_about(spark):
    class Eyes:
        def describe(self, prompt, image):
            assert prompt in ("look", "look\n\npassport P123")
            return f"[{{\"category\": \"pii\", \"subcategory\": \"pii.identity\", \"severity\": \"high\", \"description\": \"{len(image)} bytes\"}}]"

    images = spark.createDataFrame([("a.png", bytearray(b"abc"), "passport P123"), ("b.png", bytearray(b"abcd"), None), ("c.png", None, "words"), ("d.png", bytearray(), " ")], "path string, content binary, ocr_text string")
    asked = model.describe(images, Eyes, "look")
    assert {r["path"]: (r["response"] is not None, r["error"]) for r in asked.collect()} == {"a.png": (True, None), "b.png": (True, None), "c.png": (False, None), "d.png": (False, None)}
    found = {r["path"]: [(f["category"], f["description"], f["evidence"]) for f in r["findings"]] for r in image_findings(asked).collect()}
    assert found["a.png"] == [("pii", "3 bytes", "passport P123")] and found["b.png"] == [("pii", "4 bytes", "[image content]")]
    assert found["c.png"][0][0] == "unclassified" and found["d.png"][0][0] == "safe"
    assert model.describe(images.limit(0), Eyes, "look").count() == 0


def test_retries_give_up():
    waits = []
    with pytest.raises(model.Refused):
        model.with_retries(lambda: (_ for _ in ()).throw(model.Refused(503)), 3, waits.append)
    assert len(waits) == 2
    with pytest.raises(model.Refused):
        model.with_retries(lambda: (_ for _ in ()).throw(model.Refused(400)), 3, waits.append)


def test_stream(spark, tmp_path):
    folder = tmp_path / "land"
    folder.mkdir()
    (folder / "a.txt").write_text("SSN 123-45-6789 and pickle.loads(x)")
    (folder / "b.txt").write_text("nothing")
    rows = landing.alerts(landing.landing(spark, str(folder)))
    counts = landing.alert_counts(rows.withColumn("t", F.timestamp_seconds(F.lit(60))), "t")
    for stream, name, mode, n in ((rows, "alerts_seen", "append", 2), (counts, "alerts_counted", "complete", 2)):
        query = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
        query.processAllAvailable()
        query.stop()
        assert spark.table(name).count() == n
