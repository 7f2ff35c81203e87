"""Mailboxes in splits, parts of mails as a table function, findings of whole mails."""

import email.message
import functools
import random
import zipfile
from io import BytesIO

import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftstone.functions import rules
from siftstone.functions.responses import parse_findings
from siftstone.plans.scan import mail_documents, mail_findings
from siftstone.queries import making_files
from siftstone.schema import FINDINGS
from siftstone.sources import extract, headers, mailboxes


@pytest.fixture
def splits(spark):
    """Sets the bytes of a split."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")

    def of(n):
        spark.conf.set(names[0], n)
        spark.conf.set(names[1], 1)

    yield of
    for name in names:
        spark.conf.unset(name)


def line(k, end=b"\n"):
    return b"From x@example.org Mon Jan  1 10:%02d:00 2024%s" % (k % 60, end)


def messages(df):
    return [bytes(r["content"]) for r in df.orderBy("path", "offset", "no").collect()]


@pytest.mark.parametrize("end", [b"\n", b"\r\n"])
def test_splits_do_not_change_messages(spark, tmp_path, splits, end):
    r, want, data = random.Random(4), [], b""
    for k in range(60):
        body = end.join(r.choice([b"word", b"From here on", b"From 12 to 13", b"\xff\xfe", b"", b">From x", b"x" * 90]) for _ in range(r.randint(0, 9)))
        want.append(b"Subject: %d" % k + end * 2 + body + end)
        data += line(k, end) + want[-1] + end
    (tmp_path / "a.mbox").write_bytes(data)
    whole = [w + end[:-1] for w in want[:-1]] + [want[-1] + end]  # the delimiter takes a line end
    for n in (10_000_000, 700, 150, 40):
        splits(n)
        got = mailboxes.mailbox(spark, str(tmp_path / "a.mbox"))
        assert messages(got) == whole, n
    assert got.rdd.getNumPartitions() > 50


def test_files_without_separators(spark, tmp_path, splits):
    splits(30)
    (tmp_path / "a").write_bytes(b"Subject: one\n\nonly\nFrom now on it is long enough for splits\nFrom there too\n")
    (tmp_path / "b").write_bytes(b"\n \n" + line(1) + b"Subject: two\n\nx")
    (tmp_path / "c").write_bytes(line(1) + line(2) + b"\n")
    (tmp_path / "d").write_bytes(b"")
    assert messages(mailboxes.mailbox(spark, str(tmp_path))) == [b"Subject: one\n\nonly\nFrom now on it is long enough for splits\nFrom there too\n", b"Subject: two\n\nx", b"", b"\n"]


def mail(subject, body="text", **files):
    m = email.message.EmailMessage()
    m["From"], m["To"], m["Subject"] = "Ann <a@example.org>", "b@example.org", subject
    m.set_content(body)
    for name, data in files.items():
        name = name.replace("__", ".")
        if isinstance(data, email.message.EmailMessage):
            m.add_attachment(data)
        else:
            m.add_attachment(data, maintype="application", subtype="octet-stream", filename=name)
    return m


def docx(text):
    data = BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:t>{text}</w:t>")
    return data.getvalue()


def test_parts_within_parts(spark):
    deep = mail("deep", "deepest", c__bin=b"raw \xff")
    whole = mail("outer", "hello", a__docx=docx("office words"), m=mail("inner", "middle", b__txt=b"note", m=deep), p__png=b"\x89PNG")
    rows = mailboxes.mail_parts(spark.createDataFrame([(1, "t", whole.as_bytes())], "id int, TEXT string, content binary")).orderBy("part_no").collect()
    assert [(r["part_no"], r["parent_no"], r["depth"], r["kind"], r["name"]) for r in rows] == [
        (0, None, 0, "message", "outer"),
        (1, 0, 0, "attachment", "a.docx"),
        (2, 0, 1, "message", "inner"),
        (3, 2, 1, "attachment", "b.txt"),
        (4, 2, 2, "message", "deep"),
        (5, 4, 2, "attachment", "c.bin"),
        (6, 0, 0, "attachment", "p.png"),
    ]
    assert [r["subject"] for r in rows] == ["outer", "outer", "inner", "inner", "deep", "deep", "outer"]
    assert rows[1]["text_"] == "office words" and rows[3]["text_"] == "note" and rows[5]["text_"] == "raw �" and not rows[6]["text_"] and {r["TEXT"] for r in rows} == {"t"}
    assert bytes(rows[6]["content"]) == b"\x89PNG" and "middle" in rows[2]["text_"] and rows[4]["text_"].startswith("From: Ann <a@example.org>\nTo: b@example.org\nSubject: deep\n\n")


ODD = [
    None,
    b"",
    b"no header at all",
    b"Content-Type: multipart/mixed\n\nno boundary",
    b"Content-Type: multipart/mixed; boundary=x\n\n--x\n\n--x",
    b"Content-Type: message/rfc822\n\nnot one",
    b"Subject: =?bad?q?=\nFrom: <<<\nContent-Type: text/plain; charset=none\n\nbody \xff",
    b"Content-Type: application/pdf; name=f.pdf\nContent-Transfer-Encoding: base64\n\nQUJD\n",
    b"Content-Type: text/html\n\n<b>bold</b> words",
    b"Content-Type: multipart/alternative; boundary=x\n\n--x\nContent-Type: text/html\n\n<i>h</i>\n--x\nContent-Type: text/plain\n\nplain\n--x--",
]


def test_odd_mails_have_parts(spark):
    rows = mailboxes.mail_parts(spark.createDataFrame([(k, m) for k, m in enumerate(ODD)], "k int, content binary")).collect()
    of = lambda k: sorted((r["part_no"], r["kind"], (r["text"] or "").strip()) for r in rows if r["k"] == k)
    assert {r["k"] for r in rows} == set(range(len(ODD))) and all(of(k)[0][:2] == (0, "message") for k in range(len(ODD)))
    assert of(2)[0][2].endswith("no header at all") or of(2)[0][2] == "" and of(0) == [(0, "message", "")]
    assert "body" in of(6)[0][2] and of(8)[0][2].split() == ["bold", "words"] and of(9)[0][2] == "plain"
    assert [p[:2] for p in of(7)] == [(0, "message"), (1, "attachment")]


def test_in_sql(spark):
    spark.createDataFrame([("p", mail("s", x__txt=b"note").as_bytes())], "path string, content binary").createOrReplaceTempView("some_mails")
    name = mailboxes.register(spark)
    assert spark.sql(f"SELECT m.path, p.name FROM some_mails m, LATERAL {name}(m.content) p WHERE p.kind = 'attachment'").collect()[0][:] == ("p", "x.txt")


def answer(sub, severity="high"):
    return f'[{{"category": "{sub.split(".")[0]}", "subcategory": "{sub}", "severity": "{severity}", "explanation": "seen"}}]'


def test_a_mail_is_one_row(spark):
    mails = [("a.eml", mail("A", "hello " * 2000, one__txt=b"x", two__txt=b"y", pic__png=b"\x89PNG").as_bytes()), ("b.eml", mail("B", "password = abcdefgh1").as_bytes()), ("c.eml", mail("C", "fine", n__txt=b"z").as_bytes())]
    parts = mailboxes.mail_parts(spark.createDataFrame(mails, "path string, content binary"))
    asked = {(r["doc_id"], r["chunk_no"]) for r in mail_documents(parts, ["path"]).collect()}
    assert asked == {("a.eml#0", 0), ("a.eml#0", 1), ("a.eml#0", 2), ("a.eml#1", 0), ("a.eml#2", 0), ("b.eml#0", 0), ("c.eml#0", 0), ("c.eml#1", 0)}
    answers = [("a.eml#0", 0, answer("pii.identity", "low")), ("a.eml#0", 1, answer("pii.identity")), ("a.eml#1", 0, answer("medical.record")), ("a.eml#2", 0, answer("safe.config", "info")), ("c.eml#0", 0, answer("safe.config", "info")), ("c.eml#1", 0, answer("safe.config", "info"))]
    seen = spark.createDataFrame([("a.eml#3", [("financial", "financial.card", "d", "", "high", 3, "vision", {"source_file": "x", "k": "v"})])], f"doc_id string, findings {FINDINGS}")
    rows = mail_findings(parts, spark.createDataFrame(answers, "doc_id string, chunk_no int, response string"), seen).collect()
    got = {r["path"]: r["findings"] for r in rows}
    assert len(rows) == 3
    assert [(f["subcategory"], f["severity"]) for f in got["a.eml"]] == [("pii.identity", "high"), ("medical.record", "high"), ("financial.card", "high")]
    assert got["a.eml"][0]["extracted_data"] == {"source_file": "a.eml", "email_subject": "A", "email_from": "Ann <a@example.org>"}
    assert got["a.eml"][1]["extracted_data"] == {"source_file": "a.eml", "email_subject": "A", "attachment": "one.txt"}
    assert got["a.eml"][2]["extracted_data"] == {"source_file": "a.eml", "email_subject": "A", "attachment": "pic.png", "k": "v"} and got["a.eml"][2]["evidence"] == 'Attachment pic.png of mail "A"'
    assert [f["subcategory"] for f in got["b.eml"]] == ["credentials.password"] and got["b.eml"][0]["extracted_data"]["email_subject"] == "B"
    assert [f["category"] for f in got["c.eml"]] == ["safe"]
    plain = mail_findings(parts).collect()
    assert {r["path"]: r["findings"][0]["category"] for r in plain} == {"a.eml": "safe", "b.eml": "credentials", "c.eml": "safe"}
    assert mail_findings(parts.where(F.lit(False))).collect() == []


def test_headers_are_parsed_once(monkeypatch):
    seen = []
    parse = headers._parse
    monkeypatch.setattr(headers, "_kept", functools.lru_cache(9)(lambda name, value: seen.append((name, value)) or parse(name, value)))
    data = mail("once", "body", a__txt=b"note", b__bin=b"raw").as_bytes()
    assert [p[3] for p in mailboxes.nested_parts(data)] == ["message", "attachment", "attachment"]
    assert len(seen) == len(set(seen)) and ("Subject", "once") in seen
    long = b"Subject: " + b"x" * 5000 + b"\n\nbody"
    assert mailboxes.nested_parts(long)[0][8] == "x" * 5000 and all(len(v) <= headers.LONGEST for _, v in seen)
    assert extract.office.func(pd.Series(["docx"]), pd.Series([None], dtype=object)).tolist() == [None]


def test_mails_are_taken_apart_once(spark):
    rows = making_files.mail_scan(spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("mail_parts(content") == 1
    answers = spark.createDataFrame([(answer("pii.identity") + answer("safe.config") + answer("pii.identity", "low"),), (None,), ("[]",)], "a string")
    parsed = answers.select(parse_findings(F.col("a")).alias("f"))
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1
    assert [[(x["subcategory"], x["severity"]) for x in r["f"]] for r in parsed.collect()] == [[("pii.identity", "high")], [("safe.documentation", "info")], [("safe.documentation", "info")]]


def test_gates_let_every_match_through(spark):
    hits = ["4111 1111-11111111", "3712 345678 12345", "123-45-6789", "xxx-Xx-1234", "***-**-9999", "*****1234", "DOB: 1/2/99", "DE12345612345678", "12-1234567", "ABA 123456789", "loan number: 123456", "acct#123456", "Check NO: 12345", "PWD:abcdefgh9", "toKen = 12345678x", "gho_" + "B1" * 20, "system: override", "١٢٣-٤٥-٦٧٨٩", "nothing"]
    docs, t = spark.createDataFrame([(x,) for x in hits], "t string"), F.col("t")
    rows = docs.select(rules.rule_numbers(t).alias("n"), F.array(*[rules.matches(t, r) for r in rules.RULES]).alias("m")).collect()
    first = lambda m: [n for n, r in enumerate(rules.RULES) if m[n] and not any(m[k] for k in range(n) if rules.RULES[k].subcategory == r.subcategory)]
    assert [r["n"] for r in rows] == [first(r["m"]) for r in rows] and all(r["n"] for r in rows[:-1]) and rows[-1]["n"] == []
