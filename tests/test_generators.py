"""Labelled texts from a grammar."""

import base64
import json
import re

import pytest

from siftstone.operators import generators as G

RULES = {
    "report": [(3, "{head}\n{line}{line}"), (1, "{head} only")],
    "head": [(1, "Report é 😀 {number}"), (1, "To {email:pii.contact}:")],
    "line": [(1, "ssn {ssn:pii.identity}; "), (1, "key {key_id:credentials.api_key} and {token:credentials.token}. "), (2, "{quiet}"), (1, "{secret:credentials.secret_note} ")],
    "quiet": [(1, "nothing here. ")],
    "secret": [(1, "jwt {web_token:credentials.token} of {password}")],
}


@pytest.fixture
def grammar(spark):
    return G.grammar_table(spark, RULES)


def test_findings_point_at_the_right_characters(spark, grammar):
    rows = G.expanded(spark.range(400), grammar, "report").collect()
    kinds = {"pii.identity": r"9\d\d-\d\d-\d{4}", "pii.contact": r"user\d{5}@example\.org", "credentials.api_key": r"AKIAEXAMPLE[A-Z2-7]{9}", "credentials.token": r"[\w-]{32}|[\w-]+\.[\w-]+\.[\w-]{22}", "credentials.secret_note": r"jwt \S+ of Fake-\S{10}"}
    seen = set()
    for r in rows:
        assert "{" not in r["text"] and "}" not in r["text"]
        begins = []
        for f in r["findings"]:
            a, b = int(f["extracted_data"]["begin"]), int(f["extracted_data"]["end"])
            assert r["text"][a:b] == f["evidence"] and re.fullmatch(kinds[f["subcategory"]], f["evidence"])
            seen.add(f["subcategory"])
            begins.append(a)
        assert begins == sorted(begins)
        assert len(re.findall(r"ssn 9", r["text"])) == sum(f["subcategory"] == "pii.identity" for f in r["findings"])
    assert seen == set(kinds)
    lines = sum(r["text"].count("\n") for r in rows) / 400
    assert 0.65 < lines < 0.85  # weights 3 to 1


def test_tokens_can_be_read(spark, grammar):
    tokens = [f["evidence"] for r in G.expanded(spark.range(300), grammar, "secret").collect() for f in r["findings"]]
    assert len(set(tokens)) == 300
    head, payload, _ = tokens[0].split(".")
    padded = lambda x: base64.urlsafe_b64decode(x + "=" * (-len(x) % 4))
    assert json.loads(padded(head)) == {"alg": "HS256", "typ": "JWT"} and set(json.loads(padded(payload))) == {"sub", "role"}


def test_rows_do_not_depend_on_others(spark, grammar):
    whole = {r["id"]: r["text"] for r in G.expanded(spark.range(60), grammar, "report").collect()}
    some = {r["id"]: r["text"] for r in G.expanded(spark.range(20, 40).repartition(7), grammar, "report").collect()}
    assert all(whole[k] == t for k, t in some.items())
    other = {r["id"]: r["text"] for r in G.expanded(spark.range(60), grammar, "report", seed=1).collect()}
    assert sum(whole[k] != other[k] for k in whole) > 50
    assert G.expanded(spark.range(0), grammar, "report").collect() == []
    odd = G.expanded(spark.createDataFrame([(None,), (1,), (1,)], "id long"), grammar, "report").collect()
    assert len(odd) == 3 and odd[1]["text"] == odd[2]["text"]


def test_errors(spark):
    with pytest.raises(Exception, match="neither a symbol nor a value: nowhere"):
        G.expanded(spark.range(1), G.grammar_table(spark, {"a": [(1, "{nowhere}")]}), "a").collect()
    with pytest.raises(Exception, match="nested deeper"):
        G.expanded(spark.range(1), G.grammar_table(spark, {"a": [(1, "x{a}")]}), "a").collect()


def test_quotas(spark, grammar):
    rows = G.labelled_corpus(spark, grammar, {"report": 2500, "secret": 3, "quiet": 0})
    assert {r["symbol"]: r["count"] for r in rows.groupBy("symbol").count().collect()} == {"report": 2500, "secret": 3} and rows.select("id").distinct().count() == 2503
