"""Reports of any size as one file, and results that survive a restart."""

import datetime
import html
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from siftstone.operators import report as P
from siftstone.operators import resumable as R
from siftstone.schema import FINDINGS

FILES = f"path string, kind string, size long, findings {FINDINGS}"


def finding(category, severity="high", rank=3, description="d", evidence="e", **extracted):
    return (category, f"{category}.x", description, evidence, severity, rank, "model", extracted)


def made(spark, n):
    """n files, of which two of three have two findings each."""
    one = F.struct(F.lit("pii").alias("category"), F.lit("pii.x").alias("subcategory"), F.concat(F.lit('say "'), F.col("id").cast("string"), F.lit('"\n<b>&')).alias("description"), F.lit("e").alias("evidence"), F.lit("high").alias("severity"), F.lit(3).alias("sev_rank"), F.lit("m").alias("source"), F.create_map().cast("map<string,string>").alias("extracted_data"))
    two = one.withField("category", F.concat(F.lit("c"), (F.col("id") % 3).cast("string"))) if hasattr(one, "withField") else one
    lists = F.when(F.col("id") % 3 > 0, F.array(one, two)).otherwise(F.array())
    return spark.range(n).select(F.format_string("f%07d", "id").alias("path"), F.lit("text").alias("kind"), F.col("id").alias("size"), lists.cast(FINDINGS).alias("findings"))


def test_sarif_document(spark, tmp_path):
    rows = made(spark, 3000).repartition(7)
    at = P.write_document(spark, P.sarif_pieces(rows), str(tmp_path / "r.sarif.json"))
    run = json.loads(open(at, encoding="utf-8").read())["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["c1", "c2", "pii"] and len(run["results"]) == 4000
    uris = [r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] for r in run["results"]]
    assert uris == sorted(uris) and run["results"][0]["message"]["text"] == 'say "1"\n<b>&' and run["results"][0]["properties"] == {"severity": "high", "source": "m", "evidence": "e"}
    assert sorted(os.listdir(tmp_path)) in (["r.sarif.json"], [".r.sarif.json.crc", "r.sarif.json"])
    with pytest.raises(FileExistsError):
        P.write_document(spark, P.sarif_pieces(rows), at)


def test_documents_of_nothing(spark, tmp_path):
    for k, rows in enumerate((made(spark, 0), made(spark, 1))):  # no file, and one without findings
        assert json.loads(open(P.write_document(spark, P.sarif_pieces(rows), str(tmp_path / f"s{k}"))).read())["runs"][0]["results"] == []
        assert json.loads(P.sarif(rows))["runs"][0]["tool"]["driver"]["rules"] == []
        page = open(P.write_document(spark, P.html_pieces(rows), str(tmp_path / f"h{k}"), "")).read()
        assert page.count("<tr><td>") == k and page == P.html_page(rows)


def test_html_document(spark, tmp_path):
    page = open(P.write_document(spark, P.html_pieces(made(spark, 300).repartition(5), "<T>"), str(tmp_path / "r.html"), ""), encoding="utf-8").read()
    cells = [re.findall("<td>(.*?)</td>", r, re.S) for r in re.findall("<tr><td>.*?</tr>", page, re.S)]
    found, every = [c for c in cells if len(c) == 5], [c for c in cells if len(c) == 4]
    assert len(found) == 400 and len(every) == 300 and found[0] == ["f0000001", "high", "pii", html.escape('say "1"\n<b>&'), "e"] and "<b>" not in page
    assert [c[0] for c in every] == [f"f{k:07}" for k in range(300)] and every[0][2:] == ["clean", "No findings"] and every[1][2:] == ["high", "pii, c1"]
    assert "<li>pii: 200</li>" in page and "<option>c2</option>" in page and "&lt;T&gt;" in page and "Findings (400)" in page and "All files (300)" in page


def test_what_a_clean_file_says(spark):
    rows = [("a", "text", 1, [finding("safe", "info", 0, "plain", summary="short", subject="s")]), ("b", "text", 1, [finding("safe", "info", 0, "plain", subject="s")]), ("c", "image", 1, [finding("safe", "info", 0, "plain", summary="", visual_description="seen")]), ("d", "text", 1, [finding("safe", "info", 0, "plain")]), ("e", "text", 1, None)]
    got = [re.findall("<td>(.*?)</td>", r["value"]) for r in P.file_cells(spark.createDataFrame(rows, FILES)).orderBy("path").collect()]
    assert got == [["a", "text", "clean", "short"], ["b", "text", "clean", "s"], ["c", "image", "clean", "seen"], ["d", "text", "clean", "plain"], ["e", "text", "clean", "No findings"]]


def test_save_makes_one_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "REPORT_ROWS", 10)  # bounds texts on the driver only
    names = P.save(made(spark, 60), "sarif", str(tmp_path), datetime.datetime(2024, 1, 2, 3, 4, 5))
    assert os.path.isfile(names[0]) and len(json.loads(open(names[0]).read())["runs"][0]["results"]) == 80 and os.path.isdir(names[1])


# Results that survive a restart


class Stopped(Exception):
    pass


def work(stop_at=None, failing=None, call=1):
    """A worker that fails for some ids, and is stopped as it comes to the batch that holds an id."""

    def results(rows):
        if stop_at is not None and rows.where(F.col("id") == stop_at).count():
            raise Stopped
        bad = F.col("id") % failing == 0 if failing else F.lit(False)
        return rows.select("id", F.when(~bad, F.col("id") * 2).alias("answer"), F.when(bad, F.lit("timeout")).alias("error"), F.lit(call).alias("call"), F.create_map(F.lit("k"), F.lit("v")).alias("m"))

    return results


def test_a_stopped_call_is_resumed(spark, tmp_path):
    folder, todo = str(tmp_path / "results"), spark.range(100)
    with pytest.raises(Stopped):
        R.evaluate(todo, work(stop_at=17, failing=10), folder, "id", batch_rows=9)
    schema = work()(todo).schema
    first = {r["id"] for r in R.committed(spark, folder, schema).collect()}
    assert 0 < len(first) < 100
    # What a call leaves behind that is killed as it writes: rows beside the batches, and a batch copied in part.
    spark.range(100).select("id", F.lit(-1).cast("bigint").alias("answer")).write.parquet(f"{folder}/_stage-000001-000099-x")
    spark.range(100).select("id", F.lit(-1).cast("bigint").alias("answer")).write.parquet(f"{folder}/batch=000001-000098")
    os.remove(f"{folder}/batch=000001-000098/_SUCCESS")
    got = R.evaluate(todo, work(failing=10, call=2), folder, "id", batch_rows=9).collect()
    assert sorted(r["id"] for r in got) == list(range(100)) and all((r["answer"] == 2 * r["id"]) == (r["id"] % 10 > 0) for r in got)
    assert {r["id"] for r in got if r["call"] == 1} == {i for i in first if i % 10}  # not done again
    last = R.evaluate(todo, work(call=3), folder, "id").collect()
    assert len(last) == 100 and {r["id"] for r in last if r["call"] == 3} == set(range(0, 100, 10)) and not any(r["error"] for r in last)
    names = R.batch_names(spark, folder)
    R.evaluate(todo, work(call=4), folder, "id")
    assert R.batch_names(spark, folder) == names and not [n for n in os.listdir(folder) if n.startswith("_stage")]


def test_failures_can_stand(spark, tmp_path):
    folder = str(tmp_path / "r")
    rows = spark.createDataFrame([(1,), (None,), (10,), (10,)], "id long")
    for call in (1, 2):
        got = R.evaluate(rows, work(failing=10, call=call), folder, "id", keep_failed=True).collect()
        assert sorted((r["id"], r["call"], r["error"]) for r in got) == [(1, 1, None), (10, 1, "timeout")]


def test_nothing_to_do(spark, tmp_path):
    assert R.evaluate(spark.range(0), work(), str(tmp_path / "r"), "id").collect() == []


def test_a_batch_is_written_once(spark, tmp_path):
    folder = str(tmp_path / "r")
    assert R.commit(spark.range(3), folder, "a") and not R.commit(spark.range(5), folder, "a") and R.commit(spark.range(2), folder, "b")
    assert R.committed(spark, folder, "id long").groupBy("batch").count().orderBy("batch").collect() == [("a", 3), ("b", 2)]


def test_a_stream_that_delivers_again(spark, tmp_path):
    land, folder = tmp_path / "land", str(tmp_path / "r")
    land.mkdir()
    for k in range(3):
        (land / f"{k}.txt").write_text(f"line {k}\n")
    rows = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(str(land))
    calls = []

    def sink(df, number):
        calls.append(number)
        R.stream_sink(folder)(df, number)
        if calls == [0, 1]:
            raise Stopped  # after the batch was written, before the stream knows

    for _ in range(2):
        query = rows.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except Exception:
            pass
    assert calls == [0, 1, 1, 2]
    assert sorted(r["value"] for r in R.committed(spark, folder, "value string").collect()) == ["line 0", "line 1", "line 2"]
