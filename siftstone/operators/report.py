"""Roll-ups and exports of scanned files: rows of (path, kind, size, findings)."""

from __future__ import annotations

import html
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.folders import children, file_system, remove, rename
from siftstone.functions.text import basename, escape_html, extension, tidy_key
from siftstone.schema import SEVERITIES, severity_name

SAFE = "safe"


def exploded(files: DataFrame) -> DataFrame:
    """One row a finding, with its position; files without findings have one row with nulls."""
    return files.select("path", "kind", "size", F.posexplode_outer("findings").alias("pos", "f")).select("path", "kind", "size", "pos", "f.*")


def _of_rank(rank: int):
    return lambda f: f["sev_rank"] == rank


def summary(files: DataFrame, severities: str = "all") -> DataFrame:
    """One row: files, findings (not safe), flagged, clean, one count a severity, max_severity.

    severities: "all" counts safe findings by severity too, "risky" doesn't.
    """
    risky = F.filter("findings", lambda f: f["category"] != SAFE)
    counted = F.col("findings") if severities == "all" else risky
    of = [F.sum(F.size(F.filter(counted, _of_rank(r)))).alias(name) for r, name in enumerate(SEVERITIES)]
    return files.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum(F.size(risky)), F.lit(0)).alias("findings"),
        F.count_if(F.size(risky) > 0).alias("flagged"),
        F.count_if(F.coalesce(F.size(risky), F.lit(0)) == 0).alias("clean"),
        *of,
        severity_name(F.max(F.array_max(F.transform(risky, lambda f: f["sev_rank"])))).alias("max_severity"),
    )


def flagged_by_definition(files: DataFrame) -> DataFrame:
    """One row: flagged files by four meanings of the word in use: any risky finding; any finding; risky and above info; as the first, in the PDF."""
    risky = F.filter("findings", lambda f: f["category"] != SAFE)
    return files.agg(
        F.count_if(F.size(risky) > 0).alias("risky"),
        F.count_if(F.size("findings") > 0).alias("any_finding"),
        F.count_if(F.exists(risky, lambda f: f["sev_rank"] > 0)).alias("risky_above_info"),
        F.count_if(F.size(risky) > 0).alias("pdf"),
    )


def category_counts(files: DataFrame) -> DataFrame:
    return exploded(files).where(F.col("category") != SAFE).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def severity_breakdown(files: DataFrame) -> DataFrame:
    """For each file with risky findings a line such as "1 critical, 2 low", greatest first."""
    risky = F.filter("findings", lambda f: f["category"] != SAFE)
    counts = [F.size(F.filter(risky, _of_rank(r))) for r in range(len(SEVERITIES))]
    parts = [F.when(counts[r] > 0, F.concat(counts[r].cast("string"), F.lit(f" {SEVERITIES[r]}"))) for r in reversed(range(len(SEVERITIES)))]
    return files.select("path", F.concat_ws(", ", *parts).alias("breakdown")).where("breakdown <> ''")


def extension_counts(files: DataFrame, most: int = 50) -> DataFrame:
    """Files and bytes by extension, the commonest first."""
    return files.groupBy(extension(F.col("path")).alias("ext")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")).orderBy(F.desc("files"), "ext").limit(most)


def at_or_above(files: DataFrame, severity: str) -> DataFrame:
    """One row: whether any risky finding is of the severity or a greater one (an exit code of 1)."""
    rank = SEVERITIES.index(severity)
    hit = F.max(F.exists("findings", lambda f: (f["category"] != SAFE) & (f["sev_rank"] >= rank)))
    return files.agg(F.coalesce(hit, F.lit(False)).alias("exceeded")).withColumn("exit_code", F.col("exceeded").cast("int"))


def filter_findings(findings: DataFrame, severity: str | None = None, category: str | None = None, text: str | None = None) -> DataFrame:
    """Rows of `exploded` of a severity, a category, and with a text in path, description or evidence (upper case or not)."""
    keep = F.lit(True)
    if severity:
        keep = keep & (F.col("severity") == severity)
    if category:
        keep = keep & (F.col("category") == category)
    if text:
        low = F.lit(text.lower())
        keep = keep & (F.lower("path").contains(low) | F.lower("description").contains(low) | F.lower("evidence").contains(low))
    return findings.where(keep)


def sort_findings(findings: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """By any column, severity by its rank; equal rows by path and position."""
    key = F.col("sev_rank" if column == "severity" else column)
    return findings.orderBy(key.desc() if descending else key.asc(), "path", "pos")


def json_lines(files: DataFrame) -> DataFrame:
    """(path, json): a file's result as JSON, without empty extracted data."""
    slim = F.transform("findings", lambda f: F.struct(f["category"].alias("category"), f["description"].alias("description"), f["evidence"].alias("evidence"), f["severity"].alias("severity"), f["source"].alias("source"), F.when(F.size(f["extracted_data"]) > 0, f["extracted_data"]).alias("extracted_data")))
    return files.select("path", F.to_json(F.struct("path", "kind", "size", slim.alias("findings"))).alias("json"))


SARIF_LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}


def sarif_results(files: DataFrame) -> DataFrame:
    """One row a risky finding: path, rule_id, level, message, start_line."""
    level = F.element_at(F.create_map(*[F.lit(x) for kv in SARIF_LEVEL.items() for x in kv]), F.col("severity"))
    return exploded(files).where(F.col("category") != SAFE).select("path", "pos", F.col("category").alias("rule_id"), level.alias("level"), F.col("description").alias("message"), F.lit(1).alias("start_line"))


#: Rows of a report that is made as one text on the driver; a larger one is an error there, and is written by `save`.
REPORT_ROWS = 200_000


def bounded(rows: DataFrame, *order: str) -> list:
    """All rows in order, if they are few enough for one text."""
    got = (rows.orderBy(*order) if order else rows).limit(REPORT_ROWS + 1).collect()
    if len(got) > REPORT_ROWS:
        raise ValueError(f"more than {REPORT_ROWS} rows: narrow the files, or write the report with save()")
    return got


def sarif_json(files: DataFrame) -> DataFrame:
    """(path, pos, value): each risky finding as a SARIF result."""
    rows = exploded(files).where(F.col("category") != SAFE)
    level = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SARIF_LEVEL.items() for x in kv]), F.coalesce("severity", F.lit("info"))), F.lit("note"))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.lit(1).alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("category").alias("ruleId"), level.alias("level"), F.struct(F.coalesce("description", F.lit("")).alias("text")).alias("message"), F.array(place).alias("locations"), F.struct("severity", "source", "evidence").alias("properties"))
    return rows.select("path", "pos", F.to_json(result).alias("value"))


def sarif_rules(files: DataFrame) -> DataFrame:
    """(category, value): each risky category as a SARIF rule."""
    names = exploded(files).where(F.col("category") != SAFE).select("category").distinct()
    return names.select("category", F.to_json(F.struct(F.col("category").alias("id"), F.struct(F.col("category").alias("text")).alias("shortDescription"))).alias("value"))


def sarif_pieces(files: DataFrame, tool: str = "siftstone") -> list[str | DataFrame]:
    """A SARIF 2.1.0 document, in pieces for `document_text` or `write_document`."""
    head = f'{{"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{{"tool": {{"driver": {{"name": {json.dumps(tool)}, "rules": [\n'
    return [head, sarif_rules(files).orderBy("category"), ']}}, "results": [\n', sarif_json(files).orderBy("path", "pos"), "]}]}\n"]


def document_text(pieces: list[str | DataFrame], between: str = ",") -> str:
    """A document on the driver: texts as they are, and of each table the `value` of its rows, in order, `between` them; REPORT_ROWS rows of a table at most."""
    out = []
    for piece in pieces:
        if isinstance(piece, str):
            out.append(piece)
        else:
            out.append(f"{between}".join(r["value"] + "\n" for r in bounded(piece)))
    return "".join(out)


def write_document(spark: SparkSession, pieces: list[str | DataFrame], path: str, between: str = ",") -> str:
    """The same document of any size, as one file; its path.

    Tables are written by their tasks, a file a partition in the order of the rows, and the files are copied one after
    another through Spark's file system: no row comes to Python, and the driver holds one buffer. The file has its name
    once it is whole; one that is there is an error.
    """
    stage = f"{path}._parts-{uuid.uuid4().hex}"
    copy = spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes
    files, place = file_system(spark, f"{stage}/whole")
    try:
        for k, piece in enumerate(pieces):
            if not isinstance(piece, str):
                piece.select(F.concat(F.lit(between), "value").alias("value")).write.option("compression", "none").text(f"{stage}/{k}")
        out = files.create(place)
        try:
            for k, piece in enumerate(pieces):
                if isinstance(piece, str):
                    out.write(bytearray(piece.encode()))
                    continue
                skip = len(between.encode())  # none before the first row
                for name in sorted((n for n in children(spark, f"{stage}/{k}") if n.startswith("part-")), key=lambda n: (int(n.split("-")[1]), n)):
                    here = file_system(spark, f"{stage}/{k}/{name}")[1]
                    if not files.getFileStatus(here).getLen():
                        continue
                    data = files.open(here)
                    try:
                        data.seek(skip)
                        copy(data, out, 1 << 20, False)
                    finally:
                        data.close()
                    skip = 0
        finally:
            out.close()
        if not rename(spark, f"{stage}/whole", path):
            raise FileExistsError(path)
    finally:
        remove(spark, stage)
    return path


def sarif(files: DataFrame, tool: str = "siftstone") -> str:
    """The SARIF 2.1.0 document, of REPORT_ROWS findings at most."""
    return json.dumps(json.loads(document_text(sarif_pieces(files, tool))), indent=2)


def _entries(extracted: Column, each) -> Column:
    return F.transform(F.array_sort(F.map_keys(extracted)), lambda k: each(tidy_key(k), F.element_at(extracted, k)))


def markdown_sections(files: DataFrame) -> DataFrame:
    """(path, section): a heading and a list of findings with their extracted values, keys in order."""
    line = lambda f: F.concat(F.lit("- **"), F.upper(f["severity"]), F.lit("** "), f["category"], F.lit(": "), f["description"], F.array_join(_entries(f["extracted_data"], lambda k, v: F.concat(F.lit("\n  - "), k, F.lit(": "), v)), ""))
    return files.select("path", F.concat(F.lit("## "), "path", F.lit("\n"), F.array_join(F.transform("findings", line), "\n")).alias("section"))


def terminal_lines(files: DataFrame) -> DataFrame:
    """(path, line): one line a finding; a safe one shows its summary, else its subject, else its description."""
    rows = exploded(files).where("category IS NOT NULL")
    shown = F.when(F.col("category") == SAFE, F.coalesce(F.try_element_at("extracted_data", F.lit("summary")), F.try_element_at("extracted_data", F.lit("subject")), "description")).otherwise(F.col("description"))
    return rows.select("path", "pos", F.concat(F.lit("["), "severity", F.lit("] "), "category", F.lit(": "), shown).alias("line"))


def html_rows(files: DataFrame) -> DataFrame:
    """One row a file for an HTML page: base name, categories, greatest severity and the first explanation."""
    risky = F.filter("findings", lambda f: f["category"] != SAFE)
    words = F.filter("findings", lambda f: (f["category"] == SAFE) & (F.coalesce(f["description"], F.lit("")) != ""))
    return files.select(basename(F.col("path")).alias("name"), F.array_join(F.array_distinct(F.transform(risky, lambda f: f["category"])), ", ").alias("categories"), severity_name(F.array_max(F.transform(risky, lambda f: f["sev_rank"]))).alias("severity"), F.coalesce(F.get(words, F.lit(0))["description"], F.lit("No description.")).alias("explanation"))


def finding_cells(files: DataFrame) -> DataFrame:
    """(path, pos, value): each risky finding as a row of an HTML table: file, severity, category, description, evidence; values are escaped."""
    rows = exploded(files).where(F.col("category") != SAFE)
    return rows.select("path", "pos", _cells("path", "severity", "category", "description", "evidence").alias("value"))


def file_cells(files: DataFrame) -> DataFrame:
    """(path, value): each file as a row of an HTML table: path, kind, greatest severity or clean, and its categories or what a safe finding says."""
    risky = F.filter("findings", lambda f: f["category"] != SAFE)
    calm = F.get(F.filter("findings", lambda f: f["category"] == SAFE), F.lit(0))
    told = lambda key: F.nullif(F.try_element_at(calm["extracted_data"], F.lit(key)), F.lit(""))
    said = F.coalesce(told("summary"), told("subject"), told("visual_description"), calm["description"], F.lit("No findings"))
    flagged = F.coalesce(F.size(risky) > 0, F.lit(False))
    status = F.when(flagged, severity_name(F.array_max(F.transform(risky, lambda f: f["sev_rank"])))).otherwise("clean")
    label = F.when(flagged, F.array_join(F.array_distinct(F.transform(risky, lambda f: f["category"])), ", ")).otherwise(said)
    return files.select("path", "kind", status.alias("status"), label.alias("label")).select("path", _cells("path", "kind", "status", "label").alias("value"))


def _cells(*columns: str) -> Column:
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), escape_html(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in columns], F.lit("</tr>"))


#: Of a page: tabs; rows of the first table show by the words typed and the severity and category chosen; a click on a head sorts.
PAGE_SCRIPT = """const box=id=>document.getElementById(id),rows=t=>[...box(t).tBodies[0].rows];
function show(){const w=box('words').value.toLowerCase(),s=box('grade').value,c=box('kind').value;
rows('found').forEach(r=>{const v=[...r.cells].map(x=>x.textContent);
r.hidden=!([v[0],v[3],v[4]].some(x=>x.toLowerCase().includes(w))&&(!s||v[1]===s)&&(!c||v[2]===c))})}
const grades=['','info','low','medium','high','critical'];
['found','all'].forEach(t=>[...box(t).tHead.rows[0].cells].forEach((h,k)=>h.onclick=()=>{const up=h.dataset.up!=='1';h.dataset.up=up?'1':'0';
const key=r=>t==='found'&&k===1?grades.indexOf(r.cells[k].textContent):r.cells[k].textContent;
rows(t).sort((a,b)=>(key(a)>key(b)?1:key(a)<key(b)?-1:0)*(up?1:-1)).forEach(r=>r.parentNode.append(r))}));
document.querySelectorAll('button').forEach(b=>b.onclick=()=>['found','all'].forEach(t=>box('of-'+t).hidden=t!==b.value));
box('words').oninput=show;box('grade').onchange=show;box('kind').onchange=show;"""


def html_pieces(files: DataFrame, title: str = "Scan report") -> list[str | DataFrame]:
    """A page with counts, a table of findings to filter and sort, and one of all files, in pieces for `document_text` or `write_document`."""
    one = summary(files).first()
    counts = "".join(f"<li>{name}: {one[name] or 0}</li>" for name in ("files", "flagged", "clean", "findings", *reversed(SEVERITIES)))
    per = category_counts(files)
    name = escape_html(F.col("category"))
    bars = per.orderBy(F.desc("n"), "category").select(F.concat(F.lit("<li>"), name, F.lit(": "), F.col("n").cast("string"), F.lit("</li>")).alias("value"))
    options = per.orderBy("category").select(F.concat(F.lit("<option>"), name, F.lit("</option>")).alias("value"))
    grades = "".join(f"<option>{s}</option>" for s in ("", *reversed(SEVERITIES)))
    heads = lambda *names: "<thead><tr>" + "".join(f"<th>{n}</th>" for n in names) + "</tr></thead><tbody>\n"
    return [
        f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><ul>{counts}</ul><ul>\n",
        bars,
        f"</ul><button value=found>Findings ({one['findings']})</button><button value=all>All files ({one['files']})</button><div id=of-found><input id=words placeholder=Filter><select id=grade>{grades}</select><select id=kind><option></option>\n",
        options,
        f"</select><table id=found>{heads('File', 'Severity', 'Category', 'Description', 'Evidence')}",
        finding_cells(files).orderBy("path", "pos"),
        f"</tbody></table></div><div id=of-all hidden><table id=all>{heads('File', 'Type', 'Status', 'Classification')}",
        file_cells(files).orderBy("path"),
        f"</tbody></table></div><script>{PAGE_SCRIPT}</script>\n",
    ]


def html_page(files: DataFrame, title: str = "Scan report") -> str:
    """The page as a text, of REPORT_ROWS findings and files at most; all values are escaped."""
    return document_text(html_pieces(files, title), "")


# File endings by format.
ENDINGS = {"json": "json", "markdown": "md", "sarif": "sarif.json", "html": "html"}


def file_name(kind: str, when) -> str:
    """Name of a report's file for a time in UTC."""
    return f"scan_{when:%Y%m%d_%H%M%S}.{ENDINGS.get(kind, 'txt')}"


def formatted(files: DataFrame, kind: str) -> str:
    """The report as text: json, markdown, sarif, html; any other name gives the terminal's lines."""
    if kind == "json":
        return "[" + ",\n".join(r["json"] for r in bounded(json_lines(files), "path")) + "]"
    if kind == "markdown":
        return "\n\n".join(r["section"] for r in bounded(markdown_sections(files), "path"))
    if kind == "sarif":
        return sarif(files)
    if kind == "html":
        return html_page(files)
    return "\n".join(r["line"] for r in bounded(terminal_lines(files), "path", "pos"))


def save(files: DataFrame, kind: str, folder: str, when) -> list[str]:
    """Write a report of any size, as text files in path order in a folder named for the time, and always as JSON lines too; the folders' paths.

    markdown, json and the terminal's lines are written by Spark, a line or section a record; html and sarif, which are
    one document, as one file, whatever its size.
    """
    lines = {"json": json_lines(files).select("path", F.lit(0).alias("pos"), F.col("json").alias("value")), "markdown": markdown_sections(files).select("path", F.lit(0).alias("pos"), F.concat("section", F.lit("\n")).alias("value"))}
    out = []
    for name in dict.fromkeys((kind, "json")):
        at = f"{folder.rstrip('/')}/{file_name(name, when)}"
        if name in ("html", "sarif"):
            out.append(write_document(files.sparkSession, (html_pieces if name == "html" else sarif_pieces)(files), at, "" if name == "html" else ","))
        else:
            rows = (lines[name] if name in lines else terminal_lines(files).select("path", "pos", F.col("line").alias("value"))).orderBy("path", "pos").select("value")
            rows.write.text(at)
            out.append(at)
    return out
