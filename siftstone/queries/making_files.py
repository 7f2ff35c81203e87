"""Files made from documents: mailboxes in splits, parts of mails, findings of whole mails, trees of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.folders import work_folder
from siftstone.operators import generators
from siftstone.operators.report import exploded
from siftstone.plans.scan import mail_findings
from siftstone.queries.base import FILES, documents, files, query, table
from siftstone.sources import listing, mailboxes
from siftstone.sources.files import changed_files as changed

BODY = "regexp_replace(text, '\\s+$', '')"


@query(f"SELECT doc_id, CAST(strlen(body) AS BIGINT) AS bytes, sha256(body) AS digest FROM (SELECT doc_id, {BODY} AS body FROM documents)")
def mailbox_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a message of a mailbox, written, and read again in splits."""
    mail = F.concat(F.lit("From sender@example.org Mon Jan  1 10:00:00 2024\nSubject: "), F.col("doc_id").cast("string"), F.lit("\nFrom now on the header is over\n\n"), "text", F.lit("\n"))
    folder = work_folder(spark, "mailbox")
    documents(spark, sf_dir, "doc_id", "text").select(mail.alias("value")).write.text(folder)
    text = F.decode("content", "UTF-8")
    rows = mailboxes.mailbox(spark, folder).select(F.regexp_extract(text, "^Subject: (-?\\d+)", 1).cast("bigint").alias("doc_id"), F.regexp_replace(F.regexp_replace(text, "(?s)^.*?\n\n", ""), "\\s+$", "").alias("body"))
    return rows.select("doc_id", F.octet_length("body").cast("bigint").alias("bytes"), F.sha2("body", 256).alias("digest"))


def _part(kind: str, body: Column, name: str | None = None) -> Column:
    head = f"Content-Type: {kind}\nContent-Transfer-Encoding: 8bit\n" + (f'Content-Disposition: attachment; filename="{name}"\n' if name else "")
    return F.concat(F.lit(head + "\n"), body, F.lit("\n"))


def _multipart(mark: str, subject: Column, parts: list[Column]) -> Column:
    head = F.concat(F.lit("From: Anna <a@example.org>\nTo: b@example.org\nSubject: "), subject, F.lit(f'\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="{mark}"\n\n'))
    return F.concat(head, *[F.concat(F.lit(f"--{mark}\n"), p) for p in parts], F.lit(f"--{mark}--\n"))


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, content): a mail a document, with a text file and, of every third, an attached mail with a file of its own."""
    number = F.col("doc_id").cast("string")
    note = F.concat(F.lit("source "), "source")
    inner = _multipart("=in=", F.concat(F.lit("inner "), number), [_part("text/plain; charset=utf-8", F.lit("SSN 123-45-6789")), _part("text/csv; charset=utf-8", F.concat(F.lit("lang,"), "lang"), "l.csv")])
    nested = F.concat(F.lit("--=out=\nContent-Type: message/rfc822\n\n"), inner, F.lit("\n"))
    first = [_part("text/plain; charset=utf-8", F.col("text")), _part("text/plain; charset=utf-8", note, "note.txt")]
    outer = _multipart("=out=", F.concat(F.lit("doc "), number), first)
    with_nested = F.concat(F.substring(outer, F.lit(1), F.length(outer) - len("--=out=--\n")), nested, F.lit("--=out=--\n"))
    return documents(spark, sf_dir, "doc_id", "text", "source", "lang").select("doc_id", F.when(F.col("doc_id") % 3 == 0, with_nested).otherwise(outer).cast("binary").alias("content"))


HEAD = "'From: Anna <a@example.org>' || chr(10) || 'To: b@example.org' || chr(10) || 'Subject: '"
PART_ROWS = f"""SELECT doc_id, 0 AS part_no, NULL AS parent_no, 0 AS depth, 'message' AS kind, 'doc ' || doc_id AS name, {HEAD} || 'doc ' || doc_id || chr(10) || chr(10) || text AS text FROM documents
UNION ALL SELECT doc_id, 1, 0, 0, 'attachment', 'note.txt', 'source ' || source FROM documents
UNION ALL SELECT doc_id, 2, 0, 1, 'message', 'inner ' || doc_id, {HEAD} || 'inner ' || doc_id || chr(10) || chr(10) || 'SSN 123-45-6789' FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 3, 2, 1, 'attachment', 'l.csv', 'lang,' || lang FROM documents WHERE doc_id % 3 = 0"""


@query(f"SELECT doc_id, CAST(part_no AS INT) AS part_no, CAST(coalesce(parent_no, -1) AS INT) AS parent_no, CAST(depth AS INT) AS depth, kind, name, sha256(text) AS digest FROM ({PART_ROWS})")
def mail_part_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mailboxes.mail_parts(mails(spark, sf_dir))
    return rows.select("doc_id", "part_no", F.coalesce("parent_no", F.lit(-1)).alias("parent_no"), "depth", "kind", "name", F.sha2("text", 256).alias("digest"))


@query(f"""SELECT doc_id, pos, subcategory, evidence FROM (
  SELECT doc_id, 0 AS pos, 'pii.contact' AS subcategory, 'pii.contact' AS evidence FROM documents WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END, 'financial.transaction', 'financial.transaction' FROM documents WHERE doc_id % 2 = 0)""")
def mail_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that answers give of mails' parts, merged into one row a mail; without those of the rule net."""
    parts = mailboxes.mail_parts(mails(spark, sf_dir))
    # Answers come from ids by rule, as in other queries: mails are taken apart once.
    numbers = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.when(F.col("doc_id") % 3 == 0, F.sequence(F.lit(0), F.lit(3))).otherwise(F.sequence(F.lit(0), F.lit(1)))).alias("part_no"))
    of = lambda sub: f'[{{"category": "{sub.split(".")[0]}", "subcategory": "{sub}", "severity": "low", "explanation": "seen"}}]'
    said = F.when((F.col("part_no") == 0) & (F.col("doc_id") % 5 == 0), of("pii.contact")).when((F.col("part_no") == 1) & (F.col("doc_id") % 2 == 0), of("financial.transaction")).when(F.col("part_no") > 0, of("safe.config"))
    answers = numbers.select(F.concat_ws("#", "doc_id", "part_no").alias("doc_id"), F.lit(0).alias("chunk_no"), said.alias("response")).where("response IS NOT NULL")
    rows = mail_findings(parts, answers, key=["doc_id"])
    files = rows.select(F.col("doc_id").alias("path"), F.lit("text").alias("kind"), F.lit(0).alias("size"), "findings")
    return exploded(files).where("subcategory IN ('pii.contact', 'financial.transaction') AND source <> 'regex'").select(F.col("path").alias("doc_id"), "pos", "subcategory", "evidence")


@query("""SELECT lang AS what, CAST(sum(strlen(text) + 1) AS BIGINT) AS n FROM documents WHERE lang <> 'de' GROUP BY lang
UNION ALL SELECT 'ignored folder', CAST(count(DISTINCT lang) AS BIGINT) FROM documents WHERE lang = 'de' HAVING count(*) > 0 UNION ALL SELECT 'empty', 1""")
def tree_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree with all documents in a folder for each language, listed without one of them: bytes found, and what was skipped."""
    folder = work_folder(spark, "languages")
    documents(spark, sf_dir, "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL").write.partitionBy("lang").text(folder)
    found, skipped = listing.discover_tree(spark, folder, most_bytes=1 << 50, kinds=["text"], patterns=["lang=de/"])
    bytes_of = found.groupBy(F.regexp_extract("relative", "lang=([^/]+)/", 1).alias("what")).agg(F.sum("size").alias("n"))
    return bytes_of.unionByName(skipped.where("reason IN ('ignored folder', 'empty')").select(F.col("reason").alias("what"), "n"))


@query(f"SELECT path, size FROM ({FILES}) WHERE doc_id % 7 = 0")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files among a list of changed paths that is a table itself."""
    rows = files(spark, sf_dir)
    number = F.regexp_extract("path", "/(-?\\d+)\\.[a-z]+$", 1).cast("bigint")
    paths = rows.where(number % 7 == 0).select(F.concat(F.lit("./"), "path")).union(table(spark, sf_dir, "documents").select(F.concat(F.lit("gone/"), F.col("doc_id").cast("string"))))
    return changed(rows.withColumn("path", F.concat(F.lit("file:/repo/"), "path")), paths, "file:/repo").select(F.regexp_replace("path", "^file:/repo/", "").alias("path"), "size")


RULES = {
    "note": [(2, "Dear team, {body} Regards."), (1, "Log é: {body}")],
    "body": [(1, "the number is {ssn:pii.identity}."), (3, "pay {card:financial.credit_card} for order {number}, says {who}.")],
    "who": [(1, "nobody"), (1, "the holder of {web_token:credentials.token}")],
}


def _draw_sql(path: str, n: int) -> str:
    return f"CAST('0x' || substring(sha256('42|' || doc_id || '|{path}'), 1, 12) AS BIGINT) % {n}"


def _digits_sql(path: str, n: int, first: int = 0) -> str:
    return "concat(" + ", ".join(f"CAST('0x' || substring(sha256('42|' || doc_id || '|{path}|value'), {1 + 2 * (first + k)}, 2) AS INT) % 10" for k in range(n)) + ")"


SSN = f"'9' || {_digits_sql('0.0.0', 2)} || '-' || {_digits_sql('0.0.0', 2, 2)} || '-' || {_digits_sql('0.0.0', 4, 4)}"
CARD = f"'4000-' || {_digits_sql('0.0.0', 4)} || '-' || {_digits_sql('0.0.0', 4, 4)} || '-' || {_digits_sql('0.0.0', 4, 8)}"
BODY_CHOICE = f"CASE WHEN {_draw_sql('0.0', 4)} < 1 THEN 'ssn' ELSE 'card' END"


@query(f"""SELECT doc_id, opening, kind, planted, place, planted_tokens FROM (
  SELECT doc_id, CASE WHEN {_draw_sql('0', 3)} < 2 THEN 'Dear team, ' ELSE 'Log é: ' END AS opening, {BODY_CHOICE} AS kind,
    CASE WHEN {BODY_CHOICE} = 'ssn' THEN {SSN} ELSE {CARD} END AS planted,
    CAST(CASE WHEN {_draw_sql('0', 3)} < 2 THEN 11 ELSE 7 END + CASE WHEN {BODY_CHOICE} = 'ssn' THEN 14 ELSE 4 END AS INT) AS place,
    CAST(CASE WHEN {BODY_CHOICE} = 'card' AND {_draw_sql('0.0.2', 2)} = 1 THEN 1 ELSE 0 END AS INT) AS planted_tokens FROM documents)""")
def generated_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled text for each document: what it opens with, and what was planted where."""
    rows = generators.expanded(table(spark, sf_dir, "documents").select("doc_id"), generators.grammar_table(spark, RULES), "note", key="doc_id")
    first = F.col("findings")[0]
    begin, end = (first["extracted_data"][x].cast("int") for x in ("begin", "end"))
    tokens = F.size(F.filter("findings", lambda f: (f["subcategory"] == "credentials.token") & (F.size(F.split(f["evidence"], "\\.")) == 3)))
    opening = F.when(F.col("text").startswith("Dear"), "Dear team, ").otherwise(F.substring("text", 1, 7))
    kind = F.when(first["subcategory"] == "pii.identity", "ssn").otherwise("card")
    return rows.select("doc_id", opening.alias("opening"), kind.alias("kind"), F.substring(F.col("text"), begin + 1, end - begin).alias("planted"), begin.alias("place"), tokens.alias("planted_tokens"))
