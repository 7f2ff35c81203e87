"""The scan from texts to findings, as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions.responses import parse_detailed, parse_findings, repaired_tail
from siftstone.functions.rules import rule_numbers, safety_net
from siftstone.functions.text import chunks
from siftstone.operators.findings import SAFE, enriched, merge_nested, with_default
from siftstone.schema import FINDINGS, finding


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt over the cores where a table comes in fewer pieces than there are; work on texts outweighs the move. Larger tables stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def chunked(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, chunk_no, chunk): what a model is asked about."""
    return docs.select("doc_id", F.posexplode(chunks(F.col(text))).alias("chunk_no", "chunk"))


def scan(docs: DataFrame, responses: DataFrame | None = None, text: str = "text") -> DataFrame:
    """doc_id, path, kind, size, findings of each document (doc_id, text).

    responses: a model's answers by chunk (doc_id, chunk_no, response). Findings of a document's chunks are merged; the
    rule net adds what the model has no category for; a document without any gets a safe one. Of an answer that breaks off
    counts what can be read.
    """
    base = docs.select("doc_id", F.col(text).alias("text"))
    if responses is None:
        base = base.withColumn("found", F.array().cast(FINDINGS))
    else:
        whole = responses.select("doc_id", "chunk_no", "response", repaired_tail(F.col("response")).alias("tail"))
        parsed = whole.select("doc_id", "chunk_no", parse_findings(F.col("response"), tail=F.col("tail")).alias("f"))
        lists = parsed.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "f")), lambda a, b: a["chunk_no"] - b["chunk_no"]), lambda c: c["f"])).alias("found"))
        base = base.join(lists, "doc_id", "left").withColumn("found", merge_nested(F.coalesce("found", F.array().cast(FINDINGS))))
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    # One step a projection: each is read several times by the next, and Spark doesn't inline what is costly.
    base = base.withColumn("numbers", rule_numbers(F.col("text")))
    base = base.withColumn("all", F.concat("found", safety_net(F.col("text"), F.col("found"), numbers=F.col("numbers"))))
    base = base.withColumn("all", enriched(F.col("all"), path, F.col("text")))
    return base.select("doc_id", path.alias("path"), F.lit("text").alias("kind"), F.octet_length("text").cast("bigint").alias("size"), with_default(F.col("all"), F.col("text")).alias("findings"))


# Characters of OCR text shown as evidence, and of attachments that are looked at.
EXCERPT, ATTACHMENT_CHARS = 200, 5000


def image_findings(images: DataFrame) -> DataFrame:
    """(path, findings) of images (path, ocr_text, response): a vision model's answer, with the OCR text as evidence.

    Text that the model says nothing of is unclassified, of medium severity; an image without both is safe. The rule net
    doesn't read images' text.
    """
    text = F.trim(F.coalesce("ocr_text", F.lit("")))
    said = F.transform(parse_detailed(F.col("response"), "vision"), lambda f: f.withField("evidence", F.when(text != "", F.substring(text, 1, EXCERPT)).otherwise("[image content]")))
    unread = F.array(finding(F.lit("unclassified"), F.lit("unclassified"), F.lit("Text without a classification."), F.lit("medium"), F.lit("ocr"), evidence=F.substring(text, 1, EXCERPT))).cast(FINDINGS)
    safe = F.array(finding(F.lit("safe"), F.lit("safe.media"), F.lit("Nothing of concern found."), F.lit("info"), F.lit("scanner"))).cast(FINDINGS)
    return images.select("path", F.when(F.size(said) > 0, said).when(text != "", unread).otherwise(safe).alias("findings"))


def attachment_documents(parts: DataFrame) -> DataFrame:
    """(doc_id, text) of mail parts with text: "file#part" and the first characters, not chunked."""
    named = F.concat("path", F.lit("#"), F.col("part_no").cast("string"))
    return parts.where(F.trim("text") != "").select(named.alias("doc_id"), F.substring("text", 1, ATTACHMENT_CHARS).alias("text"))


def mail_documents(parts: DataFrame, key: list[str]) -> DataFrame:
    """(doc_id, chunk_no, chunk): what a model is asked about of the parts of mails: chunks of messages, the first characters of other parts with text."""
    text = F.coalesce("text", F.lit(""))
    pieces = F.when(F.col("kind") == "message", chunks(text)).otherwise(F.array(F.substring(text, 1, ATTACHMENT_CHARS)))
    return parts.where(F.trim(text) != "").select(_part_id(key).alias("doc_id"), F.posexplode(pieces).alias("chunk_no", "chunk"))


def _part_id(key: list[str]) -> Column:
    return F.concat_ws("#", *[F.col(c).cast("string") for c in key], F.col("part_no").cast("string"))


def mail_findings(parts: DataFrame, responses: DataFrame | None = None, images: DataFrame | None = None, key: list[str] | None = None) -> DataFrame:
    """One row a mail (the columns of `key`, by default path) with the findings of all its parts.

    parts: as `mailboxes.mail_parts` gives them. responses: a model's answers to `mail_documents` (doc_id, chunk_no,
    response). images: findings of image attachments (doc_id as there, findings), as from `image_findings`. Findings of a
    message's chunks are merged; of attachments and attached messages only those count that aren't safe. Each says in which
    file, mail and attachment it was found. The rule net reads the mail's own headers and body, and adds what no part has a
    category for. A mail without any finding gets a safe one.
    """
    key = key or ["path"]
    rows = parts.withColumn("part", _part_id(key))
    answered = _part_findings(responses, images)
    if answered is None:
        rows = rows.withColumn("found", F.array().cast(FINDINGS))
    else:
        rows = rows.join(answered.withColumnRenamed("doc_id", "part"), "part", "left").withColumn("found", F.coalesce("found", F.array().cast(FINDINGS)))
    root = F.col("part_no") == 0
    shown = F.when(root, F.col("found")).otherwise(F.filter("found", lambda f: f["category"] != SAFE))
    place = F.concat(F.lit("Attachment "), "name", F.lit(" of mail \""), "subject", F.lit("\""))
    context = F.map_concat(
        F.create_map(F.lit("source_file"), F.col(key[0]).cast("string"), F.lit("email_subject"), F.col("subject")),
        F.when(F.col("kind") == "message", F.create_map(F.lit("email_from"), F.col("sender"))).otherwise(F.create_map(F.lit("attachment"), F.col("name"))),
    )
    blank = lambda f: F.coalesce(f["evidence"], F.lit("")) == ""
    known = lambda f: F.map_filter(F.coalesce(f["extracted_data"], F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys(context), k))
    told = F.transform(shown, lambda f: f.withField("evidence", F.when(blank(f) & ~root, place).otherwise(f["evidence"])).withField("extracted_data", F.map_concat(known(f), context)))
    # A mail's parts came out of one value, so they fit into one again.
    whole = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("part_no", told.alias("f"))), lambda a, b: a["part_no"] - b["part_no"]).alias("p"), F.max(F.when(root, F.col("text"))).alias("text"), F.max(F.when(root, F.col("subject"))).alias("subject"))
    whole = whole.withColumn("found", F.flatten(F.transform("p", lambda x: x["f"]))).withColumn("numbers", rule_numbers(F.col("text")))
    net = F.transform(safety_net(F.col("text"), F.col("found"), numbers=F.col("numbers")), lambda f: f.withField("extracted_data", F.map_concat(F.map_filter(f["extracted_data"], lambda k, v: ~k.isin("source_file", "email_subject")), F.create_map(F.lit("source_file"), F.col(key[0]).cast("string"), F.lit("email_subject"), F.col("subject")))))
    return whole.withColumn("all", F.concat("found", net)).select(*key, with_default(F.col("all"), F.col("text")).alias("findings"))


def _part_findings(responses: DataFrame | None, images: DataFrame | None) -> DataFrame | None:
    """(doc_id, found) from answers by chunk and from findings of images."""
    made = [] if images is None else [images.select("doc_id", F.col("findings").alias("found"))]
    if responses is not None:
        whole = responses.select("doc_id", "chunk_no", "response", repaired_tail(F.col("response")).alias("tail"))
        parsed = whole.select("doc_id", "chunk_no", parse_findings(F.col("response"), tail=F.col("tail")).alias("f"))
        lists = parsed.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "f")), lambda a, b: a["chunk_no"] - b["chunk_no"]), lambda c: c["f"])).alias("found"))
        made.insert(0, lists.select("doc_id", merge_nested(F.col("found")).alias("found")))
    return made[0].unionByName(made[1]) if len(made) > 1 else made[0] if made else None
