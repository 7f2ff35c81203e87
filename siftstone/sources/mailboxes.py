"""Mail of any amount: mailbox files read in splits, and the parts of a message as a table function.

A mailbox is read by Spark's text source with the start of a separator line as record delimiter, so a file of any size is
dealt to tasks by its splits, and only one message at a time is in memory. A separator line is "From ", a sender and a time
of day and a year; other lines that begin with "From " belong to the message that they stand in. Where such a line stands
first in a split, what follows is joined to the message that the split before ends with: of each split only its first and
last message take part in that.
"""

from __future__ import annotations

import email
import re
from collections.abc import Iterator
from email.message import EmailMessage

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from siftstone.functions.text import extension
from siftstone.sources.headers import POLICY

DELIMITER = "\nFrom "
#: What follows "From " on a separator line.
SEPARATOR = re.compile(rb"\S+[ \t][^\n]*?\d{1,2}:\d{2}[^\n]*?\b\d{4}\b")
#: Messages within messages are opened this deep; deeper ones are attachments like others.
DEPTH = 20
_TAG = re.compile(r"<[^>]*>")
_PIECES = "path string, split bigint, no bigint, loose boolean, last boolean, content binary"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages of each split from its records; loose: a piece without a separator line before it."""
    at, no, loose, held = None, 0, False, []

    def row(last: bool) -> tuple:
        return (*at, no, loose, last, b"".join(held))

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["path", "split", "no", "loose", "last", "content"])

    for batch in batches:
        done, size = [], 0
        for path, split, value in zip(*(batch.column(c) for c in ("path", "split", "value"))):
            here, data = (path.as_py(), split.as_py()), value.as_py() or b""
            opens = here != at
            if opens and here[1] == 0:  # the start of a file has no delimiter before it
                first = data.startswith(b"From ") and SEPARATOR.match(data, 5)
                data, begins = (data[5:] if first else data), bool(first)
            else:
                begins = bool(SEPARATOR.match(data))
            if begins:
                data = data[data.find(b"\n") + 1 :] if b"\n" in data else b""
            if opens or begins:
                if at is not None:
                    done.append(row(last=opens))
                    size += len(done[-1][-1])
                at, no, loose, held = here, 0 if opens else no + 1, not begins, [data]
                if size > 16 << 20:
                    yield sent(done)
                    done, size = [], 0
            else:
                held += [DELIMITER.encode(), data]
        yield sent(done)
    if at is not None:
        yield sent([row(last=True)])


def mailbox(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, offset, no, content) of every message of mailbox files, without its separator line.

    offset and no order a file's messages: the start of the split, and the place there. What stands before a file's first
    separator line is a message if it isn't blank, so a file with one mail and no separator is one. Bytes are kept as they are.
    Splits follow spark.sql.files.maxPartitionBytes and don't change the messages. The files are read twice, the second
    time for the messages at the ends of splits. Spark lists no empty files.
    """
    lines = spark.read.text(path, lineSep=DELIMITER).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"))
    pieces = lines.mapInArrow(_pieces, _PIECES)
    edge = F.col("last") | F.col("loose")
    order = Window.partitionBy("path").orderBy("split", "no")
    # A loose piece goes on with the message before it; one that opens a file is a message, if it says anything.
    edges = pieces.where(edge).withColumn("opens", F.col("loose") & (F.col("split") == 0))
    edges = edges.withColumn("message", F.sum((~F.col("loose") | F.col("opens")).cast("bigint")).over(order))
    parts = F.array_sort(F.collect_list(F.struct("split", "no", "content")))
    glued = edges.groupBy("path", "message").agg(parts.alias("p"), F.max("opens").alias("opens"))
    whole = F.aggregate("p", F.lit(None).cast("binary"), lambda so_far, p: F.when(so_far.isNull(), p["content"]).otherwise(F.concat(so_far, F.lit(DELIMITER.encode()), p["content"])))
    glued = glued.select("path", F.col("p")[0]["split"].alias("offset"), F.col("p")[0]["no"].alias("no"), whole.alias("content"), "opens")
    glued = glued.where(~F.col("opens") | F.decode("content", "ISO-8859-1").rlike("\\S")).drop("opens")
    return pieces.where(~edge).select("path", F.col("split").alias("offset"), "no", "content").unionByName(glued)


def _content(part: EmailMessage) -> str:
    """Text of a part; of a character set that isn't known, or isn't the text's, what UTF-8 can read."""
    try:
        text = part.get_content()
        return text if isinstance(text, str) else (part.get_payload(decode=True) or b"").decode("utf-8", "replace")
    except (LookupError, ValueError, KeyError, AttributeError):
        return (part.get_payload(decode=True) or b"").decode("utf-8", "replace")


def _header(message: EmailMessage, name: str) -> str:
    try:
        return str(message[name] or "")
    except (ValueError, IndexError, AttributeError, TypeError):  # broken headers raise all of these when they are read
        return ""


def nested_parts(content: bytes | None) -> list[tuple]:
    """(part_no, parent_no, depth, kind, name, content_type, sender, recipient, subject, text, content) of a mail, in its order.

    kind: message (its text is its headers and body, plain text before HTML without tags) or attachment. Attached messages
    are messages, with parts of their own; a part's sender and subject are those of the message that it lies in.
    """
    out: list[tuple] = []

    def attachment(part: EmailMessage, no: int, depth: int, heads: tuple) -> None:
        data = part.get_payload(decode=True)
        if data is None:  # a multipart, or a message that is too deep
            data = part.as_bytes()
        shown = _content(part) if part.get_content_maintype() == "text" else ""
        out.append((len(out), no, depth, "attachment", part.get_filename() or "", part.get_content_type(), *heads, shown, data))

    def message(m: EmailMessage, parent: int | None, depth: int, name: str) -> None:
        no = len(out)
        heads = sender, to, subject = tuple(_header(m, h) for h in ("From", "To", "Subject"))
        body, parts = _structure(m)
        text = "" if body is None else _content(body)
        if body is not None and body.get_content_type() == "text/html":
            text = _TAG.sub(" ", text)
        head = "\n".join(f"{h}: {v}" for h, v in (("From", sender), ("To", to), ("Subject", subject)) if v)
        out.append((no, parent, depth, "message", name or subject, "message/rfc822", *heads, f"{head}\n\n{text}", b""))
        for part in parts:
            inner = part.get_payload()
            if part.get_content_type() == "message/rfc822" and isinstance(inner, list) and inner and depth < DEPTH:
                message(inner[0], no, depth + 1, part.get_filename() or "")
            else:
                attachment(part, no, depth, heads)

    message(email.message_from_bytes(content or b"", policy=POLICY), None, 0, "")
    return out


def _structure(m: EmailMessage) -> tuple[EmailMessage | None, list[EmailMessage]]:
    """Body and attachments; a message that is nothing but a file has that as its attachment."""
    try:
        body = m.get_body(("plain", "html"))
        return body, list(m.iter_attachments()) if m.is_multipart() else [m] if body is None and m.get_payload() else []
    except (AttributeError, KeyError, ValueError, IndexError, TypeError):  # the parser keeps broken structures, and fails when they are walked
        return None, []


PARTS = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in ("part_no", "parent_no", "depth")]
    + [T.StructField(n, T.StringType()) for n in ("kind", "name", "content_type", "sender", "recipient", "subject", "text")]
    + [T.StructField("content", T.BinaryType())]
)


@udtf(returnType=PARTS)
class MailParts:
    """The parts of one mail, as rows: for a lateral join with the table that holds the mails."""

    def eval(self, content: bytes):
        yield from nested_parts(content)


def register(spark: SparkSession, name: str = "mail_parts") -> str:
    """Make the table function known to SQL: SELECT m.path, p.* FROM mails m, LATERAL mail_parts(m.content) p."""
    spark.udtf.register(name, MailParts)
    return name


def mail_parts(mails: DataFrame, content: str = "content") -> DataFrame:
    """`mails` without their content, and beside each row the parts of its mail (columns of PARTS), by a lateral join.

    An attachment's `text` is that of its format (office files, PDF, mail, else as UTF-8); images have none. A null or broken
    mail is a message without text. Where `mails` has a column of a part's name, the part's gets a "_" after it.
    """
    from siftstone.sources.extract import text_of

    spark = mails.sparkSession
    function = register(spark)
    keep = [c for c in mails.columns if c != content]
    name = {c: _free(c, keep) for c in PARTS.names}
    fields = [*[f"m.`{c}`" for c in keep], *[f"p.{c} AS `{n}`" for c, n in name.items()]]
    rows = spark.sql(f"SELECT {', '.join(fields)} FROM {{mails}} m, LATERAL {function}(m.`{content}`) p", mails=mails)
    read = (F.col(name["kind"]) == "attachment") & ~F.col(name["content_type"]).startswith("text/") & ~is_image(F.col(name["name"]), F.col(name["content_type"]))
    other = text_of(extension(F.col(name["name"])), F.when(read, F.col(name["content"])))
    return rows.withColumn(name["text"], F.when(read, other).otherwise(F.col(name["text"])))


def _free(name: str, taken: list[str]) -> str:
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def is_image(name: Column, content_type: Column) -> Column:
    """Whether an attachment is an image, by its name or its declared type."""
    from siftstone.sources.files import IMAGE

    return extension(name).isin(IMAGE) | content_type.startswith("image/")
