"""Text of office files, mail and images' OCR tables. Formats need Python, so these are Arrow UDFs of small helpers."""

from __future__ import annotations

import email
import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftstone.sources.headers import POLICY

_TAG, _SPACE = re.compile(r"<[^>]*>"), re.compile(r"\s+")


def _plain(xml: bytes) -> str:
    return _SPACE.sub(" ", _TAG.sub(" ", xml.decode("utf-8", "replace"))).strip()


def _docx(z: zipfile.ZipFile) -> str:
    return _plain(z.read("word/document.xml"))


def _pptx(z: zipfile.ZipFile) -> str:
    slides = sorted(n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n))
    return "\n\n".join(f"[Slide {i}]\n{_plain(z.read(n))}" for i, n in enumerate(slides, 1))


def _xlsx(z: zipfile.ZipFile) -> str:
    shared = [_plain(m.encode()) for m in re.findall(r"<si>.*?</si>", z.read("xl/sharedStrings.xml").decode("utf-8", "replace"), re.S)] if "xl/sharedStrings.xml" in z.namelist() else []
    names = re.findall(r'<sheet [^>]*name="([^"]*)"', z.read("xl/workbook.xml").decode("utf-8", "replace"))
    out = []
    for i, name in enumerate(names, 1):
        if (part := f"xl/worksheets/sheet{i}.xml") not in z.namelist():
            continue
        rows = []
        for row in re.findall(r"<row[ >].*?</row>", z.read(part).decode("utf-8", "replace"), re.S):
            cells = []
            for attrs, body in re.findall(r"<c([^>]*)>(.*?)</c>", row, re.S):
                value = _plain(body.encode())
                cells.append(shared[int(value)] if 't="s"' in attrs and value.isdigit() and int(value) < len(shared) else value)
            if any(cells):
                rows.append("\t".join(cells))
        out.append(f"[Sheet: {name}]\n" + "\n".join(rows))
    return "\n\n".join(out)


_OFFICE = {"docx": _docx, "pptx": _pptx, "xlsx": _xlsx}


def office_text(ext: str, content: bytes | None) -> str | None:
    """Text of a docx, pptx or xlsx file; null if it cannot be read or holds none."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            return _OFFICE[ext](z) or None
    except (KeyError, zipfile.BadZipFile, ValueError):
        return None


@F.pandas_udf(T.StringType())
def office(ext: pd.Series, content: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else office_text(e, c) for e, c in zip(ext, content)], dtype=object)


def mail_parts(content: bytes | None) -> list[tuple[int, str, str, str, bytes]]:
    """(part_no, name, content_type, text, bytes): part 0 is headers and body, the others attachments."""
    message = email.message_from_bytes(content or b"", policy=POLICY)
    body = message.get_body(("plain", "html"))
    try:
        text = "" if body is None else body.get_content()
    except (LookupError, ValueError):  # a charset that isn't known, or isn't the text's
        text = (body.get_payload(decode=True) or b"").decode("utf-8", "replace")
    if body is not None and body.get_content_type() == "text/html":
        text = _TAG.sub(" ", text)
    head = "\n".join(f"{name}: {message[name]}" for name in ("From", "To", "Subject") if message[name])
    out = [(0, str(message["Subject"] or ""), "message", f"{head}\n\n{text}", b"")]
    for i, part in enumerate(message.iter_attachments(), 1):
        data = part.get_payload(decode=True) or b""
        out.append((i, part.get_filename() or "", part.get_content_type(), data.decode("utf-8", "replace")[:5000] if part.get_content_maintype() == "text" else "", data))
    return out


_FROM = re.compile(rb"^From .*\r?\n", re.M)


def mailbox_messages(content: bytes | None) -> list[bytes]:
    """The messages of an mbox file: each begins at a line "From ...". A file without such a line is one message."""
    data = content or b""
    at = [m for m in _FROM.finditer(data) if m.start() == 0 or data[: m.start()].endswith((b"\n\n", b"\r\n\r\n"))]
    if not at:
        return [data]
    ends = [m.start() for m in at[1:]] + [len(data)]
    return [data[m.end() : end] for m, end in zip(at, ends)]


@F.pandas_udf(T.StringType())
def mail_text(content: pd.Series) -> pd.Series:
    """Headers and bodies of all messages of a mail file, blank lines between them; null if it holds none."""
    return content.map(lambda c: "\n\n".join(mail_parts(m)[0][3] for m in mailbox_messages(c)).strip() or None, na_action="ignore")


def mail(files: DataFrame) -> DataFrame:
    """One row a part of each file (path, content), of all its messages: path, part_no, name, content_type, text, content."""

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                parts = [part for m in mailbox_messages(content) for part in mail_parts(m)]
                rows += [(path, k, *part[1:]) for k, part in enumerate(parts)]
            yield pd.DataFrame(rows, columns=["path", "part_no", "name", "content_type", "text", "content"])

    return files.select("path", "content").mapInPandas(parts, "path string, part_no int, name string, content_type string, text string, content binary")


def ocr_text(words: DataFrame) -> DataFrame:
    """(path, text, confidence) from rows of an OCR table (path, word_no, block, line, conf, word).

    Words of negative confidence are left out; a new block starts a paragraph, a new line a line.
    """
    w = Window.partitionBy("path").orderBy("word_no")
    rows = words.where("conf >= 0").withColumn("b", F.lag("block").over(w)).withColumn("l", F.lag("line").over(w))
    gap = F.when(F.col("b").isNull(), "").when(F.col("b") != F.col("block"), "\n\n").when(F.col("l") != F.col("line"), "\n").otherwise(" ")
    pieces = rows.select("path", "conf", F.struct("word_no", F.concat(gap, "word").alias("t")).alias("p"))
    return pieces.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"]), "").alias("text"), F.avg("conf").cast("float").alias("confidence"))


def text_of(path_extension: Column, content: Column) -> Column:
    """Text by format: office files, PDF and mail by their UDFs, old binary formats by printable runs, others as UTF-8.

    A PDF without a reader, and a broken office file, have no text (null).
    """
    from siftstone.sources.files import decoded, printable_runs

    of = path_extension.isin
    return F.when(of(*_OFFICE), office(path_extension, content)).when(of("pdf"), pdf(content)).when(of("eml", "mbox"), mail_text(content)).when(of("doc", "xls", "ppt", "msg"), printable_runs(content)).otherwise(decoded(content))


def pdf_text(content: bytes | None) -> str | None:
    """Text of a PDF's pages if a reader is installed; null otherwise, or if there is no text."""
    try:
        import pypdf
    except ImportError:
        return None
    try:
        return "\n\n".join(page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(content or b"")).pages).strip() or None
    except Exception:  # a broken file has no text
        return None


@F.pandas_udf(T.StringType())
def pdf(content: pd.Series) -> pd.Series:
    return content.map(pdf_text, na_action="ignore")
