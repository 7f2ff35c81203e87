"""Files as rows: discovery, ignore patterns, kinds, text."""

from __future__ import annotations

import re
import subprocess
from functools import reduce
from operator import or_
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions.text import extension

# Extensions by kind, the first bytes (hex) of images, and the bytes of a text that are read.
TEXT = [
    "txt", "csv", "json", "xml", "yaml", "yml", "toml", "ini", "cfg", "conf", "log", "md", "rst", "html", "htm", "css", "js", "ts", "py", "rs", "go", "java", "c", "cpp", "h", "hpp",
    "rb", "php", "sh", "bash", "zsh", "sql", "env", "pem", "key", "crt", "pub", "tex", "rtf", "pdf", "docx", "doc", "xlsx", "xls", "pptx", "tsv", "eml", "msg", "mbox",
]
IMAGE = ["png", "jpg", "jpeg", "gif", "bmp", "tiff", "tif", "webp"]
EMAIL = ["pst", "ost"]
# What HTML begins with by the WHATWG sniffing rules, each followed by a space or ">".
HTML_STARTS = ["!doctype html", "html", "head", "script", "iframe", "h1", "div", "font", "table", "a", "style", "title", "b", "body", "br", "p", "!--"]
IMAGE_MAGIC = ["89504E47", "FFD8FF", "47494638", "424D", "49492A00", "4D4D002A", "52494646"]
TEXT_BYTES = 10 * 1024 * 1024
IGNORE_FILE = ".scanignore"


def kind_of(path: Column, content: Column | None = None) -> Column:
    """text, image, email or unknown, by extension; without a known one by the first bytes, if content is given: those of images, HTML, XML and scripts."""
    ext = extension(path)
    by_name = F.when(ext.isin(TEXT), "text").when(ext.isin(IMAGE), "image").when(ext.isin(EMAIL), "email")
    if content is None:
        return by_name.otherwise("unknown")
    head = F.hex(F.substring(content, 1, 8))
    start = F.decode(F.substring(content, 1, 512), "ISO-8859-1")
    markup = start.rlike(f"(?i)^\\s*<(?:{'|'.join(HTML_STARTS)})[ >]") | start.rlike("^\\s*<\\?xml") | start.startswith("#!")
    return by_name.when(reduce(or_, (head.startswith(m) for m in IMAGE_MAGIC)), "image").when(markup, "text").otherwise("unknown")


def ignored(relative: Column, patterns: list[str]) -> Column:
    """Whether a path below the root is ignored.

    A plain name or one with a final slash ignores any part of that name; *.ext an extension; one with ** what starts
    and ends like its two halves. Other patterns match nothing.
    """
    parts, tests = F.split(relative, "/"), [F.lit(False)]
    for p in patterns:
        if "*" not in p and "/" not in p:
            tests.append(F.array_contains(parts, p))
        elif p.startswith("*."):
            tests.append(F.substring_index(relative, "/", -1).rlike(f"^.+\\.{_quoted(p[2:])}$"))
        elif "**" in p:
            halves = p.split("**")
            if len(halves) == 2:
                tests.append(relative.startswith(halves[0].rstrip("/")) & relative.endswith(halves[1].lstrip("/")))
        elif p.endswith("/"):
            tests.append(F.array_contains(parts, p.rstrip("/")))
    return reduce(or_, tests)


def _quoted(x: str) -> str:
    return "".join(f"\\{c}" if c in ".+*?()[]{}|^$\\" else c for c in x)


def ignore_patterns(*folders: str) -> list[str]:
    """Lines of the folders' ignore files, without blank ones and comments."""
    out = []
    for folder in folders:
        if (file := Path(folder) / IGNORE_FILE).is_file():
            out += [s for line in file.read_text().splitlines() if (s := line.strip()) and not s.startswith("#")]
    return out


def scan_root(path: str) -> str:
    """The folder to scan: a blank path, "/", "." and "./" mean the working folder, relative paths lie below it; URLs stay."""
    path = path.strip()
    if re.match(r"^[a-zA-Z][\w+.-]*:", path):
        return path
    return str(Path.cwd() if path in ("", "/", ".", "./") else (Path.cwd() / path).resolve())


def discover(spark: SparkSession, path: str, most_bytes: int = 100 * 1024 * 1024, kinds: list[str] | None = None, patterns: list[str] | None = None, with_content: bool = True) -> tuple[DataFrame, DataFrame]:
    """(files, skipped): files are path, kind, size, [content]; skipped counts the others by reason.

    Only sizes and names are read for the decision; contents are read for what is left. Spark lists no files of length 0, so
    these are neither found nor counted. A path that isn't there is Spark's error.
    """
    path = scan_root(path)
    root = path.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    relative = F.regexp_replace(F.col("path"), f"^(?:file:)?/*{_quoted(root.lstrip('/'))}/*", "")
    kind = kind_of(F.col("path"))
    rows = found.select("path", relative.alias("relative"), kind.alias("kind"), F.col("length").alias("size"), *["content"] * with_content)
    why = (
        F.when(ignored(F.col("relative"), patterns or []), "ignored")
        .when(F.col("size") > most_bytes, "too large")
        .when(F.col("kind") == "unknown", "unknown kind")
        .when(~F.col("kind").isin(kinds) if kinds and "all" not in kinds else F.lit(False), "other kind")
    )
    rows = rows.withColumn("reason", why)
    skipped = rows.drop("content").where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return rows.where("reason IS NULL").drop("reason", "relative"), skipped


def decoded(content: Column) -> Column:
    """Text of a file's first 10 MB; bytes that are no UTF-8 become replacement marks."""
    return F.make_valid_utf8(F.substring(content, 1, TEXT_BYTES).cast("string"))


def printable_runs(content: Column, least: int = 4) -> Column:
    """Runs of printable ASCII of an old binary format, a space between them."""
    return F.array_join(F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(f"[\\x20-\\x7e\\n\\t]{{{least},}}"), F.lit(0)), " ")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines; blank and broken lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of CSV with a header; quoted line ends and doubled quotes are honoured, broken rows left out."""
    return spark.read.schema(schema).options(header=True, multiLine=True, quote='"', escape='"', mode="DROPMALFORMED").csv(path)


def plain_lines(spark: SparkSession, path: str, most: int | None = None, seed: int = 42) -> DataFrame:
    """(value) of lines that are neither blank nor comments; `most` keeps that many by a seeded order."""
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.trim(F.col("value")).startswith("#"))
    return rows if most is None else rows.orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), "value"), 256), "value").limit(most)


def one_text(spark: SparkSession, text: str, label: str = "<stdin>") -> DataFrame:
    """A text as a file row; a blank one is an error."""
    if not text.strip():
        raise ValueError("no text")
    return spark.createDataFrame([(label, "text", len(text.encode()), text)], "path string, kind string, size long, text string")


def changed_paths(spark: SparkSession, folder: str, since: str) -> DataFrame:
    """(value) of paths, relative to a repository's top folder, that git says have changed since a commit; deleted ones are among them."""
    run = subprocess.run(["git", "-C", folder, "diff", "--name-only", "-z", since, "--"], capture_output=True)
    if run.returncode:
        raise ValueError(run.stderr.decode(errors="replace").strip())
    return spark.createDataFrame([(p,) for p in run.stdout.decode(errors="replace").split("\0") if p], "value string")


def tidy_path(path: Column) -> Column:
    """A path without empty and "." parts, and without a slash at either end."""
    return F.array_join(F.filter(F.split(path, "/"), lambda p: ~p.isin("", ".")), "/")


def changed_files(files: DataFrame, paths: DataFrame | list[str], root: str | None = None) -> DataFrame:
    """Files (path) that are among changed `paths`: a list, or a table whose first column holds them, of any length.

    Paths are relative to `root`; without a root, a file is changed if its path ends with one. Joined by equal paths; blank
    and null ones match nothing, repeated ones once.
    """
    table = files.sparkSession.createDataFrame([(p,) for p in paths], "value string") if isinstance(paths, list) else paths
    changed = table.toDF(*[f"c{k}" for k in range(len(table.columns))]).select(tidy_path(F.col("c0")).alias("__changed")).where("__changed <> ''")
    if root is not None:
        top = F.length(tidy_path(F.lit(root)))
        path = tidy_path(F.col("path"))
        inside = F.when(path.startswith(F.concat(tidy_path(F.lit(root)), F.lit("/"))), F.substring(path, top + 2, F.length(path)))
        return files.withColumn("__relative", inside).join(changed, F.col("__relative") == F.col("__changed"), "left_semi").drop("__relative")
    parts = F.split(tidy_path(F.col("path")), "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    hit = files.select(F.col("path").alias("__path"), F.explode(ends).alias("__end")).join(changed, F.col("__end") == F.col("__changed"), "left_semi")
    return files.join(hit, F.col("path") == F.col("__path"), "left_semi")
