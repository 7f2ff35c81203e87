"""Text functions as column expressions; all count characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chunk size, overlap and number of chunks; log lines a window and the least a window may have.
CHUNK, OVERLAP, CHUNKS = 5000, 500, 10
WINDOW_LINES, LEAST_LINES = 25, 5


def once(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def chunks(text: Column, size: int = CHUNK, overlap: int = OVERLAP, most: int = CHUNKS) -> Column:
    """Pieces of `size` characters, each `overlap` into the one before; the last ends with the text or is the `most`-th."""
    step = size - overlap if size > overlap else size
    last = F.least(F.lit(most - 1), F.ceil((F.length(text) - size) / step).cast("int"))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substring(text, i * step + 1, F.lit(size))))


def line_windows(text: Column, lines: int = WINDOW_LINES, least: int = LEAST_LINES) -> Column:
    """Arrays of `lines` consecutive lines, without windows of fewer than `least`."""
    all_lines = F.split(text, "\n")
    windows = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_lines) - 1) / lines).cast("int")), lambda i: F.slice(all_lines, i * lines + 1, F.lit(lines)))
    return F.filter(windows, lambda w: F.size(w) >= least)


def cut_at_word(text: Column, most: int, mark: str = "\n[...truncated...]") -> Column:
    """The first `most` characters, back to the last space if that keeps over 70 %, and a mark; shorter texts as they are."""
    head = F.substring(text, 1, most)
    space = most - F.locate(" ", F.reverse(head))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.when((F.locate(" ", head) > 0) & (space > most * 0.7), F.substring(head, F.lit(1), space)).otherwise(head), F.lit(mark)))


def strip_tags(markup: Column, collapse: bool = False) -> Column:
    """Each tag as a space; collapse: runs of white space as one space, outer ones off."""
    plain = F.regexp_replace(markup, "<[^>]*>", " ")
    return F.trim(F.regexp_replace(plain, "\\s+", " ")) if collapse else plain


def first_line(text: Column, most: int = 120) -> Column:
    """First line of over five characters that doesn't look like a rule, heading or comment; else the text's start."""
    # The search ends with the line; the whole text is only trimmed where it has none. A run of spaces is tried once, from its start.
    good = once(F.regexp_extract(text, r"(?:\A|\n)[^\S\n]*+([^\s=\-#*/][^\n]{4,}\S)", 1), lambda x: F.when(x != "", x))
    return F.substring(F.coalesce(good, F.regexp_replace(text, r"^\s+|(?<!\s)\s+$", "")), 1, most)


# Words in the first line that tell the kind of a document, in order of precedence.
CONTEXTS = [
    ("email message", ["message-id", "from:"]),
    ("medical record", ["patient", "dob:"]),
    ("CRS report", ["crs report"]),
    ("security advisory", ["advisory", "cve"]),
    ("meeting notes", ["meeting"]),
    ("job posting", ["job description"]),
]


def document_context(text: Column) -> Column:
    return once(first_line(text), context_of)


def context_of(line: Column) -> Column:
    """Kind of the document with this first line; empty if it doesn't tell."""

    def kind(low: Column) -> Column:
        kind = F.lit("")
        for name, words in reversed(CONTEXTS):
            has = low.contains(words[0])
            for w in words[1:]:
                has = has | low.contains(w)
            kind = F.when(has, F.lit(name)).otherwise(kind)
        return kind

    return F.when(F.length(line) < 10, F.lit("")).otherwise(once(F.lower(line), kind))


def context_explanation(subcategory: Column, text: Column) -> Column:
    """What was found and in what kind of document."""
    name = F.when(subcategory.contains("."), F.replace(F.substring_index(subcategory, ".", -1), F.lit("_"), F.lit(" "))).otherwise(subcategory)
    place = once(document_context(text), lambda context: F.when(context == "", F.lit("")).otherwise(F.concat(F.lit(" in "), context)))
    return F.concat(F.lit("Found "), name, F.lit(" content"), place)


def redacted(text: Column, label: str, pattern: str) -> Column:
    """First match with most of it hidden, by kind of value; null without one."""
    return hidden(first_match(text, pattern), label)


def first_match(text: Column, pattern: str) -> Column:
    return F.trim(F.regexp_extract(text, f"(?i){pattern}", 0))


def hidden(value: Column, label: str) -> Column:
    """A value with most of it hidden, by its kind; null for an empty one."""
    if label == "ssn":
        short, hidden = F.length(value) >= 7, F.concat(F.substring(value, 1, 3), F.lit("-XX-"), F.substring(value, -4, 4))
    elif label in ("api_key", "token", "password"):
        short, hidden = F.length(value) > 12, F.concat(F.substring(value, 1, 12), F.lit("..."))
    elif label == "credit_card":
        short, hidden = F.length(value) >= 12, F.concat(F.substring(value, 1, 4), F.lit("-XXXX-XXXX-"), F.substring(value, -4, 4))
    else:
        short, hidden = F.lit(False), value
    return F.when(value != "", F.when(short, hidden).otherwise(F.substring(value, 1, 60)))


def human_size(n: Column) -> Column:
    """B, or KB, MB and GB with one decimal."""
    of = lambda unit, name: F.concat(F.format_string("%.1f", F.bround(n / float(unit), 1)), F.lit(f" {name}"))
    return F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, of(1 << 10, "KB")).when(n < 1 << 30, of(1 << 20, "MB")).otherwise(of(1 << 30, "GB"))


def escape_html(x: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(plain), F.lit(escaped))
    return x


def extension(path: Column) -> Column:
    """Lower-case characters after the last dot of the last path part; empty without one."""
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), "^.+\\.([^.]+)$", 1))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def strip_ansi(x: Column) -> Column:
    return F.regexp_replace(x, "\u001b\\[[0-9;?]*[A-Za-z]", "")


def header_value(message: Column, name: str) -> Column:
    """Value of the first header line of that name before the first blank line; null without one."""
    head = F.split(message, "\n\n", 2)[0]
    return F.when(head.rlike(f"(?m)^{name}: "), F.regexp_extract(head, f"(?m)^{name}: (.*)$", 1))


def keyword_hits(text: Column, words: list[str]) -> Column:
    """Those of the (lower-case) words that the text holds, in their order, upper case or not."""
    return once(F.lower(text), lambda low: F.filter(F.array(*map(F.lit, words)), lambda w: low.contains(w)))


def count_hits(text: Column, words: list[str]) -> Column:
    return once(F.lower(text), lambda low: count_in(low, words))


def count_in(low: Column, words: list[str]) -> Column:
    """How many of the words a text in lower case holds."""
    total = F.lit(0)
    for w in words:
        total = total + low.contains(w).cast("int")
    return F.coalesce(total, F.lit(0))


def tidy_key(key: Column) -> Column:
    return F.replace(key, F.lit("_"), F.lit(" "))


def filled(template: str, **values: Column) -> Column:
    """A template with {name} places taken by columns."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def nonblank_map(m: Column) -> Column:
    return F.map_filter(m, lambda k, v: F.trim(v) != "")
