"""Labelled texts made from a grammar that is a table, with the places of what was put in.

A grammar has one row a production: symbol, choice, weight, body. A body is text with {name} places; a name is a symbol of
the grammar or a value (VALUE_NAMES), and `{name:label}` says that what is put there is a finding of that label. Each place is
expanded by a hash of the seed, the row's id and the place's own path from the root, so a row's text doesn't depend on other
rows, on partitions or on the order of work, and SQL can make the same. Expansion goes level by level: a row is a list of
pieces, and each level opens all its symbols at once, with column functions only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftstone.schema import FINDINGS, finding

GRAMMAR = "symbol string, choice int, weight int, body string"
#: Levels of nesting at most; a grammar that goes deeper is an error, not a text that is cut off.
LEVELS = 8
#: A place: its name and, after a colon, the label of what stands there.
PLACE = r"\{([a-z_][a-z0-9_]*)(?::([a-z_]+\.[a-z_]+))?\}"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"


def draw(seed: Column, what: Column, n: Column | int) -> Column:
    """A whole number from 0 to n - 1 by the SHA-256 of seed and text: any SQL engine can compute it."""
    digits = F.substring(F.sha2(F.concat_ws("|", seed, what), 256), 1, 12)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.lit(n) if isinstance(n, int) else n)


def _letters(key: Column, n: int, first: int = 0, alphabet: str = BASE64) -> Column:
    """n characters of an alphabet from a hex digest, from its `first` byte on: a byte a character."""
    at = lambda k: F.pmod(F.conv(F.substring(key, 2 * (k + first) + 1, F.lit(2)), 16, 10).cast("int"), F.lit(len(alphabet))) + 1
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.substring(F.lit(alphabet), at(k), F.lit(1))), "")


def _digits(key: Column, n: int, first: int = 0) -> Column:
    return _letters(key, n, first, "0123456789")


def base64_token(key: Column, n: int) -> Column:
    """n characters of the URL-safe base64 alphabet; n is 32 at most, a byte of the digest each."""
    return _letters(key, n)


def three_part_token(key: Column) -> Column:
    """A signed web token's form: a header and a payload that are base64 of JSON, and a signature; signed by nobody."""
    plain = lambda c: F.regexp_replace(F.translate(F.base64(c.cast("binary")), "+/", "-_"), "[=\\r\\n]", "")
    payload = F.concat(F.lit('{"sub":"'), _digits(key, 8), F.lit('","role":"user"}'))
    return F.concat(plain(F.lit('{"alg":"HS256","typ":"JWT"}')), F.lit("."), plain(payload), F.lit("."), _letters(key, 22, 8))


def values(key: Column) -> dict[str, Column]:
    """Made-up values by name, from a hex digest; none is a real account, key or person."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    return {
        "ssn": F.concat(F.lit("9"), _digits(key, 2), F.lit("-"), _digits(key, 2, 2), F.lit("-"), _digits(key, 4, 4)),
        "card": F.concat(F.lit("4000-"), _digits(key, 4), F.lit("-"), _digits(key, 4, 4), F.lit("-"), _digits(key, 4, 8)),
        "account": _digits(key, 10),
        "key_id": F.concat(F.lit("AKIAEXAMPLE"), _letters(key, 9, 0, upper)),
        "token": base64_token(key, 32),
        "web_token": three_part_token(key),
        "password": F.concat(F.lit("Fake-"), _letters(key, 10)),
        "number": _digits(key, 4),
        "date": F.concat(F.lit("20"), _digits(key, 2), F.lit("-0"), (F.conv(F.substring(key, 1, 2), 16, 10).cast("int") % 9 + 1).cast("string"), F.lit("-1"), _digits(key, 1, 3)),
        "email": F.concat(F.lit("user"), _digits(key, 5), F.lit("@example.org")),
    }


VALUE_NAMES = ["ssn", "card", "account", "key_id", "token", "web_token", "password", "number", "date", "email"]


def grammar_table(spark: SparkSession, rules: dict[str, list[tuple[int, str]]]) -> DataFrame:
    """The grammar as a table, from {symbol: [(weight, body), ...]}."""
    return spark.createDataFrame([(s, k, w, body) for s, choices in rules.items() for k, (w, body) in enumerate(choices)], GRAMMAR)


def _ready(grammar: DataFrame) -> DataFrame:
    """Productions by symbol: choices in order with the weights before them, and bodies as lists of pieces."""
    running = F.sum("weight").over(Window.partitionBy("symbol").orderBy("choice")) - F.col("weight")
    # A body's pieces, in order: text, then a place, then text, ...; a place of no name is text alone.
    texts = F.split("body", PLACE)
    names = F.regexp_extract_all("body", F.lit(PLACE), F.lit(1))
    labels = F.regexp_extract_all("body", F.lit(PLACE), F.lit(2))
    pieces = F.transform(texts, lambda t, k: F.struct(t.alias("text"), F.get(names, k).alias("name"), F.nullif(F.get(labels, k), F.lit("")).alias("label")))
    rows = grammar.select("symbol", "choice", "weight", running.alias("low"), pieces.alias("pieces"))
    return rows.groupBy("symbol").agg(F.sum("weight").alias("total"), F.array_sort(F.collect_list(F.struct("low", "weight", "pieces"))).alias("choices"))


def _levels(grammar: DataFrame, start: str) -> int:
    """How deep symbols nest below `start`; an error if that is over LEVELS, as with a symbol within itself, or if a name is unknown."""
    below: dict[str, set[str]] = {}
    for r in grammar.select("symbol", "body").collect():  # a grammar is written by hand
        below.setdefault(r["symbol"], set()).update(name for name, _ in re.findall(PLACE, r["body"]))
    level, names = 0, {start}
    while names & below.keys():
        level += 1
        if level > LEVELS:
            raise ValueError(f"a grammar nested deeper than {LEVELS} levels below {start}")
        if unknown := (names := set().union(*(below[n] for n in names if n in below))) - below.keys() - set(VALUE_NAMES):
            raise ValueError(f"neither a symbol nor a value: {', '.join(sorted(unknown))}")
    if not level:
        raise ValueError(f"neither a symbol nor a value: {start}")
    return level


def expanded(rows: DataFrame, grammar: DataFrame, start: str, seed: int = 42, key: str = "id") -> DataFrame:
    """(key, text, findings) of every row: `start` expanded for it.

    rows: one column `key` is read; null keys are a key of their own, repeated ones give the same text. findings: one for
    each labelled place, in order: its evidence is the text there, and extracted_data has begin and end, in characters. A name
    that is neither a symbol nor a value, and symbols that nest deeper than LEVELS, are an error. The grammar goes to all
    tasks as one row, and so is small.
    """
    salt = F.lit(str(seed))
    ident = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    place = "struct<text:string,name:string,label:string,path:string,closed:string>"
    none = F.lit(None).cast("string")
    first = F.array(F.struct(F.lit("").alias("text"), F.lit(start).alias("name"), none.alias("label"), F.lit("0").alias("path"), none.alias("closed")))
    # A row is a list of pieces, each a text and what comes after it: an open place, or nothing. A level opens all symbols.
    out = rows.select(F.col(key), ident.alias("__ident"), first.cast(f"array<{place}>").alias("__pieces"))
    table = _ready(grammar).agg(F.map_from_entries(F.collect_list(F.struct("symbol", F.struct("total", "choices")))).alias("__grammar"))
    out = out.crossJoin(F.broadcast(table))  # one row, the grammar
    for _ in range(_levels(grammar, start)):
        out = out.withColumn("__pieces", F.flatten(F.transform("__pieces", lambda p: _opened(p, salt))))
    return _assembled(out.select(F.col(key), F.flatten(F.transform("__pieces", lambda p: _valued(p, salt))).alias("__pieces")), key)


def _piece(text: Column, path: Column, name: Column | None = None, label: Column | None = None, closed: Column | None = None) -> Column:
    parts = {"text": text, "name": name, "label": label, "path": path, "closed": closed}
    return F.struct(*[(F.lit(None).cast("string") if c is None else c).alias(n) for n, c in parts.items()])


def _around(p: Column, inner: Column) -> Column:
    """A place's text before it, what stands there, and an end; both say so if the place is labelled."""
    mark = lambda sign: F.when(p["label"].isNotNull(), F.concat(F.lit(sign), p["label"]))
    return F.concat(F.array(_piece(p["text"], p["path"], closed=mark("<"))), inner, F.array(_piece(F.lit(""), p["path"], closed=mark(">"))))


def _opened(p: Column, salt: Column) -> Column:
    """The pieces that a piece becomes: those of its symbol's production, or itself if no symbol is open there."""
    rule = F.try_element_at(F.col("__grammar"), p["name"])
    at = draw(salt, F.concat_ws("|", F.col("__ident"), p["path"]), rule["total"])
    body = F.get(F.filter(rule["choices"], lambda c: (c["low"] <= at) & (at < c["low"] + c["weight"])), F.lit(0))["pieces"]
    inner = F.transform(body, lambda b, k: _piece(b["text"], F.concat(p["path"], F.lit("."), k.cast("string")), b["name"], b["label"]))
    return F.when(rule.isNull(), F.array(p)).otherwise(_around(p, inner))


def _valued(p: Column, salt: Column) -> Column:
    """The same for a piece whose open place is a value."""
    key = F.sha2(F.concat_ws("|", salt, F.col("__ident"), p["path"], F.lit("value")), 256)
    value = F.coalesce(*[F.when(p["name"] == name, column) for name, column in values(key).items()])
    return F.when(p["name"].isNull(), F.array(p)).otherwise(_around(p, F.array(_piece(value, p["path"]))))


def _assembled(rows: DataFrame, key: str) -> DataFrame:
    """Text and findings of rows of closed pieces. `closed` marks where a labelled place begins, after a piece's text, and ends, before the next."""
    text = F.array_join(F.transform("__pieces", lambda p: p["text"]), "")
    rows = rows.withColumn("text", text)
    at = F.aggregate(
        "__pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<label:string,begin:int,end:int>>").alias("open"), F.array().cast("array<struct<label:string,begin:int,end:int>>").alias("done")),
        lambda s, p: _step(s, p),
        lambda s: F.array_sort(s["done"], lambda a, b: F.when(a["begin"] != b["begin"], a["begin"] - b["begin"]).otherwise(b["end"] - a["end"])),
    )
    made = F.transform("__spans", lambda x: finding(F.substring_index(x["label"], ".", 1), x["label"], F.concat(F.lit("Planted "), F.substring_index(x["label"], ".", -1)), F.lit("high"), F.lit("generator"), F.create_map(F.lit("begin"), x["begin"].cast("string"), F.lit("end"), x["end"].cast("string")), F.substring(F.col("text"), x["begin"] + 1, x["end"] - x["begin"])))
    return rows.withColumn("__spans", at).select(key, "text", made.cast(FINDINGS).alias("findings"))


def _step(s: Column, p: Column) -> Column:
    after = s["at"] + F.length(p["text"])
    opens, closes = p["closed"].startswith("<"), p["closed"].startswith(">")
    last = F.element_at(s["open"], -1)
    one = F.struct(F.substring(p["closed"], 2, 200).alias("label"), after.alias("begin"), after.alias("end"))
    over = F.struct(last["label"].alias("label"), last["begin"].alias("begin"), s["at"].alias("end"))
    opened = F.when(opens, F.array_append(s["open"], one)).when(closes, F.slice(s["open"], F.lit(1), F.size(s["open"]) - 1)).otherwise(s["open"])
    return F.struct(after.alias("at"), opened.alias("open"), F.when(closes, F.array_append(s["done"], over)).otherwise(s["done"]).alias("done"))


def quota_ids(spark: SparkSession, quotas: dict[str, int]) -> DataFrame:
    """(symbol, number, id): as many rows of each symbol as its quota says, made by tasks; ids are symbol and number."""
    table = spark.createDataFrame(list(quotas.items()), "symbol string, n long")
    rows = table.where("n > 0").select("symbol", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(n - 1) DIV 1000"))).alias("thousand"), "n").repartition("symbol", "thousand")
    rows = rows.select("symbol", F.explode(F.sequence(F.col("thousand") * 1000, F.least(F.col("thousand") * 1000 + 999, F.col("n") - 1))).alias("number"))
    return rows.withColumn("id", F.concat_ws("-", "symbol", F.col("number").cast("string")))


def labelled_corpus(spark: SparkSession, grammar: DataFrame, quotas: dict[str, int], seed: int = 42) -> DataFrame:
    """(id, symbol, text, findings): of each start symbol as many texts as its quota says."""
    ids = quota_ids(spark, quotas)
    parts = [expanded(ids.where(F.col("symbol") == s), grammar, s, seed).withColumn("symbol", F.lit(s)) for s in quotas]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("id", "symbol", "text", "findings")
