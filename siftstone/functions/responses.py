"""Findings from a model's written answer: JSON arrays within prose, whole or cut off."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftstone.functions.text import once
from siftstone.schema import CATEGORIES, FINDINGS, finding

ITEM = "array<struct<category: string, subcategory: string, severity: string, explanation: string>>"
#: Fixed value: characters kept of an explanation that breaks off.
SHOWN_OF_EXPLANATION = 300
DETAILED = "array<struct<category: string, description: string, severity: string, extracted_data: map<string, string>>>"


def resolved_category(category: Column, subcategory: Column, always: bool = False) -> Column:
    """The subcategory's prefix where that is another known category and category is `confidential` (always: whatever it is)."""
    prefix = F.substring_index(F.coalesce(subcategory, F.lit("")), ".", 1)
    known = F.coalesce(subcategory, F.lit("")).contains(".") & prefix.isin(CATEGORIES)
    return F.when(known if always else known & (category == "confidential"), prefix).otherwise(category)


def repaired_labels(findings: Column) -> Column:
    """Findings whose category is the prefix of their subcategory where that is a known category."""
    return F.transform(findings, lambda f: f.withField("category", resolved_category(f["category"], f["subcategory"], always=True)))


def known_severity(severity: Column, unknown: str = "medium") -> Column:
    s = F.coalesce(severity, F.lit("medium"))
    return F.when(s.isin("critical", "high", "medium", "low", "info"), s).otherwise(F.when(s == "warning", F.lit("medium")).otherwise(F.lit(unknown)))


def cut_off_array(answer: str | None) -> str | None:
    """What can be read of an array that breaks off, as an array: its whole objects, else what there is of the first; null if there is nothing. Braces in strings don't count."""
    if answer is None or (start := answer.find("[")) < 0:
        return None
    depth, quoted, escaped, value = 0, False, False, False
    whole = field = opened = -1  # ends of the last whole object and of the last text value; start of the last string
    name = ""
    for i in range(start + 1, len(answer)):
        c = answer[i]
        if quoted:
            escaped, quoted = c == "\\" and not escaped, not (c == '"' and not escaped)
            if not quoted and depth == 1:
                name, field = (name, i) if value else (answer[opened + 1 : i], field)
        elif c == '"':
            quoted, opened = True, i
        elif c in ":,":
            value = c == ":"
        elif c in "{[":
            depth, value = depth + 1, False
        elif c in "}]":
            depth -= 1
            whole = i if depth == 0 and c == "}" else whole
    # All whole objects; else the first one's whole fields; else it with the words of an explanation that breaks off.
    tries = [answer[start : whole + 1] + "]"] if whole >= 0 else []
    if whole < 0 and field >= 0:
        tries.append(answer[start : field + 1] + "}]")
    if whole < 0 and quoted and value and depth == 1 and name == "explanation":
        tries.insert(0, answer[start : opened + 1 + SHOWN_OF_EXPLANATION].rstrip("\\") + '..."}]')
    for text in tries:
        try:
            json.loads(text)
        except ValueError:
            continue
        return text
    return None


@F.pandas_udf(T.StringType())
def repair_array(answers: pd.Series) -> pd.Series:
    return answers.map(cut_off_array)


def blocks(answer: Column) -> Column:
    """Arrays in the answer, each from a bracket to the first closing one."""
    return F.regexp_extract_all(answer, F.lit("(?s)\\[.*?\\]"), F.lit(0))


def items(block: Column, strict: bool = True) -> Column:
    """Items of one array. strict: a block with an item that has no category, or is no object, counts for nothing; else only such items don't."""
    got = F.from_json(block, ITEM)
    named = lambda x: x.isNotNull() & x["category"].isNotNull()
    none = F.array().cast(ITEM)
    if strict:
        return once(got, lambda all_items: F.when(F.coalesce(F.forall(all_items, named), F.lit(False)), all_items).otherwise(none))
    return F.coalesce(F.filter(got, named), none)


def repaired_tail(answer: Column) -> Column:
    """The whole objects of an array that an answer breaks off in; a column of its own, as Python can't run inside array functions."""
    return repair_array(F.regexp_extract(F.coalesce(answer, F.lit("")), "(?s)\\[[^\\]]*$", 0))


def parse_findings(answer: Column, strict: bool = True, source: str = "model", tail: Column | None = None, tidy_category: bool = False) -> Column:
    """Findings of all arrays in an answer: the first of each category and subcategory, safe ones only if there are no others.

    An answer without any is one safe finding. tail: a column made by `repaired_tail`, for arrays that break off.
    tidy_category: categories in lower case without outer blanks.
    """
    text = F.coalesce(answer, F.lit(""))
    all_blocks = blocks(text)
    if tail is not None:
        all_blocks = F.concat(all_blocks, F.array_compact(F.array(tail)))
    raw = F.flatten(F.transform(all_blocks, lambda b: items(b, strict)))
    category = lambda x: F.lower(F.trim(x["category"])) if tidy_category else x["category"]
    rows = F.transform(raw, lambda x: F.struct(resolved_category(category(x), x["subcategory"]).alias("category"), F.coalesce(x["subcategory"], F.lit("")).alias("subcategory"), known_severity(x["severity"]).alias("severity"), described(x["explanation"], category(x), x["subcategory"]).alias("explanation")))
    first = first_of_each(rows, lambda x: F.concat_ws(":", x["category"], x["subcategory"]))
    risky = lambda found: F.filter(found, lambda x: x["category"] != "safe")
    chosen = once(first, lambda found: once(risky(found), lambda r: F.when(F.size(r) > 0, r).otherwise(found)))
    made = F.transform(chosen, lambda x: finding(x["category"], x["subcategory"], x["explanation"], x["severity"], F.lit(source))).cast(FINDINGS)
    return once(made, lambda m: F.when(F.size(m) > 0, m).otherwise(F.array(nothing_found(source)).cast(FINDINGS)))


def described(explanation: Column, category: Column, subcategory: Column) -> Column:
    """The explanation, or where there is none a sentence that names what was found."""
    name = F.when(F.coalesce(subcategory, F.lit("")) == "", category).otherwise(subcategory)
    return F.coalesce(explanation, F.concat(F.lit("Detected "), name, F.lit(" content")))


def nothing_found(source: str) -> Column:
    return finding(F.lit("safe"), F.lit("safe.documentation"), F.lit("Nothing of concern found."), F.lit("info"), F.lit(source))


def first_of_each(rows: Column, key) -> Column:
    """The items of an array whose key no item before them has."""
    return once(rows, lambda r: once(F.transform(r, key), lambda keys: F.filter(r, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)))


def parse_detailed(answer: Column, source: str = "model") -> Column:
    """Findings of the one array from the first bracket to the last; none if any part of it is amiss. Blank extracted values are dropped."""
    block = F.regexp_extract(F.coalesce(answer, F.lit("")), "(?s)\\[.*\\]", 0)
    got = F.from_json(block, DETAILED)
    good = F.coalesce(F.forall(got, lambda x: x["category"].isNotNull() & x["description"].isNotNull() & x["severity"].isNotNull()), F.lit(False))
    empty = F.create_map().cast("map<string,string>")
    made = F.transform(got, lambda x: finding(x["category"], F.lit(""), x["description"], known_severity(x["severity"], "info"), F.lit(source), F.map_filter(F.coalesce(x["extracted_data"], empty), lambda k, v: F.trim(v) != ""), evidence=F.lit("")))
    return F.when(good, made.cast(FINDINGS)).otherwise(F.array().cast(FINDINGS))


def parse_lenient(answer: Column) -> Column:
    """Items of the whole answer as JSON, else of its fenced block, else of its outermost brackets; one object counts as a list of one."""
    text = F.coalesce(F.trim(answer), F.lit(""))
    fenced = F.trim(F.regexp_extract(text, "(?s)```(?:json)?\\s*(.*?)```", 1))
    spans = [text, fenced, F.regexp_extract(text, "(?s)\\[.*\\]", 0)]
    listed = [F.when(s.startswith("{"), F.concat(F.lit("["), s, F.lit("]"))).otherwise(s) for s in spans]
    parsed = [F.from_json(s, ITEM) for s in listed]
    return F.coalesce(*[F.when(F.coalesce(F.exists(p, lambda x: x["category"].isNotNull()), F.lit(False)), p) for p in parsed], F.array().cast(ITEM))
