"""Corpus building: identity of texts, held-out selection, unions, training pairs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions.text import cut_at_word

FINGERPRINT_CHARS = 500


def fingerprint(text: Column, chars: int | None = FINGERPRINT_CHARS) -> Column:
    """First 16 hex digits of the SHA-256 of a text's start (None: of all of it)."""
    return F.substring(F.sha2(F.substring(text, 1, chars) if chars else text, 256), 1, 16)


def prefix_dedup(rows: DataFrame, chars: int, order: str, text: str = "text", first: Column | None = None) -> DataFrame:
    """The first row, by (`first`, `order`), of those that start with the same characters. Null texts count as one.

    Of rows that are first with the same `order`, the one with the least text, and of equal ones any. The winner is a minimum
    that carries its row, combined before the shuffle, so a very common start costs nothing.
    """
    p = "__"
    while any(c.startswith(p) for c in rows.columns):
        p += "_"
    key = F.sha2(F.coalesce(F.substring(text, 1, chars), F.lit("\0")), 256)
    lead = F.lit(0) if first is None else first
    place = F.struct(lead.alias("a"), F.col(order).isNotNull().alias("n"), F.col(order).alias("b"), F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256).alias("c"))
    winner = rows.groupBy(key.alias(f"{p}k")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), place).alias(f"{p}w"))
    return winner.select(f"{p}w.*")


def hold_out(candidates: DataFrame, train: DataFrame, text: str = "text", chars: int | None = FINGERPRINT_CHARS) -> DataFrame:
    """Candidates whose fingerprint no row of `train` has."""
    known = train.select(fingerprint(F.col(text), chars).alias("__f")).distinct()
    return candidates.withColumn("__fp", fingerprint(F.col(text), chars)).join(known, F.col("__fp") == F.col("__f"), "left_anti").drop("__fp")


def combine(sources: Sequence[DataFrame]) -> DataFrame:
    """All rows of all sources by column name; a missing column is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def run_sources(sources: dict[str, Callable[[], DataFrame]], only: Sequence[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """The union of all named sources (or `only` some), each with its name in `source`; and errors by source: one that fails doesn't stop the others."""
    made, errors = [], {}
    for name in only or sources:
        try:
            rows = sources[name]().withColumn("source", F.lit(name))
            rows.limit(1).collect()  # an error of a lazy reader shows here, not in the union
            made.append(rows)
        except Exception as e:  # a broken source is reported, not fatal
            errors[name] = str(e)
    if not made:
        raise ValueError(f"no source could be read: {errors}")
    return combine(made), errors


def code_labels(rows: DataFrame, codes: str, labels: dict[str, str], default: str, name: str = "label") -> DataFrame:
    """`rows` with the label of the first code (array column) that has one, else the default."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    found = F.array_compact(F.transform(codes, lambda c: F.try_element_at(table, c)))
    return rows.withColumn(name, F.coalesce(F.get(found, F.lit(0)), F.lit(default)))


def not_done(todo: DataFrame, done: DataFrame, key: str, failed: Column | None = None) -> DataFrame:
    """Rows still to do: those whose key isn't in `done`; with `failed`, done rows that failed count as to do."""
    ok = done if failed is None else done.where(~F.coalesce(failed, F.lit(False)))
    return todo.join(ok.select(key).distinct(), key, "left_anti")


INSTRUCTIONS = [
    "List everything sensitive or hostile in this document.",
    "Review this text for personal data, secrets and attacks.",
    "Classify the security risks of the document below.",
    "Report findings for this document as a JSON array.",
]
SYSTEM = "You review documents and answer with a JSON array of findings."


def chosen_instruction(id_column: Column, seed: int = 42) -> Column:
    """One of the instructions by the hash of the seed and the id."""
    digits = F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), id_column.cast("string")), 256), 1, 8)
    at = F.conv(digits, 16, 10).cast("bigint") % len(INSTRUCTIONS)
    return F.element_at(F.array(*map(F.lit, INSTRUCTIONS)), at.cast("int") + 1)


def answer_json(findings: Column) -> Column:
    return F.to_json(F.transform(findings, lambda f: F.struct(f["category"].alias("category"), f["subcategory"].alias("subcategory"), f["severity"].alias("severity"), f["description"].alias("explanation"))))


def alpaca(rows: DataFrame, most: int = 4000, seed: int = 42) -> DataFrame:
    """(id, instruction, input, output) of rows (id, text, findings) that have findings."""
    return rows.where(F.size("findings") > 0).select("id", chosen_instruction(F.col("id"), seed).alias("instruction"), cut_at_word(F.col("text"), most).alias("input"), answer_json(F.col("findings")).alias("output"))


def chat(rows: DataFrame, most: int = 4000, seed: int = 42) -> DataFrame:
    """(id, messages) with a system, a user and an assistant message."""
    pairs = alpaca(rows, most, seed)
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return pairs.select("id", F.array(message("system", F.lit(SYSTEM)), message("user", F.concat("instruction", F.lit("\n\n"), "input")), message("assistant", F.col("output"))).alias("messages"))


def completion(rows: DataFrame, most: int = 4000, seed: int = 42) -> DataFrame:
    """(id, prompt, completion) with the parts under headings."""
    pairs = alpaca(rows, most, seed)
    return pairs.select("id", F.concat(F.lit(f"### System:\n{SYSTEM}\n\n### User:\n"), "instruction", F.lit("\n\n"), "input", F.lit("\n\n### Assistant:\n")).alias("prompt"), F.col("output").alias("completion"))


def corpus_stats(rows: DataFrame, top: int = 30, cap: int = 5000) -> DataFrame:
    """Rows by primary subcategory, the commonest first: n, share of rows with several findings, whether over the cap."""
    primary = F.coalesce(F.get("findings", F.lit(0))["subcategory"], F.lit("unknown"))
    stats = rows.groupBy(primary.alias("subcategory")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.size("findings") > 1).cast("int")).alias("several"))
    return stats.withColumn("over_cap", F.col("n") > cap).orderBy(F.desc("n"), "subcategory").limit(top)


def source_counts(rows: DataFrame) -> DataFrame:
    """Findings by source and subcategory."""
    return rows.select("source", F.explode("findings").alias("f")).groupBy("source", F.col("f.subcategory").alias("subcategory")).agg(F.count(F.lit(1)).alias("n"))


def richness(findings: Column) -> Column:
    """Points for how much a record shows, to take the richest first."""
    # Points by subcategory, and by extracted field.
    points = {"pii.identity": 10, "pii.contact": 5, "credentials.password": 50, "confidential.internal": 20, "financial.transaction": 15}
    extra = {"ssn": 100, "phone": 3, "address": 5}
    table = F.create_map(*[x for k, v in points.items() for x in (F.lit(k), F.lit(v))])
    fields = lambda f: sum((F.when(F.array_contains(F.map_keys(f["extracted_data"]), k), F.lit(v)).otherwise(0) for k, v in extra.items()), F.lit(0))
    return F.aggregate(findings, F.lit(0), lambda s, f: s + F.coalesce(F.try_element_at(table, f["subcategory"]), F.lit(0)) + fields(f))


def review_sheet(rows: DataFrame, id_column: str, text: str = "text", seed: int = 42) -> DataFrame:
    """(review_id, key, preview) for reading by hand: R001, ... in the seeded order, line ends shown as marks."""
    from siftstone.operators.ranking import rank_in_group, seeded

    ranked = rank_in_group(rows, [F.lit(0)], seeded(F.col(id_column), seed), F.col(id_column), "__rank")
    return ranked.select(F.format_string("R%03d", F.col("__rank")).alias("review_id"), F.col(id_column).alias("key"), F.substring(F.replace(text, F.lit("\n"), F.lit(" \\n ")), 1, 1500).alias("preview"))
