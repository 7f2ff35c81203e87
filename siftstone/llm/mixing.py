"""Mixing sources to target weights by proportionate-fair (Pfair) scheduling, in DataFrame functions only.

Each source's documents, in a seeded order, are cut into blocks. Block j (from 0) of a source of weight w (of all weights)
may not be placed before slot floor(j / w) and is due by slot ceil((j + 1) / w). In every slot the released block with the
earliest deadline is placed (ties: the source first by name). Earliest deadline first always meets such windows, so up to
the slot where the first source runs out, a source has had less than one block more or less than its share at every
slot, however long the stream. The rest of the sources keep their slots then: nothing is dropped.

When all sources but one have ended, that one's blocks stand in the last slots that they may have.

The schedule is one, but periods of it are made apart. Which blocks are placed before a period starts, at slot T, is known
without the slots before: all that are due by T, and of those that are released and due later (one a source) as many as
there are slots, by deadline, as far as for every slot s no more blocks released from s on are taken than there are slots
from s to T. That is what earliest deadline first arrives at, as it takes the best set that can be placed.

Weights are held as multiples of 2^-30 of their sum, so a share drifts by less than half a block in 2^30 slots. Sources
of less than 1 / SOURCES of all weight are scheduled as one, the pool, whose blocks go in order of (j + u) / w, u from the
name's hash; the bound then holds for the pool. So no row holds more than SOURCES + 1 sources, however many there are.
Ranks within a source come from small buckets and the counts of earlier buckets: no source meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.llm.common import counted_join, free_name, written

NO_SOURCE = "(none)"
#: Sources that are scheduled each on its own have at least this part of all weight.
SOURCES = 1024
#: Weights are multiples of 1 / ONE.
ONE = 1 << 30
#: Slots after those of the schedule, for sources without a weight.
AFTER = 1 << 40
#: Of `tasks` (q of ONE) and `t0`: how many blocks each task has had before slot t0, by earliest deadline first.
HAD_BEFORE = f"""transform(tasks, (x, i) -> x.q * t0 DIV {ONE} + IF(array_contains(aggregate(
    array_sort(filter(transform(tasks, (y, k) -> named_struct('due', ((y.q * t0 DIV {ONE} + 1) * {ONE} + y.q - 1) DIV y.q, 'i', k, 'free', (y.q * t0 DIV {ONE}) * {ONE} DIV y.q, 'part', y.q * t0 % {ONE})), y -> y.part > 0)),
    named_struct('room', room, 'took', CAST(array() AS ARRAY<INT>)),
    (state, y) -> IF(exists(state.room, r -> r.s <= y.free AND r.n < 1), state, named_struct('room', transform(state.room, r -> named_struct('s', r.s, 'n', r.n - IF(r.s <= y.free, 1L, 0L))), 'took', array_append(state.took, y.i))),
    state -> state.took), i), 1L, 0L))"""
#: For every slot s at which a block that is due after t0 is released: how many such blocks there is room for from s to t0.
ROOM = f"""transform(array_distinct(concat(array(0L), transform(tasks, y -> (y.q * t0 DIV {ONE}) * {ONE} DIV y.q))), s -> named_struct('s', s, 'n',
    t0 - s - aggregate(tasks, 0L, (n, y) -> n + greatest(0L, y.q * t0 DIV {ONE} - (y.q * s + {ONE - 1}) DIV {ONE}))))"""
DUE = f"(({{block}} + 1) * {ONE} + {{q}} - 1) DIV {{q}}"
#: The slots from t0 to t1, one after another: (i, block, slot).
PLACED = f"""aggregate(sequence(t0, t1 - 1L), named_struct('had', had, 'placed', CAST(array() AS ARRAY<STRUCT<i: INT, block: BIGINT, slot: BIGINT>>)),
    (state, t) -> aggregate(
      array(array_min(transform(tasks, (x, i) -> IF(state.had[i] * {ONE} DIV x.q <= t, named_struct('due', ((state.had[i] + 1L) * {ONE} + x.q - 1L) DIV x.q, 'i', i), NULL)))),
      state,
      (s, best) -> named_struct('had', transform(s.had, (c, i) -> IF(i = best.i, c + 1L, c)), 'placed', array_append(s.placed, named_struct('i', best.i, 'block', s.had[best.i], 'slot', t)))),
    state -> state.placed)"""


def order_hash(column: Column) -> Column:
    """A seeded order of ids that any SQL engine can compute: a full-period congruential step modulo 2^31."""
    return F.pmod(F.pmod(F.coalesce(column, F.lit(-1)).cast("bigint"), F.lit(2147483648)) * F.lit(1103515245) + F.lit(12345), F.lit(2147483648))


def weighted(counts: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """One row a source: its documents `n` and its `weight`, null without a positive one."""
    n = counts.groupBy("source").agg(F.sum("n").alias("n"))
    if weights is None:
        return n.withColumn("weight", F.sqrt("n"))
    given = [kv for name, w in weights.items() if w > 0 for kv in (F.lit(name), F.lit(float(w)))]
    return n.withColumn("weight", F.try_element_at(F.create_map(*given), F.col("source")) if given else F.lit(None).cast("double"))


def running(rows: DataFrame, high: Column, order: list[str], value: str, name: str) -> DataFrame:
    """`rows` with the sum of `value` over all rows before, in order of `high` (few values, or ranges of bounded size) and `order` within."""
    rows = rows.withColumn("high", high)
    sums = rows.groupBy("high").agg(F.sum(value).alias("of_high"))
    # One row a value of high: 4096 for names, one for 65,536 blocks for the pool.
    before = sums.select("high", (F.sum("of_high").over(Window.orderBy("high")) - F.col("of_high")).alias("earlier"))
    within = F.sum(value).over(Window.partitionBy("high").orderBy(*order)) - F.col(value)
    return rows.withColumn("within", within).join(F.broadcast(before), "high").withColumn(name, F.col("earlier") + F.col("within")).drop("high", "within", "earlier")


def sources_of(counts: DataFrame, weights: dict[str, float] | None, block_docs: int) -> DataFrame:
    """A row a source: rows, blocks, share of all weight (null without one), alone (whether it is a task of its own), and for those without a weight the place of their first block."""
    n = weighted(counts, weights).select("source", F.col("n").alias("rows"), F.expr(f"(n + {block_docs - 1}) DIV {block_docs}").alias("blocks"), "weight")
    n = n.crossJoin(F.broadcast(n.agg(F.sum("weight").alias("total")))).withColumn("share", F.col("weight") / F.col("total")).drop("weight", "total")
    n = n.withColumn("alone", F.coalesce(F.col("share") * SOURCES >= 1, F.lit(False))).withColumn("late", F.when(F.col("share").isNull(), F.col("blocks")).otherwise(0))
    return running(n, F.substring(F.sha2("source", 256), 1, 3), ["source"], "late", "place").drop("late")


def tasks_of(sources: DataFrame) -> DataFrame:
    """One row: tasks (source, blocks, q; a null source is the pool), last (the task that lasts longest) and until (the slot by which all others have ended)."""
    one = sources.groupBy().agg(
        F.array_sort(F.collect_list(F.when(F.col("alone"), F.struct("source", "share", "blocks")))).alias("t"),  # SOURCES at most
        F.sum(F.when(~F.col("alone"), F.col("share"))).alias("rest"),
        F.sum(F.when(~F.col("alone") & F.col("share").isNotNull(), F.col("blocks"))).alias("rest_blocks"),
    )
    one = one.selectExpr("concat(t, IF(rest IS NULL, array(), array(named_struct('source', CAST(NULL AS STRING), 'share', greatest(rest, 1e-6D), 'blocks', rest_blocks)))) AS t").where("size(t) > 0")
    one = one.selectExpr("t", "aggregate(t, CAST(array(0D) AS ARRAY<DOUBLE>), (s, x) -> array_append(s, element_at(s, -1) + x.share)) AS c")
    whole = f"CAST(round({ONE} * (c[{{}}] / element_at(c, -1))) AS BIGINT)"
    one = one.selectExpr(f"transform(t, (x, i) -> named_struct('source', x.source, 'blocks', x.blocks, 'q', {whole.format('i + 1')} - {whole.format('i')})) AS tasks")
    one = one.selectExpr("tasks", f"reverse(array_sort(transform(tasks, (x, i) -> named_struct('end', (x.blocks * {ONE} + x.q - 1) DIV x.q, 'i', i)))) AS e")
    return one.selectExpr("tasks", "tasks[e[0].i] AS last", "IF(size(e) > 1, e[1].end, 0L) AS until")


def schedule(one: DataFrame, period: int) -> DataFrame:
    """(p_source, p_block, p_slot) of all blocks of the tasks (a null source is the pool) but those of the last that are due after all others have ended."""
    at = one.selectExpr(f"explode(sequence(0L, (until + {period - 1}) DIV {period})) AS p").repartition("p").crossJoin(F.broadcast(one))
    at = at.selectExpr("tasks", "last", "until", f"p * {period} AS t0", f"least((p + 1) * {period}, until) AS t1").where("t0 < t1")
    at = at.selectExpr("*", f"{ROOM} AS room").selectExpr("*", f"{HAD_BEFORE} AS had").selectExpr("tasks", "last", "until", f"inline({PLACED})")
    at = at.selectExpr("tasks[i] AS x", "last", "until", "block", "slot").where("block < x.blocks")
    return at.where(f"NOT (x.source <=> last.source AND {DUE.format(block='block', q='x.q')} > until)").selectExpr("x.source AS p_source", "block AS p_block", "slot AS p_slot")


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, period: int = 1024, block_docs: int = 16, buckets: int = 1024) -> DataFrame:
    """The place of every document in a stream mixed to target weights.

    weights: target by source (need not sum to 1); None: the square root of each source's number of documents.
    Sources that it doesn't name, or names with 0, follow after all others, one after another. period: slots that one
    task schedules. buckets: bound for the rows of a source that meet in a task is its rows / buckets. Neither changes
    the result.

    Returns doc_id, source (null: "(none)"), block, block_offset, release, deadline, slot, mix_order: the stream is
    the rows in order of mix_order, which is unique. release and deadline are the source's own, or the pool's; null after
    the schedule. Null ids rank as -1; rows that repeat an id are rows of their own, in any order among themselves. Texts,
    long or null, aren't read, nor are other columns. An empty table gives an empty result.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)).alias("source"), order_hash(F.col("doc_id")).alias("h")).withColumn("bucket", F.col("h") * F.lit(buckets).cast("bigint") / F.lit(2147483648))
    rows = rows.withColumn("bucket", F.floor("bucket"))
    counts = rows.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), (F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("before"))
    near = F.row_number().over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id")) - 1
    ranked = rows.withColumn("near", near).join(before, (F.col("source") == F.col("b_source")) & (F.col("bucket") == F.col("b_bucket"))).withColumn("rank", F.col("before") + F.col("near"))
    ranked = ranked.select("doc_id", "source", "rank", F.expr(f"rank DIV {block_docs}").alias("block"))
    sources = written(sources_of(counts, weights, block_docs), "sources")
    total = sources.agg(F.sum("rows").alias("n"), F.count_if(~F.col("alone") & F.col("share").isNotNull()).alias("pooled"), F.sum(F.when(~F.col("alone"), F.col("share"))).alias("rest")).first()
    tasks = written(tasks_of(sources), "tasks")
    plan = schedule(tasks, period)
    known = counted_join(ranked, sources.select("source", "rows", "alone", F.when(F.col("share").isNull(), F.col("place")).alias("place")), ["source"], total["n"] or 0)
    own = tasks.select(F.explode("tasks").alias("t")).select(F.col("t.source").alias("t_source"), F.col("t.q").alias("q"))  # SOURCES + 1 rows
    known = known.withColumn("task_block", F.col("block")).withColumn("in_pool", ~F.col("alone") & F.col("place").isNull())
    if total["pooled"]:
        known = with_pool_blocks(known, sources, block_docs, total["n"], total["rest"])
    # The task's name, null for the pool; rows of sources without a weight have no task.
    name = F.when(F.col("alone"), F.col("source"))
    known = known.join(F.broadcast(own.withColumn("t_any", F.lit(True))), name.eqNullSafe(F.col("t_source")) & ((F.col("alone") | F.col("in_pool")) == F.col("t_any")), "left")
    out = known.join(plan, name.eqNullSafe(F.col("p_source")) & F.col("place").isNull() & (F.col("task_block") == F.col("p_block")), "left")
    due = F.expr(DUE.format(block="task_block", q="q"))
    out = out.select("doc_id", "source", "block", F.expr(f"rank % {block_docs}").alias("block_offset"), F.expr(f"task_block * {ONE} DIV q").alias("release"), due.alias("deadline"), F.coalesce("p_slot", due - 1, F.lit(AFTER) + F.col("place") + F.col("block")).alias("slot"))
    return out.withColumn("mix_order", F.col("slot") * block_docs + F.col("block_offset"))


def with_pool_blocks(known: DataFrame, sources: DataFrame, block_docs: int, total: int, rest: float) -> DataFrame:
    """`known` with task_block of the pool's blocks: their place in the pool, in order of their own times."""
    some = sources.where(~F.col("alone") & F.col("share").isNotNull()).select("source", "rows", "share")
    blocks = counted_join(known.where(f"rank % {block_docs} = 0 AND in_pool").select("source", "block"), some, ["source"], total).select("source", "block", ((F.col("block") + F.crc32("source") / float(1 << 32)) / F.col("share")).alias("time"))
    bins = blocks.withColumn("bin", F.floor(F.col("time") * rest / 256))
    counts = running(bins.groupBy("bin").agg(F.count(F.lit(1)).alias("n")), F.floor(F.col("bin") / 256), ["bin"], "n", "before").select("bin", "before")
    at = bins.withColumn("near", F.row_number().over(Window.partitionBy("bin").orderBy("time", "source", "block")) - 1).join(counts, "bin")
    at = at.select(F.col("source").alias("a_source"), F.col("block").alias("a_block"), (F.col("before") + F.col("near")).alias("at"))
    return known.join(at, (F.col("source") == F.col("a_source")) & (F.col("block") == F.col("a_block")), "left").withColumn("task_block", F.coalesce("at", "task_block")).drop("a_source", "a_block", "at")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, all columns, whatever their names, in mixed order (a range-partitioned sort). Rows that repeat a doc_id stand together, where the first of them stands."""
    key, order = free_name(docs.columns, "mix_id"), free_name(docs.columns, "mix_order")
    place = mix_sources(docs, **options).groupBy(F.col("doc_id").alias(key)).agg(F.min("mix_order").alias(order))
    return docs.join(place, docs["doc_id"].eqNullSafe(place[key])).orderBy(order, key).select(*[docs[c] for c in docs.columns])


#: One schedule from its first slot to its last. No source has less than 1 / 1024 of all weight in the tables that SQL reads.
ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '(none)') AS source, ((((coalesce(doc_id, -1) % 2147483648) + 2147483648) % 2147483648) * 1103515245 + 12345) % 2147483648 AS h FROM documents),
w AS (SELECT source, (count(*) + 15) // 16 AS blocks, sqrt(count(*)) AS weight FROM d GROUP BY source),
x AS (SELECT source, blocks, weight / sum(weight) OVER () AS share, row_number() OVER (ORDER BY source) AS i FROM w),
c AS (SELECT source, blocks, i, sum(share) OVER (ORDER BY i) AS hi, coalesce(sum(share) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, sum(share) OVER () AS whole FROM x),
s AS (SELECT source, blocks, i, CAST(round(1073741824 * (hi / whole)) AS BIGINT) - CAST(round(1073741824 * (lo / whole)) AS BIGINT) AS q FROM c),
f AS (SELECT i, row_number() OVER (ORDER BY (blocks * 1073741824 + q - 1) // q DESC, i DESC) AS k, (blocks * 1073741824 + q - 1) // q AS due FROM s),
a AS (SELECT list(q ORDER BY i) AS qs, coalesce((SELECT due FROM f WHERE k = 2), 0) AS slots, (SELECT i FROM f WHERE k = 1) AS longest FROM s),
e AS (
  SELECT CAST(0 AS BIGINT) AS t, list_transform(qs, lambda x: CAST(0 AS BIGINT)) AS had, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS block FROM a
  UNION ALL
  SELECT t + 1, list_transform(had, lambda c, j: CASE WHEN j = best % 100000 THEN c + 1 ELSE c END), best % 100000, had[best % 100000]
  FROM (SELECT t, had, list_min(list_transform(qs, lambda x, j: CASE WHEN had[j] * 1073741824 // x <= t THEN ((had[j] + 1) * 1073741824 + x - 1) // x * 100000 + j END)) AS best FROM e, a WHERE t < slots)
),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) - 1 AS k FROM d),
b AS (SELECT doc_id, r.source, s.i, k // 16 AS block, k % 16 AS block_offset, k // 16 * 1073741824 // q AS release, ((k // 16 + 1) * 1073741824 + q - 1) // q AS deadline FROM r JOIN s ON r.source = s.source),
o AS (SELECT doc_id, source, b.block, block_offset, release, deadline, CASE WHEN b.i = longest AND deadline > slots THEN deadline - 1 ELSE e.t - 1 END AS slot
      FROM b CROSS JOIN a LEFT JOIN e ON e.i = b.i AND e.block = b.block AND e.t > 0)
SELECT doc_id, source, block, block_offset, release, deadline, slot, slot * 16 + block_offset AS mix_order FROM o
"""
