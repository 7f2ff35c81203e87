"""The prefix trie of conversations, rolled up by leaf-peeling message passing.

A node is a distinct sequence of first turns. Its key is the combined hash of its turns, each salted with its place, so
nodes come from one grouping of all prefixes, and no conversation is gathered: turns are ranked, and hashes combined, within
blocks of BLOCK turns and over the blocks before.

Peeling: nodes with the same smallest member form a downward path (the members of a child are among those of its parent),
and a path is one vertex of the message passing. A path holds a counter of child paths that haven't reported. Those at zero
send their subtree's totals to the parent path and are done; counters fall by the messages that came; until only the path
of the root finishes. So rounds are as many as branches are nested, not as conversations have turns. What reached a
path's nodes is then summed along the path, from its end up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.llm.common import counted_join, forget, row_count, written

#: Turns of a conversation, nodes of a path and members' ids that are ordered in one group; what is longer has several.
BLOCK = 4096
KEY = ["k1", "k2", "depth"]


def ranked_turns(conversations: DataFrame) -> DataFrame:
    """(c, p, r1, r2, n): each turn's place in its conversation from 1, two hashes of role and text, and its code points."""
    text, role = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("text", "role"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("c"), F.col("turn").alias("t"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("b", F.coalesce(F.floor(F.col("t") / BLOCK), F.lit(-(1 << 62))))
    counts = rows.groupBy("c", "b").agg(F.count(F.lit(1)).alias("m"))
    before = counts.select("c", "b", (F.sum("m").over(Window.partitionBy("c").orderBy("b")) - F.col("m")).alias("before"))
    near = F.row_number().over(Window.partitionBy("c", "b").orderBy(F.asc_nulls_first("t"), "role", "text"))
    rows = rows.select("c", "b", near.alias("near"), F.xxhash64("role", "text").alias("r1"), F.xxhash64(F.lit("turn"), "text", "role").alias("r2"), F.length("text").cast("bigint").alias("n"))
    return rows.join(before, ["c", "b"]).select("c", (F.col("before") + F.col("near")).cast("bigint").alias("p"), "r1", "r2", "n")


def conversations_of(turns: DataFrame, group: int, most: int) -> DataFrame:
    """A row a conversation: c, at (grows with c), size, donor, h (turns it takes over), k (those that there are), length (once rebuilt)."""
    sizes = turns.groupBy("c").agg(F.count(F.lit(1)).alias("size"))
    mine = sizes.select("c", "size", (F.col("c") - F.col("c") % group).alias("donor"), (F.crc32(F.col("c").cast("string")) % most).alias("h"))
    theirs = sizes.where(F.col("c") % group == 0).select(F.col("c").alias("donor"), F.col("size").alias("donor_size"))
    rows = mine.join(theirs, "donor", "left").withColumn("k", F.least("h", F.coalesce("donor_size", F.lit(0))))
    rows = rows.withColumn("length", F.col("k") + F.greatest(F.col("size") - F.col("h"), F.lit(0)))
    return rows.orderBy("c").select("c", F.monotonically_increasing_id().alias("at"), "size", "donor", "h", "k", "length")


def rebuilt(turns: DataFrame, convs: DataFrame, group: int, most: int) -> DataFrame:
    """(c, at, depth, r1, r2, n, ends): turns of the rebuilt conversations; ends: whether it is the last."""
    heads = turns.where((F.col("c") % group == 0) & (F.col("p") < most)).select(F.col("c").alias("donor"), "p", "r1", "r2", "n")
    taken = convs.where("k > 0").select("c", "at", "donor", "k", "length").join(heads, "donor").where("p <= k").select("c", "at", F.col("p").alias("depth"), "r1", "r2", "n", "length")
    own = counted_join(turns, convs.select("c", "at", "h", "k", "length", F.col("size").alias("rows")), ["c"], row_count(turns)).where("p > h")
    own = own.select("c", "at", (F.col("p") - F.col("h") + F.col("k")).alias("depth"), "r1", "r2", "n", "length")
    return taken.unionByName(own).select("c", "at", "depth", "r1", "r2", "n", (F.col("depth") == F.col("length")).alias("ends"))


def along(rows: DataFrame, by: str, values: dict[str, Column], total, up: bool = False) -> DataFrame:
    """`rows` (of `by` and depth) with `values` combined by the aggregate `total` over each row and those before it (up: after it) of the same `by`."""
    sign = -1 if up else 1
    rows = rows.withColumns(values).withColumn("block", F.expr(f"depth DIV {BLOCK}"))
    within = Window.partitionBy(by, "block").orderBy(sign * F.col("depth")).rowsBetween(Window.unboundedPreceding, 0)
    blocks = rows.groupBy(by, "block").agg(*[total(x).alias(f"{x}_b") for x in values])
    earlier = Window.partitionBy(by).orderBy(sign * F.col("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(by, "block", *[total(f"{x}_b").over(earlier).alias(f"{x}_e") for x in values]).where(f"{next(iter(values))}_e IS NOT NULL")
    rows = rows.select("*", *[total(x).over(within).alias(f"{x}_w") for x in values]).join(blocks, [by, "block"], "left")
    return rows.drop("block")


def prefixes(turns: DataFrame, convs: DataFrame, group: int, most: int) -> DataFrame:
    """(c, at, depth, k1, k2, p1, p2, n, ends): a row for each prefix of each rebuilt conversation, the textless one too, with its key and its parent's."""
    rows = rebuilt(turns, convs, group, most)
    salted = {"x1": F.xxhash64("depth", "r1", "r2"), "x2": F.xxhash64("r2", "depth", "r1")}
    rows = along(rows, "c", salted, F.bit_xor)
    key = {f"k{i}": F.col(f"x{i}_w").bitwiseXOR(F.coalesce(f"x{i}_e", F.lit(0))) for i in (1, 2)}
    rows = rows.withColumns(key).select("c", "at", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"), "n", "ends")
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    roots = convs.select("c", "at", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), zero.alias("n"), (F.col("length") == 0).alias("ends"))
    return rows.unionByName(roots)


def linked(nodes: DataFrame) -> DataFrame:
    """`nodes` with n_children and `parent`, the parent's smallest member."""
    above = [F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth")]
    counts = nodes.where("depth > 0").groupBy(*above).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(counts, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = written(nodes, "counted")
    # A parent may have very many children; those parents are broadcast, by count.
    side = nodes.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("depth").alias("over"), F.col("owner").alias("parent"), F.col("n_children").alias("rows"))
    below = nodes.withColumn("over", F.col("depth") - 1)
    return counted_join(below, side, ["p1", "p2", "over"], row_count(nodes), "left").drop("p1", "p2", "over")


def peeled(nodes: DataFrame) -> DataFrame:
    """(owner, depth, leaves, saved): what child paths send to the nodes that they hang from, in rounds."""
    paths = nodes.groupBy("owner").agg(
        F.min("depth").alias("top"),
        F.min_by("parent", "depth").alias("parent"),
        F.count_if(F.col("n_children") == 0).alias("leaves"),
        F.sum("saved").alias("saved"),
        (F.sum("n_children") - F.count(F.lit(1)) + 1).alias("waits"),
    )
    left, sent = written(paths, "paths"), []
    while True:
        done = written(left.where("waits = 0 AND parent IS NOT NULL").select("parent", (F.col("top") - 1).alias("depth"), "leaves", "saved"), "messages")
        sent.append(done)
        came = done.groupBy("parent").agg(F.count(F.lit(1)).alias("m"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        waiting = left.where("waits > 0").join(came.withColumnRenamed("parent", "owner"), "owner", "left")
        add = lambda name, more: (F.col(name) + F.coalesce(more, F.lit(0))).alias(name)
        rest = written(waiting.select("owner", "top", "parent", add("leaves", "more_leaves"), add("saved", "more_saved"), (F.col("waits") - F.coalesce("m", F.lit(0))).alias("waits")), "paths")
        forget(left)
        left = rest
        if not row_count(left):
            break
    return reduce(DataFrame.unionByName, sent).groupBy(F.col("parent").alias("owner"), "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def hashed_ends(rows: DataFrame) -> DataFrame:
    """(k1, k2, depth, ends_sha256) of the prefixes that end a conversation: SHA-256 of the conversations' ids, ascending, with commas.

    Ids are joined in stretches of BLOCK of all conversations first; a node's stretches are then hashed one after another as
    they stream by, so a node at which very many conversations end needs no memory for them.
    """
    stretch = F.shiftright("at", BLOCK.bit_length() - 1).alias("stretch")
    texts = rows.where("ends").groupBy(*KEY, stretch).agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("ids"))

    def work(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, hashlib.sha256()
        for batch in incoming:
            done = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
                if key == last:
                    state.update(b",")
                else:
                    if last is not None:
                        done.append((*last, state.hexdigest()))
                    last, state = key, hashlib.sha256()
                state.update(ids.encode())
            yield sent(done)
        yield sent([] if last is None else [(*last, state.hexdigest())])

    def sent(done: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], kind) for k, kind in enumerate(kinds)], names=[*KEY, "ends_sha256"])

    ordered = texts.repartition(*KEY).sortWithinPartitions(*KEY, "stretch").select(*KEY, "ids")
    return ordered.mapInArrow(work, "k1 bigint, k2 bigint, depth bigint, ends_sha256 string")


def prefix_trie(conversations: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """A row a node of the trie of rebuilt conversations.

    conversations: conv_id, turn, role, text; other columns aren't read. Conversation c becomes the first h original turns
    of conversation c - c % group (the remainder has c's sign), followed by its own turns after the first h; h = crc32(c as
    text) % most. Turns go by turn, null first, and among equal ones by role and text; repeated rows are turns of their own.
    Null roles and texts are empty. Rows without a conv_id belong to no conversation. No conversation, no node.

    Returns conv_id (the smallest member), depth, parent_conv_id (the parent's; null at the root), n_convs, n_children,
    n_leaves (childless nodes in its subtree), saved_tokens (over its subtree, (n_convs - 1) * code points of the last text),
    ends_sha256 (of the ids of members of just `depth` turns). Sequences are told apart by two 64-bit hashes.
    """
    turns = written(ranked_turns(conversations), "turns")
    convs = written(conversations_of(turns, group, most), "conversations")
    rows = written(prefixes(turns, convs, group, most), "prefixes")
    forget(turns)
    nodes = rows.groupBy(*KEY).agg(F.min("c").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.max("n").alias("n"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    nodes = written(linked(nodes).withColumn("saved", (F.col("n_convs") - 1) * F.col("n")), "nodes")
    came = peeled(nodes)
    own = {"leaves": F.coalesce("leaves", F.lit(0)) + (F.col("n_children") == 0).cast("bigint"), "saved": F.col("saved") + F.coalesce("more", F.lit(0))}
    full = along(nodes.join(came.withColumnRenamed("saved", "more"), ["owner", "depth"], "left"), "owner", own, F.sum, up=True)
    full = full.join(hashed_ends(rows), KEY, "left")
    whole = lambda x: (F.col(f"{x}_w") + F.coalesce(f"{x}_e", F.lit(0))).cast("bigint")
    return full.select(
        F.col("owner").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        F.col("n_children").cast("bigint").alias("n_children"),
        whole("leaves").alias("n_leaves"),
        whole("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


_CRC = """xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
    lambda a, b: list_reduce(list_concat([xor(a, b)], CAST(range(0, 8) AS BIGINT[])), lambda u, z: xor(u >> 1, CASE WHEN u % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END))))"""
ORACLE = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL),
v AS (SELECT c, list(struct_pack(r := r, x := x) ORDER BY p) AS s FROM t GROUP BY c),
h AS (SELECT c, s, {_CRC} % 6 AS h FROM v),
b AS MATERIALIZED (SELECT h.c, list_concat(CASE WHEN d.c IS NULL THEN [] ELSE d.s[1:h.h] END, h.s[h.h + 1:]) AS s FROM h LEFT JOIN v d ON d.c = h.c - h.c % 100),
n AS MATERIALIZED (SELECT s[1:d] AS s, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CASE WHEN len(s) = d THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '') AS ends FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM b) GROUP BY s[1:d], d),
k AS (SELECT s[1:d - 1] AS s, d - 1 AS d, count(*) AS n FROM n WHERE d > 0 GROUP BY 1, 2),
m AS MATERIALIZED (SELECT n.s, n.d, conv_id, n_convs, ends, coalesce(k.n, 0) AS n_children, CASE WHEN n.d > 0 THEN (n_convs - 1) * length(n.s[n.d].x) ELSE 0 END AS saved FROM n LEFT JOIN k ON k.s = n.s AND k.d = n.d),
a AS (SELECT s[1:i] AS s, i AS d, sum(saved) AS saved, count_if(n_children = 0) AS leaves FROM (SELECT s, saved, n_children, unnest(range(0, d + 1)) AS i FROM m) GROUP BY 1, 2)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, m.n_convs, CAST(m.n_children AS BIGINT) AS n_children, CAST(a.leaves AS BIGINT) AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN a ON a.s = m.s AND a.d = m.d LEFT JOIN n q ON m.d > 0 AND q.d = m.d - 1 AND q.s = m.s[1:m.d - 1]
"""
