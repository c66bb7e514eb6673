"""Prefix trie of conversations by the Euler-tour technique: leaves and savings of every subtree.

A node is a distinct sequence of first turns. Its name is exact: the smallest conversation that has it, and its depth.

1. Turns get their place, conversations are rebuilt, and every turn gets the hash of its prefix: the exclusive or of
   hashes of (depth, turn), twice 64 bits, a running sum that long conversations take in ranges (`operators.running`).
   Texts are left behind at the scan; only hashes and word counts move.
2. Nodes are counted by that hash, map-side first, and meet their parents.
3. Nodes that follow each other without a branch are one run (64 at most), which enters the tour as one pair of arcs:
   enter carries the run's leaves and savings, exit nothing. Enter goes on to the first child or to the own exit, exit
   to the next sibling or to the exit of the parent. Siblings are ordered in buckets of some 256, so that the children
   of a popular node are in many tasks; only one row per parent names its first and last child.
4. The tour is ranked by `list_rank`: sums from every arc to the end. What lies between a run's enter and exit is its
   subtree, so a difference of two sums gives leaves and savings; inside a run the nodes subtract what comes before them.
5. Ids of the conversations that end at a node are hashed as a stream of sorted chunks, 4,096 ids at most in each.

What it saves: a prefix that n conversations share is stored (and computed) once instead of n times, so a node saves
n - 1 times the words of its last turn.

Defined results: null role or text counts as empty; a row without conv_id belongs to no conversation. Turns go by `turn`
(null first), then by hashes of role and text; repeated rows are turns of their own. An empty table has no conversations
and no nodes, not even a root. Columns beyond conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
import operator
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.running import RANGE_ROWS, in_ranges, running_count, sums_in_ranges
from .common import SPACE, ship, stored
from .list_rank import SMALL, sums_to_end

ship(__name__)

RUN = 64  # nodes of a run, at most
SIBLINGS = 256  # siblings of a bucket, about
CHUNK_BITS = 12  # ids of a chunk of members: 1 << CHUNK_BITS at most
KEY = ["depth", "s", "t"]


def numbered_turns(conversations: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """conv_id, place (from 1), x and y (hashes of role and text), words."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.xxhash64(F.lit(1), role, text).alias("x"),
        F.xxhash64(F.lit(2), role, text).alias("y"), F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("bigint").alias("words"))
    return running_count(stored(turns), ["conv_id"], ["turn", "x", "y"], "place", range_rows).drop("turn")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversation ids, and the turns of the rebuilt conversations in the order of `place`.

    Conversation c takes the first h turns of conversation c - c % 20 and its own after its first h; h is crc32 of its
    decimal id modulo 4. At most 39 conversations take from one.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    ids = stored(turns.select("conv_id").distinct())
    taking = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 20).alias("base"), h.alias("h")).where("h > 0")
    first = turns.where("place <= 3").withColumnRenamed("conv_id", "base")
    shared = taking.join(first, "base").where("place <= h").select(turns.columns)
    return ids, turns.where(F.col("place") > h).unionByName(shared)


def prefixes(turns: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Per turn: conv_id, depth, s and t (the hash of the prefix that ends with it), up_s and up_t (without it), words."""
    rows, cut = in_ranges(turns, ["conv_id"], ["place"], range_rows)
    deep = sums_in_ranges(rows, cut, ["conv_id"], ["place"], {"depth": F.lit(1).cast("bigint")})
    p, q = F.xxhash64("depth", "x", "y"), F.xxhash64("y", "depth", "x")
    hashed = sums_in_ranges(deep, cut, ["conv_id"], ["place"], {"s": p, "t": q}, F.bit_xor, lambda a, b: a.bitwiseXOR(b))
    return hashed.select("conv_id", *KEY, F.col("s").bitwiseXOR(p).alias("up_s"), F.col("t").bitwiseXOR(q).alias("up_t"), "words")


def _nodes(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """conv_id, depth, s, t, n_convs, n_children, own savings, and the parent's conv_id and n_children."""
    zero = F.lit(0).cast("bigint")
    counted = rows.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"),
        F.max("up_s").alias("up_s"), F.max("up_t").alias("up_t"))
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        *[zero.alias(k) for k in KEY], "conv_id", "n_convs", zero.alias("words"),
        *[F.lit(None).cast("bigint").alias(c) for c in ("up_s", "up_t")])
    nodes = stored(counted.unionByName(root))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_s").alias("s"), F.col("up_t").alias("t")).agg(
        F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", zero)))
    above = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("s").alias("up_s"), F.col("t").alias("up_t"),
        F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings"))
    own = ((F.col("n_convs") - 1) * F.col("words")).alias("own")
    return stored(nodes.join(above, ["depth", "up_s", "up_t"], "left").select(
        "conv_id", *KEY, "n_convs", "n_children", own, "parent_conv_id", "siblings"))


def _in_runs(nodes: DataFrame) -> DataFrame:
    """Nodes with the depth of the head of their run, and the savings of the run's nodes above them."""
    starts = (F.col("depth") % RUN == 0) | (F.col("siblings") > 1) | (F.col("parent_conv_id") != F.col("conv_id"))
    so_far = Window.partitionBy("conv_id", F.floor(F.col("depth") / RUN)).orderBy("depth").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    above = F.sum("own").over(so_far) - F.col("own")
    return nodes.withColumns({"_above": above, "_starts": starts}).withColumns({
        "head": F.max(F.when(F.col("_starts"), F.col("depth"))).over(so_far),
        "before": F.col("_above") - F.max(F.when(F.col("_starts"), F.col("_above"))).over(so_far),
    }).drop("_above", "_starts")


def _tour(runs: DataFrame) -> DataFrame:
    """The arcs of the Euler tour over runs: a (conversation), b (2 * head, odd for exit), the next arc, leaves, saved."""
    enter, leave = F.col("head") * 2, F.col("head") * 2 + 1
    parent = ["parent_conv_id", "head"]
    heads = runs.where("head > 0")
    bucket = F.pmod(F.xxhash64("conv_id"), F.ceil(F.col("siblings") / SIBLINGS))
    bucketed = heads.select("conv_id", *parent, bucket.alias("bucket"))
    per_bucket = bucketed.groupBy(*parent, "bucket").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("last"))
    buckets = Window.partitionBy(*parent).orderBy("bucket")
    per_bucket = per_bucket.select(*parent, "bucket", "last", F.lead("first").over(buckets).alias("next_first"))
    next_one = F.lead("conv_id").over(Window.partitionBy(*parent, "bucket").orderBy("conv_id"))
    siblings = bucketed.withColumn("next", next_one).join(per_bucket, [*parent, "bucket"]).select(
        "conv_id", "head", F.coalesce("next", "next_first").alias("next"))
    ends = bucketed.groupBy(*parent).agg(
        F.min(F.struct("bucket", "conv_id"))["conv_id"].alias("first_child"),
        F.max(F.struct("bucket", "conv_id"))["conv_id"].alias("last_child")).select(
        F.col("parent_conv_id").alias("conv_id"), (F.col("head") - 1).alias("last_depth"), "first_child", "last_child")
    parents = stored(runs.join(ends, ["conv_id", "last_depth"], "left"))
    none, zero = F.lit(None).cast("bigint"), F.lit(0).cast("bigint")

    def arcs(df: DataFrame, a: Column, b: Column, next_a: Column, next_b: Column, leaves=zero, saved=zero) -> DataFrame:
        return df.select(a.alias("a"), b.alias("b"), next_a.alias("next_a"), next_b.alias("next_b"),
                         leaves.alias("leaves"), saved.alias("saved"))

    me, below = F.col("conv_id"), F.col("last_depth") + 1
    entering = arcs(parents, me, enter, F.coalesce(F.col("first_child"), me),
                    F.when(F.col("first_child").isNull(), leave).otherwise(below * 2), F.col("leaves"), F.col("saved"))
    to_sibling = arcs(siblings.where(F.col("next").isNotNull()), me, leave, F.col("next"), enter)
    to_parent = arcs(parents.where(F.col("last_child").isNotNull()), F.col("last_child"), below * 2 + 1, me, leave)
    end = arcs(runs.where("head = 0"), me, leave, none, none)
    return entering.unionByName(to_sibling).unionByName(to_parent).unionByName(end)


def _member_hashes(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """s, t, depth and ends_sha256 of the nodes at which conversations end."""
    last = rows.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("last"))
    ends = ids.join(last, "conv_id", "left").select(
        "conv_id", *[F.coalesce(F.col(f"last.{k}"), F.lit(0)).alias(k) for k in KEY])
    chunk = F.shiftright("conv_id", CHUNK_BITS).alias("chunk")
    chunks = ends.groupBy(*KEY, chunk).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("members"))
    ordered = chunks.repartition(*KEY).sortWithinPartitions(*KEY, "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest = None, None
        for batch in batches:
            out = []
            for *key, members in zip(*(batch.column(c).to_pylist() for c in (*KEY, "members"))):
                if key == held:
                    digest.update(b",")
                else:
                    if held is not None:
                        out.append((*held, digest.hexdigest()))
                    held, digest = key, hashlib.sha256()
                digest.update(members.encode())
            yield _rows(out)
        if held is not None:
            yield _rows([(*held, digest.hexdigest())])

    return ordered.select(*KEY, "members").mapInArrow(run, "depth bigint, s bigint, t bigint, ends_sha256 string")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out)) or [()] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()])], names=[*KEY, "ends_sha256"])


def trie(conversations: DataFrame, range_rows: int = RANGE_ROWS, small: int = SMALL) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    ids, turns = rebuilt(stored(numbered_turns(conversations, range_rows)))
    rows = stored(prefixes(turns, range_rows))
    placed = stored(_in_runs(_nodes(ids, rows)))
    runs = stored(placed.groupBy("conv_id", "head").agg(
        F.max("depth").alias("last_depth"), F.count_if(F.col("n_children") == 0).alias("leaves"), F.sum("own").alias("saved"),
        F.min_by("parent_conv_id", "depth").alias("parent_conv_id"), F.min_by("siblings", "depth").alias("siblings")))
    ranks = sums_to_end(_tour(runs), ["leaves", "saved"], small)
    sign = F.when(F.col("b") % 2 == 0, 1).otherwise(-1)
    below = ranks.groupBy(F.col("a").alias("conv_id"), F.floor(F.col("b") / 2).alias("head")).agg(
        F.sum(sign * F.col("leaves")).alias("n_leaves"), F.sum(sign * F.col("saved")).alias("saved_tokens"))
    return placed.join(below, ["conv_id", "head"]).join(_member_hashes(ids, rows), KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("saved_tokens") - F.col("before")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
