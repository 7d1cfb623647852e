"""A trie of conversation prefixes, its totals by peeling leaves.

A node is a distinct sequence of first turns. Its name is the number of its turns and 128 bits that change with every turn: the
exclusive or of a digest of (place, role, text) over the turns, so that a running value over a conversation names all its nodes
without any text beside another. Nodes come from grouping the conversations' steps by name.

Totals travel by messages: a node holds how many of its children have not reported; those that lack none send their totals to
their parent, until only the root is left. Nodes that follow each other with the same members (a conversation's own tail above
all) are one chain, told by (least member, number of members), and a chain reports as one: rounds grow with the branchings on a
path and not with its turns. A place in the chain is then read off a running sum. Hot parents meet their messages summed up.

Conversations of any length are ranked and summed in runs (:mod:`athenaeum.llm.ranks`), never in one task. The ids that end at a
node are joined in blocks of ids; the digest over them, which no two tasks can share, reads these blocks as a stream.

Defined results: null role or text counts as empty; turns without a number come first; repeated turns (same conversation and
number) are ordered by the first ``HEAD`` characters of role and text, then by digest, and all kept; rows without a conversation id belong to none and are left out; a rebuilt
conversation without turns is a member of the root alone; an empty table has no root; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from athenaeum.llm.common import crc32_of_id, cut, drop
from athenaeum.llm.ranks import ranked, running

#: Conversations of one base, and the most turns that are taken from it.
FAMILY, TAKEN = 5, 8
#: Range of ids that are joined before they are read, and characters that order turns of one number.
IDS, HEAD = 4096, 64
NODE = ["depth", "a", "b"]
XOR = (F.bit_xor, lambda x, y: x.bitwiseXOR(y))
SUM = (F.sum, lambda x, y: x + y)


def base(conv_id: Column) -> Column:
    return conv_id - conv_id % FAMILY


def taken(conv_id: Column) -> Column:
    """Turns that a conversation takes from its base."""
    return (crc32_of_id(conv_id) % (TAKEN + 1)).cast("long")


def turns(talks: DataFrame) -> DataFrame:
    """conv_id, what orders its turns (bounded, as the bounds of ranges are made of it), the digest of (role, text), and the text's bytes."""
    rows = talks.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
    said = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("said")
    return rows.select("conv_id", "turn", *[F.substring(c, 1, HEAD).alias(c) for c in ("role", "text")], said, F.octet_length("text").cast("long").alias("bytes"))


def placed_turns(talks: DataFrame) -> DataFrame:
    """conv_id, rank from 0, the digest's first 128 bits as two longs, and the text's bytes."""
    half = lambda i: F.conv(F.substring("said", i, 16), 16, -10).cast("long")
    placed = ranked(turns(talks), ["conv_id"], ["turn", "role", "text", "said"], "turns")
    return cut(placed.select("conv_id", "rank", half(1).alias("x"), half(17).alias("y"), "bytes"), "placed")


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, x, y, bytes) of every rebuilt turn, and all conversations (conv_id, size)."""
    sizes = cut(placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size")), "sizes")
    kin = F.explode(F.sequence(F.col("conv_id") - FAMILY + 1, F.col("conv_id") + FAMILY - 1))
    first = placed.filter((F.col("rank") < TAKEN) & (base(F.col("conv_id")) == F.col("conv_id"))).withColumn("kin", kin)
    first = first.filter((base(F.col("kin")) == F.col("conv_id")) & (F.col("rank") < taken(F.col("kin"))))
    first = first.select(F.col("kin").alias("conv_id"), (F.col("rank") + 1).alias("depth"), "x", "y", "bytes").join(sizes.select("conv_id"), "conv_id", "left_semi")
    own = placed.filter(F.col("rank") >= taken(F.col("conv_id"))).withColumn("base", base(F.col("conv_id")))
    own = own.join(sizes.select(F.col("conv_id").alias("base"), "size"), "base", "left")
    depth = F.col("rank") + 1 - taken(F.col("conv_id")) + F.least(F.coalesce("size", F.lit(0)), taken(F.col("conv_id")))
    return first.union(own.select("conv_id", depth.alias("depth"), "x", "y", "bytes")), sizes.select("conv_id", "size")


def steps(rows: DataFrame, talks: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, up_a, up_b, bytes): every node that a conversation passes, the root included, and that node's parent."""
    mixed = rows.select("conv_id", "depth", F.xxhash64("depth", "x", "y").alias("own_a"), F.xxhash64("y", "depth", "x", F.lit(1)).alias("own_b"), "bytes")
    named = running(mixed.withColumns({"a": F.col("own_a"), "b": F.col("own_b")}), ["conv_id"], "depth", {"a": XOR, "b": XOR})
    below = named.select("conv_id", "depth", "a", "b", F.col("a").bitwiseXOR(F.col("own_a")).alias("up_a"), F.col("b").bitwiseXOR(F.col("own_b")).alias("up_b"), "bytes")
    zero = F.lit(0).cast("long")
    return below.union(talks.select("conv_id", zero, zero, zero, zero, zero, zero))


def ends(path: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of the nodes at which some conversation ends."""
    last = path.groupBy("conv_id").agg(F.max("depth").alias("depth")).join(path.select("conv_id", *NODE), ["conv_id", "depth"])
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    blocks = last.groupBy(*NODE, F.floor(F.col("conv_id") / IDS).alias("block")).agg(joined.alias("ids"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, made = None, None
        for batch in batches:
            done = []
            for *at, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if at == node:
                    made.update(b",")
                else:
                    if node:
                        done.append((*node, made.hexdigest()))
                    node, made = at, hashlib.sha256()
                made.update(ids.encode())
            if done:
                yield rows(done)
        if node:
            yield rows([(*node, made.hexdigest())])

    def rows(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], [*NODE, "ends_sha256"])

    return blocks.repartition(*NODE).sortWithinPartitions(*NODE, "block").select(*NODE, "ids").mapInArrow(read, "depth long, a long, b long, ends_sha256 string")


def nodes(path: DataFrame) -> DataFrame:
    """(depth, a, b, up_a, up_b, bytes, conv_id, n_convs): every node with its least member and how many it has."""
    same = [F.first(c).alias(c) for c in ("up_a", "up_b", "bytes")]
    return path.groupBy(*NODE).agg(*same, F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))


CHAIN = ["conv_id", "n_convs"]


def chains(trie: DataFrame) -> DataFrame:
    """(conv_id, n_convs, top, over_conv, over_convs, saved): every chain, the chain over it (null over the root), its own savings."""
    own = (F.col("n_convs") - 1) * F.col("bytes")
    top = F.min(F.struct("depth", "up_a", "up_b"))
    made = trie.groupBy(*CHAIN).agg(top.alias("top"), F.sum(own).alias("saved"))
    parents = trie.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("over_conv"), F.col("n_convs").alias("over_convs"))
    parted = made.select(*CHAIN, F.col("top.depth").alias("depth"), F.col("top.up_a").alias("up_a"), F.col("top.up_b").alias("up_b"), "saved")
    return parted.join(parents, ["depth", "up_a", "up_b"], "left").select(*CHAIN, F.col("depth").alias("top"), "over_conv", "over_convs", "saved")


def peeled(bound: DataFrame) -> DataFrame:
    """Chains with n_children, and n_leaves and saved of all below: leaves report first, then whoever lacks no report."""
    over = [F.col("over_conv").alias("conv_id"), F.col("over_convs").alias("n_convs")]
    children = bound.filter("over_conv IS NOT NULL").groupBy(*over).agg(F.count(F.lit(1)).alias("n_children"))
    state = bound.join(children, CHAIN, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    state = cut(state.withColumns({"lacking": F.col("n_children"), "n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")}), "waiting")
    done = []
    while state.head(1):
        finished = cut(state.filter("lacking = 0"), "finished")
        if not finished.head(1):
            raise RuntimeError("nodes wait for each other")
        sent = finished.filter("over_conv IS NOT NULL").groupBy(*over).agg(F.count(F.lit(1)).alias("told"), F.sum("n_leaves").alias("leaves_below"), F.sum("saved").alias("saved_below"))
        heard = state.filter("lacking > 0").join(sent, CHAIN, "left")
        plus = lambda c, d, sign=1: F.col(c) + sign * F.coalesce(d, F.lit(0).cast("long"))
        after = cut(heard.select(*CHAIN, "top", "over_conv", "over_convs", plus("saved", "saved_below").alias("saved"), "n_children", plus("lacking", "told", -1).alias("lacking"), plus("n_leaves", "leaves_below").alias("n_leaves")), "waiting")
        drop(state)
        state = after
        done.append(finished)
    out = done[0] if done else state
    for more in done[1:]:
        out = out.union(more)
    return out


def trie(talks: DataFrame) -> DataFrame:
    """One row for every node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows, sizes = rebuilt(placed_turns(talks))
    path = cut(steps(cut(rows, "rebuilt"), sizes), "path")
    named = cut(nodes(path), "nodes")
    below = cut(peeled(cut(chains(named), "chains")), "peeled")
    own = named.select(*NODE, *CHAIN, ((F.col("n_convs") - 1) * F.col("bytes")).alias("own"))
    upto = running(own.withColumn("upto", F.col("own")), CHAIN, "depth", {"upto": SUM})
    last = F.col("depth") == F.col("bottom")
    bottoms = named.groupBy(*CHAIN).agg(F.max("depth").alias("bottom"))
    placed_in = upto.join(below.join(bottoms, CHAIN), CHAIN).join(ends(path), NODE, "left")
    return placed_in.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("top"), F.col("over_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.col("n_children")).otherwise(F.lit(1).cast("long")).alias("n_children"), "n_leaves",
        (F.col("saved") - F.col("upto") + F.col("own")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
