"""Merkle manifest of a dataset: a root over all rows, and for each row what is needed to recompute it.

A leaf is the digest of a row's fields. Each language's leaves, in order of their id, make a tree of fan-in ``FAN``; the
languages' roots make one more. Leaves are put into ordered arrays of ``BLOCK`` (a fixed size, whatever the number of rows) and
an array is collapsed level by level by ``sequence``, ``transform``, ``slice`` and ``aggregate``; the roots of the blocks are
the nodes of the next round. On the way down, a block's path to the root is made once and meets its members in the block's
row, where each member's own steps are put before it. All of it is DataFrame functions.

Defined results: a null field is ``-`` and every other one carries its length, so no two rows share a leaf unless they are
alike; rows of one id are ordered by their leaf, alike rows have places of their own; a null id comes first and is never
tampered with; a null language is a language that comes first; a lone leaf is its own root; an empty table gives no rows;
columns beyond the five are not covered and their names don't matter; a text is one value of any length.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from athenaeum.llm.common import bind, crc32_of_id, cut
from athenaeum.llm.ranks import ranked

#: Nodes under one, and the fields of a leaf.
FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that one round collapses, and nodes of a block.
LEVELS = 3
BLOCK = FAN**LEVELS

STEP = "struct<left:string,right:string>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf(fields: dict[str, Column]) -> Column:
    """Digest of the five fields, each ``-`` or length, colon, value."""
    parts = [F.coalesce(F.concat(F.octet_length(fields[c].cast("string")).cast("string"), F.lit(":"), fields[c].cast("string")), F.lit("-")) for c in FIELDS]
    return digest(F.concat(*parts))


def lower_cased(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree (the language, never null, in the same order), leaf, and ``changed``: the leaf after tampering, where there is any."""
    fields = {c: F.col(f"`{c}`") for c in FIELDS}
    changed = F.when(crc32_of_id(F.col("doc_id")) % 3 == 0, leaf(fields | {"text": lower_cased(fields["text"])}))
    return docs.select("doc_id", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"), leaf(fields).alias("leaf"), changed.alias("changed"))


def _above(level: Column) -> Column:
    """The level over ``level``: one node for each run of ``FAN``."""
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(level, i * FAN + 1, FAN), "")))


def _levels(nodes: Column, height: Column) -> Column:
    """``nodes`` and the levels above them, as many as ``height`` still asks for, ``LEVELS`` at most."""
    steps = F.filter(F.array(*map(F.lit, range(LEVELS))), lambda i: i < height)
    return F.aggregate(steps, F.array(nodes), lambda made, _: F.concat(made, F.array(_above(F.element_at(made, -1)))))


def _steps(levels: Column, at: Column) -> Column:
    """What stands to the left and right of the member ``at`` and of its ancestors inside the block."""

    def step(i: int) -> Column:
        place = F.floor(at / FAN**i).cast("int")
        run = F.slice(F.get(levels, F.lit(i)), place - place % FAN + 1, FAN)
        return F.struct(F.array_join(F.slice(run, 1, place % FAN), "").alias("left"), F.array_join(F.slice(run, place % FAN + 2, FAN), "").alias("right"))

    return F.slice(F.array(*map(step, range(LEVELS))), F.lit(1), F.size(levels) - 1)


def _height(n: Column) -> Column:
    """Levels above ``n`` leaves."""
    return sum((F.when(n > FAN**i, 1).otherwise(0) for i in range(1, 21)), F.when(n > 1, 1).otherwise(0))


def _blocks(nodes: DataFrame, *carried: str) -> DataFrame:
    """Nodes (tree, height, rank, node) as blocks (tree, height, block, members), members in order."""
    block = F.floor(F.col("rank") / BLOCK).alias("block")
    members = F.sort_array(F.collect_list(F.struct("rank", "node", *carried))).alias("members")
    return nodes.groupBy("tree", "height", block).agg(members)


def _up(blocks: DataFrame) -> DataFrame:
    """Roots of blocks, as nodes of the next round."""
    levels = _levels(F.col("members.node"), F.col("height"))
    left = F.greatest(F.col("height") - LEVELS, F.lit(0))
    # two steps, as a lambda would read a "height" that is made beside it
    made = blocks.select("tree", "block", left.alias("left"), F.get(F.element_at(levels, -1), F.lit(0)).alias("node"))
    return made.select("tree", F.col("left").alias("height"), F.col("block").alias("rank"), "node")


def grown(placed: DataFrame, *carried: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every round over ``placed`` (tree, rank, node), and the roots (tree, node)."""
    counts = placed.groupBy("tree").agg(_height(F.count(F.lit(1))).alias("height"))
    nodes, rounds = placed.join(counts, "tree"), []
    highest = counts.agg(F.max("height")).first()[0] or 0
    for i in range(max(1, -(-highest // LEVELS))):
        rounds.append(cut(_blocks(nodes, *(() if rounds else carried)), f"blocks-{i}"))
        nodes = _up(rounds[-1])
    return rounds, cut(nodes.select("tree", "node"), "roots")


def _members(blocks: DataFrame, above: DataFrame, fields) -> DataFrame:
    """``fields(member, path, above)`` for every member; ``above`` has a path for each block, and may have more."""
    both = blocks.join(above, ["tree", "block"])
    path = lambda levels, i: F.concat(_steps(levels, i), F.col("path"))
    each = lambda levels: F.transform("members", lambda m, i: bind(path(levels, i), lambda p: fields(m, p)))
    return both.select(F.inline(bind(_levels(F.col("members.node"), F.col("height")), each)))


def paths(rounds: list[DataFrame], tops: DataFrame, last) -> DataFrame:
    """Down from ``tops`` (tree, path, and more in ``top``) to the members of the first round, each as ``last(member, path, top)``."""
    above = tops.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(rounds[1:]):
        above = _members(blocks, above, lambda m, p: F.struct(F.col("tree").alias("tree"), m["rank"].alias("block"), p.alias("path"), F.col("top").alias("top")))
    return _members(rounds[0], above, last)


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and what stands beside its path give."""
    return F.aggregate(path, node, lambda made, s: digest(F.concat(s["left"], made, s["right"])))


def proof(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, path (what stands left and right, level by level), changed (the leaf after tampering or null)."""
    placed = ranked(cut(leaves(docs), "leaves"), ["tree"], ["doc_id", "leaf"], "placed").withColumnRenamed("leaf", "node")
    rounds, subroots = grown(placed, "doc_id", "changed")
    langs = ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "node"), ["tree"], ["lang"], "langs")
    upper, root = grown(langs, "lang")
    tops = root.select("tree", F.array().cast(f"array<{STEP}>").alias("path"), F.col("node").alias("top"))
    of_lang = lambda m, p: F.struct(m["lang"].alias("tree"), p.alias("path"), F.struct(m["node"].alias("subroot"), F.col("top").alias("root")).alias("top"))
    by_lang = cut(paths(upper, tops, of_lang), "tops")
    row = lambda m, p: F.struct(m["doc_id"].alias("doc_id"), m["node"].alias("leaf"), F.col("top.subroot").alias("subroot"), F.col("top.root").alias("root"), p.alias("path"), m["changed"].alias("changed"))
    return paths(rounds, by_lang, row)


def verified(rows: DataFrame) -> DataFrame:
    """A manifest's rows with the proof's digest and the root recomputed after tampering."""
    made = rows.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))
