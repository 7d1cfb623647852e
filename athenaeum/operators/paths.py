"""Which file belongs to which work, by five tiers: named path, lookup, key in the file's name, title words, author.

Every tier is a join by equality. A key is looked for anywhere in a name by the rarest of its runs of letters, then as a whole. Title
words and key parts meet the names' words two by two, as two must occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from athenaeum.operators.quotations import rarest

#: Title words that count, their least length, and how many must occur; least length of a key's parts, and how many must occur besides the author.
TITLE_WORDS, LETTERS, OCCUR, PART, OTHERS = 5, 4, 2, 3, 2
#: Characters of a name that hold the author where " - " doesn't end them, and of a run of a key by which it is looked for.
PREFIX, ANCHOR = 40, 12


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))


def name_index(files: DataFrame) -> DataFrame:
    """path, name (lower case, without folders), its words, the words before the first " - ", and its years."""
    name = F.lower(F.regexp_extract("path", r"[^/]+\z", 0))
    head = F.when(F.contains("name", F.lit(" - ")), F.substring_index("name", " - ", 1)).otherwise(F.substring("name", 1, PREFIX))
    words = lambda c: F.array_union(_all(c, r"\p{L}+|\d+"), _all(c, r"[\p{L}\d]+"))
    made = files.select("path", name.alias("name"))
    return made.select("path", "name", words(F.col("name")).alias("words"), words(head).alias("head"), _all(F.col("name"), r"(?=(\d{4}))", 1).alias("years"))


def _pieces(text: str, length: str) -> Column:
    """A text's runs of ``length`` characters."""
    starts = F.sequence(F.lit(1), F.length(text) - F.col(length) + 1)
    return F.when(F.length(text) >= F.col(length), F.array_distinct(F.transform(starts, lambda i: F.substring(F.col(text), i, F.col(length)))))


def _by_key(works: DataFrame, names: DataFrame) -> DataFrame:
    """id and the least path where the key stands in the name.

    Of a key's runs of ``ANCHOR`` characters (a shorter key is one) the one that fewest names have is looked for, then the key as a
    whole. Works with one key are one, as are files with one name.
    """
    asked = works.select("id", F.regexp_replace(F.lower("key"), r"[^\w-]", "").alias("safe")).filter("safe <> ''")
    keys = asked.select("safe").distinct().withColumn("n", F.least(F.length("safe"), F.lit(ANCHOR)))
    lengths = F.broadcast(keys.select("n").distinct())  # ANCHOR rows at most
    named = names.filter("name <> ''").groupBy("name").agg(F.min("path").alias("path"))
    held = named.join(lengths).select("path", "name", F.explode(_pieces("name", "n")).alias("gram"))
    each = keys.select(F.col("safe").alias("item_id"), F.lit(1).alias("wanted"), F.explode(_pieces("safe", "n")).alias("gram"))
    counts = held.groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    # what runs make is many times the table's size, which a plan cannot tell: merged, never broadcast
    few = rarest(each.hint("merge"), counts).withColumnRenamed("item_id", "safe")
    met = few.hint("merge").join(held, "gram").filter(F.contains("name", F.col("safe")))
    return asked.hint("merge").join(met.groupBy("safe").agg(F.min("path").alias("path")), "safe").select("id", "path")


def _twos(words: Column) -> Column:
    """Every two of a row's distinct words, each two in one order."""
    return F.flatten(F.transform(words, lambda a: F.transform(F.filter(words, lambda b: a < b), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def _by_words(asked: DataFrame, held: DataFrame) -> DataFrame:
    """id and the least path of rows of ``asked`` (id, under, wanted) and ``held`` (path, under, words) that share ``under`` and two of the wanted words.

    Two shared words are one shared pair, for which the least path is kept, so each work meets one row for each of its pairs.
    """
    each = asked.select("id", "under", F.explode(_twos(F.col("wanted"))).alias("two"))
    known = asked.select(F.explode("wanted").alias("word")).distinct()
    # words that no work wants make no pairs
    words = held.select("path", "under", F.explode(F.array_distinct("words")).alias("word")).hint("merge").join(known, "word", "left_semi")
    kept = words.groupBy("path", "under").agg(F.collect_set("word").alias("words")).filter(F.size("words") >= 2)
    best = kept.select("path", "under", F.explode(_twos(F.col("words"))).alias("two")).groupBy("under", "two").agg(F.min("path").alias("path"))
    return each.hint("merge").join(best, ["under", "two"]).select("id", "path")


def _by_title(works: DataFrame, names: DataFrame) -> DataFrame:
    """At least ``OCCUR`` of the first title words, and the key's year, if it has one."""
    words = F.array_distinct(F.slice(F.regexp_extract_all(F.lower(F.coalesce("title", F.lit(""))), F.lit(rf"[\p{{L}}\d]{{{LETTERS},}}"), F.lit(0)), 1, TITLE_WORDS))
    asked = works.select("id", F.regexp_extract("key", r"\d{4}", 0).alias("under"), words.alias("wanted")).filter(F.size("wanted") >= OCCUR)
    held = names.select("path", F.explode(F.array_union("years", F.array(F.lit("")))).alias("under"), "words")
    return _by_words(asked, held)


def _by_author(works: DataFrame, names: DataFrame) -> DataFrame:
    """The key's first part among the words that name authors, and at least ``OTHERS`` of its other parts."""
    parts = F.filter(F.transform(F.regexp_extract_all("key", F.lit(r"[A-Z][a-z]+|[a-z]+|\d{4}"), F.lit(0)), lambda p: F.lower(p)), lambda p: F.length(p) >= PART)
    asked = works.select("id", parts.alias("parts")).filter(F.size("parts") > OTHERS)
    asked = asked.select("id", F.get("parts", F.lit(0)).alias("under"), F.array_distinct(F.slice("parts", 2, 100)).alias("wanted")).filter(F.size("wanted") >= OTHERS)
    return _by_words(asked, names.select("path", F.explode("head").alias("under"), "words"))


def resolve(works: DataFrame, files: DataFrame) -> DataFrame:
    """id, tier (1 to 5) and path of the best file of each work (id, key, title, direct, lookup) that has one; the least path of the best tier.

    Words are whole: a title word inside a longer one doesn't count. Null keys, titles and paths meet nothing.
    """
    there = files.select("path").distinct()
    names = name_index(there)
    named = lambda c: works.select("id", F.col(c).alias("path")).join(there, "path", "left_semi").select("id", "path")
    found = None
    for tier, rows in enumerate((named("direct"), named("lookup"), _by_key(works, names), _by_title(works, names), _by_author(works, names)), 1):
        best = rows.groupBy("id").agg(F.min("path").alias("path")).withColumn("tier", F.lit(tier))
        found = best if found is None else found.union(best)
    return found.groupBy("id").agg(F.min(F.struct("tier", "path")).alias("best")).select("id", "best.*")
