"""Bibliographies as columns: their entries, what each says, authors and DOIs in the forms that sources give them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The least length of an entry, the most authors that are listed, and words between names.
ENTRY, AUTHORS, BETWEEN = 20, 10, ("and", "et", "al", "др")
#: A DOI, an address, a year, and the number an entry begins with.
DOI, URL, YEAR, NUMBER = r"10\.\d{4,9}/[^\s,;\"<>\]]+", r"https?://[^\s,;\"<>\]]+", r"\b((?:19|20)\d{2})\b", r"^\s*(?:\[(\d{1,3})\]|(\d{1,3})[.)])\s+"


#: A DOI anywhere in a text, placeholders that are none, and the hosts that resolve DOIs.
ANYWHERE, PLACEHOLDER, RESOLVERS = r"(?U)\b(10\.\d{4,9}/[-._;()/:\w]+)\b", r"^10\.(?:0000|1000)/", ("doi.org", "dx.doi.org")


def _first(text: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _bare(text: Column) -> Column:
    """Without marks at its end; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.trim(text), r"[\s.,;]+$", ""), F.lit(""))


def entries(text: Column) -> Column:
    """array<struct<number, entry>> of a bibliography: cut before numbers that begin a line, or at blank lines where there are fewer than two."""
    numbered = F.split(F.concat(F.lit("\n"), text), r"\n(?=[ \t]*(?:\[\d{1,3}\]|\d{1,3}[.)])\s)")
    loose = F.split(text, r"\n\s*\n|\n(?=\p{Lu})")
    told = F.when(F.size(numbered) > 2, numbered).otherwise(loose)
    made = F.transform(told, lambda e: F.struct(F.regexp_replace(F.regexp_extract(e, NUMBER, 0), r"\D", "").try_cast("int").alias("number"), F.trim(F.regexp_replace(F.regexp_replace(e, NUMBER, ""), r"\s+", " ")).alias("entry")))
    return F.filter(made, lambda e: F.length(e["entry"]) >= ENTRY)


def parsed(entry: Column) -> Column:
    """struct<doi, url, year, authors, title, journal> of an entry; what it doesn't say is null.

    An entry with its year in brackets after the authors is read in that order; any other is its sentences in turn, without the year and
    what is an address.
    """
    text = F.regexp_replace(entry, NUMBER, "")
    url = _bare(_first(text, URL))
    said = F.trim(F.regexp_replace(F.regexp_replace(text, URL, ""), rf"(?i)(?:doi:\s*)?{DOI}", ""))
    inside = r"^(.+?)\s*\((?:19|20)\d{2}[a-z]?\)\.?\s*"
    ordered = said.rlike(inside)
    rest = F.regexp_replace(said, inside, "")
    # the first year leaves with the marks that set it off
    plain = F.filter(F.transform(F.split(F.regexp_replace(said, r"^(.*?)[\s(]*\b(?:19|20)\d{2}\b\)?(?:;[\d:(),–-]*)?", "$1"), r"\.(?:\s|$)"), _bare), lambda s: s.rlike(r"\p{L}"))
    part = lambda i: F.get(plain, F.lit(i))
    title = F.split_part(rest, F.lit(". "), F.lit(1))
    journal = F.regexp_replace(F.substring(rest, F.length(title) + 3, F.length(rest)), r",\s*\d.*$|\.\s.*$", "")
    few = F.size(plain) < 2
    return F.struct(
        _bare(F.lower(_first(text, DOI))).alias("doi"), F.when(~F.contains(url, F.lit("doi.org/")), url).alias("url"), _first(text, YEAR, 1).cast("int").alias("year"),
        F.when(ordered, _bare(_first(said, inside, 1))).when(~few, part(0)).alias("authors"),
        F.when(ordered, _bare(title)).when(few, part(0)).otherwise(part(1)).alias("title"),
        F.when(ordered, _bare(journal)).when(~few, part(2)).alias("journal"),
    )


INITIALS = r"^(?:\p{Lu}\.?){1,3}$"


def first_surname(authors: Column) -> Column:
    """Of the first of authors parted by semicolons: what stands before a comma, else the last word but for initials behind it."""
    one = F.trim(F.split_part(authors, F.lit(";"), F.lit(1)))
    words = F.filter(F.split(one, r"\s+"), lambda w: w != "")
    # drop initials from the end, but never the only word
    kept = F.reduce(F.reverse(words), F.array().cast("array<string>"), lambda a, w: F.when((F.size(a) == 0) & w.rlike(INITIALS), a).otherwise(F.array_append(a, w)))
    return F.when(F.contains(one, F.lit(",")), F.trim(F.split_part(one, F.lit(","), F.lit(1)))).otherwise(F.coalesce(F.get(kept, F.lit(0)), F.get(words, F.lit(0)), F.lit("")))


def blocking_surname(authors: Column) -> Column:
    """What duplicates are blocked by: the last word before the first comma or "and", in lower case."""
    words = F.split(F.trim(F.split_part(F.split_part(authors, F.lit(","), F.lit(1)), F.lit(" and "), F.lit(1))), r"\s+")
    return F.lower(F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("")))


def surname_set(authors: Column) -> Column:
    """The words of two letters or more in lower case, but for those between names, in order."""
    words = F.regexp_extract_all(F.coalesce(authors, F.lit("")), F.lit(r"\p{L}{2,}"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(F.transform(words, F.lower), lambda w: ~w.isin(*BETWEEN))))


def author_list(authors: Column) -> Column:
    """array<struct<last, initial>> of up to ``AUTHORS`` names: parted by semicolons or "and", or by commas, of which those before initials part no names."""
    clean = F.regexp_replace(F.coalesce(authors, F.lit("")), r"(?i)\s+and\s+", ";")
    parts = F.filter(F.transform(F.split(clean, ","), lambda p: F.trim(p)), lambda p: p != "")
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("held"))

    def pair(acc: Column, p: Column) -> Column:
        joined = acc["held"].isNotNull() & p.rlike(r"^\p{Lu}\.?(?:[\s-]*\p{Lu}\.?)?$")
        before = F.when(acc["held"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["held"]))
        whole = F.array_append(acc["done"], F.concat(acc["held"], F.lit(", "), p))
        return F.struct(F.when(joined, whole).otherwise(before).alias("done"), F.when(~joined, p).alias("held"))

    paired = F.aggregate(parts, zero, pair, lambda a: F.when(a["held"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["held"])))
    chunks = F.filter(F.when(F.contains(clean, F.lit(";")), F.transform(F.split(clean, ";"), lambda p: F.trim(p))).otherwise(paired), lambda c: c != "")

    def name(c: Column) -> Column:
        comma = F.contains(c, F.lit(","))
        last = F.when(comma, F.trim(F.split_part(c, F.lit(","), F.lit(1)))).otherwise(F.regexp_extract(c, r"(\S+)$", 1))
        rest = F.when(comma, F.substring_index(c, ",", -1)).otherwise(F.regexp_replace(c, r"\S+$", ""))
        letter = F.upper(F.regexp_extract(rest, r"\p{L}", 0))
        return F.struct(last.alias("last"), F.when(letter != "", F.concat(letter, F.lit("."))).otherwise("").alias("initial"))

    return F.filter(F.slice(F.transform(chunks, name), 1, AUTHORS), lambda n: n["last"] != "")


def doi_of_url(url: Column) -> Column:
    """The DOI that an address of a DOI resolver names; empty for any other address."""
    named = F.lower(F.coalesce(F.try_parse_url(F.trim(url), F.lit("HOST")), F.lit(""))).isin(*RESOLVERS)
    return F.when(named, F.regexp_replace(F.coalesce(F.try_parse_url(F.trim(url), F.lit("PATH")), F.lit("")), "^/+", "")).otherwise("")


def doi_anywhere(text: Column) -> Column:
    """The first DOI of a whole text; null for none and for placeholders."""
    found = F.regexp_replace(F.regexp_extract(text, ANYWHERE, 1), r"\.+$", "")
    return F.when((found != "") & ~found.rlike(PLACEHOLDER), found)
