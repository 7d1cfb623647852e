"""Claims of a manuscript: each citation with its sentence and what in the sentence can be checked.

A manuscript cites by keys or by numbers; one that names any key is read by keys. Citations are blanked before sentences are cut, so
that dots and digits inside them neither end a sentence nor count as numbers. Phrases that define are found by a trie with failure
links, all of them in one pass over the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

from athenaeum.functions.arrow import Sentences, masked

#: Phrases that define, and how much is kept before and behind them.
DEFINING = (
    "— это", "является", "означает", "определяется как", "соответствует", "разделяет", "разделяющий", "отделяет", "граница между", "относится к",
    "corresponds to", "separates", "is defined as", "is described as", "refers to", "is understood as",
)
BEFORE, BEHIND = 30, 50
#: The least length of a sentence, and of a quotation in words or characters.
SENTENCE, WORDS, CHARACTERS = 10, 5, 30

#: What a key is made of, how citations are written by key and by number, and what points back to the last one.
KEY = r"[A-Za-z](?:[\w:.+-]*[\w+-])?"
BY_KEY = re.compile(rf"\[{{1,2}}(?P<group>-?@[^\[\]]+)\]{{1,2}}|(?<![\w\[@/])-?@(?P<bare>{KEY})")
EACH_KEY = re.compile(rf"(?:^|;)\s*-?@({KEY})")
BY_NUMBER = re.compile(r"\[(?P<numbers>\d{1,3}(?:\s*[,;]\s*\d{1,3})*)(?:\s*,\s*(?P<place>(?:п|разд|табл|с|гл|p|pp|sec|tab)\.\s*[^\]]+))?\]")
AGAIN = re.compile(r"\b[Тт]ам же\b|\b[Ii]bid\b\.?")
#: Headings of a bibliography, and quotations.
BIBLIOGRAPHY = re.compile(r"(?im)^#*\s*(?:\d+\.?\s*)?(?:references|bibliography|список (?:использованной )?литературы|литература|библиография)\s*$")
QUOTED = re.compile(r"[«\"“]([^«»\"“”]*)[»\"”]")
#: A run of digits and the marks that join them, with a sign before and a unit behind.
QUANTITY = re.compile(r"(?<![^\W_])(?P<sign>[-−])?(?P<run>\d+(?:[.,\-–]\d+)*)(?P<unit>\s*(?:%|процент\w*|°[CK]|кг|км|мм|м)(?![^\W_]))?(?![^\W_])")
YEAR = re.compile(r"(?:19|20)\d{2}")


class Phrases:
    """A trie over phrases with failure links: every occurrence of any of them, in one pass."""

    def __init__(self, phrases: tuple[str, ...]) -> None:
        self.phrases, self.next, self.fail, self.ends = phrases, [{}], [0], [[]]
        for i, phrase in enumerate(phrases):
            at = 0
            for c in phrase:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.fail.append(0)
                    self.ends.append([])
                at = self.next[at][c]
            self.ends[at].append(i)
        waiting = deque(self.next[0].values())
        while waiting:
            at = waiting.popleft()
            for c, to in self.next[at].items():
                self.fail[to] = self._step(self.fail[at], c)
                self.ends[to] += self.ends[self.fail[to]]
                waiting.append(to)

    def _step(self, at: int, c: str) -> int:
        while at and c not in self.next[at]:
            at = self.fail[at]
        return self.next[at].get(c, 0)

    def find(self, text: str) -> Iterator[tuple[int, int]]:
        """(start, phrase) in order of where they end."""
        at = 0
        for i, c in enumerate(text):
            at = self._step(at, c)
            for k in self.ends[at]:
                yield i + 1 - len(self.phrases[k]), k


DEFINITIONS = Phrases(DEFINING)


class Anchor(NamedTuple):
    kind: str
    raw: str
    start: int
    end: int


def is_identifier(run: str) -> bool:
    """Whether digits name a document or a clause: three parts with dots, or a part of five digits in a run that has several."""
    parts = [p.split(".") for p in re.split("[-–]", run)]
    several = len(parts) > 1 or len(parts[0]) > 1
    return any(len(p) > 2 for p in parts) or several and any(len(g) > 4 for p in parts for g in p)


#: Digits with one point among them: with a unit behind, they measure however long they are.
DECIMAL = re.compile(r"\d+\.\d+")


def quantities(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, number with sign and unit) of what is measured: no years, no identifiers, each end of a range for itself."""
    for m in QUANTITY.finditer(text):
        if is_identifier(m["run"]) and not (m["unit"] and DECIMAL.fullmatch(m["run"])):
            continue
        pieces = list(re.finditer(r"\d+(?:[.,]\d+)?", m["run"]))
        for i, p in enumerate(pieces):
            a, b = m.start("run") + p.start(), m.start("run") + p.end()
            if i == 0 and m["sign"]:
                a -= 1
            if i == len(pieces) - 1 and m["unit"]:
                b = m.end()
            raw = text[a:b].strip()
            if not YEAR.fullmatch(raw):
                yield a, b, raw


def anchors(text: str, start: int, end: int, definitions: list[tuple[int, int]]) -> list[Anchor]:
    """What can be checked in the sentence at [start, end): long quotations, the first of each defining phrase, quantities."""
    out = []
    for m in QUOTED.finditer(text, start, end):
        if len(m[1].split()) >= WORDS or len(m[1]) >= CHARACTERS:
            out.append(Anchor("quote", m[0], m.start(), m.end()))
    seen: set[int] = set()
    for at, k in definitions:
        if k not in seen:
            seen.add(k)
            a, b = max(start, at - BEFORE), min(end, at + len(DEFINING[k]) + BEHIND)
            out.append(Anchor("definition", " ".join(text[a:b].split()), a, b))
    out += [Anchor("number", raw, start + a, start + b) for a, b, raw in quantities(text[start:end])]
    return list(dict.fromkeys(out))


class Claim(NamedTuple):
    key: str
    place: str
    start: int
    end: int
    kind: str
    anchor: str


def _blank(pattern: re.Pattern, text: str) -> str:
    return pattern.sub(lambda m: " " * len(m[0]), text)


def manuscript_claims(text: str) -> list[Claim]:
    """A row for each citation and anchor of its sentence; a citation by key without any has the kind "none", one by number "reference".

    By numbers, only what stands outside the bibliography counts, and "ibid" is a reference to be looked at. Sentences of under ten
    characters make no claim.
    """
    hidden = masked(text)
    by_key = [m for m in BY_KEY.finditer(hidden) if m["bare"] or EACH_KEY.search(m["group"])]
    cited: list[tuple[int, int, list[str], str]] = []
    if by_key:
        plain = _blank(BY_KEY, hidden)
        cited = [(m.start(), m.end(), [m["bare"]] if m["bare"] else EACH_KEY.findall(m["group"]), "") for m in by_key]
    else:
        heading = BIBLIOGRAPHY.search(hidden)
        hidden = hidden[: heading.start()] + " " * (len(hidden) - heading.start()) if heading else hidden
        plain = _blank(BY_NUMBER, hidden)
        cited = [(m.start(), m.end(), re.findall(r"\d+", m["numbers"]), (m["place"] or "").strip()) for m in BY_NUMBER.finditer(hidden)]
        cited += [(m.start(), m.end(), [""], "") for m in AGAIN.finditer(plain)]
    # characters whose lower case is longer stay as they are, so that places hold
    small = "".join(low if len(low := c.lower()) == 1 else c for c in plain)
    sentences, found = Sentences(plain), sorted(DEFINITIONS.find(small))
    starts, out, known = [a for a, _ in found], [], {}
    for at, to, keys, place in cited:
        start, end = sentences.around(at, to)
        if len(text[start:end].strip()) < SENTENCE:
            continue
        if (start, end) not in known:  # a sentence is read once however often it cites
            i, j = bisect_left(starts, start), bisect_left(starts, end)
            known[start, end] = anchors(plain, start, end, found[i:j])
        fits = [a for a in known[start, end] if a.end <= end]
        for key in keys:
            if not by_key:
                out.append(Claim(key, place, start, end, "reference" if key else "again", f"[{key}]" if key else text[at:to]))
            elif not fits:
                out.append(Claim(key, place, start, end, "none", ""))
            if by_key or key:
                out += [Claim(key, place, start, end, a.kind, a.raw) for a in fits]
    return out
