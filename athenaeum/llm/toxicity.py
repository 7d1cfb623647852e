"""Toxicity by lexicon: Levenshtein automata over a lexicon trie, with context windows.

The lexicon is learned from labelled rows: words, and stems (prefixes) that inflect, whose share of toxic documents stands
out. Its trie is walked together with a Levenshtein automaton for each word of a text (both advance by one character, and a
branch is left once the automaton has no live state), which finds misspelled words, and words that begin with a misspelled stem,
in one descent; exact words and stems are looked up. A word near a term is no misspelling if it is an ordinary word (one of
the clean training rows), and terms whose neighbours are ordinary in more than ``NEIGHBOURS`` of these are matched exactly only.

Each hit is looked at in its window: quotation marks around it, words of reporting nearby, or other hits beside it. Counts of
hits by kind (exact or misspelled, plain or quoted, crowded or alone) are a document's features, and a logistic regression on
the labelled rows weighs them; so whether quotation excuses a word is learned, not assumed. Labelled rows may hold few
misspellings, so each toxic row is fitted twice with half its weight: as it is, and with its terms misspelled by one letter.

Labels are learned from at most ``SAMPLE`` rows of each label, those with the smallest hash of their id: a documented bound
on what is fitted on the driver (of rows with the same id the text with the smallest hash). All documents are scored.

Defined results: null and empty texts have no hits; repeated rows are scored each; without usable labels every score is the
labels' share (0.5 without any); an empty table gives an empty result; extra columns are not carried; a text is read whole,
whatever its length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from athenaeum.llm.common import crc32_of_id, sized_slices

FOLDS, HELD = 4, 2
SAMPLE = 1000
THRESHOLD = 0.3
#: Distinct toxic texts that hold a term: as a share of them, and for a word and a stem at least; endings of a stem.
SUPPORT, WORD_TEXTS, STEM_TEXTS, ENDINGS = 0.015, 3, 3, 3
LOG_ODDS = 3.0
STEM = (4, 7)
#: Of the clean texts, in how many a term may have neighbours for misspellings of it to be looked for.
NEIGHBOURS = 0.01
WINDOW = 4
WORD = re.compile(r"[^\W_]+")
#: Marks of quotation, and words (and stems) of reporting.
QUOTES = "\"'«»„“”‘’‹›"
REPORTING = {"said", "says", "say", "called", "wrote", "quoted", "quote", "quoting", "dit", "disait", "cité", "sagte", "schrieb", "zitiert", "dijo", "dice", "citó"}
FEATURES = ("exact", "stem", "misspelled", "quoted", "crowded", "density")


def distance_allowed(term: str, stem: bool = False) -> int:
    """Misspellings are looked for in terms long enough that one change leaves them recognizable."""
    return 1 if len(term) >= (6 if stem else 5) else 0


class Levenshtein:
    """An automaton that accepts what is within ``most`` changes of ``word``; a state is a row of distances, capped."""

    def __init__(self, word: str, most: int) -> None:
        self.word, self.most = word, most
        self.seen: dict[tuple, dict[str, tuple | None]] = {}

    def start(self) -> tuple[int, ...]:
        return tuple(min(i, self.most + 1) for i in range(len(self.word) + 1))

    def step(self, state: tuple[int, ...], c: str) -> tuple[int, ...] | None:
        """The next state, or None if none of its entries is live."""
        known = self.seen.setdefault(state, {})
        if c not in known:
            over, row = self.most + 1, [min(state[0] + 1, self.most + 1)]
            for i, w in enumerate(self.word):
                row.append(min(state[i] + (w != c), state[i + 1] + 1, row[i] + 1, over))
            known[c] = tuple(row) if min(row) <= self.most else None
        return known[c]


@dataclass
class Lexicon:
    """Terms in a trie; a stem's end is marked apart from a word's."""

    words: set[str]
    stems: set[str]
    #: Words that a stem explains; only their misspellings are looked for.
    explained: set[str] = field(default_factory=set)
    #: Terms that are matched exactly only, and words near others that are no misspellings.
    exact: set[str] = field(default_factory=set)
    ordinary: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        self.root: dict = {}
        kinds = {"word": {t for t in self.words | self.explained if distance_allowed(t)} - self.exact, "stem": {t for t in self.stems if distance_allowed(t, True)} - self.exact}
        for kind, terms in kinds.items():
            for term in terms:
                node = self.root
                for c in term:
                    node = node.setdefault(c, {})
                node[kind] = term
        # a misspelling of one change keeps one half of the term as it is: at an end of the word, or a stem's second half a place from its own
        self.heads = {t[: len(t) // 2] for t in kinds["word"] | kinds["stem"]}
        self.tails = {t[len(t) // 2 :] for t in kinds["word"]}
        self.inner = {(at, t[len(t) // 2 :]) for t in kinds["stem"] for at in range(len(t) // 2 - 1, len(t) // 2 + 2)}
        self.head_sizes, self.tail_sizes = sorted({len(x) for x in self.heads}), sorted({len(x) for x in self.tails})
        self.inner_places = sorted({(at, at + len(x)) for at, x in self.inner})
        self.stem_sizes = sorted({len(s) for s in self.stems})

    def near(self, word: str) -> set[tuple[str, str]]:
        """All terms (with "word" or "stem") that are one change from the word, or from how it begins."""
        if not (any(word[:n] in self.heads for n in self.head_sizes) or any(word[-n:] in self.tails for n in self.tail_sizes) or any((a, word[a:b]) in self.inner for a, b in self.inner_places)):
            return set()
        automaton = Levenshtein(word, 1)
        found, todo = set(), [(self.root, automaton.start())]
        while todo:
            node, state = todo.pop()
            if "word" in node and state[-1] <= 1:
                found.add((node["word"], "word"))
            if "stem" in node and min(state) <= 1:
                found.add((node["stem"], "stem"))
            for c, below in node.items():
                if len(c) == 1 and (after := automaton.step(state, c)):
                    todo.append((below, after))
        return found

    def find(self, word: str) -> tuple[str, int, str] | None:
        """(term, changes, "word" or "stem") of the best match: exact words, exact stems, then misspelled words and stems."""
        if word in self.words:
            return word, 0, "word"
        for n in self.stem_sizes:
            if word[:n] in self.stems:
                return word[:n], 0, "stem"
        if word in self.ordinary:
            return None
        term, kind = min(self.near(word), key=lambda x: (x[1] == "stem", x[0]), default=(None, None))
        return (term, 1, kind) if term else None


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def features(self, text: str, known: dict[str, tuple | None]) -> np.ndarray:
        lowered = text.lower()
        if len(lowered) != len(text):  # a few letters grow when lowered; places only have to agree with each other
            text = lowered
        spans, hits = [], []
        for m in WORD.finditer(lowered):
            w = m[0]
            if w not in known:
                if len(known) > 500_000:
                    known.clear()
                known[w] = self.lexicon.find(w)
            if known[w]:
                hits.append((len(spans), m.start(), m.end(), known[w]))
            spans.append(m)
        out = np.zeros(len(FEATURES))
        for i, (place, a, b, (_, changes, kind)) in enumerate(hits):
            near = [spans[j][0] for j in range(max(0, place - WINDOW), min(len(spans), place + WINDOW + 1)) if j != place]
            before, after = text[max(0, a - 2) : a], text[b : b + 2]
            quoted = any(c in QUOTES for c in before) and any(c in QUOTES for c in after) or any(w in REPORTING for w in near)
            crowded = i > 0 and place - hits[i - 1][0] <= WINDOW or i + 1 < len(hits) and hits[i + 1][0] - place <= WINDOW
            out[2 if changes else 1 if kind == "stem" else 0] += 1
            out[3] += quoted
            out[4] += crowded
        out[:5] = np.log1p(out[:5])
        out[5] = np.log1p(1000 * len(hits) / (len(spans) + 20))
        return out

    def score(self, text: str, known: dict) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(text, known) @ self.weights + self.bias, -30, 30))))


def lexicon_of(toxic: list[str], clean: list[str]) -> Lexicon:
    """Words and stems that stand out in the toxic texts; a stem replaces the words it explains."""
    toxic, clean = sorted(set(toxic)), sorted(set(clean))
    counts: dict[bool, Counter] = {True: Counter(), False: Counter()}
    for label, texts in ((True, toxic), (False, clean)):
        for t in texts:
            words = set(WORD.findall(t.lower()))
            stems = {(w[:n],) for w in words for n in range(STEM[0], STEM[1] + 1) if len(w) > n}
            counts[label].update(words | stems if label else words & candidates | stems & candidates)
        if label:
            least = SUPPORT * len(toxic)
            candidates = {k for k, n in counts[True].items() if n >= max(least, STEM_TEXTS if isinstance(k, tuple) else WORD_TEXTS)}

    def odds(k) -> float:
        return float(np.log((counts[True][k] + 0.1) / (len(toxic) + 0.2)) - np.log((counts[False][k] + 0.1) / (len(clean) + 0.2)))

    scored = sorted(((odds(k), counts[True][k], k) for k in candidates if odds(k) >= LOG_ODDS), key=lambda x: (-x[1], str(x[2])))
    words = [k for _, _, k in scored if isinstance(k, str)]
    kinds = Counter(w[:n] for w in counts[True] if isinstance(w, str) for n in range(STEM[0], STEM[1] + 1) if len(w) > n)
    # a stem has several endings, and nothing shorter says the same
    stems: set[str] = set()
    for _, _, k in sorted(((o, n, k) for o, n, k in scored if isinstance(k, tuple)), key=lambda x: (len(x[2][0]), x[2][0])):
        s = k[0]
        if kinds[s] >= ENDINGS and not any(s[:n] in stems for n in range(STEM[0], len(s))):
            stems.add(s)
    kept = {w for w in words if not any(w[:n] in stems for n in range(STEM[0], STEM[1] + 1))}
    made = Lexicon(kept, stems, set(words) - kept)
    # what lies near the terms in clean texts
    neighbours, ordinary, seen = Counter(), set(), {}
    for t in clean:
        near = set()
        for w in set(WORD.findall(t.lower())):
            if w not in seen:
                seen[w] = made.near(w) if made.find(w) else set()
                ordinary |= {w} if seen[w] else set()
            near |= {term for term, _ in seen[w]}
        neighbours.update(near)
    return Lexicon(kept, stems, made.explained, {t for t, n in neighbours.items() if n > NEIGHBOURS * len(clean)}, ordinary)


def misspelled(text: str, lexicon: Lexicon) -> str:
    """The text in lower case with one letter of each of its terms changed, dropped or doubled (which and how follows from the term)."""

    def change(m: re.Match) -> str:
        found = lexicon.find(m[0])
        if not found or found[1]:
            return m[0]
        size = len(found[0])
        code = zlib.crc32(m[0].encode())
        at = 1 + code % max(1, size - 2)
        put = (chr(ord("a") + code // 64 % 26), "", 2 * m[0][at : at + 1])[code // 16 % 3]
        return m[0][:at] + put + m[0][at + 1 :]

    return WORD.sub(change, text.lower())


def fit(rows: list[tuple[str, int]], share: float) -> Model:
    """``rows``: text and label; ``share``: of label 1 among all labelled rows, to which the sample's is put right."""
    # each half is looked at with the other half's lexicon, so that words learned by heart don't count as certain
    half = [rows[i::2] for i in (0, 1)]
    made = [lexicon_of([t for t, y in h if y], [t for t, y in h if not y]) for h in (half[1], half[0], rows)]
    model = Model(made[2], np.zeros(len(FEATURES)), 0.0)
    seen = []
    labels, parts = [], []
    for lexicon, part in zip(made, half, strict=False):
        known: dict = {}
        for t, y in part:
            shown = [t, misspelled(t, lexicon)] if y else [t]
            seen += [Model(lexicon, model.weights, 0.0).features(x, known) for x in shown]
            labels += [float(y)] * len(shown)
            parts += [1 / len(shown)] * len(shown)
    x, y, part = np.array(seen).reshape(-1, len(FEATURES)), np.array(labels), np.array(parts)
    share = min(max(share, 1e-3), 1 - 1e-3)
    if not len(y) or y.min() == y.max():
        model.bias = float(np.log(share / (1 - share)))
        return model
    mean = (part * y).sum() / part.sum()
    w = part * np.where(y > 0, share / mean, (1 - share) / (1 - mean))
    full, used = np.hstack([x, np.ones((len(x), 1))]), np.ones(x.shape[1] + 1, dtype=bool)
    while True:
        beta = _logistic(full[:, used], y, w)
        placed = np.zeros(len(used))
        placed[used] = beta
        # only quotation may speak for a document; a kind of hit that would is left out
        wrong = (placed < 0) & (np.arange(len(used)) < x.shape[1]) & (np.arange(len(used)) != FEATURES.index("quoted"))
        if not wrong.any():
            break
        used &= ~wrong
    model.weights, model.bias = placed[:-1], float(placed[-1])
    return model


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's method; the last column is the constant."""
    beta = np.zeros(x.shape[1])
    ridge = np.diag([0.5] * (x.shape[1] - 1) + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (w * p * (1 - p))) @ x + ridge, x.T @ (w * (y - p)) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of the labelled rows outside the held-out fold; at most 2 * SAMPLE texts are fetched."""
    key = F.col("doc_id")
    usable = labels.filter(F.coalesce(crc32_of_id(key) % FOLDS != HELD, F.lit(False)) & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    counted = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    total = sum(counted.values())
    share = counted.get(1, 0) / total if total else 0.5
    mark = F.xxhash64("doc_id", F.lit(7))
    chosen = None
    for label in (0, 1):
        some = usable.filter(F.col("toxic") == label).orderBy(mark, "doc_id").limit(SAMPLE)
        chosen = some if chosen is None else chosen.union(some)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = found.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "toxic", mark.alias("mark")).collect()
    rows.sort(key=lambda r: (r["mark"], r["text"], r["toxic"]))
    return fit([(r["text"], int(r["toxic"])) for r in rows], share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    held = F.coalesce(crc32_of_id(F.col("doc_id")) % FOLDS == HELD, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            for part in sized_slices(batch, "text"):
                scores = [sent.value.score(t or "", known) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    source = docs.select("doc_id", held.alias("held_out"), "text")
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
