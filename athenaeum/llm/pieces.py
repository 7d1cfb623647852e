"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of pieces with log scores.

The vocabulary is a SentencePiece model file. A Unigram file's scores are log probabilities and are taken as they are; a
BPE file stores ranks instead, which become log probabilities by Zipf's law (``-log(rank + 1)``, normalized over the
pieces). Encoding puts the whitespace marker before the text and for each space, takes the path of highest total score,
and spells characters without a piece in byte pieces; an unknown character costs ``UNKNOWN`` below the worst piece, as in
the public library. Decoding joins pieces, turns markers to spaces, bytes to characters, and drops the leading marker.

No piece has a marker behind another character, so the best path of a text is made of the best paths of its words, and
the distinct words of a slice of texts are solved all at once with array operations, byte by byte.

Defined results: null or empty text has no pieces and score 0; a literal marker character reads as a space, and so doesn't come
back (``lossless`` is false there); repeated rows are returned each; an empty table gives an empty result; ``encode`` carries
the columns named in ``keys`` only. Long texts are solved in runs of whole words, with some nine bytes of memory for each of
the text; a single word of many megabytes is solved whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from athenaeum.llm.common import binaries, ranges, sized_slices, utf8
from athenaeum.llm.trie import DoubleArray

#: The whitespace marker, and what an unknown character costs below the worst piece.
MARKER = "▁"
UNKNOWN = 10.0
#: Bytes from which a string is walked alone.
LONG = 256
#: Bytes of text solved together: the arrays over them take some hundred times as much memory.
SLICE = 2 << 20


@dataclass
class Pieces:
    """A vocabulary, ready to be sent to executors (its size is the model file's)."""

    trie: DoubleArray
    scores: np.ndarray
    byte_ids: np.ndarray
    spelled: np.ndarray
    spelled_at: np.ndarray
    apart: np.ndarray
    unknown: float

    @classmethod
    def of(cls, pieces: list[tuple[str, float, str]]) -> Pieces:
        """``pieces``: text, log score, and kind ("normal", "byte" or "other") in order of their ids."""
        spelled, byte_ids, keys = [], np.full(256, -1, dtype=np.int32), []
        for i, (text, _, kind) in enumerate(pieces):
            raw = text.replace(MARKER, " ").encode() if kind == "normal" else b""
            if kind == "byte":
                byte_ids[code := int(text[3:5], 16)] = i
                raw = bytes([code])
            elif raw:
                if b" " in raw.lstrip(b" "):
                    raise ValueError(f"a marker stands behind another character in {text!r}")
                keys.append((raw, i))
            spelled.append(raw)
        if (byte_ids < 0).any():
            raise ValueError("the vocabulary has no byte pieces")
        inside = np.zeros(256, dtype=bool)
        for raw, _ in keys:
            if len(raw) > 1:
                inside[np.frombuffer(raw, dtype=np.uint8)] = True
        # single bytes that no longer piece has: words end before and after them
        apart = ~inside
        apart[0x20], apart[0x80:] = False, False
        lengths = np.array([len(x) for x in spelled], dtype=np.int64)
        scores = np.array([s for _, s, _ in pieces], dtype=np.float64)
        worst = min(scores[i] for _, i in keys)
        return cls(DoubleArray(keys), scores, byte_ids, np.frombuffer(b"".join(spelled), dtype=np.uint8), np.concatenate([[0], np.cumsum(lengths)]), apart, worst - UNKNOWN)

    @classmethod
    def load(cls, path: str, log_scores: str = "auto") -> Pieces:
        """From a model file. ``log_scores``: "stored", "zipf", or "auto" (stored if they are not ranks)."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = ["byte" if model.is_byte(i) else "other" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "normal" for i in range(model.get_piece_size())]
        scores = [model.get_score(i) for i in range(len(kinds))]
        if log_scores == "zipf" or log_scores == "auto" and all(s == round(s) for s in scores):
            harmonic = math.log(sum(1 / (r + 1) for r in range(kinds.count("normal"))))
            scores = [-math.log(1 - s) - harmonic for s in scores]
        return cls.of([(model.id_to_piece(i), scores[i], kinds[i]) for i in range(len(kinds))])

    def _walk(self, text: bytes, best: np.ndarray, took: np.ndarray, piece: np.ndarray, slot: int) -> None:
        """The same search for one string, into the same arrays."""
        if not hasattr(self, "_lists"):
            self._lists = [x.tolist() for x in (self.trie.base, self.trie.check, self.trie.value, self.scores)]
        base, check, value, scores = self._lists
        n = len(text)
        top, wide, took_id = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        top[0], p = 0.0, 0
        while p < n:
            lead = text[p]
            width = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            here, node, single = top[p], 0, False
            for d in range(p, n):
                to = base[node] + text[d]
                if check[to] != node:
                    break
                node = to
                i = value[node]
                if i >= 0:
                    single = single or d + 1 - p == width
                    if here + scores[i] > top[d + 1]:
                        top[d + 1], wide[d + 1], took_id[d + 1] = here + scores[i], d + 1 - p, i
            if not single and here + self.unknown > top[p + width]:
                top[p + width], wide[p + width], took_id[p + width] = here + self.unknown, width, -1
            p += width
        best[slot : slot + n + 1], took[slot : slot + n + 1], piece[slot : slot + n + 1] = top, wide, took_id

    def viterbi(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best paths of the strings that ``starts`` cuts ``data`` into: ids of all, where each string's ids start, scores."""
        count = len(starts) - 1
        order = np.argsort(-(starts[1:] - starts[:-1]), kind="stable")
        at, n = starts[:-1][order], (starts[1:] - starts[:-1])[order]
        slot = at + order  # a string of n bytes has n + 1 slots
        best = np.full(len(data) + count, -np.inf)
        took, piece = np.zeros(len(best), dtype=np.int32), np.full(len(best), -1, dtype=np.int32)
        best[slot] = 0.0
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        # few strings are long: those are walked alone, all others in step
        apart = int(np.searchsorted(-n, -LONG, side="left"))
        for k in range(apart):
            self._walk(data[at[k] : at[k] + n[k]].tobytes(), best, took, piece, int(slot[k]))
        every = (at, n, slot)
        at, n, slot = at[apart:], n[apart:], slot[apart:]
        longest = int(n[0]) if len(n) else 0
        open_at = np.searchsorted(-n, -np.arange(longest), side="left")  # strings longer than p
        for p in range(longest):
            k = int(open_at[p])
            lead = data[at[:k] + p]
            live = np.flatnonzero((lead & 0xC0) != 0x80)
            lead = lead[live]
            width = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            here = best[slot[live] + p]
            single = np.zeros(len(live), dtype=bool)
            who, node, d = np.arange(len(live)), np.zeros(len(live), dtype=np.int32), 0
            first = at[live] + p
            left = n[live] - p
            while len(who):
                to = base[node] + data[first[who] + d]
                ok = check[to] == node
                who, node = who[ok], to[ok]
                d += 1
                ids = value[node]
                end = ids >= 0
                if end.any():
                    w, i = who[end], ids[end]
                    target = slot[live[w]] + (p + d)
                    score = here[w] + self.scores[i]
                    up = score > best[target]
                    target, w = target[up], w
                    best[target], took[target], piece[target] = score[up], d, i[up]
                    single[w[width[w] == d]] = True
                more = left[who] > d
                who, node = who[more], node[more]
            lone = np.flatnonzero(~single)
            if len(lone):
                target = slot[live[lone]] + p + width[lone]
                score = here[lone] + self.unknown
                up = score > best[target]
                target = target[up]
                best[target], took[target], piece[target] = score[up], width[lone][up], -1
        at, n, slot = every
        # back along the paths, all strings in step
        who, pos, trail = np.arange(count), n.copy(), []
        who = who[pos > 0]
        while len(who):
            s = slot[who] + pos[who]
            trail.append((who, pos[who] - took[s], took[s], piece[s]))
            pos[who] -= took[s]
            who = who[pos[who] > 0]
        scores = np.empty(count)
        scores[order] = best[slot + n]
        if not trail:
            return np.zeros(0, dtype=np.int32), np.zeros(count + 1, dtype=np.int64), scores
        who, start, wide, ids = (np.concatenate(x) for x in zip(*trail, strict=True))
        sort = np.lexsort((start, order[who]))
        who, start, wide, ids = order[who][sort], start[sort], wide[sort].astype(np.int64), ids[sort]
        reps = np.where(ids < 0, wide, 1)
        out = np.repeat(ids, reps)
        spell = np.repeat(ids < 0, reps)
        out[spell] = self.byte_ids[data[ranges((starts[:-1][who] + start)[ids < 0], wide[ids < 0])]]
        sizes = np.bincount(who, weights=reps, minlength=count).astype(np.int64)
        return out, np.concatenate([[0], np.cumsum(sizes)]), scores

    def _solved(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of a run of whole words, and of each word that starts at a place of ``first`` or at a bound of words: where it starts, its number of ids, its score."""
        space, alone = data == 0x20, self.apart[data]
        begins = alone | space
        begins[1:] = (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
        begins[first] = True
        starts = np.append(np.flatnonzero(begins), len(data))
        coded = binaries(data, starts).dictionary_encode()
        inverse = coded.indices.to_numpy().astype(np.int64)
        _, word_at, word_data = coded.dictionary.buffers()
        word_at = np.frombuffer(word_at, dtype=np.int32)[: len(coded.dictionary) + 1].astype(np.int64)
        ids, id_at, scores = self.viterbi(np.frombuffer(word_data, dtype=np.uint8)[: word_at[-1]], word_at)
        sizes = (id_at[1:] - id_at[:-1])[inverse]
        return ids[ranges(id_at[:-1][inverse], sizes)], np.array([starts[:-1], sizes]), scores[inverse]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of all texts, where each text's ids start, and each text's score. ``SLICE`` bytes are solved together: a longer text is cut before a word."""
        texts = pc.replace_substring(texts.fill_null(""), MARKER, " ")
        full = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", texts, ""))
        data, offsets = utf8(full)
        found, n_ids, scores, at = [np.zeros(0, dtype=np.int32)], np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts)), 0
        while at < len(data):
            to = self._bound(data, offsets, at + SLICE)
            first = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to)] - at
            ids, (starts, sizes), worth = self._solved(data[at:to], np.append(first, 0))
            text = np.searchsorted(offsets, starts + at, side="right") - 1
            found.append(ids)
            n_ids += np.bincount(text, weights=sizes, minlength=len(texts)).astype(np.int64)
            scores += np.bincount(text, weights=worth, minlength=len(texts))
            at = to
        return np.concatenate(found), np.concatenate([[0], np.cumsum(n_ids)]), scores

    @staticmethod
    def _bound(data: np.ndarray, offsets: np.ndarray, at: int) -> int:
        """The first place from ``at`` on where a text starts or white space begins a word."""
        while at < len(data):
            end = at + (1 << 16)
            window = data[at - 1 : end]
            word = np.flatnonzero((window[1:] == 0x20) & (window[:-1] != 0x20))
            text = int(offsets[np.searchsorted(offsets, at)])
            found = [at + int(x) for x in word[:1]] + [text] * (text <= end)
            if found:
                return min(found)
            at = end
        return len(data)

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids; the leading marker is dropped. Ids are spelled out some at a time."""
        ends, data = np.zeros(len(ids) + 1, dtype=np.int64), []
        np.cumsum((self.spelled_at[1:] - self.spelled_at[:-1])[ids], out=ends[1:])
        at_once = max(1, SLICE // 8)
        for i in range(0, len(ids), at_once):
            some = ids[i : i + at_once]
            data.append(self.spelled[ranges(self.spelled_at[some], (self.spelled_at[1:] - self.spelled_at[:-1])[some])].tobytes())
        data, at = b"".join(data), ends[starts]
        return [data[a + (data[a : a + 1] == b" ") : b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def encode(docs: DataFrame, model_path: str, keys: tuple[str, ...] = ("doc_id",), log_scores: str = "auto") -> DataFrame:
    """``keys``, ids, their number, how many are byte pieces, the path's score, and whether decoding gives the text back."""
    pieces = docs.sparkSession.sparkContext.broadcast(Pieces.load(model_path, log_scores))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces.value
        is_byte = np.zeros(len(vocabulary.scores), dtype=bool)
        is_byte[vocabulary.byte_ids] = True
        for batch in batches:
            for part in sized_slices(batch, "text", SLICE):
                texts = part.column("text")
                ids, starts, scores = vocabulary.encode(texts)
                fallback = np.concatenate([[0], np.cumsum(is_byte[ids])])[starts]
                back = vocabulary.decode(ids, starts)
                same = [b == (t or "").encode() for b, t in zip(back, texts.to_pylist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))
                columns = [lists, pa.array(np.diff(starts)), pa.array(np.diff(fallback)), pa.array(scores), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), *columns], names=[*keys, "ids", "n_tokens", "n_bytes", "score", "lossless"])

    source = docs.select(*keys, "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "text")
    return source.mapInArrow(run, f"{fields}, ids array<int>, n_tokens long, n_bytes long, score double, lossless boolean")


def decode(coded: DataFrame, model_path: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` and the text that ``ids`` spell; bytes that are no character become U+FFFD, null ids an empty text."""
    pieces = coded.sparkSession.sparkContext.broadcast(Pieces.load(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(batch):  # rows of some SLICE ids are spelled together, never as numbers of Python
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, side="right")))
                part = batch.slice(at, to - at)
                starts = np.concatenate([[0], ends[at:to] - (ends[at - 1] if at else 0)]).astype(np.int64)
                texts = pieces.value.decode(pc.list_flatten(part.column("ids")).to_numpy(zero_copy_only=False), starts)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], names=[*keys, "text"])
                at = to

    source = coded.select(*keys, "ids")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "ids")
    return source.mapInArrow(run, f"{fields}, text string")
