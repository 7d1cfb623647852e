"""Language-model scoring by a weighted backoff automaton over words.

A text is read from left to right as tokens: its lower-cased words, then one end. The automaton's states are contexts, the last
``GRAMS - 1`` tokens (a start mark before the first); a state that training has seen ``n`` times has an arc for each token that
followed it and a failure arc to the state without the oldest token. With ``theta(n) = n ** HEAPS`` the failure arc weighs
``theta / (n + theta)`` and an arc taken ``c`` times adds ``c / (n + theta)``, so a token's probability is

    p(w | context) = (c(context w) + theta(n) * p(w | shorter context)) / (n + theta(n)),

a proper distribution at every state (a Dirichlet prior whose strength follows Heaps' law, which stands for the number of kinds
of followers that Witten-Bell smoothing counts). A state that training never saw fails at no cost. The state of no tokens fails
into a byte automaton that spells the token: byte n-grams up to ``ORDER`` (interpolated Witten-Bell), learned from each
document's distinct tokens, with the end as an empty word. A text's score is the sum of the log probabilities along its path.

No table of the model is ever in one place. Runs of texts make blocks; a block sends each of its distinct n-grams (56 bits of a
64-bit hash) once, with its count in training rows, to the bucket of its hash; buckets sum up and answer; and from the answers the
block builds the part of the automaton that its texts can reach (:class:`WordAutomaton`: numbered states, arcs in a table, failure
arcs) and walks it, each text's state passed on from token to token. An n-gram is one entry for each block that holds it however
frequent it is, and buckets are ranges of hashes, so none is hot. Nothing is cut off: all n-grams of all training rows count. What
is broadcast is the byte automaton, which has at most ``256 ** ORDER`` n-grams whatever the corpus is (some ten thousand in practice).

Defined results: null and empty texts are the end alone; a null id is in the training fold; repeated rows count and are
returned each; without training rows every count is 0 and tokens are spelled; an empty table gives an empty result; extra
columns are not carried. A text longer than a block is cut at white space into parts, which begin in the state that the
part before ends in and whose sums are added up: its score is that of the whole text. (Only the byte automaton learns from the
distinct tokens of parts there.)
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from athenaeum.llm.common import LOWER, SPACE, binaries, crc32_of_id, cut, gathered, utf8
from athenaeum.llm.trie import DoubleArray

#: Words of the longest n-gram, and the exponent of a state's kinds of followers.
GRAMS = 3
HEAPS = 0.9
ORDER = 3
#: Bytes that one reader of the byte automaton reads, tokens that one of the word automaton does, and bytes whose n-grams are counted together.
LANE, RUN, COUNTED = 512, 128, 1 << 20
#: Text of one block and one bucket's share of all text: smaller ones take less memory and cost more rows.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
STOP = 0x20
FOLDS = 10
SMOOTH = 0.1
#: Hashes of the end and of the start mark; no word holds a space.
END, START = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b" end", b" start"))
#: Bits of an n-gram's hash that tell it apart.
KEY_BITS = 56
#: In place of a byte n-gram: bytes of all texts, tokens and documents of training rows.
BYTES, TOKENS, DOCS = -1, -2, -3


class Words:
    """A slice of texts as words: their bytes side by side, and which belong to which text."""

    def __init__(self, texts: pa.Array) -> None:
        raw, offsets = utf8(texts)
        data = LOWER[raw]
        inside = ~SPACE[data]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        cuts = offsets[:-1][offsets[:-1] < len(data)]
        starts[cuts] = inside[cuts]
        self.data = data[inside]
        first = np.flatnonzero(starts)
        # bytes of words before each word
        self.starts = np.append(np.cumsum(inside, dtype=np.int32)[first] - 1, len(self.data)).astype(np.int64)
        self.per_doc = np.diff(np.searchsorted(first, offsets))
        self.coded = binaries(self.data, self.starts).dictionary_encode()
        self.local = self.coded.indices.to_numpy().astype(np.int64)
        self.kinds = len(self.coded.dictionary)

    def spelled(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct words and the empty word as the byte automaton reads them, each with a stop, and where each starts."""
        if not self.kinds:
            return np.full(1, STOP, dtype=np.uint8), np.arange(2)
        _, at, data = self.coded.dictionary.buffers()
        at = np.frombuffer(at, dtype=np.int32)[: self.kinds + 1].astype(np.int64)
        out = np.full(int(at[-1]) + self.kinds + 1, STOP, dtype=np.uint8)
        out[np.arange(at[-1]) + np.repeat(np.arange(self.kinds), np.diff(at))] = np.frombuffer(data, dtype=np.uint8)[: at[-1]]
        return out, np.append(at + np.arange(self.kinds + 1), len(out))

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """All texts' tokens as places in the list of distinct ones, whose last is the end, and where each text's start."""
        starts = np.concatenate([[0], np.cumsum(self.per_doc + 1)])
        out = np.full(int(starts[-1]), self.kinds, dtype=np.int64)
        out[np.arange(len(self.local)) + np.repeat(np.arange(len(self.per_doc)), self.per_doc)] = self.local
        return out, starts

    def hashes(self) -> np.ndarray:
        return np.array([*map(xxhash.xxh64_intdigest, self.coded.dictionary.to_pylist()), int(END)], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _before(values: np.ndarray, starts: np.ndarray, first) -> np.ndarray:
    """For each token what ``values`` has for the one before it, and ``first`` for the first of a text."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[starts[:-1]] = first
    return out


def levels(hashes: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order from 1: which tokens end an n-gram of it (within their text and its start mark), and those n-grams' hashes."""
    place = np.arange(len(hashes)) - np.repeat(starts[:-1], np.diff(starts))
    out, last = [(np.arange(len(hashes)), hashes)], hashes
    for n in range(2, GRAMS + 1):
        last = _mixed(_before(last, starts, START) * np.uint64(0x9E3779B97F4A7C15) + hashes)
        some = np.flatnonzero(place >= n - 2)
        out.append((some, last[some]))
    return out


PARTS = {"row": pa.int64(), "lead": pa.int32(), "last": pa.bool_()}
GAP = re.compile(rb"[\x20\x09-\x0D]")
TAIL = re.compile(rb"(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){1,%d}\Z" % (GRAMS - 1))


def cut_text(raw: bytes, size: int) -> Iterator[tuple[bytes, int, bool]]:
    """Parts of some ``size`` bytes, cut at white space: each with the words before it that make its state, their number, and whether it is the last."""
    at = 0
    while True:
        gap = GAP.search(raw, at + size) if len(raw) > at + size else None
        to = gap.end() if gap else len(raw)
        state, back = b"", 256
        while at and not state:
            m = TAIL.search(raw, max(0, at - back), at)
            # the first of the words found may be the end of a longer one, unless white space or the text's start is before it
            whole = m and (m.start() == 0 or m.start() > max(0, at - back)) and len(m[0].split()) == GRAMS - 1
            state, back = (m[0] if whole or m and back > at else b""), 2 * back
            if back > 4 * at and not m:
                break
        yield state + raw[at:to], len(state.split()), to == len(raw)
        at = to
        if at == len(raw):
            return


def _parts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows numbered; texts of more than ``size`` bytes as several rows of one number."""
    row = (TaskContext.get().partitionId() << 36) - 1
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        long = np.flatnonzero(sizes > size).tolist()
        for a, b in zip([0, *(i + 1 for i in long)], [*long, len(batch)], strict=True):
            if b > a:
                part = batch.slice(a, b - a)
                made = {"row": np.arange(row + 1, row + 1 + b - a), "lead": np.zeros(b - a, dtype=np.int32), "last": np.ones(b - a, dtype=bool)}
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(made[k], t) for k, t in PARTS.items())], names=[*part.schema.names, *PARTS])
                row += b - a
            if b < len(batch):
                row += 1
                for text, lead, last in cut_text(batch.column("text")[b].as_buffer().to_pybytes(), size):
                    one = batch.slice(b, 1)
                    columns = [pa.array([text.decode()], one.column(n).type) if n == "text" else one.column(n) for n in one.schema.names]
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.array([v], t) for v, t in zip((row, lead, last), PARTS.values(), strict=True))], names=[*one.schema.names, *PARTS])


def _own(part: pa.RecordBatch, starts: np.ndarray) -> np.ndarray:
    """Which tokens are a part's own: not the words before it, nor an end in the middle of a text."""
    own = np.ones(int(starts[-1]), dtype=bool)
    lead = part.column("lead").to_numpy()
    for i in np.flatnonzero(lead).tolist():
        own[starts[i] : starts[i] + lead[i]] = False
    own[starts[1:][~part.column("last").to_numpy(zero_copy_only=False)] - 1] = False
    return own


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte, so that the mostly empty high bytes lie together and deflate to nothing."""
    wide = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return pa.compress(np.ascontiguousarray(wide), codec="zstd", asbytes=True)


def _numbers(planes: bytes, n: int) -> np.ndarray:
    wide = np.frombuffer(pa.decompress(planes, decompressed_size=8 * n, codec="zstd"), dtype=np.uint8).reshape(8, n)
    return np.ascontiguousarray(wide.T).view("<u8").ravel()


def _grams(size: int):
    """Counts of all byte n-grams of full order in the distinct tokens of each training document, and the totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: tuple[np.ndarray, np.ndarray] | None = None
        sums = {BYTES: 0, TOKENS: 0, DOCS: 0}
        for part in gathered(_parts(batches, size), "text", size):
            sums[BYTES] += len(utf8(part.column("text"))[0])
            part = part.filter(pc.invert(part.column("held_out")))
            if not len(part):
                continue
            words = Words(part.column("text"))
            tokens, starts = words.tokens()
            sums[TOKENS] += int(_own(part, starts).sum())
            sums[DOCS] += int(pc.sum(part.column("last")).as_py())
            # each document's distinct tokens
            in_doc = np.unique(np.repeat(np.arange(len(part)), np.diff(starts)) * (words.kinds + 1) + tokens)
            weight = np.bincount(in_doc % (words.kinds + 1), minlength=words.kinds + 1)
            stream, at = words.spelled()
            # some bytes at a time, wherever words end, so that a word of any length takes no more
            for begin in range(0, len(stream), COUNTED):
                where = np.arange(begin, min(begin + COUNTED, len(stream)))
                word = np.searchsorted(at, where, side="right") - 1
                code = np.zeros(len(where), dtype=np.int64)
                for back in range(ORDER - 1, -1, -1):
                    code = code << 8 | np.where(where - back >= at[word], stream[np.maximum(where - back, 0)], STOP)
                weights = weight[word].astype(np.int64)
                if total:
                    code, weights = np.concatenate([total[0], code]), np.concatenate([total[1], weights])
                grams, inverse = np.unique(code, return_inverse=True)
                total = grams, np.bincount(inverse, weights=weights).astype(np.int64)
        found = [np.array(list(sums), dtype=np.int64), np.array(list(sums.values()), dtype=np.int64)]
        found = [np.concatenate(x) for x in zip(found, total, strict=True)] if total else found
        for i in range(0, len(found[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in found], names=["gram", "n"])

    return run


class Automaton:
    """States, arcs with log10 probabilities, and failure arcs with log10 backoff weights, over a double-array."""

    def __init__(self, grams: list[dict[bytes, int]]) -> None:
        """``grams``: for each order from 1, the n-grams and their counts."""
        one = {bytes([b]): grams[0].get(bytes([b]), 0) for b in range(256)}
        levels = [one, *grams[1:]]
        trie = DoubleArray([(g, 0) for level in levels for g in level])
        self.base, self.check = trie.base, trie.check
        size = len(trie.base)
        self.arc, self.logp = np.zeros(size, dtype=bool), np.zeros(size)
        self.next, self.fail, self.backoff = np.zeros(size, dtype=np.int32), np.zeros(size, dtype=np.int32), np.zeros(size)

        def slot(gram: bytes) -> int:
            at = 0
            for b in gram:
                to = int(trie.base[at]) + b
                if trie.check[to] != at:
                    return -1
                at = to
            return at

        sums: dict[bytes, list[int]] = {}
        for level in levels:
            for g, n in level.items():
                if n:
                    s = sums.setdefault(g[:-1], [0, 0])
                    s[0] += n
                    s[1] += 1
        chance: dict[bytes, float] = {}

        def of(gram: bytes) -> float:
            """The interpolated probability of the gram's last byte after the others."""
            if gram not in chance:
                lower = of(gram[1:]) if len(gram) > 1 else 1 / 256
                total, kinds = sums.get(gram[:-1], (0, 0))
                seen = levels[len(gram) - 1].get(gram, 0)
                if not total:
                    return lower
                chance[gram] = (seen + kinds * lower) / (total + kinds)
            return chance[gram]

        slots = {b"": 0}
        for level in levels:
            for g in level:
                slots[g] = slot(g)
        states = {c: slots[c] if c in slots else slot(c) for c in sums}
        states[b""] = 0

        def longest(text: bytes) -> int:
            for i in range(max(0, len(text) - ORDER + 1), len(text) + 1):
                if text[i:] in states:
                    return states[text[i:]]
            return 0

        for level in levels:
            for g in level:
                at = slots[g]
                self.arc[at], self.logp[at], self.next[at] = True, np.log10(of(g)), longest(g)
        for c, at in states.items():
            if c:
                total, kinds = sums[c]
                self.fail[at], self.backoff[at] = longest(c[1:]), np.log10(kinds / (total + kinds))
        self.start = longest(bytes([STOP]) * (ORDER - 1))

    def score(self, stream: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 probability of each token of the stream."""
        sizes = np.diff(at)
        lanes = -(-sizes // LANE)
        doc = np.repeat(np.arange(len(sizes)), lanes)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = at[doc] + nth * LANE
        stop = np.minimum(begin + LANE, at[doc + 1])
        warm = np.where(nth > 0, begin - (ORDER - 1), begin)
        order = np.argsort(warm - stop, kind="stable")
        doc, begin, stop, warm = doc[order], begin[order], stop[order], warm[order]
        state = np.where(warm == begin, self.start, 0).astype(np.int32)
        total = np.zeros(len(doc))
        longest = int((stop - warm).max()) if len(doc) else 0
        running = np.searchsorted(warm - stop, -np.arange(longest), side="left")
        for t in range(longest):
            k = int(running[t])
            symbol = stream[warm[:k] + t]
            s = state[:k]
            gain = np.zeros(k)
            to = self.base[s] + symbol
            hit = (self.check[to] == s) & self.arc[to]
            left = np.flatnonzero(~hit)
            while len(left):
                gain[left] += self.backoff[s[left]]
                s[left] = self.fail[s[left]]
                step = self.base[s[left]] + symbol[left]
                to[left] = step
                left = left[~((self.check[step] == s[left]) & self.arc[step])]
            gain += self.logp[to]
            state[:k] = self.next[to]
            if t < ORDER - 1:
                gain *= warm[:k] + t >= begin[:k]
            total[:k] += gain
        return np.bincount(doc, weights=total, minlength=len(sizes))


def train(marked: DataFrame, size: int = BLOCK_BYTES) -> tuple[Automaton, dict[int, int]]:
    """The byte automaton of the training rows of ``marked`` (text, held_out), and the totals. Fetched are byte n-grams only."""
    got = marked.select("text", "held_out").mapInArrow(_grams(size), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    gram, n = (got.column(x).to_numpy() for x in ("gram", "n"))
    totals = {BYTES: 0, TOKENS: 0, DOCS: 0} | {int(g): int(k) for g, k in zip(gram[gram < 0], n[gram < 0], strict=True)}
    gram, n, found = gram[gram >= 0], n[gram >= 0], []
    for k in range(1, ORDER + 1):
        kinds, inverse = np.unique(gram & ((1 << 8 * k) - 1), return_inverse=True)
        counts = np.bincount(inverse, weights=n, minlength=len(kinds)).astype(np.int64)
        found.append({g.to_bytes(k, "big"): c for g, c in zip(kinds.tolist(), counts.tolist(), strict=True)})
    return Automaton(found), totals


def _blocks(size: int):
    """Runs of rows as blocks: one compressed value each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        for nth, part in enumerate(gathered(_parts(batches, size), "text", size)):
            with pa.BufferOutputStream() as out:
                with pa.ipc.new_stream(out, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                    stream.write_batch(part)
                yield pa.RecordBatch.from_pydict({"block": pa.array([(partition << 24) + nth], pa.int64()), "rows": pa.array([out.getvalue().to_pybytes()], pa.binary())})

    return run


def _opened(rows: pa.BinaryScalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(rows.as_buffer()).read_next_batch()


def _asked(buckets: int):
    """Each block's distinct n-grams in order of their hashes, cut at the buckets' bounds: as steps from one to the next, with twice their count in training rows (and one more if it is a single token)."""
    bounds = np.array([(b << KEY_BITS) // buckets for b in range(buckets)], dtype=np.uint64)

    def of(block: int, part: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(part.column("text"))
        tokens, starts = words.tokens()
        trained = (np.repeat(~part.column("held_out").to_numpy(zero_copy_only=False).astype(bool), np.diff(starts)) & _own(part, starts)).astype(np.uint64)
        # hash, whether it is a single token, whether a training row has it: in one number, so that one sort does
        held = [h >> np.uint64(8) << np.uint64(8) | np.uint64(2 * (n == 0)) | trained[at] for n, (at, h) in enumerate(levels(words.hashes()[tokens], starts))]
        sorted_ = np.sort(np.concatenate(held))
        del held
        keys = sorted_ >> np.uint64(8)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts = np.add.reduceat(sorted_ & np.uint64(1), first) * np.uint64(2) + (sorted_[first] >> np.uint64(1) & np.uint64(1))
        keys = keys[first]
        cuts = np.append(np.searchsorted(keys, bounds), len(keys))
        some = np.flatnonzero(np.diff(cuts))
        rows = {"bucket": some, "n": np.diff(cuts)[some], "keys": [], "counts": []}
        for b in some.tolist():
            own = keys[cuts[b] : cuts[b + 1]]
            rows["keys"].append(_planes(np.diff(own, prepend=bounds[b])))
            rows["counts"].append(_planes(counts[cuts[b] : cuts[b + 1]]))
        made = {k: pa.array(v, pa.int64() if k in ("bucket", "n") else pa.binary()) for k, v in rows.items()}
        return pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(some), block)), **made})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # gives freed memory back
        for batch in batches:
            for block, rows in zip(batch.column("block").to_pylist(), batch.column("rows"), strict=True):
                yield of(block, _opened(rows))

    return run


def _answered(rows: pa.Table) -> pa.Table:
    """One bucket: every block's n-grams with their counts in all blocks, and in the first row how many single tokens training has."""
    sizes = rows.column("n").to_numpy()
    keys = np.concatenate([np.cumsum(_numbers(k, n), dtype=np.uint64) for k, n in zip(rows.column("keys").to_pylist(), sizes.tolist(), strict=True)])
    counts = np.concatenate([_numbers(k, n) for k, n in zip(rows.column("counts").to_pylist(), sizes.tolist(), strict=True)])
    order = np.argsort(keys, kind="stable")
    first = np.concatenate([[True], np.diff(keys[order]) > 0])
    total = np.add.reduceat(counts[order] >> np.uint64(1), np.flatnonzero(first))
    single = counts[order][first] & np.uint64(1) > 0
    each = np.empty(len(keys), dtype=np.uint64)
    each[order] = total[np.cumsum(first) - 1]
    cuts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    packed = pa.array([_planes(each[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
    kinds = np.zeros(len(sizes), dtype=np.int64)
    kinds[0] = np.count_nonzero(single & (total > 0))
    return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "n": rows.column("n"), "totals": packed, "kinds": pa.array(kinds)})


def _theta(n: np.ndarray) -> np.ndarray:
    return n**HEAPS


class Arcs:
    """Arcs by (state, symbol), in a table of open addresses that is searched for many at once."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.shift = np.uint64(64 - max(4, int(2 * len(keys)).bit_length()))
        self.table = np.full(1 << (64 - int(self.shift)), -1, dtype=np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._first(keys)
        while len(left):
            free = self.table[at] < 0
            self.table[at[free]] = left[free]
            lost = self.table[at] != left
            left, at = left[lost], (at[lost] + 1) & (len(self.table) - 1)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The arc of each key, -1 where there is none."""
        at = self._first(keys)
        found = self.table[at]
        look = np.flatnonzero((found >= 0) & (self.keys[found] != keys)) if len(self.keys) else np.zeros(0, dtype=np.int64)
        while len(look):
            at[look] = (at[look] + 1) & (len(self.table) - 1)
            found[look] = self.table[at[look]]
            look = look[(found[look] >= 0) & (self.keys[found[look]] != keys[look])]
        return found


class WordAutomaton:
    """The part of the model that a block's texts can reach: contexts as states, arcs with log10 probabilities, failure arcs with log10 weights.

    State 0 is the empty context, state 1 the start mark; then every context of up to ``GRAMS - 1`` tokens that training has. A state
    has an arc for each token that training saw behind it; an arc leads to the longest context that is a state. Failing in state 0
    leads to the token's spelling.
    """

    def __init__(self, tokens: np.ndarray, starts: np.ndarray, grams: list[np.ndarray], counts: list[np.ndarray], spelled: np.ndarray, n_tokens: int, n_docs: int) -> None:
        """``grams``, ``counts``: for each order and each token, which n-gram ends there (-1: none) and how often training has it.
        ``spelled``: log10 probability of each distinct token's letters."""
        self.symbols, self.spelled = len(spelled), spelled
        first = np.zeros(len(tokens), dtype=bool)
        first[starts[:-1]] = True
        named, sizes, reps = np.zeros((GRAMS, len(tokens)), dtype=np.int32), [np.array([n_tokens, n_docs], dtype=np.float64)], []
        for n in range(GRAMS):
            known = np.flatnonzero((grams[n] >= 0) & (counts[n] > 0))
            rep = np.full(int(grams[n].max(initial=-1)) + 1, -1)
            rep[grams[n][known]] = known  # n-grams are numbered, so any of their places stands for them
            kinds = np.flatnonzero(rep >= 0)
            reps.append(rep[kinds])
            if n < GRAMS - 1:
                rep[kinds] = np.arange(len(kinds)) + sum(map(len, sizes))
                named[n, known] = rep[grams[n][known]]
                sizes.append(counts[n][reps[n]])
        seen = np.concatenate(sizes)
        strength = _theta(seen)
        self.backoff = np.zeros(len(seen))
        some = seen > 0
        self.backoff[some] = np.log10(strength[some] / (seen[some] + strength[some]))
        self.fail = np.zeros(len(seen), dtype=np.int32)
        for n in range(1, GRAMS - 1):
            self.fail[named[n, reps[n]]] = named[n - 1, reps[n]]
        self.start = 1 if n_docs else 0
        keys, logs, to, before = [], [], [], None
        for n, at in enumerate(reps):
            # the state before the n-gram's last token: none, the one token or the start mark, or the n - 1 before it
            state = np.zeros(len(at), dtype=np.int64) if n == 0 else np.where(first[at], 1 if n == 1 else 0, named[n - 1, at - 1]).astype(np.int64)
            lower = spelled[tokens[at]] if n == 0 else before[at]
            theta = strength[state]
            logs.append(np.log10((counts[n][at] + theta * 10.0**lower) / (seen[state] + theta)))
            table = np.zeros(int(grams[n].max(initial=-1)) + 2)
            table[grams[n][at]] = logs[-1]
            before = table[grams[n]]  # what has no n-gram reads the last place
            keys.append(state * self.symbols + tokens[at])
            to.append(named[min(n, GRAMS - 2), at])
        self.arcs = Arcs(np.concatenate(keys))
        self.logp, self.next = np.concatenate(logs), np.concatenate(to)

    def score(self, tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 probability of each token, texts read from left to right with their state carried along.

        A text of more than ``RUN`` tokens is read by several readers, each of which reads the tokens of its first state before its own.
        """
        sizes = np.diff(starts)
        lanes = -(-sizes // RUN)
        nth = np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = np.repeat(starts[:-1], lanes) + nth * RUN
        stop = np.minimum(begin + RUN, np.repeat(starts[1:], lanes))
        warm = np.maximum(begin - (GRAMS - 1), np.repeat(starts[:-1], lanes))
        order = np.argsort(warm - stop, kind="stable")
        begin, stop, warm = begin[order], stop[order], warm[order]
        # who begins in the middle of a text knows nothing yet: after as many tokens as a state has, it is where one reader would be
        state = np.where(warm == np.repeat(starts[:-1], lanes)[order], self.start, 0).astype(np.int64)
        longest = int((stop - warm).max(initial=0))
        running = np.searchsorted(warm - stop, -np.arange(longest), side="left")
        out = np.zeros(len(tokens))
        for t in range(longest):
            k = int(running[t])
            symbol = tokens[warm[:k] + t]
            s, gain = state[:k].copy(), np.zeros(k)
            arc = self.arcs.find(s * self.symbols + symbol)
            left = np.flatnonzero(arc < 0)
            while len(left):
                gain[left] += self.backoff[s[left]]
                down = left[s[left] > 0]
                s[down] = self.fail[s[down]]
                arc[down] = self.arcs.find(s[down] * self.symbols + symbol[down])
                left = down[arc[down] < 0]
            hit = arc >= 0
            gain += np.where(hit, self.logp[arc] if len(self.logp) else 0.0, self.spelled[symbol])
            state[:k] = np.where(hit, self.next[arc] if len(self.next) else 0, 0)
            own = warm[:k] + t >= begin[:k]
            out[warm[:k][own] + t] = gain[own]
        return out


def walk(counts: list[np.ndarray], starts: np.ndarray, spelled: np.ndarray, n_tokens: int, n_docs: int) -> np.ndarray:
    """log10 probability of each token of texts in which no n-gram comes twice. counts: of each order, how often training has the n-gram that ends there."""
    each = np.arange(len(spelled))
    return WordAutomaton(each, starts, [each] * GRAMS, counts, spelled, n_tokens, n_docs).score(each, starts)


def _scored(model, n_tokens: int, n_docs: int):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        pa.set_memory_pool(pa.system_memory_pool())
        docs = _opened(blocks.column("rows")[0])
        words = Words(docs.column("text"))
        tokens, starts = words.tokens()
        found = levels(words.hashes()[tokens], starts)
        keys, inverse = np.unique(np.concatenate([h >> np.uint64(8) for _, h in found]), return_inverse=True)
        answers = answers.sort_by("bucket")
        totals = np.concatenate([_numbers(t, n) for t, n in zip(answers.column("totals").to_pylist(), answers.column("n").to_pylist(), strict=True)]).astype(np.float64)
        if len(totals) != len(keys):
            raise RuntimeError(f"{len(keys)} n-grams asked for, {len(totals)} answered")
        counts, grams, at = [], [], 0
        for some, _ in found:
            c, g = np.zeros(len(tokens)), np.full(len(tokens), -1, dtype=np.int64)
            g[some] = inverse[at : at + len(some)]
            c[some] = totals[g[some]]
            counts.append(c)
            grams.append(g)
            at += len(some)
        del inverse
        logs = WordAutomaton(tokens, starts, grams, counts, model.value.score(*words.spelled()), n_tokens, n_docs).score(tokens, starts)
        own = _own(docs, starts)
        sums = lambda x: np.add.reduceat(np.where(own, x, 0), starts[:-1])
        new = np.zeros(len(docs), dtype=np.int64)
        new[0] = sum(answers.column("kinds").to_pylist())
        columns = {"n_tokens": sums(np.ones(len(tokens), dtype=np.int64)), "n_known": sums((counts[0] > 0).astype(np.int64)), "raw": sums(np.log10(counts[0] + SMOOTH)), "score": sums(logs), "new": new}
        return pa.table({"row": docs.column("row"), "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), **{k: pa.array(v) for k, v in columns.items()}})

    return run


def score(docs: DataFrame, folds: int = FOLDS, size: int = BLOCK_BYTES) -> DataFrame:
    """Base and model scores of every row of ``docs`` (doc_id, text), learned from those outside fold 0, in blocks of some ``size`` bytes."""
    spark = docs.sparkSession
    held = F.coalesce(crc32_of_id(F.col("doc_id")) % folds == 0, F.lit(False))
    marked = docs.select("doc_id", held.alias("held_out"), "text")
    automaton, totals = train(marked, size)
    model = spark.sparkContext.broadcast(automaton)
    n_buckets = max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-totals[BYTES] // BUCKET_BYTES))
    # blocks are made once: what asks and what is answered both read them from this exchange
    dealt = marked.mapInArrow(_blocks(size), "block long, rows binary").repartition("block")
    asked = dealt.mapInArrow(_asked(n_buckets), "block long, bucket long, n long, keys binary, counts binary")
    answers = asked.groupBy("bucket").applyInArrow(_answered, "block long, bucket long, n long, totals binary, kinds long")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    walked = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scored(model, totals[TOKENS], totals[DOCS]), f"row long, doc_id {id_type}, held_out boolean, n_tokens long, n_known long, raw double, score double, new long")
    # a row for each text again
    summed = walked.groupBy("row").agg(*[F.first(c).alias(c) for c in ("doc_id", "held_out")], *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "raw", "score", "new")])
    found = cut(summed, "scored")
    kinds = found.agg(F.coalesce(F.sum("new"), F.lit(0))).first()[0]
    norm = float(np.log10(totals[TOKENS] + SMOOTH * (kinds + 1)))
    return found.select(
        "doc_id", "held_out", "n_tokens", "n_known",
        F.lit(totals[TOKENS]).cast("long").alias("train_tokens"),
        (F.col("raw") - F.col("n_tokens") * norm).alias("base_score"),
        "score",
    )
