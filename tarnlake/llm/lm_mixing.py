"""Language-model scores by online logistic context mixing.

A text is a sequence of words, each closed by a space, and one end mark. Two kinds of hashed contexts predict it.

*Bits.* Bytes are coded by a Huffman tree over the training texts' bytes, so a byte is a few binary decisions.
``ORDERS`` contexts, each a hash of so many bytes before within the word, point into a table of counts of either
decision; the counts of one slot are a bit predictor. A mixer adds the predictors' log odds with weights that a gate selects, and the logistic of
the sum is the decision's probability. There are ``SETS`` of weights, each with its own gate (how sure the longest
contexts are, the place in the word, how sure the middle contexts are), learned online in one pass: one training text in ``FIT_SHARE``,
by the hash of its id and with all its words, is at first left out of the predictors' counts, and these texts' words come in ``ROUNDS``
blocks, each predicted by the weights so far before these follow its gradient. Then the left-out texts are counted, too.
The sets' outputs and the orders go to a last mixer, whose weights go on learning online in every text that is scored, after each block
of ``STEP`` words; decisions that the sets are sure of (log odds of ``OPEN`` or more) keep the sets' even mixture.

*Words.* Counts of words, word pairs and word triples of all training texts, by their hash, predict a word by itself and
from the one or two before it. A training text is scored by the counts of all others, and any text also by its own words so far.

Every text starts with even weights over the sets and uninformed gates for the word contexts (by how often a context was
seen, and whether the last word was found in it). The gates, too, are refined online, after each block of ``STEP`` words, by what
each predictor was worth so far in this text. The letters' and the words' probabilities are mixed by share, not by log odds. The sum of the logarithms is the text's log probability, and over its
length the bits per byte.

What is gathered from the corpus grows with it: the distinct words, pairs and triples of each slice of texts with their
training counts go, sorted and packed, to the group of their hash range, are added up there, and the totals
come back to the slice. Groups hold about as many keys at every input size, and a word is one entry
of a slice, however common it is. The bit predictors count each distinct word once, with its total; their table, whose
size is fixed, is counted by task and merged by block.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm import text as T
from tarnlake.session import drop_scratch, materialize, scratch_path

#: Bytes of text in a slice, and in a group's share of the hash range; letters expanded at once; words between updates.
SLICE, GROUP, PIECE, STEP = 7 << 20, 12 << 20, 100_000, 32
BLOCK = 4096
#: (bytes before, bits of the table)
ORDERS = ((1, 17), (2, 19), (3, 20), (4, 21), (6, 22))
_OFFSET = np.concatenate([[0], np.cumsum([1 << b for _, b in ORDERS])])
SLOTS, CHOICES, SCALE = int(_OFFSET[-1]), 15, 10.0
#: Weight sets: (gate that selects the weights, how many of the orders).
SETS = ((0, 5), (1, 5), (2, 3))
#: Code lengths and log odds are kept as whole numbers of this fraction of a natural unit.
FRACTION = 1024
FIT_SHARE, ROUNDS, RIDGE = 16, 8, 20.0
#: A word context's gates: levels of its count, by whether the word before was found; a further one means no context.
GATES = {1: 2, 2: 16, 3: 10}
#: Bits of a word's key; keys of pairs and triples have fewer, by the size of the corpus.
WORD_BITS = 62
#: Evidence that a gate starts with (found, all), and the share of its weight that a set hands round after a block.
PRIOR, SHARE = (0.3, 1.0), 0.01
#: Texts mixed side by side; log odds from which a decision is sure, and most of any; inputs of a text's own mixers; how fast op6 lets them learn.
TEXTS, OPEN, LIMIT, INPUTS, RATE = 384, 3.0, 12, len(ORDERS) + len(SETS), 0.04
_SEEDS = np.random.default_rng(3).integers(1, 2**63, 64, dtype=np.uint64) | T.U(1)
END, SPACE = 10, 32


class Code:
    """A Huffman tree: for each byte its path as (inner node, branch) pairs."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(c), s, s) for s, c in enumerate(counts)]
        heapq.heapify(heap)
        child: dict[int, tuple] = {}
        n = 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            child[256 + n] = (a[2], b[2])
            heapq.heappush(heap, (a[0] + b[0], 256 + n, 256 + n))
            n += 1
        paths: dict[int, list[tuple[int, int]]] = {}
        walk = [(heap[0][2], [])]
        while walk:
            node, path = walk.pop()
            if node < 256:
                paths[node] = path
            else:
                walk += [(c, [*path, (node - 256, k)]) for k, c in enumerate(child[node])]
        self.size = np.array([len(paths[s]) for s in range(256)])
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        flat = [x for s in range(256) for x in paths[s]]
        self.node, self.branch = np.array([x[0] for x in flat], np.uint64), np.array([x[1] for x in flat], bool)


class Letters:
    """The bytes of some words. What predicts a byte is the word up to it, so words that begin alike share their first bytes' code.

    The end mark is a word of its own byte alone; every other word is followed by a space. ``same`` maps the bytes of all
    words to ``some``, one place for each distinct beginning.
    """

    def __init__(self, words: list[bytes]):
        end = bytes([END])
        self.flat = np.frombuffer(b"".join(w if w == end else w + b" " for w in words), np.uint8)
        self.size = np.array([len(w) + (w != end) for w in words], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.place = np.arange(len(self.flat)) - np.repeat(self.first, self.size)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(T._TABLE[self.flat] * T._power("up", max(1, len(self.flat)))[: len(self.flat)])])
        start = np.repeat(self.first, self.size)
        begun = T.mix((total[1:] - total[start]) * T._power("down", len(total))[start] ^ self.place.astype(np.uint64) * _SEEDS[60])
        _, self.some, self.same = np.unique(begun, return_index=True, return_inverse=True)

    def pieces(self, code: Code):
        """(slot of each order, branch, place in the word) of the decisions of some PIECE distinct beginnings, and decisions of each."""
        for lo in range(0, len(self.some), PIECE):
            at = self.some[lo : lo + PIECE]
            place, symbol = self.place[at], self.flat[at]
            n = code.size[symbol]
            of = np.repeat(np.arange(len(at)), n)
            step = code.start[symbol][of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            node = code.node[step] * T._MULT
            contexts, h, done = [], np.zeros(len(at), np.uint64), 0
            for number, (order, bits) in enumerate(ORDERS):
                for k in range(done + 1, order + 1):
                    h = h + np.where(place >= k, self.flat[np.maximum(at - k, 0)].astype(np.uint64) + T.U(1), T.U(0)) * _SEEDS[k]
                done = order
                x = T.mix(h * _SEEDS[0] + T.U(order))
                contexts.append((((x[of] + node) * _SEEDS[62]) >> T.U(64 - bits)).astype(np.int32) + np.int32(_OFFSET[number]))
            yield contexts, code.branch[step], np.minimum(place, CHOICES - 1).astype(np.int8)[of], n


def _packed(x: np.ndarray) -> bytes:
    """Compressed byte by byte of the values: high bytes are mostly alike."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _unpacked(x: bytes, kind) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(x), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(flat.T).view(kind).ravel()


class _Chunk:
    """The tokens of some MB of texts, gathered part by part."""

    def __init__(self):
        self.words, self.h, self.row = [], [], []
        self.rows = self.bytes = 0

    def add(self, column: pa.Array) -> None:
        w = T.Words(column)
        h = np.concatenate([w.hashes(), np.full(w.rows, 1, np.uint64)])
        w._held = None
        row = np.concatenate([np.repeat(np.arange(w.rows), w.counts), np.arange(w.rows)])
        order = np.argsort(row, kind="stable")
        self.words.append((w, order))
        self.h.append(h[order])
        self.row.append((row[order] + self.rows).astype(np.int32))
        self.rows += w.rows
        self.bytes += len(w.data)

    def texts(self, at: np.ndarray) -> list[bytes]:
        """The words at some tokens, in the order of the tokens."""
        out: list[bytes] = []
        ends = np.cumsum([len(order) for _, order in self.words])
        cuts = np.searchsorted(at, np.concatenate([[0], ends]))
        for k, (w, order) in enumerate(self.words):
            i = order[at[cuts[k] : cuts[k + 1]] - (ends[k - 1] if k else 0)]
            real = i < len(w.starts)
            raw, j = w.data.tobytes(), np.where(real, i, 0)
            lo, hi = (x[j].tolist() if len(x) else [0] * len(j) for x in (w.starts, w.ends))
            out += [raw[x:y] if r else b"\n" for x, y, r in zip(lo, hi, real.tolist())]
        return out

    def close(self, chunk: int, ids: pa.Array, train: np.ndarray) -> pa.RecordBatch:
        """One row for the texts: their distinct words, common ones first, and the number of each token's word."""
        h, row = np.concatenate(self.h), np.concatenate(self.row)
        _, first, unit = np.unique(h, return_index=True, return_inverse=True)
        often = np.argsort(-np.bincount(unit, minlength=len(first)), kind="stable")
        rank = np.empty(len(first), np.int32)
        rank[often] = np.arange(len(first), dtype=np.int32)
        unit, first = rank[unit], first[often]
        order = np.argsort(first)
        found = self.texts(first[order])
        words = [found[k] for k in np.argsort(order)]
        own = np.bincount(unit, weights=train[row], minlength=len(words)).astype(np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        total = np.bincount(flat, weights=np.repeat(own, [len(w) for w in words]), minlength=256).astype(np.int64)
        total[SPACE] += own.sum()
        made = {
            "chunk": [chunk],
            "ids": pa.array([ids.to_pylist()], pa.list_(pa.int64())),
            "train": pa.array([train.astype(bool)], pa.list_(pa.bool_())),
            "counts": pa.array([np.bincount(row, minlength=self.rows)], pa.list_(pa.int32())),
            "units": [_packed(unit)],
            "words": [zstandard.compress(b" ".join(words), 3)],
            "bytes": pa.array([total], pa.list_(pa.int64())),
        }
        return pa.RecordBatch.from_pydict(made, schema=_SCHEMA)


_SCHEMA = pa.schema(
    [("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("counts", pa.list_(pa.int32()))]
    + [("units", pa.binary()), ("words", pa.binary()), ("bytes", pa.list_(pa.int64()))]
)
_SHAPE = "chunk long, ids array<long>, train array<boolean>, counts array<int>, units binary, words binary, bytes array<long>"


def _slices(batches):
    """Chunks of texts: what ``_Chunk.close`` gives for every SLICE bytes or so."""
    from pyspark import TaskContext

    part, k = TaskContext.get().partitionId(), 0
    now, ids, train = _Chunk(), [], []
    for b in batches:
        for at, column in T.slices(b["text"]):
            now.add(column)
            ids.append(b["id"].slice(at, len(column)))
            train.append(b["train"].slice(at, len(column)).to_numpy(zero_copy_only=False))
            if now.bytes > SLICE:
                yield now.close(part << 32 | k, pa.concat_arrays(ids), np.concatenate(train))
                now, ids, train, k = _Chunk(), [], [], k + 1
    if now.rows:
        yield now.close(part << 32 | k, pa.concat_arrays(ids), np.concatenate(train))


class _Slice:
    """A row of ``_SCHEMA`` read back; tokens are in the order of the texts."""

    def __init__(self, row: dict):
        self.ids, self.train = row["ids"].values, np.array(row["train"].values, bool)
        self.counts = np.array(row["counts"].values, np.int64)
        self.off = np.concatenate([[0], np.cumsum(self.counts)])
        self.words = zstandard.decompress(row["words"].as_py()).split(b" ")
        self.unit = _unpacked(row["units"].as_py(), np.int32)

    def of_tokens(self, x: np.ndarray) -> np.ndarray:
        return np.repeat(x, self.counts)

    def hashes(self) -> np.ndarray:
        """A hash of each distinct word; the end mark, whose byte is white space, has one of its own."""
        end = self.words.index(bytes([END]))
        others = b" ".join(self.words[:end] + self.words[end + 1 :])
        return np.insert(T.Words(pa.array([others], pa.large_binary()).cast(pa.large_string())).hashes(), end, T.U(1))

    def grams(self, bits: int):
        """Keys of each token's word, of the pair that it ends, and of the triple, one after another."""
        h = self.hashes()
        yield _word_key(h)[self.unit]
        before, first = h[self.unit], self.off[:-1]
        total = before * _SEEDS[50]
        for k in (1, 2):
            before = np.concatenate([np.zeros(1, np.uint64), before[:-1]])
            before[first] = T.U(k + 1)
            total = total + before * _SEEDS[50 + k]
            yield T.mix(total + T.U(k)) >> T.U(64 - bits)


def _word_key(h: np.ndarray) -> np.ndarray:
    return T.mix(h * _SEEDS[50]) >> T.U(64 - WORD_BITS)


def _cuts(keys: np.ndarray, bits: int, groups: int) -> list[tuple[int, slice]]:
    """The parts of sorted keys by group, those that hold any."""
    ends = np.searchsorted((keys >> T.U(bits - 32)) * T.U(groups) >> T.U(32), np.arange(groups + 1))
    return [(g, slice(ends[g], ends[g + 1])) for g in range(groups) if ends[g] < ends[g + 1]]


def _deltas(keys: np.ndarray) -> bytes:
    return _packed(np.diff(keys, prepend=T.U(0)))


def _undelta(pack: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(pack, np.uint64), dtype=np.uint64)


def _rows(batches):
    for b in batches:
        for r in range(b.num_rows):
            yield {c: b[c][r] for c in b.schema.names}


def _words(groups: int, every: int):
    """(group, keys, words, n, fit): a slice's distinct words by key, with counts in training texts and in those of the fit."""

    def run(batches):
        for row in _rows(batches):
            s = _Slice(row)
            key = _word_key(s.hashes())
            order = np.argsort(key)
            key, words = key[order], [s.words[k] for k in order]
            n, fit = (np.bincount(s.unit[s.of_tokens(x)], minlength=len(words))[order].astype(np.uint32) for x in (s.train, _for_fit(s.ids, s.train, every)))
            parts = _cuts(key, WORD_BITS, groups)
            packs = [(_deltas(key[x]), zstandard.compress(b" ".join(words[x]), 1), _packed(n[x]), _packed(fit[x])) for _, x in parts]
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in parts], pa.int32()), *[pa.array(x, pa.binary()) for x in zip(*packs)]], ["group", "keys", "words", "n", "fit"])

    return run


def _distinct(table: pa.Table) -> pa.Table:
    """One row: the distinct words of a group in the order of their keys, with both counts."""
    keys = np.concatenate([_undelta(x) for x in table["keys"].to_pylist()])
    words = [w for x in table["words"].to_pylist() for w in zstandard.decompress(x).split(b" ")]
    keys, first, of = np.unique(keys, return_index=True, return_inverse=True)
    n, fit = (np.bincount(of, weights=np.concatenate([_unpacked(x, np.uint32) for x in table[c].to_pylist()])).astype(np.uint64) for c in ("n", "fit"))
    made = [[_deltas(keys)], [zstandard.compress(b" ".join([words[k] for k in first]), 3)], [_packed(n)], [_packed(fit)]]
    sums = [pa.array([int(n.sum())]), pa.array([int((n > 0).sum())])]
    names = ["group", "keys", "words", "n", "fit", "tokens", "distinct"]
    return pa.Table.from_arrays([table["group"].slice(0, 1).combine_chunks(), *[pa.array(x, pa.binary()) for x in made], *sums], names)


def _keys(bits: int, groups: int):
    """(group, chunk, keys, n): a slice's distinct keys in order; those of pairs and triples with their training counts."""

    def run(batches):
        for row in _rows(batches):
            s = _Slice(row)
            held = s.of_tokens(~s.train).astype(np.uint64)
            for order, key in enumerate(s.grams(bits)):
                if order:
                    # The lowest bit marks held-out tokens, so that one sort groups keys and counts.
                    x = np.sort(key << T.U(1) | held)
                    k = x >> T.U(1)
                    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                    n, k = np.add.reduceat(1 - (x & T.U(1)).astype(np.int64), first).astype(np.uint32), k[first]
                    packs = [(order * groups + g, _deltas(k[own]), _packed(n[own])) for g, own in _cuts(k, bits, groups)]
                else:
                    k = np.sort(_word_key(s.hashes()))
                    packs = [(g, _deltas(k[own]), b"") for g, own in _cuts(k, WORD_BITS, groups)]
                group, *rest = zip(*packs)
                made = [pa.array(group, pa.int32()), pa.array([row["chunk"].as_py()] * len(packs), pa.int64())]
                yield pa.RecordBatch.from_arrays([*made, *[pa.array(x, pa.binary()) for x in rest]], ["group", "chunk", "keys", "n"])

    return run


_REPLY = "chunk long, group int, totals binary"


def _reply(groups: int):
    """The training counts of one group's keys over all slices, for each slice in the order of its keys."""

    def run(key, table: pa.Table, held: pa.Table) -> pa.Table:
        keys = [_undelta(x) for x in table["keys"].to_pylist()]
        if key[0].as_py() < groups:
            words = _undelta(held["keys"][0].as_py())
            n = _unpacked(held["n"][0].as_py(), np.uint64)
            totals = [_packed(n[np.searchsorted(words, k)]) for k in keys]
        else:
            flat, n = np.concatenate(keys), np.concatenate([_unpacked(x, np.uint32) for x in table["n"].to_pylist()])
            order = np.argsort(flat)
            flat = flat[order]
            of = np.cumsum(np.concatenate([[False], flat[1:] != flat[:-1]]))
            back = np.empty(len(flat), np.uint64)
            back[order] = np.bincount(of, weights=n[order])[of]
            ends = np.cumsum([len(k) for k in keys])
            totals = [_packed(back[e - len(k) : e]) for e, k in zip(ends, keys)]
        group = pa.array([key[0].as_py()] * len(keys), pa.int32())
        return pa.Table.from_arrays([table["chunk"].combine_chunks(), group, pa.array(totals, pa.binary())], ["chunk", "group", "totals"])

    return run


def _for_fit(ids: pa.Array, train: np.ndarray, every: int) -> np.ndarray:
    """The training texts that fit the weight sets: about one in ``every``, by the hash of the id."""
    h = T.mix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + _SEEDS[61])
    return train & (h % T.U(every) == 0)


def _count(code, texts: str = "rest"):
    """(block, at, n): counts of either branch by slot, from the training counts of a task's words: of the fit's texts or of the rest."""

    def run(batches):
        both = np.zeros((SLOTS, 2), np.uint32)
        flat = both.ravel()
        for row in _rows(batches):
            n = _unpacked(row["fit"].as_py(), np.uint64)
            n = n if texts == "fit" else _unpacked(row["n"].as_py(), np.uint64) - n
            words = zstandard.decompress(row["words"].as_py()).split(b" ")
            letters, n = Letters([words[k] for k in np.flatnonzero(n)]), n[n > 0]
            times = np.bincount(letters.same, weights=np.repeat(n, letters.size), minlength=len(letters.some)).astype(np.uint32)
            lo = 0
            for slots, branch, _, sizes in letters.pieces(code.value):
                own = np.repeat(times[lo : lo + len(sizes)], sizes)
                lo += len(sizes)
                for at in slots:
                    np.add.at(flat, at.astype(np.int64) * 2 + branch, own)
        for block in range(SLOTS // BLOCK):
            part = both[block * BLOCK : (block + 1) * BLOCK].T
            some = np.flatnonzero(part.any(0))
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([_packed(some.astype(np.uint16))]), pa.array([_packed(part[:, some].ravel())])], ["block", "at", "n"])

    return run


def _merge(table: pa.Table) -> pa.Table:
    both = np.zeros((2, BLOCK))
    for at, n in zip(table["at"].to_pylist(), table["n"].to_pylist()):
        both[:, _unpacked(at, np.uint16)] += _unpacked(n, np.uint32).reshape(2, -1)
    q, sure = quantise(both)
    return pa.table({"block": table["block"].slice(0, 1).cast(pa.int32()), "q": pa.array([q.tobytes()], pa.binary()), "sure": pa.array([sure.tobytes()], pa.binary())})


def quantise(both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scaled log odds, how often seen: 0, 1, 2-3, 4-15, 16 or more) of each slot."""
    odds = np.log((both[1] + 0.4) / (both[0] + 0.4))
    return np.clip(np.rint(odds * SCALE), -127, 127).astype(np.int8), np.searchsorted([1, 2, 4, 16], both.sum(0), "right").astype(np.int8)


def gates(slots: list[np.ndarray], sure: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """What selects the weights of a decision: how sure the two longest contexts are, the place in the word, the two middle contexts."""
    rough = np.array([0, 0, 1, 1, 2], np.int8)
    one, two, three, four = (np.take(sure, s) for s in slots[1:])
    return [four * np.int8(3) + np.take(rough, three), place, two * np.int8(3) + np.take(rough, one)]


#: Weights before the fit: a row for each gate, a column for each order, all alike.
START = np.full((CHOICES, len(ORDERS)), 0.3)


def _predictions(letters: Letters, code: Code, table: np.ndarray, sure: np.ndarray):
    """(log odds of the branch taken by order, gates, decisions of each distinct beginning), piece by piece."""
    for slots, branch, place, sizes in letters.pieces(code):
        odds = np.stack([np.take(table, s) for s in slots], 1)
        odds *= (branch.astype(np.int8) * np.int8(2) - np.int8(1))[:, None]
        yield odds, gates(slots, sure, place), sizes


def statistics(words: list[bytes], times: np.ndarray, code: Code, table: np.ndarray, sure: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    """For each weight set and gate: code length, gradient and curvature of some words that count so many times."""
    size = len(ORDERS)
    letters = Letters(words)
    often, lo = np.bincount(letters.same, weights=np.repeat(times.astype(float), letters.size), minlength=len(letters.some)), 0
    out = np.zeros((len(SETS), CHOICES, 1 + size + size * size))
    for odds, gate, sizes in _predictions(letters, code, table, sure):
        n, x = np.repeat(often[lo : lo + len(sizes)], sizes), odds.astype(np.float64) / SCALE
        lo += len(sizes)
        for k, (which, orders) in enumerate(SETS):
            g = gate[which]
            add = lambda v: np.bincount(g, weights=v, minlength=CHOICES)  # noqa: B023, E731
            z = np.einsum("ij,ij->i", x[:, :orders], weights[k][g, :orders])
            miss = 1 / (1 + np.exp(np.clip(z, -30, 30)))
            out[k, :, 0] += add(n * np.logaddexp(0, -z))
            for i in range(orders):
                out[k, :, 1 + i] += add(n * miss * x[:, i])
                for j in range(i, orders):
                    both = add(n * miss * (1 - miss) * x[:, i] * x[:, j])
                    for at in {i * size + j, j * size + i}:
                        out[k, :, 1 + size + at] += both
    return out


def online(sums) -> list[np.ndarray]:
    """The weights of each of SETS, learned online: ROUNDS blocks of words are each predicted by the weights so far, which then follow
    the gradient of the block's code length, over the curvature of all blocks so far. A ridge holds rare gates near START. ``sums`` gives
    the statistics of a block at some weights."""
    size = len(ORDERS)
    now = [np.pad(START[:, :orders] * size / orders, ((0, 0), (0, size - orders))) for _, orders in SETS]
    bend = np.zeros((len(SETS), CHOICES, size, size)) + RIDGE * np.eye(size)
    for block in range(ROUNDS):
        found = sums(now, block)
        bend += found[:, :, 1 + size :].reshape(bend.shape)
        for k, (_, orders) in enumerate(SETS):
            for g in range(CHOICES):
                now[k][g, :orders] += np.linalg.solve(bend[k, g, :orders, :orders], found[k, g, 1 : 1 + orders])
    return [(w / SCALE).astype(np.float32) for w in now]


def in_block(words: list[bytes], n: np.ndarray, block: int) -> tuple[list[bytes], np.ndarray]:
    """The words of a block and how often it has them: a word's ``n`` places are dealt evenly over all blocks, in whatever task it is."""
    some = np.flatnonzero(n)
    turn = np.array([zlib.crc32(words[k]) for k in some.tolist()], np.int64)
    own = (n[some].astype(np.int64) + (turn + block) % ROUNDS) // ROUNDS
    return [words[k] for k in some[own > 0].tolist()], own[own > 0]


def fit(words: list[bytes], code: Code, table: np.ndarray, sure: np.ndarray) -> list[np.ndarray]:
    """The weights for some words, each counted once."""
    n = Counter(words)
    return online(lambda weights, block: statistics(*in_block(list(n), np.array(list(n.values())), block), code, table, sure, weights))


def _fit_sums(base, weights: list[np.ndarray], block: int):
    """The statistics of a task's words in one block, by their counts in the texts of the fit."""

    def run(batches):
        total = np.zeros((len(SETS), CHOICES, 1 + len(ORDERS) + len(ORDERS) ** 2))
        for row in _rows(batches):
            n, words = _unpacked(row["fit"].as_py(), np.uint64), zstandard.decompress(row["words"].as_py()).split(b" ")
            total += statistics(*in_block(words, n, block), *base.value, weights)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return run


def fit_all(words: DataFrame, base) -> list[np.ndarray]:
    """The weights for all words of the fit's texts; each task sends one small table of sums a block."""

    def sums(weights, block):
        rows = words.select("words", "fit").mapInArrow(_fit_sums(base, weights, block), "sums binary").collect()
        return sum((np.frombuffer(r.sums).reshape(len(SETS), CHOICES, -1) for r in rows), np.zeros((len(SETS), CHOICES, 1 + len(ORDERS) + len(ORDERS) ** 2)))

    return online(sums)


def _table(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The bit predictors (scaled log odds, how often seen) of all slots, from tasks' counts."""
    table, sure = np.zeros(SLOTS, np.int8), np.zeros(SLOTS, np.int8)
    for r in blocks.groupBy("block").applyInArrow(_merge, "block int, q binary, sure binary").collect():
        own = slice(r.block * BLOCK, (r.block + 1) * BLOCK)
        table[own], sure[own] = np.frombuffer(r.q, np.int8), np.frombuffer(r.sure, np.int8)
    return table, sure


def unit_costs(words: list[bytes], code: Code, table: np.ndarray, sure: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    """Code length (natural logarithm) of each word under each weight set. A decision's two branches add up to one."""
    letters = Letters(words)
    each, lo = np.empty((len(letters.some), len(SETS)), np.float32), 0
    for odds, gate, sizes in _predictions(letters, code, table, sure):
        odds, starts = odds.astype(np.float32), np.cumsum(sizes) - sizes
        for k, (which, _) in enumerate(SETS):
            z = np.einsum("ij,ij->i", odds, np.take(weights[k], gate[which], axis=0))
            np.clip(-z, -12, 12, out=z)
            np.exp(z, out=z)
            z += 1
            np.log(z, out=z)
            each[lo : lo + len(sizes), k] = np.add.reduceat(z, starts)
        lo += len(sizes)
    return np.add.reduceat(each[letters.same], letters.first, axis=0)


def unit_decisions(words: list[bytes], code: Code, table: np.ndarray, sure: np.ndarray, weights: list[np.ndarray]):
    """(code length of each word's sure decisions, inputs of its open ones word by word, how many are open).

    Open are the decisions to which the even mixture of the sets gives less log odds than OPEN, whichever branch is taken. Their inputs are
    the orders' log odds and those of each set, as multiples of 1 / FRACTION.
    """
    letters = Letters(words)
    n, lo = len(letters.some), 0
    each, opens, kept = np.zeros(n, np.float32), np.zeros(n, np.int64), [np.zeros((0, INPUTS), np.int16)]
    for odds, gate, sizes in _predictions(letters, code, table, sure):
        x, starts = np.empty((len(odds), INPUTS), np.float32), np.cumsum(sizes) - sizes
        x[:, : len(ORDERS)] = odds
        for k, (which, _) in enumerate(SETS):
            np.einsum("ij,ij->i", x[:, : len(ORDERS)], np.take(weights[k], gate[which], axis=0), out=x[:, len(ORDERS) + k])
        z = x[:, len(ORDERS) :].mean(1)
        is_open = np.abs(z) < OPEN
        z[is_open] = np.inf
        each[lo : lo + len(sizes)] = np.add.reduceat(np.log1p(np.exp(-np.maximum(z, -LIMIT))), starts)
        opens[lo : lo + len(sizes)] = np.add.reduceat(is_open, starts, dtype=np.int64)
        x = x[is_open]
        x *= np.where(np.arange(INPUTS) < len(ORDERS), FRACTION / SCALE, FRACTION).astype(np.float32)
        kept.append(np.rint(np.clip(x, -LIMIT * FRACTION, LIMIT * FRACTION, out=x), out=x).astype(np.int16))
        lo += len(sizes)
    of = opens[letters.same]
    at = np.repeat((np.cumsum(opens) - opens)[letters.same] - (np.cumsum(of) - of), of) + np.arange(of.sum())
    return np.add.reduceat(each[letters.same], letters.first)[:, None], _rows_at(np.concatenate(kept), at), np.add.reduceat(of, letters.first)


def _rows_at(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Some rows of INPUTS numbers of 16 bits, each taken as one value."""
    return np.take(rows.view(np.complex128)[:, 0], at).view(np.int16).reshape(-1, INPUTS)


class Mixers:
    """The last weights of each text for its open decisions, from the orders' and the sets' log odds.

    They start as the even mixture of the sets and follow, after each block, the gradient of the code length.
    """

    def __init__(self, rows: np.ndarray, opens: np.ndarray, rate: float):
        self.rows, self.opens, self.rate = rows, opens, rate
        self.start = np.cumsum(opens) - opens

    def begin(self, texts: int) -> None:
        self.weights = np.zeros((texts, INPUTS), np.float32)
        self.weights[:, len(ORDERS) :] = 1 / len(SETS)
        self.seen = np.full((texts, INPUTS), 1e-3, np.float32)

    def costs(self, units: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Code length of each token's open decisions; tokens are text by text, ``ends`` where each text's end."""
        n = self.opens[units]
        last = np.cumsum(n)
        x = _rows_at(self.rows, np.repeat(self.start[units] - (last - n), n) + np.arange(n.sum())).astype(np.float32)
        self.cuts = np.concatenate([[0], last])[np.concatenate([[0], ends])].tolist()
        z = np.empty(len(x), np.float32)
        for k, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            np.matmul(x[a:b], self.weights[k], out=z[a:b])
        z *= np.float32(-1 / FRACTION)
        np.clip(z, -LIMIT, LIMIT, out=z)
        np.exp(z, out=z)
        self.x, self.n, self.miss = x, n, z / (1 + z)
        total = np.zeros(len(units))
        some = n > 0
        if some.any():
            total[some] = np.add.reduceat(np.log1p(z, out=z), (last - n)[some])
        return total[:, None]

    def update(self, rest: np.ndarray) -> None:
        """A step along the gradient, in which a token counts by the share ``rest`` that its letters have in its probability."""
        self.miss *= np.repeat(rest.astype(np.float32), self.n)
        slope = np.stack([self.miss[a:b] @ self.x[a:b] for a, b in zip(self.cuts, self.cuts[1:])]) / np.float32(FRACTION)
        self.seen[: len(slope)] += slope * slope
        self.weights[: len(slope)] += self.rate * slope / np.sqrt(self.seen[: len(slope)])


def _within(row: np.ndarray, key: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """(how often a token's key occurs in its text, how often before it)."""
    size, before = np.ones(len(key), np.int32), np.zeros(len(key), np.int32)
    some = np.flatnonzero(np.bincount(key, minlength=kinds)[key] > 1)
    code = row[some].astype(np.int64) * kinds + key[some]
    order = np.argsort(code, kind="stable")
    code = code[order]
    cuts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    n = np.diff(np.concatenate([cuts, [len(code)]]))
    size[some[order]] = np.repeat(n, n)
    before[some[order]] = np.arange(len(code)) - np.repeat(cuts, n)
    return size, before


def _context(order: int, count: np.ndarray, found: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(count of the context before each token, its gate): ``count`` and ``found`` are of the tokens themselves."""
    c, f = (np.concatenate([[0], x[:-1]]) for x in (count, found > 0))
    c[first] = 0
    f[first] = 0
    level = np.minimum(np.log2(np.maximum(c, 1)).astype(np.int8), GATES[order] // 2 - 1)
    return c, np.where(c > 0, level * 2 + f, GATES[order]).astype(np.int8)


def mix(cost: np.ndarray, unit: np.ndarray, off: np.ndarray, contexts: dict[int, tuple[np.ndarray, np.ndarray]], mixers: Mixers | None = None) -> np.ndarray:
    """Natural log probability of each text; TEXTS texts run side by side, and their states are updated after each block of STEP tokens.

    ``cost`` is by unit and weight set; ``contexts`` has for each length a word's log probability by it, and the gate; ``mixers``
    add the code length of the decisions that ``cost`` leaves open.
    """
    d, k = len(off) - 1, cost.shape[1]
    length, total = np.diff(off), np.zeros(d)
    sets = np.full((d, k), -np.log(k))
    state = {o: (np.full((d, GATES[o] + 1), PRIOR[0]), np.full((d, GATES[o] + 1), PRIOR[1])) for o in contexts}
    for found, _ in state.values():
        found[:, -1] = 0
    order = np.argsort(-length, kind="stable")
    for some, lo in ((x, lo) for x in np.split(order, range(TEXTS, d, TEXTS)) for lo in range(0, int(length[x].max(initial=0)), STEP)):
        live = some[: int(np.searchsorted(-length[some], -lo))]
        n = np.minimum(length[live] - lo, STEP)
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        at = np.arange(n.sum()) + np.repeat(off[live] + lo - starts, n)
        of = np.repeat(live, n)
        c = cost[unit[at]].astype(float)
        if mixers:
            if not lo:
                mixers.begin(len(live))
            c += mixers.costs(unit[at], np.cumsum(n))
        m = sets[of] - c
        top = m.max(1)
        p = top + np.log(np.exp(m - top[:, None]).sum(1))
        rest = np.ones(len(at))
        shares = {}
        for name, (context, gate) in contexts.items():
            found, seen = state[name]
            g = gate[at]
            part = found[of, g] / seen[of, g]
            with np.errstate(divide="ignore"):
                a = np.log(part) + context[at]
            p_new = np.logaddexp(a, np.log1p(-part) + p)
            shares[name] = np.exp(a - p_new), g
            p = p_new
        for name in reversed(contexts):
            found, seen = state[name]
            share, g = shares[name]
            code = of * found.shape[1] + g
            real = g < found.shape[1] - 1
            np.add.at(found.ravel(), code[real], (rest * share)[real])
            np.add.at(seen.ravel(), code[real], rest[real])
            rest = rest * (1 - share)
        if mixers:
            mixers.update(rest)
        total[live] += np.add.reduceat(p, starts)
        s = sets[live] - np.add.reduceat(rest[:, None] * c, starts)
        s -= s.max(1)[:, None]
        s = np.exp(s)
        s /= s.sum(1)[:, None]
        sets[live] = np.log((1 - SHARE) * s + SHARE / k)
    return total


def _log(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(x)


def _score(model, rate: float, bits: int, groups: int, n_train: int, n_distinct: int):
    def run(key, docs: pa.Table, known: pa.Table) -> pa.Table:
        s = _Slice({n: docs[n][0] for n in docs.column_names})
        mixers = None
        if rate:
            cost, *open_ = unit_decisions(s.words, *model.value)
            mixers = Mixers(*open_, rate)
        else:
            cost = unit_costs(s.words, *model.value)
        cost = np.rint(cost * FRACTION) / np.float32(FRACTION)
        packs = dict(zip(*(known[c].to_pylist() for c in ("group", "totals"))))
        row, train = s.of_tokens(np.arange(len(s.counts), dtype=np.int32)), s.of_tokens(s.train)
        per = lambda x: np.add.reduceat(x, s.off[:-1])  # noqa: E731  every text has its end
        counts = []
        for order, keys in enumerate(s.grams(bits)):
            # Words are sorted as such, not token by token.
            distinct, own = np.unique(keys if order else _word_key(s.hashes()), return_inverse=True)
            own = own if order else own[s.unit]
            parts = [packs[g] for g in range(order * groups, (order + 1) * groups) if g in packs]
            total = np.concatenate([_unpacked(t, np.uint64) for t in parts]).astype(np.int64)[own]
            size, before = _within(row, own, len(distinct))
            counts.append(total - np.where(train, size, 0) + before)
            if not order:
                known_words, base = per((total > 0).astype(np.int64)), per(np.log10((total + 1) / (n_train + n_distinct + 1)))
        first = s.off[:-1]
        # All words of other training texts, and of this text so far.
        all_ = n_train - np.where(train, s.of_tokens(s.counts), 0) + np.arange(len(row)) - s.of_tokens(first)
        gate = np.concatenate([[0], counts[0][:-1] > 0])
        gate[first] = 0
        contexts = {1: (_log(counts[0]) - _log(np.maximum(all_, 1)), np.where(all_ > 0, gate, GATES[1]).astype(np.int8))}
        for k in (1, 2):
            c, gate = _context(k + 1, counts[k - 1], counts[k], first)
            contexts[k + 1] = np.where(c > 0, _log(counts[k]) - _log(np.maximum(c, 1)), -np.inf), gate
        del row, train, counts, all_, total, own, size, before
        score = mix(cost, s.unit, s.off, contexts, mixers) / np.log(10)
        length = per(np.array([len(w) + 1 for w in s.words])[s.unit]) - 1
        cols = {
            "doc_id": s.ids,
            "held_out": pa.array(~s.train),
            "n_tokens": pa.array(s.counts, pa.int64()),
            "n_known": pa.array(known_words),
            "train_tokens": pa.array([n_train] * len(s.counts), pa.int64()),
            "base_score": pa.array(base),
            "score": pa.array(score),
            "bits_per_byte": pa.array(-score * np.log2(10) / length),
        }
        return pa.table(cols)

    return run


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.0) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    All is learned from rows whose crc32(doc_id as text) modulo 7 is not 2; held_out marks the others. A-Z is
    lower-cased; tokens are the words and one end. ``base_score`` sums log10((c + 1) / (N + V + 1)); ``score``
    is the mixing model's log10 probability of the words and the end, where a training row's own words are left out of
    the counts of words, pairs and triples. A null or empty text is an end alone. Rows without an id are held in by the
    checksum of the empty text; repeated rows repeat, and count again in training. An empty table gives no rows. Other
    columns are ignored. ``rate`` is how fast the weights of bits go on learning in each text; at 0 they stay as the training texts left
    them. ``bits_per_byte`` divides by the bytes of the words, a space after each, and the end.
    """
    spark = docs.sparkSession
    d = T.pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long")).withColumn("train", T.crc_mod(F.col("id"), 7) != 2)
    texts = materialize(d.mapInArrow(_slices, _SHAPE), "units")
    counts = np.ones(256, np.int64)
    for r in texts.select(F.posexplode("bytes").alias("byte", "n")).groupBy("byte").agg(F.sum("n").alias("n")).collect():
        counts[r.byte] += r.n
    parts = texts.select("chunk", "ids", "train", "counts", "units", "words")
    size = int(counts.sum())
    # The range of keys grows with the corpus, so that two keys share a hash as rarely at every size.
    bits, groups = min(62, max(34, size.bit_length() + 9)), -(-size // GROUP)
    packed = parts.mapInArrow(_words(groups, FIT_SHARE), "group int, keys binary, words binary, n binary, fit binary").groupBy("group")
    words = materialize(packed.applyInArrow(_distinct, "group int, keys binary, words binary, n binary, fit binary, tokens long, distinct long"), "words")
    n_train, n_distinct = (x or 0 for x in words.agg(F.sum("tokens"), F.sum("distinct")).first())
    code = Code(counts)
    # Each task sends a table of its own, so fewer tasks send less.
    tasks = max(spark.sparkContext.defaultParallelism, groups // 16)
    few, sent = words.coalesce(tasks), spark.sparkContext.broadcast(code)
    shape, path = "block int, at binary, n binary", scratch_path(spark, "slots")
    for x in ("rest", "fit"):
        few.select("words", "n", "fit").mapInArrow(_count(sent, x), shape).write.parquet(f"{path}/texts={x}")
    slots = spark.read.schema(f"{shape}, texts string").parquet(path)
    weights = fit_all(few, spark.sparkContext.broadcast((code, *_table(slots.where("texts = 'rest'")))))
    model = spark.sparkContext.broadcast((code, *_table(slots), weights))
    # The tables are in the model: their parts need no disk beside the exchanges that follow.
    drop_scratch(spark, path)
    found = parts.mapInArrow(_keys(bits, groups), "group int, chunk long, keys binary, n binary").groupBy("group")
    known = found.cogroup(words.select("group", "keys", "n").groupBy("group")).applyInArrow(_reply(groups), _REPLY)
    return parts.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_score(model, rate, bits, groups, n_train, n_distinct), RESULT)


def op6_lm_mixing(spark, sf_dir: str) -> DataFrame:
    return score(T.documents(spark, sf_dir, "doc_id", "text"), rate=RATE)
