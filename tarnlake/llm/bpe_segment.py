"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

A piece's bytes are the leaves: leaf i holds ``rank * width + i`` of the pair that begins at i, or
infinity where there is no merge. Inner nodes hold the lesser of their children, so the root is the
leftmost merge of lowest rank. A merge changes three leaves, each updated along its path to the root
in logarithmic time, until the root is infinite. Pieces of like length run side by side, one
array operation for a step of all of them; long pieces run alone.

The vocabulary and merges come from a tokenizer file (byte level); none is trained here.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm import text as T

_FAR = np.iinfo(np.int64).max
_SPACE = r"\t-\r \x85\xa0  -     　"
#: The published byte-level splitting pattern, white space spelt out.
_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_UNEVEN = re.compile(r"\s\s|\A\s|\s\Z")
#: Where letters and numbers have long been settled; beyond it the library's own splitter decides.
_SETTLED = "ԯ"


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}


class SegmentBpe:
    """A byte-level BPE vocabulary with its encoder and decoder."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        back = {c: b for b, c in letters.items()}
        vocab = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.made = np.array([vocab["".join(p)] for p in pairs], np.int64)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = np.concatenate([key[order], [_FAR]]), np.concatenate([order, [0]])
        self.rank_of = {int(k): r for r, k in reversed(list(enumerate(key)))}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.single = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        self.back, self.flat = back, None
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs merge, and their ranks."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return self.keys[at] == key, self.ranks[at]

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece, whatever its length."""
        out: list = [None] * len(pieces)
        size = np.array([len(p) for p in pieces])
        width = 1 << np.ceil(np.log2(np.maximum(size, 2))).astype(int)
        for w in np.unique(width):
            own = np.flatnonzero(width == w)
            if w > 512:
                for i in own:
                    out[i] = self._alone(pieces[i])
                continue
            step = max(1, (1 << 19) // int(w))
            for lo in range(0, len(own), step):
                part = own[lo : lo + step]
                for i, ids in zip(part, self._beside([pieces[i] for i in part], int(w))):
                    out[i] = ids
        return out

    def _beside(self, pieces: list[bytes], w: int) -> list[list[int]]:
        n = len(pieces)
        size = np.array([len(p) for p in pieces])
        sym = np.full((n, w + 1), -1, np.int64)
        raw = np.frombuffer(b"".join(p.ljust(w, b"\0") for p in pieces), np.uint8).reshape(n, w)
        sym[:, :w] = np.where(np.arange(w) < size[:, None], self.single[raw], -1)
        after = np.minimum(np.arange(1, w + 2), w)[None].repeat(n, 0)
        before = np.maximum(np.arange(-1, w), 0)[None].repeat(n, 0)
        tree = np.full((n, 2 * w), _FAR)
        r, c = np.nonzero(np.arange(w) < size[:, None] - 1)
        hit, rank = self.lookup(sym[r, c], sym[r, c + 1])
        tree[r[hit], w + c[hit]] = rank[hit] * w + c[hit]
        half = w
        while half > 1:
            half >>= 1
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
        live = np.flatnonzero(tree[:, 1] < _FAR)
        while len(live):
            at = tree[live, 1] % w
            rank = tree[live, 1] // w
            gone = after[live, at]
            then = after[live, gone]
            sym[live, at] = self.made[rank]
            sym[live, gone] = -1
            after[live, at] = then
            before[live, then] = at
            prior = before[live, at]
            tree[live, w + gone] = _FAR
            for one, two in ((at, then), (prior, at)):
                a, b = sym[live, one], sym[live, two]
                hit, rank = self.lookup(a, b)
                hit &= (a >= 0) & (b >= 0)
                # At the left end there is no earlier pair: its leaf stays.
                own = one != two
                tree[live[own], w + one[own]] = np.where(hit, rank * w + one, _FAR)[own]
            for leaf in (gone, at, prior):
                node = w + leaf
                while node[0] > 1:
                    node = node >> 1
                    tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, 2 * node + 1])
            live = live[tree[live, 1] < _FAR]
        sym = sym[:, :w]
        keep = sym >= 0
        flat, ends = sym[keep].tolist(), np.cumsum(keep.sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _alone(self, piece: bytes) -> list[int]:
        n = len(piece)
        w = 1 << (n - 1).bit_length()
        sym = [int(x) for x in self.single[np.frombuffer(piece, np.uint8)]]
        after, before = list(range(1, n + 1)), list(range(-1, n))
        tree = [_FAR] * (2 * w)
        rank_of, made = self.rank_of, self.made

        def leaf(i: int) -> int:
            j = after[i]
            r = rank_of.get(sym[i] << 32 | sym[j]) if j < n else None
            return _FAR if r is None else r * w + i

        def put(i: int, v: int) -> None:
            k = w + i
            tree[k] = v
            while k > 1:
                k >>= 1
                tree[k] = min(tree[2 * k], tree[2 * k + 1])

        tree[w : w + n] = [leaf(i) for i in range(n)]
        for k in range(w - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        while tree[1] < _FAR:
            rank, i = divmod(tree[1], w)
            j = after[i]
            sym[i], sym[j] = int(made[rank]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            put(j, _FAR)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        return [s for s in sym if s >= 0]

    def split(self, chunk: str) -> list[bytes]:
        if max(chunk, default="") > _SETTLED:
            return [bytes(self.back[c] for c in p) for p, _ in self.splitter.pre_tokenize_str(chunk)]
        return [p.encode() for p in _PIECES.findall(chunk)]

    def chunks(self, text: str) -> list[str]:
        """Parts of a text that are encoded one by one: cuts fall at special tokens, and before a space between two words."""
        if self.cut and any(s in text for s in self.special):
            return [c for part in self.cut.split(text) if part for c in ([part] if part in self.special else self._even(part))]
        return self._even(text)

    @staticmethod
    def _even(text: str) -> list[str]:
        if not text:
            return []
        if _UNEVEN.search(text):
            return [text] if len(text) < 65 else re.split(r"(?<=\S)(?= \S)", text)
        head, *rest = text.split(" ")
        return [head, *(" " + x for x in rest)]

    def decode(self, ids) -> str:
        return b"".join(self.bytes_of[int(i)] for i in ids).decode("utf-8", "replace")

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of many rows' ids, laid end to end: so many ids for each row."""
        if self.flat is None:
            size = np.zeros(max(self.bytes_of) + 1, np.int64)
            for i, b in self.bytes_of.items():
                size[i] = len(b)
            raw = b"".join(self.bytes_of[i] for i in sorted(self.bytes_of))
            self.flat, self.size, self.first = np.frombuffer(raw, np.uint8), size, np.cumsum(size) - size
        size = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        raw = self.flat[np.arange(ends[-1]) + np.repeat(self.first[ids] - ends[:-1], size)].tobytes()
        cuts = ends[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:])]


class Cached:
    """Encodes many texts; each distinct chunk and piece once while it is held. What is held is bounded."""

    LIMIT = 150_000

    def __init__(self, bpe: SegmentBpe):
        self.bpe, self.ids, self.pieces = bpe, {}, {}
        self.number = [str(i) for i in range(max(bpe.bytes_of) + 1)]

    def forget(self) -> None:
        """Give the memory back; a worker process outlives its tasks."""
        self.ids, self.pieces = {}, {}

    def learn(self, chunks: set[str]) -> None:
        if len(self.ids) > self.LIMIT:
            # What these texts hold is kept, and with it what is frequent.
            self.ids = {c: self.ids[c] for c in chunks if c in self.ids}
            self.pieces = {}
        bpe, cut, alone = self.bpe, {}, []
        for c in chunks - self.ids.keys():
            if c in bpe.special:
                self.ids[c] = str(bpe.special[c])
            elif (c[1:].isalpha() and c[0] == " " or c.isalpha()) and max(c) <= _SETTLED:
                alone.append(c)  # a word is one piece
            else:
                cut[c] = bpe.split(c)
        new = list({p for ps in cut.values() for p in ps} - self.pieces.keys())
        number = self.number.__getitem__
        made = [",".join(map(number, x)) for x in bpe.encode_pieces([c.encode() for c in alone] + new)]
        self.ids.update(zip(alone, made))
        self.pieces.update(zip(new, made[len(alone) :]))
        for c, ps in cut.items():
            self.ids[c] = ",".join([self.pieces[p] for p in ps])

    def encode(self, texts: list[str]) -> list[str]:
        """Decimal ids of each, joined by commas."""
        cut = [self.bpe.chunks(t) for t in texts]
        self.learn(set().union(*cut))
        ids = self.ids.__getitem__
        return [",".join(map(ids, c)) for c in cut]

    def round_trip(self, texts: list[str]) -> list[tuple[str, int, str]]:
        """(ids joined by commas, how many, the text that these ids decode to) of each."""
        ids = self.encode(texts)
        counts = [i.count(",") + 1 if i else 0 for i in ids]
        flat = np.fromstring(",".join(filter(None, ids)), np.int64, sep=",") if any(counts) else np.zeros(0, np.int64)
        return list(zip(ids, counts, self.bpe.decode_all(flat, np.array(counts, np.int64))))


_held: dict[str, Cached] = {}


def cached(path: str) -> Cached:
    """One for each worker process and file."""
    if path not in _held:
        _held[path] = Cached(SegmentBpe(path))
    return _held[path]


def _digest(path: str):
    def run(batches):
        enc = cached(path)
        for b in batches:
            for at, part in T.slices(b["text"], 1 << 20):
                done = enc.round_trip([x or "" for x in part.to_pylist()])
                n = [k for _, k, _ in done]
                ids = [hashlib.sha256(i.encode()).hexdigest() for i, _, _ in done]
                back = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for _, _, t in done]
                yield pa.RecordBatch.from_arrays([b["id"].slice(at, len(n)), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        enc.forget()

    return run


def _encode(path: str):
    def run(batches):
        enc = cached(path)
        for b in batches:
            for at, part in T.slices(b["text"], 1 << 20):
                done = [np.array(i.split(","), np.int32) if i else np.zeros(0, np.int32) for i in enc.encode([x or "" for x in part.to_pylist()])]
                yield pa.RecordBatch.from_arrays([b["id"].slice(at, len(done)), T.lists(done, pa.int32())], ["doc_id", "ids"])
        enc.forget()

    return run


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ids (array<int>) of each row's whole text; a null text has none, an empty table gives no rows."""
    return T.pick(df, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long")).mapInArrow(_encode(path), "doc_id long, ids array<int>")


def decode(df: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """The table with a further column ``decoded``: the text of each row's ids; null ids give a null."""

    def texts(ids: pd.Series) -> pd.Series:
        bpe = cached(path).bpe
        return pd.Series([None if i is None else bpe.decode(i) for i in ids])

    return df.withColumn("decoded", F.pandas_udf(texts, "string")(ids_col))


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256 and decoded_sha256 (lower-case hex).

    Special tokens that stand in a text keep their own ids. A null text counts as empty: no
    tokens, and the digests of nothing. Repeated rows repeat; other columns are ignored; an empty table gives no rows.
    """
    shape = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return T.pick(df, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long")).mapInArrow(_digest(path), shape)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    return round_trip(T.documents(spark, sf_dir, "doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))
