"""Toxicity of restored text: a noisy channel undone by Viterbi decoding, then a learned score.

Writers hide words by look-alike signs (leetspeak), by spacing single letters and by repeating letters.
Suspicious places of a text become lattices: every sign offers the letters it may stand for, a run of one letter
offers itself once or twice, and a separator between single letters vanishes or is a word break. The path that a character
model of the corpus (trigrams over all documents, backed off to bigrams and letters) finds likeliest is the restored text.

Words of the restored text, and their beginnings, then meet a lexicon learned from labelled documents:
each entry's weight is the lower end of its log odds between toxic and other documents. Evidence sums over
a text's distinct entries, and a logistic curve fitted on labelled documents that the lexicon did not see
turns it into a score.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm import text as T

#: The lexicon and the curve are fitted on at most so many labelled rows, chosen by the hash of their ids.
MAX_LABELS = 200_000
LEAST_DOCS, LEAST_WEIGHT, PREFIXES = 4, 1.0, (4, 5, 6, 7, 8)
# The letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l"}
_SIGNS = "".join(map(re.escape, LEET))
_LETTER = "a-zà-öø-ÿ"
#: Letters and bytes beyond ASCII form words here, all else separates.
_APART = np.ones(256, bool)
_APART[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_CLASS = np.full(256, 27, np.int64)
_CLASS[_APART] = 0
_CLASS[97:123] = np.arange(1, 27)
_EDGE = "0-9@$€£"
#: A run of letters and signs. Marks that also end sentences belong to a disguised word only inside; such a word has three places or more, of any number.
_RUN = re.compile(rf"[{_LETTER}{_SIGNS}]+", re.I)
_ENDING = "".join(c for c in LEET if c not in "0123456789@$€£")
_PLAIN = re.compile(rf"[{_LETTER}]+|[^{_LETTER}]+", re.I)
_SPACED = re.compile(rf"(?<![{_LETTER}0-9])[{_LETTER}{_SIGNS}](?:([ ._*~-])[{_LETTER}{_SIGNS}](?:\1[{_LETTER}{_SIGNS}]){{2,}})(?![{_LETTER}0-9])", re.I)
_REPEAT = re.compile(rf"[{_LETTER}]*([{_LETTER}])\1\1[{_LETTER}]*", re.I)
#: What every match of the three patterns holds: a run of letters and signs has its last sign before a letter, or ends in signs.
_HINT = re.compile(rf"[{_SIGNS}][{_LETTER}]|[{_LETTER}][{_SIGNS}]*[{_EDGE}]|(?<![{_LETTER}])[{_LETTER}{_SIGNS}][ ._*~-][{_LETTER}{_SIGNS}][ ._*~-][{_LETTER}{_SIGNS}][ ._*~-]|([{_LETTER}])\1\1", re.I)


class CharModel:
    """Log probabilities of a letter after two others, from trigram counts (28 classes: separator, a-z, other)."""

    def __init__(self, counts: np.ndarray):
        tri = counts.reshape(28, 28, 28).astype(float)
        bi, uni = tri.sum(0), tri.sum((0, 1))
        p1 = (uni + 1) / (uni.sum() + 28)
        p2 = (bi + 8 * p1) / (bi.sum(1, keepdims=True) + 8)
        p3 = (tri + 4 * p2) / (tri.sum(2, keepdims=True) + 4)
        self.log = np.log(p3).tolist()
        self.held: dict[str, str] = {}

    @staticmethod
    def code(c: str) -> int:
        return ord(c) - 96 if "a" <= c <= "z" else 0 if c == " " else 27

    def decode(self, seen: str, spaced: bool = False) -> str:
        if len(seen) > 64:
            return self._decode(seen, spaced)
        if (seen, spaced) not in self.held:
            if len(self.held) > 200_000:
                self.held.clear()
            self.held[seen, spaced] = self._decode(seen, spaced)
        return self.held[seen, spaced]

    def _decode(self, seen: str, spaced: bool) -> str:
        """The likeliest letters for one word as seen; ``spaced``: for single letters, a separator (left out here) between any two."""
        # A path's letters are a chain back to its beginning.
        paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for at, (c, run) in enumerate(itertools.groupby(seen)):
            n = len(list(run))
            options = [(x * k, -0.7 * (n > 2)) for x in LEET.get(c, c) for k in ((1,) if n == 1 else (1, 2))]
            if spaced:
                options += [(x * i + " " + x * j, -0.7 * (n > i + j)) for x in LEET.get(c, c) for i in (1, 2) for j in (1, 2) if i + j <= n]
                options += [(" " + letters, cost) for letters, cost in options] if at else []
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, text) in paths.items():
                for letters, cost in options:
                    s, p, q = score + cost, a, b
                    for x in letters:
                        k = self.code(x)
                        s += self.log[p][q][k]
                        p, q = q, k
                    if (p, q) not in new or s > new[p, q][0]:
                        new[p, q] = (s, (text, letters))
            paths = new
        chain = max(((s + self.log[a][b][0], t) for (a, b), (s, t) in paths.items()), key=lambda x: x[0])[1]
        parts: list[str] = []
        while chain:
            chain, letters = chain
            parts.append(letters)
        return "".join(reversed(parts))

    def _run(self, m: re.Match) -> str:
        run = m[0]
        word = run.strip(_ENDING)
        if len(word) < 3 or _PLAIN.fullmatch(word):
            return run
        at = run.index(word)
        return run[:at] + self.decode(word.lower()) + run[at + len(word) :]

    def restore(self, text: str) -> str:
        """The text with every suspicious place decoded; a text without one is returned as it is."""
        if not _HINT.search(text):
            return text
        text = _SPACED.sub(lambda m: self.decode(m[0][::2].lower(), True), text)
        text = _RUN.sub(self._run, text)
        return _REPEAT.sub(lambda m: self.decode(m[0].lower()), text)


def _count_trigrams(batches):
    for b in batches:
        total = np.zeros(28**3, np.int64)
        for _, part in T.slices(b["text"]):
            c = _CLASS[T.Words(part).data]
            c = np.concatenate([[0, 0], c, [0, 0]])
            total += np.bincount(c[:-2] * 784 + c[1:-1] * 28 + c[2:], minlength=28**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])


def char_model(texts: DataFrame) -> CharModel:
    """Counts over all documents; at most 28 ** 3 of them reach the driver."""
    counts = np.zeros(28**3, np.int64)
    for r in texts.select("text").mapInArrow(_count_trigrams, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[r["at"]] = r.n
    return CharModel(counts)


def _features(part: pa.Array, model: CharModel):
    """(hash, row) of the distinct words and word beginnings of each restored text, and words a row."""
    restored = pa.array([model.restore(t or "") for t in part.to_pylist()], pa.large_string())
    w = T.Words(restored, _APART)
    row = np.repeat(np.arange(w.rows), w.counts)
    hashes, rows = [w.hashes()], [row]
    for size in PREFIXES:
        h, long = w.prefixes(size)
        hashes.append(h)
        rows.append(row[long])
    return np.concatenate(hashes), np.concatenate(rows), w.counts


def _distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[first], row[first]


def _learn(model):
    def run(batches):
        for b in batches:
            for at, part in T.slices(b["text"]):
                h, row, _ = _features(part, model.value)
                h, row = _distinct(h, row)
                toxic = b["toxic"].slice(at, len(part)).to_numpy()[row].astype(bool)
                key, back = np.unique(h, return_inverse=True)
                t = np.bincount(back, weights=toxic, minlength=len(key)).astype(np.int64)
                n = np.bincount(back, minlength=len(key)) - t
                yield pa.RecordBatch.from_arrays([pa.array(T.signed(key)), pa.array(t), pa.array(n)], ["h", "t", "n"])

    return run


def _measure(model, lexicon, *carry):
    def run(batches):
        keys, weights = lexicon.value
        for b in batches:
            for at, part in T.slices(b["text"]):
                h, row, words = _features(part, model.value)
                where = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                hit = keys[where] == h if len(keys) else np.zeros(len(h), bool)
                hh, rr = _distinct(h[hit], row[hit])
                e = np.bincount(rr, weights=weights[np.searchsorted(keys, hh)], minlength=len(part)) if len(keys) else np.zeros(len(part))
                n = np.bincount(rr, minlength=len(part))
                x = np.stack([np.log1p(e), np.log1p(n), np.log1p(words)], 1)
                cols = [b[c].slice(at, len(part)) for c in carry]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.array(x[:, k]) for k in range(3)]], [*carry, "x0", "x1", "x2"])

    return run


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression with an intercept, by Newton steps."""
    x = np.concatenate([np.ones((len(x), 1)), x], 1)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labels: int = MAX_LABELS) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Labels are learned from rows whose crc32(doc_id as text) modulo 5 is not 0 (held_out marks the others); ids, languages,
    sources and labels are no inputs of a score. Null and empty texts get the score of no evidence. Of labels that
    repeat an id the larger counts; null labels count for nothing. Repeated rows repeat; without labels all score 0.5 at
    most; empty tables give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    d = T.pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long")).withColumn("fold", T.crc_mod(F.col("id"), 5))
    model = spark.sparkContext.broadcast(char_model(d))
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).where("label_id is not null and toxic is not null").groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(T.crc_mod(F.col("label_id"), 5) != 0).orderBy(F.xxhash64("label_id"), "label_id").limit(max_labels)
    seen = d.join(F.broadcast(known), d.id == known.label_id)
    counts = seen.where("fold <> 4").select("text", "toxic").mapInArrow(_learn(model), "h long, t long, n long").groupBy("h").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    toxic, other = (float(x or 0) for x in known.where(T.crc_mod(F.col("label_id"), 5) != 4).agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first())
    odds = F.log((F.col("t") + 0.5) / (F.col("n") + 0.5) * ((other + 1) / (toxic + 1)))
    low = odds - 1.64 * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("n") + 0.5))
    rows = counts.where(F.col("t") >= LEAST_DOCS).select("h", low.alias("w")).where(F.col("w") >= LEAST_WEIGHT).collect()
    keys, weights = np.array([r.h for r in rows], np.int64).view(np.uint64), np.array([r.w for r in rows])
    order = np.argsort(keys)
    lexicon = spark.sparkContext.broadcast((keys[order], weights[order]))
    shape = "x0 double, x1 double, x2 double"
    held = seen.where("fold = 4").select("text", "toxic").mapInArrow(_measure(model, lexicon, "toxic"), f"toxic int, {shape}").collect()
    w = fit_curve(np.array([[r.x0, r.x1, r.x2] for r in held]).reshape(-1, 3), np.array([r.toxic for r in held], float))
    measured = d.select("id", "fold", "text").mapInArrow(_measure(model, lexicon, "id", "fold"), f"id long, fold long, {shape}")
    z = F.lit(float(w[0])) + F.col("x0") * float(w[1]) + F.col("x1") * float(w[2]) + F.col("x2") * float(w[3])
    p = 1 / (1 + F.exp(-z))
    return measured.select(F.col("id").alias("doc_id"), (F.col("fold") == 0).alias("held_out"), p.alias("score"), (p >= 0.5).cast("int").alias("predicted"))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return score(T.documents(spark, sf_dir, "doc_id", "text"), labels)
