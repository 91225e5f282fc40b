"""Vectorised tokenising and hashing of Arrow text columns, shared by the operators.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased. A word's 64-bit hash is a
polynomial over a table of random values for each byte, finished by a mixing step; shingles mix
the hashes of their words. All of it runs in numpy over the column's bytes, a few MB at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

U = np.uint64
_RNG = np.random.default_rng(20240607)
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_MULT = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_MULT), -1, 2**64))
#: Odd multipliers for the words of a shingle.
_PLACES = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
UPPER_LETTERS, LOWER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_powers: dict[str, np.ndarray] = {}


def documents(spark, sf_dir: str, *columns: str):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def pick(df, **columns: str):
    """Only the named columns, under fixed names, whatever else the table holds: name=column."""
    return df.select(*[df[c].alias(k) for k, c in columns.items()])


#: A key of more rows than this share of all is dealt out over so many tasks.
HOT_SHARE, SALTS = 0.001, 32


def join_unique(rows, unique, key: str, deal: str, how: str = "left"):
    """``rows`` joined with at most one row of ``unique`` for each ``key``.

    The rows of a key that a great many have are dealt out by ``deal``, and the key's one row goes to each of those parts.
    At most 1 / HOT_SHARE keys can be so common, so they are broadcast. ``rows`` is read twice.
    """
    n = rows.count()
    common = rows.groupBy(key).agg(F.count("*").alias("n_")).where(F.col("n_") > max(SALTS, HOT_SHARE * n))
    hot = F.broadcast(common.select(key, F.lit(True).alias("hot_")))
    zero, last = F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")
    left = rows.join(hot, key, "left").withColumn("salt_", F.when(F.col("hot_"), F.pmod(F.xxhash64(deal), F.lit(SALTS))).otherwise(zero))
    parts = F.explode(F.when(F.col("hot_"), F.sequence(zero, last)).otherwise(F.array(zero))).alias("salt_")
    right = unique.join(hot, key, "left").select(*unique.columns, parts)
    return left.drop("hot_").join(right, [key, "salt_"], how).drop("salt_")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher that spreads all bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(kind: str, n: int) -> np.ndarray:
    held = _powers.get(kind)
    if held is None or len(held) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        base = np.full(size, _MULT if kind == "up" else _INVERSE, np.uint64)
        base[0] = 1
        held = _powers[kind] = np.cumprod(base)
    return held[:n]


class Words:
    """The words of one slice of a text column: ``starts``/``ends`` into ``data``, ``first`` word of each row."""

    def __init__(self, column: pa.Array, space: np.ndarray = SPACE):
        column = column.fill_null("")
        column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
        _, off, buf = column.buffers()
        off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        self.rows, self.offsets, self.data = len(column), off - off[0], LOWER[raw]
        n = len(raw)
        inside = ~space[raw]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = True, ~inside[:-1]
            after[-1], after[:-1] = True, ~inside[1:]
        self.starts = np.flatnonzero(inside & (before | edge[:-1]))
        self.ends = np.flatnonzero(inside & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self._held: np.ndarray | None = None

    def _sums(self) -> np.ndarray:
        """Prefix sums of the polynomial's terms."""
        if self._held is None:
            self._held = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_TABLE[self.data] * _power("up", max(1, len(self.data)))[: len(self.data)], out=self._held[1:])
        return self._held

    def hashes(self) -> np.ndarray:
        total = self._sums()
        h = (total[self.ends] - total[self.starts]) * _power("down", len(total))[self.starts]
        return mix(h ^ ((self.ends - self.starts).astype(np.uint64) * _MULT))

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the first ``size`` bytes, which words are longer than that)."""
        total, long = self._sums(), self.ends - self.starts > size
        s = self.starts[long]
        return mix(((total[s + size] - total[s]) * _power("down", len(total))[s]) ^ U(size * int(_PLACES[-1]) % 2**64)), long

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def slices(column: pa.Array | pa.ChunkedArray, most: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(first row, part of the column) with about ``most`` bytes each; a longer text is a part of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.asarray(pc.fill_null(pc.binary_length(column), 0)).cumsum()
    at, base = 0, 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(size, base + most, "right")))
        yield at, column.slice(at, to - at)
        at, base = to, int(size[to - 1])


def shingle(words: np.ndarray, counts: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's word windows in order, and how many each row has; a row with fewer words has its whole sequence as one."""
    n = len(words)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    full = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        full += words[k : k + len(full)] * _PLACES[k]
    full = mix(full)
    starts = np.concatenate([[0], np.cumsum(made)])
    total = int(starts[-1])
    at = np.arange(total) - np.repeat(starts[:-1], made) + np.repeat(first[:-1], made)
    out = np.zeros(total, np.uint64)
    long = np.repeat(counts >= width, made)
    out[long] = full[at[long]]
    for row in np.flatnonzero((counts > 0) & (counts < width)):
        w = words[first[row] : first[row + 1]]
        out[starts[row]] = mix((w * _PLACES[: len(w)]).sum(dtype=np.uint64, keepdims=True) ^ (np.array([len(w)], np.uint64) * _MULT))[0]
    return out, starts


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) by slices of the column."""
    for at, part in slices(column):
        w = Words(part)
        s, starts = shingle(w.hashes(), w.counts, w.first, width)
        yield at, [np.unique(s[starts[i] : starts[i + 1]]) for i in range(w.rows)]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column of numpy arrays."""
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts])]) if parts else np.zeros(1)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat, kind))


#: SQL (DuckDB) for the lower-cased words of a text.
SQL_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER_LETTERS}', '{LOWER_LETTERS}'), '[^\\x20\\x09-\\x0D]+')"


def crc_mod(doc_id, n: int):
    """crc32 of the id as decimal text, modulo n (an absent id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
