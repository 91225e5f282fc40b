"""Alignment of two tokenizers over the same bytes.

A slice's documents are laid end to end as bytes. Token lengths are summed up to the byte offsets at which tokens end, and one
count over all ends shows where a token of either vocabulary ends (1) and where both do (2). Both ends cut the text into groups;
an end of either closes one overlap of an A token with a B token, so every link is one counted offset. Prefix sums of these
counts, taken at the documents' ends, give each document's results.

How often an id pair is linked is a sum over the corpus. A slice numbers its distinct pairs and keeps, for each document,
their numbers and times; the distinct pairs are summed by a shuffle, and a slice gets back its own pairs' sums by a join, as
plain rows that meet the slice in a group of its own. Nothing of the pair table is broadcast, and no task holds more than a few slices.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm import text as T
from tarnlake.llm.bpe_segment import _byte_letters, tokenizer_path
from tarnlake.session import materialize

SLICE, PART, PER_FILE = 1 << 20, 256 << 10, 6
_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
_STORED = "slice long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digest array<string>, pairs array<long>, counts array<long>, sizes array<int>, steps array<int>, times array<int>"


class Tokenizers:
    """Vocabulary A (byte level) and vocabulary B (pieces with byte fallback), with the bytes of every id.

    A's texts go through the splitting of its rank form; texts with letters beyond those that are long settled go through
    the library of its own file, so that they are split by that library's tables.
    """

    def __init__(self, a_path: str, b_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(a_path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in _byte_letters().items()}
        special = {t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if i not in special}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        own = dict(zip(ranks.values(), ranks))
        self.a_bytes = pa.array([own.get(i, b"") for i in range(max(own) + 1)], pa.binary())
        self.b_bytes = pa.array([self._piece(i) for i in range(self.b.get_piece_size())], pa.binary())
        self.a_size, self.b_size = (np.array([len(x.as_py()) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # Ids as decimals with what may follow them: a comma, the end of the A side, the end of a group, nothing.
        self.decimals = pa.array([f"{i}{mark}" for i in range(max(len(self.a_size), len(self.b_size))) for mark in (",", "|", ";", "")], pa.string())

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:5], 16)])
        return b"" if self.b.is_control(i) or self.b.is_unknown(i) else self.b.id_to_piece(i).replace("▁", " ").encode()

    def encode(self, texts: list[str], settled: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A's ids, how many for each text, B's ids, how many)."""
        a = [self.a.encode_to_numpy(" " + t) if ok else np.array(self.library.encode(" " + t, add_special_tokens=False).ids, np.uint32) for t, ok in zip(texts, settled)]
        # B's ids come as Python numbers, so only those of a part of the texts are held as such.
        size = np.cumsum([len(t) for t in texts])
        cuts = np.unique(np.searchsorted(size, np.arange(0, size[-1] + PART, PART), "left")).tolist() if len(texts) else [0]
        b = [np.array(x, np.int32) for lo, hi in zip(cuts, [*cuts[1:], len(texts)]) for x in self.b.encode(texts[lo:hi], num_threads=1)]
        flat = lambda ids: (np.concatenate(ids) if ids else np.zeros(0)).astype(np.int64)
        return flat(a), np.array([len(x) for x in a], np.int64), flat(b), np.array([len(x) for x in b], np.int64)


_held: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    if (a_path, b_path) not in _held:
        _held[a_path, b_path] = Tokenizers(a_path, b_path)
    return _held[a_path, b_path]


def _settled(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Texts whose letters every table of letters has alike: up to U+053F, and the general punctuation."""
    odd = raw >= 0xD5
    odd[:-1] &= ~((raw[:-1] == 0xE2) & (raw[1:] == 0x80))
    return np.diff(np.searchsorted(np.flatnonzero(odd), off)) == 0


def _spelt(table: pa.Array, ids: np.ndarray) -> bytes:
    buf = table.take(pa.array(ids)).buffers()[2]
    return buf.to_pybytes() if buf is not None else b""


class Aligned:
    """The alignment of one slice. ``rows``: the documents that have tokens; everything else is laid end to end over them."""

    def __init__(self, tok: Tokenizers, column: pa.Array):
        column = column.fill_null("").cast(pa.large_string())
        off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        # A slice shares the buffer of its whole batch: only its own bytes are looked at.
        raw, off = np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0] : off[-1]], off - off[0]
        texts, settled = column.to_pylist(), _settled(raw, off)
        rows = np.flatnonzero(np.diff(off))
        a, na, b, nb = tok.encode([texts[i] for i in rows], [bool(settled[i]) for i in rows])
        # Texts that either side does not give back byte by byte have no tokens.
        size = np.diff(off)[rows] + 1
        own = b"".join(b" " + texts[i].encode() for i in rows)
        same = np.ones(len(rows), bool)
        for ids, n, lengths, table in ((a, na, tok.a_size, tok.a_bytes), (b, nb, tok.b_size, tok.b_bytes)):
            made = _spelt(table, ids)
            if made != own:
                ends = np.concatenate([[0], np.cumsum(lengths[ids])])[np.concatenate([[0], np.cumsum(n)])]
                at = np.concatenate([[0], np.cumsum(size)])
                same &= [made[ends[i] : ends[i + 1]] == own[at[i] : at[i + 1]] for i in range(len(rows))]
        if not same.all():
            a, b = a[np.repeat(same, na)], b[np.repeat(same, nb)]
            rows, na, nb, size = rows[same], na[same], nb[same], size[same]
        self.rows, self.a, self.b, self.na, self.nb = rows, a, b, na, nb
        self.ends = np.cumsum(size)
        length = int(self.ends[-1]) if len(rows) else 0
        a_ends, b_ends = np.cumsum(tok.a_size[a]), np.cumsum(tok.b_size[b])
        marks = np.bincount(np.concatenate([a_ends, b_ends]), minlength=length + 1).astype(np.int8)
        self.both = np.cumsum(marks == 2, dtype=np.int32)
        self.either = np.cumsum(marks > 0, dtype=np.int32)
        # A token's group: how many cuts lie before its end.
        self.a_group, self.b_group = self.both[a_ends - 1], self.both[b_ends - 1]
        offsets = np.flatnonzero(marks)
        only_a = np.zeros(length + 1, np.int8)
        only_a[a_ends] = 1
        before = np.cumsum(only_a, dtype=np.int32)[offsets] - only_a[offsets]
        self.link_a, self.link_b = before, np.arange(len(offsets)) - before + self.both[offsets - 1]
        self.tok = tok

    def by_document(self, sums: np.ndarray) -> np.ndarray:
        at = sums[self.ends] if len(self.ends) else np.zeros(0, np.int64)
        return np.diff(at, prepend=0)

    def spelt_groups(self) -> list[str]:
        """Each document's groups as ``a1,a2|b1;a3|b2,b3``."""
        n = int(self.both[-1]) if len(self.rows) else 0
        a_in, b_in = np.bincount(self.a_group, minlength=n), np.bincount(self.b_group, minlength=n)
        code = np.empty(len(self.a) + len(self.b), np.int64)
        a_to, b_to = np.cumsum(a_in), np.cumsum(b_in)
        a_at = np.arange(len(self.a)) + (b_to - b_in)[self.a_group]
        b_at = np.arange(len(self.b)) + a_to[self.b_group]
        code[a_at], code[b_at] = self.a * 4, self.b * 4
        code[a_at[a_to - 1]] += 1
        code[b_at[b_to - 1]] += 2
        last = np.cumsum(self.na + self.nb)
        code[last - 1] += 1
        out = self.tok.decimals.take(pa.array(code))
        raw, off = out.buffers()[2], np.frombuffer(out.buffers()[1], np.int32)
        raw = raw.to_pybytes() if raw is not None else b""
        return [raw[x:y].decode() for x, y in zip(off[np.concatenate([[0], last[:-1]])].tolist() if len(last) else [], off[last].tolist())]

    def columns(self, n: int) -> list[np.ndarray]:
        """n_a, n_b, n_groups and n_links of all ``n`` rows."""
        out = []
        for v in (self.na, self.nb, self.by_document(self.both), self.by_document(self.either)):
            full = np.zeros(n, np.int64)
            full[self.rows] = v
            out.append(full)
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct id pairs, their links, how many pairs each document has, steps between a document's pair numbers, its links of each)."""
        coded = pa.array(self.a[self.link_a] << 32 | self.b[self.link_b]).dictionary_encode()
        own, number = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        width = max(1, len(own))
        key = np.sort(np.repeat(np.arange(len(self.rows)), self.by_document(self.either)) * width + number)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.concatenate([first, [len(key)]]))
        row, at = np.divmod(key[first], width)
        steps = np.diff(at, prepend=0)
        new = np.flatnonzero(np.diff(row, prepend=-1))
        steps[new] = at[new]
        return own, np.bincount(number, minlength=len(own)), np.bincount(row, minlength=len(self.rows)), steps, times


def _slices(a_path: str, b_path: str):
    def run(batches):
        tok, number = tokenizers(a_path, b_path), TaskContext.get().partitionId() << 32
        for b in batches:
            for at, part in T.slices(b["text"], SLICE):
                x = Aligned(tok, part)
                digest = [""] * len(part)
                for row, g in zip(x.rows.tolist(), x.spelt_groups()):
                    digest[row] = hashlib.sha256(g.encode()).hexdigest()
                pairs, counts, size, steps, times = x.pairs()
                sizes = np.zeros(len(part), np.int32)
                sizes[x.rows] = size
                cols = [b["id"].slice(at, len(part)), *(pa.array(c) for c in x.columns(len(part))), pa.array(digest, pa.string()), pa.array(pairs, pa.int64()), pa.array(counts, pa.int64()), pa.array(sizes), pa.array(steps.astype(np.int32)), pa.array(times.astype(np.int32))]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in cols]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists], [f.split()[0] for f in _STORED.split(", ")])
                number += 1

    return run


def _spread(slices: pa.Table, held: pa.Table) -> pa.Table:
    """Each document's sums over its links, from its slice with the counts of the slice's pairs over the corpus."""
    row = {c: slices[c].combine_chunks()[0].values for c in ("ids", *_COUNTS, "digest", "sizes", "steps", "times")}
    size = row["sizes"].to_numpy().astype(np.int64)
    ends = np.cumsum(size)
    steps, times = row["steps"].to_numpy().astype(np.int64), row["times"].to_numpy().astype(np.int64)
    total = np.cumsum(steps)
    start = np.concatenate([[0], total])[ends - size]
    pair = total - np.repeat(start, size)
    count, best = np.zeros((2, held.num_rows), np.int64)
    pos = held["pos"].to_numpy()
    count[pos], best[pos] = held["n"].to_numpy(), held["best"].to_numpy()
    out = []
    for v in (best, count):
        sums = np.concatenate([[0], np.cumsum(v[pair] * times)])
        out.append(pa.array(sums[ends] - sums[ends - size]))
    return pa.table([row["ids"], *(row[c] for c in _COUNTS), *out, row["digest"]], ["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256"])


def pair_counts(stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries of slices: slice, pos, pair, n; counts of pairs: pair, n, best)."""
    entries = stored.select("slice", F.posexplode(F.arrays_zip("pairs", "counts")).alias("pos", "e")).select("slice", "pos", F.col("e.pairs").alias("pair"), F.col("e.counts").alias("n"))
    counts = materialize(entries.groupBy("pair").agg(F.sum("n").alias("n")), "align-counts")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).alias("b")
    most = counts.groupBy(b).agg(F.max("n").alias("most"))
    return entries, counts.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    A encodes a space and the text, B the text, to which it adds the space itself; neither has special tokens, and their strings in
    a text are plain text. Offsets where tokens of both end cut a text into groups. A link is a pair of an A and a B token
    whose bytes overlap. A pair of ids counts how many links hold it over all rows; n_best is how many of a row's links have a pair that counts
    as many as any of its B id, and count_sum adds up the counts of its links. groups_sha256 is of ``a1,a2|b1;a3|b2,b3``.

    A null or empty text, and one that either side's tokens do not give back byte by byte, has zeros and an empty digest. Repeated rows
    repeat and count each time; rows without an id keep a null one; an empty table gives no rows; other columns are ignored.
    """
    d = T.pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    # A file is held whole by its writer and its reader, so it has few slices, however large the input's splits are.
    stored = materialize(d.mapInArrow(_slices(a_path, b_path), _STORED), "align-slices", compression="zstd", maxRecordsPerFile=str(PER_FILE))
    entries, counts = pair_counts(stored)
    held = entries.drop("n").join(counts, "pair").select(F.col("slice").alias("of"), "pos", "n", "best")
    return stored.drop("pairs", "counts").groupBy("slice").cogroup(held.groupBy("of")).applyInArrow(_spread, f"doc_id long, {' long, '.join(_COUNTS)} long, n_best long, count_sum long, groups_sha256 string")


def _group_lists(a_path: str, b_path: str):
    def run(batches):
        tok = tokenizers(a_path, b_path)
        for b in batches:
            for at, part in T.slices(b["text"], 1 << 20):
                x, found = Aligned(tok, part), [[] for _ in range(len(part))]
                for row, g in zip(x.rows.tolist(), x.spelt_groups()):
                    found[row] = [dict(zip(("a", "b"), ([int(i) for i in side.split(",")] for side in one.split("|")))) for one in g.split(";")]
                kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
                yield pa.RecordBatch.from_arrays([b["id"].slice(at, len(part)), pa.array(found, kind)], ["doc_id", "groups"])

    return run


def groups(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and each row's groups: the A ids and the B ids of every stretch between two common ends; none where ``align`` has no tokens."""
    d = T.pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    return d.mapInArrow(_group_lists(a_path, b_path), "doc_id long, groups array<struct<a: array<int>, b: array<int>>>")


def op13_token_align(spark, sf_dir: str) -> DataFrame:
    return align(T.documents(spark, sf_dir, "doc_id", "text"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
