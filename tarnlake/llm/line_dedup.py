"""Removal of lines that many documents repeat, with two Bloom filters before the exact count.

A line's key is the line without white space at both ends, A-Z in lower case, kept as a 128-bit digest. Every task makes two
filters of its own lines, one of what it has seen and one of what it has seen twice, and sends the places of their set
bits. Filters are merged by chunks of bits: a place is set in the second filter where one of the parts had it there, or
where two parts had it in their first. So the merged second filter holds every key that two documents have, and a few others.
Only keys that it holds are shuffled, to be counted exactly by documents and to choose the document that keeps the line.

The filter has ``BITS_A_LINE`` bits for each line of the corpus, up to ``ROUND_BITS`` at a time: with more lines the keys are
dealt by their digest over several rounds, each with a filter of that size, so what is broadcast is bounded.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm import text as T
from tarnlake.session import materialize

BITS_A_LINE, HASHES, ROUND_BITS, CHUNK = 10, 4, 1 << 30, 1 << 20
#: Dropped keys (24 bytes each) that are broadcast at most; beyond it they are joined.
BROADCAST_KEYS = 1_000_000
#: Keys that a task holds before it sends the places of its filters.
HELD = 2_000_000
_SPACE = b" \t\n\x0b\x0c\r"


def _key(line: bytes, least: int) -> bytes | None:
    """The digest of a line's key, or None where the key has fewer code points than ``least``."""
    key = line.strip(_SPACE).lower()
    if len(key) < least or not key.isascii() and len(key.decode("utf-8", "replace")) < least:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _bytes(column: pa.Array) -> list[bytes]:
    return column.fill_null("").cast(pa.large_binary()).to_pylist()


def _line_keys(least: int):
    """Each row's distinct keys, end to end; rows without a key give none."""

    def run(batches):
        for b in batches:
            for at, part in T.slices(b["text"]):
                keys = [b"".join({k for line in t.split(b"\n") if (k := _key(line, least))}) for t in _bytes(part)]
                out = pa.RecordBatch.from_arrays([b["id"].slice(at, len(keys)), pa.array(keys, pa.binary())], ["id", "keys"])
                yield out.filter(pa.array([bool(k) for k in keys], pa.bool_()))

    return run


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a batch as rows of two 64-bit words, and how many each row has."""
    column = column.cast(pa.large_binary())
    size = np.asarray(pc.binary_length(column))
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint64).reshape(-1, 2), size // 16


def _in_round(keys: np.ndarray, number: int, rounds: int) -> np.ndarray:
    return ((keys[:, 0] >> T.U(32)) * T.U(rounds)) >> T.U(32) == T.U(number)


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    """The places of each key, one row for each hash function."""
    x, y = keys[:, 0] * T._MULT, keys[:, 1] | T.U(1)
    return np.stack([((T.mix(x + T.U(i) * y) >> T.U(32)) * T.U(bits)) >> T.U(32) for i in range(HASHES)])


def _filters(bits: int, number: int, rounds: int):
    """A task's two filters, as the places that are set in each chunk."""

    def sent(held):
        keys = np.concatenate(held)
        _, first, times = np.unique(keys[:, 0], return_index=True, return_counts=True)
        once, twice = (np.unique(_places(keys[k], bits)).astype(np.int64) for k in (first, first[times > 1]))
        chunks = np.unique(once // CHUNK)
        cut = lambda p: np.split((p % CHUNK).astype(np.int32), np.searchsorted(p // CHUNK, chunks[1:]))
        return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), T.lists(cut(once), pa.int32()), T.lists(cut(twice), pa.int32())], ["chunk", "once", "twice"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            keys, _ = _words(b["keys"])
            keys = keys[_in_round(keys, number, rounds)]
            held.append(keys)
            n += len(keys)
            if n >= HELD:
                yield sent(held)
                held, n = [], 0
        if n:
            yield sent(held)

    return run


def _merged(table: pa.Table) -> pa.Table:
    """The second filter of one chunk, from the two of every part."""
    once, twice = np.zeros(CHUNK, bool), np.zeros(CHUNK, bool)
    for b in table.to_batches():
        for o, t in zip(b["once"], b["twice"]):
            seen = o.values.to_numpy()
            twice[t.values.to_numpy()] = True
            twice[seen[once[seen]]] = True
            once[seen] = True
    return pa.table({"chunk": table["chunk"][:1], "bits": pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())})


def _suspects(second, bits: int, number: int, rounds: int):
    """(key, id) of every key that the second filter holds."""

    def run(batches):
        held = second.value
        for b in batches:
            keys, counts = _words(b["keys"])
            rows = np.repeat(np.arange(len(counts)), counts)
            own = np.flatnonzero(_in_round(keys, number, rounds))
            hit = np.ones(len(own), bool)
            for p in _places(keys[own], bits):
                hit &= (held[p >> T.U(3)] >> (p & T.U(7)).astype(np.uint8)) & 1 == 1
            own = own[hit]
            found = pa.Array.from_buffers(pa.binary(16), len(own), [None, pa.py_buffer(np.ascontiguousarray(keys[own]).tobytes())])
            yield pa.RecordBatch.from_arrays([found.cast(pa.binary()), b["id"].take(pa.array(rows[own]))], ["key", "id"])

    return run


def suspected(keys: DataFrame) -> DataFrame:
    """(key, id) of the keys that two documents may have: all that do, and few others. ``keys``: a stored table of ids and keys."""
    spark = keys.sparkSession
    n = keys.agg(F.sum(F.octet_length("keys") / 16)).first()[0] or 0
    rounds = max(1, -(-int(n) * BITS_A_LINE // ROUND_BITS))
    chunks = max(1, -(-int(n) * BITS_A_LINE // rounds // CHUNK))
    bits, out = chunks * CHUNK, []
    for number in range(rounds):
        parts = keys.select("keys").mapInArrow(_filters(bits, number, rounds), "chunk int, once array<int>, twice array<int>")
        second = np.zeros(bits // 8, np.uint8)
        for r in parts.groupBy("chunk").applyInArrow(_merged, "chunk int, bits binary").toLocalIterator():
            second[r.chunk * CHUNK // 8 : (r.chunk + 1) * CHUNK // 8] = np.frombuffer(r.bits, np.uint8)
        out.append(keys.mapInArrow(_suspects(spark.sparkContext.broadcast(second), bits, number, rounds), "key binary, id long"))
    return reduce(DataFrame.unionByName, out)


def _cut(least: int, dropped=None):
    """Texts without their dropped lines. ``dropped``: a broadcast of each key's document that keeps it; without it the row names its keys."""

    def run(batches):
        keeper = dropped.value if dropped else None
        for b in batches:
            for at, part in T.slices(b["text"]):
                ids = b["id"].slice(at, len(part)).to_pylist()
                drops = None if dropped else b["drop"].slice(at, len(part)).to_pylist()
                texts, lines, gone = [], [], []
                for i, t in enumerate(_bytes(part)):
                    all_lines = t.split(b"\n")
                    keep = all_lines
                    if dropped:
                        keep = [x for x in all_lines if (k := _key(x, least)) is None or keeper.get(k, ids[i]) == ids[i]]
                    elif drops[i]:
                        own = set(drops[i])
                        keep = [x for x in all_lines if _key(x, least) not in own]
                    lines.append(len(all_lines))
                    gone.append(len(all_lines) - len(keep))
                    texts.append(b"\n".join(keep) if gone[-1] else t)
                text = pa.array(texts, pa.binary()).cast(pa.string(), safe=False)
                yield pa.RecordBatch.from_arrays([b["id"].slice(at, len(part)), pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), text], ["doc_id", "n_lines", "n_dropped", "text"])

    return run


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 40, documents: int = 5) -> DataFrame:
    """One row per input row: doc_id, n_lines (before dropping), n_dropped and the text of the lines that stay.

    Keys of at least ``least`` code points that ``documents`` or more documents hold lose all their lines but those of
    the largest id that holds them. A null or empty text is one empty line, and its text comes back empty. An id is one document, however
    many rows repeat it; rows without an id are together one document, less than every other, and keep a line only where no other holds it.
    Lines repeated within a document count once. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    d = T.pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    keys = materialize(d.mapInArrow(_line_keys(least), "id long, keys binary"), "line-keys")
    # A key's documents are first made distinct by key and id, so that a very common line is counted by all tasks.
    pairs = materialize(suspected(keys).distinct(), "line-suspects")
    confirmed = materialize(pairs.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= documents).drop("n"), "line-drops")
    shape = "doc_id long, n_lines long, n_dropped long, text string"
    if confirmed.count() <= BROADCAST_KEYS:
        held = spark.sparkContext.broadcast({bytes(r.key): r.keeper for r in confirmed.collect()})
        return d.mapInArrow(_cut(least, held), shape)
    lost = T.join_unique(pairs, confirmed, "key", "id", "inner").where(~F.col("id").eqNullSafe(F.col("keeper")))
    own = lost.groupBy("id").agg(F.collect_list("key").alias("drop")).select(F.col("id").alias("of"), "drop")
    return d.join(own, d["id"].eqNullSafe(own["of"]), "left").select("id", "text", "drop").mapInArrow(_cut(least), shape)


def op11_line_dedup(spark, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(T.documents(spark, sf_dir, "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP11_SQL = f"""
with l as (select doc_id, i, line, translate(trim(line, E' \\t\\n\\x0B\\x0C\\r'), '{T.UPPER_LETTERS}', '{T.LOWER_LETTERS}') as k
    from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as i from documents)),
g as (select k, max(doc_id) as keeper from l where length(k) >= 40 group by k having count(distinct doc_id) >= 5),
m as (select doc_id, i, line, keeper is not null and keeper <> doc_id as gone from l left join g using (k))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256 from m group by doc_id
"""
