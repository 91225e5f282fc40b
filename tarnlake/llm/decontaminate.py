"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by the size of their shingle sets. For the items of one partition, whose
sizes are at most ``s``, each document is cut into windows of 2 * s shingles that begin every s
shingles, so any run of s shingles lies inside one window, and the window's size is known: an item
contained in a passage has a Jaccard similarity of more than a quarter with that window, however long the
document is. An item is a candidate for a document when any of ``HASHES`` minima agrees in any window.
Candidates are then verified on the exact sets of the whole item and the whole document.

The items of one pass, with their signatures and sets, are broadcast. Their size is counted first:
items are dealt into blocks of at most ``BLOCK`` shingles, and the documents are read once for each
block, so what is broadcast has a bound at every size of the benchmark.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm import text as T

HASHES, BLOCK = 48, 2_000_000
_MULTIPLIERS = np.random.default_rng(11).integers(1, 2**63, HASHES, dtype=np.uint64) * T.U(2) + T.U(1)
RESULT = "doc_id long, item_id long, item_shingles long, shared long, containment double"


def _item_sets(width: int):
    def run(batches):
        for b in batches:
            for at, sets in T.shingle_sets(b["text"], width):
                yield pa.RecordBatch.from_arrays([b["id"].slice(at, len(sets)), T.lists([T.signed(s) for s in sets], pa.int64())], ["id", "s"])

    return run


class _Index:
    """The items of one block: by size class, a sorted table of (hash function, minimum) with its items."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        self.ids, self.sets, self.classes = ids, sets, []
        size = np.array([len(s) for s in sets])
        top = 1 << np.ceil(np.log2(size)).astype(int)
        for s in np.unique(top):
            own = np.flatnonzero(top == s)
            minima = np.array([[(sets[i] * m).min() for i in own] for m in _MULTIPLIERS])
            order = np.argsort(minima, axis=1)
            self.classes.append((int(s), np.take_along_axis(minima, order, 1), own[order]))

    def candidates(self, shingles: np.ndarray, starts: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) of which any minimum agrees in any window."""
        out: set[tuple[int, int]] = set()
        made = np.diff(starts)
        rows = np.flatnonzero(made)
        if not len(rows):
            return out
        for s, minima, owners in self.classes:
            blocks = -(-made[rows] // s)
            first = np.concatenate([[0], np.cumsum(blocks)])
            of = np.repeat(np.arange(len(rows)), blocks)
            cuts = starts[rows][of] + (np.arange(first[-1]) - first[:-1][of]) * s
            for k, m in enumerate(_MULTIPLIERS):
                low = np.minimum.reduceat(shingles * m, cuts)
                # A window is two blocks of one document; its minimum is the lesser of theirs.
                pair = np.minimum(low[:-1], low[1:])
                windows = np.where(of[:-1] == of[1:], pair, low[:-1]) if len(low) > 1 else low
                windows = np.concatenate([windows, low[-1:]]) if len(windows) < len(low) else windows
                lo, hi = np.searchsorted(minima[k], windows, "left"), np.searchsorted(minima[k], windows, "right")
                for w in np.flatnonzero(hi > lo):
                    out.update((int(rows[of[w]]), int(i)) for i in owners[k][lo[w] : hi[w]])
        return out


def _found(held: _Index, column: pa.Array, width: int, percent: int):
    """(row, item, shared) of every item that a text contains."""
    for at, part in T.slices(column):
        w = T.Words(part)
        s, starts = T.shingle(w.hashes(), w.counts, w.first, width)
        near: dict[int, list[int]] = {}
        for row, item in held.candidates(s, starts):
            near.setdefault(row, []).append(item)
        for row, items in near.items():
            own = np.unique(s[starts[row] : starts[row + 1]])
            for i in items:
                shared = int(np.isin(held.sets[i], own).sum())
                if 100 * shared >= percent * len(held.sets[i]):
                    yield at + row, i, shared


def _search(index, width: int, percent: int):
    names = RESULT.replace(" long", "").replace(" double", "").split(", ")

    def run(batches):
        held = index.value
        for b in batches:
            ids = b["id"].to_pylist()
            found = [(ids[row], held.ids[i], n := len(held.sets[i]), shared, shared / n) for row, i, shared in _found(held, b["text"], width, percent)]
            cols = zip(*found) if found else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(),) * 4 + (pa.float64(),))], names)

    return run


def _drop(index, width: int, percent: int):
    def run(batches):
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            keep[[row for row, _, _ in _found(index.value, b["text"], width, percent)]] = False
            yield b.filter(pa.array(keep))

    return run


def _indexes(spark, items: DataFrame, item_col: str, item_text: str, width: int):
    """The items in blocks of bounded size, each broadcast."""
    i = T.pick(items, id=item_col, text=item_text).withColumn("id", F.col("id").cast("long"))
    sets = i.mapInArrow(_item_sets(width), "id long, s array<long>").where("size(s) > 0")
    total = sets.agg(F.sum(F.size("s"))).first()[0] or 0
    # Dealt by the hash of the item, which needs no order over all; twice as many blocks as the mean needs.
    blocks = -(-2 * total // BLOCK) if total > BLOCK else 1
    for k in range(blocks):
        own = (sets if blocks == 1 else sets.where(F.pmod(F.xxhash64("id", "s"), F.lit(blocks)) == k)).collect()
        if own:
            yield spark.sparkContext.broadcast(_Index([r.id for r in own], [np.array(r.s, np.int64).view(np.uint64) for r in own]))


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row for each document and test item it contains: doc_id, item_id, item_shingles, shared, containment.

    A-Z is lower-cased and words are runs of other than white space. A set holds the distinct
    ``width``-word shingles, or with fewer words the whole sequence as one. A document contains an
    item if ``100 * shared >= percent * item_shingles``. Null and empty texts, documents or items,
    have no shingle and appear in no row; rows without an id keep a null id; repeated rows
    are each reported; without items, or documents, there are no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    d = T.pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    out = [d.mapInArrow(_search(index, width, percent), RESULT) for index in _indexes(spark, items, item_col, item_text, width)]
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], RESULT)


def clean(docs: DataFrame, items: DataFrame, item_col: str = "item_id", item_text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, whose ``text`` contains no test item."""
    for index in _indexes(docs.sparkSession, items, item_col, item_text, width):
        docs = docs.mapInArrow(_drop(index, width, percent), docs.schema)
    return docs


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contained_items(T.documents(spark, sf_dir, "doc_id", "text"), items)


_GRAMS = "unnest(list_distinct(case when len(w) >= 5 then list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as s"
OP8_SQL = f"""
with d as (select doc_id, {_GRAMS} from (select doc_id, {T.SQL_WORDS} as w from documents)),
i as (select item_id, {_GRAMS} from (select item_id, {T.SQL_WORDS} as w from benchmark)),
n as (select item_id, count(*) as n from i group by 1),
p as (select doc_id, item_id, count(*) as shared from d join i using (s) group by 1, 2)
select doc_id, item_id, n as item_shingles, shared, shared / n as containment from p join n using (item_id) where 100 * shared >= 80 * n
"""
