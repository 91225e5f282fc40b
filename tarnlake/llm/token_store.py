"""Token ids as Parquet list columns, with offsets over the whole corpus.

Ids are written in ascending doc_id order: a range partitioning deals the documents to files, each file is
sorted, and its number is a column. The format is Parquet with version 2 pages. Ids are
delta-encoded where ``encoding`` is "delta" or dictionary-encoded where it is "dictionary"; row groups and
pages have set sizes, and the writer adds column and offset indexes, so a reader of a few doc_ids, or of lengths
alone, reads only the pages and columns that it needs.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.llm import text as T
from tarnlake.llm.bpe_segment import _byte_letters, tokenizer_path
from tarnlake.session import scratch_path

#: Letters that are one code point in every normal form, then marks other than the apostrophe.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
ROW_GROUP, PAGE = 32 << 20, 256 << 10


class _Parts(dict):
    """Encoded parts, each made when it is first asked for."""

    def __init__(self, make, held=()):
        super().__init__(held)
        self.make = make

    def __missing__(self, part: str) -> bytes:
        ids = self[part] = self.make(part)
        return ids


class _Encoder:
    """The library's ids for whole texts.

    Texts are cut at ASCII white space, where its splitting never joins, and each distinct part is encoded once while
    it is held. A part of Latin letters, or of these and then marks, is two pieces to the library's splitter and needs no
    more than its model; every other part goes through all of its steps.
    """

    LIMIT = 900_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.model = self.lib.model
        self.ids = _Parts(self.part)
        self.marks: dict[str, list[int]] = {"": []}
        letters = [chr(c) for c in (*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100))]
        byte = {bytes([b]): c for b, c in _byte_letters().items()}
        self.spelt = str.maketrans({c: "".join(byte[bytes([b])] for b in c.encode()) for c in letters})

    def whole(self, text: str) -> list[int]:
        return self.lib.encode(text, add_special_tokens=False).ids

    def part(self, w: str) -> bytes:
        m = _PLAIN.fullmatch(w)
        if not m:
            return array("i", self.whole(w)).tobytes()
        word, marks = m.groups()
        if marks not in self.marks:
            if len(self.marks) > 50_000:
                self.marks = {"": []}
            self.marks[marks] = self.whole(marks)
        return array("i", [t.id for t in self.model.tokenize(word.lower().translate(self.spelt))] + self.marks[marks]).tobytes()

    def encode(self, texts: pa.Array, end: int) -> pa.ListArray:
        """The ids of each text and the end, as one list column.

        Parts are cut at ASCII white space and numbered by Arrow, so each distinct one of a slice is looked up once,
        and the ids are laid out by their places.
        """
        parts = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        coded = parts.values.dictionary_encode()
        # As objects of a numpy array they are made in one call, without a scalar for each.
        named = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.ids) > self.LIMIT:
            # What the next texts hold is kept.
            self.ids = _Parts(self.part, ((w, self.ids[w]) for w in named if w in self.ids))
        found = [*map(self.ids.__getitem__, named), array("i", [end]).tobytes()]
        size = np.fromiter(map(len, found), np.int32, len(found)) // 4
        pool, start = np.frombuffer(b"".join(found), np.int32), np.cumsum(size, dtype=np.int32) - size
        cuts = parts.offsets.to_numpy()
        # The end is one more part of each text.
        word = np.insert(coded.indices.to_numpy(), cuts[1:] - cuts[0], len(found) - 1)
        n = size[word]
        after = np.cumsum(n, dtype=np.int64)
        at = np.repeat((start[word] - (after - n)).astype(np.int32), n)
        at += np.arange(len(at), dtype=np.int32)
        ends = after[cuts[1:] - cuts[0] + np.arange(len(texts))]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(pool[at]))


_held: dict[str, _Encoder] = {}


def _encode(path: str, end: int):
    def run(batches):
        if path not in _held:
            _held[path] = _Encoder(path)
        for b in batches:
            part = b["part"]
            for at, texts in T.slices(b["text"], 1 << 22):
                ids = _held[path].encode(texts, end)
                yield pa.RecordBatch.from_arrays([part.slice(at, len(ids)), b["id"].slice(at, len(ids)), pc.list_value_length(ids), ids], ["part", "doc_id", "n_tokens", "ids"])

    return run


def write_tokens(df: DataFrame, out: str, path: str, end: int = 1, id_col: str = "doc_id", text_col: str = "text", encoding: str = "delta", codec: str = "zstd") -> None:
    """Write (part, doc_id, n_tokens, ids) of every row to Parquet at ``out``, in ascending doc_id order over the parts.

    A null or empty text has the end id alone. Rows without an id come first. Repeated ids stand next to
    each other, ordered by text. An empty table gives files without rows. Other columns are ignored.
    """
    docs = T.pick(df, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    dealt = docs.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first())
    ids = dealt.withColumn("part", F.spark_partition_id()).mapInArrow(_encode(path, end), "part int, doc_id long, n_tokens int, ids array<int>")
    options = {
        "compression": codec,
        "parquet.writer.version": "v2",
        "parquet.enable.dictionary": "true" if encoding == "dictionary" else "false",
        "parquet.block.size": str(ROW_GROUP),
        "parquet.page.size": str(PAGE),
    }
    ids.write.options(**options).parquet(out)


def _checked(batches):
    for b in batches:
        ids = b["ids"]
        ids = ids.cast(pa.list_(pa.uint32())) if ids.null_count == 0 else ids.fill_null([]).cast(pa.list_(pa.uint32()))
        flat = np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False), "<u4").view(np.uint8)
        n = np.asarray(pc.list_value_length(ids), np.int64)
        cuts = np.concatenate([[0], np.cumsum(n)]) * 4
        crc = [zlib.crc32(flat[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:])]
        yield pa.RecordBatch.from_arrays([b["part"], b["doc_id"], pa.array(n), pa.array(crc, pa.int64())], ["part", "doc_id", "n_tokens", "ids_crc32"])


def read_tokens(spark, path: str) -> DataFrame:
    """(part, doc_id, n_tokens, ids) as written; selecting fewer columns, or some doc_ids, reads only their pages."""
    return spark.read.schema("part int, doc_id long, n_tokens int, ids array<int>").parquet(path)


def digest(stored: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each stored row.

    Starts add up within a part, over parts by one total for each: those alone are ordered in one place, and
    there are as many as files. Rows of one id stand in the order of their crc, which are equal where all is equal.
    """
    rows = stored.mapInArrow(_checked, "part int, doc_id long, n_tokens long, ids_crc32 long")
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    order = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(before, "part").select("doc_id", (F.col("before") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).alias("start"), "n_tokens", "ids_crc32")


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "tokens")
    write_tokens(T.documents(spark, sf_dir, "doc_id", "text"), out, tokenizer_path("word_bpe_49k.json"))
    return digest(read_tokens(spark, out))
