"""Importance resampling of text quality: hashed n-gram models and a Gumbel top-k.

Words and word pairs are hashed into ``BUCKETS``. Two generative models share that space: the target model
counts the buckets of documents labelled good, the raw model those of all documents. A document's
log weight is the sum over its n-grams of log target less log raw, the logarithm of how much likelier the target model
makes it than the raw one. Keeping the ``k`` largest values of log weight + Gumbel noise draws k documents without
replacement in proportion to their weights. The noise is a function of the id, so a run can be repeated. k follows the share of good
labels, at the upper end of its confidence interval. The k-th value is found exactly by counting the values'
leading 16 bits, then the next, four times: each count has at most 65,536 rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm import text as T
from tarnlake.session import materialize

BUCKETS, SEED = 1 << 16, 20240611
#: The target model is fitted on at most so many labelled rows, chosen by the hash of their ids.
MAX_LABELS = 200_000


def _ngrams(part: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(bucket, row) of every word and word pair, and the rows."""
    w = T.Words(part)
    h, row = w.hashes(), np.repeat(np.arange(w.rows), w.counts)
    same = row[:-1] == row[1:]
    pairs = T.mix(h[:-1] * T._PLACES[0] + h[1:] * T._PLACES[1])[same]
    return (np.concatenate([h, pairs]) >> T.U(48)).astype(np.int64), np.concatenate([row, row[:-1][same]]), w.rows


def _count(batches):
    for b in batches:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        q = b["quality"].fill_null(0).to_numpy() == 1
        for at, part in T.slices(b["text"]):
            bucket, row, n = _ngrams(part)
            raw += np.bincount(bucket, minlength=BUCKETS)
            good += np.bincount(bucket[q[at : at + n][row]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(good[some])], ["bucket", "raw", "good"])


@dataclass
class Model:
    """Log ratios by bucket, and the least value that is kept once ``cutoff`` has set it."""

    ratio: np.ndarray
    share: float
    least: int = -(2**63)

    def values(self, column: pa.Array, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log weight, value as a sortable integer) of each row; a text without words comes last of all."""
        weights, sizes = [], []
        for _, part in T.slices(column):
            bucket, row, n = _ngrams(part)
            sizes.append(np.bincount(row, minlength=n))
            weights.append(np.bincount(row, weights=self.ratio[bucket], minlength=n))
        size, w = (np.concatenate(x) if x else np.zeros(0) for x in (sizes, weights))
        u = ((noise.view(np.uint64) >> T.U(11)).astype(float) + 0.5) / 2**53
        bits = np.ascontiguousarray(w - np.log(-np.log(u))).view(np.int64)
        bits = bits ^ ((bits >> 63) & np.int64(2**63 - 1))
        return w, np.where(size > 0, bits, np.int64(-(2**63) + 1))


def _noise(c):
    return F.xxhash64(c, F.lit(SEED))


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Model:
    """Count both models in one pass over ``docs`` (doc_id, text)."""
    known = labels.select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("quality")).where("label_id is not null and quality is not null").groupBy("label_id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("label_id"), "label_id").limit(max_labels)
    n, good = known.agg(F.count("*"), F.sum("quality")).first()
    if not n or not good:
        return Model(np.zeros(BUCKETS), 1.0)
    seen = docs.join(F.broadcast(known), docs.doc_id == known.label_id, "left").select("text", "quality")
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in seen.mapInArrow(_count, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect():
        raw[r.bucket] += r.raw
        target[r.bucket] += r.good
    p = good / n
    return Model(np.log(target / target.sum()) - np.log(raw / raw.sum()), min(1.0, p + 2.6 * math.sqrt(p * (1 - p) / n)))


def _weigh(model):
    def run(batches):
        for b in batches:
            w, v = model.value.values(b["text"], b["noise"].to_numpy())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(w), pa.array(v)], ["doc_id", "log_weight", "value"])

    return run


def weigh(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, log_weight, value) of each row, written once."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return materialize(docs.select("doc_id", "text", _noise(F.col("doc_id")).alias("noise")).mapInArrow(_weigh(held), "doc_id long, log_weight double, value long"), "weights")


def kth_largest(values: DataFrame, k: int) -> int:
    """The k-th largest ``value`` (1 is the largest; k no more than the rows), by four counts of 16 bits."""
    known, left = 0, k
    for level in range(4):
        shift = 48 - 16 * level
        # The sign bit is flipped, so that unsigned order is the values' order.
        key = F.expr("value ^ (-9223372036854775807L - 1L)")
        at = values if not level else values.where(F.shiftrightunsigned(key, shift + 16) == known)
        digit = F.shiftrightunsigned(key, shift).bitwiseAND(65535)
        for digit_, n in sorted(((r.digit, r.n) for r in at.groupBy(digit.alias("digit")).agg(F.count("*").alias("n")).collect()), reverse=True):
            if n >= left:
                known = known << 16 | digit_
                break
            left -= n
    return known - 2**63


def cutoff(weighed: DataFrame, share: float) -> int:
    n = weighed.count()
    k = math.ceil(share * n)
    return kth_largest(weighed, k) if 0 < k < n else -(2**63)


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, log_weight, kept.

    Rows that repeat an id and text share their value, and all values equal to the k-th are kept.
    Null and empty texts, which have no n-gram, weigh 0 and come last. Without a good label nothing can be
    told and all rows are kept. Labels that repeat an id count as their least. Other columns are ignored; empty
    tables give no rows.
    """
    d = T.pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    model = fit(d, labels)
    weighed = weigh(d, model)
    return weighed.select("doc_id", "log_weight", (F.col("value") >= cutoff(weighed, model.share)).alias("kept"))


def _keep(model, names, noise: str):
    def run(batches):
        for b in batches:
            _, v = model.value.values(b["text"], b[noise].to_numpy())
            yield b.select(names).filter(pa.array(v >= model.value.least))

    return run


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that resampling keeps, with all their columns: weighed again rather than carried through a shuffle."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(d, labels)
    model.least = cutoff(weigh(d, model), model.share)
    held = docs.sparkSession.sparkContext.broadcast(model)
    # A name that no column has.
    noise = "_" * (1 + max(map(len, docs.columns)))
    return docs.withColumn(noise, _noise(F.col("doc_id").cast("long"))).mapInArrow(_keep(held, docs.columns, noise), docs.schema)


def op2_quality_resample(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return resample(T.documents(spark, sf_dir, "doc_id", "text"), labels)
