"""Collocations by pivot partitioning.

Words are numbered by falling frequency over the corpus, so of the words of a phrase the one with the largest number is
the rarest: the phrase's pivot. For every place of a frequent word a fragment is made of the words around it that a phrase
may reach; rarer words, and all behind them, are blanked out, because a phrase with such a word belongs to another pivot.
Equal fragments of a slice are merged, and each is sent to its pivot. A pivot's fragments are mined there by themselves,
and only phrases that the pivot owns come out, with their counts. A pivot with more than ``HOT`` places is dealt by
its fragments over several parts, whose counts are added up afterwards.

Texts are tokenised once. A slice of them holds its words by numbers of its own, and asks for the corpus-wide ones by joining
its distinct words, so nothing that grows with the corpus is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.llm import text as T
from tarnlake.operators.merge import sequence_key
from tarnlake.session import materialize

SLICE, HOT, CHUNK, DEALT, PER_FILE = 8 << 20, 200_000, 400_000, 32, 2
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True
_SLICE = "slice long, words array<string>, langs array<string>, counts array<long>, seq array<int>"


def _lists(*columns: pa.Array) -> list[pa.Array]:
    """Each array as a list column of one row."""
    return [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]


def _slices(batches):
    """One row for each slice: its distinct words by language with counts, and all its words by number, 0 between pieces."""
    number = TaskContext.get().partitionId() << 32
    for b in batches:
        for at, part in T.slices(b["text"], SLICE):
            w = T.Words(part, _GAP)
            n = len(w.starts)
            if not n:
                continue
            ends = np.concatenate([[0], np.cumsum(w.ends - w.starts)]).astype(np.int64)
            words = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(w.data[~_GAP[w.data]].tobytes())]).dictionary_encode()
            lang = b["lang"].slice(at, len(part)).fill_null("und").dictionary_encode()
            k = len(lang.dictionary)
            code = pa.array(words.indices.to_numpy().astype(np.int64) * k + np.repeat(lang.indices.to_numpy(), w.counts)).dictionary_encode()
            own, seq = code.dictionary.to_numpy(), code.indices.to_numpy()
            piece = np.cumsum(_BREAK[w.data])[w.starts] + np.repeat(np.arange(w.rows), w.counts)
            laid = np.arange(n) + np.concatenate([[0], np.cumsum(piece[1:] != piece[:-1])])
            out = np.zeros(laid[-1] + 1, np.int32)
            out[laid] = seq + 1
            cols = _lists(words.dictionary.take(pa.array(own // k)).cast(pa.string()), lang.dictionary.take(pa.array(own % k)), pa.array(np.bincount(seq, minlength=len(own)), pa.int64()), pa.array(out))
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *cols], ["slice", "words", "langs", "counts", "seq"])
            number += 1


def _merge(rows: np.ndarray, counts: np.ndarray, lead: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows, their summed counts, their hashes). With ``lead`` they are in its order, then by a part of the hash;
    a row may then appear twice."""
    h = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        h = T.mix(h * T._MULT + rows[:, k].astype(np.uint64))
    key = h if lead is None else (lead.astype(np.uint64) << T.U(33)) | (h >> T.U(31))
    order = np.argsort(key)
    rows, counts, key = rows[order], counts[order], key[order]
    new = (rows[1:] != rows[:-1]).any(1)
    if lead is None and (new & (key[1:] == key[:-1])).any():
        # Unlike rows of one hash: sorted by their values instead.
        order = np.lexsort(rows.T)
        rows, counts, key = rows[order], counts[order], key[order]
        new = (rows[1:] != rows[:-1]).any(1)
    first = np.concatenate([[0], np.flatnonzero(new) + 1]) if len(rows) else np.zeros(0, np.int64)
    return rows[first], np.add.reduceat(counts, first) if len(first) else counts, key[first]


def _fragments(reach: int):
    """The fragments of each slice, a row for each pivot and part."""

    def run(batches):
        for b in batches:
            for seq, held in zip(b["seq"], b["held"]):
                pos, ids, f = (held.values.field(k).to_numpy() for k in range(3))
                number = np.zeros(max(int(pos.max()) + 2, int(pc.max(seq.values).as_py()) + 1), np.int32)
                number[pos + 1] = ids
                line = np.concatenate([np.zeros(reach, np.int32), number[seq.values.to_numpy()], np.zeros(reach, np.int32)])
                at = np.flatnonzero(line)
                pivot, cols = line[at], []
                for side in (-1, 1):
                    open_ = np.ones(len(at), bool)
                    for d in range(1, reach + 1):
                        near = line[at + side * d]
                        open_ = open_ & (near > 0) & (near <= pivot)
                        cols.append(np.where(open_, near, 0))
                some = (cols[0] > 0) | (cols[reach] > 0)
                rows = np.stack([pivot, *cols], 1)[some]
                rows, n, key = _merge(rows, np.ones(len(rows), np.int64), rows[:, 0])
                by = np.argsort(ids)
                parts = -(-f[by][np.searchsorted(ids[by], rows[:, 0])] // HOT)
                part = ((key & T.U(2**33 - 1)) * parts.astype(np.uint64) >> T.U(33)).astype(np.int64)
                new = np.flatnonzero((rows[1:, 0] != rows[:-1, 0]) | (part[1:] != part[:-1])) + 1
                first = np.concatenate([[0], new]) if len(rows) else np.zeros(0, np.int64)
                flat = np.concatenate([rows[:, 1:], n[:, None]], 1).astype(np.int32)
                off = np.concatenate([first, [len(rows)]]).astype(np.int32) * flat.shape[1] if len(rows) else np.zeros(1, np.int32)
                frags = pa.ListArray.from_arrays(pa.array(off), pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(rows[first, 0]), pa.array(part[first].astype(np.int32)), pa.array(parts[first].astype(np.int32)), frags], ["pivot", "part", "parts", "frags"])

    return run


def _owned(pivot: np.ndarray, flat: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The phrases that fragments' pivots own, at the pivot's first place in each, so that none counts twice: (words, counts, fragment)."""
    reach = most - 1
    line = np.concatenate([flat[:, reach - 1 :: -1] if reach else flat[:, :0], pivot[:, None], flat[:, reach:]], 1)
    out = []
    for size in range(2, most + 1):
        for before in range(size):
            span = line[:, reach - before : reach - before + size]
            ok = np.flatnonzero((span > 0).all(1) & (span[:, :before] != pivot[:, None]).all(1))
            words = np.zeros((len(ok), most), np.int32)
            words[:, :size] = span[ok]
            out.append((words, counts[ok], ok))
    return tuple(np.concatenate(x) for x in zip(*out))


def _mine(least: int, most: int):
    """Counts of phrases from fragments sorted by pivot and part: final ones, of ``least`` or more, where the pivot is whole."""
    width = 2 * (most - 1) + 1

    def sent(words, n, whole):
        keep = ~whole | (n >= least)
        words, n, whole = words[keep], n[keep], whole[keep]
        sizes = (words > 0).sum(1)
        off = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(off), pa.array(words[words > 0])), pa.array(n), pa.array(whole)], ["words", "n", "whole"])

    def run(batches):
        words, n, group, whole = np.zeros((0, most), np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        groups, last = 0, None
        for b in batches:
            size = np.diff(b["frags"].offsets.to_numpy()) // width
            cuts = np.searchsorted(np.cumsum(size), np.arange(CHUNK, size.sum() + CHUNK, CHUNK), "left") + 1
            for lo, hi in zip([0, *cuts[:-1]], cuts):
                part = b.slice(lo, hi - lo)
                if not part.num_rows:
                    continue
                pivot, salt, parts = (part[c].to_numpy() for c in ("pivot", "part", "parts"))
                flat = part["frags"].flatten().to_numpy().reshape(-1, width)
                begins = np.concatenate([[(pivot[0], salt[0]) != last], (pivot[1:] != pivot[:-1]) | (salt[1:] != salt[:-1])])
                number = groups + np.cumsum(begins)
                groups, last = int(number[-1]), (pivot[-1], salt[-1])
                of = np.repeat(np.arange(part.num_rows), size[lo:hi])
                w, c, at = _owned(pivot[of], flat[:, :-1], flat[:, -1].astype(np.int64), most)
                words, n = np.concatenate([words, w]), np.concatenate([n, c])
                group, whole = np.concatenate([group, number[of[at]]]), np.concatenate([whole, parts[of[at]] == 1])
                if len(n) < CHUNK:
                    continue
                # Groups that have ended are done with; the one that may go on is summed up and held.
                rows, n, _ = _merge(np.concatenate([words, group[:, None].astype(np.int32), whole[:, None]], 1), n)
                words, group, whole = rows[:, :most], rows[:, most].astype(np.int64), rows[:, most + 1] > 0
                done = group < groups
                yield sent(words[done], n[done], whole[done])
                words, n, group, whole = words[~done], n[~done], group[~done], whole[~done]
        rows, n, _ = _merge(np.concatenate([words, group[:, None].astype(np.int32), whole[:, None]], 1), n)
        yield sent(rows[:, :most], n, rows[:, most + 1] > 0)

    return run


def _decimal(c: str) -> Column:
    return F.col(c).cast("decimal(15,0)")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 10, most: int = 3, top: int = 2000, cover: int = 50) -> DataFrame:
    """The best phrases of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    A-Z is lower-cased; texts are split into pieces at ``.,;:!?`` and line ends, and pieces into words at blanks and tabs. A
    phrase has 2 to ``most`` words and is found ``least`` times or more in pieces, overlaps included (a). Its score is
    floor(1000000 * a * a / (l * r)) of its worst cut, l and r being how often the cut's two parts are found; of equal cuts the first counts. A
    phrase inside a longer one that is found in ``cover`` percent of its places or more is left out. n is the number of words
    of the language. Ties go to the larger a, then to the phrase that comes first by its bytes.

    A null language counts as ``und``. Null, empty and blank texts have no words; repeated rows count each time; an empty table gives no rows;
    other columns are ignored. A very long text is a slice of its own. There may be 2**31 - 1 words of ``least`` or more.
    """
    d = T.pick(docs, text=text_col, lang=lang_col)
    # A reader decodes the rows of a file together, so a file has few slices, however large the input's splits are.
    held = materialize(d.mapInArrow(_slices, _SLICE), "collocations-slices", compression="zstd", maxRecordsPerFile=str(PER_FILE))
    entries = held.select("slice", F.posexplode(F.arrays_zip("words", "langs", "counts")).alias("pos", "e")).select("slice", "pos", F.col("e.words").alias("word"), F.col("e.langs").alias("lang"), F.col("e.counts").alias("n"))
    totals = held.select(F.explode(F.arrays_zip("langs", "counts")).alias("e")).groupBy(F.col("e.langs").alias("lang")).agg(F.sum("e.counts").alias("n"))
    common = entries.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least).withColumn("less", -F.col("f"))
    known = materialize(sequence_key(common, ["less", "lang", "word"], 0, "id").select("lang", "word", "f", F.col("id").cast("int").alias("id")), "collocations-words")
    asked = entries.drop("n").join(known, ["lang", "word"]).groupBy("slice").agg(F.collect_list(F.struct("pos", "id", "f")).alias("held"))
    sent = held.select("slice", "seq").join(asked, "slice").select("seq", "held").mapInArrow(_fragments(most - 1), "pivot int, part int, parts int, frags array<int>")
    mined = materialize(sent.repartition("pivot", "part").sortWithinPartitions("pivot", "part").mapInArrow(_mine(least, most), "words array<int>, n long, whole boolean"), "collocations-mined")
    rest = mined.where("not whole").groupBy("words").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    found = materialize(mined.where("whole").select("words", "n").unionByName(rest), "collocations-found")

    parts = known.select(F.array("id").alias("p"), F.col("f").alias("a"), "lang", F.col("word").alias("phrase"))
    scored = None
    for size in range(2, most + 1):
        cuts = found.where(F.size("words") == size).select("words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(size - 1))).alias("k"))
        left = parts.select(F.col("p").alias("lp"), F.col("a").alias("l"), "lang", F.col("phrase").alias("first"))
        right = parts.select(F.col("p").alias("rp"), F.col("a").alias("r"), F.col("phrase").alias("second"))
        j = cuts.join(left, F.slice("words", F.lit(1), F.col("k")) == F.col("lp")).join(right, F.slice("words", F.col("k") + 1, F.lit(size) - F.col("k")) == F.col("rp"))
        score = (F.lit(1_000_000).cast("decimal(7,0)") * (_decimal("a") * _decimal("a"))).alias("x")
        j = j.withColumn("x", score).withColumn("y", _decimal("l") * _decimal("r")).withColumn("score", F.expr("x div y"))
        best = j.groupBy("words").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"), F.first("a").alias("a"), F.first("lang").alias("lang"), F.first(F.concat_ws(" ", "first", "second")).alias("phrase"))
        step = materialize(best.select(F.col("words").alias("p"), "a", "lang", "phrase", "b.l", "b.r", "b.score"), "collocations-scored")
        scored = step if scored is None else scored.unionByName(step)
        parts = parts.unionByName(step.select("p", "a", "lang", "phrase"))

    inner = found.where(F.size("words") > 2).select("n", F.explode(F.expr("flatten(transform(sequence(2, size(words) - 1), s -> transform(sequence(1, size(words) - s + 1), i -> slice(words, i, s))))")).alias("p"))
    longer = inner.groupBy("p").agg(F.max("n").alias("longer"))
    kept = scored.join(longer, "p", "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * cover))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language's phrases are first ranked in parts, so that no task holds them all.
    dealt = kept.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(DEALT))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).where(F.col("rank") <= top)
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(T.documents(spark, sf_dir, "lang", "text"))


OP12_SQL = f"""
with p as (select row_number() over () as p, lang, w from (
    select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from (
        select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), '{T.UPPER_LETTERS}', '{T.LOWER_LETTERS}'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents))),
t as (select p, lang, unnest(w) as x, generate_subscripts(w, 1) as i from p),
c1 as (select lang, x, count(*) as f from t group by all),
n as (select lang, sum(f)::bigint as n from c1 group by all),
t3 as (select lang, x, lead(x) over v as y, lead(x, 2) over v as z from t window v as (partition by p order by i)),
c2 as (select lang, x, y, count(*) as a from t3 where y is not null group by all having count(*) >= 10),
c3 as (select lang, x, y, z, count(*) as a from t3 where z is not null group by all having count(*) >= 10),
cut as (select c2.lang, x || ' ' || y as phrase, a, 1 as k, p.f as l, q.f as r from c2 join c1 p using (lang, x) join c1 q on q.lang = c2.lang and q.x = c2.y
    union all select c3.lang, c3.x || ' ' || c3.y || ' ' || c3.z, c3.a, 1, p.f, q.a from c3 join c1 p using (lang, x) join c2 q on q.lang = c3.lang and q.x = c3.y and q.y = c3.z
    union all select c3.lang, c3.x || ' ' || c3.y || ' ' || c3.z, c3.a, 2, p.a, q.f from c3 join c2 p using (lang, x, y) join c1 q on q.lang = c3.lang and q.x = c3.z),
s as (select *, ((1000000::hugeint * a * a) // (l::hugeint * r))::bigint as score from cut),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
o as (select lang, sub, max(a) as longer from (select lang, x || ' ' || y as sub, a from c3 union all select lang, y || ' ' || z, a from c3) group by all),
k as (select b.* from b left join o on o.lang = b.lang and o.sub = b.phrase where longer is null or 100 * longer < 50 * a)
select lang, rank, phrase, a, l, r, n, score from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from k) join n using (lang) where rank <= 2000
"""
