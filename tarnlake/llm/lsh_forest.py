"""Near-duplicate groups by an LSH forest: sorted MinHash signature orders with adaptive prefix depth.

A document's set holds the hashes of its distinct word shingles. Equal sets form one class, and only
one document of each class goes on. Each of several orders reads the signature's values in a sequence of its own; documents
with the same first ``DEPTH`` values are a region of that order.

*Neighbours.* Every order is sorted by region and then by the values that follow. Within a region a document's neighbours in that
sequence, ``WINDOW`` to either side, are those with the longest common prefixes. In each of ``ROUNDS`` it is linked, after a look at the full
sets, to the one of them in another component that comes first in a common ranking, if their signatures agree. Most copies
are in one component after that, a group of thousands for a few links each.

*Regions.* Only regions that still hold several components are looked at again, whole: every pair of
different components whose agreement could still mean the threshold is decided on the full sets. A region with more than
``REGION`` documents (or ``WEIGHT`` shingles) is cut into blocks that those outside its main component all meet, if they are
no more than ``REGION``. Otherwise it goes deeper: its documents are placed anew by longer prefixes, 6 and then 12
values, in more orders, so that a pair at the threshold meets at each depth with probability above 1 - 1e-5. What is still too
large at the last depth meets in blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.llm import text as T
from tarnlake.operators.graph import connected_components
from tarnlake.session import materialize

SIZE, TREES, DEPTH, REGION, WEIGHT, WINDOW, ROUNDS = 128, 20, 3, 1000, 1 << 22, 8, 2
#: Longer prefixes of regions that are too large, and in how many orders.
DEEPER = ((6, 48), (12, 192))
#: Agreement below the threshold by this much rules a pair out (over three standard errors of SIZE values).
MARGIN, LABEL = 0.13, 16
_rng = np.random.default_rng(7)
_MULTIPLIERS = _rng.integers(1, 2**63, SIZE, dtype=np.uint64) * T.U(2) + T.U(1)
#: Each of the first orders begins at other positions, six of its own; further ones are any.
_ORDERS = [np.concatenate([own := np.arange(t * 6, t * 6 + 6), _rng.permutation(np.setdiff1d(np.arange(SIZE), own))])[:LABEL] for t in range(TREES)]
_ORDERS += [_rng.permutation(SIZE)[:LABEL] for _ in range(DEEPER[-1][1] - TREES)]


def _identity(own: np.ndarray) -> tuple[int, int]:
    """Two sums over a set's hashes; with its size they stand for the set."""
    return own.sum(dtype=np.uint64).astype(np.int64), T.mix(own ^ T.U(0x5DEECE66D)).sum(dtype=np.uint64).astype(np.int64)


def _sketch(width: int):
    def run(batches):
        for b in batches:
            for at, part in T.slices(b["text"]):
                w = T.Words(part)
                s, starts = T.shingle(w.hashes(), w.counts, w.first, width)
                size, h1, h2 = (np.zeros(w.rows, np.int64) for _ in range(3))
                for i in range(w.rows):
                    own = np.unique(s[starts[i] : starts[i + 1]])
                    size[i] = len(own)
                    h1[i], h2[i] = _identity(own)
                some = np.flatnonzero(np.diff(starts))
                sig = np.zeros((w.rows, SIZE), np.uint32)
                if len(some):
                    for k, m in enumerate(_MULTIPLIERS):
                        sig[some, k] = np.minimum.reduceat(s * m, starts[:-1][some]) >> T.U(32)
                keys = np.zeros((w.rows, TREES), np.int64)
                for t in range(TREES):
                    h = np.full(w.rows, t + 1, np.uint64)
                    for d in range(DEPTH):
                        h = T.mix(h * T._MULT + sig[:, _ORDERS[t][d]].astype(np.uint64))
                    keys[:, t] = h.view(np.int64)
                low = pa.array([x.astype(np.uint8).tobytes() for x in sig], pa.binary())
                yield pa.RecordBatch.from_arrays([b["id"].slice(at, w.rows), pa.array(size), pa.array(h1), pa.array(h2), low, T.lists(list(keys), pa.int64())], ["id", "n", "h1", "h2", "sig", "k"])

    return run


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity from the low bytes of two signatures, less chance hits."""
    return ((a == b).mean(-1) - 1 / 256) / (1 - 1 / 256)


def _regions(batches):
    """Whole regions, though they may span batches (rows come sorted by region)."""
    held = None
    for b in batches:
        held = b if held is None else pa.concat_batches([held, b])
        r = held["region"].to_numpy()
        if len(r) and r[0] != r[-1]:
            cut = int(np.searchsorted(r, r[-1]))
            yield held.slice(0, cut)
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held


def _possible(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _signatures(b) -> np.ndarray:
    return np.frombuffer(b"".join(b["sig"].to_pylist()), np.uint8).reshape(-1, SIZE)


def _groups(b):
    r = b["region"].to_numpy()
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(r)) + 1, [len(r)]])
    return [(lo, hi) for lo, hi in zip(cuts[:-1], cuts[1:]) if hi - lo > 1]


def _label(batches):
    """Adds the low bytes of the values that the row's order begins with."""
    for b in batches:
        sig = _signatures(b)
        label = np.take_along_axis(sig, np.array(_ORDERS)[b["tree"].to_numpy()], 1) if len(sig) else sig
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x.tobytes() for x in label], pa.binary())], [*b.schema.names, "label"])


def _neighbours(percent: int):
    """(x, y, rank): each document of a sorted order with one of the near ones around it.

    Where some agree by the threshold it is the first of them in a common ranking, else the one that agrees best.
    """
    low, high = percent / 100 - MARGIN, percent / 100

    def of(b):
        ids, n, sig, region, comp = b["id"].to_numpy(), b["n"].to_numpy(), _signatures(b), b["region"].to_numpy(), b["comp"].to_numpy()
        rank = T.mix(ids.view(np.uint64)) >> T.U(2)
        first, with_ = rank.copy(), ids.copy()
        lone = np.full(len(ids), T.U(2**63 - 1))
        for w in range(1, min(WINDOW, len(ids) - 1) + 1):
            a, c = np.arange(len(ids) - w), np.arange(w, len(ids))
            own = (region[a] == region[c]) & (comp[a] != comp[c]) & _possible(n[a], n[c], percent)
            a, c = a[own], c[own]
            e = _agreement(sig[a], sig[c])
            near, weak = e >= high, (e >= low) & (e < high)
            for x, y in ((a[near], c[near]), (c[near], a[near])):
                better = rank[y] < first[x]
                first[x[better]], with_[x[better]] = rank[y[better]], ids[y[better]]
                lone[x] = 0
            worth = T.U(2**62) + ((1 - e[weak]) * 2**60).astype(np.uint64)
            for x, y in ((a[weak], c[weak]), (c[weak], a[weak])):
                better = worth < lone[x]
                first[x[better]], with_[x[better]], lone[x[better]] = worth[better], ids[y[better]], worth[better]
        some = with_ != ids
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(with_[some]), pa.array(first[some].view(np.int64))], ["x", "y", "rank"])

    def run(batches):
        held = None
        for b in batches:
            # The last rows of a batch are also neighbours of the next one's first.
            if b.num_rows:
                held = b if held is None else pa.concat_batches([held, b])
                yield of(held)
                held = held.slice(max(0, held.num_rows - WINDOW))

    return run


def _deep_keys(depth: int, orders: int):
    """(region, id, n, comp): the regions of longer prefixes, from the signatures' low bytes."""

    def run(batches):
        for b in batches:
            sig = _signatures(b).astype(np.uint64)
            keys = np.zeros((len(sig), orders), np.int64)
            for t in range(orders):
                h = np.full(len(sig), (t + 1) * 1000 + depth, np.uint64)
                for d in range(depth):
                    h = T.mix(h * T._MULT + sig[:, _ORDERS[t][d]])
                keys[:, t] = h.view(np.int64)
            each = [pa.array(np.repeat(b[c].to_numpy(), orders)) for c in ("id", "n", "comp")]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *each], ["region", "id", "n", "comp"])

    return run


def _decide(percent: int):
    """(a, b): links on full sets that join components within a region."""
    low = percent / 100 - MARGIN

    def of(ids, n, sig, comp, flat, starts):
        _, flat = np.unique(flat, return_inverse=True)
        mark = np.zeros(int(flat.max()) + 1, bool)
        comp = comp.copy()
        for i in range(len(ids) - 1):
            j = np.flatnonzero((comp[i + 1 :] != comp[i]) & _possible(n[i + 1 :], n[i], percent)) + i + 1
            j = j[_agreement(sig[j], sig[i]) >= low]
            if not len(j):
                continue
            own = flat[starts[i] : starts[i + 1]]
            mark[own] = True
            take = np.concatenate([flat[starts[k] : starts[k + 1]] for k in j])
            both = np.add.reduceat(mark[take].astype(np.int64), np.concatenate([[0], np.cumsum(n[j])[:-1]]))
            mark[own] = False
            for k in j[100 * both >= percent * (n[j] + n[i] - both)]:
                if comp[k] != comp[i]:
                    comp[comp == comp[k]] = comp[i]
                    yield min(ids[i], ids[k]), max(ids[i], ids[k])

    def run(batches):
        for b in _regions(batches):
            ids, n, sig, comp = b["id"].to_numpy(), b["n"].to_numpy(), _signatures(b), b["comp"].to_numpy()
            flat, starts = b["s"].flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(b["s"]).to_numpy())])
            out = [p for lo, hi in _groups(b) if (comp[lo:hi] != comp[lo]).any() for p in of(ids[lo:hi], n[lo:hi], sig[lo:hi], comp[lo:hi], flat[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo])]
            x, y = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    return run


def _shingles(width: int):
    def run(batches):
        last = None
        for b in batches:
            for at, sets in T.shingle_sets(b["text"], width):
                key = [(i, *_identity(x)) for i, x in zip(b["id"].slice(at, len(sets)).to_pylist(), sets)]
                # Rows come sorted by id: of repeated rows one goes on.
                keep = [k for k in range(len(sets)) if key[k] != (key[k - 1] if k else last)]
                last = key[-1]
                yield pa.RecordBatch.from_arrays([pa.array([key[k][1] for k in keep], pa.int64()), pa.array([key[k][2] for k in keep], pa.int64()), T.lists([T.signed(sets[k]) for k in keep], pa.int64())], ["h1", "h2", "s"])

    return run


def _confirm(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a < b) whose full sets reach the threshold."""
    p = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct()
    one, two = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    joined = p.hint("merge").join(one, "a").hint("merge").join(two, "b").select("a", "b", both.alias("i"), (F.size("sa") + F.size("sb")).alias("t"))
    return materialize(joined.where(F.expr(f"100L * i >= {percent}L * (t - i)")).select("a", "b"), "links")


def _joined(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components after further links; only those that a link joins are looked at again."""
    if comp is None:
        return connected_components(links)
    at = lambda side: comp.select(F.col("id").alias(side), F.col("component").alias(f"c{side}"))
    ends = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct()
    more = connected_components(ends)
    moved = T.join_unique(comp, more.select(F.col("id").alias("component"), F.col("component").alias("next")), "component", "id")
    first = more.join(comp.select("id"), "id", "left_anti").select("id", "component")
    return materialize(moved.select("id", F.coalesce("next", "component").alias("component")).unionByName(first), "components")


FITS = f"n1 <= {REGION} and (w1 <= {WEIGHT} or n1 <= 2)"


def _outside(d: DataFrame) -> DataFrame:
    """(k1, main, inside, outside): regions (k1, id, comp) of several components, the main one, and how many documents it holds and does not."""
    each = d.groupBy("k1", "comp").agg(F.count("*").alias("n"))
    main = each.groupBy("k1").agg(F.max_by("comp", F.struct("n", F.negate("comp"))).alias("main"), F.max("n").alias("inside"), F.sum("n").alias("all"))
    return main.where("all > inside").select("k1", "main", "inside", (F.col("all") - F.col("inside")).alias("outside"))


def _blocks(d: DataFrame, main: DataFrame) -> DataFrame:
    """(region, id): every pair of a region of ``main`` that has a document outside its main component meets in some block.

    Those outside are dealt into blocks of REGION, and so are the main component's; each outside block meets every other
    and every main one. With no more than REGION outside, a document of the main component is in one block.
    """
    size = lambda n: F.expr(f"cast(greatest(1, ceil({n} / {REGION})) as int)")
    d = T.join_unique(d, main.select("k1", "main", size("outside").alias("outs"), size("inside").alias("ins")), "k1", "id", "inner")
    outside = d.where("comp <> main").withColumn("own", F.expr("pmod(xxhash64(id, 1), cast(outs as bigint))"))
    inside = d.where("comp = main").withColumn("own", F.expr("pmod(xxhash64(id, 1), cast(ins as bigint))"))
    key = lambda kind, a, b: F.xxhash64("k1", F.lit(kind), a, b).alias("region")
    q = F.col("q").cast("long")
    among = outside.withColumn("q", F.explode(F.expr("sequence(0, outs - 1)"))).select(key(1, F.least("own", q), F.greatest("own", q)), "id")
    out = outside.withColumn("q", F.explode(F.expr("sequence(0, ins - 1)"))).select(key(2, F.col("own"), q), "id")
    met = inside.withColumn("q", F.explode(F.expr("sequence(0, outs - 1)"))).select(key(2, q, F.col("own")), "id")
    return among.unionByName(out).unionByName(met).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    A-Z is lower-cased and words are runs of other than white space. The set holds the distinct
    ``width``-word shingles; with fewer words the whole sequence is the one shingle; a null or empty
    text (or one of white space) has an empty set and links with nothing. Documents with
    ``100 * intersection >= percent * union`` are linked, and ``component_id`` is the smallest id
    reachable. ``kept`` marks the rows that stay: those whose id is their group's. Rows that repeat
    an id stand for themselves, each with the component of its own text. A row without an id links
    nothing, has a null component_id and stays. An empty table gives no rows; other columns are ignored.
    """
    docs = T.pick(df, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    sk = materialize(docs.mapInArrow(_sketch(width), "id long, n long, h1 long, h2 long, sig binary, k array<long>"), "sketches")
    classes = sk.where("n > 0 and id is not null").groupBy("h1", "h2", "n").agg(F.min_by(F.struct(F.col("id").alias("doc"), "sig", "k"), "id").alias("r"))
    classes = materialize(classes.select(F.xxhash64("h1", "h2", "n").alias("id"), "n", "r.*"), "classes")
    trees = classes.select("id", "n", F.posexplode("k").alias("tree", "region"))
    held = trees.groupBy("region").agg(F.count("*").alias("n1"), F.sum("n").alias("w1")).where("n1 > 1")
    placed = T.join_unique(trees, held, "region", "id", "inner").join(classes.select("id", "sig"), "id")
    rows = materialize(placed.mapInArrow(_label, "id long, region long, n long, tree int, n1 long, w1 long, sig binary, label binary"), "regions")
    need = classes.join(rows.select("id").distinct(), "id", "left_semi").select(F.col("doc").alias("need")).distinct().hint("merge")
    text = docs.join(need, docs.id == need.need, "left_semi")
    sets = materialize(text.mapInArrow(_shingles(width), "h1 long, h2 long, s array<long>").withColumn("n", F.size("s").cast("long")).select(F.xxhash64("h1", "h2", "n").alias("id"), "s"), "sets")

    def with_comp(d: DataFrame, comp: DataFrame | None) -> DataFrame:
        if comp is None:
            return d.withColumn("comp", F.col("id"))
        c = comp.select(F.col("id").alias("cid"), "component")
        return d.join(c, F.col("id") == F.col("cid"), "left").select(*d.columns, F.coalesce("component", "id").alias("comp"))

    def decide(d: DataFrame) -> DataFrame:
        """Links within regions (region, id, n, comp) of bounded size that hold several components."""
        # A region holds no more than FITS allows, and one shuffle tells which hold several components.
        w = Window.partitionBy("region")
        open_ = d.withColumn("lo", F.min("comp").over(w)).withColumn("hi", F.max("comp").over(w)).where("lo < hi").drop("lo", "hi")
        wide = open_.join(classes.select("id", "sig"), "id").hint("merge").join(sets, "id").select("region", "id", "n", "sig", "comp", "s")
        return materialize(wide.repartition("region").sortWithinPartitions("region", "id").mapInArrow(_decide(percent), "a long, b long").distinct(), "more")

    comp = None
    for _ in range(ROUNDS):
        # Any number of a region's documents may be of one partition: the range is cut by the whole order.
        order = with_comp(rows.select("region", "label", "id", "n", "sig"), comp).repartitionByRange("region", "label", "id").sortWithinPartitions("region", "label", "id")
        near = order.mapInArrow(_neighbours(percent), "x long, y long, rank long").groupBy("x").agg(F.min_by("y", F.struct("rank", "y")).alias("y"))
        comp = _joined(comp, _confirm(sets, near, percent))
    comp = _joined(comp, decide(with_comp(rows.where(FITS).select("region", "id", "n"), comp)))
    large = rows.where(f"not ({FITS})").select(F.col("region").alias("k1"), "id", "n")
    for depth, orders in (*DEEPER, (None, None)):
        c = with_comp(large, comp)
        main = materialize(_outside(c), "outside")
        # A few documents outside meet all of the region at once; where there are many, the region goes deeper.
        few = main.where(F.col("outside") <= REGION) if depth else main
        if not few.isEmpty():
            met = _blocks(c.select("k1", "id", "comp"), few)
            comp = _joined(comp, decide(with_comp(met.join(classes.select("id", "n"), "id"), comp)))
        left = materialize(T.join_unique(c, main.where(F.col("outside") > REGION).select("k1"), "k1", "id", "inner").select("id", "n").distinct(), "deeper") if depth else None
        if left is None or left.isEmpty():
            break
        keys = with_comp(left, comp).join(classes.select("id", "sig"), "id")
        keys = materialize(keys.mapInArrow(_deep_keys(depth, orders), "region long, id long, n long, comp long"), "deep")
        held = keys.groupBy("region").agg(F.count("*").alias("n1"), F.sum("n").alias("w1"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").drop("lo", "hi")
        keys = materialize(T.join_unique(keys, held, "region", "id", "inner"), "deep")
        comp = _joined(comp, decide(keys.where(FITS).select("region", "id", "n", "comp")))
        large = keys.where(f"not ({FITS})").select(F.col("region").alias("k1"), "id", "n")
    named = classes.select("id", "doc").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    named = named.join(least, "component").select("id", "component_id")
    own = sk.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.xxhash64("h1", "h2", "n")).alias("id"))
    own = own.join(named, "id", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return own.select("doc_id", "n_shingles", "component_id", (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"))


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(T.documents(spark, sf_dir, "doc_id", "text"), width=4, percent=80)


OP4_SQL = f"""
with recursive d as (select doc_id, {T.SQL_WORDS} as w from documents),
g as (select distinct doc_id, unnest(case when len(w) >= 4 then list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from d),
n as (select doc_id, count(*) as n from g group by 1),
c as (select doc_id, md5(string_agg(s, chr(10) order by s)) as k from g group by 1),
r as (select k, min(doc_id) as rep from c group by 1),
gr as (select g.doc_id, s from g join r on g.doc_id = r.rep),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from gr a join gr b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
l as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * i >= 80 * (x.n + y.n - i)),
e as (select a, b from l union select b, a from l),
walk(id, seen) as (select rep, rep from r union select e.b, walk.seen from walk join e on e.a = walk.id),
f as (select id, min(seen) as component from walk group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(f.component, d.doc_id)::bigint as component_id, d.doc_id = coalesce(f.component, d.doc_id) as kept
from d left join n on n.doc_id = d.doc_id left join c on c.doc_id = d.doc_id left join r on r.k = c.k left join f on f.id = r.rep
"""
