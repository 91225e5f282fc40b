"""Quality rules whose cutoffs come with a risk bound, in DataFrame functions alone.

Each rule is a share in thousandths (symbols by word characters, capitals by word characters,
repeated words by words, repeated lines by lines) and rejects a document above a cutoff. Cutoffs are
chosen on labelled documents, none of which had a part in shaping a rule. The settings of a stratum are a sequence that is fixed
beforehand: all rules are off at first, and each step lowers one rule, in turn, to the next cutoff of its ladder. For a setting, the
number of good documents (quality 1) that any of its rules would reject is tested by the exact binomial tail against the allowed rate
``ALPHA``. Settings are tested in their order, each at ``DELTA`` divided by the number of strata, up to the first that fails; the last that
passed holds. A sequence that stops at its first failure needs no share for its other tests, so a wrong setting passes in a stratum with a probability of
at most DELTA / strata, and in any with at most DELTA (Bonferroni over strata): with probability 1 - DELTA the rules in use,
taken together, reject no more than ALPHA of any stratum's good documents. A stratum with fewer than
``log(DELTA / strata) / log(1 - ALPHA)`` good labels cannot pass any test; the output says so.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm import text as T
from tarnlake.session import materialize

ALPHA, DELTA = 0.03, 0.05
STRATA = ("en", "de", "fr", "es")
OTHER = "other"
#: Rule: (what counts, what it is a share of).
RULES = {"symbols": ("n_symbols", "word_chars"), "capitals": ("n_capitals", "word_chars"), "repeats": ("n_repeat_words", "n_words"), "lines": ("n_dup_lines", "n_lines")}
#: Each rule's cutoffs in thousandths, from the loosest on; as many for each.
LADDERS = {"symbols": (300, 200, 150, 100, 75, 50, 30, 20), "capitals": (900, 800, 700, 600, 500, 400, 300, 250), "repeats": (450, 400, 350, 300, 250, 200, 150, 100), "lines": (700, 600, 500, 400, 300, 250, 200, 150)}
STEPS = sum(map(len, LADDERS.values()))
_BLANK = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"


def _without(t: Column, chars: str) -> Column:
    return F.length(F.translate(t, chars, ""))


def measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` without its text, with n_words, word_chars, n_symbols, n_capitals, n_lines, n_dup_lines, n_repeat_words (long)."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    kept = [c for c in df.columns if c != text_col]
    d = df.select(*kept, t.alias("_t"))
    d = d.withColumn("_w", F.filter(F.split("_t", r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    d = d.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    # The window that begins at each word; the last two begin none.
    d = d.withColumn("_g", F.expr("slice(transform(_w, (x, i) -> xxhash64(x, get(_w, i + 1), get(_w, i + 2))), 1, greatest(size(_w) - 2, 0))"))
    d = d.withColumn("_s", F.expr("if(size(array_distinct(_g)) = size(_g), null, array_sort(transform(_g, (h, i) -> struct(h, i))))"))
    # Positions of windows that occur twice or more; each covers three words.
    d = d.withColumn("_p", F.expr("transform(filter(_s, (x, k) -> coalesce(x.h = get(_s, k - 1).h, false) or coalesce(x.h = get(_s, k + 1).h, false)), x -> x.i)"))
    covered = F.expr("size(array_distinct(flatten(transform(_p, x -> array(x, x + 1, x + 2)))))")
    long = lambda c, name: c.cast("long").alias(name)
    return d.select(
        *kept,
        long(F.size("_w"), "n_words"),
        long(_without(F.col("_t"), _BLANK), "word_chars"),
        long(F.length("_t") - _without(F.col("_t"), _SYMBOLS), "n_symbols"),
        long(F.length("_t") - _without(F.col("_t"), T.UPPER_LETTERS), "n_capitals"),
        long(F.size("_l"), "n_lines"),
        long(F.size("_l") - F.size(F.array_distinct("_l")), "n_dup_lines"),
        long(F.when(F.col("_s").isNull(), 0).otherwise(covered), "n_repeat_words"),
    )


def _log_factorial(x: Column) -> Column:
    """ln x! by Stirling's series at x + 8, less the eight logarithms between."""
    y = x + 8
    series = y * F.log(y) - y + F.log(y * 6.283185307179586) / 2 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5)))
    return series - reduce(lambda a, b: a + b, [F.log(x + i) for i in range(1, 9)])


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of n trials at rate p, exact to rounding where k is at most n * p (1 above, where no test passes).

    Terms are added from k down; those beyond twenty deviations are below any rounding and left off.
    """
    k, n = k.cast("double"), n.cast("double")
    top = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    steps = F.least(k, F.ceil(F.sqrt(k) * 20) + 200).cast("long")
    first = F.struct(F.exp(top).alias("t"), F.exp(top).alias("s"), k.alias("i"))

    def add(a, _):
        t = a["t"] * a["i"] / (n - a["i"] + 1) * ((1 - p) / p)
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"), (a["i"] - 1).alias("i"))

    total = F.aggregate(F.when(steps > 0, F.sequence(F.lit(1).cast("long"), steps)).otherwise(F.array().cast("array<bigint>")), first, add, lambda a: a["s"])
    return F.when(k > n * p, F.lit(1.0)).otherwise(total)


def _stratum(c: Column) -> Column:
    return F.when(c.isin(*STRATA), c).otherwise(F.lit(OTHER))


def _above(rule: str, cutoff: Column) -> Column:
    what, of = RULES[rule]
    return F.col(what) * 1000 > cutoff * F.col(of)


def _step(rule: str) -> Column:
    """The first setting at which the rule rejects a document: 1 is the loosest, beyond ``STEPS`` none."""
    place, cuts = list(RULES).index(rule), LADDERS[rule]
    passed = reduce(lambda a, b: a + b, [(~_above(rule, F.lit(c))).cast("int") for c in cuts])
    return F.when(passed < len(cuts), passed * len(RULES) + place + 1).otherwise(STEPS + 1)


def _cut(rule: str, setting: Column) -> Column:
    """The rule's cutoff in a setting; null where it is off."""
    place = list(RULES).index(rule)
    return F.when(setting > place, F.get(F.array(*[F.lit(c) for c in LADDERS[rule]]), F.floor((setting - place - 1) / len(RULES)).cast("int")))


def settings(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row for each stratum that has good labels: stratum, good_labels, setting (0: all rules off), and the cutoff of each rule.

    ``measured`` has doc_id, stratum and the measures. A document is good if its labels say quality 1 and none says 0. An id
    is one trial in its stratum, however many rows repeat it: rejected where any of them is.
    """
    good = labels.groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").alias("q")).where("q = 1")
    held = measured.join(good, F.col("doc_id") == F.col("label_id"))
    trials = held.groupBy("stratum", "doc_id").agg(F.min(F.least(*[_step(r) for r in RULES])).alias("step"))
    tests = F.array(*[F.struct(F.lit(i).alias("setting"), F.count_if(F.col("step") <= i).alias("k")) for i in range(1, STEPS + 1)])
    counted = trials.groupBy("stratum").agg(F.count("*").alias("n"), tests.alias("tests"))
    each = materialize(counted.select("stratum", "n", F.explode("tests").alias("x")).select("stratum", "n", "x.*"), "settings")
    # A later setting rejects all that an earlier one does: up to the last that passes, all pass.
    ok = binomial_tail(F.col("k"), F.col("n"), alpha) <= delta / (len(STRATA) + 1)
    chosen = each.groupBy("stratum").agg(F.first("n").alias("good_labels"), F.coalesce(F.max(F.when(ok, F.col("setting"))), F.lit(0)).alias("setting"))
    return chosen.select("stratum", "good_labels", "setting", *[_cut(r, F.col("setting")).alias(f"cut_{r}") for r in RULES])


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rejected_by, kept, stratum, setting, state.

    Words are ``[^\\x20\\x09-\\x0D]+``. A null or empty text has no words, lines or characters and fails the base
    rule of 50 words. Strata are the languages named in STRATA, all others and null together. ``state`` is ``on`` where a setting
    holds, ``few`` where the stratum has too few good labels for any, and ``off`` where even the loosest fails. Rows
    without an id are judged but never labelled; repeated rows repeat; labels of absent documents, null labels and other columns
    are ignored; an id with labels that differ counts as not good, and one that repeats is one trial. Without labels every rule is off. Empty tables give no rows.
    """
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), _stratum(docs[lang_col]).alias("stratum"))
    m = materialize(measures(d), "measures")
    # At most one row for each stratum.
    joined = m.join(F.broadcast(settings(m, labels, alpha, delta)), "stratum", "left").withColumn("setting", F.coalesce("setting", F.lit(0)))
    rejected = F.array_compact(F.array(*[F.when(_step(r) <= F.col("setting"), F.lit(r)) for r in RULES]))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    few = F.coalesce(F.pow(F.lit(1 - alpha), F.col("good_labels")) > delta / (len(STRATA) + 1), F.lit(True))
    state = F.when(F.col("setting") > 0, "on").when(few, "few").otherwise("off")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.array_join(rejected, ",").alias("rejected_by"), (~failed & (F.size(rejected) == 0)).alias("kept"), "stratum", "setting", state.alias("state"))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return judge(T.documents(spark, sf_dir, "doc_id", "text", "lang"), labels)


def _sql() -> str:
    rules, each = list(RULES), DELTA / (len(STRATA) + 1)
    # The first step at which a rule is broken: its ladder's cutoffs that are kept, in turns of all rules.
    step = lambda i, r: f"case when {RULES[r][0]} * 1000 > {LADDERS[r][-1]} * {RULES[r][1]} then len(list_filter({list(LADDERS[r])}, lambda c: {RULES[r][0]} * 1000 <= c * {RULES[r][1]})) * {len(rules)} + {i + 1} else {STEPS + 1} end"
    tail = f"case when k > n * {ALPHA} then 1.0 else list_sum(list_transform(generate_series(0, k), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA})))) end"
    return f"""
with d as (select doc_id, coalesce(text, '') as t, case when lang in {STRATA} then lang else '{OTHER}' end as stratum,
  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from documents),
g as (select doc_id, unnest(generate_series(1, len(w) - 2)) as i, w from d where len(w) > 2),
h as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as c from g),
r as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from h where c > 1) group by 1),
m as (select doc_id, stratum, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, length(regexp_replace(t, '[^A-Z]', '', 'g'))::bigint as n_capitals,
  len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words
  from d left join r using (doc_id)),
good as (select doc_id from labels group by 1 having min(quality) = 1),
s as (select *, {", ".join(f"{step(i, r)} as s_{r}" for i, r in enumerate(rules))} from m),
x as (select stratum, doc_id, min(least({", ".join(f"s_{r}" for r in rules)})) as step from s join good using (doc_id) group by 1, 2),
k as (select stratum, i as setting, count(*) as n, count(*) filter (step <= i) as k from x, (select unnest(generate_series(1, {STEPS})) as i) group by all),
cuts as (select stratum, n, coalesce(max(setting) filter ({tail} <= {each!r}), 0) as setting from k group by 1, 2),
j as (select s.*, coalesce(setting, 0) as setting, n from s left join cuts using (stratum)),
bad as (select *, array_to_string(list_filter([{", ".join(f"case when s_{r} <= setting then '{r}' end" for r in rules)}], lambda c: c is not null), ',') as by_ from j),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from bad)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, by_ as rejected_by, not base_failed and by_ = '' as kept, stratum, setting::int as setting,
  case when setting > 0 then 'on' when n is null or pow({1 - ALPHA!r}, n) > {each!r} then 'few' else 'off' end as state
from f
"""


OP10_SQL = _sql()
