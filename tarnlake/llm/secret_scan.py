"""Secret scan with corpus-wide ownership frequency.

Each text gives base spans (three fixed patterns) and further candidates (long mixed tokens and key
material that the patterns leave out). The hash of every candidate's value is then counted over the
whole corpus by distinct repositories and owners, where all copies and near copies of a text count as one
holder. A value with more than ``MAX_OWNERS`` owners and more than ``MAX_REPOS`` repositories is a widely copied
example; one that stays with a single owner, or with few, and looks live (high entropy, no marks of a
sample) is a credential. Base spans always stay, with their verdict as a count; other candidates are
added as spans only where their ownership says credential.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm import lsh_forest
from tarnlake.llm import text as T
from tarnlake.session import materialize

#: A value is widely copied beyond both; the query and the pipeline use these.
MAX_OWNERS, MAX_REPOS = 4, 8
# The base kinds in their order, with the part of a match that is the value and its least length.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),
)
#: Further candidates, in their order after the base kinds.
MORE = (
    # The body is all up to the END line, headers included.
    ("pem", re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----(?=[^-]{16}|[^-]*-(?!----))(?:[^-]++|-(?!----))*+-----END [A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----")),
    ("signed", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("opaque", re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")),
)
KINDS = {k: i for i, k in enumerate([*(b[0] for b in BASE), *(m[0] for m in MORE)])}
#: Lines of encoded bytes hold a sample's marks by chance.
_ENCODED = re.compile(r"[A-Za-z0-9+/=]{40,}")
_SAMPLE = re.compile(r"example|sample|dummy|changeme|placeholder|your|xxxx|1234567|abcdef|test", re.I)
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
OUT = "id long, mark string, owner string, repo string, base_sha256 string, n_assign long, n_access long, n_hex long, base string, found array<struct<kind:string,start:int,end:int,h:long,live:boolean>>"
_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("h", pa.int64()), ("live", pa.bool_())]))


def live_looking(value: str) -> bool:
    """Whether a value could be a real credential: varied characters, no marks of a sample."""
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return bits >= 3.0 and not _SAMPLE.search(_ENCODED.sub("", value) if value.startswith("-----BEGIN") else value)


def _opaque(value: str) -> bool:
    """Upper and lower case and digits, as generated tokens have."""
    return any(c.isdigit() for c in value) and any(c.islower() for c in value) and any(c.isupper() for c in value)


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the base patterns by start, then kind."""
    out, low = [], text.lower()
    for kind, pattern, group, least in BASE:
        if kind == "assign" and not any(x in low for x in _NAMES) or kind == "access" and "AKIA" not in text:
            continue
        out += [(kind, m.start(), m.end(), m[group]) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(out, key=lambda s: (s[1], KINDS[s[0]]))


def _union(spans) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that some spans cover, in order."""
    starts, ends = [], []
    for s, e in sorted(spans):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def _touched(covered: tuple[list[int], list[int]], s: int, e: int, hold: bool) -> bool:
    """Whether a covered stretch overlaps s..e; those within it do not count if it may ``hold`` them."""
    starts, ends = covered
    i = bisect_right(ends, s)
    if not hold:
        return i < len(starts) and starts[i] < e
    j = bisect_left(starts, e) - 1
    return i < len(starts) and starts[i] < s or j >= 0 and ends[j] > e


def more_spans(text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """Candidates of the further kinds that no base span, nor one of an earlier kind, touches; key material may hold some."""
    out = []
    for kind, pattern in MORE:
        if kind == "pem" and "PRIVATE KEY-----" not in text or kind == "signed" and "eyJ" not in text:
            continue
        covered = _union((s, e) for _, s, e, _ in (*base, *out))
        found = [(kind, *m.span(), m[0]) for m in pattern.finditer(text) if kind != "opaque" or _opaque(m[0])]
        out += [x for x in found if not _touched(covered, x[1], x[2], kind == "pem")]
    return out


def join_spans(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _value_hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _scan(batches):
    for b in batches:
        rows = []
        for text in b["text"]:
            text = text.as_py() or ""
            base = base_spans(text)
            spans = [*base, *more_spans(text, base)]
            n = Counter(s[0] for s in base)
            joined = join_spans(s[:3] for s in base)
            rows.append((hashlib.sha256(joined.encode()).hexdigest(), n["assign"], n["access"], n["hex"], joined, [{"kind": k, "start": s, "end": e, "h": _value_hash(v), "live": live_looking(v)} for k, s, e, v in spans]))
        cols = list(zip(*rows)) if rows else [()] * 6
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), _FOUND)
        yield pa.RecordBatch.from_arrays([b["id"], b["mark"], b["owner"], b["repo"], *[pa.array(c, t) for c, t in zip(cols, kinds)]], ["id", "mark", "owner", "repo", "base_sha256", "n_assign", "n_access", "n_hex", "base", "found"])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None, max_owners: int = 1, max_repos: int | None = None) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_copied.

    ``spans`` lists kind:start:end (code points, end exclusive) by start, then kind. ``n_copied``
    counts spans whose value more than ``max_owners`` owners and more than ``max_repos`` repositories (as many, if not
    given) hold; ``n_owned`` counts the others that look live. Equal texts and near copies (five-word shingles, similarity
    0.8) are one holder, under their least owner and repository. ``most_repos`` counts repositories with
    all copies. The repository is ``repo_col``, or the owner where the table has none. Null and empty texts have no span; a null owner counts as one owner of its own; repeated
    rows repeat their results but count once as owners. An empty table gives no rows.
    """
    found, verdict = _verdicts(df, id_col, text_col, owner_col, repo_col, max_owners, max_repos)
    own = [F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256"]
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    # Rows without a candidate, most of all, need no verdict.
    none = found.where("size(found) = 0").select(*own, F.lit("").alias("spans"), *[F.lit(0).cast("long").alias(c) for c in _COUNTS])
    some = T.join_unique(found.where("size(found) > 0").select("mark", F.col("id").alias("deal"), *own), verdict, "mark", "deal")
    return none.unionByName(some.select("doc_id", *own[1:], F.coalesce("spans", F.lit("")).alias("spans"), *map(zero, _COUNTS)))


_COUNTS = ("n_owned", "n_copied", "most_repos")

def _mark(text):
    """A text's identity: spans are a function of the text and the corpus."""
    return F.concat_ws(":", F.xxhash64(text), F.hash(text), F.length(text))


def _held(each: DataFrame) -> DataFrame:
    """Owners and repositories of each value. Counted in steps: each meets only a partial count of a value that many rows hold."""
    held = each.groupBy("h", "owner", "repo").agg(F.count("*").alias("n"))
    held = held.groupBy("h", "owner").agg(F.count("*").alias("repos"))
    return held.groupBy("h").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))


def _holders(docs: DataFrame, each: DataFrame, beyond) -> DataFrame:
    """h, owners, repos, all_repos: by near-copy classes of texts wherever plain counts go beyond the limits.

    Classes can only lower a count, so values within the limits need none.
    """
    held = _held(each).withColumn("all_repos", F.col("repos"))
    many = held.where(beyond).select("h")
    # A value that a great many texts hold is dealt out by text.
    once = materialize(T.join_unique(each, many, "h", "mark", "inner").groupBy("h", "mark").agg(F.min(F.struct("owner", "repo")).alias("o")), "holders")
    if once.isEmpty():
        return held
    marks = once.select("mark").distinct()
    texts = docs.withColumn("mark", _mark(F.col("text"))).select("mark", "text").join(marks, "mark", "left_semi").dropDuplicates(["mark"])
    group = lsh_forest.near_duplicates(texts.select(F.xxhash64("mark").alias("doc_id"), "text")).select(F.col("doc_id").alias("own"), "component_id")
    one = once.join(group, F.xxhash64("mark") == F.col("own")).groupBy("h", "component_id").agg(F.min("o").alias("o")).select("h", "o.*")
    less = _held(one).select(F.col("h").alias("value"), F.col("owners").alias("fewer"), F.col("repos").alias("least"))
    return held.join(less, F.col("h") == F.col("value"), "left").select("h", F.coalesce("fewer", "owners").alias("owners"), F.coalesce("least", "repos").alias("repos"), "all_repos")


def _verdicts(df, id_col, text_col, owner_col, repo_col, max_owners, max_repos):
    docs = df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text"), F.coalesce(df[owner_col].cast("string"), F.lit("")).alias("owner"), F.coalesce(df[repo_col or owner_col].cast("string"), F.lit("")).alias("repo"))
    found = materialize(docs.withColumn("mark", _mark(F.col("text"))).mapInArrow(_scan, OUT), "secrets")
    each = found.where("size(found) > 0").select("mark", "owner", "repo", F.explode("found").alias("f")).select("mark", "owner", "repo", "f.*")
    copied = (F.col("owners") > max_owners) & (F.col("repos") > (max_owners if max_repos is None else max_repos))
    held = _holders(docs, each, copied)
    known = T.join_unique(materialize(each.dropDuplicates(["mark", "kind", "start"]), "spans"), held, "h", "mark", "inner")
    base = F.col("kind").isin(*[b[0] for b in BASE])
    owned = F.col("live") & ~copied
    order = F.create_map(*[x for k, i in KINDS.items() for x in (F.lit(k), F.lit(i))])
    span = F.struct("start", order[F.col("kind")].alias("o"), F.concat_ws(":", "kind", "start", "end").alias("s"))
    verdict = known.groupBy("mark").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(base | owned, span))), lambda x: x["s"]), ",").alias("spans"),
        F.count_if(owned).alias("n_owned"),
        F.count_if(copied).alias("n_copied"),
        F.max("all_repos").alias("most_repos"),
    )
    return found, materialize(verdict, "verdicts")


def _masked(text: pd.Series, spans: pd.Series) -> pd.Series:
    def one(t, listed):
        if t is None or not listed:
            return t
        out, at = [], 0
        for s, e in sorted((int(s), int(e)) for _, s, e in (x.split(":") for x in listed.split(","))):
            if s >= at:
                out += [t[at:s], "[SECRET]"]
            at = max(at, e)
        return "".join([*out, t[at:]])

    return pd.Series([one(t, x) for t, x in zip(text, spans)])


def mask(df: DataFrame, text_col: str = "text", max_owners: int = 1, max_repos: int | None = None, **columns: str) -> DataFrame:
    """The table with the characters of every reported span replaced by one marker; all rows and columns stay.

    Spans that overlap become one marker. Rows without a span, and null or empty texts, are unchanged.
    """
    _, verdict = _verdicts(df, columns.get("id_col", "doc_id"), text_col, columns.get("owner_col", "source"), columns.get("repo_col"), max_owners, max_repos)
    # The row travels as one column, so that no name of its own can clash.
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), _mark(df[text_col]).alias("mark"), df[columns.get("id_col", "doc_id")].alias("deal"))
    joined = T.join_unique(rows, verdict.where("spans <> ''").select("mark", "spans"), "mark", "deal")
    text = F.col("row").getField(text_col)
    masked = F.when(F.col("spans").isNull(), text).otherwise(F.pandas_udf(_masked, "string")(text, "spans"))
    return joined.select(*[(masked if c == text_col else F.col("row").getField(c)).alias(c) for c in df.columns])


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = T.documents(spark, sf_dir, "doc_id", "text", "source", "lang").withColumn("repo", F.concat_ws("/", "source", "lang"))
    return scan(docs, repo_col="repo", max_owners=MAX_OWNERS, max_repos=MAX_REPOS)
