import glob
import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import SCHEMA, corpus

from tarnlake.llm import collocations, html_extract, line_dedup, quality_resample, secret_scan, text, token_align, token_store, toxicity
from tarnlake.llm.bpe_segment import tokenizer_path

LOW = {i: i + 32 for i in range(65, 91)}
SHAPE = "doc_id long, text string, lang string, source string, id long, n long, value string"
A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def table(spark, rows):
    """(id, text, lang) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, "s", 1, 2, "x") for i, t, lang in rows], SHAPE).repartition(3)


def brute_lines(rows, least=40, documents=5):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                held.setdefault(key(line), set()).add(i)
    keeper = {k: max(ids, key=lambda i: (i is not None, i or 0)) for k, ids in held.items() if len(ids) >= documents}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def lines_corpus():
    r = random.Random(5)
    line = lambda: " ".join("".join(r.choice("abcdeéß") for _ in range(5)) for _ in range(9))
    common = [line() for _ in range(6)]
    rows = []
    for i in range(60):
        own = [line() for _ in range(r.randrange(0, 4))]
        own += [r.choice(["", "  ", "\t"]) + c.upper() * (r.random() < 0.3) + c * (r.random() < 0.5) + "\r" for c in common if r.random() < 0.2]
        own += [common[0]] * (i % 3 == 0)
        r.shuffle(own)
        rows.append((i, "\n".join(own)))
    edge = "é" * 39 + "x"
    rows += [(100 + k, f"{edge}\n{edge[:-1]}\nx") for k in range(5)] + [(200 + k, common[1] + "\n" + common[1]) for k in range(2)]
    rows += [(None, None), (None, common[0] + "\nown"), (300, ""), (301, None), (302, "\n\n"), (3, "again\n" + common[0]), (303, "\n".join(line() for _ in range(3000)) + "\n" + common[0])]
    return rows


@pytest.mark.parametrize("way", ["one filter", "many rounds", "joined"])
def test_lines_match_plain_counts(spark, monkeypatch, way):
    if way == "many rounds":
        monkeypatch.setattr(line_dedup, "ROUND_BITS", 4096)
    if way == "joined":
        monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", 0)
    rows = lines_corpus()
    got = line_dedup.drop_repeated_lines(table(spark, [(i, t, "en") for i, t in rows]))
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "text"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute_lines(rows)))
    assert sum(r[2] for r in brute_lines(rows)) > 40


def test_only_suspected_lines_are_shuffled(spark):
    """A line that one document has is hardly ever suspected; one that two have always is."""
    r = np.random.default_rng(0)
    keys = [r.bytes(16) for _ in range(20000)]
    rows = [(i, b"".join(keys[i * 100 : i * 100 + 100])) for i in range(200)] + [(500, b"".join(keys[:50])), (501, b"".join(keys[19990:]))]
    df = spark.createDataFrame(rows, "id long, keys binary").repartition(7)
    found = {(bytes(x.key), x.id) for x in line_dedup.suspected(df).collect()}
    twice = {(k, i) for i, own in ((500, keys[:50]), (501, keys[19990:])) for k in own} | {(k, j // 100) for j, k in enumerate(keys) if j < 50 or j >= 19990}
    assert twice <= found and len(found - twice) < 0.03 * len(keys)


def test_lines_of_an_empty_table(spark):
    assert line_dedup.drop_repeated_lines(spark.createDataFrame([], SCHEMA)).collect() == []


def brute_phrases(rows, least, most, top=2000):
    pieces = [(lang or "und", re.findall(r"[^\x20\x09]+", p)) for t, lang in rows for p in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOW))]
    f = Counter((lang, tuple(w[i : i + k])) for lang, w in pieces for k in range(1, most + 1) for i in range(len(w) - k + 1))
    n = Counter()
    for lang, w in pieces:
        n[lang] += len(w)
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in cand.items():
        if any(l2 == lang and len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (l2, q), b in cand.items()):
            continue
        score, k, left, right = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, left, right, n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(lang, i + 1, *x[1:]) for i, x in enumerate(own[:top])]
    return ranked


def phrases_corpus():
    r = random.Random(9)
    words = ["the", "The", "of", "a", "new", "york", "times", "big", "é", "zoo", "x1"]
    make = lambda n: "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n"]) for _ in range(n))
    rows = [(make(r.randrange(0, 60)), r.choice(["en", "de", None])) for _ in range(60)]
    rows += [("new york times " * 12, "en"), ("a a a a a a a a a a a a a a", "de"), ("The the x", None), (None, "en"), ("", None), (" \t\n.,;", "fr"), ("one two", "fr")]
    return [*rows, rows[0], rows[0], (make(4000), "en")]


@pytest.mark.parametrize(("most", "hot", "chunk"), [(3, 200_000, 400_000), (3, 7, 50), (2, 7, 1), (4, 25, 10)])
def test_phrases_match_plain_counts(spark, monkeypatch, most, hot, chunk):
    """Also with pivots that are dealt over many parts, groups that go on over batches, and other lengths."""
    monkeypatch.setattr(collocations, "HOT", hot)
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    rows = phrases_corpus()
    df = table(spark, [(i, t, lang) for i, (t, lang) in enumerate(rows)])
    got = collocations.collocations(df, most=most)
    want = brute_phrases(rows, 10, most)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 50


def test_the_best_phrases_of_each_language(spark):
    rows = phrases_corpus()
    df = table(spark, [(i, t, lang) for i, (t, lang) in enumerate(rows)])
    assert sorted(map(tuple, collocations.collocations(df, least=3, top=7).collect())) == sorted(brute_phrases(rows, 3, 3, 7))


def test_large_counts_score_exactly(spark):
    """Products beyond 64 bits."""
    a, left, right = 10**12 + 7, 3 * 10**12 + 1, 2 * 10**12 + 3
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    x = F.lit(1_000_000).cast("decimal(7,0)") * (collocations._decimal("a") * collocations._decimal("a"))
    got = df.withColumn("x", x).withColumn("y", collocations._decimal("l") * collocations._decimal("r")).select(F.expr("x div y")).first()[0]
    assert got == 10**6 * a * a // (left * right)


def test_phrases_of_empty_tables(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations.collocations(table(spark, [(1, None, None), (2, "one two three", "en")])).collect() == []


def test_fragments_that_collide_are_kept_apart(monkeypatch):
    monkeypatch.setattr(collocations.T, "mix", lambda x: x & np.uint64(3))
    rows = np.random.default_rng(1).integers(0, 4, (500, 3)).astype(np.int32)
    got, n, _ = collocations._merge(rows, np.ones(500, np.int64))
    want = Counter(map(tuple, rows.tolist()))
    assert {tuple(r): int(c) for r, c in zip(got.tolist(), n)} == want and len(got) == len(want)


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    ta, tb = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    plain = {c: b for b, c in token_align._byte_letters().items()}
    docs, count = [], Counter()
    for i, t in rows:
        none = (i, 0, 0, [], [])
        if not t:
            docs.append(none)
            continue
        own = (" " + t).encode()
        a = [(x, bytes(plain[c] for c in ta.id_to_token(x))) for x in ta.encode(" " + t, add_special_tokens=False).ids]
        b = [(x, bytes([int(tb.id_to_piece(x)[3:5], 16)]) if tb.is_byte(x) else tb.id_to_piece(x).replace("▁", " ").encode()) for x in tb.encode(t)]
        if b"".join(x for _, x in a) != own or b"".join(x for _, x in b) != own:
            docs.append(none)
            continue
        spans = []
        for side in (a, b):
            at = np.concatenate([[0], np.cumsum([len(x) for _, x in side])]).tolist()
            spans.append([(k, lo, hi) for (k, _), lo, hi in zip(side, at, at[1:])])
        links, j0 = [], 0
        for x, lo, hi in spans[0]:
            while spans[1][j0][2] <= lo:
                j0 += 1
            j = j0
            while j < len(spans[1]) and spans[1][j][1] < hi:
                links.append((x, spans[1][j][0]))
                j += 1
        count.update(links)
        cuts = sorted({s[2] for s in spans[0]} & {s[2] for s in spans[1]})
        groups = [[[k for k, lo, hi in side if u < hi <= v] for side in spans] for u, v in zip([0, *cuts], cuts)] if len(cuts) < 400 else None
        docs.append((i, len(a), len(b), cuts, links, groups))
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    out = []
    for i, na, nb, cuts, links, *groups in docs:
        digest = "" if not links else None if groups[0] is None else hashlib.sha256(";".join("|".join(",".join(map(str, s)) for s in g) for g in groups[0]).encode()).hexdigest()
        out.append((i, na, nb, len(cuts), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), digest))
    return out


def tokens_corpus():
    r = random.Random(2)
    odd = ["a▁b plain", "<|endoftext|> and <s> </s>", "tab\tnew\n\nline  two   spaces ", "naïve façade “quoted” – dash…", "Ուշ is old", "日本語のテキスト", "emoji 👩‍👩‍👧 ok", "\x00\x01 low", "x" * 3000, "don't we're I'LL", " lead", "  ", " nbsp em", "é combining", "ﬁ ligature ½ ²", "Ᲊ rare Ɤ letters", "-----=====", "1234567890123"]
    texts = [*odd, None, "", *(t for _, t, *_ in corpus()), "".join(r.choice("abc de\n,.é日👍") for _ in range(5000))]
    return [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(1, odd[1]), (2, None)]


def test_alignment_matches_plain_overlaps(spark):
    rows = tokens_corpus()
    got = token_align.align(table(spark, [(i, t, "en") for i, t in rows]), A, B).collect()
    want = brute_alignment(rows)
    plain = lambda rs, full: sorted(str(tuple(r)[: None if full else 7]) for r in rs)
    assert plain(got, False) == plain(want, False)
    digests = Counter(r[-1] for r in got)
    assert all(digests[r[-1]] for r in want if r[-1]) and digests[""] == sum(r[-1] == "" for r in want)
    assert sum(r[1] > 0 for r in want) > 50 and want[0][1] == 0


def test_groups_spell_the_digest(spark):
    df = table(spark, [(i, t, "en") for i, t in tokens_corpus()[:20]])
    digest = {r.doc_id: r.groups_sha256 for r in token_align.align(df, A, B).collect() if r.doc_id is not None and r.doc_id != 2}
    for r in token_align.groups(df, A, B).collect():
        if r.doc_id in digest:
            text = ";".join(",".join(map(str, g.a)) + "|" + ",".join(map(str, g.b)) for g in r.groups)
            assert digest[r.doc_id] == (hashlib.sha256(text.encode()).hexdigest() if text else "")


def test_alignment_of_an_empty_table(spark):
    assert token_align.align(spark.createDataFrame([], SCHEMA), A, B).collect() == []


def test_pipeline_keeps_one_text_of_an_id(spark):
    """Of an id's rows one stands for it, whichever order they come in; equal rows stay once, rows without an id stay."""
    import corpus_pipeline

    r = random.Random(1)
    base, other, third = (" ".join(f"w{r.randrange(10**6)}" for _ in range(60)) for _ in range(3))
    rows = [(1, base), (2, other), (2, base), (3, third), (3, third), (4, base + " x"), (None, base), (None, base)]
    found = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string").repartition(2)
        found.append(sorted(corpus_pipeline.near_dedup(spark, df, "").collect(), key=str))
    assert found[0] == found[1]
    ids = [x.doc_id for x in found[0]]
    texts = {x.doc_id: x.text for x in found[0] if x.doc_id is not None}
    assert ids.count(None) == 2 and ids.count(1) == 1 and ids.count(3) == 1 and 4 not in ids and texts[1] == base
    # Where its copy of another's text stands for it, the id goes with that text.
    assert texts.get(2, other) == other


def test_pipeline_masks_beside_columns_of_any_name(spark):
    import corpus_pipeline

    df = spark.createDataFrame([(1, "password = abcdefgh12345678", "en", "s", 1, "own/repo", "m", "s")], "doc_id long, text string, lang string, source string, n_chars long, _repo string, mark string, spans string")
    (row,) = corpus_pipeline.secrets(spark, df, "").collect()
    assert row._repo == "own/repo" and row.mark == "m" and row.spans == "s" and "abcdefgh" not in row.text and row.n_chars == len(row.text)


_STORY = ["A long paragraph of the story says a good deal about what went on that day, and who was there to see it happen. " * 3, "Another one, with <a href='/x'>a link</a> in the middle, goes on about it for long enough to count as prose. " * 3, "The last one ends it all with some words about the weather, which was fine the whole week before it turned. " * 3]
_PAGES = {
    "list of stories": "<article><h1>Title</h1><p>{0}</p><div><ul>" + "".join(f"<li><a href='/{i}'>Story number {i}</a></li>" for i in range(12)) + "</ul></div><p>{1}</p><ul><li>milk</li><li>eggs</li></ul><p>{2}</p></article>",
    "share row": "<main><h1>Title</h1><p>{0}</p><p>{1}</p><div><a href='#'>Share</a> | <a href='#'>Mail</a> | <a href='#'>Print</a></div><p>{2}</p><ul><li>milk</li><li>eggs</li></ul></main>",
    "one link stays": "<article><h1>Title</h1><p>{0}</p><p><a href='/report'>The whole report</a></p><p>{1}</p><p>{2}</p></article>",
    "plain list stays": "<article><h1>Title</h1><p>{0}</p><ul><li>milk</li><li>eggs</li><li>flour</li><li><a name='n'>salt</a></li></ul><p>{1}</p><p>{2}</p></article>",
}


@pytest.mark.parametrize("name", _PAGES)
def test_regions_decide_about_links_inside_an_article(name, monkeypatch):
    """Without classes or element names the smoothed ratios tell a block of links from short lines; with the ratios flat, so that there are no regions, they all stay."""
    page = "<html><body>" + _PAGES[name].format(*_STORY) + "</body></html>"
    text, _, _ = html_extract.main_text(page)
    plain = [re.sub("<[^>]*>", "", x).strip() for x in _STORY]
    blocks = text.split("\n\n")
    assert [b for b in blocks if len(b) > 100] == plain and blocks[0] == "Title"
    extra = [b for b in blocks[1:] if len(b) <= 100]
    want = {"list of stories": ["milk", "eggs"], "share row": ["milk", "eggs"], "one link stays": ["The whole report"], "plain list stays": ["milk", "eggs", "flour", "salt"]}
    assert extra == want[name]
    monkeypatch.setattr(html_extract, "ratios", lambda lines: np.ones(len(lines)))
    off, _, _ = html_extract.main_text(page)
    assert (off != text) == (name in ("list of stories", "share row"))
    assert html_extract.main_text("<body><ul><li><a href='/1'>one</a></li><li><a href='/2'>two</a></li><li><a href='/3'>three</a></li></ul></body>")[0] == "one\n\ntwo\n\nthree"


def test_a_value_in_half_of_all_texts_is_dealt_out(spark, monkeypatch):
    """One value in many texts of many owners: called copied, its rows in many parts of the join, the other values as they are."""
    pem = lambda x: f"-----BEGIN RSA PRIVATE KEY-----\n{x * 8}\n-----END RSA PRIVATE KEY-----"
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(i, f"{body(i)} {pem('QUJDREVG')} {body(i + 1000)}", f"owner{i % 40}") for i in range(160)] + [(1000 + i, f"{body(i + 5000)} {pem(f'Uniq{i:04d}')}", "one") for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("repo", F.concat("source", F.lit("/x")))
    plain_rows = {r.doc_id: r.spans for r in secret_scan.scan(df, repo_col="repo", max_owners=4, max_repos=8).collect()}
    monkeypatch.setattr(text, "SALTS", 4)
    parts = []
    real = text.join_unique
    monkeypatch.setattr(secret_scan.T, "join_unique", lambda rows, *a, **k: parts.append(a[1]) or real(rows, *a, **k))
    got = {r.doc_id: r.spans for r in secret_scan.scan(df, repo_col="repo", max_owners=4, max_repos=8).collect()}
    assert got == plain_rows and parts.count("h") == 2
    assert all("pem" not in got[i] for i in range(160)) and all("pem" in got[1000 + i] for i in range(160))


def test_decoding_finds_the_likeliest_of_all_readings():
    """The Viterbi path scores as well as the best of every reading of the lattice, spelt out one by one."""
    sample = "you are an idiot and a dumb ass so go away you worthless piece of sad stupid luggage because the hello bell rang "
    c = toxicity._CLASS[np.frombuffer((sample * 20).encode(), np.uint8)]
    model = toxicity.CharModel(np.bincount(c[:-2] * 784 + c[1:-1] * 28 + c[2:], minlength=28**3))

    def value(reading, cost):
        a = b = 0
        for x in reading:
            k = model.code(x)
            cost += model.log[a][b][k]
            a, b = b, k
        return cost + model.log[a][b][0]

    def readings(seen, spaced):
        runs = [(c, len(list(g))) for c, g in itertools.groupby(seen)]
        choices = []
        for at, (c, n) in enumerate(runs):
            own = [(x * k, -0.7 * (n > 2)) for x in toxicity.LEET.get(c, c) for k in ((1,) if n == 1 else (1, 2))]
            if spaced:
                own += [(x * i + " " + x * j, -0.7 * (n > i + j)) for x in toxicity.LEET.get(c, c) for i in (1, 2) for j in (1, 2) if i + j <= n]
                own += [(" " + t, cost) for t, cost in own] if at else []
            choices.append(own)
        for pick in itertools.product(*choices):
            yield "".join(t for t, _ in pick), sum(cost for _, cost in pick)

    r = random.Random(3)
    for k in range(60):
        seen = "".join(r.choice("1do1t0us4l$$e!b|") for _ in range(r.randrange(2, 7)))
        spaced = bool(k % 2)
        every = list(readings(seen, spaced))
        best = max(value(t, cost) for t, cost in every)
        got = model.decode(seen, spaced)
        assert max(value(t, cost) for t, cost in every if t == got) == pytest.approx(best)


@pytest.mark.parametrize(("encoding", "named"), [("delta", "DELTA_BINARY_PACKED"), ("dictionary", "RLE_DICTIONARY")])
def test_token_files_have_the_encodings_groups_and_indexes_asked_for(spark, tmp_path, monkeypatch, encoding, named):
    """What the footers say, and that a look at lengths or at one document reads few bytes and few rows."""
    import pyarrow.parquet as pq

    from tarnlake.operators.layout import rows_read

    monkeypatch.setattr(token_store, "ROW_GROUP", 64 << 10)
    monkeypatch.setattr(token_store, "PAGE", 4 << 10)
    r = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(f"w{r.randrange(500)}" for _ in range(r.randrange(1, 120)))) for i in range(3000)], "doc_id long, text string").repartition(2)
    out = str(tmp_path / "tokens")
    token_store.write_tokens(docs, out, tokenizer_path("word_bpe_49k.json"), encoding=encoding)
    groups = rows = 0
    for f in glob.glob(f"{out}/part-*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.row_group(g).num_columns)}
            ids = next(c for n, c in columns.items() if n.startswith("ids"))
            assert named in ids.encodings and ids.compression == "ZSTD"
            assert columns["doc_id"].has_offset_index and columns["doc_id"].has_column_index and columns["doc_id"].statistics.has_min_max
            # A column's own bytes: lengths alone are read without the ids.
            assert columns["n_tokens"].total_compressed_size < 0.2 * ids.total_compressed_size
            groups += 1
        rows += meta.num_rows
    assert rows == 3000 and groups > 4
    stored = token_store.read_tokens(spark, out)
    (row,), read = rows_read(stored.where("doc_id = 1234").select("doc_id", "n_tokens"))
    assert row.doc_id == 1234 and read < 0.35 * 3000
    plan = stored.where("doc_id = 1234").select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,n_tokens:int>" in plan


def test_the_quality_stage_keeps_what_resampling_keeps(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    want = {r.doc_id for r in quality_resample.resample(docs, labels).collect() if r.kept}
    got = corpus_pipeline.quality(spark, docs, sf)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == want and len(want) < docs.count()
