import hashlib
import itertools
import random
import string
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from opticframe.llm import common, embed_dedup, graph_ann, mixing, packing, quality, sharding, simhash, unigram, url_filter, wavelet
from opticframe.llm.tokens import TextEncoder, vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, rank int, n string, block string"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and very long texts, repeated rows, copies, and columns whose names clash with our own."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n)) + ".\n"
    rows = [(i, text(rng.randint(1, 400)), "en", f"s{i % 3}") for i in range(120)]
    rows += [(200, None, None, None), (201, "", "en", "s0"), (202, "   \n\t ", "en", "s1"), (203, text(20_000), "en", "s1"), (None, "no id here", None, "s2"), (5, rows[5][1], "en", "s2"), (5, rows[5][1], "en", "s2")]
    rows += [(300 + i, rows[7][1], "fr", "s0") for i in range(40)] + [(400, rows[8][1] + " end", "en", "s0"), (401, "GERÇEKTEN MI? EVET, İYİ.", "tr", "s0")]
    return spark.createDataFrame([(*r, None, "x", 1, "y", "z") for r in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def library_ids(texts):
    """Ids of whole texts by the tokenizers library alone."""
    from tokenizers import Tokenizer

    return [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(vocabulary()).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def encoded(enc, texts):
    ids, at = enc.encode(texts)
    return [ids[a:b].astype("<u4").tobytes() for a, b in zip(at[:-1], at[1:])]


def test_encoder_splits_only_where_the_library_does():
    enc = TextEncoder(vocabulary())
    letters = [c for c in map(chr, range(0x600)) if c.isalpha()]
    words = [a + c + s for c in letters for s in ["", *string.punctuation, ".)", "!?"] for a in ("", "ab")]
    words += ["BELKİ.", "İ-", "İİ,", "aİb.", "GERÇEKTEN MI? EVET, İYİ.", "i\u0307.", "ﬁ.", "ΑΣ.", "Σ", "Å.", "e\u0301,", "ab\u0301c!"]
    assert encoded(enc, words) == library_ids(words)
    rng = random.Random(31)
    pool = letters + list(string.punctuation + string.digits) * 6 + ["İ"] * 20 + list("\u0301\u0307\u0327 \n\t\x0b\x85\xa0漢ǅ٣²")
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(20_000)]
    assert encoded(enc, texts) == library_ids(texts)


def test_encoder_forgets_and_relearns(monkeypatch):
    from opticframe.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_WORDS", 50)
    monkeypatch.setattr(tokens, "CACHE_BYTES", 8)
    monkeypatch.setattr(tokens, "RUN", 7)
    enc, rng = TextEncoder(vocabulary()), random.Random(32)
    words = ["".join(rng.choice("abcdé1İ'") for _ in range(rng.randint(1, 12))) + rng.choice(["", ".", "!?"]) for _ in range(300)]
    for _ in range(20):
        texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 5))] + [None] * rng.randint(0, 1)
        assert encoded(enc, texts) == library_ids(texts)
    ids, at = enc.encode(["a b", None, "c"], 7)
    assert ids[at[1:] - 1].tolist() == [7] * 3 and np.diff(at).tolist() == [3, 1, 2] and enc.encode([], 7)[1].tolist() == [0]


def test_encoder_equals_whole_texts(docs):
    enc = TextEncoder(vocabulary())
    texts = [r["text"] or "" for r in docs.collect()] + ["Don't <|endoftext|> a<|startoftext|>b X<|ENDOFTEXT|> it's,", "İΣ é ́x\x1c\x85b 漢字,a 12a3 ²x", "n''t 'S 's.' a_b??c", "x" * 3000]
    want = enc.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.array(w.ids, "<u4").tobytes() for w in want] == encoded(enc, texts)


def test_trees_learn_and_flat_walk_is_right():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    trees = quality.grow(x[:2000], y[:2000])
    assert ((trees.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97

    def walk(row):
        raw = trees.base
        for f, c, leaf in zip(trees.feature, trees.cut, trees.leaf):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + int(row[f[at]] > c[at])
            raw += leaf[at - len(f)]
        return 1 / (1 + np.exp(-raw))

    assert np.allclose([walk(r) for r in x[:20]], trees.score(x[:20]))


def test_quality_edges(spark, docs, none):
    labels = docs.selectExpr("doc_id", "cast(length(text) > 800 as int) quality")
    trees = quality.fit(docs, labels)
    out = quality.score(docs, trees).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    ids = [r["doc_id"] for r in out if r["doc_id"] is not None]
    assert {r["doc_id"]: r["held_out"] for r in out if r["doc_id"] is not None} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in ids}
    assert quality.score(none, trees).count() == 0
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, labels.where("false"))).collect()} == {0.5}
    assert quality.accepted(docs, trees).columns == docs.columns


def test_automaton_equals_regex():
    import re

    globs = ["*.com/a**", "**z?", "a*b*c", "**/x/**", "\\*lit", "?", "**"]
    turn = lambda g: re.compile(re.sub(r"\\\\\\\*|\\\*\\\*|\\\*|\\\?", lambda m: {"\\\\\\*": r"\*", "\\*\\*": "(?s:.*)", "\\*": "[^/]*", "\\?": "[^/]"}[m[0]], re.escape(g)))
    rng = random.Random(3)
    texts = ["", "a", "*lit", ".com/a", "x.com/ab/c", "abc"] + ["".join(rng.choice("abcxz./") for _ in range(rng.randint(0, 90))) for _ in range(500)]
    got = url_filter.Automaton(globs * 12).match([t.encode() for t in texts])  # several words
    want = np.array([[bool(turn(g).fullmatch(t)) for g in globs * 12] for t in texts])
    assert (got == want).all()


def test_url_edges(spark):
    rules = [url_filter.Rule.host_path("block", "net/de/"), url_filter.Rule.host_path("allow", "a.net/de/8")]
    rows = [(1, "http://A.NET/de/8?x"), (2, "https://b.net/de/"), (3, "http://xnet/de/"), (4, None), (5, "no scheme"), (6, "ftp://net"), (6, "ftp://net#/de/")]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, host string, verdict string")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, rules).collect()}
    assert got == {(1, "a.net", "/de/8", "a.net/de/8", "allow"), (2, "b.net", "/de/", "net/de/", "block"), (3, "xnet", "/de/", None, "allow"), (4, "", "", None, "allow"), (5, "", "", None, "allow"), (6, "net", "", None, "allow")}
    long = "http://net/" + "a/" * 10_000
    few = spark.createDataFrame([(1, long + "z"), (2, "http://" + "h" * 20_000 + ".net/de/"), (3, "http://net/de/" + "a" * 20_000)], "page_id long, url string")
    judged = url_filter.judge(few, rules).collect()
    assert [(r["page_id"], r["verdict"], len(r["path"])) for r in sorted(judged, key=lambda r: r["page_id"])] == [(1, "allow", 20_002), (2, "block", 4), (3, "block", 20_004)]
    assert url_filter.judge(pages.where("false"), rules).count() == 0 and url_filter.judge(pages, []).count() == 7


def test_rules_for_a_host_alone(spark):
    rules = [url_filter.Rule.host_path("block", t) for t in ("Example.COM", "a.org/", "b.org/x*y", "c.org/~")]
    urls = ["http://example.com", "http://example.com?q", "http://www.EXAMPLE.com/any/path", "http://example.community", "http://example.com.net/", "http://badexample.com/", "http://a.org", "http://a.org/", "http://q.a.org/z", "http://b.org/x*y/1", "http://b.org/xzy", "http://c.org/~me", "http://c.org//~"]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()

    def blocked(url):
        host, path = url_filter._parts(url)
        return any((host == h or host.endswith("." + h)) and path.startswith(p) for h, p in (("example.com", ""), ("a.org", "/"), ("b.org", "/x*y"), ("c.org", "/~")))

    assert [r["verdict"] == "block" for r in sorted(got, key=lambda r: r["page_id"])] == [blocked(u) for u in urls] == [True, True, True, False, False, False, False, True, True, True, False, True, False]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 16))
    x[100:140] = x[100]  # equal vectors
    x[200:230] = x[200] + rng.normal(scale=0.05, size=(30, 16))
    rows = [(i, v.tolist(), int(i < 350) + 10 * int(100 <= i < 230), 1) for i, v in enumerate(x)]
    rows += [(900, None, 1, 1), (901, [0.0] * 16, 1, 1), (902, [float("nan")] * 16, 1, 1), (903, [None] + [1.0] * 15, 1, 1), (904, x[100].tolist(), None, 1), (None, x[1].tolist(), 1, 1), (905, [], 1, 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rank int")


def _valid(vectors):
    return {r["vec_id"]: (np.array(r["embedding"], float), r["label"]) for r in vectors.where("vec_id is not null and (vec_id < 900 or vec_id = 904)").collect()}


def test_graph_search(vectors):
    rows = _valid(vectors)
    ids, x = np.array(list(rows)), np.stack([v for v, _ in rows.values()])
    got = graph_ann.search(vectors.where("vec_id % 50 = 0"), graph_ann.index(vectors, shard_rows=200)).collect()
    hit = 0
    for q in range(0, 700, 50):
        c = graph_ann.cosines(np.repeat(rows[q][0][None], len(x), 0), x)
        want = sorted((-s, i) for s, i in zip(c, ids) if i != q)[:5]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        assert all(abs(s - c[list(ids).index(i)]) < 1e-15 for _, i, s in mine)
        hit += len({i for _, i in want} & {m[1] for m in mine})
    assert hit >= 0.95 * 70
    assert [m["vec_id"] for m in sorted((r for r in got if r["query_id"] == 100), key=lambda r: r["rank"])] == [101, 102, 103, 104, 105]
    assert graph_ann.search(vectors, graph_ann.index(vectors.where("false"))).count() == 0


@pytest.mark.parametrize("shard_rows", [1000, 60])
def test_graph_search_with_repeated_rows(spark, shard_rows):
    rng = np.random.default_rng(24)
    x = rng.normal(size=(300, 16))
    near = lambda i, by: (x[i] + rng.normal(scale=by, size=16)).tolist()
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(0, rows[0][1])] * 7 + [(1, rows[1][1])]  # repeated queries, also candidates
    rows += [(400, near(2, 0.01))] * 9  # a near row, repeated
    rows += [(i, rows[3][1]) for i in (500, 501, 502) for _ in range(8)]  # equal vectors, their ids repeated
    rows += [(600, near(4, 0.01)) for _ in range(90)] + [(5, near(5, 0.01)) for _ in range(90)]  # one id with many vectors
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = graph_ann.search(vectors.where("vec_id < 6"), graph_ann.index(vectors, shard_rows=shard_rows)).collect()
    ids, all_x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    hit = 0
    for q in range(6):
        score = {}
        for v in all_x[ids == q]:
            for i, s in zip(ids.tolist(), graph_ann.cosines(v[None], all_x)):
                score[i] = max(s, score.get(i, -2))
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and len({m[1] for m in mine}) == 5 and q not in [m[1] for m in mine]
        assert all(abs(s - score[i]) < 1e-12 for _, i, s in mine)
        hit += len({m[1] for m in mine} & set(sorted(score.keys() - {q}, key=lambda i: (-score[i], i))[:5]))
    assert hit >= 29
    assert {r["vec_id"] for r in got if r["query_id"] == 3} >= {500, 501, 502}
    few = spark.createDataFrame([(1, [1.0, 0.0])] * 20 + [(2, [1.0, 0.1]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in graph_ann.search(few, graph_ann.index(few)).collect()) == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 2), (3, 2, 1)]


def test_embedding_links(vectors):
    rows = _valid(vectors)
    ids = sorted(i for i in rows if rows[i][1] is not None)
    parent = {i: i for i in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = dict.fromkeys(rows, 0)
    for a, b in itertools.combinations(ids, 2):
        if rows[a][1] == rows[b][1] and graph_ann.cosines(rows[a][0][None], rows[b][0][None])[0] >= 0.93:
            links[a], links[b] = links[a] + 1, links[b] + 1
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    got = {r["vec_id"]: r for r in embed_dedup.link(vectors, block_rows=64).collect()}
    assert len(got) == vectors.count()
    for i in rows:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (links[i], root(i), root(i) == i)
    for i in (900, 901, 902, 903, 905):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert (got[None]["n_links"], got[None]["component_id"], got[None]["kept"]) == (0, None, False)
    assert max(links.values()) >= 39 and embed_dedup.link(vectors.where("false")).count() == 0


def test_quantisation_bound():
    rng = np.random.default_rng(2)
    a, b = graph_ann.unit(rng.normal(size=(300, 24))), graph_ann.unit(rng.normal(size=(300, 24)))
    b[:50] = graph_ann.unit(a[:50] + rng.normal(scale=0.02, size=(50, 24)))
    for t in (0.3, 0.9, 0.99):
        got = {(int(i), int(j)) for r, c in embed_dedup.tile_links(a, b, t, False) for i, j in zip(r, c)}
        assert got == {(i, j) for i in range(300) for j in range(300) if graph_ann.cosines(a[i : i + 1], b[j : j + 1])[0] >= t}


def test_poisson_tables():
    for rate in (0.0, 0.01, 0.7, 3.0, 60.0, 2000.0):
        least, cdf = mixing.poisson_table(rate)
        u = (np.arange(20_000) + 0.5) / 20_000
        k = least + np.searchsorted(cdf, u, "right")
        assert abs(k.mean() - rate) <= 0.01 * rate + 1e-9 and abs(k.var() - rate) <= 0.05 * rate + 1e-9


def test_mixing(spark, docs, none):
    weights = {"s0": 1.0, "s1": 1.0, None: 1.0}
    out = mixing.mix(docs, weights, total=6000, details=True).collect()
    by = {s: sum(r["source"] == s for r in out) for s in ("s0", "s1", "s2", None)}
    assert by["s2"] == 0 and all(abs(by[s] - 2000) < 400 for s in ("s0", "s1"))
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs, weights, total=6000, details=True).repartition(3).collect()))
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(none).count() == 0


@pytest.mark.parametrize("sources", [5, 5000])
def test_mixing_deals_out_equal_rows_and_joins_many_sources(spark, docs, monkeypatch, sources):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", sources)
    monkeypatch.setattr(common, "HEAVY", 20)
    monkeypatch.setattr(mixing, "HEAVY", 20)
    rows = [(None, "", "a")] * 900 + [(7, "same", "a")] * 900 + [(10 + i, f"t{i}", f"s{i % 40}") for i in range(800)] + [(5000 + i, "x", None) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {**{f"s{i}": 1.0 for i in range(40)}, "a": 100.0, None: 1.0}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # they are small here
    try:
        mixed = mixing.mix(df, weights, total=2840, details=True)
        out = mixed.collect()
        parts = [r["n"] for r in mixed.selectExpr("spark_partition_id() p").groupBy("p").count().withColumnRenamed("count", "n").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(parts) < 0.4 * len(out) and len(parts) == 4
    rate = {r["source"]: r["_rate"] for r in out}
    n = {"a": 1800, None: 40} | {f"s{i}": 20 for i in range(40)}
    assert rate.keys() <= n.keys() and all(abs(x - weights[s] / 141 * 2840 / n[s]) < 1e-9 for s, x in rate.items())
    for r in out:
        least, cdf = mixing.poisson_table(r["_rate"])
        told = str(r["doc_id"]) if r["doc_id"] is not None else "null"
        if r["doc_id"] is not None:
            u = int(hashlib.md5(f"0:{told}:null".encode()).hexdigest()[:13], 16) / 2**52
            assert r["_copies"] == least + sum(x <= u for x in cdf)
    assert len({r["_copies"] for r in out if r["doc_id"] is None}) <= 1
    assert len(mixing.mix(docs, {}).take(1)) == 0


def test_mixing_tells_rows_of_one_doc_id_apart(spark):
    rows = [(i, f"text {i}", "s") for i in range(600)] + [(7000, f"other {i}", "s") for i in range(1500)] + [(8000, "same", "s")] * 400 + [(None, f"none {i}", "s") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs, details=True, total=2800).collect()
    counts = {}
    for r in out:
        counts[r["doc_id"], r["text"]] = max(counts.get((r["doc_id"], r["text"]), 0), r["_copies"])
    assert len({counts.get((7000, f"other {i}"), 0) for i in range(1500)}) >= 4 and len({r["_shuffle_key"] for r in out if r["doc_id"] == 7000}) > 1000
    assert abs(sum(r["doc_id"] == 7000 for r in out) - 1500) < 200
    alone = {r["doc_id"]: r["_copies"] for r in mixing.mix(docs.where("doc_id < 600"), details=True, total=600).collect()}
    assert all(counts.get((i, f"text {i}"), 0) == alone.get(i, 0) for i in range(600))


def test_unigram_counts(docs, none):
    scores = unigram.zipf_scores(vocabulary("piece_bpe_32k.model"))

    def brute(word):
        best = [(0.0, 0)]
        for e in range(1, len(word) + 1):
            ways = [(best[e - 1][0] + unigram.UNKNOWN, -(best[e - 1][1] + len(word[e - 1].encode())))]
            ways += [(best[b][0] + scores[word[b:e]], -(best[b][1] + 1)) for b in range(e) if word[b:e] in scores]
            s, n = max(ways)
            best.append((s, -n))
        return best[-1][1]

    rows, known = docs.collect(), {}

    def tokens(text):
        words = (text or "").split()
        known.update((w, brute(unigram.MARK + w)) for w in set(words) - known.keys())
        return len(words), sum(known[w] for w in words), len(set(words))

    got = unigram.count_tokens(docs).collect()
    key = lambda i: -1 if i is None else i
    assert sorted((key(r["doc_id"]), r["n_words"], r["n_tokens"], r["n_distinct"]) for r in got) == sorted((key(r["doc_id"]), *tokens(r["text"])) for r in rows)
    rng = random.Random(33)
    words = sorted({"".join(rng.choice("theinagr 漢字é▁=*x😀".replace(" ", "")) for _ in range(rng.randint(1, 30))) for _ in range(1500)} | {"x" * 700, "representation" * 30, "=" * 200, "漢字thinking" * 60})
    for few in (1, 8, 10_000):  # all over the trie, some alone, all alone
        assert unigram.UnigramTrie(scores, few).counts(pa.array(words)).tolist() == [brute(unigram.MARK + w) for w in words]
    assert unigram.UnigramTrie(scores).counts(pa.array([], pa.string())).tolist() == [] and unigram.count_tokens(none).count() == 0


def test_differencing():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 1000, 3000)
    part, sums = sharding.partition(sizes, 7, run=500)
    assert sorted(np.bincount(part, sizes, 7)) == sorted(sums) and sums.max() - sums.min() <= 2
    part, sums = sharding.partition(np.array([8, 7, 6, 5, 4]), 2)
    assert sorted(sums) == [14, 16]  # as differencing ends for these


def test_sharding(docs, none):
    out = sharding.shard(docs, shards=4).collect()
    assert len(out) == docs.count()
    for s in range(4):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    rows = docs.collect()
    assert sorted((r["size"], r["text_crc32"]) for r in out) == sorted((len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in rows)
    assert all(len({r["shard"] for r in out if r["text_crc32"] == c}) == 1 for c in {r["text_crc32"] for r in out})
    assert sharding.shard(none).count() == 0


@pytest.mark.parametrize("copies", [0, 850, 3000])
def test_sharding_with_blocks_and_a_large_group(spark, monkeypatch, copies):
    monkeypatch.setattr(sharding, "BLOCK_GROUPS", 400)
    rng = random.Random(21)
    rows = [(i, "x" * rng.randint(20, 300) + str(i)) for i in range(3000)] + [(5000 + i, "y" * 100) for i in range(copies)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.shard(docs, shards=6).collect()
    assert len(out) == len(rows)
    mine = {r["shard"] for r in out if r["doc_id"] >= 5000}
    sums = [sum(r["size"] for r in out if r["shard"] == s) for s in range(6)]
    fair = sum(sums) / 6
    assert len(mine) == (copies > 0)
    if copies * 108 > fair:  # alone, and the others even
        assert sums.pop(mine.pop()) == copies * 108
    assert max(sums) - min(sums) <= 0.001 * fair


def test_runs_make_up_for_a_large_size():
    rng = np.random.default_rng(22)
    sizes = rng.integers(1, 1000, 3000)
    sizes = np.r_[sizes, int(sizes.sum() / 7)]
    part, sums = sharding.partition(sizes, 7, run=500)
    assert sorted(np.bincount(part, sizes, 7)) == sorted(sums) and sums.max() - sums.min() <= 2
    _, more = sharding.partition(sizes, 7, base=np.array([1_000_000, 0, 0, 0, 0, 0, 0]))
    assert more[0] == 1_000_000 and more[1:].max() - more[1:].min() <= 2


def test_pack_counts():
    rng = random.Random(6)
    for _ in range(30):
        cap = rng.choice([8, 20, 64])
        counts = {n: rng.randint(1, 30) for n in rng.sample(range(1, cap + 1), rng.randint(1, cap // 2))}
        places, filled = packing.pack_counts(counts, cap), {}
        for n, r, s, o, nxt in zip(places.length, places.rank, places.sequence, places.offset, [*zip(places.length[1:], places.rank[1:]), (None, None)]):
            times = (nxt[1] if nxt[0] == n else counts[int(n)]) - r
            for t in range(times):
                filled.setdefault(int(s + t), []).append((int(o), int(n)))
        assert sum(len(v) for v in filled.values()) == sum(counts.values()) and len(filled) == places.sequences
        for v in filled.values():
            v.sort()
            assert [o for o, _ in v] == [sum(n for _, n in v[:k]) for k in range(len(v))] and sum(n for _, n in v) <= cap
        room = []
        for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):  # plain best fit
            at = min((k for k in room if k >= n), default=None)
            room += [cap - n] if at is None else [at - n]
            if at is not None:
                room.remove(at)
        assert -(-sum(n * c for n, c in counts.items()) // cap) <= len(filled) <= len(room)
    assert packing.pack_counts({5: 3, 3: 3}, 8).sequences == 3 and packing.pack_counts({}, 8).sequences == 0


def test_packing(docs, none):
    out = packing.pack(docs, keep_ids=True).collect()
    want, rows = {}, docs.collect()
    for r, ids in zip(rows, library_ids(r["text"] for r in rows)):
        ids += b"\0\0\0\0"
        for k in range(0, len(ids), 8192):
            key = (r["doc_id"], k // 8192, zlib.crc32(ids[k : k + 8192]))
            want[key] = want.get(key, 0) + 1
    got = {}
    for r in out:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] and r["start"] == 2048 * r["piece"]
        key = (r["doc_id"], r["piece"], r["ids_crc32"])
        got[key] = got.get(key, 0) + 1
    assert got == want
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in by.values():
        v.sort()
        assert [o for o, _ in v] == [sum(n for _, n in v[:k]) for k in range(len(v))] and sum(n for _, n in v) <= 2048
    assert len(by) <= -(-sum(r["length"] for r in out) // 2048) + 2
    assert packing.pack(none).count() == 0


def test_wavelet_matrix():
    rng = np.random.default_rng(7)
    for values in (rng.integers(0, 500, 5000), np.zeros(0, np.int64), np.array([0]), np.full(700, 65535)):
        values = values.astype(np.uint16)
        w = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(values).to_bytes())
        assert (w.values() == values).all()
        if len(values):
            at = rng.integers(0, len(values), 50)
            assert (w.access(at) == values[at]).all()
            v = int(values[0])
            assert w.count(v) == (values == v).sum() and w.rank(v, 100) == (values[:100] == v).sum()
            assert [w.select(v, k) for k in range(3)] == [*np.flatnonzero(values == v)[:3].tolist(), -1, -1, -1][:3]
        assert w.count(70_000) == 0 and w.select(499, 10**6) == -1


def test_lookups_inflate_their_blocks_only():
    rng = np.random.default_rng(17)
    values = (rng.zipf(1.3, 300_000) % 40_000).astype(np.uint16)
    blob = wavelet.WaveletMatrix.build(values).to_bytes()
    fresh = lambda: wavelet.WaveletMatrix.from_bytes(blob)
    w = fresh()
    blocks = w.bits * w.blocks
    assert w.blocks == 10 and w.inflated == 0 and (w.access([123_456]) == values[123_456]).all() and w.inflated == w.bits
    w = fresh()
    assert w.rank(7, 200_000) == (values[:200_000] == 7).sum() and w.inflated <= 2 * w.bits < blocks
    w, places = fresh(), np.flatnonzero(values == 7)
    assert w.select(7, 1000) == places[1000] and w.inflated <= 3 * w.bits < blocks
    for k in (0, len(places) // 2, len(places) - 1):
        assert w.select(7, k) == places[k]
    at = rng.integers(0, len(values), 2000)
    assert (w.access(at) == values[at]).all() and (fresh().values() == values).all()
    for end in (0, 1, 32_768, 65_536, 65_537, 300_000, 10**9):
        assert w.rank(1, end) == (values[:end] == 1).sum()


def test_wavelet_files(spark, docs, none, monkeypatch):
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    at, want = 0, []
    for r, ids in zip(rows, library_ids(r["text"] for r in rows)):
        ids += np.uint32(2).astype("<u4").tobytes()
        want.append((r["doc_id"], at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    monkeypatch.setattr(wavelet, "SEGMENT_TOKENS", 5000)
    files = wavelet.write(docs)
    got = wavelet.documents(files).collect()
    assert sorted(map(tuple, got), key=lambda t: t[1]) == want
    assert {(r["start"], zlib.crc32(r["ids"])) for r in wavelet.documents(files, ids=True).collect()} == {(w[1], w[3]) for w in want}
    found = wavelet.occurrences(files, 2).collect()
    assert sum(r["n"] for r in found) >= len(want) and all(r["first"] >= 0 for r in found)
    assert sum(r["n"] for r in wavelet.occurrences(files, 48_000).collect()) == sum(np.frombuffer(r["ids"], "<u4").tolist().count(48_000) for r in wavelet.documents(files, ids=True).collect())
    assert wavelet.documents(wavelet.write(none)).count() == 0


def test_many_equal_rows_without_id_are_many_partitions(spark, monkeypatch):
    docs = spark.range(4000).selectExpr("cast(null as long) doc_id", "'a b c' text").union(spark.range(100).selectExpr("id", "'x' text"))
    monkeypatch.setattr(wavelet, "SEGMENT_TOKENS", 500)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # they are small here
    try:
        files = wavelet.write(docs)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    per = [r["n"] for r in files.groupBy("shard").agg({"n_docs": "sum"}).withColumnRenamed("sum(n_docs)", "n").collect()]
    assert len(per) >= 3 and max(per) <= 0.5 * 4100 and sum(per) == 4100
    got = sorted(map(tuple, wavelet.documents(files).collect()), key=lambda t: t[1])
    assert [t[0] for t in got] == [None] * 4000 + list(range(100)) and [t[1] for t in got] == [4 * k for k in range(4000)] + [16_000 + 2 * k for k in range(100)]


def _simhash(text, words):
    parts = [w.decode() for w in (text or "").encode().lower().split()]
    shingles = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_fingerprints():
    for t in (None, "", " \t", "One", "A b", "a b c", "É a\x0bB\x0cc d e\x85f g", "w " * 40_000):
        assert int(simhash.fingerprint(t)[0][0]) == _simhash(t, 3)
    assert simhash.fingerprint("a b c d e f", 5, 4)[0].shape == (4,) and simhash.fingerprint("a b c d e f", 5, 4)[1] == 2


def test_join_near_equals_brute_force():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    x[1000:1500] = x[1000] ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    x[1500:1600] = x[:100] ^ np.uint64(5)
    forest = simhash.join_near(x[:, None], 2)
    want = simhash.Forest(len(x))
    r, c = np.nonzero(np.bitwise_count(x[:, None] ^ x) <= 2)
    want.join(r, c)
    assert (forest.label == want.label).all()
    tree = simhash.VantageTree(x[:, None], 4, 2)
    at, leaf = tree.leaf_of(x[:, None])
    home = {}
    for a, n in zip(at.tolist(), leaf.tolist()):
        home.setdefault(a, set()).add(n)
    assert tree.leaves > 4 and sorted(set(leaf.tolist())) == list(range(tree.leaves)) and all(home[a] & home[b] for a, b in zip(r.tolist(), c.tolist()))


def test_simhash_links(docs, none):
    rows = [(r["doc_id"], _simhash(r["text"], 3)) for r in docs.collect() if r["doc_id"] is not None]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, x), (b, y) in itertools.combinations(rows, 2):
        if (x ^ y).bit_count() <= 2:
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    got = simhash.link(docs).collect()
    assert len(got) == docs.count()
    assert sorted((r["doc_id"], int.from_bytes(r["fp"], "little"), r["component_id"]) for r in got if r["doc_id"] is not None) == sorted((i, f, root(i)) for i, f in rows)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None] and simhash.link(none).count() == 0


def test_tiles_lose_nothing(spark):
    rng = np.random.default_rng(9)
    x = rng.integers(0, 1 << 63, (400, 4), dtype=np.uint64)
    x[200:300] = x[:100] ^ (np.uint64(3) << rng.integers(0, 60, (100, 1)).astype(np.uint64))
    n = rng.integers(50, 400, 400)
    n[200:300] = (n[:100] * rng.uniform(0.7, 1.2, 100)).astype(int)
    classes = spark.createDataFrame([(bytearray(f.tobytes()), i, int(c)) for i, (f, c) in enumerate(zip(x, n))], "fp binary, rep long, shingles long")
    edges = simhash.near_edges(simhash.dealt(classes, 52), 52, 0.8, tile_rows=40).collect()
    got = simhash.Forest(400)
    got.join(np.array([r["a"] for r in edges]), np.array([r["b"] for r in edges]))
    want = simhash.Forest(400)
    d = sum(np.bitwise_count(x[:, None, k] ^ x[:, k]).astype(int) for k in range(4))
    want.join(*np.nonzero((d <= 52) & (np.minimum(n[:, None], n) >= 0.8 * np.maximum(n[:, None], n))))
    assert (got.label == want.label).all() and len(set(want.label)) < 400


@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_the_tree_follows_the_classes(spark, monkeypatch, broadcast):
    monkeypatch.setattr(simhash, "BROADCAST_SHARDS", broadcast)
    rng = np.random.default_rng(10)
    x = rng.integers(0, 1 << 63, 6000, dtype=np.uint64)
    x[3000:4000] = x[:1000] ^ (np.uint64(1) << rng.integers(0, 63, 1000).astype(np.uint64))
    classes = spark.createDataFrame([(bytearray(f.tobytes()), i, 0) for i, f in enumerate(x)], "fp binary, rep long, shingles long")
    shards = simhash.dealt(classes, 2, shard_rows=150)
    leaves = [r["count"] for r in shards.groupBy("leaf").count().collect()]
    assert len(leaves) > 30 and max(leaves) < 1500  # the boundaries are on both sides
    want = simhash.Forest(6000)
    want.join(*np.nonzero(np.bitwise_count(x[:, None] ^ x) <= 2))
    for tile_rows in (50, 10_000):
        edges = simhash.near_edges(shards, 2, tile_rows=tile_rows).collect()
        got = simhash.Forest(6000)
        got.join(np.array([r["a"] for r in edges]), np.array([r["b"] for r in edges]))
        assert (got.label == want.label).all() and len(set(want.label)) == 5000


@pytest.mark.parametrize(("common", "left", "right"), [(1, 0, 0), (4, 0, 1), (8, 1, 1), (12, 0, 3), (16, 2, 2), (40, 5, 5), (80, 0, 20), (200, 25, 25), (2000, 250, 250)])
def test_similar_sets_meet(common, left, right):
    rng, missed = np.random.default_rng(common), 0
    for _ in range(3000):
        h = rng.integers(0, 1 << 63, common + left + right, dtype=np.uint64)
        a, b = np.sort(h[: common + left]), np.sort(np.r_[h[:common], h[common + left :]])
        missed += not np.isin(simhash.meeting_keys(a), simhash.meeting_keys(b)).any()
    assert missed <= 1  # similarity 0.8: expected is under 0.03, and none at all of sets that the keys hold whole


def test_meeting_classes(spark):
    rows = [(bytearray([i]) * 16, bytearray(8), 5, i, [100, 200 + i // 2, 300 + i]) for i in range(20)]
    classes = spark.createDataFrame(rows, "key binary, fp binary, shingles long, rep long, keys array<long>").withColumn("n", F.lit(1))
    got = sorted((r["leaf"], r["rep"]) for r in simhash.met(classes, common.Scratch(spark, "test")).collect())
    assert got == sorted([(100, i) for i in range(20)] + [(200 + i // 2, i) for i in range(20)])
    assert simhash.met(classes.where("false"), common.Scratch(spark, "test")).count() == 0


def test_sketches_part_what_only_resembles(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    rows, close, apart = [], [], []
    for k in range(0, 400, 4):
        base = [word() for _ in range(rng.choice((60, 200, 900)))]
        for i, share in enumerate((0.0, 0.01, 0.1)):  # of words changed: Jaccard similarity about 0.9 and 0.4
            changed = [word() if share and j % int(1 / share) == 5 else w for j, w in enumerate(base)]
            rows.append((k + i, " ".join(changed), "mine"))
        close.append(k + 1)
        apart.append(k + 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone string")
    kept = simhash.distinct(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert not ids & set(close) and set(apart) <= ids and len(ids) == 200
    sketch = lambda t: simhash.fingerprint(t, 5, 4, simhash.SLOTS)[2]
    assert not sketch("").any() and simhash.alike(sketch("")[None], sketch(None)[None], 0.8).all()


def test_repeated_passages_are_near_copies(spark):
    rng = random.Random(23)
    words = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(20_000)]
    text, long = " ".join(words[:204]), " ".join(words)  # the long one has more shingles than a run
    rows = [(1, text), (2, text + " " + text), (3, text + 3 * (" " + " ".join(words[180:204]))), (4, " ".join(words[300:708])), (5, long), (6, long + " " + long)]
    kept = simhash.distinct(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 4, 5]
    assert simhash.fingerprint(rows[5][1], 5, 4, 16)[1] == simhash.fingerprint(long, 5, 4, 16)[1] + 4 == 20_000


def test_shards_of_one_table_go_to_many_tasks(spark):
    rng = np.random.default_rng(27)
    x = rng.integers(0, 1 << 63, 800, dtype=np.uint64)
    x[400:] = x[:400] ^ np.uint64(1)
    shards = spark.createDataFrame([(i % 400 // 50, bytearray(f.tobytes()), i, 0) for i, f in enumerate(x)], "leaf long, fp binary, rep long, shingles long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it would put the few rows of a test into one task
    try:
        parts = [[p for p in simhash.near_edges(shards, 2, tile_rows=1000, pack_rows=n).rdd.glom().collect() if p] for n in (None, 10)]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(parts[0]) == 1 < len(parts[1])
    assert [sorted((r["a"], r["b"]) for p in e for r in p) for e in parts] == [[(i + 400, i) for i in range(400)]] * 2


def _changed_texts(texts, words, share):
    """Pairs of texts (2k, 2k + 1), of which the second has so many words changed."""
    rng = random.Random(26)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    rows = []
    for k in range(0, 2 * texts, 2):
        base = [word() for _ in range(words)]
        rows += [(k, " ".join(base)), (k + 1, " ".join(word() if j % share == 7 else w for j, w in enumerate(base)))]
    return rows


def test_near_copies_of_one_shard_need_no_keys(spark, monkeypatch):
    def none_met(classes, scratch):
        raise AssertionError("the tree has one shard")

    monkeypatch.setattr(simhash, "met", none_met)
    rows = _changed_texts(50, 100, 60)  # similarity about 0.8 to 0.9
    kept = simhash.distinct(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(0, 100, 2))


def test_the_tree_of_near_copies_parts_and_loses_none_within_its_boundary(spark, monkeypatch):
    rows = _changed_texts(40, 8000, 8000)
    fps = [simhash.fingerprint(t, 5, 4)[0] for _, t in rows]
    reach = simhash.boundary(76, 4, 0.8)
    within = [k + 1 for k in range(0, 80, 2) if int(np.bitwise_count(fps[k] ^ fps[k + 1]).sum()) <= reach]
    leaves, dealt = [], simhash.dealt

    def counted(classes, radius, shard_rows):
        out = dealt(classes, radius, shard_rows)
        leaves.append(out.select("leaf").distinct().count())
        return out

    monkeypatch.setattr(simhash, "SHARD_ROWS", 10)
    monkeypatch.setattr(simhash, "dealt", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.distinct(docs).collect()} == set(range(0, 80, 2))  # with the keys
    met = simhash.met
    monkeypatch.setattr(simhash, "met", lambda classes, scratch: met(classes, scratch).where("false"))
    gone = set(range(80)) - {r["doc_id"] for r in simhash.distinct(docs).collect()}
    assert len(within) > 10 and set(within) <= gone <= set(range(1, 80, 2)) and min(leaves) > 2
    assert simhash.boundary(2, 1, 0.0) == 2 and simhash.boundary(76, 4, 0.0) == 76 and reach == 4


def test_short_near_copies(spark):
    rng = random.Random(25)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    rows = []
    for k in range(0, 1200, 4):
        text = " ".join(word() for _ in range(8))
        rows += [(k, text), (k + 1, text + " " + word()), (k + 2, " ".join(word() for _ in range(2)) + " " + text)]  # 4 shingles, 5 and 6: similarities 0.8, 0.67, 0.57
    kept = {r["doc_id"] for r in simhash.distinct(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not kept & set(range(1, 1200, 4)) and set(range(0, 1200, 4)) <= kept
    assert len(kept & set(range(2, 1200, 4))) >= 285  # but for slots that hold two shingles


@pytest.mark.parametrize("few", [0, 1000])
def test_components(spark, few):
    from opticframe.llm.components import connected_components

    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (7, 7)]
    got = connected_components(spark.createDataFrame(chain, "a long, b long"), common.Scratch(spark, "test"), few).collect()
    assert {r["node"]: r["component"] for r in got} == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 103: 100}


@pytest.mark.parametrize("kind", ["binary", "long"])
def test_attach_spreads_a_heavy_class_and_shuffles_the_rest(spark, monkeypatch, kind):
    monkeypatch.setattr(common, "HEAVY", 10)
    key = (lambda k: bytearray(k.to_bytes(16, "big"))) if kind == "binary" else (lambda k: k)
    rows = [(key(1), None)] * 3000 + [(key(2 + i % 500), i) for i in range(2000)] + [(key(9999), 5)]
    classes = [(key(1), 3000, "heavy")] + [(key(2 + i), 4, f"c{i}") for i in range(500)]
    df = spark.createDataFrame(rows, f"k {kind}, id long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = common.attach(df, spark.createDataFrame(classes, f"k {kind}, n long, name string"), "k", "n", 5001)
        parts = [r["count"] for r in got.selectExpr("spark_partition_id() p").groupBy("p").count().collect()]
        rows_of = [(bytes(r["k"]) if kind == "binary" else r["k"], r["id"], r["name"]) for r in got.collect()]
        plan = got._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" in plan and max(parts) < 0.4 * 5001
    name = {bytes(k) if kind == "binary" else k: x for k, _, x in classes}
    want = [(bytes(k) if kind == "binary" else k, i, name.get(bytes(k) if kind == "binary" else k)) for k, i in rows]
    assert sorted(rows_of, key=str) == sorted(want, key=str)


def test_scratch_is_shared_and_released(spark, monkeypatch):
    before = common.saved(spark)
    t = common.Scratch(spark, "test")
    a, b = t.save(spark.range(3)), t.save(spark.range(4))
    assert common.saved(spark) == [*before, a.scratch_path, b.scratch_path]
    t.drop(a)
    common.release(spark, common.saved(spark)[len(before) :])
    assert common.saved(spark) == before
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|No such file"):
        spark.read.parquet(b.scratch_path).count()

    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError, match="checkpoint.dir"):
        common.scratch_root(Cluster)


@pytest.mark.parametrize("operator", ["shard", "pack"])
def test_equal_rows_without_id_part_among_chunks(spark, monkeypatch, operator):
    seen = []
    module = {"shard": sharding, "pack": packing}[operator]
    monkeypatch.setattr(module, "LEAST_CHUNKS", 8)
    save = common.Scratch.save
    monkeypatch.setattr(common.Scratch, "save", lambda self, df: seen.append(save(self, df)) or seen[-1])
    docs = spark.range(0, 4000, 1, 4).selectExpr("cast(null as long) doc_id", "cast(null as string) text")
    out = getattr(module, operator)(docs).collect()
    chunked = [t for t in seen if "chunk" in t.columns]
    sizes = [r["s"] for t in chunked for r in t.groupBy("chunk").agg({"n" if "n" in t.columns else "*": "sum" if "n" in t.columns else "count"}).toDF("chunk", "s").collect()]
    assert sizes and max(sizes) < 0.25 * 4000
    places = sorted((r["shard"], r["slot"]) if operator == "shard" else (r["sequence_id"], r["offset"]) for r in out)
    assert len(set(places)) == 4000 and (operator == "pack" or [s for _, s in places] == list(range(4000)))


def test_pipeline(spark, docs, none, tmp_path):
    import corpus_pipeline

    corpus = docs.select("doc_id", "text", "lang", "source", "n_chars")
    corpus.selectExpr("doc_id", "cast(length(text) > 300 as int) quality", "0 toxic").write.parquet(str(tmp_path / "labels.parquet"))
    corpus.write.parquet(str(tmp_path / "documents.parquet"))
    now = corpus
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, str(tmp_path))
        if name != "packing":
            assert now.columns == corpus.columns
        if name == "near_copies":
            texts = [r["text"] for r in now.where("doc_id is not null and doc_id <> 5").collect()]
            assert len(set(texts)) == len(texts) and now.where("doc_id = 400").count() == 0
            assert {r["doc_id"] for r in before.where("doc_id between 0 and 99").collect()} == {r["doc_id"] for r in now.where("doc_id between 0 and 99").collect()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none.select(*corpus.columns), str(tmp_path)).count() == 0
