"""Operators without SQL against plain versions of what they compute."""

import hashlib
import heapq
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from opticframe.llm import common, embed_dedup, graph_ann, mixing, quality, sharding
from opticframe.llm.tokens import vocabulary


def _statistics(text):
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * len(quality.FEATURES)
    n, w = len(data), len(words)
    share = lambda ok: sum(map(ok, data)) / n
    among = lambda signs: share(lambda b: b in signs)
    letters, upper = share(lambda b: 97 <= b <= 122 or 65 <= b <= 90 or b > 127), share(lambda b: 65 <= b <= 90)
    lines, counts = [x for x in data.split(b"\n") if x.strip()], Counter(words)
    p = [k / n for k in Counter(data).values()]
    of = {
        "log_bytes": math.log1p(n), "log_words": math.log1p(w), "word_bytes": sum(map(len, words)) / w, "letters": letters, "upper": upper / max(letters, 1e-9), "digits": share(lambda b: 48 <= b <= 57),
        "blanks": among(b" \t\n\r"), "stops": among(b".,;:?"), "symbols": among(b"#$%&*+=@^_~\\/"), "bangs": among(b"!"), "pipes": among(b"|"), "brackets": among(b"<>{}[]()"), "high_bytes": share(lambda b: b > 127),
        "byte_entropy": -sum(x * math.log2(x) for x in p), "distinct_words": len(counts) / w, "top_word": max(counts.values()) / w, "distinct_pairs": len({*zip(words, words[1:])}) / (w - 1) if w > 1 else 1.0,
        "lines": math.log1p(len(lines)), "line_bytes": math.log1p(n / len(lines)), "distinct_lines": len(set(lines)) / len(lines), "top_line_bytes": max(len(x) * lines.count(x) for x in lines) / n,
        "words_per_stop": math.log1p(w / (sum(map(data.count, (b".", b"?", b"!"))) + 1)), "long_words": sum(len(x) > 20 for x in words) / w, "short_words": sum(len(x) < 3 for x in words) / w,
    }
    return [of[f] for f in quality.FEATURES]


def test_statistics_equal_plain_ones():
    rng = random.Random(41)
    pool = list("abcXYZ 0189.,;:?!|<>{}[]()#$%&*+=@^_~\\/\n\t\ré漢") + [" "] * 12 + ["\n"] * 2
    texts = [None, "", " \n", "a", "One line.", "two\n\n  \ntwo\ntwo x", "w " * 3000, "x" * 5000, "漢字 " * 40] + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 800))) for _ in range(200)]
    for t in texts:
        assert np.allclose(quality.statistics(t), _statistics(t), rtol=1e-12, atol=1e-12)


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(42)
    x, least, l2, rate = np.round(rng.random((400, 5)), 1), 20, 1.0, 0.15  # ties among values
    y = (x[:, 3] + 0.3 * rng.random(400) > 0.7).astype(float)
    trees = quality.grow(x, y, trees=1, depth=1, rate=rate, leaf_rows=least, l2=l2)
    share = (y.sum() + 0.5) / 401
    g, h = share - y, np.full(400, share * (1 - share))
    worth = lambda at: g[at].sum() ** 2 / (h[at].sum() + l2)
    best = max((worth(x[:, f] <= c) + worth(x[:, f] > c) - worth(np.full(400, True)), f, c) for f in range(5) for c in np.unique(x[:, f]) if least <= (x[:, f] <= c).sum() <= 400 - least)
    f, c = int(trees.feature[0, 0]), trees.cut[0, 0]
    assert f == best[1] and ((x[:, f] <= c) == (x[:, f] <= best[2])).all()
    for k, side in enumerate((x[:, f] <= c, x[:, f] > c)):
        assert math.isclose(trees.leaf[0, k], -rate * g[side].sum() / (h[side].sum() + l2))


def test_scores_are_those_of_each_text_alone(spark):
    texts = ["A good sentence, with words. " * 9, "!!! $$$ | | |", None, "", "A good sentence, with words. " * 9]
    rows = [(i % 4 if i < 4 else None, t, 0.5, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, value string")
    rng = np.random.default_rng(1)
    x = rng.random((500, len(quality.FEATURES)))
    trees = quality.grow(x, (x[:, 0] > 0.5).astype(float))
    got = Counter((r["doc_id"], r["score"], r["predicted"]) for r in quality.score(docs, trees).collect())
    each = [float(trees.score(quality.statistics(t)[None])[0]) for t in texts]
    assert got == Counter((r[0], s, int(s >= 0.7)) for r, s in zip(rows, each))
    assert Counter(tuple(r) for r in quality.accepted(docs, trees).collect()) == Counter(r for r, s in zip(rows, each) if s >= 0.7)


@pytest.mark.parametrize("parts", [2, 4, 24])
def test_differencing_equals_the_plain_method(parts):
    rng = random.Random(parts)
    for n in (0, 1, 3, 40, 300):
        sizes = [rng.randint(1, 10**9) for _ in range(n)]
        heap = [(-x, i, [0] * (parts - 1) + [x]) for i, x in enumerate(sizes)]
        heapq.heapify(heap)
        for i in itertools.count(n):
            if len(heap) < 2:
                break
            a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
            both = sorted(x + y for x, y in zip(sorted(a), sorted(b, reverse=True)))
            heapq.heappush(heap, (both[0] - both[-1], i, both))
        part, sums = sharding.partition(np.array(sizes, np.int64), parts)
        assert sorted(sums.tolist()) == (heap[0][2] if heap else [0] * parts)
        assert np.bincount(part, sizes, parts).astype(int).tolist() == sums.tolist()


def test_sharding_of_many_blocks_is_even(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_GROUPS", 100)
    rng = random.Random(43)
    docs = spark.createDataFrame([(i, "z" * int(rng.lognormvariate(4, 1)) + str(i)) for i in range(6000)], "doc_id long, text string")  # 59 blocks beside the largest
    sums = Counter()
    for r in sharding.shard(docs, shards=5).collect():
        sums[r["shard"]] += r["size"]
    assert len(sums) == 5 and max(sums.values()) - min(sums.values()) <= 0.0005 * sum(sums.values()) / 5


def test_links_of_rows_that_share_an_id(spark):
    a, b, c = [1.0, 0.0], [1.0, 0.05], [0.0, 1.0]
    rows = [(1, a, 0), (1, a, 0), (1, c, 0), (2, b, 0), (3, c, 0), (4, c, 1), (None, a, 0)]
    got = Counter(tuple(r) for r in embed_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    # the two rows of 1 link with each other and with 2, that of c with 3; 1 is one node, so that all of label 0 are one component
    assert got == Counter({(1, 2, 1, True): 2, (1, 1, 1, True): 1, (2, 2, 1, False): 1, (3, 1, 1, False): 1, (4, 0, 4, True): 1, (None, 0, None, False): 1})


def test_scores_of_the_search_over_all_rows(spark):
    rng = np.random.default_rng(44)
    x = rng.normal(size=(1500, 12))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = graph_ann.search(vectors.where("vec_id % 10 = 0"), graph_ann.index(vectors, shard_rows=300)).collect()
    u, hit = x / np.sqrt((x * x).sum(1, keepdims=True)), 0
    for q in range(0, 1500, 10):
        s = u @ u[q]
        s[q] = -2
        hit += len({r["vec_id"] for r in got if r["query_id"] == q} & set(np.argsort(-s)[:5].tolist()))
    assert hit >= 0.97 * 750


def test_pipeline_equals_plain_stages(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(45)
    words = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    rows = [(i, text(rng.randint(30, 900)), "en", f"s{min(i % 7, 2)}") for i in range(300)]
    for i in range(40):  # near copies (a word changed, or one added), exact ones, and texts that share a third
        w = rows[i][1].split()
        w[len(w) // 2] = "changed"
        rows += [(1000 + i, " ".join(w), "en", "s0"), (2000 + i, rows[i][1] + " more", "en", "s1"), (3000 + i, rows[i][1], "en", "s1"), (4000 + i, rows[i][1] + " " + text(2 * len(w)), "en", "s2")]
    rows += [(5000 + i, "| $$ !! " * 20 + str(i) + " 77 #", "en", "s0") for i in range(150)] + [(6000, None, "en", None), (6001, "", "en", "s0"), (6002, text(9000), "en", "s0")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "kept") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _gone string")
    docs.selectExpr("doc_id", "cast(doc_id < 5000 or doc_id > 6001 as int) quality", "0 toxic").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stage, now = dict(corpus_pipeline.STAGES), {r[0]: r for r in rows}

    first = {r["doc_id"] for r in stage["quality"](spark, docs, str(tmp_path)).collect()}
    assert first == {i for i in now if i < 5000 or i == 6002}

    kept_docs = docs.where(docs["doc_id"].isin(list(first)))
    shingles = {i: {tuple(w[k : k + 5]) for w in [now[i][1].lower().split()] for k in range(max(1, len(w) - 4))} for i in first}
    root = {i: i for i in first}
    find = lambda i: i if root[i] == i else find(root[i])
    for a, b in itertools.combinations(sorted(first), 2):
        if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    near = stage["near_copies"](spark, kept_docs, str(tmp_path))
    second = {r["doc_id"] for r in near.collect()}
    assert near.columns == docs.columns and second == {i for i in first if find(i) == i} and 4000 in second and 3000 not in second

    sizes = Counter(now[i][3] for i in second)
    whole = sum(math.sqrt(n) for n in sizes.values())
    want = {}
    for i in second:
        rate = math.sqrt(sizes[now[i][3]]) / whole * len(second) / sizes[now[i][3]]
        least, cdf = mixing.poisson_table(rate)
        u = int(hashlib.md5(f"0:{i}:null".encode()).hexdigest()[:13], 16) / 2**52
        want[i] = least + sum(x <= u for x in cdf)
    third = stage["mixing"](spark, docs.where(docs["doc_id"].isin(list(second))), str(tmp_path))
    got = Counter(r["doc_id"] for r in third.collect())
    assert third.columns == docs.columns and got == Counter({i: n for i, n in want.items() if n})

    before = common.saved(spark)
    packed = corpus_pipeline.run(spark, str(tmp_path))
    left = [p for p in common.saved(spark) if p not in before]
    out, each = packed.collect(), Tokenizer.from_file(vocabulary())
    assert left == [packed.scratch_path]  # all else that the run wrote is gone
    pieces = Counter()
    for i, n in got.items():
        ids = np.array([*each.encode(now[i][1], add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            pieces[i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())] += n
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == pieces
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in by.values():
        v.sort()
        assert [o for o, _ in v] == [sum(n for _, n in v[:k]) for k in range(len(v))] and sum(n for _, n in v) <= 2048
    room = []
    for n in sorted((r["length"] for r in out), reverse=True):  # plain best fit
        at = min((k for k in room if k >= n), default=None)
        room += [2048 - n] if at is None else [at - n]
        if at is not None:
            room.remove(at)
    assert len(by) <= len(room)
