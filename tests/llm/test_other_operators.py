import random
import zlib

import numpy as np

from pagelattice.llm import rp_forest, url_filter


def test_nearest_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(1500, 24))
    vectors[3] = vectors[0]
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(2000, None), (2050, [0.0] * 24), (2100, [float("nan")] * 24), (2150, []), (2200, [1.0, 2.0]), (0, vectors[0].tolist())]
    found = rp_forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=50, k=5).collect()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hit = total = 0
    for q in range(0, 1500, 50):
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5]
        score = unit @ unit[q]
        score[q] = -9
        best = np.lexsort((np.arange(1500), -score))[:5]
        hit, total = hit + len({v for _, v, _ in own} & set(best.tolist())), total + 5
        assert all(abs(s - score[v]) < 1e-9 for _, v, s in own)
    assert hit / total >= 0.9
    assert {r["query_id"] for r in found} == set(range(0, 1500, 50))
    assert next(r["vec_id"] for r in found if r["query_id"] == 0 and r["rank"] == 1) == 3


def brute_nearest(rows, every, k):
    """The nearest ids of each query id over all its vectors and all others'."""
    out = {}
    for q, v in rows:
        if q % every:
            continue
        for other, w in rows:
            if other != q and len(w) == len(v):
                score = float(np.dot(v, w) / np.sqrt(np.dot(v, v) * np.dot(w, w)))
                best = out.setdefault(q, {})
                best[other] = max(best.get(other, -9), score)
    return {q: sorted(own.items(), key=lambda x: (-x[1], x[0]))[:k] for q, own in out.items()}


def test_nearest_of_repeated_ids_and_ties(spark):
    rng = np.random.default_rng(5)
    rows = [(50, rng.normal(size=6)) for _ in range(3)] + [(7, rng.normal(size=6)) for _ in range(9)] + [(k, rng.normal(size=6)) for k in range(60, 80)]
    rows += [(k, rows[0][1] * 2) for k in (101, 90, 95, 91, 92, 93)] + [(100, rng.normal(size=6))]
    rows += rows[:5]
    frame = spark.createDataFrame([(i, v.tolist(), "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    expected = brute_nearest(rows, 50, 5)
    for shard_rows in (8192, 4):
        found = {}
        for r in rp_forest.nearest(frame, search=1.0, shard_rows=shard_rows).orderBy("query_id", "rank").collect():
            found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert {q: [v for v, _ in own] for q, own in found.items()} == {q: [v for v, _ in own] for q, own in expected.items()}
        assert all(abs(a[1] - b[1]) < 1e-12 for q in found for a, b in zip(found[q], expected[q]))
    assert [v for v, _ in expected[50]][:5] == [90, 91, 92, 93, 95]
    assert rp_forest.nearest(frame.limit(0)).count() == 0


def test_nearest_of_one_hot_vector(spark):
    rows = [(k, [1.0, 2.0, 3.0]) for k in range(400)] + [(k, [float(k % 7), 1.0, float(k % 5)]) for k in range(400, 600)]
    found = rp_forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).filter("query_id = 50").orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == [0, 1, 2, 3, 4] and all(abs(r["score"] - 1) < 1e-12 for r in found)


def brute_score(text, counts):
    """Interpolated character models of order 0 to 4 with exact contexts: mean difference of the log-likelihoods."""
    codes = url_filter.coded([text])[0].tolist()
    total = 0.0
    for at in range(url_filter.ORDER, len(codes)):
        p = [1 / 64, 1 / 64]
        for k in range(url_filter.ORDER + 1):
            context = tuple(codes[at - k : at])
            for side in (0, 1):
                whole, seen = counts[side].get((context, codes[at]), 0), counts[side].get(context, 0)
                p[side] = (whole + url_filter.PRIOR * p[side]) / (seen + url_filter.PRIOR)
        total += np.log(p[1]) - np.log(p[0])
    return total / max(1, len(codes) - url_filter.ORDER)


def test_url_model_against_exact_contexts(spark):
    rng = random.Random(3)
    sides = {"allow": "abcde/-", "block": "vwxyz/-"}
    rows = [("http://h.org/" + "".join(rng.choice(sides[side] + "mn") for _ in range(rng.randrange(4, 30))), side) for _ in range(150) for side in sides]
    model = url_filter.train(spark.createDataFrame(rows, "url string, rule_verdict string"))
    counts = ({}, {})
    for url, side in rows:
        if zlib.crc32(url.encode()) % 5:
            codes = url_filter.coded([url])[0].tolist()
            own = counts[int(side == "block")]
            for at in range(url_filter.ORDER, len(codes)):
                for k in range(url_filter.ORDER + 1):
                    context = tuple(codes[at - k : at])
                    own[context] = own.get(context, 0) + 1
                    own[context, codes[at]] = own.get((context, codes[at]), 0) + 1
    tests = [u for u, _ in rows[:40]] + ["", "http://h.org/", "http://h.org/abcabc", "http://h.org/xyzxyz", "plain"]
    # runs of over three characters share cells by chance, so some scores differ a little
    apart = np.abs(model.score(tests) - np.array([brute_score(t, counts) for t in tests]))
    assert np.median(apart) < 1e-6 and (apart > 0.01).mean() < 0.2
    p = model.block_probability(["http://h.org/abcdeabcde", "http://h.org/vwxyzvwxyz"])
    assert p[0] < 0.1 and p[1] > 0.9


def test_free_urls_follow_the_side_they_read_like(spark):
    rng = random.Random(4)
    word = lambda kind: "".join(rng.choice(kind) for _ in range(8))
    urls = [f"http://x.com/en/{word('vwxyz')}" for _ in range(200)] + [f"http://example.com/en/7{word('abcde')}" for _ in range(200)]
    free = [f"http://free{k}.gov/{word('vwxyz' if k % 2 else 'abcde')}" for k in range(40)]
    rows = list(enumerate(urls + free))
    found = {r["page_id"]: r for r in url_filter.judge_urls(spark.createDataFrame([(k, u, "x", "y") for k, u in rows], "page_id long, url string, host string, verdict string")).collect()}
    right = sum(found[400 + k]["verdict"] == ("block" if k % 2 else "allow") for k in range(40))
    assert right >= 38 and all(found[400 + k]["rule"] is None for k in range(40))
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    one_side = url_filter.judge_urls(spark.createDataFrame([(1, "http://x.com/en/a"), (2, "http://y.org/"), (None, None), (2, "http://y.org/")], "page_id long, url string"))
    assert sorted((r["page_id"] or 0, r["verdict"]) for r in one_side.collect()) == [(0, "allow"), (1, "block"), (2, "allow"), (2, "allow")]


def test_urls(spark):
    urls = [f"http://a{k}.example.com/en/{k}" for k in range(60)] + [f"http://b{k}.example.com/en/7{k}" for k in range(60)]
    urls += [None, "", "no scheme", "HTTP://Sub.Example.NET/de/8x?y#z", "http://example.netx/de/1", "http://q.net/de/9", "http://x.example.com/fr/1"]
    rows = {r["page_id"]: r for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert len(rows) == len(urls)
    assert (rows[1]["rule"], rows[1]["verdict"]) == ("com/en/", "block") and (rows[61]["rule"], rows[61]["verdict"]) == ("example.com/en/7", "allow")
    assert all((rows[k]["host"], rows[k]["path"], rows[k]["rule"]) == ("", "", None) for k in (120, 121, 122))
    assert (rows[123]["host"], rows[123]["path"], rows[123]["rule"]) == ("sub.example.net", "/de/8x", "example.net/de/8")
    assert rows[124]["rule"] is None and rows[125]["rule"] == "net/de/" and rows[126]["verdict"] in ("allow", "block")


def test_verdict_of_each_rule(spark):
    told = {"com/en/": ("http://q.com/en/1", "block"), "example.com/en/7": ("http://a.example.com/en/71", "allow"), "net/de/": ("http://q.net/de/1", "allow"), "example.net/de/8": ("http://a.example.net/de/81", "block"), "org/es/": ("http://q.org/es/1", "block")}
    rows = [(rule, url) for rule, (url, _) in told.items()]
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id string, url string")).collect()}
    assert found == {rule: (rule, says) for rule, (_, says) in told.items()}
