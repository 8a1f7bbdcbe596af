"""SimHash, nearest neighbours, url rules, packing, chats against plain versions of themselves."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import ann, chat_format, packing, simhash, url_filter
from tessera.llm.components import components


def plain_fingerprint(text, k=3):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, distance=3):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fs = sorted(fps)
    for i, a in enumerate(fs):
        for b in fs[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in fps}


def plain_near_copies(rows, distance=7, similarity=0.8):
    """The least id of each row's group: all pairs compared by fingerprint and whole shingle sets."""
    rows = sorted((i, (t or "").encode().lower().split()) for i, t in rows)
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for _, w in rows]
    fps = [simhash.fingerprint(b" ".join(w).decode(), 1, True) for _, w in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if rows[a][1] == rows[b][1] or ((fps[a] ^ fps[b]).bit_count() <= distance and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return {i: rows[r][0] for (i, _), r in zip(rows, root, strict=True)}


def near_rows(n=120, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            w = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(["x", "y", "Ünd", "Z"])
        else:
            w = ["".join(rng.choices("abcdeÉ", k=3)) for _ in range(rng.choice([1, 2, 3, 40, 200]))]
        rows.append((1000 - i, " ".join(w)))
    return [*rows, (1, None), (2, ""), (3, "\n\t"), (4, "A"), (5, "a"), (6, "one\x0btwo"), (7, "word " * 40_000)]


@pytest.mark.parametrize("distance,limit", [(3, 4096), (3, 1), (9, 4096)])
def test_near_duplicates_match_plain_version(spark, distance, limit):
    rows = near_rows()
    df = spark.createDataFrame([(i, t, "e") for i, t in rows], "doc_id long, text string, component_id string")
    old = simhash.links.__defaults__
    simhash.links.__defaults__ = (3, limit, 16)  # small chunks, so that groups split into cells
    try:
        got = {r.doc_id: r for r in simhash.near_duplicates(df, distance=distance).collect()}
    finally:
        simhash.links.__defaults__ = old
    fps = {i: plain_fingerprint(t) for i, t in rows}
    roots = plain_components(set(fps.values()), distance)
    least = {}
    for i, f in fps.items():
        least[roots[f]] = min(i, least.get(roots[f], i))
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == {i: least[roots[f]] for i, f in fps.items()}


def test_one_row_of_each_component_stays(spark):
    text = " ".join(f"word{i}" for i in range(300))
    rows = [(5, text), (3, text), (9, text.replace("word7 ", "other ")), (4, "something else entirely " * 5), (None, text)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int")
    kept = simhash.drop_near_duplicates(df)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4] and kept.columns == df.columns
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0
    odd = df.select("*", *[F.lit(n).alias(n) for n in ("_keep", "_KEEP_", "_doc", "_min", "node", "root", "a.b")])
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id, r._keep, r["a.b"]) for r in kept.collect()) == [(3, "_keep", "a.b"), (4, "_keep", "a.b")]


@pytest.mark.parametrize("cell,chunk", [(8192, 2_000_000), (8, 600)])
def test_near_copies_are_verified(spark, monkeypatch, cell, chunk):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = [(900 - i, w) for i, w in enumerate([base, base[::-1], base[60:] + base[:60], [*base[:119], "Ünd"]])]
    for i in range(60):  # from copies with one edit to texts of the same words in other orders
        w = list(rng.choice(rows)[1])
        for _ in range(rng.choice([0, 1, 1, 3, 8])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
        rows.append((i, w))
    rows = [(i, rng.choice([" ", "\n"]).join(w)) for i, w in rows] + [(1000, None), (1001, ""), (1002, "a"), (1003, "A"), (1004, "a b"), (1005, "word " * 50_000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, _x int")
    monkeypatch.setattr(simhash.links, "__defaults__", (3, 1, cell))
    monkeypatch.setattr(simhash.verified_links, "__defaults__", (chunk,))
    want = {i for i, least in plain_near_copies(rows).items() if i == least}
    assert 10 < len(want) < 60 and {r.doc_id for r in simhash.drop_near_duplicates(df).collect()} == want


@pytest.mark.parametrize("few", [0, 64])
def test_set_forest_is_decided_by_sets_alone(few):
    rng = random.Random(4)
    sets = [np.arange(0), np.arange(0)]
    for i in range(150):
        x = {*range(40), *rng.sample(range(40, 10**6), rng.choice([3, 60, 160]))} if i < 40 or rng.random() < 0.2 else set(rng.choice(sets[2:]).tolist())
        for _ in range(rng.choice([0, 1, 4, 12])):
            x.discard(rng.choice(sorted(x)))
            x.add(rng.randrange(10**6))
        sets.append(np.array(sorted(x)))
    sets = [x.astype(np.uint64) for x in sets]
    root = {i: i for i in range(len(sets))}
    for a in range(len(sets)):
        for b in range(a):
            if simhash.similar(sets[a], sets[b]) and root[a] != root[b]:
                x, y = sorted((root[a], root[b]))
                root = {i: x if r == y else r for i, r in root.items()}
    got = list(range(len(sets)))
    pairs = simhash.set_forest(sets, few=few)
    for a, b in pairs:
        assert simhash.similar(sets[a], sets[b])
        x, y = sorted((got[a], got[b]))
        assert x != y
        got = [x if r == y else r for r in got]
    assert got == [root[i] for i in range(len(sets))] and 20 < len(set(got)) < 140


def test_verified_links_ignore_fingerprints(spark):
    base = [f"w{i}" for i in range(400)]
    longer = (" ".join([*base, *[f"tail{k}_{i}" for i in range(90)]]) for k in range(1000))
    far = lambda t: (simhash.fingerprint(t, 1, True) ^ simhash.fingerprint(" ".join(base), 1, True)).bit_count()
    rows = [(1, " ".join(base)), (2, next(t for t in longer if far(t) > 7))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    own = simhash.sketches(df, "doc_id", "text")
    texts = own.select("_node", F.col("_doc").alias("_least"), "_id", "_size")
    least = min(r._id for r in own.collect())
    roots = own.select(F.col("_id").alias("node"), F.lit(least).alias("root"))
    got = simhash.verified_links(texts, roots, df, "doc_id", "text", similarity=0.8).collect()
    assert len({frozenset((r.a, r.b)) for r in got}) == 1


def edited(rng, words, kind, share):
    """``words`` with a share of them replaced in passages, cut from the end, or another text's words appended; or single words replaced."""
    n = int(len(words) * share)
    other = [f"o{rng.randrange(10**9)}" for _ in range(n)]
    if kind == "cut":
        return words[: len(words) - n]
    if kind == "append":
        return words + other
    if kind == "passage":
        at = rng.randrange(len(words) - n)
        return words[:at] + other + words[at + n :]
    out = list(words)
    for i in rng.sample(range(len(words)), max(1, n // 5)):
        out[i] = f"o{rng.randrange(10**9)}"
    return out


@pytest.mark.parametrize("kind", ["cut", "append", "passage", "scattered"])
def test_candidates_hold_near_copies_of_any_edit(kind):
    rng = random.Random(6)
    far = lost = near = 0
    for _ in range(300):
        words = [f"w{rng.randrange(10**9)}" for _ in range(rng.randint(100, 600))]
        copy = edited(rng, words, kind, rng.choice([0.04, 0.08, 0.1]) if kind in ("passage", "scattered") else rng.uniform(0.1, 0.19))
        a, b = (simhash.shingle_set(simhash._word_hashes([x.encode() for x in w])) for w in (words, copy))
        if simhash.similar(a, b):
            near += 1
            far += (simhash.fingerprint(" ".join(words), 1, True) ^ simhash.fingerprint(" ".join(copy), 1, True)).bit_count() > 7
            x, y = simhash.minima(a), simhash.minima(b)
            lost += not (simhash.bands(x) == simhash.bands(y)).any() or np.bitwise_count(simhash.sketch(a) ^ simhash.sketch(b))[0] > simhash.SKETCH_DISTANCE
    assert near > 200 and lost <= 1 and (far > near / 10 or kind in ("passage", "scattered"))


@pytest.mark.parametrize("small,cell,chunk", [(16, 8192, 2_000_000), (1, 8, 2000)])
def test_near_copies_match_brute_force_on_similarity(spark, monkeypatch, small, cell, chunk):
    rng = random.Random(8)
    rows = []
    for i in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(100, 300))]
        rows += [(i, words), *[(100 + 4 * i + k, edited(rng, words, kind, rng.uniform(0.02, 0.25))) for k, kind in enumerate(["cut", "append", "passage", "scattered"])]]
    rng.shuffle(rows)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in rows}
    least = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and least[a] != least[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((least[a], least[b]))
                least = {i: x if r == y else r for i, r in least.items()}
    monkeypatch.setattr(simhash.band_links, "__defaults__", (small, cell))
    monkeypatch.setattr(simhash.verified_links, "__defaults__", (chunk,))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    want = {i for i, r in least.items() if i == r}
    assert 40 < len(want) < 150 and {r.doc_id for r in simhash.drop_near_duplicates(df).collect()} == want


@pytest.mark.parametrize("small,chunk", [(16, 8192), (0, 8)])
def test_index_of_fingerprints_joins_all_texts_within_its_distance(spark, small, chunk):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 12, np.uint64)
    rows = []
    for i in range(150):
        fp = int(base[i % 12])
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            fp ^= 1 << int(b)
        rows.append((1000 + i, int(np.array(fp, np.uint64).view(np.int64))))
    rows += [(2000 + i, rows[0][1]) for i in range(20)]  # many texts of one fingerprint
    found = simhash.print_links(spark.createDataFrame(rows, "_id long, _fp long"), 3, small, chunk).collect()
    fps = dict(rows)
    parent = {i: i for i in fps}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    assert all((fps[r.a] ^ fps[r.b]).bit_count() <= 3 or ((fps[r.a] ^ fps[r.b]) & ((1 << 64) - 1)).bit_count() <= 3 for r in found)
    for r in found:
        parent[top(r.a)] = top(r.b)
    ids = list(fps)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            if ((fps[i] ^ fps[j]) & ((1 << 64) - 1)).bit_count() <= 3:
                assert top(i) == top(j)


def test_fingerprints_of_shingle_sets_follow_their_majority():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 5, 70_000):
        h = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
        want = sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > n)
        assert int(simhash.print_of(h)[0]) == want


def test_sketches_follow_similarity():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 3000, np.uint64)
    bits = lambda a, b: int(np.bitwise_count(simhash.sketch(a) ^ simhash.sketch(b)).sum())
    near = [bits(x[i : i + 900], x[i + 100 : i + 1000]) for i in range(0, 1000, 50)]
    assert max(near) <= simhash.SKETCH_DISTANCE and abs(np.mean(near) - 6.4) < 3
    assert bits(x[:900], x[1000:1900]) > simhash.SKETCH_DISTANCE and len(simhash.sketch(x[:0])) == 1
    assert simhash.similar(np.arange(10), np.arange(2, 10)) and not simhash.similar(np.arange(10), np.arange(3, 10))
    assert simhash.similar(np.arange(0), np.arange(0))


def test_plan_thresholds_cover_the_distance():
    rng = np.random.default_rng(0)
    bits = (rng.random((500, 64)) < rng.random(64)).astype(float)
    bits[:, 1] = bits[:, 0]
    for n in (500, 10**6, 10**10):
        for d in (1, 3, 7):
            parts = simhash.plan(n, bits.sum(0) * n / 500, bits.T @ bits * n / 500, d)
            assert sum(p.threshold + 1 for p in parts) == d + 1 and sorted(b for p in parts for b in p.bits) == list(range(64))
    assert len(simhash.plan(10**10, bits.sum(0) * 2e7, bits.T @ bits * 2e7, 3)) < len(simhash.plan(500, bits.sum(0), bits.T @ bits, 3))


def test_components_of_a_long_path(spark):
    got = components(spark.createDataFrame([(i, i + 1) for i in range(300)] + [(-5, -9)], "a long, b long"))
    assert {(r.node, r.root) for r in got.collect()} == {(i, 0) for i in range(301)} | {(-5, -9), (-9, -9)}


def test_nearest_recall_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 24)) + 3 * rng.standard_normal((10, 24))[rng.integers(0, 10, 3000)]
    x[50:90] = x[10]
    rows = [(i, v.tolist(), "z") for i, v in enumerate(x)] + [(5000, None, "z"), (5020, [0.0] * 24, "z"), (5040, [float("nan")] * 24, "z"), (5060, [None] * 24, "z"), (5080, [], "z"), (None, x[0].tolist(), "z"), (5100, [1.0, 2.0], "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    p = ann.Params(block=1000, queries=40)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, params=p).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 3000, 20))
    hits = 0
    for q, found in got.items():
        found.sort()
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(3000), -s))[:20]
        assert [r for r, _, _ in found] == list(range(1, 21)) and np.allclose([v for _, _, v in found], s[[i for _, i, _ in found]])
        assert [(-v, i) for _, i, v in found] == sorted((-v, i) for _, i, v in found)
        hits += len({i for _, i, _ in found} & set(want.tolist()))
    assert hits / (20 * len(got)) >= 0.9


def test_nearest_recall_on_unclustered_vectors_in_several_blocks(spark):
    x = np.random.default_rng(2).standard_normal((24_000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = spark.range(24_000).withColumnRenamed("id", "vec_id")
    df = ids.mapInPandas(lambda parts: (b.assign(embedding=[x[i] for i in b["vec_id"]]) for b in parts), "vec_id long, embedding array<float>")
    p = ann.Params(block=8192)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 400 == 0, params=p).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    y = x.astype(float)
    best = {q: set(np.argsort(-np.where(np.arange(24_000) == q, -9, y @ y[q]), kind="stable")[:20].tolist()) for q in range(0, 24_000, 400)}
    assert sum(len(best[q] & got[q]) for q in best) >= 0.9 * 20 * len(best)
    verified = [len(c) for c in ann.Block(y[:8192], 1.0, p).candidates(y[::400], 20)]
    assert np.mean(verified) < 0.1 * 8192


def test_windows_of_equal_rows_and_of_huge_vectors():
    same = np.ones((500, 3))
    assert [len(c) for c in ann.Block(same, 3.0, ann.Params()).candidates(same[:2], 20)] == [500, 500]
    with np.errstate(all="ignore"):
        huge = np.full((50, 3), 1e200)
        assert [len(c) for c in ann.Block(huge, float("inf"), ann.Params()).candidates(huge[:1], 5)] == [50]


def test_nearest_with_few_or_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (20, [1.0, 0.0])], schema)
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect()]
    assert sorted(got) == [(0, 1, 20), (0, 2, 1), (0, 3, 2), (20, 1, 0), (20, 2, 1), (20, 3, 2)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(df.limit(1), F.col("vec_id") % 20 == 0).count() == 0


def plain_verdict(url):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:].split("?")[0].split("#")[0]
    fit = [(len(h + p), h + p, v) for h, p, v in url_filter.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, None))


def test_urls_match_plain_version(spark):
    rng = random.Random(4)
    hosts = ["com", "example.com", "www.example.com", "WWW.Example.COM", "notexample.com", "a.net", "net", "x.org", "cheap-pills.org", "a.www.example.com", ""]
    paths = ["", "/", "/en/", "/en", "/en/5", "/es/x", "/fr/", "/EN/1", "//", "?q=/en/", "#/es/", "/es/?a#b", "?x=b.com/y", "#b.com/en/", "/?u=www.example.com/en/", ":80/en/", ":8080/", "?b.net/es/", "/a.com/", "@b.com/x"]
    urls = [rng.choice(["http://", "https://", "://", "", "x"]) + rng.choice(hosts) + rng.choice(paths) for _ in range(400)] + [None, "", "http://a://b/c", "http://net/es/\nx", "http://a?x=b.com/y", "http://a#b.com/y", "http://a#x.example.com/en/", "http://a.com:80/", "http://u:p@example.com/en/?"]
    df = spark.createDataFrame([(i % 300, u, "old") for i, u in enumerate(urls)] + [(None, urls[0], "old")], "page_id long, url string, rule string")
    out = url_filter.judge_urls(df)
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict"] and out.count() == len(urls) + 1
    for r in out.collect():
        host, path, rule, verdict = plain_verdict(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if "cheap-pills" in host else "allow"))


def plain_filter(line, url):
    """Whether a filter line fits, by trying every start and every way to match."""
    body = line.removeprefix("@@")
    host, start, end = body.startswith("||"), body.startswith("|"), body.endswith("|")
    body, url = body.strip("|").lower(), url.lower()

    def fits(i, j):
        if j == len(body):
            return not end or i == len(url)
        if body[j] == "*":
            return any(fits(k, j + 1) for k in range(i, len(url) + 1))
        if body[j] == "^":
            return (i == len(url) and fits(i, j + 1)) or (i < len(url) and not (url[i].isascii() and url[i].isalnum()) and url[i] not in "_.%-" and fits(i + 1, j + 1))
        return i < len(url) and url[i] == body[j] and fits(i + 1, j + 1)

    name = next((k for k, c in enumerate(url) if c in "/?#"), len(url))
    starts = [0, *[k + 1 for k in range(name) if url[k] == "."]] if host else [0] if start else range(len(url) + 1)
    return any(fits(i, 0) for i in starts)


def test_filter_lines_match_plain_version(spark):
    lines = ["||ads.", "/banner/*.gif|", "^id=7^", "-x-", "|shop.", "@@||good.org^", "a*b", "||xn--p1ai^", "/q^", "@@/library/", "promo"]
    rng = random.Random(6)
    hosts, tails = ["ads.com", "my.ads.org", "badads.com", "shop.de", "my.shop.de", "good.org", "sub.good.org", "good.orgs", "xn--p1ai"], ["", "/", "/banner/a/b.GIF", "/banner/b.gif?", "?id=7", "?id=77&x", "/a-x-b", "/q", "/q?z", "/queue", "/library/ads.x", "/a/b", "/Promo/", "/promos"]
    urls = [rng.choice(hosts) + "".join(rng.choices(tails, k=rng.randint(1, 2))) for _ in range(300)] + ["", "a" * 30_000 + "/q"]
    df = spark.createDataFrame([(i, "http://" + u) for i, u in enumerate(urls)], "page_id long, url string")
    for r in url_filter.judge_urls(df, [url_filter.filter_rule(x) for x in lines]).collect():
        hit = [x for x in lines if plain_filter(x, urls[r.page_id])] if len(urls[r.page_id]) < 1000 else ["/q^"]
        assert r.verdict == ("allow" if not hit or any(x.startswith("@@") for x in hit) else "block"), (urls[r.page_id], hit)
    assert url_filter.filter_rule("/banner/*.gif|").tokens == ("banner", "gif") and url_filter.filter_rule("promo").tokens == ()
    assert len(url_filter.default_rules()) > 250 and all(r.tokens for r in url_filter.default_rules())


def test_published_filter_lists_are_read(spark):
    lines = ["[Filter list 2.0]", "! title", "", "||ads.example^", "||ads.example^", "@@||ads.example/fine/", "/banner/*/img^", "example.com##.ad", "example.com#@#.ad", "||track.example^$third-party,domain=a.com", "|https://", r"/\/ad[0-9]+\.gif/", "*", "/plain/"]
    rules, left = url_filter.read_filter_list(lines)
    assert [r.name for r in rules] == ["||ads.example^", "@@||ads.example/fine/", "/banner/*/img^", r"/\/ad[0-9]+\.gif/", "/plain/"]
    assert left == ["example.com##.ad", "example.com#@#.ad", "||track.example^$third-party,domain=a.com", "|https://", "*"]
    urls = {"http://ads.example/x": "block", "http://my.ads.example/fine/x": "allow", "http://a.b/banner/1/img": "block", "http://a.b/AD12.gif": "block", "http://a.b/adx.gif": "allow", "http://a.b/plain/": "block", "http://a.b/plainly/": "allow"}
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert {r.url: r.verdict for r in url_filter.judge_urls(df, rules).collect()} == urls


def test_urls_with_clashing_columns_and_blocked_by_the_filter_list(spark):
    df = spark.createDataFrame([(1, "https://a.org/en/1?page=2&ref=x", 7, "h"), (2, "https://a.org/library/?ref=x", 8, "h"), (3, "https://poker.org/", 9, "h")], "page_id long, url string, _best int, _host string")
    df = df.select("*", *[F.lit(n).alias(n) for n in ("id", "subject", "_id", "_subject", "row", "best", "word", "chosen", "a.b")])
    out = url_filter.judge_urls(df).orderBy("page_id")
    assert [(r.verdict, r._best, r._host, r.best, r["a.b"]) for r in out.collect()] == [("block", 7, "h", "best", "a.b"), ("allow", 8, "h", "best", "a.b"), ("block", 9, "h", "best", "a.b")]


def test_url_rules_without_tokens_and_without_urls(spark):
    df = spark.createDataFrame([(1, "http://a.b/zz9"), (2, "http://a.b/")], "page_id long, url string")
    loose = url_filter.UrlRule("digits", r"\d", (), "block", 5)
    assert {(r.page_id, r.rule, r.verdict) for r in url_filter.judge_urls(df, [loose]).collect()} == {(1, "digits", "block"), (2, None, "allow")}
    assert url_filter.judge_urls(df.limit(0)).count() == 0 and {r.verdict for r in url_filter.judge_urls(df, []).collect()} == {"allow"}


def test_packing_is_whole_and_fits(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([0, 1, 5, 300, 1024, 1500, 8192, 9000, 40_000])) for i in range(800)] + [(None, 7), (900, None), (901, -4), (5, 5), (5, 5)]
    df = spark.createDataFrame([(i, n, 0) for i, n in rows], "doc_id long, n_tokens long, bin long")
    out = [r.asDict() for r in packing.best_fit(df, shard_pieces=200).collect()]
    total = {}
    for r in out:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
    want = {}
    for i, n in rows:
        want[i] = want.get(i, 0) + max(n or 0, 0)
    assert total == want
    bins = {}
    for r in out:
        if r["bin"] is None:
            assert (r["n_tokens"], r["bin_offset"], r["bin_length"]) == (0, 0, 0)
        else:
            bins.setdefault(r["bin"], []).append(r)
    assert {r["bin"] for r in packing.bins(packing.best_fit(df, shard_pieces=200)).collect()} == set(bins)
    used = room = 0
    for rs in bins.values():
        size, at = {r["bin_length"] for r in rs}, 0
        assert len(size) == 1
        for r in sorted(rs, key=lambda r: (r["bin_offset"], r["n_tokens"])):
            assert r["bin_offset"] == at
            at += r["n_tokens"]
        size = size.pop()
        assert at <= size and size == min(c for c in packing.LENGTHS if c >= at)
        used, room = used + at, room + size
    assert used / room > 0.9
    assert packing.best_fit(df.limit(0)).count() == 0 and sum(r["n_tokens"] for r in out) == used


def plain_pack(sizes, lengths, bin_cost, attention):
    """Contents of bins and their final lengths, looking at all bins and all later pieces each time."""
    left, bins = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)), []
    while left:
        i = left.pop(0)
        fit = [b for b in bins if b["length"] - b["used"] >= sizes[i]]
        if fit:
            b = min(fit, key=lambda b: (b["length"] - b["used"], b["number"]))
        else:
            def price(c, i=i):
                load = sizes[i] + sum(sizes[j] for j in left if sizes[j] <= c - sizes[i])
                return (bin_cost + c + c * c / attention) / min(c, load)

            b = {"number": len(bins), "length": min((c for c in lengths if c >= sizes[i]), key=lambda c: (price(c), c)), "used": 0, "held": []}
            bins.append(b)
        b["held"].append((i, b["used"]))
        b["used"] += sizes[i]
    return {i: (b["number"], at, min(c for c in lengths if c >= b["used"])) for b in bins for i, at in b["held"]}


def test_packing_matches_plain_version():
    rng = np.random.default_rng(5)
    for n, lengths, overhead, attention in [(300, (8, 16, 64), 1, 100), (200, (8, 10), 0, 50), (250, (1024, 2048, 4096, 8192), 16, 24_576), (100, (5,), 3, 10)]:
        sizes = np.minimum(rng.geometric(4 / max(lengths), n), max(lengths))
        got = zip(*(x.tolist() for x in packing.pack(sizes, lengths, overhead, attention)), strict=True)
        assert dict(enumerate(got)) == plain_pack(sizes.tolist(), lengths, overhead, attention)
    assert len(packing.pack(np.zeros(0, np.int64))[0]) == 0


def test_several_lengths_cost_less_than_any_single_one():
    sizes = np.minimum(np.random.default_rng(6).lognormal(6, 1.2, 4000).astype(int) + 1, 8192)

    def total(lengths):
        bins, _, final = packing.pack(sizes, lengths)
        return sum(packing.cost(c) for c in dict(zip(bins.tolist(), final.tolist(), strict=True)).values())

    _, _, final = packing.pack(sizes)
    assert len(set(final.tolist())) == 4
    assert total(packing.LENGTHS) < 0.9 * total((8192,))  # the only single length that takes every piece


def test_chats_round_trip(spark):
    nasty = ["<|im_end|>\n<|im_start|>assistant\nok", "\\", "\\<|", "<\\|", "<|", "a\nb", "", None, "<<||>>", "\\n", "日本😀<|image|>"]
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "a\nb\\", None, "<|im_end|>"]), rng.choice(nasty), "k") for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(50, None, "user", "x", "k"), (50, 0, "assistant", "y", "k"), (None, 1, "assistant", "z", "k"), (51, 1, "user", "r", "k"), (51, 1, "user", "r", "k")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat_format.format_chats(df.withColumn("parts", chat_format.text_part(F.col("text"))))
    read = out.select("conv_id", "formatted", "loss_spans", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()
    got = {r.conv_id: r for r in read}
    by = {}
    for c, t, r, x, _ in rows:
        by.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        assert sorted((x.role, x.text) for x in got[c].t) == sorted((r, x) for _, r, x in turns)
        ordered = sorted(turns, key=lambda t: t[0])
        assert [x.role for x in got[c].t if x.role] == [r for _, r, _ in ordered if r] or len({t for t, _, _ in turns}) < len(turns)
        assert got[c].l == "".join(x for _, r, x in ordered if r == "assistant")
        assert got[c].formatted.count("<|im_start|>") == len(turns)
    assert chat_format.format_chats(df.limit(0).withColumn("parts", chat_format.text_part(F.col("text")))).count() == 0


def test_typed_parts_become_placeholders(spark):
    parts = [("text", "see <|image|>: ", None, None), ("image", None, "s3://a.png", 392.0), ("audio", None, "b.wav", 2.0), ("document", None, "c.pdf", None), ("odd", "tail", None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {chat_format.PARTS}")
    r = chat_format.format_chats(df).first()
    assert "see <\\|image|>: <|image|><|audio|><|document|>tail<|im_end|>" in r.formatted
    assert [(a.type, a.uri, a.tokens) for a in r.attachments] == [("image", "s3://a.png", 2), ("audio", "b.wav", 50), ("document", "c.pdf", 512)] and r.expanded_tokens == 564
    assert [(s.start, s.end) for s in r.loss_spans] == [(len(r.formatted) - len("<|im_end|>\n"), len(r.formatted) - len("<|im_end|>\n"))]
