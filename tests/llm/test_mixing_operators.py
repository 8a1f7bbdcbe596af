"""Fill-in-middle, mixing and resampling against plain versions of themselves."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import fim, mixing, queries, resampling

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(seed, i):
    x = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    return [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]


# ---- fill-in-middle


def plain_fim(i, text):
    t = text or ""
    h, n = digest(1, i), len(t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return t, "plain", n, None, None
    if h[3] % 100 < 20:
        return f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}", "spm", n, a, b - a
    return f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}", "psm", n, a, b - a


def test_fill_in_middle_matches_plain_version_and_reads_back(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("ab é日😀\n\r\t<>SPḾ‍", k=rng.randint(0, 40)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "x<S>y"), (303, "<P"), (304, "é😀\r\n" * 50_000), (None, "null id"), (1, rows[1][1]), (305, "<" * 600)]
    df = spark.createDataFrame([(i, t, "kept", 7) for i, t in rows], "doc_id long, text string, form string, `a.b` int")
    out = fim.fill_in_middle(df).withColumn("back", fim.restore(F.col("fim_text"), F.col("form"))).collect()
    key = lambda r: repr(r)
    got = sorted(((r.doc_id, r.text, r.fim_text, r.form, r.n_units, r.prefix_chars, r.middle_chars) for r in out), key=key)
    assert got == sorted(((i, t, *plain_fim(i, t)) for i, t in rows), key=key)
    assert all(r.back == (r.text or "") and r["a.b"] == 7 for r in out) and {r.form for r in out} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(df.limit(0)).count() == 0


def test_fill_in_middle_by_other_units_and_marks(spark):
    words = fim.Cutter(r"\S+")
    assert words.ends("ab  c\n") == [2, 4, 5, 6] and words.cut("ab  c\n", lambda n: (1, n)) == (4, [2, 6])  # what lies between matches is a unit too
    marks = ("[[p]]", "[[s]]", "[[m]]")
    df = spark.createDataFrame([(i, f"one two three {i} four") for i in range(40)], "doc_id long, text string")
    out = fim.fill_in_middle(df, pattern=r"\S+", marks=marks, plain_from=100).withColumn("back", fim.restore(F.col("fim_text"), F.col("form"), marks)).collect()
    assert all(r.back == r.text and r.n_units == 9 and r.form != "plain" for r in out)
    assert {len(r.text[: r.prefix_chars].split()) for r in out} > {0, 2}
    for bad in (("<P>", "P>", "<M>"), ("<P>", "<P>", "<M>"), ("aa", "b", "c"), ("", "b", "c")):
        with pytest.raises(ValueError):
            fim.check_marks(bad)


def test_words_and_blocks_of_a_text_give_the_places_of_all_units(monkeypatch):
    monkeypatch.setattr(fim, "REMEMBERED", 20)
    cutter, rng = fim.Cutter(), random.Random(2)
    for n in (0, 1, 7, fim.BLOCK - 1, fim.BLOCK, fim.BLOCK + 1, 3 * fim.BLOCK):
        for spaces in ("", " ", "      "):
            text = "".join(rng.choices("a\n😀é\u0301" + spaces, k=n))
            ranks = tuple(range(n + 1))
            assert cutter.cut(text, lambda m: ranks) == (n, list(ranks))  # noqa: B023
    assert cutter.cut("ab", lambda m: None) == (2, [])


def test_fill_in_middle_query_matches_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = queries.op11_fill_in_middle(spark, SF)
    want = con.sql(queries.ORACLE_SQL["op11_fill_in_middle"])
    assert df.columns == want.columns and sorted(map(tuple, df.collect()), key=repr) == sorted(want.fetchall(), key=repr)


# ---- mixing


def spark_hash(seed, *longs):
    h = xxhash.xxh64_intdigest(struct.pack("<I", seed), 42)  # an int literal comes first
    for x in longs:
        h = xxhash.xxh64_intdigest(struct.pack("<q", x), h) if x is not None else h
    return h - (1 << 64) if h >> 63 else h


def plain_mix(rows, weights=(1, 2, 3), most=3, seed=12, fan_in=32):
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total = {s: sum(z for z, r in zip(sizes, rows, strict=True) if r[2] == s) for s in names}
    full, words = set(), sum(sizes)
    while True:
        left, w = words - sum(most * total[s] for s in full), sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and weight[s] * left > most * total[s] * w}
        if not over:
            break
        full |= over
    target = {s: float(most * total[s]) if s in full else weight[s] * left / w for s in names}
    copies = {}
    for s in names:
        mine = [k for k, r in enumerate(rows) if r[2] == s]
        want = target[s] / total[s] if total[s] else 0.0
        base = math.floor(want + 1e-12)
        part = want - base if want - base > 1e-12 else 0.0
        for k in mine:
            copies[k] = base
        level = [(k, spark_hash(seed, rows[k][0]), float(sizes[k]), sizes[k] * part) for k in sorted((k for k in mine if sizes[k] and part), key=lambda k: (-sizes[k], spark_hash(seed, rows[k][0]), rows[k][0], k))]
        while len(level) > 1:
            nxt = []
            for g in range(0, len(level), fan_in):
                e = level[g]
                for x in level[g + 1 : g + fan_in]:
                    both = e[3] + x[3]
                    down, up = min(e[3], x[2] - x[3]), min(e[2] - e[3], x[3])
                    u = ((spark_hash(seed, e[1], x[1]) & (1 << 64) - 1) >> 11) / float(1 << 53)
                    give = u * (down + up) < up
                    first = both <= x[2] if give else e[2] <= both
                    gone, kept, taken = (e, x, not give) if first else (x, e, give)
                    if taken:
                        copies[gone[0]] += 1
                    e = (*kept[:3], max(both - (gone[2] if taken else 0.0), 0.0))
                nxt.append(e)
            level = nxt
        if level and 2 * level[0][3] >= level[0][2]:
            copies[level[0][0]] += 1
    return [(i, s, z, total[s], target[s], copies[k] * z) for k, ((i, _, s), z) in enumerate(zip(rows, sizes, strict=True))]


def mixed(spark, rows, **kwargs):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, row string, target int")
    return [(r.doc_id, r.source, r["size"], r.source_size, r.target, r.taken) for r in mixing.mix_sources(df, **kwargs).collect()]


def corpus(n, seed=3):
    rng = random.Random(seed)
    hot = lambda: rng.choice(["hot"] * 4 + ["b", "c", "é", "\U0001f600", "", None, "rare"])
    return [(i, "w " * int(rng.paretovariate(0.9) + rng.random()), hot()) for i in range(n)]


@pytest.mark.parametrize("fan_in", [2, 5, 32])
def test_mixing_matches_plain_version(spark, fan_in):
    rows = [*corpus(400), (1000, None, "b"), (1001, "", "hot"), (1002, " \t\n", "only blanks"), (1003, "x\x0by\x1cz", "c"), (1004, "big " * 30_000, "b")]
    got, want = mixed(spark, rows, fan_in=fan_in), plain_mix(rows, fan_in=fan_in)
    key = lambda r: (r[0], r[2])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-12) and a[5] == b[5]


def test_mixed_words_come_near_their_targets_and_reruns_agree(spark):
    rows = corpus(3000, 11)
    got = mixed(spark, rows)
    largest, taken, target = defaultdict(int), defaultdict(int), {}
    for _, s, size, whole, t, n in got:
        largest[s], taken[s], target[s] = max(largest[s], size), taken[s] + n, t
        assert n in (0, size, 2 * size, 3 * size) and t <= 3 * whole
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in target)
    assert sum(target.values()) == pytest.approx(sum(g[2] for g in got))
    again = mixed(spark, random.Random(1).sample(rows, len(rows)))
    assert sorted(again, key=repr) == sorted(got, key=repr)


def test_chances_of_one_more_copy_are_kept(spark):
    """Over many seeds each document is taken as often as its target says."""
    df = spark.createDataFrame([(i, "w " * (1 + i % 7), "a" if i < 40 else "b") for i in range(60)], "doc_id long, text string, source string")
    runs = [mixing.mix_sources(df, weights=(2, 1), seed=s).where("source = 'a'").select("doc_id", "copies", (F.col("target") / F.col("source_size")).alias("want")) for s in range(12)]
    every = runs[0]
    for r in runs[1:]:
        every = every.unionByName(r)
    got = every.groupBy(F.col("doc_id") % 2).agg(F.avg("copies").alias("mean"), F.first("want").alias("want")).collect()
    assert all(abs(r["mean"] - r["want"]) < 0.1 for r in got)


def test_mixing_of_repeated_rows_and_small_tables(spark):
    same = [(1, "a b c", "s")] * 100 + [(2, "a b", "t")]
    got = mixed(spark, same, weights=(1,))
    assert len(got) == 101 and abs(sum(r[5] for r in got if r[1] == "s") - 296) <= 1.5  # t stops at 6 of 302
    assert sorted(map(repr, got)) == sorted(map(repr, mixed(spark, same, weights=(1,))))
    assert mixed(spark, []) == []
    assert mixed(spark, [(None, "a b", None)]) == [(None, None, 2, 2, 2.0, 2)]
    assert mixed(spark, [(1, None, "s"), (2, "", None)]) == [(1, "s", 0, 0, 0.0, 0), (2, None, 0, 0, 0.0, 0)]


# ---- resampling


def plain_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return w, [zlib.crc32(x.encode()) % 10_000 for x in w] + [zlib.crc32(f"{a} {b}".encode()) % 10_000 for a, b in zip(w, w[1:], strict=False)]


def plain_resample(rows, target, percent=25, least=20):
    own = [plain_features(t) for _, t in rows]
    s, t = Counter(b for _, f in own for b in f), Counter(b for x in target for b in plain_features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in range(10_000)]
    out = []
    for (i, _), (w, f) in zip(rows, own, strict=True):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = digest(7, i)[0]
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    able = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    rank = {x: k + 1 for k, x in enumerate(able[: percent * len(able) // 100])}
    return [(*x[:4], rank.get(x)) for x in out]


def texts(n, seed=4):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "a", "été", "ÉTÉ", "x1", "日本", "na me", "z"]
    return [(i, "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "_", "\x00"]) for _ in range(rng.randint(0, 60)))) for i in range(n)]


def test_resampling_matches_plain_version(spark, monkeypatch):
    rows = [*texts(300), (300, None), (301, ""), (302, " ,.- "), (303, "one"), (304, "copy of two words " * 20), (305, "copy of two words " * 20), (None, "no id " * 15), (306, "again " * 40_000)]
    target = [t for _, t in texts(20, 9)] + [None, ""]
    for block in (resampling.BLOCK_WORDS, 50):  # several suffix arrays in a batch
        monkeypatch.setattr(resampling._blocks, "__defaults__", (block,))
        df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
        out = resampling.resample(df, spark.createDataFrame([(t, 1) for t in target], "text string, id int"))
        got = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out.collect()]
        assert sorted(got, key=repr) == sorted(plain_resample(rows, target), key=repr)


def test_suffix_arrays_group_equal_runs():
    rng = np.random.default_rng(1)
    ids = np.concatenate([np.append(rng.integers(1, 4, rng.integers(0, 30)), 0) for _ in range(40)])
    order, ranks = resampling.suffix_array(ids, 3)
    lists = [list(ids[i : i + 3]) + [0] * 3 for i in range(len(ids))]
    keys = [tuple(lists[i][:3]) for i in order]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(len(ids)))
    shared = resampling.common_prefixes(order, ranks)
    for k in range(1, len(order)):
        a, b = keys[k - 1], keys[k]
        assert shared[k] == next((j for j in range(3) if a[j] != b[j]), 3)


def test_longer_features_and_empty_tables(spark):
    words = [[b"a", b"b", b"a", b"b", b"a"], [], [b"b"], [b"a", b"b", b"a"]]
    got = [g.tolist() for g in resampling.feature_buckets(words, 3, 1 << 16)]
    assert got == [[zlib.crc32(b" ".join(t[i : i + n])) % (1 << 16) for n in (1, 2, 3) for i in range(len(t) - n + 1)] for t in words]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none).count() == 0
    rows = [(1, "word " * 30), (1, "word " * 30), (2, "other " * 30), (3, "short")]
    out = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), none, percent=100).collect()
    assert sorted((r["rank"] or 0) for r in out) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        resampling.resample(none, none, buckets=1 << 17)


def test_resampling_query_on_the_table(spark):
    con = duckdb.connect()
    rows = con.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    target = [r[0] for r in con.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    got = [tuple(r) for r in queries.op13_resample(spark, SF).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert sorted(got, key=repr) == sorted(plain_resample(rows, target), key=repr)
