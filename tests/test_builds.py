"""Canonical values, side-cars and the content-addressed store."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import canonical as cn
from tessera.sources import sidecar, store
from tessera.sources.manifest import ConfigMismatch


def public(x):
    if isinstance(x, dict):
        return {k: public(v) for k, v in x.items() if not k.startswith("_")}
    return [public(v) for v in x] if isinstance(x, list) else x


def random_value(rng, depth):
    kind = rng.random()
    if depth and kind < 0.35:
        return {rng.choice(["b", "a", "_p", "é", 'q"t', "A", "z.y"]) + str(rng.randint(0, 3)): random_value(rng, depth - 1) for _ in range(rng.randint(0, 4))}
    if depth and kind < 0.6:
        return [random_value(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([None, True, False, 0, -7, 12345678901, 2.5, "", "x y", 'quote " back \\ slash', "tab\tline\n", "日本 é", "<tag>/"])


def plain_leaves(x, path=""):
    if isinstance(x, (dict, list)):
        members = sorted(x.items()) if isinstance(x, dict) else list(enumerate(x))
        return [y for k, v in members for y in plain_leaves(v, f"{path}.{k}" if path else str(k))]
    return [(path, None if x is None else x if isinstance(x, str) else json.dumps(x))]


def test_canonical_values_match_plain_json(spark):
    rng = random.Random(8)
    values = [random_value(rng, 4) for _ in range(300)] + [{}, [], None, "s", 1, {"_only": 1}, {"a": {"_b": [1]}}]
    shuffled = lambda x: {k: shuffled(v) for k, v in rng.sample(list(x.items()), len(x))} if isinstance(x, dict) else [shuffled(v) for v in x] if isinstance(x, list) else x
    rows = [(i, json.dumps(v), json.dumps(shuffled(v), indent=2, ensure_ascii=False)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, a string, b string").select("i", F.parse_json("a").alias("a"), F.parse_json("b").alias("b"))
    for r in df.select("i", cn.canonical(F.col("a"), 5).alias("text"), cn.content_key(F.col("b"), 5).alias("key"), cn.leaves(F.col("a"), 5).alias("leaves")).collect():
        want = json.dumps(public(values[r.i]), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        assert json.loads(r.text) == public(values[r.i]) and r.text.replace("\\/", "/") == want
        assert r.key == hashlib.sha256(r.text.encode()).hexdigest()
        assert sorted((x.path, x.value) for x in r.leaves) == sorted(plain_leaves(public(values[r.i])))


def test_values_nested_too_deep_are_errors_not_equal_keys(spark):
    df = spark.createDataFrame([('{"a":{"b":{"c":1}}}',), (None,)], "j string").select(F.parse_json("j").alias("v"))
    assert [r[0] for r in df.select(cn.canonical(F.col("v"), 3)).collect()] == ['{"a":{"b":{"c":1}}}', None]
    for of in (cn.canonical, cn.leaves):
        with pytest.raises(Exception, match="nested too deep"):
            df.select(of(F.col("v"), 1)).collect()


def examples(spark, rows):
    return spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(rows)], "place int, body string")


def key():
    return cn.content_key(F.parse_json("body"), 4)


def build(s, df, seen, **kwargs):
    def make(text):
        seen.add(1)  # an accumulator: builds that retry count again, which local ones don't
        return text.upper().encode()

    return s.build(df, key(), "body", make, **kwargs)


def test_only_edited_examples_are_built_again(spark, tmp_path):
    rows = [{"id": i, "text": f"t{i}", "_seen": i} for i in range(5)]
    s, made = store.Store(spark, str(tmp_path / "s"), {"side": 4}), spark.sparkContext.accumulator(0)
    assert s.manifest().count() == 0 and s.entries().count() == 0
    got = build(s, examples(spark, rows), made)
    assert (got["num_examples"], got["num_built"], got["num_skipped_existing"], made.value) == (5, 5, 0, 5)
    again = [dict(reversed(r.items())) | {"_seen": 99} for r in rows]  # other order, other private fields
    again[3]["text"] = "edited"
    got = build(s, examples(spark, [*again, again[0]]), made)  # and one example twice
    assert (got["num_examples"], got["num_built"], got["num_skipped_existing"], made.value) == (6, 1, 5, 6)
    assert s.manifest().count() == 6 and s.entries().count() == 6
    assert build(store.Store(spark, str(tmp_path / "s"), {"side": 4}), examples(spark, rows), made)["num_built"] == 0
    paths = {r.cache_path for r in s.manifest().collect()}
    assert all(p == f"entries/{p[8:10]}/{p[11:75]}.pt" for p in paths) and len(paths) == 6
    everything = build(s, examples(spark, rows), made, overwrite=True)
    assert everything["num_built"] == 5 and s.manifest().count() == 6 and s.entries().count() == 6
    assert everything["total_bytes"] == sum(len(json.dumps(r)) for r in rows)


def test_stores_of_another_config_are_errors(spark, tmp_path):
    store.Store(spark, str(tmp_path / "s"), {"side": 4, "max": None})
    store.Store(spark, str(tmp_path / "s"), {"max": None, "side": 4})
    with pytest.raises(ConfigMismatch, match="config.side"):
        store.Store(spark, str(tmp_path / "s"), {"side": 5, "max": None})
    with pytest.raises(ConfigMismatch, match="config.max"):
        store.Store(spark, str(tmp_path / "s"), {"side": 4})


def test_a_build_that_dies_leaves_nothing_that_counts(spark, tmp_path):
    rows = [{"id": i} for i in range(4)]
    s, made = store.Store(spark, str(tmp_path / "s"), {}), spark.sparkContext.accumulator(0)

    def broken(text):
        if "2" in text:
            raise RuntimeError("no such frame")
        return b"x"

    with pytest.raises(Exception, match="no such frame"):
        s.build(examples(spark, rows), key(), "body", broken)
    assert s.manifest().count() == 0 and s.entries().count() == 0
    # Entries that were written but never listed don't count either.
    spark.createDataFrame([("k", b"x")], store.ENTRIES).write.parquet(f"{s.root}/entries/000000-lost")
    assert s.entries().count() == 0 and build(s, examples(spark, rows), made)["num_built"] == 4 and s.entries().count() == 4


def test_side_cars_are_required_and_compared(spark, tmp_path):
    path, settings = str(tmp_path / "t"), {"preview": {"frames": 8}, "prompt": {"style": "é"}}
    df = spark.range(3)
    df.write.parquet(path)
    with pytest.raises(sidecar.MetadataMismatch, match="missing"):
        sidecar.read_table(spark, path, 1)
    sidecar.write_table(df, path, 1, settings, rows=3)
    assert sidecar.read_table(spark, path, 1, settings).count() == 3
    assert sidecar.require_metadata(spark, path, 1)["rows"] == 3
    with pytest.raises(sidecar.MetadataMismatch, match="version 1, not 2"):
        sidecar.read_table(spark, path, 2, settings)
    other = settings | {"prompt": {"style": "e"}}
    with pytest.raises(sidecar.MetadataMismatch, match="another prompt"):
        sidecar.read_table(spark, path, 1, other)
    assert sidecar.read_table(spark, path, 1, other, sections=["preview"]).count() == 3
    for text in ("[1]", "{not json", ""):
        sidecar.write_text(spark, sidecar.sidecar_path(path), text)
        with pytest.raises(sidecar.MetadataMismatch, match="missing or unreadable"):
            sidecar.require_metadata(spark, path, 1)
