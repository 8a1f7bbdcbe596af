"""Lookups by precedence against plain loops."""

import random

from pyspark.sql import functions as F

from tessera.operators import precedence as pc


def plain_moment(call, moments):
    _, clip, mid, role, start, end = call
    own = [m for m in sorted(moments, key=lambda m: m[1]) if m[0] == clip]
    for m in own:
        if mid is not None and m[2] == mid:
            return m[1], "id"
    for m in own:
        if role and m[3] == role and (start is None or end is None or ((m[4] or -1.0) == start and (m[5] or -1.0) == end)):
            return m[1], "role" if start is None or end is None else "role and bounds"
    return None, "none"


def test_moments_by_id_role_and_bounds(spark):
    rng = random.Random(9)
    sec = lambda: rng.choice([None, 0.0, 1.0, 2.5])
    moments = [(rng.randint(0, 3), i, rng.choice(["a", "b", "c", None]), rng.choice(["trigger", "peak", "", None]), sec(), sec()) for i in range(40)]
    calls = [(i, rng.randint(0, 4), rng.choice(["a", "z", None]), rng.choice(["trigger", "peak", "", None]), sec(), sec()) for i in range(200)]
    m = spark.createDataFrame(moments, "clip int, at int, moment_id string, role string, start_sec double, end_sec double")
    c = spark.createDataFrame(calls, "call int, clip int, moment_id string, role string, start_sec double, end_sec double")
    got = {r.call: (r.match["at"] if r.match else None, r.matched_by) for r in pc.find_moments(c, m, "call", "clip", "at").collect()}
    assert got == {c[0]: plain_moment(c, moments) for c in calls} and len({b for _, b in got.values()}) == 4


def test_many_rows_of_one_key_meet_once(spark):
    right = spark.range(2000).select(F.lit("hot").alias("name"), F.col("id").alias("at"))
    left = spark.range(500).select(F.col("id").alias("row"), F.lit("hot").alias("name"), F.lit(None).cast("string").alias("other"))
    out = pc.first_match(left, "row", [("other", "x", F.col("other")), ("name", "x", F.col("name"))], right, [("x", F.col("name"))], "at")
    assert {(r.match["at"], r.matched_by) for r in out.collect()} == {(0, "name")} and out.count() == 500


def test_windows_of_turns_and_states(spark):
    schema = "a array<string>, v array<string>, b array<string>, act array<string>, known array<string>"
    rows = [
        (["w2", "w9", " w1 ", "w2", ""], ["w1"], None, ["w3"], ["w1", "w2", "w3"]), ([], ["w1"], ["w2"], None, ["w1"]), (None, None, ["w8"], ["w1"], ["w1"]),
        (None, [], [], [" w1", "w7"], ["w1"]), ([], None, None, ["w7"], ["w1"]), (["w7"], ["w1"], None, None, ["w1"]),
    ]
    cols = [F.col(c) for c in ("a", "v", "b", "act", "known")]
    got = [(r[0].ids, r[0].source) for r in spark.createDataFrame(rows, schema).coalesce(1).select(pc.selected_windows(*cols)).collect()]
    assert got == [(["w2", "w1"], "selected"), (["w1"], "verified"), ([], "best_effort"), (["w1"], "active"), ([], "none"), ([], "selected")]
    states = [(["w1", "x"], [(["w2"], None)], ["w1", "w2"]), (["x"], [(["w1"], None), (["x"], ["w2"])], ["w1", "w2"]), (None, [(None, [])], ["w1"]), ([], None, ["w1"])]
    df = spark.createDataFrame(states, "act array<string>, recs array<struct<verified:array<string>,best_effort:array<string>>>, known array<string>").coalesce(1)
    got = [(r[0].ids, r[0].source) for r in df.select(pc.state_windows(F.col("act"), F.col("recs"), F.col("known"))).collect()]
    assert got == [(["w1"], "active"), (["w2"], "best_effort"), ([], "none"), ([], "none")]


def test_images_come_from_caches_or_frames_with_a_reason(spark):
    caches = spark.createDataFrame([("a", "loaded", 4, 2.0, 10), ("b", "invalid", None, 2.0, 10), ("c", None, None, 0.0, 0)], "video_path string, status string, n_cached int, fps double, n_frames int")
    refs = [("a", 3, 7, None), ("a", 4, 7, None), ("a", -1, None, None), ("a", None, None, 99.0), ("a", None, None, 1.25), ("b", 2, None, None), ("c", None, None, 1.0), ("d", None, 5, None), ("d", None, None, None)]
    df = spark.createDataFrame(refs, "video_path string, sampled_frame_index int, raw_frame_index int, timestamp_sec double")
    got = {tuple(r)[:4]: tuple(r)[4:] for r in pc.image_sources(df, caches).collect()}
    assert [got[r] for r in refs] == [
        ("cached", 3, None), ("raw", 7, "sampled_frame_index_out_of_range:4"), ("raw", -1, "sampled_frame_index_out_of_range:-1"), ("raw", 9, "missing_sampled_frame_index"), ("raw", 2, "missing_sampled_frame_index"),
        ("raw", 2, "cache_status:invalid"), (None, None, "unresolved"), ("raw", 5, "missing_frame_cache"), (None, None, "unresolved"),
    ]


def test_an_answer_hides_the_finalized_case(spark):
    rows = [(True, None, "Normal ", "anomaly", None), (True, True, "normal", None, None), (False, True, None, "x", "anomaly"), (False, None, None, None, " ANOMALY"), (True, None, "", "", "normal")]
    df = spark.createDataFrame(rows, "hit boolean, label boolean, target string, answer string, final string").coalesce(1)
    got = [tuple(r[0]) for r in df.select(pc.label_group(*[F.col(c) for c in df.columns])).collect()]
    assert got == [("normal", "target"), ("anomaly", "label"), ("unknown", "none"), ("anomaly", "policy"), ("unknown", "none")]
