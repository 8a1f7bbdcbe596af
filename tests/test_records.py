"""Trajectories, messages and judge packages."""

from pyspark.sql import functions as F

from tessera.operators import judge, messages, trajectory


def test_trajectories_and_examples(spark):
    m = lambda *xs: [(r, float(a), float(b)) for r, a, b in xs]
    clips = spark.createDataFrame([("n", 9.0, None, None, None), ("a", 40.0, [10.0, 20.0], [8.0, 10.0], m(("peak", 12, 15), ("trigger", 10, 12), ("confirmation", 15, 20))), ("z", 40.0, [10.0, 20.0], None, m())], trajectory.CLIP)
    rows = trajectory.trajectories(clips)
    got = {}
    for r in rows.orderBy("video_id", "step_index").collect():
        got.setdefault(r.video_id, []).append(r)
    assert [(r.tool_name, r.start_sec, r.end_sec) for r in got["n"]] == [("scan_timeline", 0, 9), ("seek_evidence", 0, 3), ("seek_evidence", 3, 6), ("seek_evidence", 6, 9), ("verify_hypothesis", 0, 9), ("finalize_case", 0, 9)]
    assert [r.note for r in got["a"] if r.tool_name in ("emit_alert", "verify_hypothesis")] == ["soft", "soft misaligned", "full_keep_drop incomplete", "full_keep_drop redundant", "hard", "hard complete"]
    seeks = [(r.start_sec, r.end_sec) for r in got["a"] if r.tool_name == "seek_evidence"]
    assert seeks[:3] == [(10, 12), (12, 15), (15, 20)] and seeks[3] == (8, 10) and len(set(seeks)) == len(seeks)
    assert [r.note for r in got["z"] if r.tool_name == "verify_hypothesis"] == ["hard complete"] and got["n"][0].note == "stride 1.125"
    ex = trajectory.examples(rows).where("video_id = 'n'").orderBy("step_index").collect()
    assert [len(r.history) for r in ex] == list(range(6)) and abs(sum(r.sample_weight for r in ex) - 1) < 1e-9 and ex[2].history[1] == ex[1].target_response


def test_messages(spark):
    text, image = ("text", "hi", None, None), ("image", None, bytearray(b"x"), ("v.mp4", 3, None, 1.5))
    rows = [([("user", None, [text, image, text]), ("tool", "seek_evidence", [image])],)]
    df = spark.createDataFrame(rows, f"m {messages.MESSAGES}")
    r = df.select(
        messages.flat_text(F.col("m")).alias("t"), messages.as_references(F.col("m")).alias("r"), messages.follow_up(F.col("m")[0]["content"], F.lit("verify_hypothesis"), F.lit("revise_claim")).alias("f"),
        messages.follow_up(F.col("m")[1]["content"], F.lit("other"), F.lit(None).cast("string")).alias("n"),
    ).first()
    assert r.t == "user: hi hi\ntool: " and r.r[0].content[1].image is None and r.r[0].content[1].image_ref.sampled_frame_index == 3 and r.f[-1].text == "Revise the claim." and len(r.n) == 1
    p = spark.createDataFrame([(["s", "a", "b", "a", "c"], ["s", "a", "c"])], "m array<string>, k array<string>").withColumn("p", messages.plan(F.col("m"), F.col("k")))
    got = p.select("p", messages.apply_plan(F.col("m"), F.col("p")).alias("again")).first()
    assert got.p == [0, 1, 4] and got.again == ["s", "a", "c"]
    assert spark.range(1).select(messages.compact(F.struct(F.lit(1).alias("a"), F.lit(None).cast("int").alias("b")))).first()[0] == '{"a":1}'


def test_judge_packages(spark):
    led = [("w1", 0.0), ("w2", 5.0), ("w3", 9.0)]
    df = spark.createDataFrame([(1, led, ["w2"], 5.0, "sufficient", None), (2, led, [], None, "redundant", "old")], "id long, l array<struct<window_id:string,start_sec:double>>, s array<string>, a double, d string, judgement string")
    v = judge.views(F.col("l"), F.col("s"), F.col("a"))
    why = judge.hard_reasons(v, F.col("d"), F.lit(0.9), F.lit(0.2))
    caps = judge.capped_images([F.lit(7), F.lit(4), F.lit(3), F.lit(2)])
    got = {r.id: r for r in df.select("id", *[F.transform(c, lambda w: w["window_id"]).alias(n) for n, c in v.items()], why.alias("why"), judge.input_mode(F.lit("auto"), why, F.lit(True)).alias("mode"), F.array(*caps).alias("caps")).collect()}
    assert (got[1].keep, got[1].drop, got[1].alert_prefix, got[1].why, got[1].mode) == (["w2"], ["w1", "w3"], ["w1", "w2"], [], "text_only")
    assert got[2].why == ["nothing selected", "doubtful decision"] and got[2].mode == "multimodal" and got[1].caps == [7, 4, 1, 0]

    def flaky(prompts):
        if len(prompts) > 1 or "9" in prompts[0]:
            raise ValueError
        return [p.upper() for p in prompts]

    many = spark.createDataFrame([(i, f"p{i}", "kept" if i == 3 else None) for i in range(10)], "id long, p string, judgement string").coalesce(1)
    out = {r.id: r.judgement for r in judge.annotate(many, F.col("id") != 5, F.col("p"), flaky).collect()}
    assert out == {i: {3: "kept", 5: None, 9: None}.get(i, f"P{i}") for i in range(10)}
    twice = judge.annotate(many.unionAll(many), F.col("id") != 5, F.col("p"), flaky)
    assert twice.count() == 20 and sorted(r.judgement or "" for r in twice.collect()) == sorted((v or "") for v in [*out.values()] * 2)
