"""What references say, and an episode's first messages, by hand."""

from pyspark.sql import functions as F

from tessera.operators import messages as ms
from tessera.operators import references as rf

ENTRY = "array<struct<moment_id:string,role:string,description:string,window:array<double>,window_sec:array<double>>>"


def test_windows_come_from_the_first_list_that_has_some(spark):
    full = [("m1", "Trigger", "d", [4.0, 2.0], [8.0, 9.0]), ("m2", None, None, None, [1.0, 3.0]), ("m3", "x", None, [1.0], None), ("m4", "x", None, [], [5.0, 5.0])]
    rows = [(full, None), (None, full), ([("m3", "x", None, [1.0, None], None)], [("t", "R", None, [1.0, 2.0], [6.0, 7.0])]), ([], None)]
    got = [[(w.moment_id, w.role, w.start_sec, w.end_sec) for w in r.w] for r in spark.createDataFrame(rows, f"a {ENTRY}, b {ENTRY}").coalesce(1).select(rf.windows(F.col("a"), F.col("b")).alias("w")).collect()]
    assert got == [
        [("m1", "trigger", 2.0, 4.0), ("m2", "", 1.0, 3.0), ("m4", "x", 5.0, 5.0)], [("m1", "trigger", 8.0, 9.0), ("m2", "", 1.0, 3.0), ("m4", "x", 5.0, 5.0)], [("t", "r", 6.0, 7.0)], [],
    ]


def test_targets_are_whole_or_made(spark):
    fields = "struct<existence:string,category:string,severity:int,hard_normal:boolean,anomaly_interval_sec:array<double>,precursor_interval_sec:array<double>,earliest_alert_sec:double,counterfactual_type:string>"
    label, times = "struct<is_anomaly:boolean,category:string,severity:int,hard_normal:boolean>", "struct<anomaly_interval_sec:array<double>,precursor_interval_sec:array<double>,earliest_alert_sec:double>"
    rows = [(("own", None, None, None, None, None, 2.0, None), (True, "fire", 3, False), (None, None, 9.0), "x"), (None, (True, "fire", 3, False), ([1.0, 2.0], None, 9.0), "x"), (None, (None, None, None, True), None, None)]
    df = spark.createDataFrame(rows, f"s {fields}, l {label}, t {times}, c string").coalesce(1)
    got = [tuple(r.t) for r in df.select(rf.target(*[F.col(x) for x in df.columns]).alias("t")).collect()]
    assert got == [("own", None, None, None, None, None, 2.0, None), ("anomaly", "fire", 3, False, [1.0, 2.0], None, 9.0, "x"), ("normal", None, None, True, None, None, None, "none")]


def test_frames_follow_their_times_and_the_footer_is_last(spark):
    rows = [([0, 5, 9, -1], 8.0, [10, 20], 6), (None, 0.0, None, 0), ([1], None, [7, 8], 2)]
    df = spark.createDataFrame(rows, "i array<int>, fps double, frames array<int>, n int").coalesce(1)
    got = [r.c for r in df.select(ms.visual_content(*[F.col(c) for c in df.columns], F.lit("v.mp4"), F.lit("end")).alias("c")).collect()]
    plain = lambda c: [x.text if x.type == "text" else tuple(x.image_ref) for x in c]
    assert plain(got[0]) == ["0.000s", ("v.mp4", 0, 10, 0.0), "0.625s", ("v.mp4", 5, None, 0.625), "1.125s", "-0.125s", "end"]
    assert plain(got[1]) == ["end"] and plain(got[2]) == ["1.000s", ("v.mp4", 1, 8, 1.0), "end"]
    m = df.select(ms.initial_messages(F.lit("sys"), F.lit("usr"), F.col("i"), F.col("fps"), F.col("frames"), F.col("n"), F.lit("v")).alias("m")).collect()[1].m
    assert [(x.role, plain(x.content)) for x in m] == [("system", ["sys"]), ("user", ["usr"])]
