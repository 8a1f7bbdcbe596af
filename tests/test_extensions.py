"""Extension points, compaction of verify calls, and offline verdicts."""

import json
import random

from pyspark.sql import functions as F
from test_operators import STATE, state

from tessera import extensions as ex
from tessera.functions import text as tx
from tessera.operators import self_report as sr
from tessera.operators import verify


def test_models_answer_in_batches_and_text_by_text(spark):
    seen = []

    def encode(texts):
        seen.append(list(texts))
        if "bad" in texts and len(texts) > 1:
            raise RuntimeError
        if texts == ["bad"]:
            raise RuntimeError
        return [[float(len(t)), 1.0] for t in texts]

    assert ex.in_batches(["a", "bb", None, "a", "bad"], encode) == [[1.0, 1.0], [2.0, 1.0], None, [1.0, 1.0], None]
    assert seen == [["a", "bb", "bad"], ["a"], ["bb"], ["bad"]]
    assert ex.in_batches([None], encode) == [None] and ex.in_batches(["x", "y"], lambda t: ["one"]) == ["one", "one"]
    ex.register_model(spark, "vector_of", lambda texts: [[float(len(t))] for t in texts], ex.VECTOR)
    rows = spark.createDataFrame([("abc",), (None,), ("z",)], "t string").createOrReplaceTempView("texts")
    assert rows is None and sorted(str(r[0]) for r in spark.sql("SELECT vector_of(t) FROM texts").collect()) == ["None", "[1.0]", "[3.0]"]


def test_steps_of_clips_with_moments_in_sql(spark):
    ex.register_table_functions(spark)
    got = spark.sql("SELECT * FROM oracle_steps(30D, array(10D, 20D), array(5D, 9D), array(named_struct('role', 'trigger', 'start', 10D, 'end', 12D), named_struct('role', 'peak', 'start', 13D, 'end', 15D)))").collect()
    assert [r.tool_name for r in got][:4] == ["scan_timeline", "seek_evidence", "emit_alert", "verify_hypothesis"] and (got[1].start_sec, got[1].end_sec) == (10.0, 12.0)
    assert [r.step_index for r in got] == list(range(1, len(got) + 1)) and got[-1].tool_name == "finalize_case"
    assert spark.sql("SELECT * FROM oracle_steps(CAST(NULL AS DOUBLE), NULL, NULL, NULL)").count() == 0


def test_transcripts_are_read_in_stretches(spark, tmp_path):
    rng, lines = random.Random(5), []
    for i in range(200):
        text = "é" * rng.randint(0, 30) + str(i)
        lines.append(rng.choice([json.dumps({"role": "user", "content": text}, ensure_ascii=False), json.dumps({"message": {"role": "assistant", "content": [{"text": text}]}}), "{broken", "", "[1]", json.dumps({"role": "robot", "content": text})]))
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.jsonl").write_text("\n".join(lines), encoding="utf-8")
    (tmp_path / "two.jsonl").write_text(json.dumps({"role": "user", "content": "last"}) + "\n", encoding="utf-8")
    (tmp_path / "three.txt").write_text("{}", encoding="utf-8")
    (tmp_path / "empty.jsonl").write_text("", encoding="utf-8")
    ex.register(spark)
    want = []
    for line in lines:
        try:
            m = ex.message(json.loads(line)) if line else None
            want += [(*m, False)] if m else []
        except ValueError:
            want.append((None, None, True))
    whole = None
    for split in (700, 4000, 1 << 20):
        rows = spark.read.format("transcripts").option("split", split).load(str(tmp_path)).collect()
        got = [(r.role, r.text, r.error is not None) for r in sorted(rows, key=lambda r: (r.file, r.offset))]
        assert got == [*want, ("user", "last", False)]
        assert whole is None or {(r.file, r.offset) for r in rows} == whole
        whole = {(r.file, r.offset) for r in rows}
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW chats USING transcripts OPTIONS (path '{tmp_path}')")
    assert spark.sql("SELECT count(*) FROM chats WHERE role = 'user'").first()[0] == sum(r == "user" for r, *_ in got)
    (tmp_path / "none").mkdir()
    assert spark.read.format("transcripts").load(str(tmp_path / "none")).count() == 0


def one(spark, f, rows):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], "t string").coalesce(1).select(f(F.col("t"))).collect()]


def test_replies_are_cut_to_their_first_block(spark):
    call, answer = '<tool_call>{"name":"scan"}</tool_call>', "<answer>{}</answer>"
    rows = [f"  hm <think>t1</think> so {call} and {answer}\n", f"{answer}{call}<think>late</think>", "no block at all ", "", f"<think>has {call} inside</think>{answer}", None]
    assert one(spark, tx.first_structured_block, rows) == [f"<think>t1</think>{call}", answer, "no block at all", "", f"<think>has {call} inside</think>{call}", None]


def test_verify_calls_become_short(spark):
    wrap = lambda args, name="verify_hypothesis": f"<think>why</think> well <tool_call>{json.dumps({'name': name, 'arguments': args})}</tool_call> done"
    full = {
        "verification_decision": "Sufficient", "sufficiency_score": 0.9, "necessity_score": "2", "query": "q", "rationale": "long", "selected_window_ids": ["w1", " "], "claim": {"existence": "anomaly", "category": "car crash", "earliest_alert_sec": 3.5, "x": 1},
        "alert": {"decision": " ", "alert_sec": None, "existence": ""},
    }
    rows = [wrap(full), wrap({"claim": {"existence": "anomaly"}, "selected_window_ids": ["w1"]}), wrap({"mode": 1}), wrap(full, "seek_evidence"), "<tool_call>{broken</tool_call>", "<answer>{}</answer> x"]
    got = one(spark, sr.compact_verify_call, rows)
    think, block = got[0].split("</think>")
    assert think == "<think>why" and json.loads(block.removeprefix("<tool_call>").removesuffix("</tool_call>")) == {
        "name": "verify_hypothesis",
        "arguments": {
            "verification_mode": "reward_only", "verification_decision": "sufficient", "recommended_action": "finalize", "sufficiency_score": 0.9, "necessity_score": 1.0, "alertability_score": 0.0, "counterfactual_faithfulness": 0.0,
            "claim": {"existence": "anomaly", "category": "traffic_accident", "earliest_alert_sec": 3.5}, "selected_window_ids": ["w1"],
        },
    }
    cut = lambda r: r.replace(" well ", "").removesuffix(" done")
    assert got[1:] == [cut(rows[1]), cut(rows[2]), cut(rows[3]), rows[4], "<answer>{}</answer>"]


def test_offline_verdicts_fill_what_is_missing(spark):
    three = [("w1", "seek", "trigger", 1, 4), ("w2", "seek", "peak_action", 4, 6), ("w3", "seek", "confirmation", 6, 8)]
    roles = [("trigger", 1.0, 4.0), ("peak_action", 4.0, 6.0), ("confirmation", 6.0, 8.0)]
    df = spark.createDataFrame([state(three, [], 1.0, roles=roles)] * 4, STATE).drop("chosen", "has_alert", "alert_sec", "mode").coalesce(1)
    n = F.monotonically_increasing_id()
    turns = "array<struct<verified:array<string>,alert_sec:double>>"
    said = F.array(F.struct(F.array(F.lit("w1"), F.lit("w2")).alias("verified"), F.lit(9.0).alias("alert_sec")), F.struct(F.array().cast("array<string>").alias("verified"), F.lit(None).cast("double").alias("alert_sec")))
    df = df.withColumns({
        "i": n, "turns": F.when(n == 0, said).otherwise(F.array().cast(turns)), "active": F.when(n <= 1, F.array(F.lit("w3"))).otherwise(F.array().cast("array<string>")),
        "alerts": F.when(n == 1, F.array(F.struct(F.lit(1.0).alias("alert_sec")))).otherwise(F.array().cast("array<struct<alert_sec:double>>")),
    })
    first = verify.attach_verdicts(df).orderBy("i").collect()
    assert [r.offline_verifier.verified_window_ids for r in first] == [["w1", "w2"], ["w3"], ["w1", "w2", "w3"], ["w1", "w2", "w3"]]
    assert first[0].offline_verifier.alert_status == "justified" and first[1].offline_verifier.alert_status == "justified" and first[2].offline_verifier.alert_status == "not_applicable"
    assert "mode" not in first[0].asDict()
    held = verify.attach_verdicts(df).withColumn("offline_verifier", F.when(F.col("i") == 3, F.col("offline_verifier").withField("primary_status", F.lit("by hand"))))
    assert [r.offline_verifier.primary_status for r in verify.attach_verdicts(held).orderBy("i").collect()][3] == "by hand"
    assert [r.offline_verifier for r in verify.attach_verdicts(held, force=True).orderBy("i").collect()] == [r.offline_verifier for r in first]
