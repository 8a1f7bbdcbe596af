"""Each query against its SQL twin in DuckDB, and the driver's contract."""

import datetime
import importlib
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    at = [want.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


def test_entry_works_without_the_training_data_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("tessera.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setitem(sys.modules, "tessera.llm", None)
    alone = importlib.reload(entry)
    try:
        assert set(alone.queries()) == set(QUERIES) and set(alone.oracle_sql()) == set(ORACLES)
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


def test_rollouts_without_a_claim_match_no_interval(spark, tmp_path):
    at = lambda n: datetime.datetime(2024, 1, 1, n)
    rows = [(0, at(0), 1, "purchase", 10.0, '{"k": 3}'), (1, at(1), 1, "click", 5.0, '{"k": 6}'), (2, at(0), 5, "purchase", 10.0, '{"k": 3}')]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    r = QUERIES["episode_metrics_summary"](spark, str(tmp_path)).first()
    assert (r.num_records, r.temporal_miou, r.precursor_miou) == (2, 0.0, 0.0)


EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def summary_and_sql(spark, rows, folder):
    spark.createDataFrame(rows, EVENT).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    want = con.sql(ORACLES["episode_metrics_summary"])
    return QUERIES["episode_metrics_summary"](spark, str(folder)).first().asDict(), dict(zip(want.columns, want.fetchall()[0], strict=True))


def test_summary_rounds_rates_as_sql(spark, tmp_path):
    at = lambda n: datetime.datetime(2024, 1, 1, n)
    kinds = [(u, h, "purchase") for u in range(800) for h in (0, 1)] + [(u, 2, "click") for u in range(57)]
    got, want = summary_and_sql(spark, [(n, at(h), u, t, 10.0, '{"k": 3}') for n, (u, h, t) in enumerate(kinds)], tmp_path)
    assert got == want and got["mean_search_steps"] == 0.0712  # 57 / 800, which times 10000 is below 712.5


def test_summary_reads_events_without_k_or_time_as_sql(spark, tmp_path):
    kinds = ("purchase", "click", "signup", "purchase", "view", "signup")
    rows = []
    for n in range(240):
        u, j = divmod(n, 12)
        ts = None if kinds[j % 6] in ("click", "view") and n % 7 == 3 else datetime.datetime(2024, 1, 1 + j, u)
        rows.append((n, ts, u, kinds[j % 6], 10.0 + n, None if n % 5 == 2 else f'{{"k": {n * 7 % 100}}}'))
    got, want = summary_and_sql(spark, rows, tmp_path)
    assert got == want


def test_records_round_rates_as_sql(spark, tmp_path):
    at = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=n)
    rows = [(n, at(n), 1, "purchase" if n < 2 else "click", 10.0, '{"k": 8}' if n < 57 else '{"k": 4}') for n in range(800)]
    spark.createDataFrame(rows, EVENT).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(ORACLES["rollout_record_metrics"])
    got = QUERIES["rollout_record_metrics"](spark, str(tmp_path)).first().asDict()
    assert got == dict(zip(want.columns, want.fetchall()[0], strict=True))
    assert got["formal_turn_validity"] == 0.0712  # 57 / 800


def test_coerced_values_over_their_range_match_sql(spark, tmp_path):
    at = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=n)
    rows = [(n, at(n), 1, "view", v, f'{{"k": {k}}}') for n, (k, v) in enumerate([(83, 542.36), (49, 600.0), (1, 600.0), (50, 700.0), (99, 500.0)])]
    spark.createDataFrame(rows, EVENT).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(ORACLES["safe_coercion"])
    got = QUERIES["safe_coercion"](spark, str(tmp_path)).select(want.columns).orderBy("step_index").collect()
    assert [tuple(r) for r in got] == sorted(want.fetchall(), key=lambda r: r[1])
