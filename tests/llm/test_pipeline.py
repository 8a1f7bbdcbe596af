"""The pipeline on a small fixture, stage by stage, against plain versions."""

import random

import numpy as np
from test_group_operators import plain_near_copies
from test_text_operators import VOCABULARY, plain_contaminated, plain_line_dedup

import corpus_pipeline
from tessera.llm import packing, quality, token_counts


def fixture():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 7)))
    shared = " ".join(word() for _ in range(12))
    item = " ".join(word() for _ in range(25))
    rows, labels = [], []
    for i in range(150):
        w = [word() for _ in range(rng.randint(40, 120))]
        if i % 5 == 0:
            t = " ".join(x.upper() + "!!" for x in w)
        elif i % 7 == 0 and rows:
            t = rows[rng.randrange(len(rows))][1]
        elif i % 11 == 0:
            t = " ".join([*w[:20], item, *w[20:]])
        else:
            t = " ".join(w[:30]) + ("\n" + shared if i % 3 == 0 else "") + "\n" + " ".join(w[30:])
        rows.append((i, t))
        labels.append((i, 0 if t.isupper() else 1, 0))
    return [*rows, (200, None), (201, ""), (202, "word " * 20_000)], labels, [(0, item), (1, None)]


def test_stages_match_plain_versions(spark, tmp_path):
    rows, labels, items = fixture()
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))

    model = quality.train(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    good = model.score(np.array([quality.features(t) for _, t in rows])) >= 0.5
    kept = [r for r, g in zip(rows, good, strict=True) if g]
    assert not any((t or "").isupper() for _, t in kept) and len(kept) > 100
    kept = [(i, t) for i, _, _, t in plain_line_dedup(kept)]
    least = plain_near_copies(kept)
    kept = [(i, t) for i, t in kept if least[i] == i]
    bad = plain_contaminated(kept, items)
    kept = [(i, t) for i, t in kept if i not in bad]
    assert bad
    counter = token_counts.PieceCounter(token_counts.read_vocabulary(VOCABULARY))
    want = {i: counter.text(t) for i, t in kept}

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
    assert got == want
    used = {}
    for r in (r for r in out if r.bin is not None):  # empty pieces lie in none
        used[r.bin] = max(used.get(r.bin, (0, 0)), (r.bin_offset + r.n_tokens, r.bin_length))
    assert all(n <= size and size in packing.LENGTHS for n, size in used.values())


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    rows, labels, items = fixture()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    empty = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, str(tmp_path)).dtypes == empty.dtypes, name
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "benchmark decontamination", "best-fit packing"]
