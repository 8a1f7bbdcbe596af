"""Whole frame proposals against a plain version that recomputes every determinant."""

import math
import random

import numpy as np
import pytest

from tessera.operators import proposal as pr

TOP_K, GAP = 5, 1.0


def plain_greedy(kernel, n):
    chosen = []
    while len(chosen) < min(n, len(kernel)):
        best = None
        for c in range(len(kernel)):
            if c not in chosen:
                s = [*chosen, c]
                sign, value = np.linalg.slogdet(kernel[np.ix_(s, s)] + 1e-6 * np.eye(len(s)))
                value = value if sign > 0 else -math.inf
                if best is None or value > best[0] + 1e-9:
                    best = (value, c)
        chosen.append(best[1])
    return chosen


def unit(v):
    return np.asarray(v, float) / max(np.linalg.norm(v), 1e-8)


def plain(request, frames, vectors):
    _, clip, start, end, fps, asked, encoder, texts = request
    out = {"backend": "uniform", "n_frames": 0, "windows": [], "frames": [], "selected": []}
    own = sorted((i, v) for c, i, v in frames if c == clip)
    if not own:
        return out | {"reason": "missing_feature_cache"}
    if not encoder:
        return out | {"reason": "missing_query_encoder"}
    positive = [t for t in texts or [] if t[2] and (t[0] or "").strip()]
    if not positive:
        return out | {"reason": "empty_query_package"}
    if any(not v for _, v in own) or len({len(v) for _, v in own}) > 1:
        return out | {"reason": "invalid_feature_cache"}
    known = [(w if p else -w, unit(vectors[t.strip()]), p) for t, w, p in texts if (t or "").strip() in vectors]
    if not any(p for *_, p in known):
        return out | {"reason": "empty_query_embeddings"}
    a = max(math.floor(start * fps), 0)
    z = max(min(math.floor(end * fps), len(own) - 1), a)
    pool = [(i, unit(v)) for i, v in own if a <= i <= z]
    score = {i: round(sum(w * float(v @ q) for w, q, _ in known), 9) for i, v in pool}
    most = min(len(pool), max(min(4 * max(asked, 4), 64), TOP_K, 1))
    head = sorted(score, key=lambda i: (-score[i], i))[:most]
    windows = []
    for i in sorted(head):
        if windows and i - windows[-1][-1] <= max(1, round(GAP * fps)):
            windows[-1].append(i)
        else:
            windows.append([i])
    if not windows:
        return out | {"reason": "empty_candidate_windows"}
    rounded = [round(score[i], 6) for i in head]
    windows.sort(key=lambda w: (-round(max(score[i] for i in w), 6), -round(sum(score[i] for i in w) / len(w), 6), w[0]))
    cap = max(1, min(8, asked)) if asked > 0 else 8
    budget = (1 if max(end - start, 1e-6) < 2 else 2) + (len(head) >= 5 and rounded[0] - rounded[4] < 0.08) + (len(windows) >= 3)
    n = max(1, min(cap, budget))
    x, at, s = np.stack([dict(pool)[i] for i in head]), np.array(head) / fps, np.array(rounded)
    quality = np.exp(6 * ((s - s.min()) / (s.max() - s.min()) if s.max() - s.min() > 1e-8 else np.ones_like(s)))
    kernel = np.clip(x @ x.T, 0, 1) * np.exp(-np.abs(at[:, None] - at[None]) / 2) * np.outer(quality, quality)
    np.fill_diagonal(kernel, np.maximum(np.diag(kernel), 1e-6))
    return {"backend": "guided_dpp", "reason": None, "n_frames": n, "windows": windows, "frames": head, "selected": sorted(head[k] for k in plain_greedy(kernel, n))}


REQUEST = "request_id long, clip long, start_sec double, end_sec double, fps double, num_frames int, has_encoder boolean, texts array<struct<text:string,weight:double,positive:boolean>>"


def inputs(spark, requests, frames, vectors):
    return (
        spark.createDataFrame(requests, REQUEST), spark.createDataFrame(frames, "clip long, frame_index int, vector array<double>"),
        spark.createDataFrame(list(vectors.items()), "text string, vector array<double>"),
    )


def test_proposals_equal_a_plain_version_with_every_reason(spark):
    rng = random.Random(21)
    vector = lambda: [rng.gauss(0, 1) for _ in range(6)]
    frames = [(c, i, vector()) for c in range(4) for i in range(rng.randint(3, 60))] + [(4, 0, vector()), (4, 1, None), (5, 0, vector()), (5, 1, [1.0]), (6, 0, [])]
    vectors = {t: vector() for t in ("fire", "smoke", "person", "crowd")}
    requests = []
    for i in range(150):
        texts = [(rng.choice(["fire", "smoke", " person ", "crowd", "unknown", "", None]), rng.choice([0.4, 0.25, 0.2]), rng.random() < 0.7) for _ in range(rng.randint(0, 4))]
        start = rng.choice([-1.0, 0.0, 0.5, 2.0, 40.0])
        requests.append((i, rng.choice([0, 1, 2, 3, 3, 4, 5, 6, 7]), start, start + rng.choice([-3.0, 0.0, 1.0, 1.9, 4.0, 30.0]), rng.choice([1.0, 2.5, 4.0]), rng.choice([0, 1, 3, 8, 40]), rng.random() < 0.9, texts))
    requests.append((150, 0, 0.0, 5.0, 2.0, 2, True, None))
    seen = set()
    for r in pr.propose(*inputs(spark, requests, frames, vectors), top_k=TOP_K, merge_gap=GAP).collect():
        want = plain(requests[r.request_id], frames, vectors)
        got = {"backend": r.backend, "reason": r.fallback_reason, "n_frames": r.n_frames, "windows": [w.frames for w in r.windows], "frames": r.candidate_frames, "selected": r.selected_frames}
        assert got == want, requests[r.request_id]
        seen.add(r.fallback_reason)
    assert seen == {None, "missing_feature_cache", "missing_query_encoder", "empty_query_package", "invalid_feature_cache", "empty_query_embeddings", "empty_candidate_windows"}


def test_a_kernel_that_is_not_finite_falls_back_to_the_best_frames(spark):
    frames = [(0, i, [1.0, float(i)]) for i in range(6)] + [(0, 6, [float("nan"), 1.0])]
    request = [(1, 0, 0.0, 9.0, 1.0, 3, True, [("fire", 1.0, True)])]
    r = pr.propose(*inputs(spark, request, frames, {"fire": [1.0, 0.0]})).first()
    assert (r.backend, r.fallback_reason, r.n_frames) == ("feature_topk", "dpp_failure", 2 + 0) and len(r.selected_frames) == 2
    assert r.selected_frames == sorted(r.candidate_frames[:2])


def test_windows_say_where_and_how_good(spark):
    frames = [(0, i, [1.0, 0.0] if i in (2, 3, 9) else [0.6, 0.8]) for i in range(12)]
    requests, f, v = inputs(spark, [(1, 0, 0.0, 9.0, 2.0, 1, True, [("fire", 0.5, True)])], frames, {"fire": [2.0, 0.0]})
    r = pr.propose(requests, f.where("frame_index IN (2, 3, 9) OR frame_index < 2 OR frame_index > 3"), v, top_k=3, merge_gap=0.5).first()
    best = r.windows[0]
    assert (best.score_max, best.start_sec) == (0.5, 0.0) and best.score_mean == pytest.approx(sum(0.5 if i in (2, 3, 9) else 0.3 for i in best.frames) / len(best.frames))
    assert r.selected_frames == [2] and r.candidate_scores[:3] == [0.5, 0.5, 0.5]
