"""Messages that fit a size, and advantages of tokens, against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import fitting as ft

IMAGE, MESSAGE = 7, 2
SCHEMA = "id int, messages array<struct<role:string,tag:int,content:array<struct<type:string,text:string>>>>, limit int, reserved int"


def size(messages, reserved):
    return reserved + sum(MESSAGE + sum(IMAGE if t == "image" else len(x or "") for t, x in content) for _, _, content in messages)


def drop_image(messages):
    for k, (role, _, content) in enumerate(messages):
        for i, (kind, _) in enumerate(content):
            if kind == "image":
                stamp = i > 0 and content[i - 1][0] == "text" and re.match(r"^\d+(\.\d+)?s$", (content[i - 1][1] or "").strip())
                del content[i - 1 if stamp else i : i + 1]
                if not content and role not in ("system", "user"):
                    del messages[k]
                return True
    return False


def drop_history(messages):
    at = next((k for k, m in enumerate(messages) if m[0] not in ("system", "user")), None)
    if at is None:
        return False
    del messages[at]
    return True


def plain_fit(messages, limit, reserved):
    messages = [(r, t, [tuple(c) for c in content]) for r, t, content in messages]
    images = history = 0
    while limit > 0 and size(messages, reserved) > limit:
        if drop_image(messages):
            images += 1
        elif drop_history(messages):
            history += 1
        else:
            return messages, size(messages, reserved), images, "over"
    return messages, size(messages, reserved), images, "history" if history else "images" if images else "whole"


def test_fitted_messages_equal_a_plain_loop(spark):
    rng = random.Random(12)
    item = lambda: rng.choice([("image", None)] * 3 + [("text", rng.choice(["1.5s", " 2s ", "3s", "words", "", "12", None, "x" * 20]))] * 4)
    rows = [
        (i, [(rng.choice(["system", "user", "assistant", "tool"]), k, [item() for _ in range(rng.randint(0, 5))]) for k in range(rng.randint(0, 6))], rng.choice([0, 5, 20, 40, 60, 90, 150]), rng.choice([0, 10]))
        for i in range(400)
    ]
    f = ft.fit_messages(F.col("messages"), F.col("limit"), F.length, IMAGE, MESSAGE, F.col("reserved"))
    fits = set()
    for r in spark.createDataFrame(rows, SCHEMA).select("id", f.alias("f")).collect():
        want, whole, images, fit = plain_fit(*rows[r.id][1:])
        got = [(m.role, m.tag, [tuple(c) for c in m.content]) for m in r.f.messages]
        assert (got, r.f["size"], r.f.dropped_images, r.f.fit) == (want, whole, images, fit), rows[r.id]
        assert r.f.dropped_messages == len(rows[r.id][1]) - len(want)
        fits.add(fit)
    assert fits == {"whole", "images", "history", "over"}


def plain_advantages(parts, offsets, count, base, plain):
    def weights(chars):
        out = []
        for s, e in offsets:
            s, e = max(0, s), min(len(chars), e)
            out.append(sum(chars[s:e]) / (e - s) if e > s else 1.0)
        return out

    def spread(advantage, w):
        mean = sum(w) / len(w)
        return [advantage * x / (mean if mean > 1e-8 else 1.0) for x in w]

    active = [(a * w, chars) for a, w, chars in parts if abs(a * w) > 1e-8]
    if not offsets:
        return [base] * max(count, 0)
    each = [spread(a, weights(chars) if chars else [1.0] * len(offsets)) for a, chars in active] or [spread(base, weights(plain) if plain else [1.0] * len(offsets))]
    total = [sum(x) for x in zip(*each, strict=True)]
    return (total + [total[-1]] * max(count - len(total), 0))[: max(count, 0)]


def test_token_advantages_equal_a_plain_version(spark):
    rng = random.Random(3)
    rows = []
    for i in range(200):
        n = rng.randint(0, 30)
        chars = lambda: [rng.choice([0.0, 0.2, 1.0, 2.5]) for _ in range(rng.choice([n, n, 0]))]  # noqa: B023, E731
        cuts = sorted(rng.choices(range(n + 3), k=rng.randint(0, 8)))
        offsets = list(zip(cuts, cuts[1:], strict=False)) + ([(0, 0)] if rng.random() < 0.3 else [])
        parts = [(rng.choice([0.0, 1.0, -0.5]), rng.choice([0.0, 0.25, 1.0]), chars()) for _ in range(rng.randint(0, 3))]
        rows.append((i, parts, offsets, rng.randint(0, 12), 0.3, chars()))
    schema = "id int, parts array<struct<advantage:double,weight:double,char_weights:array<double>>>, offsets array<struct<start:int,end:int>>, n int, base double, plain array<double>"
    df = spark.createDataFrame(rows, schema)
    for r in df.select("id", ft.token_advantages(*[F.col(c) for c in ("parts", "offsets", "n", "base", "plain")]).alias("v")).collect():
        assert r.v == pytest.approx(plain_advantages(*rows[r.id][1:]), abs=1e-9), rows[r.id]


def test_a_component_keeps_its_mean_over_a_response(spark):
    df = spark.sql("SELECT array(named_struct('advantage', 2.0D, 'weight', 0.5D, 'char_weights', array(1D, 3D, 0D, 5D))) AS p, array(named_struct('start', 0, 'end', 2), named_struct('start', 2, 'end', 4), named_struct('start', 4, 'end', 9)) AS o")
    v = df.select(ft.token_advantages(F.col("p"), F.col("o"), F.lit(3), F.lit(0.0), F.array().cast("array<double>"))).first()[0]
    assert sum(v) / 3 == pytest.approx(1.0) and v == pytest.approx([2.0 / (5.5 / 3), 2.5 / (5.5 / 3), 1.0 / (5.5 / 3)])
