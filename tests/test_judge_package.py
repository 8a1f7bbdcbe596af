"""Judge packages against a plain version."""

import random

from pyspark.sql import functions as F

from tessera.operators import judge_package as jp


def plain(windows, wids, eids, mids, alert, most, cap, decision, action, mode):
    strip = lambda ids: [i.strip() for i in ids or [] if i and i.strip()]
    known = {(w[0] or "").strip() for w in windows} - {""}
    selected = [i for i in strip(wids) if i in known]
    seen = set(selected)
    for w in windows:
        i = (w[0] or "").strip()
        if i and i not in seen and ((w[1] or "").strip() in strip(eids) or (w[2] or "").strip() in strip(mids)):
            selected.append(i)
            seen.add(i)
    keep, drop = [w for w in windows if (w[0] or "").strip() in seen], [w for w in windows if (w[0] or "").strip() not in seen]
    of = keep or windows
    prefix = []
    if alert is not None:
        for w in of:
            images = [i for i in w[7] or [] if i[1] is not None and i[1] <= alert + 1e-6]
            if images:
                prefix.append((*w[:6], [i[1] for i in images], images))
    views = {"full": windows, "keep": keep, "drop": drop, "alert_prefix": prefix or of[:1]}

    def spread(images):
        if most <= 0 or len(images) <= most:
            return images
        return images[:1] if most == 1 else [images[k] for k in sorted({round(i * (len(images) - 1) / (most - 1)) for i in range(most)})]

    def text(view, empty):
        lines = []
        for w in view:
            line = f"{w[0] or ''} {w[3] or ''}" + "".join(f" {n}={w[k]}" for n, k in (("role", 4), ("moment_id", 2), ("query", 5)) if w[k])
            lines.append(line + (f" timestamps={[round(t, 3) for t in w[6]]}" if w[6] else ""))
        return "\n".join(lines) if view else empty

    images = {v: spread([i for w in x for i in w[7] or []]) for v, x in views.items()}
    reasons = ([f"verification_decision={decision}"] if decision in ("insufficient", "misaligned", "redundant") else []) + ([f"recommended_action={action}"] if action and action != "finalize" else [])
    reasons += (["multiple_selected_windows"] if len(selected) > 1 else []) + (["alert_present"] if alert is not None else [])
    mode = mode if mode in ("text_only", "multimodal_visual") else "multimodal_visual" if reasons and sum(map(len, images.values())) else "text_only"
    out, n = [("text", "P", None)], 0
    for v in jp.VIEWS:
        if (t := text(views[v], f"no {v}").strip()) != "":
            out.append(("text", f"{v} summary:\n{t}", None))
        for i in images[v] if mode == "multimodal_visual" else []:
            if n >= cap:
                break
            out += ([("text", f"{v} frame timestamp: {i[1]:.3f}s", None)] if i[1] is not None else []) + [("image", None, i[0])]
            n += 1
        if n >= cap:
            break
    return selected, reasons, mode, out


def test_packages_equal_a_plain_version(spark):
    rng = random.Random(17)
    ids = lambda p: rng.choice([None, [], [f"{p}{rng.randint(0, 5)}" for _ in range(rng.randint(1, 3))] + ["", " ", f" {p}1 "]])
    rows = []
    for i in range(200):
        windows = []
        for k in range(rng.randint(0, 4)):
            images = [(f"f{k}{j}", rng.choice([None, 0.5 * j, 2.0 * k + j])) for j in range(rng.randint(0, 5))]
            windows.append((rng.choice([f"w{k}", f"w{k}", "", None]), rng.choice([f"e{k}", None]), rng.choice([f"m{k}", ""]), "seek", rng.choice(["trigger", None]), rng.choice(["who", ""]), [t for _, t in images if t is not None], rng.choice([images, images, None])))
        rows.append((i, windows, ids("w"), ids("e"), ids("m"), rng.choice([None, 1.0, 3.0, -1.0]), rng.choice(["sufficient", "redundant", None]), rng.choice(["finalize", "continue_search", "", None]), rng.choice(["auto", "text_only", "multimodal_visual", "odd", None])))
    schema = f"i int, w array<{jp.WINDOW}>, a array<string>, b array<string>, c array<string>, alert double, decision string, action string, mode string"
    df = spark.createDataFrame(rows, schema)
    for most, cap in ((2, 3), (1, 8), (0, 100)):
        x = df.withColumn("s", jp.resolved_windows(F.col("w"), F.col("a"), F.col("b"), F.col("c"))).withColumn("v", jp.views(F.col("w"), F.col("s"), F.col("alert")))
        images = {v: jp.view_images(F.col(f"v.{v}"), most) for v in jp.VIEWS}
        x = x.withColumn("r", jp.case_reasons(F.col("decision"), F.col("action"), F.col("s"), F.col("alert").isNotNull()))
        x = x.withColumn("m", jp.input_mode(F.col("mode"), F.col("r"), sum((F.size(c) for c in images.values()), F.lit(0))))
        text = {v: jp.summary(F.col(f"v.{v}"), F.lit(f"no {v}")) for v in jp.VIEWS}
        for r in x.select("i", "s", "r", "m", jp.content(F.lit("P"), text, images, F.col("m"), cap).alias("items")).collect():
            _, w, a, b, c, alert, decision, action, mode = rows[r.i]
            assert (r.s, r.r, r.m, [tuple(t) for t in r["items"]]) == plain(w, a, b, c, alert, most, cap, decision, action, mode), rows[r.i]
