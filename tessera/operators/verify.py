"""The heuristic verifier: view scores from role overlap and coverage, derived scores, verdicts, and counterfactual groups.

A record holds its windows as an array, so it is judged inside its row: stages are columns, and only advantages
within a group of branches look at other rows. ``verdicts`` says which columns a record has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.intervals import overlap_share
from tessera.functions.numeric import unit

from .precedence import first_filled

WINDOW = "struct<window_id:string,evidence_id:string,kind:string,role:string,start_sec:double,end_sec:double>"
# How much each support counts, the overlap that makes a hit, and an alert's tolerance in seconds.
SUPPORT = {"exist_support": 0.20, "category_support": 0.20, "temporal_support": 0.20, "precursor_support": 0.10, "alert_support": 0.20, "counterfactual_support": 0.10}
HIT, TOLERANCE = 0.25, 0.5
VIEWS = ["full", "keep", "drop", "alert_prefix"]
# Modes whose complete verdicts always finalize, what statuses add to a branch, and how roles rank in a minimal subset.
FINAL_MODES = ["final_check", "hard_alert_check", "full_keep_drop", "reward_only"]
STATUS_BONUS = {"complete": 0.3, "incomplete": -0.2, "redundant": -0.3, "misaligned": -0.6}
ALERT_STATUS_BONUS = {"justified": 0.4, "premature": -0.5, "late": -0.15, "not_applicable": 0.0}
ALERT_BRANCH_BONUS = {"complete": 0.2, "incomplete": -0.1, "redundant": -0.05, "misaligned": -0.4}
ROLE_RANK = {"trigger": 0, "peak_action": 1, "peak": 1, "precursor": 2, "confirmation": 3, "aftermath": 3}


def covered(windows: Column, lo: Column | None = None, hi: Column | None = None) -> Column:
    """Seconds that the windows' union covers, between ``lo`` and ``hi`` if given."""

    def cut(w: Column) -> Column:
        s, e = F.least(w["start_sec"], w["end_sec"]), F.greatest(w["start_sec"], w["end_sec"])
        return F.struct((s if lo is None else F.greatest(s, lo)).alias("s"), (e if hi is None else F.least(e, hi)).alias("e"))

    parts = F.array_sort(F.filter(F.transform(windows, cut), lambda x: x["e"] > x["s"]))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(float("-inf")).alias("end"))
    more = lambda a, x: F.struct((a["sum"] + F.greatest(F.lit(0.0), x["e"] - F.greatest(x["s"], a["end"]))).alias("sum"), F.greatest(a["end"], x["e"]).alias("end"))
    return F.aggregate(parts, start, more, lambda a: a["sum"])


def coverage(windows: Column, target: Column) -> Column:
    """Share of an interval that the windows' union covers; 0 without an interval."""
    share = unit(covered(windows, target["start"], target["end"]) / F.greatest(target["end"] - target["start"], F.lit(1e-6)))
    return F.when(target["start"].isNotNull() & target["end"].isNotNull(), share).otherwise(F.lit(0.0))


def clip_share(windows: Column, duration: Column) -> Column:
    """Share of the clip that the windows cover; without a duration, of the clip up to their end."""
    end = F.array_max(F.transform(windows, lambda w: F.greatest(w["start_sec"], w["end_sec"])))
    of = F.when(F.coalesce(duration, F.lit(0.0)) > 0, duration).otherwise(end)
    return F.coalesce(unit(covered(windows) / F.greatest(of, F.lit(1e-6))), F.lit(0.0))


def best_overlap(windows: Column, held: Column) -> Column:
    """The best share of any of the reference windows ``held`` that a window overlaps."""

    def best(o: Column) -> Column:
        s, e = F.least(o["start_sec"], o["end_sec"]), F.greatest(o["start_sec"], o["end_sec"])
        return F.array_max(F.transform(windows, lambda w: overlap_share(F.least(w["start_sec"], w["end_sec"]), F.greatest(w["start_sec"], w["end_sec"]), s, e)))

    return F.coalesce(F.array_max(F.transform(held, best)), F.lit(0.0))


def of_roles(roles: Column, *names: str) -> Column:
    return F.filter(roles, lambda o: F.lower(o["role"]).isin(*names))


def role_score(windows: Column, roles: Column, *names: str) -> Column:
    """The best share of any reference window of these roles that a window overlaps."""
    return best_overlap(windows, of_roles(roles, *names))


def supports(trigger: Column, peak: Column, confirm: Column, precursor: Column, covers: Column, covers_precursor: Column) -> dict[str, Column]:
    """Six supports of a view from its best overlap with each role and its coverage of the anomaly and precursor."""
    t, p, c, pre = trigger >= HIT, peak >= HIT, confirm >= HIT, precursor >= HIT
    category = F.when(t & (p | c), 0.92).when(t, 0.78).when(p & c, 0.74).when(p, 0.48).when(c, 0.36).when(pre, 0.20).when(covers > 0, 0.10).otherwise(0.0)
    alert = F.when(t, 0.85).when(p & c, 0.72).when(p, 0.45).when(c, 0.30).when(pre, 0.15).otherwise(0.0)
    temporal = F.least(F.lit(1.0), 0.5 * covers + 0.5 * F.greatest(trigger, peak, confirm))
    rows = [F.greatest(category, 0.9 * covers), category, temporal, F.greatest(covers_precursor, 0.8 * precursor), alert, F.least(F.lit(1.0), 0.5 * category + 0.5 * temporal)]
    return dict(zip(SUPPORT, rows, strict=True))


def count_fallback(n: Column) -> dict[str, Column]:
    """Supports without any reference, from the number of windows alone."""
    c = F.when(n > 0, F.least(F.lit(1.0), 0.25 + 0.15 * n)).otherwise(0.0)
    return dict(zip(SUPPORT, [c, 0.9 * c, 0.85 * c, 0.4 * c, 0.75 * c, 0.8 * c], strict=True))


def normal_fallback(v: Column, n: Column) -> dict[str, Column]:
    """Supports of a claim that nothing happened, from coverage of the clip."""
    rows = [0.25 + 0.6 * v + 0.05 * n, 0.20 + 0.55 * v + 0.05 * n, 0.15 + 0.6 * v + 0.05 * F.greatest(n - 1, F.lit(0)), F.lit(0.0), 0.15 + 0.5 * v + 0.05 * n, 0.10 + 0.5 * v + 0.05 * n]
    return {k: F.when(n > 0, unit(c)).otherwise(0.0) for k, c in zip(SUPPORT, rows, strict=True)}


def overall(s: dict[str, Column], has_precursor: Column) -> Column:
    """The weighted mean of the supports; the precursor's drops out where there is none."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, w in SUPPORT.items():
        on = F.when(has_precursor, w).otherwise(0.0) if name == "precursor_support" else F.lit(w)
        total, weight = total + on * s[name], weight + on
    return unit(total / weight)


def _facts(w: Column) -> Column:
    role = lambda k: best_overlap(w, F.col("_held")[k]).alias(k)
    return F.struct(
        F.size(w).alias("n"), clip_share(w, F.col("duration")).alias("clip"), role("t"), role("p"), role("c"), role("pre"), coverage(w, F.col("anomaly")).alias("cover"), coverage(w, F.col("precursor")).alias("cover_pre"),
    )


def _six(f: Column, route: Column) -> Column:
    by_role, by_count, by_clip = supports(f["t"], f["p"], f["c"], f["pre"], f["cover"], f["cover_pre"]), count_fallback(f["n"]), normal_fallback(f["clip"], f["n"])
    return F.struct(*[F.when(route == "normal", F.round(by_clip[k], 6)).when(route == "count", by_count[k]).otherwise(F.round(by_role[k], 6)).alias(k) for k in SUPPORT])


def derived(full: Column, keep: Column, drop: Column, prefix: Column) -> dict[str, Column]:
    suff, nec = keep, unit(full - drop)
    rows = {"sufficiency": suff, "necessity": nec, "consistency": unit(1 - F.abs(full - keep)), "alertability": prefix, "counterfactual_faithfulness": unit(0.5 * suff + 0.5 * nec)}
    return {k: F.round(c, 6) for k, c in rows.items()}


def primary_status(full: Column, keep: Column, drop: Column, keep_s: dict[str, Column] | Column, d: dict[str, Column] | Column) -> Column:
    return (
        F.when((keep_s["exist_support"] < 0.2) & (keep_s["temporal_support"] < 0.2), "misaligned").when((keep_s["category_support"] < 0.15) & (keep < 0.35), "misaligned")
        .when((keep < 0.55) & (full >= 0.6), "incomplete").when((keep >= 0.6) & (drop >= 0.65), "redundant")
        .when((keep >= 0.6) & (d["necessity"] >= 0.2) & (d["consistency"] >= 0.75), "complete").otherwise("incomplete")
    )


def alert_status(has_alert: Column, alert_sec: Column, alertability: Column, expected: Column) -> Column:
    return F.when(~has_alert, "not_applicable").when(alertability >= 0.65, "justified").when(alert_sec > expected + TOLERANCE, "late").otherwise("premature")


def next_action(status: Column, alert: Column, mode: Column) -> Column:
    """A complete verdict finalizes in a final mode, else only if its alert was right or there was none."""
    done = F.when(mode.isin(*FINAL_MODES) | alert.isin("justified", "not_applicable"), "finalize").otherwise("continue_search")
    return F.when(status == "complete", done).when(status == "redundant", "refine_evidence").when(status == "misaligned", "revise_claim").otherwise("continue_search")


def failure_reasons(status: Column, alert: Column) -> Column:
    own = (
        F.when(status == "incomplete", "selected_evidence_not_sufficient").when(status == "redundant", "selected_evidence_not_necessary_enough")
        .when(status == "misaligned", "selected_evidence_not_aligned_with_claim")
    )
    timing = F.when(alert == "premature", "alert_prefix_not_actionable").when(alert == "late", "alert_after_expected_actionable_time")
    return F.filter(F.array(own, timing), lambda x: x.isNotNull())


def _ids(windows: Column) -> Column:
    return F.filter(F.transform(windows, lambda w: w["window_id"]), lambda i: F.coalesce(i, F.lit("")) != "")


def verdicts(df: DataFrame, name: str = "verdict") -> DataFrame:
    """Add the verdict on the windows whose ids are ``chosen`` (null or empty: on the whole ledger), as a struct ``name``.

    Read columns: ``ledger`` and ``visited`` (arrays of ``WINDOW``), ``chosen`` (ids), ``has_alert``, ``alert_sec``, ``mode``;
    of the claim, or of the reference where the claim is silent, ``existence``, ``anomaly`` and ``precursor`` (structs of
    start and end, or null), ``earliest_alert``; and the reference's ``roles`` (role, start_sec, end_sec), ``known`` (whether
    there is any target) and the clip's ``duration``.

    An empty ledger is seen as the visited windows that aren't scans. Chosen ids that no window has select nothing. Of
    windows that repeat an id the last counts. A claim of a normal clip without reference windows is scored by coverage of
    the clip, one without any reference by the number of windows, all others by roles and coverage.
    """
    c, none = F.col, F.array().cast(f"array<{WINDOW}>")
    ids = F.coalesce("chosen", F.array().cast("array<string>"))
    named = F.filter(F.array_distinct(ids), lambda i: F.exists("ledger", lambda w: w["window_id"] == i))
    last = lambda i: F.element_at(F.filter("ledger", lambda w: w["window_id"] == i), -1)
    unscanned = F.filter(F.coalesce("visited", none), lambda w: F.coalesce(w["kind"], F.lit("")) != "scan")
    bare = F.size("roles") == 0
    route = F.when(bare & F.coalesce(F.lower(F.trim("existence")) == "normal", F.lit(False)), "normal").when(bare & ~c("known"), "count").otherwise("roles")
    applies = F.when(c("_route") == "normal", F.lit(False)).when(c("_route") == "count", F.lit(True)).otherwise(c("precursor").isNotNull())
    at = F.coalesce(F.when(c("has_alert"), c("alert_sec")), c("earliest_alert"))
    out = df.withColumns({"_full": F.when(F.size("ledger") > 0, c("ledger")).otherwise(unscanned), "_keep": F.when(F.size(ids) == 0, c("ledger")).otherwise(F.transform(named, last)), "_route": route})
    out = out.withColumn("_kept", _ids(c("_keep")))
    drop = F.filter("_full", lambda w: ~F.coalesce(F.array_contains("_kept", w["window_id"]), F.lit(False)))
    out = out.withColumn("_views", F.array("_full", "_keep", drop, F.filter("_full", lambda w: at.isNull() | (w["start_sec"] <= at))))
    # Reference windows are told apart by role once, not for each view.
    held = {"t": ("trigger",), "p": ("peak_action", "peak"), "c": ("confirmation", "aftermath"), "pre": ("precursor",)}
    out = out.withColumn("_held", F.struct(*[of_roles(c("roles"), *names).alias(k) for k, names in held.items()]))
    out = out.withColumn("_facts", F.transform("_views", _facts)).withColumn("_six", F.transform("_facts", lambda f: _six(f, c("_route"))))
    whole = lambda s: F.struct(*[s[k].alias(k) for k in SUPPORT], F.round(overall({k: s[k] for k in SUPPORT}, applies), 6).alias("overall_support"))
    out = out.withColumn("_scores", F.transform("_six", whole))
    view = {n: F.get("_scores", F.lit(i)) for i, n in enumerate(VIEWS)}
    total = [view[n]["overall_support"] for n in VIEWS]
    out = out.withColumn("_derived", F.struct(*[x.alias(n) for n, x in derived(*total).items()]))
    out = out.withColumns({"_status": primary_status(*total[:3], view["keep"], c("_derived")), "_timing": alert_status(c("has_alert"), c("alert_sec"), c("_derived")["alertability"], c("earliest_alert"))})
    effort = F.when((F.size("_kept") == 0) & (F.size(ids) == 0), F.slice(_ids(c("_full")), 1, 1)).otherwise(c("_kept"))
    out = out.withColumn(name, F.struct(
        c("_status").alias("primary_status"), c("_timing").alias("alert_status"), next_action(c("_status"), c("_timing"), c("mode")).alias("recommended_action"),
        F.struct(*[x.alias(n) for n, x in view.items()]).alias("view_scores"), c("_derived").alias("derived_scores"),
        c("_kept").alias("verified_window_ids"), effort.alias("best_effort_window_ids"), failure_reasons(c("_status"), c("_timing")).alias("failure_reasons"),
    ))
    return out.drop("_full", "_keep", "_route", "_kept", "_views", "_held", "_facts", "_six", "_scores", "_derived", "_status", "_timing")


def blend(a: Column, b: Column, alpha: float) -> Column:
    """Two score maps mixed by key; a key of only one of them keeps its score."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(alpha * x + (1 - alpha) * y, x, y))


def _worth(value: Column, table: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for k, v in table.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def status_bonus(status: Column) -> Column:
    return _worth(status, STATUS_BONUS)


def evidence_ids(ledger: Column, ids: Column) -> Column:
    """Evidence ids of the windows, in the ledger's order."""
    held = F.filter(ledger, lambda w: F.array_contains(ids, w["window_id"]) & (F.coalesce(w["evidence_id"], F.lit("")) != ""))
    return F.transform(held, lambda w: w["evidence_id"])


def minimal_subset(ledger: Column, ids: Column, most: int = 2) -> Column:
    """Ids of the ``most`` telling of the windows: by role, then the latest end, then the id."""
    rank = lambda w: F.least(*[F.when(F.lower(w["role"]) == k, v).otherwise(4) for k, v in ROLE_RANK.items()])
    held = F.filter(ledger, lambda w: F.coalesce(F.array_contains(ids, w["window_id"]), F.lit(False)))
    keyed = F.transform(held, lambda w: F.struct(rank(w).alias("r"), (-w["end_sec"]).alias("e"), F.coalesce(w["window_id"], F.lit("")).alias("id")))
    return F.transform(F.slice(F.array_sort(keyed), 1, most), lambda x: x["id"])


BRANCH = f"struct<group_kind:string,branch_type:string,ledger:array<{WINDOW}>,visited:array<{WINDOW}>,chosen:array<string>,has_alert:boolean,alert_sec:double,mode:string,share:double>"


def _branch(kind: str, name: Column, ledger: Column, visited: Column, chosen: Column, has_alert: Column, alert_sec: Column, mode: str, share: Column) -> Column:
    held = [F.lit(kind), name, ledger, visited, chosen, has_alert, alert_sec, F.lit(mode), share.cast("double")]
    names = ["group_kind", "branch_type", "ledger", "visited", "chosen", "has_alert", "alert_sec", "mode", "share"]
    return F.struct(*[x.alias(n) for n, x in zip(names, held, strict=True)])


def alert_branches(alerts: Column) -> Column:
    """Branches that alert at several times: of structs ``branch_type, ledger, visited, has_alert, alert_sec``, each judged in its own state."""
    none = F.array().cast("array<string>")
    return F.transform(alerts, lambda b: _branch("alert", b["branch_type"], b["ledger"], b["visited"], none, b["has_alert"], b["alert_sec"], "soft_alert_check", F.lit(0.0))).cast(f"array<{BRANCH}>")


def evidence_branches(ledger: Column, chosen: Column, has_alert: Column, alert_sec: Column, minimal: Column | None = None) -> Column:
    """Branches that keep the whole ledger, the chosen windows, the others, and a minimal subset of the chosen. ``share``: of the ledger that a branch keeps."""
    none = F.array().cast(f"array<{WINDOW}>")
    every = _ids(ledger)
    least = minimal_subset(ledger, chosen) if minimal is None else F.when(F.size(minimal) > 0, minimal).otherwise(minimal_subset(ledger, chosen))
    kept = {"full_ledger": every, "keep_selected": chosen, "drop_selected": F.filter(every, lambda i: ~F.array_contains(chosen, i)), "minimal_subset": least}
    size = F.greatest(F.lit(1), F.size(every))
    return F.array(*[_branch("evidence", F.lit(n), ledger, none, ids, has_alert, alert_sec, "full_keep_drop", F.size(ids) / size) for n, ids in kept.items()]).cast(f"array<{BRANCH}>")


def _same_window(a: Column, b: Column) -> Column:
    text = lambda k: F.coalesce(a[k], F.lit("")) == F.coalesce(b[k], F.lit(""))
    time = lambda k: F.coalesce(a[k], F.lit(0.0)) == F.coalesce(b[k], F.lit(0.0))
    return text("window_id") & text("evidence_id") & time("start_sec") & time("end_sec")


def windows_since(before: Column, after: Column) -> Column:
    """Windows of ``after`` that ``before`` lacks, by ids and times."""
    return F.filter(after, lambda w: ~F.exists(before, lambda b: _same_window(w, b)))


def search_branches(before: Column, after: Column, has_alert: Column, alert_sec: Column, duration: Column) -> Column:
    """Branches without a search, with it, and with what it added alone, of states (structs of ``ledger, visited``). ``share``: of the clip that a branch has seen."""
    state = lambda s: (s["ledger"], s["visited"])
    new = (windows_since(before["ledger"], after["ledger"]), windows_since(before["visited"], after["visited"]))

    def one(name: str, ledger: Column, visited: Column) -> Column:
        seen = F.when(F.size(visited) > 0, visited).otherwise(ledger)
        ratio = F.when(F.coalesce(duration, F.lit(0.0)) > 1e-8, unit(covered(seen) / duration)).otherwise(0.0)
        return _branch("search", F.lit(name), ledger, visited, F.array().cast("array<string>"), has_alert, alert_sec, "search_step_check", ratio)

    return F.array(one("skip_search", *state(before)), one("use_search", *state(after)), one("delta_only", *new)).cast(f"array<{BRANCH}>")


def reward_parts(kind: str, status: Column, timing: Column, d: Column, share: Column, late: Column, penalty: float) -> dict[str, Column]:
    """What a judged branch of a group is paid for. ``penalty``: for each second of delay, or the whole ledger or clip."""
    if kind == "alert":
        return {
            "alertability_reward": 0.40 * d["alertability"], "claim_support_reward": 0.30 * d["sufficiency"], "alert_status_bonus": 0.20 * _worth(timing, ALERT_STATUS_BONUS),
            "primary_status_bonus": 0.10 * _worth(status, ALERT_BRANCH_BONUS), "delay_penalty": -abs(penalty) * late,
        }
    if kind == "evidence":
        return {
            "sufficiency_reward": 0.35 * d["sufficiency"], "necessity_reward": 0.35 * d["necessity"], "counterfactual_reward": 0.20 * d["counterfactual_faithfulness"],
            "primary_status_bonus": 0.10 * status_bonus(status), "subset_size_penalty": -abs(penalty) * share,
        }
    return {
        "sufficiency_reward": 0.35 * d["sufficiency"], "necessity_reward": 0.20 * d["necessity"], "counterfactual_reward": 0.20 * d["counterfactual_faithfulness"],
        "alertability_reward": 0.10 * d["alertability"], "primary_status_bonus": 0.15 * status_bonus(status), "search_cost_penalty": -abs(penalty) * share,
    }


def counterfactuals(df: DataFrame, keys: list[str], branches: str = "branches", delay: float = 0.10, size: float = 0.10, cost: float = 0.10, eps: float = 1e-6) -> DataFrame:
    """One row for each branch (an array column of ``BRANCH``): its verdict, paid components, reward, and advantage in its own group of its record.

    ``keys`` tell records apart. The other columns of ``verdicts`` are the record's.
    """
    own = ["group_kind", "branch_type", "ledger", "visited", "chosen", "has_alert", "alert_sec", "mode", "share"]
    rows = verdicts(df.drop(*own).select("*", F.inline(branches)).drop(branches))
    v, kind = F.col("verdict"), F.col("group_kind")
    late = F.coalesce(F.greatest(F.lit(0.0), F.col("alert_sec") - F.col("earliest_alert")), F.lit(0.0))
    paid = {k: reward_parts(k, v["primary_status"], v["alert_status"], v["derived_scores"], F.col("share"), late, p) for k, p in (("alert", delay), ("evidence", size), ("search", cost))}
    chain = lambda f: F.when(kind == "alert", f(paid["alert"])).when(kind == "evidence", f(paid["evidence"])).otherwise(f(paid["search"]))
    parts = chain(lambda p: F.map_from_arrays(F.array(*[F.lit(n) for n in p]), F.array(*p.values())))
    total = chain(lambda p: F.round(sum(p.values(), F.lit(0.0)), 6))
    effort = v["best_effort_window_ids"]
    windows = F.when(kind == "evidence", F.col("chosen")).otherwise(effort)
    rows = rows.withColumns({"branch_reward_components": parts, "branch_reward": total, "selected_window_ids": windows})
    group = Window.partitionBy(*keys, "group_kind")
    mean, spread = F.avg("branch_reward").over(group), F.stddev_pop("branch_reward").over(group)
    rows = rows.withColumns({"group_reward_mean": mean, "group_reward_std": spread, "selected_evidence_ids": evidence_ids(F.col("ledger"), F.col("selected_window_ids"))})
    z = F.when(F.col("group_reward_std") <= eps, 0.0).otherwise((F.col("branch_reward") - F.col("group_reward_mean")) / (F.col("group_reward_std") + eps))
    return rows.withColumn("local_advantage", F.round(z, 6)).withColumns({k: F.round(k, 6) for k in ("group_reward_mean", "group_reward_std")})


def attach_verdicts(df: DataFrame, force: bool = False, name: str = "offline_verifier") -> DataFrame:
    """``name`` filled with a final verdict where it is null, or everywhere if ``force``; verdicts that are there stay.

    Beside what ``verdicts`` reads of a record (but for ``chosen, has_alert, alert_sec, mode``): ``turns`` (in order, structs of
    ``verified`` window ids and ``alert_sec``, null without an alert), ``active`` window ids, and the state's ``alerts`` (structs of
    ``alert_sec``). The windows are those of the last turn that verified some, else the active ones, else the ledger's; the alert
    is the state's last one, else that of the last turn with one.
    """
    last = lambda a: F.try_element_at(a, F.lit(-1))
    verified = last(F.filter("turns", lambda t: F.size(t["verified"]) > 0))["verified"]
    chosen = first_filled(verified=verified, active=F.col("active"), ledger=_ids(F.col("ledger")))["ids"]
    turn = last(F.filter("turns", lambda t: t["alert_sec"].isNotNull()))["alert_sec"]
    has, sec = F.size("alerts") > 0, last(F.col("alerts"))["alert_sec"]
    asked = df.withColumns({"chosen": chosen, "has_alert": F.coalesce(has, F.lit(False)) | turn.isNotNull(), "alert_sec": F.when(has, sec).otherwise(turn), "mode": F.lit("final_check")})
    out = verdicts(asked, "_new")
    new = F.col("_new") if force else F.coalesce(F.col(name).cast(out.schema["_new"].dataType.simpleString()), "_new") if name in df.columns else F.col("_new")
    return out.withColumn(name, new).drop("_new", *[c for c in ("chosen", "has_alert", "alert_sec", "mode") if c not in df.columns])
