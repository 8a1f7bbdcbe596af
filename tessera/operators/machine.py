"""The episode state machine: a policy's replies against the tools, one pure step at a time, in batch or on a stream.

A step reads a reply, runs the tool it calls on the state, and gives the next state and a row of what happened. A
reply that can't be read, or that breaks a rule of its tool, costs an attempt and not a turn. An episode ends when it
answers or closes its case, runs out of turns, or out of attempts.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.payload import ALERT_TYPES
from tessera.functions.text import ALIASES, CATEGORIES, COMBINED, SUBSTRINGS

from .self_report import ACTION_OF, ALERT_STATUSES, FORMER_MODES, MODES, REQUIRED, SCORES, STATUS_OF
from .verify import FINAL_MODES, SUPPORT, TOLERANCE

# Turns of an episode, attempts for each turn, frames of a window, and keys that make a verification a report of the policy's own.
MAX_TURNS, ATTEMPTS_PER_TURN, MAX_FRAMES = 14, 4, 8
VERDICT_KEYS = [
    "verification_decision", "primary_status", "alert_status", "recommended_action", "sufficiency_score", "necessity_score", "alertability_score", "counterfactual_faithfulness", "derived_scores", "failure_reasons",
    "rationale", "explanation",
]
REQUEST_KEYS = ["claim", "alert", "query", "candidate_window_ids", "candidate_evidence_ids", "candidate_evidence_moment_ids", "evidence_ids", "evidence_moment_ids"]


@dataclass(frozen=True)
class Clip:
    """What the tools know of the clip. ``legacy`` and ``external`` let a request without a report be judged by the heuristic; ``no_external`` forbids the latter."""

    duration: float = 0.0
    fps: float = 1.0
    legacy: bool = False
    external: bool = False
    no_external: bool = False
    final_schema: dict = field(default_factory=dict)


@dataclass(frozen=True)
class State:
    """Windows are ``(window id, evidence id, kind, role, moment id, start, end)``. Scans take evidence numbers but stay out of the ledger."""

    visited: tuple = ()
    ledger: tuple = ()
    alerts: tuple = ()
    active: tuple = ()
    claim: dict = field(default_factory=dict)
    final: dict | None = None
    next_window: int = 1
    next_alert: int = 1
    turns: int = 0
    invalid: int = 0
    ended: str = ""

    def to_json(self) -> str:
        """An ended episode keeps nothing but its end."""
        return json.dumps(asdict(State(turns=self.turns, invalid=self.invalid, ended=self.ended) if self.ended else self))

    @staticmethod
    def from_json(text: str) -> State:
        d = json.loads(text)
        tup = lambda x: tuple(tuple(y) if isinstance(y, list) else y for y in x)
        return State(**{k: tup(v) if isinstance(v, list) else v for k, v in d.items()})


class Rejected(ValueError):
    """The call breaks a rule of its tool; the policy may try again."""


# ---- reading replies


def _json(text: str) -> object:
    try:
        return json.loads(text)
    except ValueError:
        return None


def seconds(value: object) -> object:
    """Numbers and texts such as ``12.5s`` or ``1:02:03`` as seconds; anything else as it is."""
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        return value
    try:
        total = 0.0
        for part in str(value).strip().removesuffix("s").split(":"):
            total = 60 * total + float(part)
        return total
    except ValueError:
        return value


def _arguments(tool: str, args: dict) -> dict:
    out = dict(args)
    for now, then in (("start_sec", "start_time"), ("end_sec", "end_time")):
        if then in out and now not in out:
            out[now] = out.pop(then)
    out |= {k: seconds(out[k]) for k in ("start_sec", "end_sec", "alert_sec", "earliest_alert_sec") if k in out}
    if tool == "emit_alert":
        kind = str(out.get("alert_type") or "").strip().lower()
        if kind:
            out.setdefault("decision", ALERT_TYPES.get(kind, kind))
        if "description" in out:
            out.setdefault("reason", out["description"])
        told = {"soft_alert": "anomaly", "hard_alert": "anomaly", "declare_normal": "normal"}.get(str(out.get("decision") or "").strip().lower())
        if told:
            out.setdefault("existence", told)
    return out


def read_reply(text: str | None) -> tuple[str, str, object]:
    """``(action, tool, payload)`` of the last block outside the thoughts, else of the last block: a tool call, an answer, an unreadable answer, or nothing."""
    blocks = r"<(tool_call|answer)>(.*?)</\1>"
    found = re.findall(blocks, re.sub(r"(?s)<think>.*?</think>", "", text or ""), re.DOTALL) or re.findall(blocks, text or "", re.DOTALL)
    if not found:
        return "", "", None
    kind, body = found[-1][0], found[-1][1].strip()
    if kind == "answer":
        payload = _json(body)
        return ("answer", "", payload) if isinstance(payload, dict) else ("invalid_answer", "", None)
    call = _json(body)
    if call is None and (bare := re.fullmatch(r"(?s)\{\s*([A-Za-z_]\w*)\s*:\s*(\{.*\})\s*\}", body)):
        call = {bare[1]: _json(bare[2])}
    if not isinstance(call, dict):
        return "", "", None
    name, args = (call["name"], call.get("arguments") or {}) if "name" in call else next(iter(call.items())) if len(call) == 1 else ("", None)
    name = str(name or "").strip()
    return ("tool_call", name, _arguments(name, args)) if name and isinstance(args, dict) else ("", "", None)


# ---- claims


def category(value: object, existence: object = None) -> str:
    """The canonical category, by the rules of ``text.category``."""
    if str(existence or "").strip().lower() == "normal":
        return "normal"
    t = re.sub("_+", "_", re.sub(r"[\s/-]+", "_", str(value or "").strip().lower())).strip("_")
    if t in ("", "normal", *CATEGORIES):
        return t
    if t in ALIASES:
        return ALIASES[t]
    for parts, label in SUBSTRINGS:
        bar = (label == "object_falling" and "object" not in t) or (parts == ("fall",) and "object" in t) or (label in ("explosion", "fire") and t == COMBINED)
        if not bar and any(p in t for p in parts):
            return label
    return t


def checked(claim: dict, what: str, required: bool = False) -> dict:
    """The claim with its canonical category; rejected if the category is unknown or doesn't go with what exists."""
    out, exists = dict(claim), str(claim.get("existence") or "").strip().lower()
    if "category" in out:
        out["category"] = category(out["category"], exists)
    elif exists == "normal":
        out["category"] = "normal"
    label = str(out.get("category") or "").strip()
    if required and exists == "anomaly" and not label:
        raise Rejected(f"{what}: an anomaly needs a category")
    if label and label not in ("normal", *CATEGORIES):
        raise Rejected(f"{what}: unknown category {label}")
    if label and (exists, label == "normal") in (("normal", False), ("anomaly", True)):
        raise Rejected(f"{what}: category {label} doesn't go with {exists}")
    return out


# ---- tools: each takes the state and arguments, and gives the next state and what the turn's row shows


def _number(value: object, default: float) -> float:
    try:
        return float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return default


def _frames(s: float, e: float, args: dict, clip: Clip, duration: float) -> list[int]:
    last = max(math.ceil(duration * clip.fps), 1) - 1
    a = max(0, min(math.floor(s * clip.fps), last))
    b = max(a, min(math.floor(e * clip.fps), last))
    even = lambda x, y, n: [x] if n == 1 else [round(x + (y - x) * i / (n - 1)) for i in range(n)]
    if args.get("stride_sec") is not None:
        stride = _number(args["stride_sec"], 0.0)
        picked = list(dict.fromkeys([*range(a, b + 1, max(1, round(stride * clip.fps)) if stride > 0 else 1), b]))
        return picked if len(picked) <= MAX_FRAMES else even(picked[0], picked[-1], MAX_FRAMES)
    n = max(1, min(int(_number(args.get("num_frames", MAX_FRAMES), MAX_FRAMES)), b - a + 1, MAX_FRAMES))
    return list(range(a, b + 1)) if b - a + 1 <= n else even(a, b, n)


def _window(s: State, args: dict, clip: Clip, evidence: bool) -> tuple[State, dict]:
    duration = clip.duration or 1.0 / clip.fps
    start = max(0.0, _number(args.get("start_sec", 0.0), 0.0))
    end = min(max(start, _number(args.get("end_sec", duration), duration)), duration)
    frames = _frames(start, end, args, clip, duration)
    text = lambda k: None if args.get(k) is None else str(args[k])
    w = (f"w{s.next_window:04d}", f"e{s.next_window:04d}", "evidence" if evidence else "scan", text("role") if evidence else None, text("moment_id") if evidence else None, start, end)
    s = replace(s, visited=(*s.visited, w), ledger=(*s.ledger, w) if evidence else s.ledger, next_window=s.next_window + 1)
    shown = {"window_id": w[0], "evidence_id": w[1] if evidence else None, "start_sec": start, "end_sec": end, "image_count": len(frames), "timestamps": [round(f / clip.fps, 6) for f in frames]}
    return s, shown | {"observation": f"{'Registered evidence' if evidence else 'Scanned'} {w[0]} [{start:.3f}, {end:.3f}] with {len(frames)} frames."}


def _alert(s: State, args: dict, clip: Clip) -> tuple[State, dict]:
    a = checked(args, "alert", required=True)
    early = a.get("earliest_alert_sec")
    alert = {"alert_id": f"a{s.next_alert:04d}", **{k: a.get(k) for k in ("decision", "existence", "category")}, "earliest_alert_sec": early, "alert_sec": a.get("alert_sec", early), "reason": a.get("reason")}
    at = early if early is not None else alert["alert_sec"]
    claim = {k: str(alert[k]).strip() for k in ("existence", "category") if str(alert[k] or "").strip()} | ({"earliest_alert_sec": float(at)} if isinstance(at, (int, float)) else {})
    return replace(s, alerts=(*s.alerts, alert), next_alert=s.next_alert + 1, claim=claim), {"alert_id": alert["alert_id"], "observation": f"Recorded alert {len(s.alerts)}."}


def _texts(*values: object) -> list[str]:
    """Distinct trimmed texts of the first value that holds any."""
    for v in values:
        if v:
            items = v if isinstance(v, (list, tuple)) else [v]
            return list(dict.fromkeys(t for t in (str(x).strip() for x in items) if t))
    return []


def resolve(s: State, args: dict) -> dict:
    """Which windows a verification means: by window (former names too), evidence and moment, else by candidate; and what couldn't be resolved."""
    known = [w[0] for w in s.ledger]
    asked, evidence, candidates = _texts(args.get("selected_window_ids")), _texts(args.get("selected_evidence_ids")), _texts(args.get("candidate_window_ids"))
    moments = _texts(args.get("selected_evidence_moment_ids"), args.get("evidence_moment_ids"))

    def place(i: str) -> str | None:
        n, back = (int(m[1]), 0) if (m := re.fullmatch(r"(?:evidence|w)_(\d+)", i)) else (int(m[1]), 1) if (m := re.fullmatch(r"w(\d+)", i)) and known and known[0] != "w0001" else (-1, 0)
        return known[n - back] if 0 <= n - back < len(known) else i if i in known else None

    found: dict[str, None] = {}
    sources, bad = [], []

    def add(ids: Sequence[str | None], source: str) -> None:
        new = [i for i in ids if i and i not in found]
        found.update(dict.fromkeys(new))
        if new:
            sources.append(source)

    placed = [(i, place(i)) for i in asked]
    bad = [i for i, p in placed if p is None]
    add([p for _, p in placed], "selected_window_ids")
    by_evidence = {w[1]: w[0] for w in s.ledger}
    add([by_evidence.get(e) for e in evidence], "selected_evidence_ids")
    add([w[0] for m in moments for w in s.ledger if w[4] == m], "selected_evidence_moment_ids")
    valid = [c for c in candidates if c in known]
    if not found:
        add(valid, "candidate_window_ids")
    wanted = bool(asked or evidence or moments or candidates)
    return {
        "resolved": list(found), "invalid": bad, "source": "+".join(sources) or ("unresolved" if wanted else "none"), "unresolved": wanted and not found, "candidates": valid, "evidence": evidence, "moments": moments,
        "raw": list(dict.fromkeys([*asked, *candidates])),
    }


def _score(value: object) -> float:
    return max(0.0, min(1.0, _number(value, 0.0)))


def _timing(alert: dict | None, claim: dict, alertability: float) -> str:
    if not alert:
        return "not_applicable"
    if alertability >= 0.65:
        return "justified"
    at, due = _number(alert.get("alert_sec", alert.get("earliest_alert_sec")), math.nan), _number(claim.get("earliest_alert_sec"), math.nan)
    return "late" if at > due + TOLERANCE else "premature"


def _reasons(status: str, timing: str) -> list[str]:
    own = {"incomplete": "selected_evidence_not_sufficient", "redundant": "selected_evidence_not_necessary_enough", "misaligned": "selected_evidence_not_aligned_with_claim"}.get(status)
    late = {"premature": "alert_prefix_not_actionable", "late": "alert_after_expected_actionable_time"}.get(timing)
    return [r for r in (own, late) if r]


def _own_report(p: dict, claim: dict, alert: dict | None) -> dict:
    """A policy's report, filled up as ``self_report`` does it."""
    lower = lambda k: str(p.get(k) or "").strip().lower()
    decision = lower("verification_decision")
    if decision not in STATUS_OF:
        decision = {v: k for k, v in STATUS_OF.items()}.get(lower("primary_status"), "insufficient")
    action = lower("recommended_action")
    held = p.get("derived_scores") or {}
    name = lambda s: s if s == "counterfactual_faithfulness" else f"{s}_score"
    scores = {s: _score(p.get(name(s), held.get(s, 0.0))) for s in SCORES}
    suff, nec = scores["sufficiency"], scores["necessity"]
    status = STATUS_OF[decision]
    timing = lower("alert_status")
    if timing not in ALERT_STATUSES:
        timing = _timing(alert, claim, scores["alertability"])
    scores["consistency"] = _score(held.get("consistency", 1 - abs(suff - nec) if suff or nec else 0.0))
    windows = _texts(p.get("selected_window_ids"))
    return {
        "decision": decision, "primary_status": status, "alert_status": timing, "recommended_action": action if action in ACTION_OF.values() else ACTION_OF[decision], "scores": {k: round(v, 6) for k, v in scores.items()},
        "verified": windows, "best_effort": windows or _texts(p.get("candidate_window_ids")), "reasons": _texts(p.get("failure_reasons")) or _reasons(status, timing), "confidence": round(max(suff, nec), 6), "backend": "self_report",
    }


def _view(windows: Sequence[tuple], claim: dict, clip: Clip) -> dict[str, float]:
    """Supports without a reference: by coverage of the clip for a claim that it is normal, else by the number of windows."""
    n, normal = len(windows), str(claim.get("existence") or "").strip().lower() == "normal"
    if not n:
        return dict.fromkeys([*SUPPORT, "overall"], 0.0)
    weights = {k: v for k, v in SUPPORT.items() if not (normal and k == "precursor_support")}
    if normal:
        union, end = 0.0, -math.inf
        for a, b in sorted(tuple(sorted(w[5:7])) for w in windows):
            union, end = union + max(0.0, b - max(a, end)), max(end, b)
        v = min(1.0, union / max(clip.duration if clip.duration > 0 else end, 1e-6))
        rows = [0.25 + 0.6 * v + 0.05 * n, 0.2 + 0.55 * v + 0.05 * n, 0.15 + 0.6 * v + 0.05 * (n - 1), 0.0, 0.15 + 0.5 * v + 0.05 * n, 0.1 + 0.5 * v + 0.05 * n]
        s = {k: round(min(1.0, x), 6) for k, x in zip(SUPPORT, rows, strict=True)}
    else:
        c = min(1.0, 0.25 + 0.15 * n)
        s = dict(zip(SUPPORT, [c, 0.9 * c, 0.85 * c, 0.4 * c, 0.75 * c, 0.8 * c], strict=True))
    return s | {"overall": min(1.0, sum(s[k] * w for k, w in weights.items()) / sum(weights.values()))}


def _heuristic(s: State, chosen: list[str], mode: str, claim: dict, alert: dict | None, clip: Clip) -> dict:
    """The heuristic verdict on the chosen windows, without a reference."""
    full = list(s.ledger) or [w for w in s.visited if w[2] != "scan"]
    keep = [w for i in chosen for w in s.ledger if w[0] == i] if chosen else list(s.ledger)
    at = _number(alert.get("alert_sec", alert.get("earliest_alert_sec")), math.nan) if alert else math.nan
    at = _number(claim.get("earliest_alert_sec"), math.nan) if math.isnan(at) else at
    ids = {w[0] for w in keep}
    f, k, d, p = (_view(v, claim, clip) for v in (full, keep, [w for w in full if w[0] not in ids], full if math.isnan(at) else [w for w in full if w[5] <= at]))
    nec, cons = max(0.0, min(1.0, f["overall"] - d["overall"])), max(0.0, 1 - abs(f["overall"] - k["overall"]))
    scores = {"sufficiency": k["overall"], "necessity": nec, "consistency": cons, "alertability": p["overall"], "counterfactual_faithfulness": 0.5 * k["overall"] + 0.5 * nec}
    scores = {n: round(v, 6) for n, v in scores.items()}
    if (k["exist_support"] < 0.2 and k["temporal_support"] < 0.2) or (k["category_support"] < 0.15 and k["overall"] < 0.35):
        status = "misaligned"
    elif k["overall"] < 0.55 and f["overall"] >= 0.6:
        status = "incomplete"
    elif k["overall"] >= 0.6 and d["overall"] >= 0.65:
        status = "redundant"
    else:
        status = "complete" if k["overall"] >= 0.6 and scores["necessity"] >= 0.2 and scores["consistency"] >= 0.75 else "incomplete"
    timing = _timing(alert, claim, scores["alertability"])
    action = {"misaligned": "revise_claim", "incomplete": "continue_search", "redundant": "refine_evidence"}.get(status) or ("finalize" if mode in FINAL_MODES or timing in ("justified", "not_applicable") else "continue_search")
    verified = [w[0] for w in keep]
    return {
        "decision": None, "primary_status": status, "alert_status": timing, "recommended_action": action, "scores": scores, "verified": verified, "best_effort": verified or ([] if chosen else [w[0] for w in full[:1]]),
        "reasons": _reasons(status, timing), "confidence": None, "backend": "heuristic",
    }


def _verify(s: State, args: dict, clip: Clip) -> tuple[State, dict]:
    """By the policy's own report; or, where the clip allows it, by the heuristic."""
    said = str(args.get("verification_mode") or "").strip().lower()
    mode = said if said in MODES else FORMER_MODES.get(said, "reward_only")
    claim = checked(args["claim"], "claim", required=True) if isinstance(args.get("claim"), dict) else None
    alert = checked(args["alert"], "alert") if isinstance(args.get("alert"), dict) else None
    claim, alert, sel = claim or dict(s.claim), alert or (s.alerts[-1] if s.alerts else None), resolve(s, args)
    if any(k in args for k in VERDICT_KEYS):
        p = args | {"verification_mode": mode, "selected_window_ids": sel["resolved"], "candidate_window_ids": sel["candidates"]}
        lacks = [k for k in REQUIRED if k not in p]
        if lacks or not sel["resolved"]:
            raise Rejected(f"the report lacks {', '.join(lacks) or 'a known window'}")
        v, how = _own_report(p, checked(claim, "claim", required=True), alert), "self_report"
    elif any(bool(args[k].strip() if isinstance(args[k], str) else args[k]) for k in REQUEST_KEYS if isinstance(args.get(k), (dict, list, str))):
        if clip.legacy:
            how = "legacy_compatibility"
        elif clip.no_external or not (clip.external or args.get("allow_external_verifier_fallback")):
            raise Rejected("a verification must report its own verdict")
        else:
            how = "external_verifier_fallback"
        by_evidence = [w[0] for e in sel["evidence"] for w in s.ledger if w[1] == e]
        chosen = sel["resolved"] or sel["raw"] or by_evidence
        v = _heuristic(s, chosen, mode, claim, alert, clip)
    else:
        raise Rejected("a verification must report a verdict or ask for one")
    if sel["unresolved"]:
        v |= {"verified": [], "best_effort": [], "reasons": list(dict.fromkeys([*v["reasons"], "selected_evidence_not_resolved_to_known_windows"]))}
    shown = {
        "verification_mode": mode, "verifier_backend": v["backend"], "parse_mode": how, "decision": v["decision"], "primary_status": v["primary_status"], "alert_status": v["alert_status"], "recommended_action": v["recommended_action"],
        "scores": v["scores"], "verified_window_ids": v["verified"], "best_effort_window_ids": v["best_effort"], "invalid_selected_window_ids": sel["invalid"], "selection_source": sel["source"], "failure_reasons": v["reasons"],
        "confidence": v["confidence"], "observation": f"Selected evidence is {v['primary_status']}, the alert {v['alert_status']}.",
    }
    return replace(s, claim=claim, active=tuple(v["verified"] or v["best_effort"])), shown


def _type_ok(value: object, schema: dict) -> bool:
    if schema.get("oneOf"):
        return any(_type_ok(value, o) for o in schema["oneOf"])
    kinds = {"string": str, "number": (int, float), "integer": int, "boolean": bool, "array": list, "object": dict, "null": type(None)}
    want = schema.get("type")
    fits = want not in kinds or (isinstance(value, kinds[want]) and not (isinstance(value, bool) and want in ("number", "integer")))
    return fits and ("enum" not in schema or value in schema["enum"])


def _finalize(s: State, args: dict, clip: Clip) -> tuple[State, dict]:
    case, schema = checked(args, "finalize_case", required=True), clip.final_schema or {}
    lacks = [k for k in schema.get("required", []) if k not in case]
    wrong = [k for k, v in (schema.get("properties") or {}).items() if k in case and not _type_ok(case[k], v)]
    if lacks or wrong:
        raise Rejected(f"the case lacks or misstates {', '.join(lacks or wrong)}")
    return replace(s, final=case, claim=case), {"observation": f"Finalized as {case.get('category') or case.get('existence')}."}


RULES = {"scan_timeline": lambda s, a, c: _window(s, a, c, False), "seek_evidence": lambda s, a, c: _window(s, a, c, True), "emit_alert": _alert, "verify_hypothesis": _verify, "finalize_case": _finalize}
RETRY = {
    "finalize_case": "Call finalize_case again, with every field that its schema requires.", "verify_hypothesis": "Call verify_hypothesis again, with a whole report on known windows: {windows}.",
    "answer": "The answer must be one JSON object.", "": "Reply with exactly one tool call or answer.",
}


def step(s: State, reply: str | None, clip: Clip = Clip(), max_turns: int = MAX_TURNS) -> tuple[State, dict]:  # noqa: B008
    """One reply. After the end nothing changes and every reply is late."""
    if s.ended:
        return s, {"action": None, "tool_name": None, "valid_action": False, "is_search": False, "done": True, "observation": "late"}
    action, tool, payload = read_reply(reply)
    row: dict = {"action": action or None, "tool_name": tool or None, "is_search": False}
    try:
        if action == "answer":
            s, shown = replace(s, turns=s.turns + 1), {"observation": None}
        elif action != "tool_call" or tool not in RULES:
            raise Rejected(RETRY["answer" if action == "invalid_answer" else ""])
        else:
            s, shown = RULES[tool](s, payload, clip)
            s, row["is_search"] = replace(s, turns=s.turns + 1), True
        row |= shown | {"valid_action": True}
    except Rejected as e:
        hint = RETRY.get(tool, "").format(windows=", ".join(w[0] for w in s.ledger) or "none yet")
        s, row = replace(s, invalid=s.invalid + 1), row | {"valid_action": False, "observation": f"{e} {hint}".strip()}
    end = "answered" if row["valid_action"] and action == "answer" else "finalized" if s.final is not None else "max_turns" if s.turns >= max_turns else "max_attempts" if s.turns + s.invalid > ATTEMPTS_PER_TURN * max_turns else ""
    return replace(s, ended=end), row | {"done": bool(end)}


FIELDS = {
    "action": "string", "tool_name": "string", "valid_action": "boolean", "is_search": "boolean", "done": "boolean", "observation": "string", "window_id": "string", "evidence_id": "string", "start_sec": "double", "end_sec": "double",
    "image_count": "long", "timestamps": "array<double>", "alert_id": "string", "verification_mode": "string", "verifier_backend": "string", "parse_mode": "string", "decision": "string", "primary_status": "string", "alert_status": "string",
    "recommended_action": "string", "scores": "map<string,double>", "verified_window_ids": "array<string>", "best_effort_window_ids": "array<string>", "invalid_selected_window_ids": "array<string>", "selection_source": "string",
    "failure_reasons": "array<string>", "confidence": "double",
}
OUT = ", ".join(["episode_id long", "step_index long", *[f"{k} {t}" for k, t in FIELDS.items()], "n_ledger long", "turns long", "invalid long", "ended string"])


def play(state: State, episode_id: int, rows: pd.DataFrame, clip: Clip = Clip()) -> tuple[State, pd.DataFrame]:  # noqa: B008
    """Run replies in order; late ones, which come after the end, are left out."""
    out = []
    for r in rows.sort_values("step_index").itertuples(index=False):
        if state.ended:
            break
        state, row = step(state, r.reply, clip)
        out.append((episode_id, r.step_index, *[row.get(k) for k in FIELDS], len(state.ledger), state.turns, state.invalid, state.ended))
    names = ["episode_id", "step_index", *FIELDS, "n_ledger", "turns", "invalid", "ended"]
    return state, pd.DataFrame(out, columns=names).astype({"image_count": "Int64", "confidence": "float64", "start_sec": "float64", "end_sec": "float64"})


def replay(replies: DataFrame, clip: Clip = Clip()) -> DataFrame:  # noqa: B008
    """Each episode from its start, of ``episode_id, step_index, reply``: one output row for each reply up to the end.

    Only the first ``(ATTEMPTS_PER_TURN + 1) * MAX_TURNS`` replies of an episode can matter, so no more are sent and an
    episode fits in memory.
    """
    most = (ATTEMPTS_PER_TURN + 1) * MAX_TURNS

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return play(State(), key[0], rows, clip)[1]

    place = F.row_number().over(Window.partitionBy("episode_id").orderBy("step_index"))
    return replies.withColumn("_place", place).where(F.col("_place") <= most).select("episode_id", "step_index", "reply").groupBy("episode_id").applyInPandas(run, OUT)


def resume(key: tuple, batches: Iterator[pd.DataFrame], held, clip: Clip = Clip()) -> Iterator[pd.DataFrame]:  # noqa: ANN001, B008
    """The same steps with state kept between micro-batches."""
    state = State.from_json(held.get[0]) if held.exists else State()
    rows = pd.concat(list(batches), ignore_index=True)
    state, out = play(state, key[0], rows, clip)
    held.update((state.to_json(),))
    yield out
