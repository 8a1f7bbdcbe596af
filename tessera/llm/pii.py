"""Personal data: fixed forms, plus identifiers found by bootstrapped lexical patterns.

Matches of the fixed forms are the seeds. The words around them are patterns; Spark scores patterns and
instances against each other in rounds, over all documents. A pattern whose slot almost always holds one kind
adds the other identifiers in its slot as spans of that kind.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_CANDIDATE = re.compile(r"[^\s\"'<>,;|]+")
_DIGIT = re.compile(r"[0-9]")
_HINT = re.compile(r"[0-9@_]")
_JOINED = re.compile(r"[^\W0-9_][@_][^\W0-9_]")
_WORD = re.compile(r"\S+")

#: Rounds at most, distinct instances of a kind (seeds or discovered ones) that a pattern needs, and the share of its slot that its kind must hold.
ROUNDS, MIN_SEEDS, MIN_CONFIDENCE = 4, 5, 0.8
#: Characters that tell the part of a word which adjoins a slot.
ADJOINING = 40
SPANS = "array<struct<kind:string,start:int,end:int>>"
FOUND = "array<struct<kind:string,start:int,end:int,value:string,patterns:array<string>>>"


def _email(t: str) -> Iterator[tuple[int, int]]:
    done, at = 0, t.find("@")
    while at >= 0:
        s = at
        while s > done and t[s - 1] in LOCAL:
            s -= 1
        m = _DOMAIN.match(t, at) if s < at else None
        if m:
            yield s, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = t.find("@", done)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """The fixed forms in a whole text, by kind, then start; places are code points, ends exclusive.

    The expressions never try a place twice, so long runs of digits or letters take linear time.
    """
    t = text or ""
    out = [("email", s, e) for s, e in _email(t)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(t) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 13 and 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(t) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def join_spans(spans: list[tuple[str, int, int]]) -> str:
    rank = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (rank[x[0]], x[1], x[2])))


def _word(w: str) -> str:
    w = _DIGIT.sub("0", w.lower())
    return w if len(w) <= 40 else hashlib.md5(w.encode("utf-8", "surrogatepass")).hexdigest()


class _Context:
    """The words of a text, to read patterns around any place of it in time that doesn't grow with their length."""

    def __init__(self, t: str) -> None:
        self.t = t
        self.spans = [m.span() for m in _WORD.finditer(t)]
        self.ends = [e for _, e in self.spans]
        self.forms: dict[int, str] = {}

    def form(self, i: int) -> str:
        if i not in self.forms:
            self.forms[i] = _word(self.t[slice(*self.spans[i])])
        return self.forms[i]

    def patterns(self, s: int, e: int) -> list[str]:
        """Two words before the slot, and one on either side.

        A part of a word that adjoins the slot is a word, told by its nearest ``ADJOINING`` characters; and so is a text's end.
        """
        i = bisect_right(self.ends, s)
        inside = i < len(self.spans) and self.spans[i][0] < s
        left = [self.form(k) for k in range(max(0, i - 2 + inside), i)]
        if inside:
            left.append(_word(self.t[max(self.spans[i][0], s - ADJOINING) : s]))
        before = ["^"] * (2 - len(left)) + left
        j = bisect_right(self.ends, e)
        after = "$" if j == len(self.spans) else self.form(j) if self.spans[j][0] >= e else _word(self.t[e : min(self.spans[j][1], e + ADJOINING)])
        return [f"{before[0]} {before[1]} _", f"{before[1]} _ {after}"]


def _like_an_identifier(value: str) -> bool:
    digits = len(_DIGIT.findall(value))
    if not digits:
        return _JOINED.search(value) is not None
    return digits >= 5 or (value.strip("0123456789") != "" and any(c in value for c in "@-._"))


def scan(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple]]:
    """Base spans, and for them and each other identifier-like token: kind (empty if unknown), place, value, patterns.

    Identifier-like: at least five digits, or a digit and one of ``@`` ``-`` ``.`` ``_``, or ``@`` or ``_`` between
    letters; marks at the ends don't count. Words end at any white space of Unicode.
    """
    t = text or ""
    base = base_spans(t)
    hint = _HINT.search(t)
    if not hint:
        return base, []
    words = _Context(t)
    found = [(k, s, e, t[s:e], words.patterns(s, e)) for k, s, e in base]
    taken = sorted((s, e) for _, s, e in base)
    i = 0
    while hint:
        s, e = words.spans[bisect_right(words.ends, hint.start())]
        for m in _CANDIDATE.finditer(t, s, e):
            value = m[0].strip(".:!?*#$%&()[]{}=")
            start = m.start() + m[0].find(value) if value else m.start()
            while i < len(taken) and taken[i][1] <= start:
                i += 1
            if _HINT.search(value) and _like_an_identifier(value) and not (i < len(taken) and taken[i][0] < start + len(value)):
                found.append(("", start, start + len(value), value, words.patterns(start, start + len(value))))
        hint = _HINT.search(t, e)
    return base, found


def _scan_all(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [scan(t) for t in b["_text"]]
            yield pd.DataFrame({
                "_id": b["_id"], "_row": b["_row"],
                "_base": [[{"kind": k, "start": s, "end": e} for k, s, e in base] for base, _ in rows],
                "_found": [[{"kind": k, "start": s, "end": e, "value": v, "patterns": p} for k, s, e, v, p in found] for _, found in rows],
            })

    rows = df.select(F.col(id_col).cast("string").alias("_id"), F.xxhash64(F.col(text_col)).alias("_row"), F.col(text_col).alias("_text"))
    return rows.mapInPandas(run, f"_id string, _row long, _base {SPANS}, _found {FOUND}").withColumn("_id", F.col("_id").cast(kind))


def learn_patterns(found: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``pattern, kind, confidence`` from all occurrences (columns ``kind``, ``value``, ``pattern``).

    An instance's belief in a kind is 1 for a seed of it, else a noisy-or over its confident patterns. A pattern's
    confidence in a kind is the mean belief over the distinct instances in its slot; it is confident if at least
    ``min_seeds`` of them are believed and the mean is at least ``min_confidence``. Every round recomputes both from
    all occurrences, so what one round discovers induces patterns in the next. Rounds end early when they change nothing.
    """
    edges = Stored(found.groupBy("pattern", F.xxhash64("value").alias("instance")).agg(F.max("kind").alias("kind")))
    seeds = Stored(edges.df.where("kind <> ''").groupBy("instance").agg(F.min("kind").alias("kind"), F.lit(1.0).alias("belief")))
    sizes = Stored(edges.df.groupBy("pattern").agg(F.count(F.lit(1)).alias("size")))
    open_edges = edges.df.where("kind = ''").join(seeds.df, "instance", "left_anti").select("pattern", "instance")
    believed, done, patterns = seeds, None, None
    for r in range(rounds):
        held = edges.df.select("pattern", "instance").join(believed.df, "instance")
        support = held.groupBy("pattern", "kind").agg(F.sum("belief").alias("total"), F.count(F.lit(1)).alias("members")).where(F.col("members") >= min_seeds)
        scored = support.join(sizes.df, "pattern").select("pattern", "kind", (F.col("total") / F.col("size")).alias("confidence"))
        if patterns is not None:
            patterns.drop()
        patterns = Stored(scored.where(F.col("confidence") >= min_confidence))
        state = patterns.df.agg(F.count(F.lit(1)), F.round(F.sum("confidence"), 9)).first()
        if state == done or r == rounds - 1:
            break
        done = state
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))
        beliefs = open_edges.join(patterns.df, "pattern").groupBy("instance", "kind").agg((1 - doubt).alias("b"))
        # Of several kinds, the most believed one; then the first by name.
        best = beliefs.groupBy("instance").agg(F.min(F.struct((-F.col("b")).alias("b"), "kind")).alias("k")).select("instance", "k.kind", (-F.col("k.b")).alias("belief"))
        if believed is not seeds:
            believed.drop()
        believed = Stored(seeds.df.unionByName(best))
    for table in {id(x): x for x in (edges, seeds, sizes, believed)}.values():
        table.drop()
    return patterns.df


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """One row for each document: ``id_col``, ``base`` and ``added`` (arrays of kind, start, end).

    ``base``: the fixed forms; ``added``: identifiers that a learned pattern gives a kind. Null and empty texts
    have none, repeated rows each give a row, null ids are rows like others, and an empty table gives no row.
    Other columns are not read.
    """
    rows = Stored(_scan_all(df, id_col, text_col)).df
    seen = rows.select("_id", "_row", F.explode("_found").alias("f")).select("_id", "_row", "f.*")
    each = seen.select("_id", "_row", "kind", "start", "end", "value", F.explode("patterns").alias("pattern"))
    patterns = learn_patterns(each.select("kind", "value", "pattern"), rounds, min_seeds, min_confidence)
    new = each.where("kind = ''").drop("kind").join(patterns, "pattern")
    # Of several kinds for a place, the most confident one; then the first by name.
    one = new.groupBy("_id", "_row", "start", "end").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "kind")).alias("k"))
    added = one.groupBy(F.col("_id").alias("_d"), F.col("_row").alias("_h")).agg(F.array_sort(F.collect_list(F.struct(F.col("k.kind").alias("kind"), "start", "end"))).alias("added"))
    out = rows.join(added, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_row") == F.col("_h")), "left")
    return out.select(F.col("_id").alias(id_col), F.col("_base").alias("base"), F.coalesce("added", F.array().cast(SPANS)).alias("added"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` by kind as listed, then start, comma-joined."""
    keyed = F.transform(spans, lambda s: F.struct(F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
