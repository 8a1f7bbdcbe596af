"""Packages for a second judge: four views of an episode's evidence, why a case is hard, what the judge sees, and batch annotation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Views in the order in which they take images, and images in all.
VIEWS = ("full", "keep", "drop", "alert_prefix")
MAX_IMAGES = 12


def views(ledger: Column, selected: Column, alert_sec: Column) -> dict[str, Column]:
    """Views of a ledger (``array<struct<window_id, start_sec, ...>>``). Without an alert time the prefix is the whole."""
    inside = lambda w: F.array_contains(selected, w["window_id"])
    return {"full": ledger, "keep": F.filter(ledger, inside), "drop": F.filter(ledger, lambda w: ~inside(w)), "alert_prefix": F.when(alert_sec.isNull(), ledger).otherwise(F.filter(ledger, lambda w: w["start_sec"] <= alert_sec))}


def hard_reasons(v: dict[str, Column], policy: Column, sufficiency: Column, necessity: Column) -> Column:
    """Why a case deserves images: an odd selection, a doubtful decision, or close scores."""
    reasons = F.array(
        F.when(F.size(v["keep"]) == 0, "nothing selected"), F.when(F.size(v["drop"]) == 0, "everything selected"), F.when(policy.isin("misaligned", "redundant"), "doubtful decision"),
        F.when(F.abs(sufficiency - necessity) < 0.1, "close scores"), F.when(F.size(v["alert_prefix"]) == 0, "no evidence before the alert"),
    )
    return F.filter(reasons, lambda r: r.isNotNull())


def input_mode(wanted: Column, reasons: Column, has_images: Column) -> Column:
    """``text_only`` or ``multimodal``; ``auto`` takes images for hard cases that have some."""
    return F.when(wanted != "auto", wanted).when((F.size(reasons) > 0) & has_images, "multimodal").otherwise("text_only")


def capped_images(counts: Sequence[Column], most: int = MAX_IMAGES) -> list[Column]:
    """How many images each view may show when views take them in order."""
    out, used = [], F.lit(0)
    for c in counts:
        take = F.least(c, F.greatest(F.lit(most) - used, F.lit(0)))
        out.append(take)
        used = used + take
    return out


def annotate(df: DataFrame, candidate: Column, prompt: Column, judge: Callable[[list[str]], list[str]], label: str = "judgement") -> DataFrame:
    """Add ``label``: the judge's text for candidates without one; other rows keep theirs. Rows are judged where they are, so repeated ones stay as many.

    The judge sees the candidates of an Arrow batch. A batch that fails is tried row by row, and a row that fails gets null.
    """

    def asked(prompts: list[str]) -> list[str | None]:
        try:
            said = judge(prompts) if prompts else []
            if len(said) == len(prompts):
                return list(said)
        except Exception:  # noqa: BLE001
            pass
        out: list[str | None] = []
        for p in prompts:
            try:
                out.append(judge([p])[0])
            except Exception:  # noqa: BLE001
                out.append(None)
        return out

    @F.pandas_udf("string")
    def say(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for todo, prompts in batches:
            out = pd.Series([None] * len(prompts), dtype=object)
            chosen = todo.fillna(False).to_numpy(bool)
            out[chosen] = asked(prompts[chosen].tolist())
            yield out

    said = say.asNondeterministic()(candidate & F.col(label).isNull(), prompt)  # so that the optimizer asks once
    return df.withColumn("_said", said).withColumn(label, F.coalesce(label, "_said")).drop("_said")
