"""What a clip's reference says, whichever of its places says it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.intervals import pair

WINDOW = "struct<moment_id:string,role:string,start_sec:double,end_sec:double,description:string>"
FIELDS = ("existence", "category", "severity", "hard_normal", "anomaly_interval_sec", "precursor_interval_sec", "earliest_alert_sec", "counterfactual_type")


def target(structured: Column, label: Column, temporal: Column, counterfactual_type: Column) -> Column:
    """The target of a record (``FIELDS``): its own, whole, or what its label, its times and its counterfactual make of it."""
    made = {
        "existence": F.when(F.coalesce(label["is_anomaly"], F.lit(False)), "anomaly").otherwise("normal"), **{k: label[k] for k in ("category", "severity", "hard_normal")},
        **{k: temporal[k] for k in ("anomaly_interval_sec", "precursor_interval_sec", "earliest_alert_sec")}, "counterfactual_type": F.coalesce(counterfactual_type, F.lit("none")),
    }
    pick = lambda k: F.when(structured.isNotNull(), structured[k]).otherwise(made[k])
    return F.struct(*[pick(k).alias(k) for k in FIELDS])


def windows(oracle: Column, of_target: Column) -> Column:
    """Evidence windows (``WINDOW``, in order, starts before ends) of the tools' list; if it holds none that is whole, of the target's.

    Entries have ``moment_id, role, description, window, window_sec``: the first list looks at ``window`` first, the second at
    ``window_sec``, and an empty one counts as missing. What isn't two numbers is left out.
    """

    def clean(entries: Column, first: str, second: str) -> Column:
        span = lambda e: pair(F.when(F.size(e[first]) > 0, e[first]).otherwise(e[second]))
        held = F.filter(F.transform(entries, lambda e: F.struct(e.alias("e"), span(e).alias("s"))), lambda x: x["s"].isNotNull())
        one = lambda x: F.struct(x["e"]["moment_id"].alias("moment_id"), F.lower(F.coalesce(x["e"]["role"], F.lit(""))).alias("role"), x["s"]["start"].alias("start_sec"), x["s"]["end"].alias("end_sec"), x["e"]["description"].alias("description"))
        return F.transform(held, one)

    tools = clean(oracle, "window", "window_sec")
    return F.when(F.size(tools) > 0, tools).otherwise(F.coalesce(clean(of_target, "window_sec", "window"), F.array().cast(f"array<{WINDOW}>")))
