"""What a model's answer says of an item, with the limits that hold for it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text

BRIEF = "homework BOOLEAN, skip_reason STRING, summary STRING, steps STRING, estimate_min STRING"


def validated(answer: Column) -> dict[str, Column]:
    """An answer's fields with their limits; valid needs a summary and a verdict."""
    j = F.from_json(text.unfence(answer), BRIEF)
    listed = F.when(j["steps"].startswith("["), F.from_json(j["steps"], "ARRAY<STRING>")).when(j["steps"].isNotNull(), F.array(j["steps"]))
    steps = F.slice(F.transform(F.filter(listed, lambda s: F.trim(s) != ""), lambda s: text.clip_bytes(F.trim(s), 300)), 1, 3)
    minutes = F.floor(F.try_to_number(j["estimate_min"], F.lit("99999.99")) + F.lit(0.5)).cast("int")
    summary = text.clip_bytes(F.trim(j["summary"]), 1000)
    return {
        "homework": j["homework"], "skip_reason": F.when(~j["homework"], j["skip_reason"]), "summary": summary, "steps": F.array_join(steps, "; "),
        "estimate_min": F.when(minutes.between(1, 10080), minutes), "valid": (F.coalesce(summary, F.lit("")) != "") & j["homework"].isNotNull(),
    }


def verdicts(answer: Column) -> Column:
    """An answer's verdicts as an array of (id, same); null where it has none that can be read."""
    return F.from_json(text.unfence(answer), "verdicts ARRAY<STRUCT<id: STRING, same: BOOLEAN>>")["verdicts"]
