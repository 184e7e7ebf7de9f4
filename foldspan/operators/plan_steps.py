"""Plan tables: a JSON array out of free text, and its step table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspan.functions.text import blank
from foldspan.schemas import PLAN_STEP


def extract_json_array(text: Column) -> Column:
    """Objects of the JSON array that the whole text is, or else of its widest [..] span; as JSON texts. Other items go;
    nothing to parse gives an empty array."""
    raw = F.trim(blank(text))
    parse = lambda t: F.from_json(t, "array<string>")
    whole = F.when(raw.startswith("["), parse(raw))
    span = parse(F.nullif(F.regexp_extract(raw, "(?s)\\[.*\\]", 0), F.lit("")))
    items = F.coalesce(whole, span, F.array().cast("array<string>"))
    return F.filter(items, lambda x: x.startswith("{"))


def plan_steps(plans: DataFrame, key: str = "plan_id", text: str = "text") -> DataFrame:
    """One row a step: index, name, tools joined by ', ', description, rationale and a preview of its code."""
    steps = plans.select(key, F.explode(extract_json_array(F.col(text))).alias("item")).withColumn("s", F.from_json("item", PLAN_STEP))
    tools = F.from_json("s.tools_from_registry", "array<string>")
    listed = F.array_join(F.filter(F.transform(tools, lambda x: F.trim(x)), lambda x: x != ""), ", ")
    code = F.translate(F.trim(blank("s.python_code_to_execute")), "\n", " ")
    return steps.select(
        key, F.col("s.step_index").alias("step_index"), F.trim(blank("s.step_name")).alias("step_name"),
        F.when(F.col("s.tools_from_registry").startswith("["), listed).otherwise(blank("s.tools_from_registry")).alias("tools"),
        F.trim(blank("s.description")).alias("description"), F.trim(blank("s.rationale")).alias("rationale"),
        F.when(F.length(code) > 140, F.concat(F.left(code, F.lit(140)), F.lit("..."))).otherwise(code).alias("python_code_preview"),
    ).orderBy(key, "step_index")


def plan_json(steps: DataFrame, key: str = "plan_id") -> DataFrame:
    """(plan_id, plan): the steps of each plan as a JSON array in step order."""
    names = [c for c in steps.columns if c != key]
    rows = F.array_sort(F.collect_list(F.struct("step_index", F.struct(*names).alias("r"))))
    return steps.groupBy(key).agg(F.to_json(F.transform(rows, lambda x: x["r"])).alias("plan"))
