"""Pocket profiling: long-form metrics, quantile tags, residue signatures, profiles and extremes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspan.operators.ranks import placed
from foldspan.schemas import require_columns
from foldspan.sources.scratch import stored

_LEFT_OUT = re.compile(r"(?i)unnamed.*|_c\d+|struct_name.*|enzyme|ord")


def number(c: Column) -> Column:
    """Text or number as a finite or null double: NaN counts as missing."""
    value = c.cast("string").try_cast("double")
    return F.when(~F.isnan(value), value)


def tick(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def detect_metrics(df: DataFrame) -> list[str]:
    """Columns with at least one number, but for names and row numbers; one aggregate over all candidates."""
    names = [c for c in df.columns if not _LEFT_OUT.fullmatch(c)]
    if not names:
        return []
    row = df.agg(*(F.count(number(tick(c))).alias(f"n{k}") for k, c in enumerate(names))).first()
    return [c for k, c in enumerate(names) if row[k]]


def melt_metrics(df: DataFrame, metrics: list[str]) -> DataFrame:
    """(struct_name, ord, metric, metric_ord, value): wide metrics in long form, what is not a number as null."""
    require_columns(df, ["struct_name", "ord"], "the pocket table")
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(k).alias("metric_ord"), number(tick(m)).alias("value")) for k, m in enumerate(metrics)))
    return df.select("struct_name", "ord", F.inline(pairs))


def metric_quantiles(long: DataFrame, low: float = 0.33, high: float = 0.67) -> DataFrame:
    """(metric, q33, q67): exact, by linear interpolation, nulls left out; a metric without values has nulls.

    Values are placed by range and counts, and the two values beside each quantile's place are picked: four rows a metric
    meet, and no task holds a metric's values."""
    known = stored(long.filter(F.col("value").isNotNull()).select("metric", "value"), "values")
    ranked = placed(known, ["metric"], ["value"])

    def picked(name: str, q: float) -> Column:
        """From the lower value a share of the way to the upper one: between equal values that is the value itself, which a sum
        of weighted values may miss by a digit, so that all rows at the bound would lose their tag."""
        at = (F.col("total") - 1) * F.lit(q)
        lower, upper = (F.max(F.when(F.col("pos") == k, F.col("value"))) for k in (F.floor(at), F.ceil(at)))
        share = F.max(at - F.floor(at))
        return (lower + (upper - lower) * share).alias(name)

    near = lambda q: (F.col("pos") - F.floor((F.col("total") - 1) * F.lit(q))).isin(0, 1)
    found = ranked.filter(near(low) | near(high)).groupBy("metric").agg(picked("q33", low), picked("q67", high))
    return long.select("metric").distinct().join(found, "metric", "left")


def quantile_tag(long: DataFrame, quantiles: DataFrame) -> DataFrame:
    """long with its tag: na, low, mid or high; at equal bounds low wins. One row for each metric is broadcast."""
    tag = F.when(F.col("value").isNull(), "na").when(F.col("value") <= F.col("q33"), "low").when(F.col("value") >= F.col("q67"), "high").otherwise("mid")
    return long.join(F.broadcast(quantiles), "metric").withColumn("tag", tag).drop("q33", "q67")


def enzyme_key(name: Column) -> Column:
    return F.split_part(name, F.lit("_"), F.lit(1))


def select_positions(alignment: DataFrame, positions: list[int] | None) -> DataFrame:
    return alignment if positions is None else alignment.filter(F.col("index").isin(positions))


def melt_alignment(wide: DataFrame) -> DataFrame:
    """(index, enzyme, res_num, res_aa, dist_center, min_dist) of a wide alignment table."""
    names = [c[: -len("_res_aa")] for c in wide.columns if c.endswith("_res_aa")]
    part = lambda e, s: tick(f"{e}_{s}") if f"{e}_{s}" in wide.columns else F.lit(None)
    rows = [
        F.struct(F.lit(e).alias("enzyme"), part(e, "res_num").cast("int").alias("res_num"), part(e, "res_aa").cast("string").alias("res_aa"), part(e, "dist_res_to_ligand_reactive_center").cast("double").alias("dist_center"), part(e, "min_dist_res_to_ligand").cast("double").alias("min_dist"))
        for e in names
    ]
    return wide.select("index", F.inline(F.array(*rows)))


def residue_signature(alignment: DataFrame, ord: str = "index") -> DataFrame:
    """(enzyme, signature): 'index:aa' in row order, joined by '; '; a missing residue is '-'."""
    text = F.concat(F.col("index").cast("string"), F.lit(":"), F.coalesce("res_aa", F.lit("-")))
    rows = F.array_sort(F.collect_list(F.struct(F.col(ord).alias("o"), text.alias("t"))))
    return alignment.groupBy("enzyme").agg(F.array_join(F.transform(rows, lambda x: x["t"]), "; ").alias("signature"))


def profile(tagged: DataFrame, signatures: DataFrame) -> DataFrame:
    """Per structure: metric count, values and tags as JSON maps, signature, and a sentence with the first five high and
    low metrics in column order."""
    rows = F.array_sort(F.collect_list(F.struct("metric_ord", "metric", "value", "tag")))
    one = tagged.groupBy("struct_name").agg(rows.alias("rows"), F.count("value").alias("n_metrics"))
    mapped = lambda field: F.map_from_entries(F.transform("rows", lambda x: F.struct(x["metric"], x[field])))
    named = lambda tag: F.array_join(F.slice(F.transform(F.filter("rows", lambda x: x["tag"] == tag), lambda x: x["metric"]), 1, 5), ", ")
    listed = lambda tag: F.coalesce(F.nullif(named(tag), F.lit("")), F.lit("none"))
    sentence = F.concat(F.lit("High: "), listed("high"), F.lit(". Low: "), listed("low"), F.lit("."))
    keyed = one.withColumn("enzyme", enzyme_key(F.col("struct_name"))).join(signatures, "enzyme", "left")
    options = {"ignoreNullFields": "false"}
    return keyed.select(
        "struct_name", "enzyme", "n_metrics", F.to_json(mapped("value"), options).alias("metric_values"), F.to_json(mapped("tag"), options).alias("metric_tags"),
        F.coalesce("signature", F.lit("n/a")).alias("signature"), sentence.alias("interpretation"),
    )


def metric_extremes(long: DataFrame) -> DataFrame:
    """(pattern, struct_name, value): 'min::m' and 'max::m' of each metric with a value; ties go to the first row."""
    known = long.filter(F.col("value").isNotNull())
    both = known.groupBy("metric").agg(F.min(F.struct("value", "ord", "struct_name")).alias("lo"), F.min(F.struct((-F.col("value")).alias("value"), "ord", "struct_name")).alias("hi"))
    low = F.struct(F.concat(F.lit("min::"), "metric").alias("pattern"), F.col("lo.struct_name").alias("struct_name"), F.col("lo.value").alias("value"))
    high = F.struct(F.concat(F.lit("max::"), "metric").alias("pattern"), F.col("hi.struct_name").alias("struct_name"), (-F.col("hi.value")).alias("value"))
    return both.select(F.inline(F.array(low, high)))


def analyse(pocket: DataFrame, alignment: DataFrame, positions: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Profiles and extremes of a wide pocket table (struct_name, ord, metrics) and a wide alignment table (index, ..)."""
    require_columns(pocket, ["struct_name"], "the pocket table")
    require_columns(alignment, ["index"], "the alignment table")
    metrics = detect_metrics(pocket)
    if not metrics:
        raise ValueError("the pocket table has no numeric metric")
    long = melt_metrics(pocket, metrics)
    signatures = residue_signature(select_positions(melt_alignment(alignment), positions))
    return profile(quantile_tag(long, metric_quantiles(long)), signatures), metric_extremes(long)


def variant_labels(long: DataFrame) -> DataFrame:
    """(variant, base, mutations): the enzymes of long by their labels. base-MUT+MUT has a set of mutations, sorted; a label
    without a hyphen has none and is its own base."""
    names = long.select(enzyme_key(F.col("struct_name")).alias("variant")).distinct()
    parts = F.filter(F.transform(F.split(F.substring_index("variant", "-", -1), "\\+"), lambda x: F.trim(x)), lambda x: x != "")
    return names.select("variant", F.substring_index("variant", "-", 1).alias("base"), F.when(F.col("variant").contains("-"), F.array_sort(F.array_distinct(parts))).otherwise(F.array().cast("array<string>")).alias("mutations"))


def nearest_ancestors(labels: DataFrame) -> DataFrame:
    """(variant, ancestor): for each variant with mutations the one at hand of the same base with the most of its mutations
    and no others; among equals the first name.

    A containment join: variants and possible ancestors meet by single mutations, and an ancestor is contained if it
    meets as often as it has mutations. The base itself, which has none, is always contained."""
    single = lambda c: labels.filter(F.size("mutations") > 0).select(F.col("variant").alias(c), "base", F.size("mutations").alias(f"{c}_size"), F.explode("mutations").alias("mutation"))
    met = single("variant").join(single("ancestor"), ["base", "mutation"]).filter(F.col("ancestor_size") < F.col("variant_size"))
    inside = met.groupBy("variant", "ancestor", "ancestor_size").agg(F.count("*").alias("n")).filter("n = ancestor_size").select("variant", "ancestor", F.col("n").alias("shared"))
    plain = labels.filter(F.size("mutations") == 0).select("base", F.col("variant").alias("ancestor"))
    bases = labels.filter(F.size("mutations") > 0).select("variant", "base").join(plain, "base").select("variant", "ancestor", F.lit(0).cast("long").alias("shared"))
    return inside.unionByName(bases).groupBy("variant").agg(F.min(F.struct((-F.col("shared")).alias("shared"), "ancestor")).alias("a")).select("variant", "a.ancestor")


def pair_deltas(long: DataFrame, pairs: DataFrame) -> DataFrame:
    """(variant, reference, metric, delta) of asked pairs (variant, reference): the difference of the enzymes' mean values on
    each metric that both have."""
    means = long.groupBy(enzyme_key(F.col("struct_name")).alias("enzyme"), "metric").agg(F.avg("value").alias("mean"))
    first = means.select(F.col("enzyme").alias("variant"), "metric", F.col("mean").alias("m"))
    second = means.select(F.col("enzyme").alias("reference"), "metric", F.col("mean").alias("r"))
    return pairs.select("variant", "reference").distinct().join(first, "variant").join(second, ["reference", "metric"]).select("variant", "reference", "metric", (F.col("m") - F.col("r")).alias("delta"))


def variant_deltas(long: DataFrame) -> DataFrame:
    """(variant, base, metric, delta): each variant against its nearest ancestor at hand."""
    pairs = nearest_ancestors(variant_labels(long)).withColumnRenamed("ancestor", "reference")
    return pair_deltas(long, pairs).withColumnRenamed("reference", "base")


def pocket_assays(long: DataFrame, assays: DataFrame) -> DataFrame:
    """Pocket metrics beside the assay values (enzyme, assay, value) of their enzyme; structures without assays stay."""
    keyed = long.withColumn("enzyme", enzyme_key(F.col("struct_name")))
    return keyed.join(assays.select("enzyme", "assay", F.col("value").alias("activity")), "enzyme", "left")


def row_order(df: DataFrame, *keys: str) -> DataFrame:
    """Adds ord, the keys that order rows of a table that comes without an order; no rank, so no row moves."""
    return df.withColumn("ord", F.struct(*keys))
