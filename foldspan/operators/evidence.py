"""Evidence pipeline over search hits of many projects: match, score, tier, report, summarise, budget."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from foldspan.functions.text import blank, clean_text, safe_join

#: Score of a source, and domains that are trusted.
SOURCE_SCORES = {"PubMed": 0.95, "EuropePMC": 0.90, "OpenAlex": 0.80, "WebSearch": 0.45, "LocalPDF": 0.90}
OTHER_SOURCE = 0.5
TRUSTED = (
    "nature.com", "sciencedirect.com", "elsevier.com", "acs.org", "wiley.com", "pnas.org",
    "science.org", "biorxiv.org", "chemrxiv.org", "nih.gov", "ncbi.nlm.nih.gov", "europepmc.org",
)


def build_query(family: Column, seeds: Column, reactions: Column, keywords: Column, targets: Column) -> Column:
    return safe_join(F.array(family, safe_join(seeds), reactions, safe_join(keywords), safe_join(targets)))


def build_relaxed_query(family: Column, seeds: Column, keywords: Column) -> Column:
    return safe_join(F.array(family, safe_join(seeds), safe_join(keywords)))


def source_filter(hits: DataFrame, projects: DataFrame, n: int = 20, order: str = "rank") -> DataFrame:
    """Hits of the sources that their project asks for, the first n of each project and source."""
    wanted = projects.select("project_id", F.explode("sources").alias("source"))
    place = Window.partitionBy("project_id", "source").orderBy(order, "id")
    return hits.join(wanted, ["project_id", "source"], "left_semi").withColumn("__n", F.row_number().over(place)).filter(F.col("__n") <= n).drop("__n")


def union_hits(first: DataFrame, *more: DataFrame) -> DataFrame:
    for df in more:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def relaxed_fallback(primary: DataFrame, relaxed: DataFrame, projects: DataFrame, proteins: DataFrame | None = None) -> DataFrame:
    """Primary hits, and relaxed ones of projects without any primary hit, and without a protein hit where these are given,
    whose relaxed query is not blank and differs."""
    usable = projects.filter((F.trim("relaxed_query") != "") & (F.col("relaxed_query") != F.col("query"))).select("project_id")
    served = primary.select("project_id") if proteins is None else primary.select("project_id").union(proteins.select("project_id"))
    extra = relaxed.join(usable, "project_id", "left_semi").join(served.distinct(), "project_id", "left_anti")
    return primary.unionByName(extra, allowMissingColumns=True)


def attach_fulltext(hits: DataFrame, fulltexts: DataFrame) -> DataFrame:
    """Adds fulltext_excerpt (from pmcid, excerpt) to open-access hits with a pmcid; '' for others."""
    texts = fulltexts.select(F.col("pmcid").alias("__pmcid"), "excerpt")
    found = hits.join(texts, (F.col("pmcid") == F.col("__pmcid")) & F.col("is_open_access") & (F.col("pmcid") != ""), "left")
    return found.withColumn("fulltext_excerpt", blank("excerpt")).drop("__pmcid", "excerpt")


def match_targets(hits: DataFrame) -> DataFrame:
    """Adds is_biorxiv, is_nature, is_sciencedirect and their labels, joined by '; '."""
    text = F.lower(F.concat_ws(" ", *(blank(c) for c in ("title", "journal", "host_venue", "url", "fulltext_url"))))
    flags = {"is_biorxiv": text.contains("biorxiv"), "is_nature": text.contains("nature"), "is_sciencedirect": text.contains("sciencedirect") | text.contains("elsevier")}
    labels = F.array_compact(F.array(*(F.when(F.col(c), F.lit(n)) for c, n in (("is_biorxiv", "bioRxiv"), ("is_nature", "Nature"), ("is_sciencedirect", "ScienceDirect")))))
    return hits.withColumns(flags).withColumn("target_matches", F.array_join(labels, "; "))


def host(url: Column) -> Column:
    """Network place of a url, user and port included; '' if it has none."""
    return F.regexp_extract(F.lower(url), "^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)


def quality_score(hits: DataFrame) -> DataFrame:
    """Adds quality_score, 0 to 1: source, trusted host, open access, missing text and missing url; what is only white space
    is missing."""
    base = F.lit(OTHER_SOURCE)
    for source, score in SOURCE_SCORES.items():
        base = F.when(F.col("source") == source, F.lit(score)).otherwise(base)
    bare = lambda c: F.regexp_replace(blank(c), "(?U)^\\s+|\\s+$", "")
    url = F.coalesce(F.nullif(bare("url"), F.lit("")), bare("fulltext_url"))
    trusted = host(url).rlike("|".join(map(re.escape, TRUSTED)))
    excerpt = bare("fulltext_excerpt") if "fulltext_excerpt" in hits.columns else F.lit("")
    part = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    score = base + part(trusted, 0.25) + part(F.coalesce("is_open_access", F.lit(False)), 0.05) - part((bare("abstract") == "") & (excerpt == ""), 0.15) - part(url == "", 0.10)
    return hits.withColumn("quality_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def quality_tier(score: Column) -> Column:
    return F.when(score >= 0.75, "high").when(score >= 0.5, "medium").otherwise("low")


def rank_hits(hits: DataFrame, within: str | None = None) -> DataFrame:
    """Best scores first, ties by source and id; a rank column if a partition column is given."""
    order = (F.desc("quality_score"), "source", "id")
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(within).orderBy(*order))) if within else hits.orderBy(*order)


def annotated(hits: DataFrame) -> DataFrame:
    """Matches, score and tier in one projection."""
    return quality_score(match_targets(hits)).withColumn("quality_tier", quality_tier(F.col("quality_score")))


def source_report(hits: DataFrame, projects: DataFrame) -> DataFrame:
    """(project_id, metric, value): nine counts of annotated hits, zeros for projects without hits; one shuffle."""
    count = {
        "total_literature_hits": F.lit(True), "biorxiv_hits": F.col("is_biorxiv"), "nature_hits": F.col("is_nature"), "sciencedirect_hits": F.col("is_sciencedirect"),
        "open_access_hits": F.col("is_open_access"), "local_pdf_hits": F.col("source") == "LocalPDF",
        **{f"{t}_quality_hits": F.col("quality_tier") == t for t in ("high", "medium", "low")},
    }
    wide = hits.groupBy("project_id").agg(*(F.count_if(c).alias(n) for n, c in count.items()))
    whole = projects.select("project_id").distinct().join(wide, "project_id", "left").na.fill(0)
    return whole.unpivot(["project_id"], list(count), "metric", "value")


def evidence_summary(literature: DataFrame, proteins: DataFrame, n: int = 20) -> DataFrame:
    """The n best literature rows and first n protein rows of each project, in one shape. Both need enzyme and enzyme_class."""
    cut = lambda df, *order: df.withColumn("__n", F.row_number().over(Window.partitionBy("project_id").orderBy(*order))).filter(F.col("__n") <= n)
    excerpt = blank("fulltext_excerpt") if "fulltext_excerpt" in literature.columns else F.lit("")
    shape = lambda df, topic, finding, evidence, confidence, tier, url: df.select("project_id", "enzyme_class", "enzyme", "source", topic.alias("topic"), finding.alias("finding"), evidence.alias("evidence"), confidence.alias("confidence"), tier.alias("quality_tier"), url.alias("url"))
    first = shape(
        cut(literature, F.desc("quality_score"), "source", "id"),
        F.when(F.col("source") == "WebSearch", "web_evidence").otherwise("literature_evidence"),
        blank("title"),
        F.when(blank("abstract") != "", F.col("abstract")).otherwise(excerpt),
        F.col("quality_score"),
        F.col("quality_tier"),
        F.when(blank("url") != "", F.col("url")).otherwise(blank("fulltext_url")),
    )
    second = shape(cut(proteins, "source", "id"), F.lit("protein_database_evidence"), blank("title"), blank("summary"), F.lit(0.7), F.lit("high"), blank("url"))
    return first.unionByName(second)


def min_quality(hits: DataFrame, least: float = 0.35) -> DataFrame:
    return hits.filter(F.col("quality_score") >= least)


def bounded_records(df: DataFrame, projects: DataFrame, n: int, order: list) -> DataFrame:
    """(project_id, records): the first n rows of each project as a JSON array, NaN as null; '[]' without rows."""
    names = [c for c in df.columns if c != "project_id"]
    value = {f.name: F.nanvl(F.col(f.name), F.lit(None).cast("double")) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema}
    kept = df.withColumn("__n", F.row_number().over(Window.partitionBy("project_id").orderBy(*order))).filter(F.col("__n") <= n)
    rows = kept.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("__n", F.struct(*(value[c].alias(c) for c in names)).alias("r")))).alias("rows"))
    text = rows.select("project_id", F.to_json(F.transform("rows", lambda x: x["r"]), {"ignoreNullFields": "false"}).alias("records"))
    return projects.select("project_id").distinct().join(text, "project_id", "left").select("project_id", F.coalesce("records", F.lit("[]")).alias("records"))


def source_debug(log: DataFrame, hits: DataFrame) -> DataFrame:
    """(project_id, source, query_mode, query, rows, error) from the fetch log, zero rows included."""
    keys = ["project_id", "source", "query_mode"]
    counted = hits.groupBy(*keys).agg(F.count("*").alias("rows"))
    return log.join(counted, keys, "left").select(*keys, "query", F.coalesce("rows", F.lit(0)).alias("rows"), blank("error").alias("error"))


def text_budget(docs: DataFrame, max_files: int = 20, per_file: int = 8000, total: int = 50_000) -> DataFrame:
    """Local documents (project_id, name, text) within a running budget of characters, in name order.

    White space is collapsed first. The first max_files documents of a project count; blank ones are errors and use nothing; each is cut to per_file and
    the running sum to total; an excerpt that the budget cuts on white space frees one character for the next document.
    Returns (project_id, name, excerpt, abstract, status) with status used, error or skipped.
    """
    place = Window.partitionBy("project_id").orderBy("name")
    rows = docs.withColumn("n", F.row_number().over(place)).filter(F.col("n") <= max_files)
    rows = rows.withColumn("piece", F.rtrim(clean_text("text", per_file)))
    full = rows.filter(F.col("piece") != "")
    before = F.coalesce(F.sum(F.length("piece")).over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    full = full.withColumn("room", F.greatest(F.lit(0), F.lit(total) - before)).withColumn("cut", F.rtrim(F.left("piece", F.col("room").cast("int"))))
    short = (F.length("piece") > F.col("room")) & (F.length("cut") == F.col("room") - 1)
    full = full.withColumn("freed", F.coalesce(F.lag(short).over(place), F.lit(False)))
    full = full.withColumn("excerpt", F.when(F.col("freed"), F.left("piece", F.lit(1))).otherwise(F.col("cut")))
    full = full.withColumn("status", F.when(F.col("excerpt") != "", "used").otherwise("skipped"))
    empty = rows.filter(F.col("piece") == "").withColumns({"excerpt": F.lit(""), "status": F.lit("error")})
    out = ["project_id", "name", "excerpt", F.left("excerpt", F.lit(1200)).alias("abstract"), "status"]
    return full.select(*out).unionByName(empty.select(*out))


def doc_context(budgeted: DataFrame) -> DataFrame:
    """(project_id, context, n_found, n_used, n_errors): '[LocalPDF: name]' blocks of used documents, in name order."""
    block = F.struct("name", F.concat(F.lit("[LocalPDF: "), "name", F.lit("]\n"), "excerpt").alias("text"))
    used = F.filter(F.array_sort(F.collect_list(F.when(F.col("status") == "used", block))), lambda x: x.isNotNull())
    return budgeted.groupBy("project_id").agg(
        F.array_join(F.transform(used, lambda x: x["text"]), "\n\n").alias("context"),
        F.count("*").alias("n_found"), F.count_if(F.col("status") == "used").alias("n_used"), F.count_if(F.col("status") == "error").alias("n_errors"),
    )


def external_hits(web: DataFrame, local: DataFrame) -> DataFrame:
    """Web hits and local documents, blank sources as LocalDocument, the first row of each key in input order.
    The key is whichever of source, id, title, url and fulltext_url the union has; both inputs need project_id and pos."""
    rows = web.filter(F.col("source") == "WebSearch").withColumn("__side", F.lit(0)).unionByName(local.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    rows = rows.withColumn("source", F.when(F.trim(blank("source")) == "", "LocalDocument").otherwise(F.col("source")))
    keys = ["project_id", *(c for c in ("source", "id", "title", "url", "fulltext_url") if c in rows.columns)]
    first = Window.partitionBy(*keys).orderBy("__side", "pos")
    return rows.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n", "__side")
