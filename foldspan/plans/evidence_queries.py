"""Queries of the evidence operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldspan.functions import text as X
from foldspan.operators import evidence as L
from foldspan.plans.views import duck, view

#: All white space, for RE2.
WHITE = "[\\s\\x0b\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
_HIT = ["project_id", "source", "id"]


def _scored(s, d):
    return L.annotated(view(s, d, "hits"))


_TEXT = "lower(title || ' ' || journal || ' ' || host_venue || ' ' || url || ' ' || fulltext_url)"
_FLAGS = f"SELECT *, contains({_TEXT}, 'biorxiv') AS is_biorxiv, contains({_TEXT}, 'nature') AS is_nature, contains({_TEXT}, 'sciencedirect') OR contains({_TEXT}, 'elsevier') AS is_sciencedirect FROM hits"
_HOSTS = "|".join(t.replace(".", "\\.") for t in L.TRUSTED)
_BARE = {c: f"regexp_replace({c}, '^{WHITE}|{WHITE}$', '', 'g')" for c in ("abstract", "url", "fulltext_url")}
_CHOSEN = f"coalesce(nullif({_BARE['url']}, ''), {_BARE['fulltext_url']})"
_SCORE = (
    "greatest(0::DOUBLE, least(1::DOUBLE, CASE source WHEN 'PubMed' THEN 0.95::DOUBLE WHEN 'EuropePMC' THEN 0.9::DOUBLE WHEN 'OpenAlex' THEN 0.8::DOUBLE WHEN 'WebSearch' THEN 0.45::DOUBLE WHEN 'LocalPDF' THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END"
    f" + CASE WHEN regexp_matches(regexp_extract(lower({_CHOSEN}), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '{_HOSTS}') THEN 0.25::DOUBLE ELSE 0::DOUBLE END"
    f" + CASE WHEN is_open_access THEN 0.05::DOUBLE ELSE 0::DOUBLE END - CASE WHEN {_BARE['abstract']} = '' THEN 0.15::DOUBLE ELSE 0::DOUBLE END"
    f" - CASE WHEN {_CHOSEN} = '' THEN 0.1::DOUBLE ELSE 0::DOUBLE END))"
)
_TIERED = f"scored AS (SELECT *, CASE WHEN quality_score >= 0.75::DOUBLE THEN 'high' WHEN quality_score >= 0.5::DOUBLE THEN 'medium' ELSE 'low' END AS quality_tier FROM (SELECT *, {_SCORE} AS quality_score FROM ({_FLAGS})))"
_BUDGET = f"""budget AS (SELECT project_id, name, row_number() OVER (PARTITION BY project_id ORDER BY name) AS n, rtrim(left(trim(regexp_replace(text, '{WHITE}', ' ', 'g')), 8000)) AS piece FROM localdocs),
first AS (SELECT project_id, name, piece, row_number() OVER (PARTITION BY project_id ORDER BY name) AS k FROM budget WHERE n <= 20 AND piece <> ''),
loop AS (SELECT project_id, 0 AS k, 0 AS used, '' AS name, '' AS excerpt FROM (SELECT DISTINCT project_id FROM first)
    UNION ALL SELECT f.project_id, f.k, l.used + length(rtrim(left(f.piece, 50000 - l.used))), f.name, rtrim(left(f.piece, 50000 - l.used)) FROM loop l JOIN first f ON f.project_id = l.project_id AND f.k = l.k + 1),
budgeted AS (SELECT project_id, name, excerpt, left(excerpt, 1200) AS abstract, CASE WHEN excerpt <> '' THEN 'used' ELSE 'skipped' END AS status FROM loop WHERE k > 0
    UNION ALL SELECT project_id, name, '', '', 'error' FROM budget WHERE n <= 20 AND piece = '')"""


def _request(s, d):
    fields = {"family": X.default_text("p_brand"), "seeds": X.default_text(X.safe_join(F.split("p_name", " "), "; ")), "note": X.default_text(F.when(F.col("p_size") > 25, F.col("p_type")))}
    return view(s, d, "part").select("p_partkey", X.render("Family: {family}\nSeeds: {seeds}\nNote: {note}", fields).alias("request"))


def _records(s, d):
    return L.bounded_records(view(s, d, "hits").select("project_id", "source", "id", "year"), view(s, d, "projects"), 250, ["source", "id"])


def _summary(s, d):
    names = lambda df: df.withColumns({"enzyme_class": F.lit("class"), "enzyme": F.concat(F.lit("enzyme "), F.col("project_id").cast("string"))})
    return L.evidence_summary(names(_scored(s, d)), names(view(s, d, "proteins")))


QUERIES = {
    "L1_clean_text": (lambda s, d: view(s, d, "documents").select("doc_id", X.clean_text("text").alias("text")), f"SELECT doc_id, left(trim(regexp_replace(text, '{WHITE}', ' ', 'g')), 6000) AS text FROM documents"),
    "L2_compact_text": (
        lambda s, d: view(s, d, "documents").select("doc_id", X.compact_text("text").alias("text")),
        f"SELECT doc_id, CASE WHEN length(t) > 1000 THEN left(t, 997) || '...' ELSE t END AS text FROM (SELECT doc_id, trim(regexp_replace(text, '{WHITE}', ' ', 'g')) AS t FROM documents)",
    ),
    "L3_safe_join": (
        lambda s, d: view(s, d, "documents").select("doc_id", X.safe_join(F.array("lang", F.lit("  "), F.concat(F.lit(" "), "source"), F.lit(None)), "; ").alias("joined")),
        "SELECT doc_id, lang || '; ' || source AS joined FROM documents",
    ),
    "L4_build_query": (
        lambda s, d: view(s, d, "part").select("p_partkey", L.build_query(F.col("p_brand"), F.split("p_name", " "), F.col("p_type"), F.array(F.lit(" ")), F.array(F.lit("target"))).alias("query")),
        "SELECT p_partkey, p_brand || ' ' || trim(regexp_replace(p_name, ' +', ' ', 'g')) || ' ' || p_type || ' target' AS query FROM part",
    ),
    "L5_build_relaxed_query": (
        lambda s, d: view(s, d, "part").select("p_partkey", L.build_relaxed_query(F.col("p_brand"), F.split("p_name", " "), F.array(F.lit("stable"))).alias("query")),
        "SELECT p_partkey, p_brand || ' ' || trim(regexp_replace(p_name, ' +', ' ', 'g')) || ' stable' AS query FROM part",
    ),
    "L6_source_filter": (
        lambda s, d: L.source_filter(view(s, d, "hits"), view(s, d, "asked").groupBy("project_id").agg(F.collect_list("source").alias("sources"))).select(*_HIT),
        "SELECT project_id, source, id FROM (SELECT h.*, row_number() OVER (PARTITION BY h.project_id, h.source ORDER BY h.rank, h.id) AS n FROM hits h SEMI JOIN asked a ON a.project_id = h.project_id AND a.source = h.source) WHERE n <= 20",
    ),
    "L7_union_hits": (
        lambda s, d: L.union_hits(view(s, d, "hits").select(*_HIT, "year"), view(s, d, "proteins").select(*_HIT, "organism")),
        "SELECT project_id, source, id, year, NULL AS organism FROM hits UNION ALL SELECT project_id, source, id, NULL, organism FROM proteins",
    ),
    "L8_relaxed_fallback": (
        lambda s, d: L.relaxed_fallback(view(s, d, "hits").filter("project_id % 7 < 4").select(*_HIT), view(s, d, "hits").select(*_HIT), view(s, d, "projects"), view(s, d, "proteins").filter("project_id % 7 = 4")),
        "SELECT project_id, source, id FROM hits WHERE project_id % 7 < 4 OR project_id % 7 = 5",
    ),
    "L9_attach_fulltext": (
        lambda s, d: L.attach_fulltext(view(s, d, "hits"), view(s, d, "fulltexts")).select(*_HIT, "fulltext_excerpt"),
        "SELECT project_id, source, id, coalesce(excerpt, '') AS fulltext_excerpt FROM hits h LEFT JOIN fulltexts f ON f.pmcid = h.pmcid AND h.is_open_access AND h.pmcid <> ''",
    ),
    "L10_match_targets": (
        lambda s, d: L.match_targets(view(s, d, "hits")).select(*_HIT, "is_biorxiv", "is_nature", "is_sciencedirect", "target_matches"),
        f"SELECT project_id, source, id, is_biorxiv, is_nature, is_sciencedirect, array_to_string(list_filter([CASE WHEN is_biorxiv THEN 'bioRxiv' END, CASE WHEN is_nature THEN 'Nature' END, CASE WHEN is_sciencedirect THEN 'ScienceDirect' END], lambda x: x IS NOT NULL), '; ') AS target_matches FROM ({_FLAGS})",
    ),
    "L11_quality_score": (lambda s, d: _scored(s, d).select(*_HIT, "quality_score"), f"WITH {_TIERED} SELECT project_id, source, id, quality_score FROM scored"),
    "L12_quality_tier": (lambda s, d: _scored(s, d).select(*_HIT, "quality_tier"), f"WITH {_TIERED} SELECT project_id, source, id, quality_tier FROM scored"),
    "L13_rank_hits": (
        lambda s, d: L.rank_hits(_scored(s, d).drop("rank"), "project_id").select(*_HIT, "rank"),
        f"WITH {_TIERED} SELECT project_id, source, id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY quality_score DESC, source, id) AS INT) AS rank FROM scored",
    ),
    "L14_source_report": (
        lambda s, d: L.source_report(_scored(s, d), view(s, d, "projects")),
        f"WITH {_TIERED}, wide AS (SELECT project_id, count(*) AS total_literature_hits, count(*) FILTER (is_biorxiv) AS biorxiv_hits, count(*) FILTER (is_nature) AS nature_hits, count(*) FILTER (is_sciencedirect) AS sciencedirect_hits, count(*) FILTER (is_open_access) AS open_access_hits, count(*) FILTER (source = 'LocalPDF') AS local_pdf_hits, count(*) FILTER (quality_tier = 'high') AS high_quality_hits, count(*) FILTER (quality_tier = 'medium') AS medium_quality_hits, count(*) FILTER (quality_tier = 'low') AS low_quality_hits FROM scored GROUP BY project_id) UNPIVOT wide ON COLUMNS(* EXCLUDE project_id) INTO NAME metric VALUE value",
    ),
    "L15_evidence_summary": (
        _summary,
        f"WITH {_TIERED} SELECT project_id, 'class' AS enzyme_class, 'enzyme ' || project_id AS enzyme, source, CASE WHEN source = 'WebSearch' THEN 'web_evidence' ELSE 'literature_evidence' END AS topic, title AS finding, abstract AS evidence, quality_score AS confidence, quality_tier, CASE WHEN url <> '' THEN url ELSE fulltext_url END AS url FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY quality_score DESC, source, id) AS n FROM scored) WHERE n <= 20"
        " UNION ALL SELECT project_id, 'class', 'enzyme ' || project_id, source, 'protein_database_evidence', title, summary, 0.7::DOUBLE, 'high', url FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY source, id) AS n FROM proteins) WHERE n <= 20",
    ),
    "L16_min_quality": (lambda s, d: L.min_quality(_scored(s, d)).select(*_HIT, "quality_score"), f"WITH {_TIERED} SELECT project_id, source, id, quality_score FROM scored WHERE quality_score >= 0.35::DOUBLE"),
    "L17_bounded_records": (
        _records,
        "SELECT project_id, coalesce(r, '[]') AS records FROM projects LEFT JOIN (SELECT project_id, '[' || string_agg('{\"source\":\"' || source || '\",\"id\":\"' || id || '\",\"year\":' || year || '}', ',' ORDER BY n) || ']' AS r FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY source, id) AS n FROM hits) WHERE n <= 250 GROUP BY project_id) USING (project_id)",
    ),
    "L18_source_debug": (
        lambda s, d: L.source_debug(view(s, d, "SELECT project_id, source, 'full' AS query_mode, query, CAST(NULL AS STRING) AS error FROM projects JOIN asked USING (project_id)"), view(s, d, "SELECT *, 'full' AS query_mode FROM hits WHERE source <> 'OpenAlex'")),
        "SELECT project_id, source, 'full' AS query_mode, query, coalesce(rows, 0) AS rows, '' AS error FROM projects JOIN asked USING (project_id) LEFT JOIN (SELECT project_id, source, count(*) AS rows FROM hits WHERE source <> 'OpenAlex' GROUP BY ALL) USING (project_id, source)",
    ),
    "L19_text_budget": (lambda s, d: L.text_budget(view(s, d, "localdocs")), f"WITH RECURSIVE {_BUDGET} SELECT * FROM budgeted"),
    "L20_doc_context": (
        lambda s, d: L.doc_context(L.text_budget(view(s, d, "localdocs"))),
        f"WITH RECURSIVE {_BUDGET} SELECT project_id, coalesce(string_agg('[LocalPDF: ' || name || ']' || chr(10) || excerpt, chr(10) || chr(10) ORDER BY name) FILTER (status = 'used'), '') AS context, count(*) AS n_found, count(*) FILTER (status = 'used') AS n_used, count(*) FILTER (status = 'error') AS n_errors FROM budgeted GROUP BY project_id",
    ),
    "L21_render_request": (
        _request,
        "SELECT p_partkey, 'Family: ' || p_brand || chr(10) || 'Seeds: ' || replace(trim(regexp_replace(p_name, ' +', ' ', 'g')), ' ', '; ') || chr(10) || 'Note: ' || CASE WHEN p_size > 25 THEN p_type ELSE 'None provided' END AS request FROM part",
    ),
    "K2_external_hits": (
        lambda s, d: L.external_hits(view(s, d, "SELECT project_id, source, title AS id, title, url, fulltext_url, rank AS pos FROM hits"), view(s, d, "SELECT project_id, CASE WHEN project_id = 3 THEN ' ' ELSE 'LocalPDF' END AS source, name AS id, name AS title, rank() OVER (PARTITION BY project_id ORDER BY name) AS pos FROM localdocs")).select(*_HIT, "url"),
        "SELECT project_id, source, id, url FROM (SELECT *, row_number() OVER (PARTITION BY project_id, source, id, title, url, fulltext_url ORDER BY pos) AS n FROM (SELECT project_id, source, title AS id, title, url, fulltext_url, rank AS pos FROM hits WHERE source = 'WebSearch')) WHERE n = 1 UNION ALL SELECT project_id, CASE WHEN project_id = 3 THEN 'LocalDocument' ELSE 'LocalPDF' END, name, NULL FROM localdocs",
    ),
}


def queries():
    return {n: q for n, (q, _) in QUERIES.items()}


def oracle_sql():
    return {n: duck(sql) for n, (_, sql) in QUERIES.items() if sql}
