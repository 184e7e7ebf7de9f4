"""Tables of the library derived from the driver's tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: A project's number, of a row's id: seven projects in each block of 1,400 ids, so that projects grow in number, not in size.
PROJECT = "({k} % 7 + 7 * CAST(floor({k} / 1400) AS BIGINT))"
_DOC, _D, _PART = (PROJECT.format(k=k) for k in ("doc_id", "d.doc_id", "p_partkey"))

VIEWS = {
    "hits": f"""
        SELECT {_D} AS project_id, CASE d.doc_id % 6 WHEN 0 THEN 'PubMed' WHEN 1 THEN 'EuropePMC' WHEN 2 THEN 'OpenAlex' WHEN 3 THEN 'WebSearch' WHEN 4 THEN 'LocalPDF' ELSE 'Other' END AS source,
            CAST(d.doc_id AS STRING) AS id, d.source || ' report ' || CAST(d.doc_id AS STRING) AS title, d.source AS journal, CAST(2000 + d.doc_id % 25 AS INT) AS year,
            CASE WHEN d.doc_id % 5 = 0 THEN '' WHEN d.doc_id % 31 = 1 THEN ' ' ELSE d.text END AS abstract, coalesce(l.quality, 0) = 1 AS is_open_access,
            CASE WHEN d.doc_id % 11 = 0 THEN 'https://www.nature.com/' || CAST(d.doc_id AS STRING) ELSE coalesce(p.url, '') END AS fulltext_url,
            CASE WHEN d.doc_id % 3 = 0 THEN '' WHEN d.doc_id % 37 = 1 THEN '  ' ELSE coalesce(p.url, '') END AS url, CASE WHEN d.doc_id % 2 = 0 THEN 'PMC' || CAST(d.doc_id AS STRING) ELSE '' END AS pmcid,
            CASE WHEN d.doc_id % 13 = 0 THEN 'bioRxiv' ELSE d.source END AS host_venue, d.doc_id AS rank
        FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "projects": f"""
        SELECT DISTINCT {_DOC} AS project_id, 'query ' || CAST({_DOC} AS STRING) AS query,
            CASE WHEN doc_id % 7 = 6 THEN 'query ' ELSE 'wide ' END || CAST({_DOC} AS STRING) AS relaxed_query
        FROM documents""",
    "asked": f"""
        SELECT DISTINCT {_DOC} AS project_id, CASE doc_id % 6 WHEN 0 THEN 'PubMed' WHEN 3 THEN 'WebSearch' ELSE 'OpenAlex' END AS source
        FROM documents WHERE doc_id % 6 IN (0, 2, 3)""",
    "proteins": f"""
        SELECT {_PART} AS project_id, CASE p_partkey % 3 WHEN 0 THEN 'UniProt' WHEN 1 THEN 'InterPro' ELSE 'PDB' END AS source, CAST(p_partkey AS STRING) AS id,
            p_name AS title, p_brand AS organism, p_type AS summary, 'https://example.org/' || CAST(p_partkey AS STRING) AS url
        FROM part""",
    "fulltexts": "SELECT 'PMC' || CAST(page_id AS STRING) AS pmcid, html AS excerpt FROM pages",
    "localdocs": f"SELECT {_DOC} AS project_id, lpad(CAST(doc_id AS STRING), 9, '0') AS name, CASE WHEN doc_id % 17 = 0 THEN '   ' ELSE text END AS text FROM documents",
    "pocket": """
        SELECT p.p_brand || '_' || p.p_type AS struct_name, avg(l.l_quantity) AS quantity, avg(l.l_extendedprice) AS price, avg(l.l_discount) AS discount, avg(l.l_tax) AS tax, avg(p.p_size) AS size
        FROM part p JOIN lineitem l ON l.l_partkey = p.p_partkey GROUP BY p.p_brand, p.p_type""",
    "pocketlong": """
        SELECT struct_name, 0 AS metric_ord, 'quantity' AS metric, round(quantity, 6) AS value FROM pocket UNION ALL SELECT struct_name, 1, 'price', round(price, 6) FROM pocket
        UNION ALL SELECT struct_name, 2, 'discount', round(discount, 6) FROM pocket UNION ALL SELECT struct_name, 3, 'tax', round(tax, 6) FROM pocket UNION ALL SELECT struct_name, 4, 'size', round(size, 6) FROM pocket""",
    "alignment": """
        SELECT p_size AS index, p_brand AS enzyme, min(CASE WHEN p_partkey % 23 = 0 THEN '-' ELSE substring('ACDEFGHIKLMNPQRSTVWY', CAST(p_partkey % 20 AS INT) + 1, 1) END) AS res_aa
        FROM part GROUP BY p_size, p_brand""",
    "designs": """
        SELECT l_orderkey AS structure_idx, l_linenumber AS sequence_idx, max(l_partkey) AS partkey, max(CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE l_tax * 40 END) AS rmsd, max(l_quantity) AS ipae,
            max(l_discount * 15) AS binder_rmsd, max(CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE l_extendedprice / 1000 END) AS binder_plddt, max(l_extendedprice) AS score
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "messages": "SELECT conv_id AS thread, turn AS pos, role, CASE WHEN turn % 5 = 4 THEN '' ELSE text END AS content FROM conversations",
}


def needed(sql: str) -> list[str]:
    """Views that sql uses, each after those that it uses itself."""
    out: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            out += [x for x in (*needed(VIEWS[name].replace(f" AS {name}", " ")), name) if x not in out and x != name or x == name and name not in out]
    return out


def duck(sql: str) -> str:
    """sql for DuckDB with the views that it uses in front."""
    parts = [f"{n} AS ({VIEWS[n].strip()})" for n in needed(sql)]
    recursive = "RECURSIVE " if re.match(r"\s*WITH RECURSIVE", sql) else ""
    body = re.sub(r"^\s*WITH (RECURSIVE )?", "", sql)
    if body != sql:
        return f"WITH {recursive}" + ", ".join([*parts, body])
    return (f"WITH {', '.join(parts)} " if parts else "") + sql


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of a view's name, or of a query over tables and views, in Spark."""
    sql = f"SELECT * FROM {sql}" if sql in VIEWS or sql in TABLES else sql
    text = duck(sql)
    used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", text)]
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})
