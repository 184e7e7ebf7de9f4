"""Landed search responses (project_id, body) as protein and literature hits."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from foldspan.functions.text import blank


def _items(landed: DataFrame, schema: str, path: str = "results") -> DataFrame:
    parsed = landed.select("project_id", F.from_json("body", schema).alias("r"))
    return parsed.select("project_id", F.posexplode(f"r.{path}" if path else "r").alias("pos", "x"))


def _protein(df: DataFrame, source: str, id: Column, title: Column, organism: Column, summary: Column, url: Column) -> DataFrame:
    return df.select("project_id", "pos", F.lit(source).alias("source"), *(blank(c).alias(n) for c, n in ((id, "id"), (title, "title"), (organism, "organism"), (summary, "summary"), (url, "url"))))


def normalise_uniprot(landed: DataFrame) -> DataFrame:
    rows = _items(landed, "results array<struct<primaryAccession: string, uniProtkbId: string, organism: struct<scientificName: string>, proteinDescription: struct<recommendedName: struct<fullName: struct<value: string>>>>>".join(["struct<", ">"]))
    return _protein(rows, "UniProt", F.col("x.primaryAccession"), F.col("x.uniProtkbId"), F.col("x.organism.scientificName"), F.col("x.proteinDescription.recommendedName.fullName.value"), F.concat(F.lit("https://www.uniprot.org/uniprotkb/"), blank("x.primaryAccession")))


def normalise_interpro(landed: DataFrame) -> DataFrame:
    rows = _items(landed, "struct<results array<struct<metadata: struct<accession: string, name: string, type: string>>>>")
    return _protein(rows, "InterPro", F.col("x.metadata.accession"), F.col("x.metadata.name"), F.lit(""), F.col("x.metadata.type"), F.concat(F.lit("https://www.ebi.ac.uk/interpro/entry/interpro/"), blank("x.metadata.accession"), F.lit("/")))


def normalise_pdb(landed: DataFrame) -> DataFrame:
    rows = _items(landed, "struct<result_set array<struct<identifier: string>>>", "result_set")
    return _protein(rows, "PDB", F.col("x.identifier"), F.col("x.identifier"), F.lit(""), F.lit("Protein structure entry"), F.concat(F.lit("https://www.rcsb.org/structure/"), blank("x.identifier")))


def normalise_alphafold(landed: DataFrame, n: int = 20) -> DataFrame:
    """The first n entries of a top-level array; a body that is no array has none."""
    rows = _items(landed.filter(F.trim("body").startswith("[")), "array<struct<entryId: string, uniprotDescription: string, organismScientificName: string>>", "").filter(F.col("pos") < n)
    return _protein(rows, "AlphaFold DB", F.col("x.entryId"), F.col("x.uniprotDescription"), F.col("x.organismScientificName"), F.lit("Predicted protein structure"), F.concat(F.lit("https://alphafold.ebi.ac.uk/entry/"), blank("x.entryId")))


def _literature(df: DataFrame, source: str, **c: Column) -> DataFrame:
    text = lambda n: blank(c.get(n, F.lit(""))).alias(n)
    return df.select(
        "project_id", "pos", F.lit(source).alias("source"), text("id"), text("title"), text("journal"), c.get("year", F.lit(None)).cast("string").try_cast("int").alias("year"), text("abstract"),
        F.coalesce(c.get("is_open_access", F.lit(False)), F.lit(False)).alias("is_open_access"), text("fulltext_url"), text("url"), text("pmcid"), text("host_venue"),
    )


def normalise_pubmed(landed: DataFrame) -> DataFrame:
    """Hits of PubMed XML: parts of an abstract joined by a space; open access where there is a PMC id."""
    articles = landed.select("project_id", F.posexplode(F.regexp_extract_all("body", F.lit("(?s)<PubmedArticle[ >].*?</PubmedArticle>"), F.lit(0))).alias("pos", "a"))
    text = lambda path: F.xpath_string("a", F.lit(path))
    pmcid = F.trim(text("(//ArticleId[@IdType='pmc'])[1]"))
    pmid = F.regexp_replace(text("(//PMID)[1]"), "\\s+", "")
    rows = articles.withColumns({"pmcid": pmcid, "pmid": pmid})
    full = F.when(F.col("pmcid") != "", F.concat(F.lit("https://pmc.ncbi.nlm.nih.gov/articles/"), "pmcid", F.lit("/")))
    abstract = F.trim(F.array_join(F.xpath("a", F.lit("//Abstract/AbstractText/text()")), " "))
    return _literature(rows, "PubMed", id=F.col("pmid"), title=text("(//ArticleTitle)[1]"), journal=text("(//Journal/Title)[1]"), year=F.nullif(text("(//PubDate/Year)[1]"), F.lit("")), abstract=abstract, is_open_access=F.col("pmcid") != "", fulltext_url=full, url=F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), "pmid", F.lit("/")), pmcid=F.col("pmcid"), host_venue=text("(//Journal/Title)[1]"))


def normalise_europepmc(landed: DataFrame) -> DataFrame:
    fields = "id: string, title: string, journalTitle: string, pubYear: string, abstractText: string, isOpenAccess: string, fullTextUrl: string, doi: string, pmcid: string"
    rows = _items(landed, f"struct<resultList struct<result: array<struct<{fields}>>>>", "resultList.result")
    full = F.when(blank("x.fullTextUrl") != "", F.col("x.fullTextUrl")).when(blank("x.pmcid") != "", F.concat(F.lit("https://europepmc.org/articles/"), "x.pmcid"))
    doi = F.when(blank("x.doi") != "", F.concat(F.lit("https://doi.org/"), "x.doi"))
    return _literature(rows, "EuropePMC", id=F.col("x.id"), title=F.col("x.title"), journal=F.col("x.journalTitle"), year=F.col("x.pubYear"), abstract=F.col("x.abstractText"), is_open_access=F.upper("x.isOpenAccess") == "Y", fulltext_url=full, url=doi, pmcid=F.col("x.pmcid"), host_venue=F.col("x.journalTitle"))


def normalise_openalex(landed: DataFrame) -> DataFrame:
    place = "primary_location: struct<landing_page_url: string, source: struct<display_name: string>>"
    rows = _items(landed, f"struct<results array<struct<id: string, display_name: string, publication_year: string, open_access: struct<is_oa: boolean, oa_url: string>, {place}>>>")
    landing, venue = F.col("x.primary_location.landing_page_url"), F.col("x.primary_location.source.display_name")
    return _literature(rows, "OpenAlex", id=F.col("x.id"), title=F.col("x.display_name"), journal=venue, year=F.col("x.publication_year"), is_open_access=F.col("x.open_access.is_oa"), fulltext_url=F.coalesce(F.nullif("x.open_access.oa_url", F.lit("")), landing), url=landing, host_venue=venue)


def normalise_websearch(landed: DataFrame, n: int = 20) -> DataFrame:
    """Hits of either response shape: results, or a heading followed by related topics; the first n of both together.
    landed also has query, the title of a heading without one."""
    topics = "Heading: string, AbstractText: string, AbstractURL: string, RelatedTopics: array<struct<Text: string, FirstURL: string>>"
    parsed = landed.select("project_id", "query", F.from_json("body", f"struct<results: array<struct<title: string, url: string, content: string>>, {topics}>").alias("r"))
    shape = lambda url, title, abstract: F.struct(blank(url).alias("url"), blank(title).alias("title"), blank(abstract).alias("abstract"))
    none = F.expr("array()").cast("array<struct<url: string, title: string, abstract: string>>")
    results = F.coalesce(F.transform("r.results", lambda x: shape(x["url"], x["title"], x["content"])), none)
    heading = F.when((blank("r.Heading") != "") | (blank("r.AbstractText") != ""), F.array(shape(F.col("r.AbstractURL"), F.coalesce(F.nullif("r.Heading", F.lit("")), "query"), F.col("r.AbstractText")))).otherwise(none)
    related = F.coalesce(F.transform(F.filter("r.RelatedTopics", lambda x: x["Text"].isNotNull()), lambda x: shape(x["FirstURL"], F.left(x["Text"], F.lit(160)), x["Text"])), none)
    rows = parsed.select("project_id", F.posexplode(F.slice(F.concat(results, heading, related), 1, n)).alias("pos", "x"))
    url = F.col("x.url")
    return _literature(rows, "WebSearch", id=url, title=F.col("x.title"), abstract=F.col("x.abstract"), fulltext_url=url, url=url, host_venue=url)


def xml_fulltext(landed: DataFrame, n: int = 6000) -> DataFrame:
    """(pmcid, excerpt) of full-text XML (pmcid, body): all text joined by spaces, white space collapsed, cut to n; '' where
    the XML is malformed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = []
            for body in f["body"]:
                try:
                    texts.append(" ".join(ET.fromstring(body).itertext()) if body else "")
                except ET.ParseError:
                    texts.append("")
            yield pd.DataFrame({"pmcid": f["pmcid"], "raw": texts})

    rows = landed.select("pmcid", "body").mapInPandas(run, "pmcid string, raw string")
    return rows.select("pmcid", F.left(F.trim(F.regexp_replace("raw", "(?U)\\s+", " ")), F.lit(n)).alias("excerpt"))


def first_of_source(hits: DataFrame, n: int = 20) -> DataFrame:
    """The first n hits of each project and source, in response order."""
    order = Window.partitionBy("project_id", "source").orderBy("pos")
    return hits.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= n).drop("__n")
