"""Conversation threads: listing, lookup, last messages, referenced files and bounded context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from foldspan.functions.text import blank, filled, sanitise_tag, thread_ref

_EXTENSION = "(?i)\\.(md|csv|json|txt|tsv|parquet|yaml|yml)$"


def stem(file: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(file, "([^/]*)$", 1), "\\.json$", "")


def list_threads(threads: DataFrame, tag: str | None = None, n: int | None = None) -> DataFrame:
    """Summaries, newest first by the text of updated_at, of one sanitised tag if given."""
    rows = threads.select(
        F.coalesce("thread_id", stem(F.col("file"))).alias("thread_id"), blank("title").alias("title"), blank("updated_at").alias("updated_at"),
        F.greatest(F.size(F.coalesce("messages", F.expr("array()"))), F.lit(0)).alias("n_messages"), sanitise_tag("llm_process_tag").alias("llm_process_tag"), "file",
    )
    if tag:
        wanted = sanitise_tag(F.lit(tag))
        rows = rows.filter((wanted == "") | (F.col("llm_process_tag") == wanted))
    rows = rows.orderBy(F.desc("updated_at"), "file")
    return rows.limit(n) if n else rows


def resolve_threads(refs: DataFrame, threads: DataFrame) -> DataFrame:
    """(ref, file, error): the file of each reference (ref, tag). First the file tag_id, then id, then any file that ends in
    _id, then a thread with that id inside; references are unique by ref."""
    keyed = refs.withColumns({"__id": thread_ref("ref"), "__stem": F.regexp_replace(F.trim(blank("ref")), "\\.json$", ""), "__tag": sanitise_tag("tag")})
    files = threads.select("file", stem(F.col("file")).alias("s"), F.lower(blank("thread_id")).alias("inner"))
    names = files.select("file", F.inline(F.array(
        F.struct(F.lit("stem").alias("how"), F.col("s").alias("key")), F.struct(F.lit("end").alias("how"), F.regexp_extract("s", "_([^_]*)$", 1).alias("key")), F.struct(F.lit("inner").alias("how"), F.col("inner").alias("key")),
    )))
    wanted = keyed.select("ref", F.inline(F.array(
        F.struct(F.lit(0).alias("order"), F.lit("stem").alias("how"), F.col("__stem").alias("key")),
        F.struct(F.lit(1).alias("order"), F.lit("stem").alias("how"), F.when(F.col("__tag") != "", F.concat_ws("_", "__tag", "__id")).alias("key")),
        F.struct(F.lit(2).alias("order"), F.lit("stem").alias("how"), F.col("__id").alias("key")), F.struct(F.lit(3).alias("order"), F.lit("end").alias("how"), F.col("__id").alias("key")),
        F.struct(F.lit(4).alias("order"), F.lit("inner").alias("how"), F.col("__id").alias("key")),
    )))
    best = wanted.filter("key <> ''").join(names, ["how", "key"]).groupBy("ref").agg(F.min(F.struct("order", "file")).alias("b"))
    found = refs.join(best, "ref", "left")
    error = F.when(filled("ref").isNull(), "").when(F.col("b").isNull(), F.concat(F.lit("thread not found: "), "ref")).otherwise("")
    return found.select("ref", F.col("b.file").alias("file"), error.alias("error"))


def latest_by_role(messages: DataFrame) -> DataFrame:
    """(thread, n_messages, latest_user, latest_assistant): the last non-empty content of each role; '' without one."""
    last = lambda role: F.coalesce(F.max_by("content", F.when((F.col("role") == role) & (blank("content") != ""), F.col("pos"))), F.lit(""))
    return messages.groupBy("thread").agg(F.count("*").alias("n_messages"), last("user").alias("latest_user"), last("assistant").alias("latest_assistant"))


def referenced_files(messages: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(thread, path): string leaves of message metadata (JSON text) that look like paths, each once; with files (path),
    only those that exist. Keys are told from values by the colon after them."""
    leaf = F.explode(F.regexp_extract_all("metadata", F.lit('("(?:[^"\\\\]|\\\\.)*")(\\s*:)?'), F.lit(0)))
    values = messages.select("thread", leaf.alias("leaf")).filter(~F.col("leaf").rlike(":$"))
    text = F.get(F.from_json(F.concat(F.lit("["), "leaf", F.lit("]")), "array<string>"), 0)
    paths = values.select("thread", F.trim(text).alias("path"))
    likely = (F.col("path") != "") & (F.length("path") <= 400) & ~F.col("path").rlike("(?U)\\s") & (F.col("path").startswith("/") | F.col("path").rlike(_EXTENSION))
    found = paths.filter(likely).distinct()
    return found if files is None else found.join(files.select("path").distinct(), "path", "left_semi").select("thread", "path")


def file_snippets(paths: DataFrame, texts: DataFrame, n: int = 20_000) -> DataFrame:
    """(thread, path, snippet): the first n characters of each file at hand (path, text)."""
    return paths.join(texts, "path").select("thread", "path", F.left("text", F.lit(n)).alias("snippet"))


def thread_context(refs: DataFrame, threads: DataFrame, texts: DataFrame, n: int = 20_000, on_missing: str = "warn") -> DataFrame:
    """(ref, context, error): last user and assistant messages and FILE blocks, joined by blank lines. refs: (ref, tag);
    threads: file, thread_id and messages; texts: (path, text). A missing thread gives an empty text and an error, or
    raises."""
    resolved = resolve_threads(refs, threads)
    if on_missing == "raise":
        lost = resolved.filter("error <> ''").limit(1).collect()
        if lost:
            raise FileNotFoundError(lost[0]["error"])
    rows = threads.select(F.col("file").alias("thread"), F.posexplode("messages").alias("pos", "m")).select("thread", "pos", "m.*")
    latest = latest_by_role(rows)
    snippets = file_snippets(referenced_files(rows, texts), texts, n)
    block = F.struct("path", F.concat(F.lit("FILE: "), "path", F.lit("\n"), "snippet").alias("text"))
    blocks = snippets.groupBy("thread").agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda b: b["text"]), "\n\n").alias("blocks"))
    whole = resolved.join(latest, resolved["file"] == latest["thread"], "left").drop("thread").join(blocks, F.col("file") == F.col("thread"), "left")
    text = F.concat(blank("latest_user"), F.lit("\n\n"), blank("latest_assistant"), F.lit("\n\n"), blank("blocks"))
    trimmed = F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")
    return whole.select("ref", F.when(F.col("file").isNull(), "").otherwise(trimmed).alias("context"), "error")


def create_threads(threads: DataFrame, new: DataFrame) -> DataFrame:
    """threads with new ones added; an id that is there already, or twice among the new, raises."""
    again = new.join(threads.select("thread_id"), "thread_id", "left_semi").select("thread_id")
    twice = new.groupBy("thread_id").count().filter("count > 1").select("thread_id")
    bad = again.union(twice).limit(5).collect()
    if bad:
        raise ValueError(f"threads exist already: {[r['thread_id'] for r in bad]}")
    return threads.unionByName(new, allowMissingColumns=True)


def newest_messages(messages: DataFrame, n: int = 5) -> DataFrame:
    """The last n messages of each thread."""
    order = Window.partitionBy("thread").orderBy(F.desc("pos"))
    return messages.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= n).drop("__n")
