"""Line-first cleaning: each line passes punctuation, navigation and boilerplate rules, failing lines go, and a document
that loses too much of its text is rejected. DataFrame functions only; a document is judged inside its row, so nothing
is shuffled and one long document costs n log n of its own words.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspan.llm.common import written

#: White space between words: space and the control characters 9 to 13.
WHITE = "[\\x20\\x09-\\x0D]+"
SOLID = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"
#: Fixed phrases of page furniture, matched between word bounds in lower-cased lines.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "accept cookies",
    "uses cookies", "enable javascript", "click here", "read more", "sign up", "log in", "subscribe to our",
    "share this", "back to top", "skip to content", "lorem ipsum",
)
#: A line is boilerplate if such phrases make up so many percent of its characters.
PHRASE_PERCENT = 20
PHRASES = "(^|[^a-z0-9])(" + "|".join(BOILERPLATE) + ")($|[^a-z0-9])"
END_MARK = "[.!?…:;,\"'”’)][\\x20\\x09-\\x0D]*$"
MIN_WORDS = 50
#: A document is rejected if fewer than so many percent of its lines' characters are left.
KEEP_PERCENT = 50


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once: a lambda over a one-element array."""
    return F.transform(F.array(value), body).getItem(0)


def words(text: Column) -> Column:
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def occurrences(text: Column, parts: Iterable[str]) -> Column:
    """How often parts stand in text, without overlap; counted by the bytes that taking them out saves."""
    counts = [(F.octet_length(text) - F.octet_length(F.replace(text, F.lit(p), F.lit("")))) / len(p.encode()) for p in parts]
    return reduce(lambda a, b: a + b, counts).cast("int")


def repeat_words(windows: Column) -> Column:
    """Words that lie in a window of three words found twice or more; windows are hashes in text order. Windows are sorted
    with their places, so that equal ones are neighbours; the places of repeated windows, in order, cover three words
    each, less what they overlap. A text without equal windows is not sorted."""
    placed = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    twice = lambda s: F.filter(F.transform(s, lambda x, k: F.when(same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)), x["i"])), lambda i: i.isNotNull())
    covered = lambda p: F.aggregate(F.transform(p, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - i, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    counted = let(F.sort_array(placed), lambda s: let(F.sort_array(twice(s)), covered))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), counted).otherwise(0).cast("long")


def line_fails(line: Column) -> Column:
    """Whether a line with a word fails a rule: navigation (separators between few words), punctuation (symbols, doubled
    marks or capitals throughout, or a fragment without an end mark), boilerplate (known phrases make up a good part). Cheap conditions stand
    before the counts that they must hold for: three capitals in a row among the letters before the share of capitals, a
    doubled mark before their number, white space twice before the number of words."""
    spaced = F.regexp_count(F.trim(line), F.lit(WHITE)) + 1
    symbols, bars = occurrences(line, SYMBOLS + "{}=~^@"), occurrences(line, "|»•")
    upper, letters = F.regexp_count(line, F.lit("\\p{Lu}")), F.regexp_count(line, F.lit("\\p{L}"))
    navigation = (bars >= 3) & (bars * 5 >= spaced)
    doubled = reduce(lambda a, b: a | b, [line.contains(x) for x in ("!!", "??", "!?", "?!")]) & (F.regexp_count(line, F.lit("[!?]{2,}")) * 5 > spaced)
    capitals = line.rlike("\\p{Lu}\\P{L}*\\p{Lu}\\P{L}*\\p{Lu}") & (letters >= 20) & (upper * 10 > letters * 7)
    fragment = ~F.trim(line).rlike(f"{WHITE}{SOLID}+{WHITE}") & ~line.rlike(END_MARK)
    punctuation = ((symbols >= 3) & (symbols * 4 > spaced)) | doubled | capitals | fragment
    phrased = lambda x: F.aggregate(F.regexp_extract_all(x, F.lit(PHRASES), F.lit(2)), F.lit(0), lambda a, p: a + F.length(p))
    boilerplate = let(F.lower(line), lambda x: reduce(lambda a, b: a | b, [x.contains(p) for p in BOILERPLATE]) & (phrased(x) * 100 >= F.length(x) * PHRASE_PERCENT) & (phrased(x) > 0))
    return navigation | punctuation | boilerplate


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, verdict and cleaned text of each document.

    Returns (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, n_failed_lines,
    line_chars, kept_chars, kept, cleaned). Null and empty texts count no words and fail the base rule. Blank lines stay
    in the cleaned text and count nowhere. Each row is judged by itself, so ids may be null or repeat. Texts of any length
    are judged whole. An empty table gives an empty one. Other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), words(text).alias("w"), F.split(text, "\n").alias("lines"))
    window = F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.xxhash64(F.element_at("w", i), F.element_at("w", i + 1), F.element_at("w", i + 2)))
    rows = base.select(
        "doc_id",
        "lines",
        F.filter("lines", lambda x: x.rlike(SOLID)).alias("solid"),
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        occurrences(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        F.when(F.size("w") >= 3, window).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    rows = rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("solid") - F.size(F.array_distinct("solid"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("windows")).alias("n_repeat_words"),
        F.size("solid").cast("long").alias("n_lines"),
        F.length(F.array_join("solid", "")).cast("long").alias("line_chars"),
        F.filter("lines", lambda x: ~(x.rlike(SOLID) & line_fails(x))).alias("left"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    rows = rows.withColumn("still", F.filter("left", lambda x: x.rlike(SOLID)))
    rows = rows.select(
        *[c for c in rows.columns if c not in ("left", "still")],
        failed.alias("base_failed"),
        (F.col("n_lines") - F.size("still")).alias("n_failed_lines"),
        F.length(F.array_join("still", "")).cast("long").alias("kept_chars"),
        F.array_join("left", "\n").alias("cleaned"),
    )
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("kept_chars") * 100 >= F.col("line_chars") * KEEP_PERCENT))


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs that are kept, with the failing lines taken out of their texts. All columns stay; n_chars, if there, follows the
    new text. Verdicts are written before rows are dropped: a filter on the verdict would be pushed below the rules, and
    the planner would unfold all of them into one condition."""
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    packed = docs.select(F.struct(id_col, *rest).alias("__row"), F.col(text_col).alias("__text"))
    verdicts = written(judged(packed, "__row", "__text").select("doc_id", "kept", "cleaned"), "cleaned")
    kept = verdicts.filter("kept").select("doc_id.*", F.col("cleaned").alias(text_col))
    if "n_chars" in rest:
        kept = kept.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3),
tri AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM pos),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
solid AS (SELECT doc_id, line, len(regexp_extract_all(trim(line), '[\\x20\\x09-\\x0D]+')) + 1 AS spaced,
    length(line) - length(regexp_replace(line, '[#*$%&|<>{{}}=~^@]', '', 'g')) AS symbols,
    length(line) - length(regexp_replace(line, '[|»•]', '', 'g')) AS bars,
    len(regexp_extract_all(line, '\\p{{Lu}}')) AS upper, len(regexp_extract_all(line, '\\p{{L}}')) AS letters,
    len(regexp_extract_all(line, '[!?]{{2,}}')) AS bangs,
    coalesce(list_sum(list_transform(regexp_extract_all(lower(line), '{PHRASES}', 2), lambda x: length(x))), 0) AS phrased
  FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
judged AS (SELECT doc_id, line, (bars >= 3 AND bars * 5 >= spaced) OR (symbols >= 3 AND symbols * 4 > spaced) OR bangs * 5 > spaced
    OR (letters >= 20 AND upper * 10 > letters * 7)
    OR (spaced < 3 AND NOT regexp_matches(line, '[.!?…:;,"''”’)][\\x20\\x09-\\x0D]*$'))
    OR (phrased > 0 AND phrased * 100 >= length(lower(line)) * {PHRASE_PERCENT}) AS fails FROM solid),
per AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (fails) AS n_failed_lines, sum(length(line)) AS line_chars,
    coalesce(sum(length(line)) FILTER (NOT fails), 0) AS kept_chars, count(*) - count(DISTINCT line) AS n_dup_lines FROM judged GROUP BY doc_id),
base AS (SELECT w.doc_id, len(w.w) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(per.n_dup_lines, 0) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_failed_lines, 0) AS n_failed_lines,
    coalesce(line_chars, 0) AS line_chars, coalesce(kept_chars, 0) AS kept_chars
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN per USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * 50 AS base_failed, n_lines, n_failed_lines,
    CAST(line_chars AS BIGINT) AS line_chars, CAST(kept_chars AS BIGINT) AS kept_chars,
    NOT (n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * 50) AND kept_chars * 100 >= line_chars * {KEEP_PERCENT} AS kept
FROM base
"""
