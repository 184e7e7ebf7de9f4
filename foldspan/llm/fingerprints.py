"""Document fingerprints by I-Match over several randomised lexicons, with DataFrame functions only.

Terms are lower-cased words. The lexicon holds the terms whose inverse document frequency lies in a band: what is in more
than COMMON of all texts says nothing, what is in less than RARE is noise. A text's lexicon terms, distinct and sorted, are
hashed once whole and once for each of several random subsets of the lexicon, whose rates fall from an eighth to a 256th,
so that short and long texts both have subsets that few of their terms fall into. Two texts are as alike as the share of
subsets, empty for not both of them, that hash alike.

At most (distinct terms of a text on average) / RARE terms can be in RARE of all texts, so the lexicon does not grow with
the corpus. It is looked up inside the row, in a constant table of hash buckets; no term is ever shuffled but for the
counts. The next document's part comes by one join of texts and one of half texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspan.llm.common import written
from foldspan.llm.ordering import numbered

#: A lexicon term is in more than this share of all texts, and in two at least, and in less than that share.
RARE, COMMON = 0.002, 0.2
#: (classes, used): the lexicon falls into so many random classes, of which the first are subsets; each subset is dealt
#: likewise into those of the next family. So many hashes has a fingerprint: the whole lexicon's and the subsets'.
FAMILIES = ((8, 8), (8, 2), (4, 2))
HASHES = 1 + 8 + 8 * 2 + 8 * 2 * 2
#: Bytes of the lexicon beyond which the band is refused as too wide.
LEXICON_BYTES = 64 << 20
_BLANK = "[\\x20\\x09-\\x0D]+"
_NO_ID = -(1 << 63)


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-cased words of a text, sorted."""
    return F.sort_array(F.array_distinct(F.transform(F.filter(F.split(F.lower(text), _BLANK), lambda w: w != ""), lambda w: F.xxhash64(w))))


def lexicon(texts: DataFrame, rare: float = RARE, common: float = COMMON) -> DataFrame:
    """(term, n): hashed terms in the band, and the texts that hold them, written. texts has a column text; all of it counts."""
    total = texts.count()
    counts = texts.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return written(counts.filter((F.col("n") >= max(2.0, rare * total)) & (F.col("n") <= common * total)), "lexicon")


def buckets(words: DataFrame) -> tuple[Column, int]:
    """A table of hash buckets that holds all terms, as a constant, and its number of buckets. Higher-order functions take no
    subquery, so the table, whose size is checked here, passes the driver as text."""
    n = words.count()
    if n * 8 > LEXICON_BYTES:
        raise ValueError(f"a lexicon of {n} terms is larger than {LEXICON_BYTES} bytes; take a narrower band")
    slots = max(1, 2 * n)
    filled = words.groupBy(F.pmod("term", F.lit(slots)).alias("slot")).agg(F.collect_list("term").alias("held"))
    dense = words.sparkSession.range(slots).select(F.col("id").alias("slot")).join(filled, "slot", "left")
    sorted_ = F.array_sort(F.collect_list(F.struct("slot", F.coalesce("held", F.array().cast("array<bigint>")).alias("held"))))
    table = dense.agg(F.to_json(F.transform(sorted_, lambda x: x["held"]))).first()[0]
    return F.from_json(F.lit(table), "array<array<bigint>>"), slots


def fingerprint(text: Column, held: Column, slots: int) -> Column:
    """HASHES hashes of 32 bits, -1 where no term of the text is in the subset. A text without a lexicon term has the hash of
    all its terms in the first place, so that equal texts are alike and others are not."""
    in_band = lambda t: F.array_contains(F.element_at(held, (F.pmod(t, F.lit(slots)) + 1).cast("int")), t)
    both = F.transform(F.array(terms(text)), lambda x: F.struct(F.filter(x, in_band).alias("known"), x.alias("all")))
    return F.transform(both, _hashes)[0]


def _hash(subset: Column) -> Column:
    return F.when(F.size(subset) > 0, F.shiftrightunsigned(F.xxhash64(subset), 32)).otherwise(F.lit(-1).cast("bigint"))


def _hashes(x: Column) -> Column:
    """Each subset of a family is dealt into subsets of the next, so that later ones cost little."""
    whole = F.shiftrightunsigned(F.xxhash64(F.when(F.size(x["known"]) > 0, x["known"]).otherwise(x["all"])), 32)
    return F.concat(F.array(whole), _deal(x["known"], 20, FAMILIES))


def _deal(terms_: Column, low: int, families: tuple) -> Column:
    (classes, used), rest = families[0], families[1:]
    of = lambda t: F.shiftright(t, low).bitwiseAND(F.lit(classes - 1).cast("bigint"))
    part = lambda r: F.filter(terms_, lambda t: of(t) == F.lit(r).cast("bigint"))
    one = lambda d: F.concat(F.array(_hash(d)), _deal(d, low + 10, rest)) if rest else F.array(_hash(d))
    return F.flatten(F.transform(F.array(*[part(r) for r in range(used)]), one))


def likeness(a: Column, b: Column) -> Column:
    """Share of the hashes that are equal, of those where not both texts have an empty subset."""
    pairs = F.zip_with(a, b, lambda x, y: F.when((x < 0) & (y < 0), None).otherwise((x == y).cast("int")))
    seen = F.filter(pairs, lambda x: x.isNotNull())
    return F.aggregate(seen, F.lit(0), lambda s, x: s + x) / F.size(seen)


def written_out(hashes: Column) -> Column:
    """Hashes as text, eight hexadecimal digits each, eight hyphens for an empty subset."""
    return F.array_join(F.transform(hashes, lambda x: F.when(x < 0, "-" * 8).otherwise(F.lpad(F.lower(F.hex(x)), 8, "0"))), "")


def neighbours(rows: DataFrame) -> DataFrame:
    """(id, repeated, before_id, wanted), written, of rows (id, text): the previous of all different ids, ascending and in a
    circle, whether several rows have the id, and the longest part that texts of the previous id take of this one's."""
    ids = rows.groupBy("id").agg((F.count(F.lit(1)) > 1).alias("repeated"), F.max((F.length("text") / 2).cast("int")).alias("half"))
    placed = written(numbered(written(ids.withColumn("all", F.lit("")), "ids"), "all", "id").drop("all"), "placed")
    ahead = placed.select(F.pmod(F.col("pos") + 1, F.col("total")).alias("pos"), F.col("id").alias("before_id"), F.col("half").alias("wanted"))
    return written(placed.join(ahead, "pos").select("id", "repeated", "before_id", "wanted"), "neighbours")


def fingerprinted(docs: DataFrame, rare: float = RARE, common: float = COMMON, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row. The edited text
    has its last floor(n_chars / 2) code points replaced by the first as many of the next document.

    Null texts count as empty; texts of any length count whole. Null ids come before all others; the least long integer
    stands for them. Where an id repeats, each of its rows has the next different id as its neighbour, and of that id's
    texts the one with the least hash is taken. A lone id is its own neighbour. An empty table gives an empty one. Other
    columns are ignored, whatever their names.
    """
    plain = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    held, slots = buckets(lexicon(plain, rare, common))
    links = neighbours(plain)
    sent = plain.join(links, "id").select(F.col("before_id").alias("id"), "repeated", F.xxhash64("text").alias("key"), F.struct(F.expr("left(text, wanted)").alias("head"), fingerprint(F.col("text"), held, slots).alias("own")).alias("next"))
    heads = sent.filter("NOT repeated").select("id", "next")
    if not links.filter("repeated").isEmpty():
        heads = heads.unionByName(sent.filter("repeated").groupBy("id").agg(F.min_by("next", "key").alias("next")))
    n = F.length("text")
    half = (n / 2).cast("int")
    paired = plain.join(heads, "id").select("id", n.cast("long").alias("n_chars"), fingerprint(F.col("text"), held, slots).alias("own"), F.concat(F.substring("text", F.lit(1), n - half), F.substring("next.head", F.lit(1), half)).alias("edited"), F.col("next.own").alias("next_own"))
    changed = paired.select("id", "n_chars", "own", "next_own", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited"), held, slots).alias("changed"))
    return changed.select(
        F.nullif("id", F.lit(_NO_ID)).alias("doc_id"), "n_chars", "edited_sha256", written_out(F.col("own")).alias("fingerprint"), written_out(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
