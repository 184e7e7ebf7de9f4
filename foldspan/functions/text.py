"""Column expressions on text. All are built-in functions and run on batch and streaming frames alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foldspan.functions.chains import chain_ids  # noqa: F401


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c: Column | str) -> Column:
    """Text with nulls as ''."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def filled(c: Column | str) -> Column:
    """Trimmed text, null if nothing is left."""
    return F.nullif(F.trim(col(c)), F.lit(""))


def clean_text(c: Column | str, n: int = 6000) -> Column:
    """White space of any kind collapsed to one space, trimmed, cut to n characters; null gives ''."""
    return F.left(F.trim(F.regexp_replace(blank(c), "(?U)\\s+", " ")), F.lit(n))


def compact_text(c: Column | str, n: int = 1000) -> Column:
    """Collapsed text; if longer than n, its first n - 3 characters and '...'."""
    text = F.trim(F.regexp_replace(blank(c), "(?U)\\s+", " "))
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n - 3)), F.lit("..."))).otherwise(text)


def safe_join(items: Column | str, sep: str = " ") -> Column:
    """Trimmed, non-blank items joined; a null array gives ''."""
    kept = F.filter(F.transform(col(items), lambda x: F.trim(blank(x))), lambda x: x != "")
    return F.coalesce(F.array_join(kept, sep), F.lit(""))


def as_list(c: Column | str) -> Column:
    """Comma-separated text as trimmed, non-blank items; null gives an empty array."""
    return F.filter(F.transform(F.split(blank(c), ","), lambda x: F.trim(x)), lambda x: x != "")


def default_text(c: Column | str, default: str = "None provided") -> Column:
    return F.coalesce(filled(c), F.lit(default))


def sanitise_tag(c: Column | str) -> Column:
    """Runs outside A-Z, a-z, 0-9 and _ become one _, which is trimmed at both ends; null gives ''."""
    return F.regexp_replace(F.regexp_replace(F.trim(blank(c)), "[^A-Za-z0-9_]+", "_"), "^_+|_+$", "")


def thread_ref(c: Column | str) -> Column:
    """A thread id out of an id, a tag_id stem or a file name; 32 hex digits after a tag are lower-cased."""
    stem = F.regexp_replace(F.trim(blank(c)), "\\.json$", "")
    found = F.regexp_extract(stem, "^[A-Za-z0-9_]+_([0-9a-fA-F]{32})$", 1)
    return F.when(found != "", F.lower(found)).otherwise(stem)


def render(template: str, fields: dict[str, Column]) -> Column:
    """A text template with {name} places filled from columns."""
    parts, rest = [], template
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(head), fields[name]]
    return F.concat(*parts, F.lit(rest))


def pair_labels(pairs: Column | str) -> Column:
    """'a vs b' for each struct (a, b) of an array, joined by '; '."""
    return safe_join(F.transform(col(pairs), lambda p: F.concat(p["a"], F.lit(" vs "), p["b"])), "; ")
