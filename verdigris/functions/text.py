"""Column functions over texts and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"(?U)\s+"


def strip(c: Column) -> Column:
    """White space of all kinds off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def flatten(messages: Column) -> Column:
    """Blank-line join of role blocks."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<"), m["role"], F.lit(">\n"), m["content"])), "\n\n")


def unflatten(text: Column) -> Column:
    """The messages of a flattened text; bare text is one user message, an empty one none."""
    marked = F.regexp_replace(text, r"(?:\A|\n\n)<(system|user|assistant)>\n", "\u0001$1\u0002")
    parts = F.filter(F.split(marked, "\u0001"), lambda p: p != "")
    made = F.transform(parts, lambda p: F.struct(F.when(p.contains("\u0002"), F.substring_index(p, "\u0002", 1)).otherwise("user").alias("role"), F.substring_index(p, "\u0002", -1).alias("content")))
    return made


def substantive(text: Column) -> Column:
    """Content beneath the role markers."""
    return strip(F.regexp_replace(text, r"(?:\A|\n\n)<\w+>\n", "")) != ""


def has_content(messages: Column) -> Column:
    return F.exists(messages, lambda m: strip(m["content"]) != "")


def truncate(text: Column, limit: int) -> Column:
    """Unchanged up to the limit, else cut, stripped on the right, with an ellipsis."""
    cut = F.regexp_replace(F.substring(text, 1, limit - 1), r"(?U)\s+\z", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit("…")))


def clip(text: Column, limit: int) -> Column:
    """Preview form: the cut text and how many characters went."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit), F.lit("…(+"), (F.length(text) - limit).cast("string"), F.lit("ch)")))


def direction_key(text: Column) -> Column:
    """White space collapsed, dots off the end, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(strip(text), WS, " "), r"\.+\z", ""))


def scrub(text: Column, tag: str) -> Column:
    """Without tagged spans and the white space after them; an opener that never closes takes the rest."""
    closed = F.regexp_replace(text, rf"(?s)<{tag}[^>]*>.*?</{tag}>[ \t\r\n]*", "")
    return F.regexp_replace(closed, rf"(?s)<{tag}.*\z", "")


def token_jaccard(a: Column, b: Column) -> Column:
    """Of lower-case white-space tokens; both empty: 1, one empty: 0."""
    tokens = lambda c: F.filter(F.array_distinct(F.split(F.lower(c), WS)), lambda x: x != "")
    x, y = tokens(a), tokens(b)
    return F.when((F.size(x) == 0) & (F.size(y) == 0), F.lit(1.0)).when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def project_label(path: Column) -> Column:
    """The parent folder's name after the last of the first marker it has, else without leading dashes."""
    name = F.element_at(F.split(path, "/"), -2)
    out = F.regexp_replace(name, r"^-+", "")
    for marker in ("-worktrees-", "-projects-", "-Code-"):
        out = F.when(name.contains(marker), F.substring_index(name, marker, -1)).otherwise(out)
    return out


def language_of_file(path: Column) -> Column:
    """The suffix without its dot, else the name, in lower case."""
    name = F.element_at(F.split(path, "/"), -1)
    suffix = F.regexp_extract(name, r"[^.]\.([^.]+)\z", 1)
    return F.lower(F.when(suffix != "", suffix).otherwise(name))


def deliverable(text: Column, limit: int = 500, markup: tuple[str, ...] = ("<proposal", "</proposal")) -> Column:
    """One paragraph within the limit and without delivery markup."""
    out = (F.length(text) <= limit) & ~strip(text).contains("\n\n")
    for m in markup:
        out = out & ~text.contains(m)
    return out
