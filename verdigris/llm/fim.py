"""Operator 13: fill-in-the-middle, with texts cut by lookaround splitting.

A unit grammar says what the units of a text are: lines, words, sentences, runs of one character class.  Every grammar
here has the property that whether a unit ends between two characters depends on these two alone.  So it is translated to
a zero-width regex, pairs of a class on the left and a class on the right, and Spark's `split` at these places keeps every
character: the units' concatenation is the text.  (An empty text is one empty piece to `split`, but has no unit; it is
handled apart.)

Two numbers that are drawn from a document's id cut its n units into prefix, middle and suffix, any of which may be empty.
The form is `psm` (prefix, suffix, middle), `spm` (suffix, prefix, middle) or `plain`, the text itself; markers stand before
the parts.  A text that holds a marker stays plain, so an output can be taken apart again at its markers (`restored`).

All of it is column expressions of a row: no shuffle, no state, nothing that grows but the row.

Defined cases: a null or empty text has no unit and is plain, its output empty; a null id is drawn as the empty text would
be; repeated rows and ids are cut alike; texts of any length are cut whole; an empty table gives an empty result; other
columns stay, but for those that are named as one of the results, which are replaced (an id or text so named raises); names
may hold dots.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANY = r"\s\S"
#: Characters that are the second half of one: a boundary never stands before them.
_HALF = r"(?![\uDC00-\uDFFF])"


def boundary(*sides: tuple[str, str]) -> str:
    """The zero-width regex that matches between a character of a left class and one of its right class, for any of the
    sides.  Classes are the inside of a regex's brackets."""
    return "|".join(rf"(?<=[{left}]){_HALF}(?=[{right}])" for left, right in sides)


def runs(*classes: str) -> str:
    """Runs of one class each: [a]+|[b]+|…, where every character is of one of the classes."""
    return boundary(*((x, y) for x in classes for y in classes if x != y))


#: Unit grammars by name, each as the regex between units.
GRAMMARS = {
    "lines": boundary(("\\n", ANY)),  # [^\n]*\n|[^\n]+
    "words": boundary((r"\s", r"\S")),  # \s+|\S+\s*, the first unit may be space alone
    "tokens": runs(r"\s", r"\w", r"\W&&\S"),  # \s+|\w+|[^\w\s]+
    "sentences": boundary((r".!?。！？", r"\s")),  # a unit ends with its mark; space opens the next
    "characters": boundary((ANY, ANY)),
}


def units(text: Column, grammar: str = "lines") -> Column:
    """The text's units in order; none of a null or empty text."""
    return F.when(F.length(text) > 0, F.split(text, GRAMMARS[grammar], -1)).otherwise(F.array().cast("array<string>"))


def draws(key: Column, seed: int, n: int = 4) -> list[Column]:
    """n numbers below 2**32: groups of eight hex digits of the sha256 of `seed:key`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def checked(markers: tuple[str, str, str]) -> tuple[str, str, str]:
    """The markers, if an output can be taken apart at them: none empty, none within another, and no marker's end the
    beginning of one, so that none arises where parts and markers meet."""
    for a in markers:
        for b in markers:
            if not a or (a != b and a in b) or any(a.endswith(b[:k]) for k in range(1, len(b))):
                raise ValueError(f"markers {a!r} and {b!r} can't be told apart")
    if len(set(markers)) < 3:
        raise ValueError("three different markers are needed")
    return markers


def transformed(docs: DataFrame, key: str = "doc_id", text: str = "text", grammar: str = "lines", seed: int = 7, rate: int = 100, spm: int = 50, markers: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> DataFrame:
    """docs with n (units), form, prefix_chars and middle_chars (null if plain) and output.

    `rate` of 100 texts are rearranged, `spm` of 100 of these with the suffix first; `markers` stand before prefix, suffix
    and middle."""
    before, after, amid = map(F.lit, checked(markers))
    whole, made = F.coalesce(F.col(f"`{text}`"), F.lit("")), {"n", "form", "prefix_chars", "middle_chars", "output"}
    if made & {key, text}:
        raise ValueError(f"{key} and {text} must not be named as results")
    names = [c for c in docs.columns if c not in made]
    kept = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    h = draws(F.col(f"`{key}`"), seed)
    rows = docs.select(*kept, whole.alias("whole"), *(x.alias(f"h{i}") for i, x in enumerate(h)))
    rows = rows.withColumn("units", units(F.col("whole"), grammar)).withColumn("n", F.size("units").cast("long"))
    rows = rows.withColumn("x", F.col("h0") % (F.col("n") + 1)).withColumn("y", F.col("h1") % (F.col("n") + 1))
    low, high = F.least("x", "y").cast("int"), F.greatest("x", "y").cast("int")
    part = lambda start, length: F.array_join(F.slice("units", start, length), "")
    rows = rows.select("*", part(F.lit(1), low).alias("prefix"), part(low + 1, high - low).alias("middle"), part(high + 1, F.col("n").cast("int") - high).alias("suffix"))
    plain = (F.col("n") == 0) | reduce(or_, (F.contains("whole", F.lit(m)) for m in markers)) | (F.col("h2") % 100 >= rate)
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("h3") % 100 < spm, "spm").otherwise("psm"))
    output = F.when(F.col("form") == "plain", F.col("whole")).when(F.col("form") == "psm", F.concat(before, "prefix", after, "suffix", amid, "middle")).otherwise(F.concat(after, "suffix", before, "prefix", amid, "middle"))
    chars = lambda c: F.when(F.col("form") != "plain", F.length(c).cast("long"))
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), "n", "form", chars("prefix").alias("prefix_chars"), chars("middle").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text that an output was made from."""
    pieces = F.split(output, "|".join(rf"\Q{m}\E" for m in checked(markers)), -1)
    first, second, middle = (F.try_element_at(pieces, F.lit(i)) for i in (2, 3, 4))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))


def digests(made: DataFrame, key: str = "doc_id", markers: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> DataFrame:
    """Lengths, and sha256 of the outputs and of the texts that come back from them."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(F.col(f"`{key}`"), "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"), markers)).alias("restored_sha256"))
