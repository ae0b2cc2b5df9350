"""Text expressions with Python's string semantics, as built-in Spark functions only."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as Python sees it: Java's plus the separators U+001C to U+001F.
SPACE = r"(?U)[\s\x{1c}-\x{1f}]"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with ``value`` computed once, where plain nesting would compute it at each mention."""
    return F.transform(F.array(value), f)[0]


def text(c: Column) -> Column:
    """A missing text counts as empty."""
    return F.coalesce(c.cast("string"), F.lit(""))


def words(c: Column, lower: bool = False) -> Column:
    """White-space separated words, none empty."""
    c = text(c)
    return F.filter(F.split(F.lower(c) if lower else c, SPACE + "+"), lambda w: w != "")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+\z", "")


def is_set(c: Column) -> Column:
    """The truth of a string: neither null nor empty."""
    return c.isNotNull() & (c != "")


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens joined by spaces; fewer tokens give none.

    Shifted copies of the array are zipped, so nothing is looked up place by place."""

    def runs(t: Column) -> Column:
        out = t
        for k in range(1, n):
            out = F.zip_with(out, F.slice(t, F.lit(k + 1), F.size(t)), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.filter(out, lambda g: g.isNotNull())

    return bound(tokens, runs)


def hashed_ngrams(tokens: Column, n: int) -> Column:
    """64-bit hashes of the distinct runs of n tokens; fewer tokens give none."""

    def runs(h: Column) -> Column:
        out = F.slice(h, F.lit(1), F.greatest(F.size(h) - (n - 1), F.lit(0)))
        for k in range(1, n):
            out = F.zip_with(out, F.slice(h, F.lit(k + 1), F.greatest(F.size(h) - (n - 1), F.lit(0))), lambda a, b: F.xxhash64(a, b))
        return F.array_distinct(out)

    return bound(F.transform(tokens, lambda w: F.xxhash64(w)), runs)


def repetition_ratio(tokens: Column, n: int = 3) -> Column:
    """1 - distinct / all n-grams; 0 for fewer than n tokens."""
    return bound(tokens, lambda t: F.when(F.size(t) < n, F.lit(0.0)).otherwise(1 - F.size(F.array_distinct(ngrams(t, n))) / (F.size(t) - (n - 1))))


def count_chars(c: Column, chars: str) -> Column:
    """How many characters of ``chars`` occur."""
    return F.length(c) - F.length(F.translate(c, chars, ""))


def contains_any(c: Column, phrases: list[str]) -> Column:
    """Any phrase occurs as a substring of the lower-cased text."""
    low = F.lower(text(c))
    out = F.lit(False)
    for p in phrases:
        out = out | low.contains(p.lower())
    return out


#: Word bounds where only ASCII letters, digits and _ make words; Java's own \b changed its meaning between versions.
ASCII_BOUND = r"(?-iu:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def first_pattern(c: Column, patterns: list[str], ascii: bool = False) -> Column:
    """The first pattern, in list order, that is found; null if none.

    Case, digits and word bounds by Unicode, as Python has them; ascii: digits and word bounds by ASCII and case by
    simple folding, as RE2 (and so DuckDB) has them."""
    if not ascii:
        return F.coalesce(*[F.when(c.rlike("(?iuU)" + p), F.lit(p)) for p in patterns], F.lit(None).cast("string"))
    folded = F.translate(c, "\u0130\u0131", "\u00b7\u00b7")  # Java folds these to i
    bounds = [re.sub(r"(\\\\)|\\b", lambda m: m[1] or ASCII_BOUND, p) for p in patterns]
    return bound(folded, lambda t: F.coalesce(*[F.when(t.rlike("(?iu)" + b), F.lit(p)) for p, b in zip(patterns, bounds, strict=True)], F.lit(None).cast("string")))


def numbered_items(c: Column, least: int = 10) -> Column:
    """Items of a numbered list that are longer than ``least`` characters, stripped; a decimal parts an item."""
    found = F.regexp_extract_all(text(c), F.lit(r"(?s)\d+\.\s*(.+?)(?=\d+\.|\z)"), 1)
    return F.filter(F.transform(found, strip), lambda x: F.length(x) > least)


def truncate(c: Column, limit: int = 6000, share: float = 0.8) -> Column:
    """At most ``limit`` characters, cut back to the last full stop if that lies beyond ``share`` of the limit."""
    head = F.substring(c, 1, limit)
    stop = F.length(head) - F.locate(".", F.reverse(head))  # 0-based index of the last full stop
    cut = F.when(head.contains(".") & (stop > share * limit), F.substring(head, F.lit(1), (stop + 1).cast("int"))).otherwise(head)
    return F.when(F.length(c) <= limit, c).otherwise(cut)


def preview(c: Column, limit: int = 200) -> Column:
    return F.concat(F.substring(c, 1, limit), F.lit("..."))


def document_count(c: Column, separator: str = "|||||") -> Column:
    """Source documents of a joined text."""
    return F.size(F.split(text(c), "".join("\\" + ch for ch in separator)))


def word_count(c: Column) -> Column:
    return F.size(words(c))
