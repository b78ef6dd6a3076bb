"""String, time and JSON functions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All Unicode white space and the four separators that Python's strip removes as well.
STRIP = r"^[\p{IsWhite_Space}\x1c-\x1f]+|[\p{IsWhite_Space}\x1c-\x1f]+$"
#: A JSON answer, with or without a fence around it.
FENCE = r"(?s)^\s*(?:```(?:json)?\s*)?(.*?)(?:\s*```)?\s*$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(STRIP), F.lit(""))


def or_default(value: Column, default: str) -> Column:
    """Null or empty becomes the default."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def literal_pattern(query: str) -> str:
    """A pattern that matches the query itself: all but word characters and white space is escaped."""
    return re.sub(r"([^\w\s])", r"\\\1", query)


def contains_ci(text: Column, query: str) -> Column:
    """Case-insensitive literal substring; an empty query matches all, null text nothing."""
    return F.contains(F.lower(text), F.lit(query.lower()))


def highlight(text: Column, query: str, before: str = "<b>", after: str = "</b>") -> Column:
    """Markup around every match, the matched text kept; an empty query leaves the text as it is."""
    if not query:
        return text
    return F.regexp_replace(text, F.lit(f"(?iu){literal_pattern(query)}"), F.lit(f"{before}$0{after}"))


def highlight_escaped(text: Column, query: str) -> Column:
    """The same for HTML: matches are marked by two private characters, which text loses, then all is escaped."""
    marked = highlight(F.translate(text, "\ue000\ue001", ""), query, "\ue000", "\ue001")
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\ue000", "<b>"), ("\ue001", "</b>")):
        marked = F.replace(marked, F.lit(plain), F.lit(safe))
    return marked


def minutes_seconds(ms: Column) -> Column:
    """MM:SS of an offset; wraps at one hour."""
    return F.format_string("%02d:%02d", F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60)


def stem(name: Column) -> Column:
    """A file name up to its first dot."""
    return F.substring_index(name, ".", 1)


def extension(name: Column) -> Column:
    """The last dot and what follows; empty for names that only begin with dots."""
    return F.regexp_extract(name, r"[^/.][^/]*?(\.[^./]*)$", 1)


def bullets(items: Column, mark: str = "- ") -> Column:
    return F.transform(items, lambda x: F.concat(F.lit(mark), x))


def not_blank(items: Column) -> Column:
    """Items that are neither null nor blank, themselves unchanged."""
    return F.filter(items, lambda x: x.isNotNull() & (strip(x) != ""))


def fill(template: str, **parts: Column) -> Column:
    """The template with each {name} replaced once; braces inside the parts stay."""
    out, at = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m[1] in parts:
            out += [F.lit(template[at : m.start()]), F.coalesce(parts[m[1]], F.lit(""))]
            at = m.end()
    return F.concat(*out, F.lit(template[at:]))
