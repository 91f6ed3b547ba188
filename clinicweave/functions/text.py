"""Column functions over facility texts: cleaning, tags, tokens, sentences, citations."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def flatten_json_list(c: Column) -> Column:
    """A JSON list as its non-empty items joined by spaces; anything else trimmed but unchanged."""
    c = strip(F.coalesce(c, F.lit("")))
    items = F.filter(F.from_json(c, "array<string>"), lambda x: x.isNull() | (x != ""))
    return F.when(c.rlike(r"(?s)^\[.*\]$"), F.coalesce(F.array_join(items, " ", "null"), c)).otherwise(c)


def clean_pin(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\.0$", ""))


def split_camel(c: Column) -> Column:
    """Spaces at camelCase borders; null gives an empty text."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "([a-z0-9])(?=[A-Z])", "$1 ")
    return F.regexp_replace(c, "([A-Z])(?=[A-Z][a-z])", "$1 ")


def implied(terms: dict[str, list[str]]) -> dict[str, list[str]]:
    """The tags of each word: its own and those of every word that it begins with."""
    words = {w for ws in terms.values() for w in ws}
    begins = lambda w, v: w == v or w.startswith(v) and not (w[len(v)].isalnum() or w[len(v)] == "_")
    return {w: sorted(tag for tag, ws in terms.items() if any(begins(w, v) for v in ws)) for w in words}


def tags(c: Column, terms: dict[str, list[str]]) -> Column:
    """Sorted names of the terms of which any word occurs.

    One pattern looks at each place once, without moving on: the longest word that starts there
    stands for the shorter ones it begins with, and words that overlap it are found at their own place.
    """
    table = implied(terms)
    words = sorted(table, key=lambda w: (-len(w), w))
    found = F.regexp_extract_all(F.lower(split_camel(c)), F.lit(r"\b(?=(" + "|".join(re.escape(w).replace(r"\ ", " ") for w in words) + r")\b)"), 1)
    lookup = F.create_map(*(x for w in words for x in (F.lit(w), strings(table[w]))))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.array_distinct(found), lambda w: F.try_element_at(lookup, w)))))


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def normal_state(c: Column, aliases: dict[str, str] = vocab.STATE_ALIASES) -> Column:
    """Lower-case state name with short forms written out; empty: null."""
    key = F.lower(strip(c))
    table = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.when(key != "", F.coalesce(F.try_element_at(table, key), key))


def tokens(c: Column, stop: list[str] = vocab.STOPWORDS) -> Column:
    """Lower-case words of letters and digits in order, duplicates kept, stop words left out."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*stop))


def sentences(c: Column) -> Column:
    """Sentences longer than four characters, cut at full stops, new lines and bars."""
    parts = F.split(F.coalesce(c, F.lit("")), r"(?<=[.!?])\s+|\n+|\|")
    return F.filter(F.transform(parts, lambda s: F.btrim(s, F.lit(" -•·\t,;"))), lambda s: F.length(s) > 4)


def gather(*fields: Column) -> Column:
    """Fields that say something, camelCase split, joined as sentences."""
    kept = F.array(*(F.when(~strip(F.coalesce(f, F.lit(""))).isin(*vocab.BLANKS), split_camel(strip(f))) for f in fields))
    return F.array_join(F.array_compact(kept), ". ")


def shortest_with(found: Column, needles: Column) -> Column:
    """The shortest sentence that contains a needle, the first of equals, cut to 240 characters."""
    hit = F.filter(found, lambda s: F.exists(needles, lambda n: F.contains(F.lower(s), n)))
    ranked = F.transform(hit, lambda s, i: F.struct(F.length(s).alias("n"), i.alias("i"), s.alias("s")))
    return F.substring(F.array_min(ranked)["s"], 1, 240)


def shorten(c: Column, n: int = 240) -> Column:
    c = strip(c)
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, n - 1), r"\s+$", ""), F.lit("...")))


def has_content(*fields: Column) -> Column:
    out = F.lit(False)
    for f in fields:
        out = out | ~strip(F.coalesce(f, F.lit(""))).isin(*vocab.BLANKS)
    return out


def needles(found: Column, terms: dict[str, list[str]]) -> Column:
    """All words of the tags in `found`."""
    table = F.create_map(*(x for tag, words in terms.items() for x in (F.lit(tag), strings(words))))
    return F.flatten(F.transform(found, lambda t: F.coalesce(F.try_element_at(table, t), F.array(t))))
