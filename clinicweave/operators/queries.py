"""Free-text queries as rows: state, postal code, radius, specialties, requirements, order."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, vocab

# What makes a query urgent, and how a distance is written.
URGENT = r"\b(urgent|urgently|emergency|nearest|nearby|24/7|24x7|round the clock|asap|immediately)\b"
_KM = r"(\d+)\s*(?:km|kms|kilometers|kilometres)\b"


def detect_state(c: Column, strict: bool = False) -> Column:
    """The longest full state name, or else (unless `strict`) the first short word that is an alias."""
    by_length = sorted(vocab.STATES, key=len, reverse=True)
    full = F.coalesce(*(F.when(c.rlike(rf"\b{re.escape(s)}\b".replace(r"\ ", " ")), F.lit(s)) for s in by_length))
    if strict:
        return F.initcap(full)
    valid = {a: s for a, s in vocab.STATE_ALIASES.items() if s in vocab.STATES and len(a) <= 3}
    short = F.filter(F.regexp_extract_all(c, F.lit(r"\b([a-z&]{2,3})\b"), 1), lambda w: w.isin(*valid))
    table = F.create_map(*(F.lit(x) for pair in valid.items() for x in pair))
    return F.initcap(F.coalesce(full, F.try_element_at(table, F.try_element_at(short, F.lit(1)))))


def parse_queries(df: DataFrame, query_col: str = "query", default_km: float = 30.0) -> DataFrame:
    raw = text.strip(F.coalesce(query_col, F.lit("")))
    low = F.lower(raw)
    some = lambda c, p: F.when(F.regexp_extract(c, p, 1) != "", F.regexp_extract(c, p, 1))
    pin, urgent = some(raw, r"\b(\d{6})\b"), low.rlike(URGENT)
    km = F.coalesce(some(low, rf"\bwithin\s+{_KM}"), some(low, rf"\b{_KM}")).cast("double")
    return df.withColumns({
        "state": detect_state(low), "pin": pin, "radius_km": F.coalesce(km, F.when(urgent | pin.isNotNull(), default_km)),
        "specialties": text.tags(low, vocab.SPECIALTIES), "requirements": text.tags(low, vocab.EQUIPMENT),
        "sort": F.when(urgent | pin.isNotNull(), "distance").otherwise("relevance"), "raw_query": raw,
    })
