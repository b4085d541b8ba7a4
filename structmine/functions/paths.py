"""Column expressions over paths, which are ARRAY<STRING> everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from structmine.functions.json_walk import ARRAY_ITEM, TYPE_NAMES

ROOT = "$"

# The names a JSON Schema keeps its reusable parts under.
DEFINITION_KEYWORDS = ("$defs", "definitions")

ADDITIONAL_KEY = "additional_key"
PATTERN_KEY = "pattern_key"


def dotted(path) -> Column:
    """Path as readable text; for output only, keys may hold dots."""
    return F.array_join(path, ".")


def type_names(mask) -> Column:
    """Sorted type names of a type bit mask."""
    mask = F.col(mask) if isinstance(mask, str) else mask
    named = [
        F.when(mask.bitwiseAND(F.lit(bit)) != 0, F.lit(name))
        for bit, name in sorted(TYPE_NAMES.items(), key=lambda item: item[1])
    ]
    return F.array_compact(F.array(*named))


def last_segment(ref) -> Column:
    return F.try_element_at(F.split(ref, "/"), F.lit(-1))


def star_items(path) -> Column:
    """Second path dialect: no root, ``*`` for a list position."""
    body = F.when(F.try_element_at(path, F.lit(1)) == ROOT, F.slice(path, 2, F.size(path))).otherwise(path)
    return F.transform(body, lambda k: F.when(k == ARRAY_ITEM, F.lit("*")).otherwise(k))


def count_subpath(path, needle) -> Column:
    """Overlapping occurrences of ``needle`` inside ``path``; an empty needle fits size + 1 times."""
    path, needle = (F.col(c) if isinstance(c, str) else c for c in (path, needle))
    n, m = F.size(path), F.size(needle)
    hits = F.filter(
        F.sequence(F.lit(1), F.greatest(n - m + 1, F.lit(1))),
        lambda i: F.slice(path, i, F.greatest(m, F.lit(1))) == needle,
    )
    return F.when(m == 0, n + 1).when(n < m, F.lit(0)).otherwise(F.size(hits))


def without_keywords(path, keywords=DEFINITION_KEYWORDS) -> Column:
    return F.filter(path, lambda k: ~k.isin(*keywords))


def is_wildcard(part) -> Column:
    return (part == ADDITIONAL_KEY) | part.startswith(PATTERN_KEY)
