"""Regular expressions of schema paths, tried in Arrow batches."""

from __future__ import annotations

import re
import sys

import pandas as pd
from pyspark import cloudpickle

from structmine.functions.paths import ADDITIONAL_KEY, PATTERN_KEY

# Workers need no installed copy of the package: the functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def compiled(pattern):
    """The expression, or None where the text is none."""
    try:
        return re.compile(pattern)
    except (re.error, RecursionError, OverflowError):
        return None


def readable(patterns: pd.Series) -> pd.Series:
    return pd.Series([compiled(p) is not None for p in patterns], dtype=bool)


def all_fit(schema_paths: pd.Series, paths: pd.Series) -> pd.Series:
    """Whether every pattern of a schema path matches the whole key at its place."""

    known = {}

    def fits(schema_path, path):
        for key, found in zip(schema_path, path):
            if key.startswith(PATTERN_KEY) and key != ADDITIONAL_KEY:
                if key not in known:
                    known[key] = compiled(key[len(PATTERN_KEY) :])
                pattern = known[key]
                if pattern is None or not pattern.fullmatch(found):
                    return False
        return True

    return pd.Series([fits(s, p) for s, p in zip(schema_paths, paths)], dtype=bool)
