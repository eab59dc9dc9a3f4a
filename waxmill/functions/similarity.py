"""Matching-blocks similarity of texts, in Arrow batches."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def matching_ratio(a: Column, b: Column, autojunk: bool = True) -> Column:
    """Twice the characters in matching blocks over all characters (Ratcliff and Obershelp), 1.0 for two empty texts, null if either is null.

    autojunk: pass over characters that are very frequent in a long second text, which is quicker and gives other ratios.
    """

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        out, matcher, last = [], SequenceMatcher(None, autojunk=autojunk), None
        for s, t in zip(x, y, strict=True):
            if s is None or t is None:
                out.append(None)
                continue
            if t != last:
                matcher.set_seq2(t)
                last = t
            matcher.set_seq1(s)
            out.append(matcher.ratio())
        return pd.Series(out, dtype="float64")

    # so that filters on the ratio don't compute it again
    return ratio.asNondeterministic()(a, b)
