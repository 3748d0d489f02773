"""Opposing assertions among the items of a result."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import DENYING, NO_CONTEXT, STATING, assertion_words, context_words, denies, states, strong_overlap

_PART = re.compile(r"[^\W_]+")


def _polarity(content: str) -> tuple[bool, bool, frozenset[str]]:
    w = [t.lower() for t in _PART.findall(content)]
    around = list(zip([None, *w], w, [*w[1:], None]))
    support = [before == "not" for before, t, _ in around if t in ("support", "supports")]
    must = [after == "not" for _, t, after in around if t == "must"]
    negated = support + must
    return (any(t in STATING for t in w) or not all(negated), any(t in DENYING for t in w) or any(negated), frozenset(w) - frozenset(NO_CONTEXT))


def contradictory(contents: list[str]) -> bool:
    """Whether two contents assert the opposite of much the same thing."""
    seen = [_polarity(c) for c in contents]
    for i, (a_yes, a_no, a) in enumerate(seen):
        for b_yes, b_no, b in seen[i + 1 :]:
            if ((a_yes and b_no) or (a_no and b_yes)) and a and b and len(a & b) * 4 >= max(len(a), len(b)) * 3:
                return True
    return False


def contradictions(items: DataFrame) -> DataFrame:
    """Pairs (query_id, a, b) of positions whose contents contradict.

    ``items``: query_id, position, content. A query has at most a hundred items;
    its pairs are formed by an equi join on the query.
    """
    w = assertion_words(F.coalesce("content", F.lit("")))
    p = items.select("query_id", "position", states(w).alias("yes"), denies(w).alias("no"), context_words(w).alias("ctx")).filter("yes OR no")
    a, b = p.alias("a"), p.alias("b")
    opposed = (F.col("a.yes") & F.col("b.no")) | (F.col("a.no") & F.col("b.yes"))
    return (
        a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.position") < F.col("b.position")) & opposed & strong_overlap(F.col("a.ctx"), F.col("b.ctx")))
        .select(F.col("a.query_id").alias("query_id"), F.col("a.position").alias("a"), F.col("b.position").alias("b"))
    )
