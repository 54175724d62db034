"""Finding vocabulary terms in text, and shares of required terms."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let

#: Up to so many terms are tested as literals; larger vocabularies go through one automaton pass a text.
LITERALS = 200


def match_substring(text: Column, vocabulary: list[str]) -> Column:
    """Sorted terms that occur anywhere in the lower-cased text."""
    return match_bounded(text, vocabulary, short=0)


def match_bounded(text: Column, vocabulary: list[str], short: int = 3) -> Column:
    """As match_substring(), but terms of up to `short` characters must stand between word boundaries (places where one
    side is a letter of a-z, a digit or an underscore and the other isn't)."""
    terms = sorted({v for v in vocabulary if v})
    if not terms:
        return F.array().cast("array<string>")
    low = F.lower(F.coalesce(text, F.lit("")))
    if len(terms) > LITERALS:
        return automaton_match(terms, short)(low)

    def test(t: Column, v: str) -> Column:
        if len(v) > short:
            return F.contains(t, F.lit(v))
        return F.contains(t, F.lit(v)) & F.regexp_like(t, F.lit(rf"{_edge(v[0])}{re.sub(r'([^A-Za-z0-9_])', r'\\\1', v)}{_edge(v[-1], True)}"))

    # the text is lower-cased (and whatever it is made of computed) once, not once a term
    return let(low, lambda t: F.array_compact(F.array(*[F.when(test(t, v), F.lit(v)) for v in terms])))


_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


def _edge(char: str, after: bool = False) -> str:
    """A word boundary beside this character of a term, spelled out: engines and versions disagree about the short form."""
    look = "(?" if after else "(?<"
    return f"{look}![A-Za-z0-9_])" if char in _WORD else f"{look}=[A-Za-z0-9_])"


def automaton_match(terms: list[str], short: int = 0):
    """All terms in one pass over each text, by Arrow batches; terms of up to `short` characters between boundaries."""
    @F.pandas_udf("array<string>")
    def find(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        known = ahocorasick.Automaton()
        for t in terms:
            known.add_word(t, t)
        known.make_automaton()

        def stands(text: str, last: int, term: str) -> bool:
            first = last - len(term) + 1
            before, after = text[first - 1 : first] if first else "", text[last + 1 : last + 2]
            return (before in _WORD) != (term[0] in _WORD) and (after in _WORD) != (term[-1] in _WORD)

        for texts in parts:
            yield texts.map(lambda t: sorted({hit for last, hit in known.iter(t or "") if len(hit) > short or stands(t, last, hit)}))

    return find


def coverage(have: Column, required: Column) -> Column:
    """Share of required terms that are there; 0 if none is required."""
    n = F.size(F.coalesce(required, F.array().cast("array<string>")))
    both = F.size(F.array_intersect(F.coalesce(have, F.array().cast("array<string>")), F.coalesce(required, F.array().cast("array<string>"))))
    return F.when(n > 0, both / n).otherwise(F.lit(0.0))


def skill_sets(bridge: DataFrame, dictionary: DataFrame, key: str, code: str = "skill_abr", name: str = "skill_name") -> DataFrame:
    """Rows (key, skills): the sorted lower-cased names of each key's codes. Unknown codes are skipped; of a code that
    the dictionary repeats, the greatest name counts."""
    names = dictionary.filter(F.col(name).isNotNull()).groupBy(code).agg(F.lower(F.max(name)).alias("__name"))
    return bridge.join(names, code).groupBy(key).agg(F.array_sort(F.collect_set("__name")).alias("skills"))
