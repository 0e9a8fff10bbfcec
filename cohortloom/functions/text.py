"""Text cleaning and text predicates."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Texts that stand for "no answer" (compared exactly, case included).
NULL_TOKENS = ("", "declined", "declined to specify", "unknown", "Information Not Available")
# Null strings of the mapping files.
CSV_NULL_TOKENS = ("NA", "", "NULL")


def null_tokens(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS, columns: Iterable[str] | None = None) -> DataFrame:
    """Turn every token into null, in all string columns or in the given ones."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~F.col(c).isin(list(tokens)), F.col(c)) for c in columns})


def null_if_lower(col: Column, token: str) -> Column:
    """Null where the lower-cased text equals `token`."""
    return F.when(F.lower(col) != token, col)


def tidy(col: Column, side: str = "both") -> Column:
    """Lower-case and trim: `left`, `right` or `both`."""
    trims = {"left": F.ltrim, "right": F.rtrim, "both": F.trim}
    return trims[side](F.lower(col))


def joined_key(*parts: Column | str, sep: str = ":") -> Column:
    """`a:b:c`; null if any part is null."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    pieces = [cols[0]]
    for c in cols[1:]:
        pieces += [F.lit(sep), c]
    return F.concat(*pieces)


def any_phrase(col: Column, alternatives: Sequence[Sequence[str]], exact: Sequence[str] = ()) -> Column:
    """True if the lower-cased text holds every word of some alternative, or equals an `exact` text."""
    text = F.lower(col)
    tests = []
    for words in alternatives:
        hit = F.lit(True)
        for word in words:
            hit = hit & text.contains(word)
        tests.append(hit)
    if exact:
        tests.append(text.isin(list(exact)))
    found = tests[0]
    for t in tests[1:]:
        found = found | t
    return found


def keyword_flags(col: Column, words: Iterable[str]) -> dict[str, Column]:
    """`{word: 0/1}`; a missing text gives 0."""
    text = F.lower(col)
    return {w: F.coalesce(text.contains(w), F.lit(False)).cast("int") for w in words}


def regex_flag(pattern: str, *cols: Column) -> Column:
    """1 if the pattern is found in any of the texts, else 0; a missing text never matches."""
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(c.rlike(pattern), F.lit(False))
    return hit.cast("int")


def flag_or_null(col: Column) -> Column:
    """The flag is 1 or not filled in."""
    return (col == 1) | col.isNull()
