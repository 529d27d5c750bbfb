"""Text columns: cleaning, combining, relevance and entity tagging. Everything is a native expression."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The Unicode white-space class (Java's \s is ASCII only) and the punctuation the strict cleaner keeps.
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
STRICT_DROP = r"[^\p{L}\p{N}_.,!?:%-]+"
KEYWORD_LABEL = "키워드:"
WORD = r"[\p{L}\p{N}_]{2,}"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fill_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULL text becomes the empty string."""
    return df.fillna("", subset=list(cols))


def require(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep rows whose required columns are all present."""
    return df.dropna(subset=list(cols))


def strip(c: Column | str) -> Column:
    """Without white space at both ends; looks at the ends only, not at the whole text."""
    return F.btrim(_col(c), F.lit(BLANKS))


def squeeze(c: Column | str) -> Column:
    """Collapse white space to single blanks and trim."""
    return F.trim(F.regexp_replace(_col(c), rf"{SPACE}+", " "))


def min_length(c: Column | str, n: int) -> Column:
    """At least ``n`` characters (code points); NULL counts as empty."""
    return F.length(F.coalesce(_col(c), F.lit(""))) >= n


def contains_any(cols: Sequence[Column | str], keywords: Sequence[str]) -> Column:
    """True when any keyword is a case-sensitive substring of any column."""
    texts = [F.coalesce(_col(c), F.lit("")) for c in cols]
    return reduce(lambda a, b: a | b, [F.contains(t, F.lit(k)) for k in keywords for t in texts])


def entity_first_match(c: Column | str, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """First rule whose keyword occurs in the lower-cased text; NULL when none does."""
    low = F.lower(_col(c))
    hits = [F.when(contains_any([low], words), F.lit(entity)) for entity, words in rules]
    return F.coalesce(*hits)


def entity_vote(c: Column | str, keyword_sets: Mapping[str, Sequence[str]]) -> Column:
    """Entity with the most distinct keywords present; ``both`` on a positive tie, ``none`` without a hit."""
    names = F.array(*[F.lit(e) for e in keyword_sets])

    def votes(low: Column) -> Column:
        return F.array(
            *[
                reduce(lambda a, b: a + b, [F.contains(low, F.lit(w)).cast("int") for w in listed])
                for listed in keyword_sets.values()
            ]
        )

    def decide(n: Column) -> Column:
        best = F.array_max(n)
        leaders = F.size(F.filter(n, lambda v: v == best))
        winner = F.get(names, (F.array_position(n, best) - 1).cast("int"))
        return F.when(best == 0, F.lit("none")).when(leaders > 1, F.lit("both")).otherwise(winner)

    return let(F.lower(F.coalesce(_col(c), F.lit(""))), lambda low: let(votes(low), decide))


def clean_html(c: Column | str) -> Column:
    """Drop tags (within a line), turn line breaks and tabs into blanks, collapse, trim; NULL gives ''."""
    text = F.coalesce(_col(c), F.lit(""))
    return squeeze(F.regexp_replace(text, r"(?d)<.*?>", ""))


def clean_strict(c: Column | str) -> Column:
    """Drop tags (also across lines); every run of characters outside words and ``.,!?:%-`` becomes one blank; trim."""
    text = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"<[^>]+>", "")
    return F.trim(F.regexp_replace(text, STRICT_DROP, " "))


def combine_text(title: Column | str, keywords: Column | str, body: Column | str, n: int = 500) -> Column:
    """Title, labelled keywords and the lead of the body, blank-joined; empty parts are left out."""
    parts = F.array(
        strip(title), F.concat(F.lit(f"{KEYWORD_LABEL} "), F.nullif(strip(keywords), F.lit(""))), F.substring(strip(body), 1, n)
    )
    return F.concat_ws(" ", F.filter(parts, lambda p: p != ""))


def title_keywords(title: Column | str, keywords: Column | str) -> Column:
    blank = F.lit("")
    return F.concat(F.coalesce(_col(title), blank), F.lit(f" {KEYWORD_LABEL}"), F.coalesce(_col(keywords), blank))


def truncate(c: Column | str, n: int = 512) -> Column:
    """First ``n`` characters: the input limit of a scoring model."""
    return F.substring(_col(c), 1, n)


def tokens(c: Column | str) -> Column:
    """Lower-cased words of two or more word characters, in text order."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(WORD), F.lit(0))


def product_category(name: Column | str, rules: Sequence[tuple[str, Sequence[str]]], default: str = "Unknown") -> Column:
    """Category of a product name by ordered keyword rules."""
    return F.coalesce(entity_first_match(name, rules), F.lit(default))


def category_code(category: Column | str, order: Sequence[str]) -> Column:
    """Dense code of a category: its place in ``order``; anything else comes after the last."""
    spot = F.array_position(F.array(*[F.lit(o) for o in order]), _col(category))
    return F.when(spot > 0, spot - 1).otherwise(F.lit(len(order))).cast("int")
