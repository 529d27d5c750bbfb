"""Quality rules: divergence of a document's character classes and common words from those of its language.

Everything is a column expression over the whole text, so a document is judged where it is read. The reference of a language
is the summed histogram of all its documents. A document is compared with its own language; without a reference of it, or with
too short a text, the divergence rule has nothing to say and the document passes it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newstide.operators.skew import stored

#: Frequent words of four languages.
COMMON = {
    "en": "the of and to in a is that for it on with as are this by from was be an".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans sur au par ne il".split(),
    "es": "de la que el en y a los se del las un por con no una su para es lo".split(),
}
#: Classes of characters, frequent ones first. What none of them holds is counted as other.
CLASSES = ("[a-z]", "[\\x20\\x09-\\x0D]", "[A-Z]", "[^\\x00-\\x7F]", "[.,;:!?'\"()\\-]", "[#*$%&|<>]", "[0-9]")
SPACE, SYMBOL = 1, 5
VOCABULARY = sorted({w for words in COMMON.values() for w in words})
SPACES = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rules:
    """Distances above the limits reject. They are judged only where a text is long enough for a stable histogram.

    The distance of common words is taken as a share of that of a text without any. A language has a reference if its documents
    have ``reference_chars`` characters together, and one of common words if these are ``reference_share`` of its words; of more
    than ``languages`` such languages those with the most text have one.
    """

    class_limit: float = 0.3
    class_chars: int = 200
    common_limit: float = 0.975
    common_words: int = 200
    reference_chars: int = 20_000
    reference_share: float = 0.01
    languages: int = 256


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` has lambdas."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """Runs of other characters than ASCII white space."""
    cut = lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+", -1))
    return _once(F.btrim(text, F.lit(SPACES)), cut)


def repeat_words(tokens: Column) -> Column:
    """The number of words inside windows of three words that occur twice or more; overlaps count once."""
    starts = F.sequence(F.lit(0), F.size(tokens) - 3)
    windows = F.when(F.size(tokens) >= 3, F.transform(starts, lambda k: F.struct(F.xxhash64(F.get(tokens, k), F.get(tokens, k + 1), F.get(tokens, k + 2)).alias("g"), k.alias("k"))))
    ordered = F.sort_array(F.coalesce(windows, F.array().cast("array<struct<g:bigint,k:int>>")))
    found = _once(ordered, lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["g"] == x["g"]) | (F.get(s, k + 1)["g"] == x["g"])))
    places = F.sort_array(F.transform(found, lambda x: x["k"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(places, start, lambda s, k: F.struct(k.alias("last"), (s["n"] + F.least(F.lit(3), k - s["last"])).alias("n")), lambda s: s["n"])


def class_counts(text: Column) -> Column:
    """Characters by class: each is cut out of what the classes before it have left."""

    def cut(left: Column, counts: list[Column], classes: Sequence[str]) -> Column:
        if not classes:
            return F.array(*counts, F.length(left).cast("double"))
        return _once(F.regexp_replace(left, classes[0] + "+", ""), lambda rest: cut(rest, [*counts, (F.length(left) - F.length(rest)).cast("double")], classes[1:]))

    return _once(text, lambda t: cut(t, [], CLASSES))


def common_counts(tokens: Column) -> Column:
    def counts(common: Column) -> Column:
        return F.array(*[(F.size(common) - F.size(F.array_remove(common, w))).cast("double") for w in VOCABULARY])

    known = _once(F.filter(tokens, lambda w: w.isin(VOCABULARY)), counts)
    return _once(known, lambda a: F.concat(a, F.array(F.size(tokens) - F.aggregate(a, F.lit(0.0), lambda s, x: s + x))))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _entropy(shares: Column) -> Column:
    """The sum of p log2 p."""
    return F.aggregate(shares, F.lit(0.0), lambda s, p: s + F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def _shares(counts: Column) -> Column:
    return _once(_total(counts), lambda t: F.when(t > 0, F.transform(counts, lambda x: x / t)))


def js_distance(counts: Column, reference: Column, entropy: Column) -> Column:
    """Jensen-Shannon distance, from 0 to 1, of a histogram from the shares ``reference`` with their ``entropy``; null without either.

    The divergence is the entropy of the mean less the mean of the entropies, so each bin costs two logarithms.
    """

    def of(shares: Column) -> Column:
        mean = F.zip_with(shares, reference, lambda p, q: (p + q) / 2)
        return F.sqrt(F.greatest((_entropy(shares) + entropy) / 2 - _entropy(mean), F.lit(0.0)))

    return F.when(reference.isNotNull(), _once(_shares(counts), of))


def plain_js_distance(counts: Sequence[float], reference: Sequence[float]) -> float:
    """The same distance of two histograms given as numbers."""
    total = sum(counts)
    if not total:
        return 0.0
    part = lambda p, m: p * math.log2(p / m) if p > 0 else 0.0
    shares = [(c / total, q) for c, q in zip(counts, reference, strict=True)]
    return math.sqrt(max(0.0, sum((part(p, (p + q) / 2) + part(q, (p + q) / 2)) / 2 for p, q in shares)))


def references(counted: DataFrame, rules: Rules = Rules(), lang: str = "lang") -> DataFrame:
    """By language the shares of classes and common words over all its documents, with their entropies, from ``histograms``.

    At most ``rules.languages`` rows. ``common`` is null for a language that uses too few of the words; ``scale`` is the distance of
    a text without any of them. Documents without a language count for none.
    """
    sizes = {"classes": len(CLASSES) + 1, "common": len(VOCABULARY) + 1}
    sums = counted.where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("lang")).agg(
        *[F.array(*[F.sum(F.col(k)[i]) for i in range(n)]).alias(k) for k, n in sizes.items()]
    )
    enough = sums.withColumn("chars", _total(F.col("classes"))).where(F.col("chars") >= rules.reference_chars)
    top = enough.orderBy(F.col("chars").desc(), "lang").limit(rules.languages)
    shares = top.select("lang", _shares(F.col("classes")).alias("classes"), _shares(F.col("common")).alias("common"))
    known = F.col("common")[len(VOCABULARY)] <= 1 - rules.reference_share
    some = shares.withColumn("common", F.when(known, F.col("common")))
    entropies = some.withColumns({"classes_entropy": _entropy(F.col("classes")), "common_entropy": _entropy(F.col("common"))})
    wordless = F.array(*[F.lit(0.0)] * len(VOCABULARY), F.lit(1.0))
    return entropies.withColumn("scale", js_distance(wordless, F.col("common"), F.col("common_entropy")))


def histograms(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add classes and common, the counts that ``references`` sums up."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"classes": class_counts(whole), "common": _once(words(whole), common_counts)})


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and the histograms classes and common.

    A null or empty text has no words: all counts are 0. Columns already called so are replaced, all others stay.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def measures(tokens: Column) -> Column:
        return F.struct(
            F.size(tokens).cast("long").alias("n_words"),
            _once(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeat_words(tokens).alias("n_repeat_words"),
            common_counts(tokens).alias("common"),
        )

    m = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _once(words(whole), measures).alias("m"), class_counts(whole).alias("c"))
    found = {n: F.col(f"m.{n}") for n in (*MEASURES, "common") if n not in ("word_chars", "n_symbols")}
    found |= {"word_chars": (_total(F.col("c")) - F.col("c")[SPACE]).cast("long"), "n_symbols": F.col("c")[SYMBOL].cast("long"), "classes": F.col("c")}
    both = m.select("row", F.struct(*[found[n].alias(n) for n in (*MEASURES, "classes", "common")]).alias("new"))
    return both.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in found], "new.*")


def judge(measured: DataFrame, refs: DataFrame, rules: Rules = Rules(), lang: str = "lang") -> DataFrame:
    """Add base_failed, class_distance, common_distance and kept to what ``measure`` gives, and drop its histograms.

    Distances are those to the reference of the document's language; they are 0 without one, for a text without characters
    or words, and in a column ``lang`` of nulls. ``common_distance`` is a share of the distance of a text without common words.
    A text without words fails the base rule. Rows are independent of each other but for the references, so repeated rows get
    the same verdict.
    """
    few = F.broadcast(refs.select(F.struct("*").alias("r")))  # bounded by Rules.languages
    rows = measured.select(F.struct(*[F.col(f"`{c}`") for c in measured.columns]).alias("row")).join(few, F.col(f"row.`{lang}`") == F.col("r.lang"), "left")
    row = lambda c: F.col(f"row.{c}")
    distances = rows.select(
        "row",
        F.coalesce(js_distance(row("classes"), F.col("r.classes"), F.col("r.classes_entropy")), F.lit(0.0)).alias("class_distance"),
        F.coalesce(js_distance(row("common"), F.col("r.common"), F.col("r.common_entropy")) / F.col("r.scale"), F.lit(0.0)).alias("common_distance"),
        ((row("n_words") < 50) | (100 * row("n_repeat_words") > 50 * row("n_words"))).alias("base_failed"),
    )
    far = ((_total(row("classes")) >= rules.class_chars) & (F.col("class_distance") > rules.class_limit)) | (
        (row("n_words") >= rules.common_words) & (F.col("common_distance") > rules.common_limit)
    )
    judged = distances.select("row", F.struct("base_failed", "class_distance", "common_distance", (~F.col("base_failed") & ~far).alias("kept")).alias("new"))
    gone = ("classes", "common", "base_failed", "class_distance", "common_distance", "kept")
    return judged.select(*[F.col(f"row.`{c}`") for c in measured.columns if c not in gone], "new.*")


def assess(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang") -> DataFrame:
    """Measures and verdicts with references from the same documents, with their columns but the text.

    The measures are written once to the shared folder; references and verdicts both read them. Columns called like a measure or
    a verdict are replaced, all others stay; an empty table gives an empty result.
    """
    measured = stored(measure(docs, text).drop(text), "measured")
    return judge(measured, references(measured, rules, lang), rules, lang)


def keep_good(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows that ``assess`` would keep, with their own columns, whatever they are called.

    Repeated rows all stay or all go, a null or empty text goes (it fails the base rules), an empty table stays empty. Texts are
    read twice and written nowhere.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    refs = references(histograms(whole), rules)
    return judge(measure(whole), refs, rules).where("kept").select("_row.*")
