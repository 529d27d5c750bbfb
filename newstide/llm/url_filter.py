"""URL filter: host and path rules, and for other URLs a logistic regression on hashed character n-grams.

Everything is a column expression. The regression is fitted by Spark ML on a small labelled table; its coefficients are
one array literal of fixed length in the scoring expression, so pages are never joined or shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 4096
GRAMS = (3, 4, 5)
#: Words of unwanted and of ordinary hosts and paths, from which the labelled table is made.
UNWANTED = """adult casino porn xxx sex escort viagra pills poker bets slots lottery warez torrent cracked malware phishing spam ads track
    meds pharmacy xanax tramadol cialis nude erotic hentai camgirls stripper gambling roulette blackjack jackpot betting keygen serials piracy trojan botnet
    replica counterfeit payday quickloan clickbait popunder adserver banners hookup milf fetish""".split()
ORDINARY = """news blog wiki school museum library recipes garden travel science history weather sports music theatre bridge river market people work
    essex sussex middlesex classic adsl cocktail therapist analysis assets passage specialist socialism shuttle medieval bettany lotus pokemon torrens crackle
    adventure addition broadsheet trackless sextant escorial slotted betaversion pillow casing spamalot lotto1900 nudge pharos""".split()
ENDINGS = "com net org".split()
SYLLABLES = "an at ber da el en er ha in is ka la li lo ma mo na no on or ra re ri sa ser sh st ta ter th ti to un ver".split()


@dataclass(frozen=True)
class Rule:
    """``block`` or ``allow`` for a host with all its subdomains and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


#: Forms of URLs. Each is filled alike for both labels, so that only words tell them apart.
FORMS = (
    "https://{w}.example.{e}/{l}/{n}",
    "http://{sub}{w}-{x}.example.{e}/{l}/{n}.html",
    "https://{x}-{w}.site.{e}/{l}/{n}?page=2",
    "http://www.{w}{n}.{e}/",
    "https://{sub}top{w}.store.{e}/{l}/{n}/",
    "https://{x}.page.{e}/{w}/{n}",
)


def labelled_urls() -> list[tuple[str, int]]:
    """The default training table, made from the word lists: 1 is unwanted. Hosts of mere syllables are ordinary."""
    name = lambda k: "".join(SYLLABLES[(k * step + k // 7) % len(SYLLABLES)] for step in (1, 5, 11)[: 2 + k % 2])
    out = []
    for k in range(max(len(UNWANTED), len(ORDINARY))):
        bad, good = UNWANTED[k % len(UNWANTED)], ORDINARY[k % len(ORDINARY)]
        for j, form in enumerate(FORMS):
            at = 7 * k + j
            filled = {"e": ENDINGS[at % 3], "l": ("en", "de", "fr", "es")[at % 4], "n": 977 * at % 49999, "x": name(at + 500), "sub": ("", "www.", "m.", "blog.")[at // 3 % 4]}
            out += [(form.format(w=w, **filled), y) for w, y in ((bad, 1), (good, 0), (name(at), 0), (name(5 * at + 3), 0))]
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z as a-z) and path; both are empty without a ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    lower = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def grams(host: Column, path: Column) -> Column:
    """Distinct buckets of the n-grams of host and path; the ends of both count as characters."""

    def of(text: Column, n: int, kind: str) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda k: F.pmod(F.xxhash64(F.lit(kind), F.substring(text, k, F.lit(n))), F.lit(BUCKETS)).cast("int"))
        return F.when(F.length(text) >= n, cut).otherwise(F.array().cast("array<int>"))

    parts = [of(F.concat(F.lit("^"), part, F.lit("$")), n, kind) for kind, part in (("h", host), ("p", path)) for n in GRAMS]
    return F.array_distinct(F.concat(*parts))


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    offset: float


def fit(spark: SparkSession, labelled: Sequence[tuple[str, int]] | DataFrame | None = None, rounds: int = 50, ridge: float = 0.0003) -> Model:
    """Fit on a small labelled table (url, label 1 for unwanted). Rows without a URL or label take no part.

    Without rows of both labels the model gives every URL the share of unwanted ones.
    """
    if labelled is None:
        labelled = labelled_urls()
    table = labelled if isinstance(labelled, DataFrame) else spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(u).alias("url"), F.lit(y).alias("label")) for u, y in labelled])))
    table = table.where("url is not null and label is not null")
    host, path = host_and_path(F.col("url"))
    dense = lambda g: F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda k: F.array_contains(g, k).cast("double"))
    rows = table.select(F.col("label").cast("double").alias("label"), array_to_vector(F.transform(F.array(grams(host, path)), dense)[0]).alias("features"))
    share = rows.agg(F.avg("label")).first()[0]
    if share in (None, 0.0, 1.0):
        return Model((0.0,) * BUCKETS, 30.0 if share == 1.0 else -30.0)
    found = LogisticRegression(maxIter=rounds, regParam=ridge, standardization=False).fit(rows)
    return Model(tuple(float(x) for x in found.coefficients), float(found.intercept))


def score(host: Column, path: Column, model: Model) -> Column:
    """The probability that a URL is unwanted; 0 for one without host and path."""
    weights = F.split(F.lit(",".join(map(repr, model.weights))), ",").cast("array<double>")
    total = F.aggregate(grams(host, path), F.lit(model.offset), lambda s, g: s + F.get(weights, g))
    return F.when((host == "") & (path == ""), 0.0).otherwise(1 / (1 + F.exp(-total)))


def judge(pages: DataFrame, model: Model | None = None, rules: Sequence[Rule] = RULES, url: str = "url", limit: float = 0.5) -> DataFrame:
    """Add host, path, rule (null if none fits), score and verdict (``allow`` or ``block``).

    The longest rule that fits decides, of equally long ones the first; else ``score`` at ``limit`` or above blocks. A null URL or one without
    ``://`` has neither host nor path and is allowed. Columns already called so are replaced, all others stay. Rows
    are independent of each other.
    """
    model = model or fit(pages.sparkSession)
    host, path = host_and_path(F.col(url))
    out = pages.withColumns({"host": host, "path": path})
    fits = lambda r: ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
    ordered = sorted(rules, key=lambda r: -len(r.text))
    pick = lambda what: reduce(lambda c, r: c.when(fits(r), F.lit(what(r))), ordered, F.when(F.lit(False), F.lit(None).cast("string")))
    out = out.withColumns({"rule": pick(lambda r: r.text), "score": score(F.col("host"), F.col("path"), model)})
    return out.withColumn("verdict", F.coalesce(pick(lambda r: r.verdict), F.when(F.col("score") >= limit, "block").otherwise("allow")))
