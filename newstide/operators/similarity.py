"""Near-duplicate titles by TF-IDF cosine, resolved in favour of the newer row.

Meaning: for every pair of rows with cosine above the threshold the older one goes (the later one in input order on equal
dates), and a row that goes still eliminates others. Seen from one row: it stays exactly when none of its neighbours
precedes it in the order (newer date first, then input order). That order is total, which allows an exact answer without
listing the similar pairs:

1. Rows with the same bag of words have cosine 1. Only the first of them in the order can stay, and it stands for all
   as an eliminator, so each bag is folded to that one row (map-side).
2. Pruning: rows are put in MinHash buckets and each is compared with one row only, the bucket leader it shares most
   buckets with. Groups of near copies melt here, at one pair a row.
3. Completion: words are ordered from rare to frequent. All words of a row before the second one that it shares with
   another, but the first shared one, are lost to their product. So the first two shared words of two unit vectors above the
   threshold lie where what is lost leaves either vector a norm above it. Rows left by step 2 meet the rows before them
   on such pairs of words, which few unlike rows share; a word whose weight is above the threshold may be the only one
   shared. The two shared words and the norms behind them bound the product. Ids, weights and norms travel with the words,
   vectors never do. Each row first tries its best candidate, and only rows that pass try the others.

Vectors are fetched by id to check a pair, whatever their length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newstide.functions.text import WORD, let, tokens
from newstide.operators.skew import GRID_KEYS, grid_cuts, grid_place, sliced_join, stored

MARGIN = 1e-9  # keeps rounding from shortening a prefix


@dataclass(frozen=True)
class Similarity:
    threshold: float = 0.8
    bands: int = 8
    rows_per_band: int = 2


def _runs(words: str) -> Column:
    """Sorted words to (token, tf) by run lengths."""
    w = F.col(words)
    starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
    return let(
        starts,
        lambda s: F.transform(
            s,
            lambda p, j: F.struct(F.get(w, p).alias("token"), (F.coalesce(F.get(s, j + 1), F.size(w)) - p).alias("tf")),
        ),
    )


def bags(df: DataFrame, row_id: str, text: str, date: str, scope: str | None) -> DataFrame:
    """Scope, id, rank in the keep order (greater precedes) and sorted words of each row."""
    return df.select(
        (F.col(scope) if scope else F.lit(0)).alias("scope"),
        F.col(row_id).alias("id"),
        F.struct(F.col(date).alias("date"), (-F.col(row_id)).alias("place")).alias("rank"),
        F.sort_array(tokens(text)).alias("words"),
    )


def fold_bags(rows: DataFrame) -> DataFrame:
    """One row per scope and bag of words: its first row in the keep order, its number of rows and its word counts.

    Rows without words fold into one row as well; it counts towards the scope but has no vector.
    """
    return (
        rows.groupBy("scope", "words")
        .agg(F.max(F.struct("rank", "id")).alias("first"), F.count(F.lit(1)).alias("copies"))
        .select(
            "scope",
            F.col("first.id").alias("id"),
            F.col("first.rank").alias("rank"),
            "copies",
            "words",
            F.when(F.size("words") > 0, _runs("words")).alias("runs"),
        )
    )


def unit_vectors(folded: DataFrame) -> DataFrame:
    """TF-IDF unit vectors of the folded rows, words from rare to frequent.

    idf = ln((1 + rows) / (1 + rows with the word)) + 1, counted over all rows, not over folded ones.
    """
    terms = folded.select("scope", "id", "copies", F.explode("runs").alias("t")).select(
        "scope", "id", "copies", "t.token", "t.tf"
    )
    rows_in_scope = folded.groupBy("scope").agg(F.sum("copies").alias("rows"))
    words = stored(terms.groupBy("scope", "token").agg(F.sum("copies").alias("df"), F.count(F.lit(1)).alias("n")), "words")
    in_scope = words.groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
    counted = sliced_join(words, rows_in_scope, ["scope"], in_scope, "token")
    idf = counted.select("scope", "token", "df", F.col("n").alias("bags"), (F.log((1 + F.col("rows")) / (1 + F.col("df"))) + 1).alias("idf"))
    weighted = sliced_join(terms, idf, ["scope", "token"], words, "id")
    raw = weighted.groupBy("scope", "id").agg(
        F.sort_array(
            F.collect_list(F.struct("df", "token", "bags", (F.col("tf") * F.col("idf")).alias("w")))
        ).alias("terms")
    )
    norm = F.sqrt(F.aggregate("terms", F.lit(0.0), lambda a, t: a + t["w"] * t["w"]))

    def unit(by: Column) -> Column:
        return F.transform("terms", lambda t: F.struct(t["token"].alias("token"), t["bags"].alias("bags"), (t["w"] / by).alias("w")))

    return raw.select("scope", "id", let(norm, unit).alias("terms"))  # as a column of its own it would be computed for each word


def _prefix(threshold: float) -> Column:
    """(token, bags, w, left, rest) of the words that can be among the first two shared ones, those of one bag left out.

    ``left`` is the squared norm of the words from this one on, ``rest`` the norm of those after it. A second shared word
    needs ``left`` plus the square of the first above the squared threshold; the prefix ends where no first one gives that.
    """
    limit = threshold * threshold - MARGIN
    kind = "struct<left:double,top:double,out:array<struct<token:string,bags:bigint,w:double,left:double,rest:double>>>"

    def longer(a: Column, t: Column) -> Column:
        square, left = t["w"] * t["w"], a["left"]
        word = F.struct(t["token"].alias("token"), t["bags"].alias("bags"), t["w"].alias("w"), left.alias("left"), F.sqrt(F.greatest(left - square, F.lit(0.0))).alias("rest"))
        more = F.struct((left - square).alias("left"), F.greatest(a["top"], square).alias("top"), F.concat(a["out"], F.array(word)).alias("out"))
        return F.when(left + a["top"] > limit, more).otherwise(a)

    def cut(shared: Column) -> Column:
        whole = F.aggregate(shared, F.lit(0.0), lambda a, t: a + t["w"] * t["w"])
        start = F.struct(whole.alias("left"), F.lit(0.0).alias("top"), F.array().alias("out")).cast(kind)
        return F.aggregate(shared, start, longer)["out"]

    return let(F.filter("terms", lambda t: t["bags"] > 1), cut)


def _bands(cfg: Similarity) -> Column:
    """One hash per band over the minima of ``rows_per_band`` hash functions."""

    def least(hashes: Column, seed: int) -> Column:
        return F.array_min(F.transform(hashes, lambda h: F.xxhash64(F.lit(seed), h)))

    def bands(hashes: Column) -> Column:
        size = cfg.rows_per_band
        return F.array(
            *[
                F.xxhash64("scope", F.lit(b), *[least(hashes, seed) for seed in range(b * size, (b + 1) * size)])
                for b in range(cfg.bands)
            ]
        )

    return let(F.transform("terms", lambda t: F.xxhash64(t["token"])), bands)


def _dot(terms: Column, weights: Column) -> Column:
    return F.aggregate(
        terms, F.lit(0.0), lambda a, t: a + t["w"] * F.coalesce(F.try_element_at(weights, t["token"]), F.lit(0.0))
    )


def _as_map(terms: str) -> Column:
    return F.map_from_entries(F.transform(terms, lambda t: F.struct(t["token"].alias("key"), t["w"].alias("value"))))


def _beaten(pairs: DataFrame, vectors: DataFrame, cfg: Similarity) -> DataFrame:
    """The ids of ``pairs`` (id, o_id) whose vectors are above the threshold; an ``o_id`` with many rows is cut in slices."""
    pairs = stored(pairs, "candidates")
    counts = pairs.groupBy("o_id").agg(F.count(F.lit(1)).alias("n"))
    others = vectors.select(F.col("id").alias("o_id"), _as_map("terms").alias("weights")).join(counts.select("o_id"), "o_id", "left_semi")
    rows = pairs.join(vectors.select("id", "terms"), "id")
    close = _dot(F.col("terms"), F.col("weights")) > cfg.threshold
    return sliced_join(rows, others, ["o_id"], counts, "id").where(close).select("id").distinct()


def _prune(vectors: DataFrame, cfg: Similarity) -> DataFrame:
    """Ids beaten by the bucket leader that they share most buckets with."""
    rows = vectors.select("id", "rank", F.explode("bands").alias("bucket"))
    leaders = rows.groupBy("bucket").agg(F.max(F.struct("rank", "id")).alias("top"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    leaders = stored(leaders.select("bucket", F.col("top.id").alias("o_id"), "n"), "leaders")
    met = sliced_join(rows.select("id", "bucket"), leaders.drop("n"), ["bucket"], leaders.drop("o_id"), "id").where("id != o_id")
    shared = met.groupBy("id", "o_id").agg(F.count(F.lit(1)).alias("n"))
    return _beaten(shared.groupBy("id").agg(F.max(F.struct("n", "o_id"))["o_id"].alias("o_id")), vectors, cfg)


def _meeting_words(vectors: DataFrame, cfg: Similarity) -> DataFrame:
    """What each row can meet others on, two words or one that outweighs the rest: alive, id, date, key, at (the first word's
    place, -1 for one alone), w, w2 (of the second), rest (the norm behind it) and tail (that behind the last second word).
    """
    limit = cfg.threshold * cfg.threshold - MARGIN
    first = vectors.select("scope", "alive", "id", F.col("rank.date").alias("date"), "prefix", F.posexplode("prefix").alias("at", "t")).where(F.col("t.left") > limit)
    square = F.col("t.w") * F.col("t.w")
    follow = F.transform(
        F.filter(F.slice("prefix", F.col("at") + 2, F.size("prefix")), lambda u: u["left"] + square > limit),
        lambda u: F.struct(u["token"].alias("token"), u["w"].alias("w2"), u["rest"].alias("rest")),
    )
    follow = let(
        follow,
        lambda f: F.transform(f, lambda u: F.struct(u["token"].alias("token"), F.col("at").alias("at"), u["w2"].alias("w2"), u["rest"].alias("rest"), F.element_at(f, -1)["rest"].alias("tail"))),
    )
    one = F.struct(F.lit(None).cast("string").alias("token"), F.lit(-1).alias("at"), *[F.lit(0.0).alias(c) for c in ("w2", "rest", "tail")])
    alone = F.filter(F.array(one), lambda _: square > limit)
    seconds = F.concat(follow, alone)
    both = first.select("scope", "alive", "id", "date", "t", F.explode(seconds).alias("u"))
    return both.select("alive", "id", "date", F.xxhash64("scope", "t.token", "u.token").alias("key"), F.col("t.w").alias("w"), "u.at", "u.w2", "u.rest", "u.tail")


def _candidates(alive: DataFrame, vectors: DataFrame, cfg: Similarity) -> DataFrame:
    """id, o_id and an upper bound of their product, for pairs of a row of ``alive`` and one before it that may pass the threshold.

    With the first word they share, two rows meet on each further one within reach of both; what may follow lies behind the
    last of these, and for one of them behind its reach. Keys are hashes; rows that meet by a collision fail when their
    vectors are compared.
    """
    living = alive.select("id", F.lit(True).alias("alive"))
    words = _meeting_words(vectors.join(living, "id", "left").withColumn("alive", F.col("alive").isNotNull()), cfg)
    counts = words.groupBy("key").agg(F.count_if("alive").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1 and v > 0")
    counts = stored(counts, "meetings")  # most keys have one row only, which goes no further
    met = stored(sliced_join(words, counts.select("key"), ["key"], counts, "id"), "met")
    cuts = grid_cuts(met.where("alive").select("key"), met.select("key"), ["key"])
    a = grid_place(met.where("alive").drop("alive"), cuts, ["key"], "id", True)
    b = grid_place(met.drop("alive"), cuts, ["key"], "id", False)
    b = b.select("key", *GRID_KEYS, *[F.col(c).alias(f"o_{c}") for c in ("id", "date", "w", "w2", "rest", "tail")])
    rank, o_rank = (F.struct(F.col(f"{o}date").alias("date"), (-F.col(f"{o}id")).alias("place")) for o in ("", "o_"))
    pairs = a.join(b, ["key", *GRID_KEYS]).where(o_rank > rank)
    first = pairs.groupBy("id", "o_id", "at").agg(
        (F.first("w") * F.first("o_w") + F.sum(F.col("w2") * F.col("o_w2"))).alias("sum"),
        F.greatest(F.min("o_rest") * F.first("tail"), F.min("rest") * F.first("o_tail")).alias("more"),
    )
    return first.groupBy("id", "o_id").agg(F.max(F.col("sum") + F.col("more")).alias("bound")).where(F.col("bound") > cfg.threshold - MARGIN)


def _complete(vectors: DataFrame, alive: DataFrame, cfg: Similarity) -> DataFrame:
    """Ids among ``alive`` beaten by any vector sharing a prefix word."""
    found = stored(_candidates(alive, vectors, cfg), "bounds")
    best = found.groupBy("id").agg(F.max(F.struct("bound", "o_id"))["o_id"].alias("o_id"))
    beaten = stored(_beaten(best, vectors, cfg), "beaten")
    others = found.select("id", "o_id").join(beaten, "id", "left_anti").join(best, ["id", "o_id"], "left_anti")
    return beaten.unionByName(_beaten(others, vectors, cfg))


def similar_survivors(
    df: DataFrame, row_id: str, text: str, date: str, scope: str | None = None, cfg: Similarity = Similarity()
) -> DataFrame:
    """Ids that stay. ``row_id`` is a unique number giving the input order; a NULL date counts as oldest.

    Rows without a single word have no similarity to anything and stay.
    """
    rows = bags(df, row_id, text, date, scope)
    folded = stored(fold_bags(rows), "bags")
    vectors = stored(
        unit_vectors(folded)
        .join(folded.select("id", "rank"), "id")
        .withColumns({"prefix": _prefix(cfg.threshold), "bands": _bands(cfg)}),
        "vectors",
    )
    alive = stored(vectors.select("id").join(_prune(vectors, cfg), "id", "left_anti"), "alive")
    beaten = _complete(vectors, alive, cfg)
    kept = alive.join(beaten, "id", "left_anti")
    wordless = df.where(~F.coalesce(F.col(text), F.lit("")).rlike(WORD)).select(F.col(row_id).alias("id"))
    return kept.unionByName(wordless).withColumnRenamed("id", row_id)


def drop_similar(
    df: DataFrame, row_id: str, text: str, date: str, scope: str | None = None, cfg: Similarity = Similarity()
) -> DataFrame:
    return df.join(similar_survivors(df, row_id, text, date, scope, cfg), row_id, "left_semi")


def similar_losers(
    df: DataFrame, row_id: str, text: str, date: str, scope: str | None = None, cfg: Similarity = Similarity()
) -> DataFrame:
    """The rows that ``drop_similar`` drops."""
    return df.join(similar_survivors(df, row_id, text, date, scope, cfg), row_id, "left_anti")
