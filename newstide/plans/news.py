"""News preparation and scoring pipelines."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newstide.functions import words
from newstide.functions.dates import parse_date, standardize_date
from newstide.functions.scoring import Scorer, score_texts, with_sentiment
from newstide.functions.text import (
    clean_html,
    clean_strict,
    combine_text,
    contains_any,
    entity_first_match,
    entity_vote,
    let,
    min_length,
    title_keywords,
)
from newstide.operators.dedupe import dedupe_first
from newstide.operators.similarity import Similarity, similar_survivors
from newstide.operators.skew import stored


@dataclass(frozen=True)
class NewsPrep:
    """Columns and limits of the preparation. ``order`` is a unique number giving the input order."""

    order: str = "doc_id"
    date: str = "date"
    title: str = "title"
    body: str = "body"
    keywords: str = "keywords"
    scope: str | None = None
    min_body: int = 200
    relevant: Sequence[str] = words.RELEVANT
    similarity: Similarity = field(default_factory=Similarity)


def _passes(cfg: NewsPrep) -> dict[str, Column]:
    texts = [cfg.keywords, cfg.body, cfg.title]
    return {
        "long_enough": min_length(cfg.body, cfg.min_body),
        "relevant": contains_any(texts, cfg.relevant) if cfg.relevant else F.lit(True),
    }


def unique_titles(df: DataFrame, cfg: NewsPrep) -> DataFrame:
    keys = [cfg.title] if cfg.scope is None else [cfg.scope, cfg.title]
    return dedupe_first(df, keys, [cfg.order])


def _keys(cfg: NewsPrep) -> list[str]:
    """What the first two stages look at; bodies are read once, by the last join."""
    return [*([cfg.scope] if cfg.scope else []), cfg.order, cfg.title, cfg.date]


def prepare_news(df: DataFrame, cfg: NewsPrep = NewsPrep()) -> DataFrame:
    """Unique titles, no near-duplicate titles, long enough, relevant; then dates and texts are cleaned.

    The order of the stages matters: a short article can eliminate a longer one with a similar title. With ``scope`` (a
    file) the first two stages look at one file at a time.
    """
    unique = stored(unique_titles(df.select(*_keys(cfg)), cfg), "titles")
    kept = similar_survivors(unique, cfg.order, cfg.title, cfg.date, cfg.scope, cfg.similarity)
    rows = df
    for test in _passes(cfg).values():
        rows = rows.where(test)
    rows = rows.join(kept, cfg.order, "left_semi")
    return rows.withColumns(
        {
            cfg.keywords: F.coalesce(cfg.keywords, F.lit("")),
            cfg.date: standardize_date(F.col(cfg.date)),
            cfg.body: clean_html(cfg.body),
            cfg.title: clean_html(cfg.title),
        }
    )


def prepare_news_batch(df: DataFrame, cfg: NewsPrep) -> DataFrame:
    """All files at once: preparation inside each file, then unique titles over all of them and typed dates.

    ``cfg.order`` must number the rows by file first. Sort by date where the result is written.
    """
    prepared = prepare_news(df, cfg)
    return dedupe_first(prepared, [cfg.title], [cfg.order]).withColumn(cfg.date, parse_date(F.col(cfg.date)))


def funnel(df: DataFrame, cfg: NewsPrep) -> DataFrame:
    """Rows left after each stage of ``prepare_news``: (stage, n), stages numbered by ``step``.

    The two de-duplication stages mark rows by their unique number; everything is then counted in one aggregation.
    """
    unique = stored(unique_titles(df.select(*_keys(cfg)), cfg), "titles")
    kept = similar_survivors(unique, cfg.order, cfg.title, cfg.date, cfg.scope, cfg.similarity)
    passes = _passes(cfg)
    verdicts = df.select(cfg.order, *[test.alias(f"_{name}") for name, test in passes.items()])  # texts stay where they are read
    marks = verdicts.join(unique.select(cfg.order, F.lit(True).alias("_u")), cfg.order, "left").join(
        kept.withColumn("_k", F.lit(True)), cfg.order, "left"
    )
    tests = {"unique_title": F.col("_u"), "not_similar": F.col("_k"), **{name: F.col(f"_{name}") for name in passes}}
    steps, so_far = [("input", F.lit(True))], F.lit(True)
    for name, test in tests.items():
        so_far = so_far & F.coalesce(test, F.lit(False))
        steps.append((name, so_far))
    counts = marks.agg(
        F.array(
            *[
                F.struct(F.lit(i).alias("step"), F.lit(name).alias("stage"), F.count_if(test).alias("n"))
                for i, (name, test) in enumerate(steps)
            ]
        ).alias("rows")
    )
    return counts.select(F.explode("rows").alias("r")).select("r.*")


def tag_short(df: DataFrame, rules: Sequence[tuple[str, Sequence[str]]] = words.FIRST_MATCH) -> DataFrame:
    """Title with keywords as text, first-match entity, rows without entity dropped, date as typed date."""
    text = title_keywords("title", "keywords")
    return (
        df.withColumns({"text": text, "date": parse_date(F.col("date"))})
        .withColumn("entity", entity_first_match("text", rules))
        .where(F.col("entity").isNotNull())
    )


def tag_long(df: DataFrame, votes: Mapping[str, Sequence[str]] = words.VOTES, min_chars: int = 11) -> DataFrame:
    """Rows with date and title, combined and cleaned text of more than ten characters, one voted entity.

    Text and entity come out of a generator: a filter on plain columns would be pushed below the projection and
    evaluate both expressions twice.
    """
    combined = combine_text("title", F.coalesce("keywords", F.lit("")), F.coalesce("body", F.lit("")))
    both = let(combined, lambda t: F.struct(clean_strict(t).alias("text"), entity_vote(t, votes).alias("entity")))
    kept = [c for c in df.columns if c not in ("text", "entity")]
    return (
        df.withColumn("date", parse_date(F.col("date")))
        .dropna(subset=["date", "title"])
        .select(*kept, F.inline(F.array(both)))
        .where(min_length("text", min_chars) & F.col("entity").isin(*votes))
    )


def score_news(
    df: DataFrame, load: Callable[[], Scorer], rules: Sequence[tuple[str, Sequence[str]]] = words.FIRST_MATCH
) -> DataFrame:
    """Tagged news with label and score: date, title, keywords, label, score, entity. Write it by entity and year."""
    scored = with_sentiment(score_texts(tag_short(df, rules), "text", load, limit=512), weighted=False)
    return scored.select("date", "title", "keywords", "label", "score", "entity")
