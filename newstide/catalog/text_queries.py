"""Queries over texts, dates and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from newstide.catalog.bindings import NEGATIVE, POSITIVE, RELEVANT, RULES, VOTES, articles, as_items, obs, sql, table
from newstide.catalog.registry import query, r6, rounded
from newstide.functions import dates, scores, text
from newstide.functions.scoring import score_lexicon, score_texts, with_sentiment
from newstide.operators.aggregates import entity_comparison
from newstide.operators.dedupe import dedupe_first, duplicate_count
from newstide.operators.sets import duplicated_keys
from newstide.operators.similarity import bags, fold_bags, similar_losers, unit_vectors
from newstide.operators.skew import stored
from newstide.plans.news import NewsPrep, funnel, prepare_news, prepare_news_batch, score_news, tag_long, tag_short

SP = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
STRIP = rf"'^{SP}+|{SP}+$'"


def s_strip(c: str) -> str:
    return f"regexp_replace({c}, {STRIP}, '', 'g')"


def s_squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SP}+', ' ', 'g'))"


def s_html(c: str) -> str:
    return s_squeeze(f"regexp_replace({c}, '<.*?>', '', 'g')")


def s_strict(c: str) -> str:
    drop = r"[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x{85}\p{Z}.,!?:%-]"
    return s_squeeze(f"regexp_replace(regexp_replace({c}, '<[^>]+>', '', 'g'), '{drop}', ' ', 'g')")


def s_any(cols, words) -> str:
    return "(" + " or ".join(f"contains({c}, '{w}')" for w in words for c in cols) + ")"


def s_in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def s_vote(c: str) -> str:
    counts = {e: " + ".join(f"cast(contains(lower({c}), '{w}') as int)" for w in ws) for e, ws in VOTES.items()}
    a, b = counts.values()
    return f"case when {a} > {b} then 'alpha' when {b} > {a} then 'beta' when {a} > 0 then 'both' else 'none' end"


def s_words(c: str) -> str:
    return rf"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]{{2,}}')"


COMBINED = (
    f"concat_ws(' ', nullif({s_strip('title')}, ''), '키워드: ' || nullif({s_strip('keywords')}, ''), "
    f"nullif(substring({s_strip('body')}, 1, 500), ''))"
)


@query("text_required", sql("select doc_id, coalesce(keywords, '') as keywords, title from articles where d is not null and title is not null", "articles"))
def _(spark, sf):
    rows = text.require(articles(spark, sf), ["d", "title"])
    return text.fill_text(rows, ["keywords"]).select("doc_id", "keywords", "title")


@query(
    "length_filters",
    sql(
        f"""select entity, count(*) as n, cast(count(*) filter (where length(body) >= 200) as bigint) as n_body,
        cast(count(*) filter (where length({s_strict('body')}) > 10) as bigint) as n_clean from articles group by entity""",
        "articles",
    ),
)
def _(spark, sf):
    return articles(spark, sf).groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(text.min_length("body", 200)).alias("n_body"),
        F.count_if(text.min_length(text.clean_strict("body"), 11)).alias("n_clean"),
    )


@query(
    "relevant_articles",
    sql(f"select doc_id, publisher from articles where {s_any(['keywords', 'body', 'title'], RELEVANT)}", "articles"),
)
def _(spark, sf):
    return articles(spark, sf).where(text.contains_any(["keywords", "body", "title"], RELEVANT)).select("doc_id", "publisher")


@query(
    "entity_first_match",
    sql(
        "select doc_id, case "
        + " ".join(f"when {s_any(['lower(title)'], ws)} then '{e}'" for e, ws in RULES)
        + " end as tag from articles",
        "articles",
    ),
)
def _(spark, sf):
    return articles(spark, sf).select("doc_id", text.entity_first_match("title", RULES).alias("tag"))


@query("entity_vote", sql(f"select doc_id, {s_vote('body')} as tag from articles", "articles"))
def _(spark, sf):
    return articles(spark, sf).select("doc_id", text.entity_vote("body", VOTES).alias("tag"))


@query(
    "date_parsing",
    sql(
        """select obs_id, cast(case when instr(head, '-') = 0 and length(head) = 8
          then substring(head, 1, 4) || '-' || substring(head, 5, 2) || '-' || substring(head, 7, 2) else head end as varchar) as standard,
          coalesce(cast(try_strptime(raw, '%Y-%m-%d') as date), cast(try_strptime(raw, '%Y%m%d') as date),
                   cast(try_strptime(raw, '%m/%d/%Y') as date), cast(try_strptime(raw, '%Y-%m-%d %H:%M:%S') as date)) as parsed,
          strftime(d, '%Y-%m-%d') as iso
        from (select *, split_part(raw, ' ', 1) as head from styled)""",
        "obs",
        """styled as (select obs_id, d, case obs_id % 4 when 0 then strftime(d, '%Y-%m-%d') when 1 then strftime(d, '%Y%m%d')
          when 2 then strftime(d, '%m/%d/%Y') else strftime(d, '%Y-%m-%d') || ' 09:30:00' end as raw from obs)""",
    ),
)
def _(spark, sf):
    style = F.col("obs_id") % 4
    raw = (
        F.when(style == 0, F.date_format("d", "yyyy-MM-dd"))
        .when(style == 1, F.date_format("d", "yyyyMMdd"))
        .when(style == 2, F.date_format("d", "MM/dd/yyyy"))
        .otherwise(F.concat(F.date_format("d", "yyyy-MM-dd"), F.lit(" 09:30:00")))
    )
    return obs(spark, sf).withColumn("raw", raw).select(
        "obs_id",
        dates.standardize_date(F.col("raw")).alias("standard"),
        dates.parse_date(F.col("raw")).alias("parsed"),
        dates.iso_date(F.col("d")).alias("iso"),
    )


@query("clean_html", f"select page_id, {s_html('html')} as cleaned from pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.clean_html("html").alias("cleaned"))


@query("clean_strict", f"select page_id, {s_strict('html')} as cleaned from pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.clean_strict("html").alias("cleaned"))


@query(
    "combined_text",
    sql(
        f"select doc_id, {COMBINED} as combined, title || ' 키워드:' || keywords as short_text, substring(body, 1, 512) as model_input from articles",
        "articles",
    ),
)
def _(spark, sf):
    return articles(spark, sf).select(
        "doc_id",
        text.combine_text("title", "keywords", "body").alias("combined"),
        text.title_keywords("title", "keywords").alias("short_text"),
        text.truncate("body").alias("model_input"),
    )


@query(
    "probability_scores",
    sql(
        """select obs_id, round(least(5e0, greatest(1e0, 3 + 2 * (p - n))), 6) as score_diff,
          round(least(5e0, greatest(1e0, 1 * n + 3 * u + 5 * p)), 6) as score_weighted,
          case when p >= u and p >= n then 'positive' when u >= n then 'neutral' else 'negative' end as top_label,
          round(least(5e0, greatest(1e0, case when p >= u and p >= n then 3 + 2 * p when u >= n then 3e0 else 3 - 2 * n end)), 6)
            as score_single
        from (select obs_id, a / (a + b + c) as p, b / (a + b + c) as u, c / (a + b + c) as n from weights)""",
        """weights as (select o_orderkey as obs_id, cast(z % 97 + 1 as double) as a, cast(z % 89 + 1 as double) as b,
          cast(z % 83 + 1 as double) as c from (select o_orderkey, cast(round(o_totalprice * 100) as bigint) as z from orders))""",
    ),
)
def _(spark, sf):
    z = F.round(F.col("o_totalprice") * 100).cast("long")
    a, b, c = ((z % m + 1).cast("double") for m in (97, 89, 83))
    probs = F.create_map(
        F.lit("positive"), a / (a + b + c), F.lit("neutral"), b / (a + b + c), F.lit("negative"), c / (a + b + c)
    )
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("obs_id"), probs.alias("probs"))
    rows = rows.withColumn("top_label", scores.argmax_label(F.col("probs")))
    top = F.try_element_at("probs", F.col("top_label"))
    return rows.select(
        "obs_id",
        r6(scores.score_diff(F.col("probs"))).alias("score_diff"),
        r6(scores.score_weighted(F.col("probs"))).alias("score_weighted"),
        "top_label",
        r6(scores.score_single(F.col("top_label"), top)).alias("score_single"),
    )


@query(
    "neutral_default",
    sql(
        """select label, count(*) as n, round(avg(score), 6) as mean_score from (
          select case when q is null then 'neutral' when q = 1 then 'positive' else 'negative' end as label,
                 case when q is null then 3e0 when q = 1 then 5e0 else 1e0 end as score
          from documents left join (select doc_id as id, quality as q from labels) on doc_id = id) group by label"""
    ),
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    judged = docs.join(table(spark, sf, "labels"), "doc_id", "left")
    score = F.when(F.col("quality") == 1, 5.0).when(F.col("quality") == 0, 1.0)
    label = F.when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "negative")
    score, label = scores.neutral_default(score, label)
    return rounded(
        judged.select(score.alias("score"), label.alias("label"))
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))
    )


@query(
    "year_slice",
    sql("select entity, count(*) as n, min(d) as first_day, max(d) as last_day from obs where year(d) = 1998 group by entity", "obs"),
)
def _(spark, sf):
    return as_items(dates.year_slice(table(spark, sf, "orders"), "o_orderdate", 1998)).groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"), F.min("d").alias("first_day"), F.max("d").alias("last_day")
    )


@query(
    "calendar_features",
    sql(
        """select d, cast(year(d) as int) as year, cast(month(d) as int) as month, cast(quarter(d) as int) as quarter, cast(dayofyear(d) as int) as day_of_year, cast(week(d) as int) as week_of_year,
          cast(month(d) in (3, 6, 9, 12) as int) as is_quarter_end, cast(month(d) = 12 as int) as is_year_end,
          cast(month(d) in (9, 10, 11) as int) as is_season,
          round(sin(2 * pi() * month(d) / 12), 6) + 0e0 as month_sin, round(cos(2 * pi() * month(d) / 12), 6) + 0e0 as month_cos,
          round(sin(2 * pi() * quarter(d) / 4), 6) + 0e0 as quarter_sin, round(cos(2 * pi() * quarter(d) / 4), 6) + 0e0 as quarter_cos,
          cast(date_trunc('month', d) as date) as month_key
        from (select distinct d from obs)""",
        "obs",
    ),
)
def _(spark, sf):
    days = obs(spark, sf).select("d").distinct()
    out = rounded(dates.calendar_features(days, "d").withColumn("month_key", dates.month_key(F.col("d"))))
    zero = ["month_sin", "month_cos", "quarter_sin", "quarter_cos"]
    return out.withColumns({c: F.col(c) + F.lit(0.0) for c in zero})


@query(
    "finite_ratio",
    sql(
        """select l_orderkey, l_linenumber, round(case when l_discount = 0 then null else l_tax / l_discount end, 6) as ratio
        from lineitem"""
    ),
)
def _(spark, sf):
    x = table(spark, sf, "lineitem")
    ratio = scores.finite(F.try_divide("l_tax", "l_discount"))
    return x.select("l_orderkey", "l_linenumber", r6(ratio).alias("ratio"))


@query(
    "product_category",
    """select p_partkey, category, cast(case category when 'metal' then 0 when 'small' then 1 when 'tint' then 2 else 3 end as integer) as code
    from (select p_partkey, case when contains(lower(p_name), 'bolt') or contains(lower(p_name), 'nut') then 'metal'
      when contains(lower(p_name), 'small') then 'small'
      when contains(lower(p_name), 'red') or contains(lower(p_name), 'blue') then 'tint' else 'Unknown' end as category from part)""",
)
def _(spark, sf):
    rules = (("metal", ("bolt", "nut")), ("small", ("small",)), ("tint", ("red", "blue")))
    return (
        table(spark, sf, "part")
        .select("p_partkey", text.product_category("p_name", rules).alias("category"))
        .withColumn("code", text.category_code("category", [name for name, _ in rules]))
    )


LEXICON = f"""lexicon as (select *, cast(len(list_filter(ws, lambda w: w in {s_in(POSITIVE)})) as double) as p,
  cast(len(list_filter(ws, lambda w: w in {s_in(NEGATIVE)})) as double) as n from (select *, {s_words('body')} as ws from articles)),
 scored as (select *, 1e0 * n / (p + n + 1) + 3e0 * (1 / (p + n + 1)) + 5e0 * p / (p + n + 1) as score,
  case when p >= 1 and p >= n then 'positive' when n <= 1 then 'neutral' else 'negative' end as label from lexicon)"""


@query("lexicon_sentiment", sql("select doc_id, round(score, 6) as score, label from scored", "articles", LEXICON))
def _(spark, sf):
    scored = score_lexicon(articles(spark, sf), "body", POSITIVE, NEGATIVE)
    return scored.select("doc_id", r6("score").alias("score"), "label")


def _load_counter():
    import re

    word = re.compile(r"\w{2,}")

    def score(batch: list[str]) -> list[dict[str, float]]:
        out = []
        for body in batch:
            ws = word.findall(body.lower())
            p, n = sum(w in POSITIVE for w in ws), sum(w in NEGATIVE for w in ws)
            out.append({"positive": p / (p + n + 1), "neutral": 1 / (p + n + 1), "negative": n / (p + n + 1)})
        return out

    return score


@query(
    "model_sentiment_by_entity",
    sql(
        """select entity, count(*) as n, round(avg(score), 6) as mean_score, round(stddev_samp(score), 6) as std_score,
          round(avg(case when label = 'positive' then 1e0 else 0e0 end), 6) as positive_ratio,
          round(avg(case when label = 'negative' then 1e0 else 0e0 end), 6) as negative_ratio,
          round(100e0 * count(*) / (select count(*) from articles), 6) as share_pct from scored group by entity""",
        "articles",
        LEXICON,
    ),
)
def _(spark, sf):
    scored = with_sentiment(score_texts(articles(spark, sf).select("entity", "body"), "body", _load_counter))
    return rounded(entity_comparison(scored))


SHORT_TAG = "case " + " ".join(f"when {s_any(['lower(t)'], ws)} then '{e}'" for e, ws in RULES) + " end"


@query(
    "scored_news",
    sql(
        """select entity, cast(year(date) as int) as year, label, count(*) as n, round(avg(score), 6) as mean_score, min(date) as first_day from (
          select *, greatest(1e0, least(5e0, 3e0 + 2e0 * (p - n) / (p + n + 1))) as score,
            case when p >= 1 and p >= n then 'positive' when n <= 1 then 'neutral' else 'negative' end as label from counted) group by 1, 2, 3""",
        "articles",
        f"tagged as (select *, d as date, {SHORT_TAG} as tag from (select *, title || ' 키워드:' || keywords as t from articles))",
        f"""counted as (select tag as entity, date, cast(len(list_filter(ws, lambda w: w in {s_in(POSITIVE)})) as double) as p,
          cast(len(list_filter(ws, lambda w: w in {s_in(NEGATIVE)})) as double) as n
          from (select tag, date, {s_words('substring(t, 1, 512)')} as ws from tagged where tag is not null))""",
    ),
)
def _(spark, sf):
    """Tagged news with label and score, summed up as it would be written: by entity and year."""
    rows = articles(spark, sf).select(F.col("d").cast("string").alias("date"), "title", "keywords")
    scored = score_news(rows, _load_counter, RULES)
    return rounded(scored.groupBy("entity", F.year("date").alias("year"), "label").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.min("date").alias("first_day")))


@query(
    "tagged_short_text",
    sql(
        "select doc_id, date, entity from (select doc_id, d as date, case "
        + " ".join(f"when {s_any(['lower(t)'], ws)} then '{e}'" for e, ws in RULES)
        + " end as entity from (select *, title || ' 키워드:' || keywords as t from articles)) where entity is not null",
        "articles",
    ),
)
def _(spark, sf):
    rows = articles(spark, sf).select("doc_id", F.col("d").cast("string").alias("date"), "title", "keywords")
    return tag_short(rows, RULES).select("doc_id", "date", "entity")


@query(
    "tagged_long_text",
    sql(
        f"""select doc_id, date, entity, text from (select doc_id, d as date, {s_vote('c')} as entity, {s_strict('c')} as text
        from (select *, {COMBINED} as c from articles)) where length(text) > 10 and entity in ('alpha', 'beta')""",
        "articles",
    ),
)
def _(spark, sf):
    rows = articles(spark, sf).withColumn("date", F.date_format("d", "yyyyMMdd"))
    return tag_long(rows, VOTES).select("doc_id", "date", "entity", "text")


UNIQUE = "uniq as (select * from (select *, row_number() over (partition by title order by doc_id) as rn from articles) where rn = 1)"


@query("unique_titles", sql("select doc_id, title, d from uniq", "articles", UNIQUE))
def _(spark, sf):
    return dedupe_first(articles(spark, sf), ["title"], ["doc_id"]).select("doc_id", "title", "d")


@query("duplicated_titles", sql("select title, count(*) as n from articles group by title having count(*) > 1", "articles"))
def _(spark, sf):
    return duplicated_keys(articles(spark, sf), ["title"])


@query(
    "duplicate_count",
    sql(
        """select cast(count(*) filter (where n > 1) as bigint) as duplicated_keys, cast(sum(n - 1) as bigint) as surplus_rows
        from (select title, count(*) as n from articles group by title)""",
        "articles",
    ),
)
def _(spark, sf):
    return duplicate_count(articles(spark, sf), ["title"])


def _tfidf(scope: str) -> str:
    """Common tables from ``uniq`` (scope, doc_id, title, d) to ``vec`` (scope, doc_id, token, w)."""
    return f"""terms as (select scope, doc_id, token, count(*) as tf from (select {scope} as scope, doc_id, unnest({s_words('title')}) as token from uniq) group by all),
 vocab as (select scope, token, count(*) as df from terms group by all),
 docs_n as (select {scope} as scope, count(*) as n from uniq group by all),
 raw as (select scope, doc_id, token, tf * (ln((1 + n) / (1e0 + df)) + 1) as w from terms join vocab using (scope, token) join docs_n using (scope)),
 vec as (select scope, doc_id, token, w / sqrt(sum(w * w) over (partition by scope, doc_id)) as w from raw),
 pairs as (select a.doc_id as a_id, b.doc_id as b_id from vec a join vec b on a.scope = b.scope and a.token = b.token and a.doc_id < b.doc_id
   group by all having sum(a.w * b.w) > 0.8),
 losers as (select distinct case when x.d >= y.d then b_id else a_id end as doc_id from pairs
   join articles x on x.doc_id = a_id join articles y on y.doc_id = b_id),
 kept as (select * from uniq where doc_id not in (select doc_id from losers))"""


@query("tfidf_weights", sql("select doc_id, token, round(w, 6) as w from vec", "articles", UNIQUE, _tfidf("0")))
def _(spark, sf):
    rows = dedupe_first(articles(spark, sf), ["title"], ["doc_id"])
    words = bags(rows, "doc_id", "title", "d", None)
    folded = stored(fold_bags(words), "bags")
    vectors = unit_vectors(folded).select("id", F.explode("terms").alias("t"))
    # Rows of one bag share its vector.
    members = words.where(F.size("words") > 0).join(folded.select("words", "id"), "words").select(
        words["id"].alias("doc_id"), folded["id"].alias("id")
    )
    return members.join(vectors, "id").select("doc_id", "t.token", r6("t.w").alias("w"))


@query("similar_titles", sql("select doc_id, d from uniq where doc_id in (select doc_id from losers)", "articles", UNIQUE, _tfidf("0")))
def _(spark, sf):
    rows = dedupe_first(articles(spark, sf).select("doc_id", "title", "d"), ["title"], ["doc_id"])
    return similar_losers(rows, "doc_id", "title", "d").select("doc_id", "d")


PREP = NewsPrep(date="d_text", relevant=RELEVANT)


def _raw(spark, sf):
    return articles(spark, sf).withColumn("d_text", F.date_format("d", "yyyyMMdd"))


PASS = f"length(body) >= 200 and {s_any(['keywords', 'body', 'title'], RELEVANT)}"


@query(
    "prepared_news",
    sql(
        f"""select doc_id, strftime(d, '%Y-%m-%d') as d_text, {s_html('title')} as title, {s_html('body')} as body
        from kept where {PASS}""",
        "articles",
        UNIQUE,
        _tfidf("0"),
    ),
)
def _(spark, sf):
    return prepare_news(_raw(spark, sf), PREP).select("doc_id", "d_text", "title", "body")


UNIQUE_BY_FILE = """uniq as (select * from (select *, row_number() over (partition by publisher, title order by doc_id) as rn from articles)
  where rn = 1)"""


@query(
    "prepared_news_batch",
    sql(
        f"""select doc_id, publisher, d as d_text, t as title, b as body from (select *,
          row_number() over (partition by t order by doc_id) as again from (select *, {s_html('title')} as t, {s_html('body')} as b
          from kept where {PASS})) where again = 1""",
        "articles",
        UNIQUE_BY_FILE,
        _tfidf("publisher"),
    ),
)
def _(spark, sf):
    cfg = NewsPrep(date="d_text", relevant=RELEVANT, scope="publisher")
    return prepare_news_batch(_raw(spark, sf), cfg).select("doc_id", "publisher", "d_text", "title", "body")


@query(
    "news_funnel",
    sql(
        f"""select 0 as step, 'input' as stage, count(*) as n from articles union all select 1, 'unique_title', count(*) from uniq
        union all select 2, 'not_similar', count(*) from kept union all select 3, 'long_enough', count(*) from kept where length(body) >= 200
        union all select 4, 'relevant', count(*) from kept where {PASS}""",
        "articles",
        UNIQUE,
        _tfidf("0"),
    ),
)
def _(spark, sf):
    return funnel(_raw(spark, sf), PREP)


