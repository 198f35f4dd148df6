"""Word-share profiles.

The working shape is the long form ``(key, word, cnt, share)``: tokens are
exploded and aggregated by ``(key, word)`` straight away (partial + final
hash aggregation, so a frequent word or a hot key is combined map-side
before the shuffle).  The per-key total is a second aggregate over that
result, joined back; at county grain it is a tiny table that AQE
broadcasts after measuring it, at user grain a sort-merge join that AQE can
split when one user is skewed.  No group is ever collected into a list.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolex.functions import text as tx
from geolex.session import materialize, tasks_for
from geolex.sources.schemas import LEVEL_COLUMNS


def tag_tokens(text: Column) -> Column:
    """Lower-case tokens, each classified once: ``struct(t, c)`` with c =
    0 word, 1 url, 2 emoji."""
    return F.transform(tx.tokens(F.lower(text)), lambda t: F.struct(
        t.alias("t"), F.when(tx.is_url(t), 1).when(tx.is_emoji(t), 2).otherwise(0).alias("c")))


def tag_special(text: Column) -> Column:
    """``tag_tokens`` of a text in which there is a url or an emoji; of any other, whose tokens are all
    words, an empty array.  A text without url and emoji has no token with one, so most texts need
    two searches instead of an array of structs."""
    low = F.lower(text)
    plain = ~((F.instr(low, "://") > 0) | tx.is_emoji(low))
    return F.when(plain, F.filter(F.array(F.struct(F.lit("").alias("t"), F.lit(0).alias("c"))), lambda s: F.lit(False))
                  ).otherwise(tag_tokens(text))


def token_stats(tagged: Column, plain: Column) -> dict[str, Column]:
    """A4 per post from the tagged tokens: word text (``plain`` where none is tagged), url and emoji counts.

    Filters on the class field keep the work linear in tokens even when the
    optimizer inlines ``tagged`` into an output.
    """
    words = F.transform(F.filter(tagged, lambda s: s["c"] == 0), lambda s: s["t"])
    return {
        "filtered_text": F.when(F.size(tagged) == 0, plain).otherwise(F.array_join(words, " ")),
        "url_count": F.size(F.filter(tagged, lambda s: s["c"] == 1)).cast("int"),
        "emoji_count": F.size(F.filter(tagged, lambda s: s["c"] == 2)).cast("int"),
    }


def person_records(posts: DataFrame, levels: DataFrame, stop_words: Iterable[str] | None = None,
                   key: str = "fips", text_col: str = "text", user_col: str = "user_id",
                   keep: Sequence[str] = ()) -> DataFrame:
    """A4 + J7: one person-level record per resolved post.

    ``text`` is the post without stop words (own case, T5); ``filtered_text``
    its lower-case word tokens without url and emoji tokens.  ``levels`` is
    ``(key, education_level_1..4)`` (J7).
    """
    body = tx.strip_stop_words(text_col, stop_words) if stop_words is not None else F.col(text_col)
    base = posts.select(F.col(key).alias("fip"), F.col(user_col).alias("user_id"),
                        body.alias("text"), *keep)
    staged = base.select("fip", "user_id", "text", tag_special(F.col("text")).alias("_tag"), *keep)
    low = F.lower("text")  # without stop words, tokens are already joined by one space
    stats = token_stats(F.col("_tag"), low if stop_words is not None else F.array_join(tx.tokens(low), " "))
    recs = staged.select("fip", "user_id", "text", *[v.alias(k) for k, v in stats.items()], *keep)
    lv = levels.select(F.col(key).alias("fip"), *LEVEL_COLUMNS)
    return recs.join(lv, "fip", "inner")


def word_counts(df: DataFrame, key: str | Sequence[str], text_col: str = "filtered_text",
                classify: bool = False) -> DataFrame:
    """``(key, word, cnt)`` from whitespace tokens of ``text_col``.

    ``classify=True`` lower-cases and drops url/emoji tokens first (A1 on raw
    text); otherwise tokens are taken as they are (A2/A3 on filtered text).
    """
    src = F.lower(F.col(text_col)) if classify else F.col(text_col)
    toks = tx.tokens(src)
    if classify:
        toks = F.filter(toks, lambda t: ~tx.is_url(t) & ~tx.is_emoji(t))
    keys = [key] if isinstance(key, str) else list(key)
    exploded = df.select(*keys, F.explode(toks).alias("word"))
    return exploded.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("cnt"))


def marked_word_counts(df: DataFrame, key: Sequence[str], order_col: str, text_col: str = "filtered_text") -> DataFrame:
    """``(key, word, cnt, last)``: ``word_counts`` with one more row per key, whose word is null and whose
    ``last`` is the latest ``order_col``, so that what a key's latest record says comes from the same
    pass over the text (``words_of`` and ``latest_of`` read the two kinds of rows)."""
    toks = F.concat(F.array(F.lit(None).cast("string")), tx.tokens(F.col(text_col)))
    rows = df.select(*key, order_col, F.explode(toks).alias("word"))
    return rows.groupBy(*key, "word").agg(F.count(F.lit(1)).alias("cnt"),
                                          F.max(F.when(F.col("word").isNull(), F.col(order_col))).alias("last"))


def words_of(marked: DataFrame) -> DataFrame:
    return marked.filter(F.col("word").isNotNull()).drop("last")


def latest_of(marked: DataFrame, key: str, col: str) -> DataFrame:
    """``(key, col)``: the value of the latest record, of equally late ones the largest."""
    last = marked.filter(F.col("word").isNull()).groupBy(key).agg(F.max(F.struct("last", col)).alias("_last"))
    return last.select(key, F.col("_last")[col].alias(col))


def rollup_counts(counts: DataFrame, key: str) -> DataFrame:
    """Re-aggregate a finer ``(..., word, cnt)`` table to ``(key, word, cnt)``."""
    return counts.groupBy(key, "word").agg(F.sum("cnt").alias("cnt"))


def shares(counts: DataFrame, key: str, few_keys: bool = False, tasks: int | None = None) -> DataFrame:
    """``share = cnt / sum(cnt) over key`` without a window (no skewed
    single-key task): totals are an aggregate joined back.

    ``few_keys`` (regions): the totals, one row per key, are written first, so
    the planner sees their size and the counts are not exchanged on the key.
    With ``tasks`` (users) both sides of the join are dealt out by key over as many tasks."""
    totals = counts.groupBy(key).agg(F.sum("cnt").alias("_total"))
    if few_keys:
        totals = materialize(totals, f"{key}_totals")
    elif tasks:
        counts, totals = counts.repartition(tasks, key), totals.repartition(tasks, key)
    return (counts.join(totals, key)
            .select(key, "word", "cnt", (F.col("cnt") / F.col("_total")).alias("share")))


def region_words(posts: DataFrame, key: str = "fip", text_col: str = "text") -> DataFrame:
    """A1 words: share of every word token in a region, from raw post text."""
    return shares(word_counts(posts, key, text_col, classify=True), key)


def region_totals(persons: DataFrame, key: str = "fip") -> DataFrame:
    """A1 totals: tweets, url and emoji tokens per region, plus its levels."""
    return persons.groupBy(key).agg(
        F.count(F.lit(1)).alias("tweet_count"),
        F.sum("url_count").cast("long").alias("url_count"),
        F.sum("emoji_count").cast("long").alias("emoji_count"),
        *[F.max(c).alias(c) for c in LEVEL_COLUMNS],
    )


def profile_words(persons: DataFrame, key: str, cut: bool = False, few_keys: bool = False) -> DataFrame:
    """A2/A3 words: share of each word of ``filtered_text`` per ``key``.

    With ``cut`` the ``(key, word, cnt)`` table is written once to the
    shared checkpoint folder and the totals and shares are derived from it,
    so the tokenisation of all posts runs once although two aggregates read
    it (the optimizer cannot reuse the exchange once later word filters are
    pushed into one branch).  Without ``few_keys`` the written counts are joined
    in tasks in proportion to their size.
    """
    counts = word_counts(persons, key, "filtered_text")
    if cut:
        counts = materialize(counts, f"{key}_word_counts")
    return shares(counts, key, few_keys, tasks_for(counts) if cut and not few_keys else None)


def profile_totals(persons: DataFrame, key: str, order_col: str | None = None,
                   carry: Sequence[str] = ()) -> DataFrame:
    """A2/A3 totals: tweet count, average url / emoji per tweet, levels.

    Levels and ``carry`` columns (e.g. the user's fip) all come from one
    record, the latest by ``order_col`` (D12); of records with the same order
    the one with the largest (carry, levels) values, so no shuffle matters.
    """
    agg = [F.count(F.lit(1)).alias("tweet_count"),
           F.avg("url_count").alias("avg_url_count"),
           F.avg("emoji_count").alias("avg_emoji_count")]
    if order_col is None:
        agg += [F.max(c).alias(c) for c in (*LEVEL_COLUMNS, *carry)]
    else:
        agg.append(F.max(F.struct(order_col, *carry, *LEVEL_COLUMNS)).alias("_last"))
    out = persons.groupBy(key).agg(*agg)
    if order_col is not None:
        out = out.select(key, "tweet_count", "avg_url_count", "avg_emoji_count",
                         *[F.col("_last")[c].alias(c) for c in (*LEVEL_COLUMNS, *carry)])
    return out
