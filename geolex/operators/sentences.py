"""Sentence boundaries with learned abbreviations and sentence starters.

The fixed split (``text.sentences``) ends a sentence at every '.', '!' or '?' before white space, so
abbreviations break sentences apart.  Here two statistics over the whole corpus mend that,
unsupervised, from one table of counts:

* a word is an abbreviation if it stands with a period far more often than words do: Dunning's log
  likelihood ratio of "a period follows with the corpus' share" against "it nearly always follows",
  weighted down for long words and for every time it stands without a period, and up for inner periods;
* a word is a sentence starter if it follows sentence ends (other than abbreviations) more often than
  its frequency explains, by the log likelihood ratio of that collocation.

A period after an abbreviation ends a sentence only before a capitalised sentence starter.  All other ends
stay.  The text is cut by the fixed split first; only fragments next to an end that is none are
joined again, so other text is not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geolex.functions import text as tx

# --- fixed values: thresholds of the two ratios, share of periods after an abbreviation ---
ABBREVIATION_SCORE, STARTER_SCORE, ABBREVIATION_SHARE = 0.3, 30.0, 0.99
# --- end of fixed values -------------------------------------------------------------

WORD_SHAPE = r"^\p{L}+(\.\p{L}+)*$"
EDGES = r"^[^\p{L}\p{N}]+|[.!?]+$"
CAPITAL = r"^[^\p{L}\p{N}]*\p{Lu}"


def word_type(token: Column) -> Column:
    """A token in lower case, without what stands before its first letter or digit and its end marks."""
    return F.regexp_replace(F.lower(token), EDGES, "")


def end_mark(token: Column) -> Column:
    last = F.substring(token, -1, 1)
    return F.when(last.isin(".", "!", "?"), last).otherwise("")


def end_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, mark, next, cnt)``: words by the mark they end with, and after a mark by the word that follows."""
    toks = docs.select(tx.tokens(text_col).alias("_t"))
    pairs = toks.select(F.explode(F.arrays_zip(F.col("_t").alias("t"), F.slice("_t", 2, F.greatest(F.size("_t"), F.lit(1)))
                                               .alias("n"))).alias("_p"))
    mark = end_mark(F.col("_p.t"))
    rows = pairs.select(word_type(F.col("_p.t")).alias("word"), mark.alias("mark"),
                        F.when(mark != "", word_type(F.col("_p.n"))).alias("next"))
    return rows.filter("word <> ''").groupBy("word", "mark", "next").agg(F.count(F.lit(1)).alias("cnt"))


def _log_likelihood(k: Column, n: Column, p: Column) -> Column:
    """Of k successes in n at probability p; 0 log 0 is 0."""
    hit = F.when(k == 0, F.lit(0.0)).otherwise(k * F.log(p))
    miss = F.when(n - k == 0, F.lit(0.0)).otherwise((n - k) * F.log(1.0 - p))
    return hit + miss


def abbreviations(counts: DataFrame, least: float = ABBREVIATION_SCORE) -> DataFrame:
    """``(word, n_period, n_plain, score)`` of the words that are abbreviations."""
    words = counts.groupBy("word").agg(F.sum("cnt").alias("_n"), F.sum(F.when(F.col("mark") == ".", F.col("cnt"))
                                                                       .otherwise(0)).alias("_k"))
    total = counts.agg(F.sum("cnt").alias("_words"), F.sum(F.when(F.col("mark") == ".", F.col("cnt")).otherwise(0)).alias("_periods"))
    n, k = F.col("_n"), F.col("_k")
    usual = F.col("_periods") / F.col("_words")
    ratio = -2.0 * (_log_likelihood(k, n, usual) - _log_likelihood(k, n, F.lit(ABBREVIATION_SHARE)))
    size = F.char_length(F.replace(F.col("word"), F.lit(".")))
    periods = F.char_length("word") - size
    score = ratio * F.exp(-size.cast("double")) * (periods + 1) * F.pow(size.cast("double"), -(n - k).cast("double"))
    rows = (words.filter((k > 0) & F.col("word").rlike(WORD_SHAPE)).crossJoin(F.broadcast(total))  # one row
            .filter(F.col("_periods") < F.col("_words")))
    return rows.select("word", k.alias("n_period"), (n - k).alias("n_plain"), score.alias("score")).filter(
        F.col("score") >= least)


def sentence_starters(counts: DataFrame, abbrevs: DataFrame, least: float = STARTER_SCORE) -> DataFrame:
    """``(word, n_start, n_total, score)`` of the words that start sentences."""
    marked = counts.filter("mark <> '' AND next <> ''")
    ends = (marked.filter("mark <> '.'").select("next", "cnt").unionByName(
        marked.filter("mark = '.'").join(abbrevs.select("word"), "word", "left_anti").select("next", "cnt")))
    starts = ends.groupBy(F.col("next").alias("word")).agg(F.sum("cnt").alias("n_start"))
    words = counts.groupBy("word").agg(F.sum("cnt").alias("n_total"))
    total = counts.agg(F.sum("cnt").alias("_words")).crossJoin(F.broadcast(ends.agg(F.sum("cnt").alias("_ends"))))
    a, w, n, b = F.col("n_start"), F.col("n_total"), F.col("_words"), F.col("_ends")
    alike = w / n
    score = -2.0 * (_log_likelihood(a, b, alike) + _log_likelihood(w - a, n - b, alike)
                    - _log_likelihood(a, b, a / b) - _log_likelihood(w - a, n - b, (w - a) / (n - b)))
    rows = starts.join(words, "word").crossJoin(F.broadcast(total)).filter((n > b) & (w < n) & (a / b > w / n))
    return (rows.filter(F.col("word").rlike(r"^\p{L}")).select("word", "n_start", "n_total", score.alias("score"))
            .filter(F.col("score") >= least))


def learned_sentences(docs: DataFrame, id_col: str, text_col: str, abbrevs: DataFrame, starters: DataFrame) -> DataFrame:
    """``(doc_id, sent_no, text)``: the sentences, numbered by the fixed split's fragment that they begin with.
    Fragments joined again have one space between them."""
    cut = F.transform(tx.sentences(text_col), lambda x, i: F.struct(i.alias("no"), x.alias("text"), tx.tokens(x).alias("t")))
    cut = F.transform(F.filter(cut, lambda f: F.size(f["t"]) > 0), lambda f: F.struct(
        f["no"].alias("no"), f["text"].alias("text"), F.get(f["t"], 0).alias("first"), F.element_at(f["t"], -1).alias("last")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("_row"), cut.alias("_f"))
    n = F.size("_f")
    zipped = F.arrays_zip(
        F.col("_f").alias("f"), F.concat(F.array(F.lit(None)), F.slice("_f", 1, F.greatest(n - 1, F.lit(0)))).alias("before"),
        F.slice("_f", 2, F.greatest(n - 1, F.lit(0))).alias("after"))
    rows = rows.filter(n > 0).select("doc_id", "_row", F.explode(zipped).alias("_z")).filter("_z.f IS NOT NULL")

    def period(token: Column) -> Column:
        return F.when(end_mark(token) == ".", word_type(token))

    def opening(token: Column) -> Column:
        return F.when(token.rlike(CAPITAL), word_type(token))

    z = F.col("_z")
    rows = rows.select("doc_id", "_row", z["f"]["no"].cast("long").alias("sent_no"), z["f"]["text"].alias("text"),
                       period(z["before"]["last"]).alias("_a1"), opening(z["f"]["first"]).alias("_s1"),
                       period(z["f"]["last"]).alias("_a2"), opening(z["after"]["first"]).alias("_s2"),
                       z["after"].isNotNull().alias("_more"))
    for side in ("1", "2"):
        for kind, known in (("_a", abbrevs), ("_s", starters)):
            table = known.select(F.col("word").alias(kind + side), F.lit(True).alias(f"{kind}{side}_known"))
            rows = rows.join(table, kind + side, "left")
    joins = F.coalesce(F.col("_a1_known"), F.lit(False)) & F.col("_s1_known").isNull()
    joined = F.col("_more") & F.coalesce(F.col("_a2_known"), F.lit(False)) & F.col("_s2_known").isNull()
    rows = rows.select("doc_id", "_row", "sent_no", "text", joins.alias("_joins"), joined.alias("_joined"))
    alone = rows.filter(~F.col("_joins") & ~F.col("_joined")).select("doc_id", "sent_no", "text")
    order = Window.partitionBy("_row").orderBy("sent_no")  # the fragments of one document
    runs = (rows.filter(F.col("_joins") | F.col("_joined"))
            .withColumn("_run", F.sum(F.when(F.col("_joins"), 0).otherwise(1)).over(order))
            .groupBy("_row", "doc_id", "_run").agg(F.sort_array(F.collect_list(F.struct("sent_no", "text"))).alias("_f"))
            .select("doc_id", F.get("_f", 0)["sent_no"].alias("sent_no"), F.array_join("_f.text", " ").alias("text")))
    return alone.unionByName(runs)
