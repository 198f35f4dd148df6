"""TF-IDF over any text table.

``idf = ln(N / df)`` unsmoothed (not MLlib's IDF).  Every step is a
partial-aggregating ``groupBy``; N is a one-row global count broadcast to
the join.  The term table is vocabulary-sized, so tf x idf is two joins:
terms frequent enough to be few whatever the vocabulary are broadcast, and
only rows of rare terms are shuffled (no hot term among them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolex.functions import text as tx
from geolex.session import materialize


def sentence_docs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One document per sentence: ``(doc_id, sent_no, text)``; sentences
    without any non-space character are not documents."""
    s = df.select(F.col(id_col).alias("doc_id"), F.posexplode(tx.sentences(text_col)).alias("sent_no", "text"))
    return s.filter(tx.has_tokens("text"))


def term_counts(docs: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """A13 counts: ``(id..., doc_length, term, cnt)``; terms are lower-cased
    whitespace tokens, doc length the number of tokens.

    The length depends only on the document, so it rides along as a
    grouping key (no join back to a length table).  Every document also
    gets one marker row with a null term, so the document count N is read
    from the same table (documents without any token still count).
    """
    toks = docs.select(*id_cols, tx.tokens(F.lower(text_col)).alias("_toks"))
    terms = F.concat(F.array(F.lit(None).cast("string")), F.col("_toks"))
    return (toks.select(*id_cols, F.size("_toks").alias("doc_length"), F.explode(terms).alias("term"))
            .groupBy(*id_cols, "doc_length", "term").agg(F.count(F.lit(1)).alias("cnt")))


def term_frequencies(counts: DataFrame, id_cols: list[str]) -> DataFrame:
    """A13 + M8: ``(id..., term, cnt, doc_length, tf)``."""
    return (counts.filter(F.col("term").isNotNull())
            .select(*id_cols, "term", "cnt", "doc_length", (F.col("cnt") / F.col("doc_length")).alias("tf")))


def inverse_document_frequencies(counts: DataFrame) -> DataFrame:
    """A14 + M9: ``(term, df, idf)``, ``idf = ln(N / df)``; N is the number of
    marker rows (a one-row aggregate, broadcast)."""
    n_docs = counts.filter(F.col("term").isNull()).agg(F.count(F.lit(1)).alias("_n"))
    dfreq = counts.filter(F.col("term").isNotNull()).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return (dfreq.crossJoin(F.broadcast(n_docs))
            .select("term", "df", F.ln(F.col("_n") / F.col("df")).alias("idf")))


#: Terms are broadcast if they have more than one in so many of all rows, so there are fewer than that.
FREQUENT = 200_000


def join_terms(tf: DataFrame, idf: DataFrame) -> DataFrame:
    """``tf`` with the ``idf`` of its terms; ``idf`` is stored, as four scans read it."""
    total = idf.agg(F.sum("df").alias("_rows"))
    few = materialize(idf.crossJoin(F.broadcast(total)).filter(F.col("df") * F.lit(FREQUENT) > F.col("_rows"))
                      .select("term", "idf"), "frequent_terms")
    frequent = tf.join(F.broadcast(few), "term")
    rare = tf.join(F.broadcast(few.select("term")), "term", "left_anti")
    return frequent.unionByName(rare.join(idf.select("term", "idf"), "term"))


def tfidf(docs: DataFrame, id_cols: list[str], text_col: str = "text", clean: bool = True,
          cut: bool = False) -> DataFrame:
    """``(id..., term, tf, idf, tfidf)``; ``clean`` applies T12 first.

    With ``cut`` the count table and the term table are written once to the
    shared checkpoint folder, so the text is tokenised once for tf, df and N.
    """
    d = docs.select(*id_cols, (tx.strip_special(text_col) if clean else F.col(text_col)).alias("text"))
    counts = term_counts(d, id_cols, "text")
    if cut:
        counts = materialize(counts, "term_counts")
    tf = term_frequencies(counts, id_cols)
    idf = inverse_document_frequencies(counts)
    joined = join_terms(tf, materialize(idf, "term_idf")) if cut else tf.join(idf, "term")
    return (joined
            .select(*id_cols, "term", "tf", "idf", (F.col("tf") * F.col("idf")).alias("tfidf")))
