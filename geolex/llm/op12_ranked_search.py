"""Ranked lexical search by the Best Position Algorithm.

Terms are the maximal runs of ASCII letters and digits and of anything outside
ASCII; only A-Z are lower-cased.  With N documents that have a term, L their terms
and n a document's own (repeats counted), df the documents of a term and tf its
occurrences in a document, all integers but the logarithm:

    w     = floor(1000 ln((2 N + 2) / (2 df + 1)))
    m     = 100 - B + (B n N) div L                       B = 90
    score = sum of w ((10^9 tf) div (1000 tf + 8 m)) over a query's terms, once each

One pass over the texts writes, per document, n and the tf of the queries' terms.
N, L and df are sums over that table.  Then each task reads it in shards of at most
``POSTINGS`` postings.  A shard's postings make one impact list per term, descending,
and for each query the lists are read side by side (sorted access), some positions
at a time.  A document met there is looked up in the query's other lists (direct
access): that gives its whole score and its position in each list, and these
positions are seen too.  A list's best position is the end of its seen beginning,
read or looked up, so it lies at or after the last position read; the sum of the
impacts at the best positions bounds every document not met.  A query stops when
that bound is strictly below its k-th best score (documents of equal score may
still come, and the smaller id goes first), or when its lists are read.  The
k-th score is kept from shard to shard of a task.  Each task answers k documents a
query at most; their best k are ranked in two steps, so that no query's answers
of all tasks meet in one task at once.

Queries are taken in blocks of at most ``BLOCK`` bytes of text (by a hash of the row),
each against all documents; a block's terms are the only broadcast.

Rules: null and empty texts have no terms and are not counted in N; queries without
terms have no answers.  Repeated documents and queries are answered as often as
they stand in the table.  Equal scores go by ascending doc_id, null ids last.  Only
``doc_id`` and ``text``, ``item_id`` and ``text`` are read.  Empty tables give an
empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geolex.llm.common import cut, in_arrow, named, table

TOP, B = 10, 90
#: Postings of a shard, bytes of query text in a block, positions read at first.
POSTINGS, BLOCK, DEPTH = 1 << 21, 16 << 20, 64
#: Answers of a query are ranked in so many parts first.
PARTS = 64
#: A text is searched for terms in stretches of about so many bytes.
STRETCH = 1 << 22

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def terms(text: bytes | None) -> Counter:
    """Occurrences of each term; non-ASCII characters are bytes from 0x80 on."""
    found: Counter = Counter()
    text, at = text or b"", 0
    while at < len(text):
        gap = re.compile(rb"[^0-9A-Za-z\x80-\xff]|$").search(text, min(at + STRETCH, len(text)))
        found.update(TERM.findall(text[at:gap.end()].lower()))
        at = max(gap.end(), at + 1)
    return found


def query_terms(queries: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, item_id, terms): a row per query that has a term."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([list(terms(t)) for t in batch.column(1).to_pylist()], pa.list_(pa.binary()))],
                names=["item_id", "terms"])

    given = queries.select(named(item_id).alias("item_id"), named(text).cast("binary").alias("text"))
    kind = given.schema["item_id"].dataType.simpleString()
    return in_arrow(given, find, f"item_id {kind}, terms array<binary>").filter("size(terms) > 0").withColumn(
        "item", F.monotonically_increasing_id())


def term_table(docs: DataFrame, doc_id: str, text: str, wanted: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document with a term; only wanted terms are listed."""
    numbers = docs.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = numbers.value
        for batch in batches:
            ns, lists, tfs = [], [], []
            for text_ in batch.column(1).to_pylist():
                found = terms(text_)
                ns.append(found.total())
                held = found.keys() & number.keys()
                lists.append([number[t] for t in held])
                tfs.append([found[t] for t in held])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ns, pa.int64()), pa.array(lists, pa.list_(pa.int32())),
                 pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    given = docs.select(named(doc_id).cast("long").alias("doc_id"), named(text).cast("binary").alias("text"))
    return in_arrow(given, count, "doc_id long, n long, terms array<int>, tfs array<long>").filter("n > 0")


class Shard:
    """The impact lists of some documents, for sorted and direct access."""

    def __init__(self, ids: np.ndarray, owner: np.ndarray, term: np.ndarray, impact: np.ndarray):
        """``owner`` numbers the document of each posting; documents are in the order of ``ids``."""
        self.ids = ids
        order = np.lexsort((owner, -impact, term))
        self.owner, self.impact = owner[order], impact[order]
        self.names, self.starts = np.unique(term[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(order))
        # direct access: each list's documents ascending, and their positions
        by_doc = np.lexsort((self.owner, term[order]))
        self.sorted_owner = self.owner[by_doc]
        self.position = by_doc - np.repeat(self.starts, self.ends - self.starts)

    def lists(self, query: np.ndarray) -> list[int]:
        return np.flatnonzero(np.isin(self.names, query)).tolist()

    def best(self, query: np.ndarray, k: int, floor: int, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents of the k highest scores above 0 and not below ``floor``, ties by order,
        their scores, and the positions read."""
        lists = self.lists(query)
        spans = [(self.starts[j], self.ends[j]) for j in lists]
        seen = [np.zeros(b - a, bool) for a, b in spans]
        best = [0] * len(lists)
        met = np.zeros(len(self.ids), bool)
        found, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        read = 0
        while lists:
            fresh = np.unique(np.concatenate([self.owner[a + read:min(b, a + read + depth)] for a, b in spans]))
            fresh = fresh[~met[fresh]]
            met[fresh] = True
            total = np.zeros(len(fresh), np.int64)
            for j, (a, b) in enumerate(spans):
                at = np.searchsorted(self.sorted_owner[a:b], fresh)
                at[at == b - a] = 0
                holds = self.sorted_owner[a + at] == fresh
                place = self.position[a + at[holds]]
                total[holds] += self.impact[a + place]
                seen[j][place] = True
            found, scores = np.concatenate([found, fresh]), np.concatenate([scores, total])
            keep = np.flatnonzero((scores > 0) & (scores >= floor))
            keep = keep[np.lexsort((found[keep], -scores[keep]))[:k]]
            found, scores = found[keep], scores[keep]
            if len(found) == k:
                floor = max(floor, int(scores[-1]))
            read += depth
            bound = 0
            for j, (a, b) in enumerate(spans):
                # everything before ``best`` is seen; go on to the first unseen position
                rest = seen[j][best[j]:]
                unseen = int(rest.argmin()) if len(rest) else 0
                best[j] += len(rest) if len(rest) and rest[unseen] else unseen
                if best[j] < b - a:
                    bound += int(self.impact[a + max(best[j] - 1, 0)])
            if bound < floor or bound == 0 or all(read >= b - a for a, b in spans):
                break
            depth *= 2
        return found, scores, read


def shards(batches: Iterator[pa.RecordBatch], weights: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of rows (doc_id, m, terms, tfs) as (doc_id, valid, owner, term, impact)."""
    held, postings = [], 0

    def joined():
        ids, m, terms_, tfs = (c.combine_chunks() for c in pa.Table.from_batches(held).columns)
        sizes = terms_.value_lengths().to_numpy()
        owner = np.repeat(np.arange(len(sizes)), sizes)
        term, tf = terms_.flatten().to_numpy(), tfs.flatten().to_numpy()
        impact = weights[term] * (1000000000 * tf // (1000 * tf + 8 * m.to_numpy()[owner]))
        return ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), owner, term, impact

    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            held.append(part)
            postings += len(part.column(2).flatten()) + part.num_rows
            if postings >= limit:
                yield joined()
                held, postings = [], 0
    if held:
        yield joined()


def answers(docs: DataFrame, queries: list[tuple[int, np.ndarray]], weights: np.ndarray, k: int, limit: int) -> DataFrame:
    """(item, doc_id, score): each task's best k documents of each query."""
    shipped = docs.sparkSession.sparkContext.broadcast((queries, weights))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = shipped.value
        top: dict[int, list[tuple]] = {}
        for ids, valid, owner, term, impact in shards(batches, weight, limit):
            order = np.lexsort((ids, ~valid))  # ties go by id, null ids last
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.arange(len(ids))
            shard = Shard(ids[order], rank[owner], term, impact)
            valid = valid[order]
            for item, query in asked:
                have = top.get(item, [])
                floor = -have[-1][0] if len(have) == k else 0
                found, scores, _ = shard.best(query, k, floor)
                if len(found):
                    new = [(-s, not valid[d], int(shard.ids[d])) for d, s in zip(found.tolist(), scores.tolist())]
                    top[item] = sorted(have + new)[:k]
        rows = [(item, None if absent else doc, -score) for item, best in top.items() for score, absent, doc in best]
        if rows:
            item, doc, score = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, pa.int64()),
                                              pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return in_arrow(docs, search, "item long, doc_id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """Adds ``rank`` and keeps the first k of each item, chosen among parts of its answers first."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = found.withColumn("_part", F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(PARTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "_part").orderBy(*order)))
    return (first.filter(F.col("rank") <= k).drop("_part", "rank")
            .withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
            .filter(F.col("rank") <= k))


def weight(n: Column, df: Column) -> Column:
    return F.floor(1000 * F.log((2 * n + 2).cast("double") / (2 * df + 1).cast("double")))


def weighed(docs: DataFrame, terms_: int, b: int = B) -> tuple[DataFrame, np.ndarray]:
    """A term table with ``m`` in place of ``n``, and the weight of each of a block's ``terms_`` terms."""
    total = docs.agg(F.count("*").alias("_N"), F.sum("n").alias("_L"))
    df = docs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    rows = df.crossJoin(F.broadcast(total)).select("term", weight(F.col("_N"), F.col("df")).alias("w")).collect()
    weights = np.zeros(terms_, np.int64)
    for term, w in rows:  # at most the block's terms
        weights[term] = w
    m = F.expr(f"100 - {b} + ({b} * cast(n as decimal(18,0)) * cast(_N as decimal(18,0))) div _L").alias("m")
    return docs.crossJoin(F.broadcast(total)).select("doc_id", m, "terms", "tfs"), weights


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text", block: int = BLOCK, limit: int = POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest scores for each query."""
    spark = docs.sparkSession
    asked = cut(query_terms(queries, item_id, item_text), "op12-queries")
    size = asked.agg(F.sum(F.expr("aggregate(terms, 0L, (a, t) -> a + length(t) + 8)"))).first()[0]
    blocks = -(-(size or 0) // block)
    found = None
    for number in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == number).select("item", "terms").collect()
        wanted: dict[bytes, int] = {}
        held = [(row.item, np.sort(np.array([wanted.setdefault(bytes(t), len(wanted)) for t in row.terms], np.int32)))
                for row in rows]
        postings, weights = weighed(cut(term_table(docs, doc_id, text, wanted), "op12-terms"), len(wanted))
        part = cut(answers(postings, held, weights, k, limit), "op12-answers")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "item long, doc_id long, score long")
    return (ranked(found, k).join(asked.select("item", "item_id"), "item")
            .select("item_id", "rank", "doc_id", "score"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, row_number() OVER () AS k, len(terms) AS n, terms FROM t WHERE len(terms) > 0),
total AS (SELECT count(*) AS n_docs, sum(n)::HUGEINT AS n_terms FROM d),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL),
p AS (
  SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY k, term),
w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM p, total GROUP BY term, n_docs),
i AS (
  SELECT p.k, p.term, w.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)::BIGINT)) AS impact
  FROM p JOIN w USING (term) JOIN d USING (k), total),
s AS (SELECT q.item_id, i.k, sum(i.impact)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY q.item_id, i.k)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
FROM s JOIN d USING (k) WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
