"""Exact dedup by progressive refinement, in DataFrame functions only.

Three passes over the documents, each reading more of fewer texts:

1. length: documents whose byte length nobody shares are unique;
2. prefix hash: of the others, those whose (length, hash of the first
   characters) nobody shares are unique;
3. full hash: SHA-256 of the whole text, only for what is left.

What travels between passes is the set of surviving lengths, and a bit set of the
surviving prefix hashes.  Both are broadcast, and both are bounded by
construction: lengths from ``CLASSES`` bytes on are one class, so there are at most
``CLASSES`` of them (4 MB); the bit set has 16 to 32 bits a prefix and at most
``MOST_BITS`` (16 MB).  A shared class or bit only lets a text
through to the next pass; groups are formed by the full hash, so the result
is exact at every size.  Of the texts whose prefix is not shared, some 3 to 6 % pass,
7 % at 10 million shared prefixes, and 1 - exp(-k / MOST_BITS) at k beyond; hashing
those where they stand costs less than the shuffle of texts that a join by prefix
would be.  No text is shuffled to find the groups.

Rules: null text counts as empty; equal means byte for byte.  Of equal texts
the row with the largest id stays; ids that are null lose to any id, and a
group of null ids only keeps one.  Rows that repeat both id and text are all
marked kept by ``exact_groups`` and reduced to one by ``drop_copies``.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolex.llm.common import cut, named, packed, table

#: Length classes that the broadcast set may have.
CLASSES = 1 << 20
#: Bits of a row of the bit set, bits a prefix has at least, and most bits.
BLOCK, BITS_A_KEY, MOST_BITS = 1 << 12, 16, 1 << 27
PREFIX_CHARS = 256


def bit_set(keys: DataFrame) -> tuple[DataFrame, int]:
    """The distinct integers ``_key`` as a bit set of a power of two bits: rows of ``_block`` and
    ``_words``, 64 words of 64 bits each, and the number of bits."""
    bits = max(BLOCK, min(MOST_BITS, 1 << (BITS_A_KEY * keys.count() - 1).bit_length()))
    at = keys.select(F.pmod("_key", F.lit(bits)).alias("_at"))
    words = at.groupBy(F.shiftright("_at", 6).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_at & 63 AS int))")).alias("_bits"))
    entry = F.struct(F.col("_word").bitwiseAND(63), F.col("_bits"))
    blocks = words.groupBy(F.shiftright("_word", 6).alias("_block")).agg(
        F.map_from_entries(F.collect_list(entry)).alias("_of"))  # at most 64 entries
    each = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.col("_of")[i.cast("long")], F.lit(0)))
    return blocks.select("_block", each.alias("_words")), bits


def with_hits(rows: DataFrame, blocks: DataFrame, bits: int, key: Column) -> DataFrame:
    """``rows`` with ``_hit``: whether the key's bit is set; null keys have none."""
    placed = rows.withColumn("_at", F.pmod(key, F.lit(bits)))
    joined = placed.join(F.broadcast(blocks), F.shiftright("_at", 12) == F.col("_block"), "left")
    hit = F.expr("(shiftright(get(_words, cast(shiftright(_at, 6) & 63 AS int)), cast(_at & 63 AS int)) & 1) = 1")
    return joined.withColumn("_hit", F.coalesce(hit, F.lit(False))).drop("_at", "_block", "_words")


def with_full_hash(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with ``_full``: the text's SHA-256 where length and prefix hash
    are shared, null where they prove the text unique."""
    body = F.coalesce(text, F.lit(""))
    length = F.octet_length(body)
    length_class = F.least(length, F.lit(CLASSES - 1))
    prefix = F.xxhash64(length, F.substring(body, 1, PREFIX_CHARS))

    lengths = (docs.select(length_class.alias("_shared_length")).groupBy("_shared_length")
               .agg(F.count("*").alias("_n")).filter("_n > 1").select("_shared_length"))
    lengths = F.broadcast(cut(lengths, "op3-lengths"))

    def same_length(how: str) -> DataFrame:
        return docs.join(lengths, length_class == F.col("_shared_length"), how)

    prefixes = (same_length("left_semi").select(prefix.alias("_key")).groupBy("_key")
                .agg(F.count("*").alias("_n")).filter("_n > 1").select("_key"))
    blocks, bits = bit_set(cut(prefixes, "op3-prefixes"))
    rows = with_hits(same_length("left"), cut(blocks, "op3-bits"), bits,
                     F.when(F.col("_shared_length").isNotNull(), prefix))
    return (rows.withColumn("_full", F.when(F.col("_hit"), F.sha2(body.cast("binary"), 256)))
            .drop("_shared_length", "_hit"))


def group_keepers(hashed: DataFrame) -> DataFrame:
    """One row per full hash: ``_keep`` (largest id), ``_size`` and ``_keep_rows``
    (rows with that id).  Counted by (hash, id) first, then by hash, so a huge
    group is reduced on many tasks."""
    pairs = hashed.groupBy("_full", "_id").agg(F.count("*").alias("_n"))
    return pairs.groupBy(F.col("_full").alias("_group")).agg(
        F.max("_id").alias("_keep"), F.sum("_n").alias("_size"),
        F.coalesce(F.max_by("_n", "_id"), F.sum("_n")).alias("_keep_rows"))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept`` and
    the columns named in ``carry``."""
    given = docs.select(named(doc_id).alias("_id"), named(text).alias("_text"),
                        F.struct(F.lit(0).alias("_"), *map(named, carry)).alias("_row"))
    rows = cut(with_full_hash(given, F.col("_text")).select("_id", "_row", "_full"), "op3-rows")
    carried = [F.col("_row")[c].alias(c) for c in carry]
    alone = rows.filter("_full IS NULL").select(
        F.col("_id").alias(doc_id), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), *carried)
    shared = rows.filter("_full IS NOT NULL")
    keepers = cut(group_keepers(shared), "op3-keepers")
    grouped = shared.join(keepers, F.col("_full") == F.col("_group")).select(
        F.col("_id").alias(doc_id), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), *carried)
    return alone.unionByName(grouped)


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts.  Rows proved unique by
    length or prefix pass straight through; the others meet their group's
    keeper on (hash, id), which no group makes hot."""
    hashed = with_full_hash(packed(docs), F.col("_row")[text]).withColumn("_id", F.col("_row")[doc_id])
    shared = hashed.filter("_full IS NOT NULL")
    keepers = cut(group_keepers(cut(shared.select("_id", "_full"), "op3-rows")), "op3-keepers")
    kept = shared.join(keepers, (F.col("_full") == F.col("_group")) & F.col("_id").eqNullSafe(F.col("_keep")))
    once = kept.filter("_keep_rows = 1").select("_row.*")
    repeated = kept.filter("_keep_rows > 1").groupBy("_group").agg(F.first("_row").alias("_row")).select("_row.*")
    return hashed.filter("_full IS NULL").select("_row.*").unionByName(once).unionByName(repeated)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return exact_groups(docs.withColumn("text_sha256", digest), carry=("text_sha256",))


ORACLE_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT t.doc_id, g.keep_id, g.group_size,
       t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g USING (body)
"""
