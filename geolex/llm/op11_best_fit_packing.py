"""Best-fit packing of tokenised documents, certified by lower bounds.

A document is its token ids and an end id.  One longer than ``CAP`` tokens is cut
into pieces of ``CAP``, of which the first takes what is over; all others stay
whole.  Pieces of ``CAP`` tokens are sequences by themselves, the rest is packed
in rounds:

1. Pieces are dealt by hash to partitions of about ``GROUP`` pieces, so their number
   grows with the table and their size does not.
2. Each partition is packed best-fit decreasing: from the longest piece on, into
   the sequence with the least room that still holds it.
3. Dual-feasible functions bound from below how many sequences its lengths need.
   (f is dual feasible if lengths that fit one sequence never have values of more
   than 1 together; then the sum of all values is such a bound.)  A partition that
   meets its bound is certified and stays, but for its emptiest sequence, which
   closes the rounding of the bounds.  A partition with a gap gives all its
   documents up.
4. What was given up is dealt again with another hash, so that these partitions
   exchange documents, and packed again.  This goes on while it saves sequences,
   until the bound of the whole table is met, ``ROUNDS`` times at most.

The bound of the whole table comes from its lengths' histogram (at most ``CAP``
rows).  The driver sees counts only; rounds are written tables, so a lost
executor repeats tasks of one round.  Only pieces' ids and lengths are shuffled, not
texts or tokens.

Token ids are those of the ``tokenizers`` library for a vocabulary file, without special
tokens (their strings in a text are ordinary text).  The same vocabulary as ranks in
``tiktoken`` gives the same ids in a fourth of the time (the tests compare the two on
every code point) but fails on very long runs of white space, so texts with such
runs are encoded by ``tokenizers`` itself.

Rules: null text is empty, and an empty document is its end id alone.  Repeated
rows and ids are documents of their own; a null ``doc_id`` stays null.  Equal lengths
go by the pieces' internal number.  An empty table gives an empty result.  Only
``doc_id`` and ``text`` are read, extra columns play no part.
"""

from __future__ import annotations

import os
import re
import zlib
from base64 import b64decode
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolex.llm.common import cut, named, replaced, ship, table
from geolex.llm.op9_byte_bpe import read_ranks

#: Tokens of a sequence, end-of-document id, pieces of a partition, rounds.
CAP, END, GROUP, ROUNDS = 1024, 2, 1 << 16, 8
#: White space in one run that ``tiktoken`` is not given.
LONG_SPACE = re.compile(r"\s{1000}")


class Encoder:
    """Token ids of texts, by the content of a tokenizer file and of its rank file."""

    def __init__(self, content: str, ranks: bytes, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task
        import tiktoken
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_str(content)
        self.whole.encode_special_tokens = True
        pairs = (line.split() for line in ranks.splitlines())
        self.quick = tiktoken.Encoding("given", pat_str=pattern, special_tokens={},
                                       mergeable_ranks={b64decode(token): int(rank) for token, rank in pairs})

    def encode(self, text: str) -> list[int]:
        if LONG_SPACE.search(text):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.quick.encode_ordinary(text)


@lru_cache(maxsize=1)
def encoder(content: str, ranks: bytes, pattern: str) -> Encoder:
    return Encoder(content, ranks, pattern)


def cut_points(n: int, cap: int) -> list[int]:
    """Starts of a document's pieces: all but the first have ``cap`` tokens."""
    over = n % cap
    return [0, *range(over or cap, n, cap)]


PIECE = T.ArrayType(T.StructType([
    T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]))
PIECE_ARROW = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                                  ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))]))


def token_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None,
                 ranks: str | None = None, end: int = END, cap: int = CAP, keep_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): the documents' pieces.  ``ids`` is
    null unless ``keep_ids``.  ``tokenizer`` and ``ranks`` are paths on the driver of one
    vocabulary's two files."""
    import public_tokenizers
    with open(tokenizer or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        content = file.read()
    files = docs.sparkSession.sparkContext.broadcast((content, read_ranks(ranks), public_tokenizers.PATTERN))

    def pieces(raw: list[bytes | None]) -> list[pa.Array]:
        encode = encoder(*files.value).encode
        rows = []
        for text in raw:
            ids = np.array([*encode((text or b"").decode("utf-8", "replace")), end], "<u4")
            starts = cut_points(len(ids), cap)
            rows.append([{"piece": k, "start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[a:b]),
                          "ids": ids[a:b] if keep_ids else None}
                         for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)]))])
        return [pa.array(rows, PIECE_ARROW)]

    given = docs.select(named(doc_id).alias("doc_id"), named(text).alias("text"))
    return replaced(given, "text", [T.StructField("pieces", PIECE)], pieces).select("doc_id", F.inline("pieces"))


def best_fit(sizes: list[int], cap: int) -> tuple[list[int], list[int], int]:
    """The bin of each item, its place there, and the number of bins.  Sizes descend."""
    by_room: list[list[int]] = [[] for _ in range(cap + 1)]
    rooms: list[int] = []  # those some open bin has, ascending
    bins, places, used = [], [], 0
    for size in sizes:
        at = bisect_left(rooms, size)
        if at == len(rooms):
            room, number = cap, used
            used += 1
        else:
            room = rooms[at]
            number = by_room[room].pop()
            if not by_room[room]:
                del rooms[at]
        bins.append(number)
        places.append(cap - room)
        left = room - size
        if left:
            if not by_room[left]:
                insort(rooms, left)
            by_room[left].append(number)
    return bins, places, used


@lru_cache(maxsize=2)
def dual_feasible(cap: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of integer values per function for the sizes 0 to ``cap``, and what each
    counts as 1: the identity; sizes under a threshold as 0 and those above its
    complement as 1; the rounding to k-ths; and for each threshold the shares of
    ``cap`` that a size over half of it leaves."""
    size = np.arange(cap + 1)
    rows, ones = [size], [cap]
    for small in range(1, cap // 2 + 1):
        rows.append(np.where(size > cap - small, cap, np.where(size < small, 0, size)))
        ones.append(cap)
        fit = cap // small
        rows.append(np.where(2 * size > cap, fit - (cap - size) // small, np.where(size >= small, 1, 0)))
        ones.append(fit)
    for k in range(2, 65):
        rows.append(np.where((k + 1) * size % cap == 0, k * size, (k + 1) * size // cap * cap))
        ones.append(k * cap)
    return np.array(rows, np.int64), np.array(ones, np.int64)


def lower_bound(counts: np.ndarray, cap: int) -> int:
    """Bins that ``counts[s]`` items of each size s need at least."""
    values, ones = dual_feasible(cap)
    return int((-(-(values @ counts.astype(np.int64)) // ones)).max())


def packed_group(cap: int):
    """Packs one partition: adds ``sequence_id`` (the number of the first piece there),
    ``offset`` and ``_open`` (the piece is given up)."""

    def pack_one(rows: pa.Table) -> pa.Table:
        key, size = rows["_key"].to_numpy(), rows["length"].to_numpy()
        order = np.lexsort((key, -size))
        bins, places, used = best_fit(size[order].tolist(), cap)
        bins, places = np.array(bins), np.array(places)
        loads = np.bincount(bins, size[order], used)
        first = np.zeros(used, np.int64)
        first[bins[places == 0]] = key[order][places == 0]
        if used == lower_bound(np.bincount(size, minlength=cap + 1), cap):
            given_up = bins == loads.argmin()
        else:
            given_up = np.ones(len(bins), bool)
        return pa.Table.from_arrays(
            [*(rows[c].take(pa.array(order)) for c in rows.column_names if c != "_group"),
             pa.array(first[bins]), pa.array(places, pa.int64()), pa.array(given_up)],
            names=[*(c for c in rows.column_names if c != "_group"), "sequence_id", "offset", "_open"])

    return pack_one


def pack(pieces: DataFrame, cap: int = CAP, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``cap``."""
    spark = pieces.sparkSession
    ship(spark)
    names = [c for c in pieces.columns if c != "length"]
    table_ = cut(pieces.select(F.struct(F.lit(0).alias("_"), *map(named, names)).alias("_row"),
                               F.col("length").cast("long").alias("length"),
                               F.monotonically_increasing_id().alias("_key")), "op11-pieces")
    counts = np.zeros(cap + 1, np.int64)
    for size, n in table_.groupBy("length").count().collect():  # one row per length
        if size is None or not 1 <= size <= cap:
            raise ValueError(f"a piece has 1 to {cap} tokens, not {size}")
        counts[size] = n
    full = table_.filter(F.col("length") == cap).withColumn("sequence_id", F.col("_key")).withColumn(
        "offset", F.lit(0).cast("long"))
    counts[cap] = 0
    bound, left = lower_bound(counts, cap), int(counts.sum())
    done, pool, settled, before, alone = [full], table_.filter(F.col("length") < cap), 0, None, False
    schema = T.StructType([*table_.schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType()), T.StructField("_open", T.BooleanType())])
    for number in range(rounds):
        if not left:
            break
        groups = -(-left // group)
        dealt = pool.select(*table_.columns, F.pmod(F.xxhash64("_key", F.lit(number)), F.lit(groups)).alias("_group"))
        placed = cut(dealt.groupBy("_group").applyInArrow(packed_group(cap), schema), "op11-round")
        seen = placed.filter("offset = 0").agg(F.count("*").alias("used"), F.count_if("_open").alias("open")).first()
        if before is not None and seen.used >= before:
            done.append(pool)  # as the round before had it
            break
        if settled + seen.used == bound or number == rounds - 1 or (alone and groups == 1):
            done.append(placed)
            break
        alone, before, settled = groups == 1, seen.open, settled + seen.used - seen.open
        done.append(placed.filter(~F.col("_open")))
        pool = placed.filter("_open")
        left = pool.count()
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part.select(*out.columns))
    return out.select(*[F.col("_row")[c].alias(c) for c in names], "length", "sequence_id", "offset")


def certificate(packed: DataFrame, cap: int = CAP) -> tuple[int, int]:
    """The number of sequences, and a number that no packing of these pieces can beat."""
    counts = np.zeros(cap + 1, np.int64)
    for size, n in packed.groupBy("length").count().collect():
        counts[size] = n
    return packed.filter("offset = 0").count(), lower_bound(counts, cap)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the sequences themselves, of pieces with their ids.  A
    sequence gathers at most its own number of tokens."""
    return (packed.groupBy("sequence_id")
            .agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("_parts"))
            .select("sequence_id", F.flatten("_parts.ids").alias("ids"), F.col("_parts.doc_id").alias("doc_ids")))


def pack_documents(docs: DataFrame, cap: int = CAP, group: int = GROUP, rounds: int = ROUNDS, **kwargs) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset) of each piece."""
    return pack(token_pieces(docs, cap=cap, **kwargs), cap, group, rounds).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset")


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), keep_ids=False).drop("ids")
