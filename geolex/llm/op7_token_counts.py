"""Token counts from flat, unindexed token files.

A flat token file is a run of fixed-width token ids in which an end-of-document id
closes each document; nothing says where documents begin.  Spark's text reader
deals each file out in splits and reads it as a stream of bytes, cut after each
byte that is the last of the end id; a row is never longer than a document's ids,
however long the file.  A task puts the bytes of its split together again in
blocks.  A block is searched for separators in one vector comparison.

Neither a split nor a block knows where in the file it begins, or at which byte of
an id, so a block tells its length in bytes and, for each byte that ids may
begin at, the number and the last of its separators.  A running sum and a running
maximum over a file's blocks (prefix scans of one row per block) then give each
block its place, and the number of separators and the last one before it, which
completes the documents that blocks cut.

Files come from ``write_flat``: one per partition, ids big-endian, written by
Spark's own text writer so that it commits whole files and works on any file
system Spark knows.  That works because the last byte of the end-of-document id
is an ASCII character: the writer's line separator is that byte, and a line is a
document's ids and the end id without it.  The bytes on disk are exactly the
ids; no index and no separator is added.

Rules: null and empty texts are documents of 0 tokens.  Ids after the last
separator are a document without an end (``closed`` false).  An empty file has
no documents.  A file whose bytes the reader doesn't give back in full (it takes
a compressed file apart) is an error, never a cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from geolex.llm.common import cut, in_arrow, named, replaced, shared_path, table
from geolex.llm.op9_byte_bpe import read_ranks, vocabulary

#: End-of-document id, ids' width in bytes, and ids per block.
END, WIDTH, BLOCK = 50256, 2, 1 << 18

#: The text reader drops these bytes at the beginning of a file.
BYTE_ORDER_MARK = b"\xef\xbb\xbf"


def write_flat(docs: DataFrame, path: str, text: str = "text", ranks: str | None = None, end: int = END,
               width: int = WIDTH) -> None:
    """Encodes the texts and writes them as flat files."""
    tail = end.to_bytes(width, "big")
    if tail[-1] >= 0x80:
        raise ValueError("the last byte of the end-of-document id must be ASCII")
    rank_file = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks))

    def lines(raw: list[bytes | None]) -> list[pa.Array]:
        ids = vocabulary(rank_file.value).encode_all(raw)
        return [pa.array([np.frombuffer(x, "<u4").astype(f">u{width}").tobytes() + tail[:-1] for x in ids], pa.binary())]

    flat = replaced(docs.select(named(text).alias("text")), "text", [T.StructField("line", T.BinaryType())], lines)
    flat.select(F.col("line").cast("string").alias("value")).write.option("lineSep", chr(tail[-1])).text(path)


def separator(tail: bytes) -> bytes:
    """A byte to read files by: after it no end id goes on, so none lies in two splits.
    Rows are no longer than documents if it ends the end id."""
    return tail[-1:] if tail.count(tail[-1]) == 1 else next(bytes([x]) for x in range(256) if x not in tail)


def find(view: np.ndarray, tail: bytes, first: int) -> np.ndarray:
    """Where ``tail`` begins, at any byte, if its last byte is at ``first`` or later."""
    width = len(tail)
    at = np.flatnonzero(view[max(first, width - 1):] == tail[-1]) + max(first, width - 1) - (width - 1)
    for k in range(width - 1):
        at = at[view[at + k] == tail[k]]
    return at


def block_row(name: str, size: int, start: int, number: int, view: np.ndarray, known: int, tail: bytes) -> pa.RecordBatch:
    """The row of the block that is ``view`` without its first ``known`` bytes, which belong to
    the block before it.  Positions are bytes from the block's first one."""
    width, ends = len(tail), find(view, tail, known) - known
    by_byte = [ends[ends % width == k] for k in range(width)]
    return pa.RecordBatch.from_arrays(
        [pa.array([name]), *(pa.array([x], pa.int64()) for x in (size, start, number, len(view) - known)),
         pa.array([ends], pa.list_(pa.int64())), pa.array([[len(x) for x in by_byte]], pa.list_(pa.int64())),
         pa.array([[int(x[-1]) if len(x) else None for x in by_byte]], pa.list_(pa.int64()))],
        names=["file", "size", "start", "block", "bytes", "ends", "counts", "lasts"])


def read_blocks(spark: SparkSession, path: str, tail: bytes, block: int) -> DataFrame:
    """(file, size, start, block, bytes, ends, counts, lasts): each block of each split.
    Behind a file's last byte there may be one separator too many."""
    mark, width = separator(tail), len(tail)
    lines = (spark.read.option("encoding", "ISO-8859-1").option("lineSep", mark.decode("latin-1")).text(path)
             .select(F.col("_metadata.file_name"), F.col("_metadata.file_size"), F.col("_metadata.file_block_start"),
                     F.col("value").cast("binary")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, number, known, left = None, 0, 0, b""  # left: the bytes of no block yet, after the known ones
        for batch in batches:
            name, start = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(2).to_numpy()
            new = np.flatnonzero((np.diff(name) != 0) | (np.diff(start) != 0)) + 1
            for a, b in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows]):
                if a == b:
                    continue
                now = unquote(batch.column(0)[a].as_py()), batch.column(1)[a].as_py(), batch.column(2)[a].as_py()
                if now != split:
                    if len(left) > known:
                        yield block_row(*split, number, np.frombuffer(left, np.uint8), known, tail)
                    split, number, known, left = now, 0, 0, b""
                    if now[1] % width:
                        raise ValueError(f"{now[0]}: {now[1]} bytes are no whole number of ids")
                part = batch.column(3).slice(a, b - a)
                joined = pc.binary_join(pa.ListArray.from_arrays([0, len(part)], part), pa.scalar(mark, part.type))
                left = b"".join((left, joined[0].as_buffer(), mark))
                view, at = np.frombuffer(left, np.uint8), known
                while len(left) - at >= block * width:
                    yield block_row(*split, number, view[at - known:at + block * width], known, tail)
                    at += block * width
                    number, known = number + 1, min(at, width - 1)
                left = left[at - known:]
        if len(left) > known:
            yield block_row(*split, number, np.frombuffer(left, np.uint8), known, tail)

    return in_arrow(lines, search, "file string, size long, start long, block long, bytes long, ends array<long>, "
                                   "counts array<long>, lasts array<long>")


def scan(spark: SparkSession, path: str, end: int = END, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """(file, ordinal, first_token, n_tokens, closed): each document of each file, the
    end id not counted."""
    tail = end.to_bytes(width, "big")
    blocks = cut(read_blocks(spark, path, tail, block), "op7-blocks")
    whole_file = Window.partitionBy("file")
    earlier = whole_file.orderBy("start", "block").rowsBetween(Window.unboundedPreceding, -1)
    unread = F.col("size") - F.sum("bytes").over(whole_file)
    refused = F.raise_error(F.concat("file", F.lit(": not all of its bytes can be read"))).cast("long")
    dropped = F.lit(len(BYTE_ORDER_MARK)) if not set(tail) & set(BYTE_ORDER_MARK) else refused
    placed = (blocks.select("file", "start", "block", "counts", "lasts",
                            F.when(unread.isin(0, -1), 0).when(unread.isin(3, 2), dropped).otherwise(refused).alias("_dropped"),
                            F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("_bytes"))
              .withColumn("_at", F.col("_dropped") + F.col("_bytes"))
              .withColumn("_k", F.pmod(-F.col("_at"), F.lit(width)).cast("int")))
    scanned = placed.select(
        F.col("file").alias("_file"), F.col("start").alias("_split"), F.col("block").alias("_block"), "_at",
        F.coalesce(F.max(F.expr(f"(_at + lasts[_k]) div {width}")).over(earlier) + 1, F.lit(0)).alias("_from"),
        F.coalesce(F.sum(F.expr("counts[_k]")).over(earlier), F.lit(0)).alias("_before"))
    stitched = blocks.join(scanned, (F.col("file") == F.col("_file")) & (F.col("start") == F.col("_split"))
                           & (F.col("block") == F.col("_block")))
    docs = stitched.select(
        "file", "_from", "_before", F.expr(f"size div {width}").alias("stop"),
        F.expr("_at < size and _at + bytes >= size").alias("last"),
        F.expr(f"transform(filter(ends, x -> (_at + x) % {width} = 0 and _at + x + {width} <= size), "
               f"x -> (_at + x) div {width})").alias("ends"))
    docs = docs.select("*", F.size("ends").alias("_n"),
                       F.expr("concat(array(_from), transform(ends, x -> x + 1))").alias("_starts"))
    whole = docs.select("file", "_before", F.posexplode(F.arrays_zip(
        F.expr("slice(_starts, 1, _n)").alias("start"), F.col("ends").alias("end"))).alias("_k", "_d"))
    whole = whole.select("file", (F.col("_before") + F.col("_k")).alias("ordinal"), F.col("_d.start").alias("first_token"),
                         (F.col("_d.end") - F.col("_d.start")).alias("n_tokens"), F.lit(True).alias("closed"))
    open_ = (docs.filter("last").withColumn("_start", F.element_at("_starts", -1)).filter("_start < stop")
             .select("file", (F.col("_before") + F.col("_n")).alias("ordinal"), F.col("_start").alias("first_token"),
                     (F.col("stop") - F.col("_start")).alias("n_tokens"), F.lit(False).alias("closed")))
    return whole.unionByName(open_)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, from flat files made of them.  ``shard`` is the
    partition that wrote the file."""
    path = shared_path(spark, "op7-flat")
    write_flat(table(spark, sf_dir, "documents"), path)
    shard = F.regexp_extract("file", r"^part-(\d+)", 1).cast("int").alias("shard")
    return scan(spark, path).select(shard, "ordinal", "first_token", "n_tokens")
