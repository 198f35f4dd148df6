"""SimHash near-dedup over BK-trees.

A document's fingerprint has a bit set where more than half of its word
shingles' 64-bit hashes have it.  Fingerprints within ``radius`` bits link,
and documents that links connect are one component.

The index is a set of BK-trees: a node's children hang on edges numbered by
their Hamming distance to it, so a search for everything within the radius of
a fingerprint at distance d follows edges d-radius .. d+radius only.  One tree
over the corpus would have to be broadcast whole, so the trees are sharded by
pigeonhole: of ``radius + 2`` bit blocks two linked fingerprints agree in at
least two, so each distinct fingerprint goes to one shard per pair of blocks
(the two blocks' bits).  A shard with more than ``SHARD`` members is cut into
pieces, and each piece's tree is sent to the searches of every piece: no task
holds more than two pieces.  A task grows the trees of all its shards level
by level in arrays, walks them together, joins what links inside a shard, and
returns one link per member and shard (to the lowest member it reaches), never
all pairs.  Components come from alternating large-star and small-star steps
over those links; a component's hub is split by the skew join.

Rules: null text has no words, like empty text: fingerprint zero, linked like
any other.  Fewer words than the shingle length: the whole sequence is the
shingle.  Bytes A-Z are lower-cased.  Equal rows share a fingerprint and so a
component.  A component of null ids only has a null id; ``drop_near_copies``
keeps rows without an id.  Rows are not joined by id, so repeated ids and
extra columns do no harm.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolex.llm.common import cut, in_arrow, named, packed, partitions, table, unpacked

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Members of a shard in one tree; (search, node) pairs and rows handled at once in a task.
SHARD, FRONTIER, ROWS = 4096, 1 << 20, 1 << 18


# --- fingerprints ----------------------------------------------------------
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
BYTE_PLACE = np.arange(8, dtype=np.uint16) * 256


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The text's SimHash as a signed 64-bit integer."""
    words = text.lower().split()  # on bytes: A-Z, and the six ASCII white-space bytes
    if not words:
        return 0
    grams = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    hashes = b"".join(map(xxhash.xxh64_digest, map(b" ".join, grams), repeat(SEED)))
    places = np.frombuffer(hashes, np.uint8).reshape(-1, 8) + BYTE_PLACE
    seen = np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ BYTE_BITS
    return int.from_bytes(np.packbits(2 * seen.ravel() > len(places)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    given = docs.select(named(doc_id).alias("doc_id"), F.coalesce(named(text), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())],
                                             names=["doc_id", "fingerprint"])

    return in_arrow(given, run, given.select("doc_id").schema.add("fingerprint", "long"))


# --- BK-trees --------------------------------------------------------------
def starts_of_runs(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, np.int64)


class Forest:
    """One BK-tree per shard.  Nodes are numbered level by level, roots first, and
    children by (parent, edge), so a node's children on a range of edges are
    neighbours in ``child_at``."""

    def __init__(self, prints: np.ndarray, shards: np.ndarray):
        """``shards`` must be in order; each first member is its tree's root."""
        items, cluster = np.arange(len(prints)), np.cumsum(np.append(True, shards[1:] != shards[:-1])) - 1
        self.roots = shards[starts_of_runs(shards)]
        nodes, child_at, grown = [], [], 0
        while len(items):
            first = starts_of_runs(cluster)
            node = items[first]
            nodes.append(node)
            rest = np.ones(len(items), bool)
            rest[first] = False
            items, cluster = items[rest], cluster[rest]
            edge = np.bitwise_count(prints[items] ^ prints[node[cluster]])
            place = (grown + cluster) << 7 | edge
            order = np.argsort(place, kind="stable")
            items, place = items[order], place[order]
            new = starts_of_runs(place)
            child_at.append(place[new])
            grown += len(node)
            cluster = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(place))))
        self.item = np.concatenate(nodes) if nodes else items
        self.prints = prints[self.item]
        self.child_at = np.concatenate(child_at) if child_at else items

    def links(self, prints: np.ndarray, shards: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(search, member) index pairs within the radius, each search in its shard's tree."""
        if not len(self.roots) or not len(prints):
            return
        root = np.minimum(np.searchsorted(self.roots, shards), len(self.roots) - 1)
        search = np.flatnonzero(self.roots[root] == shards)
        stack = [(search, root[search])]
        while stack:
            search, node = stack.pop()
            if len(search) > FRONTIER:
                half = len(search) // 2
                stack += [(search[:half], node[:half]), (search[half:], node[half:])]
                continue
            distance = np.bitwise_count(prints[search] ^ self.prints[node]).astype(np.int64)
            near = distance <= radius
            yield search[near], self.item[node[near]]
            low = np.searchsorted(self.child_at, node << 7 | np.maximum(distance - radius, 0))
            many = np.searchsorted(self.child_at, node << 7 | (distance + radius), "right") - low
            if many.any():
                before = np.cumsum(many) - many
                child = np.repeat(low - before, many) + np.arange(many.sum())
                stack.append((np.repeat(search, many), len(self.roots) + child))


def lowest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (each item's lowest known relative) after joining a[i] with b[i]."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (up := label[label])).any():
            label = up


def joined(cells: np.ndarray, prints: np.ndarray, in_tree: np.ndarray, searches: np.ndarray,
           radius: int) -> np.ndarray:
    """For rows ordered by cell: the index of the lowest row that links reach."""
    tree, search = np.flatnonzero(in_tree), np.flatnonzero(searches)
    label = np.arange(len(prints))
    for a, b in Forest(prints[tree], cells[tree]).links(prints[search], cells[search], radius):
        label = lowest(label, search[a], tree[b])
    return label


def shard_links(shards: DataFrame, radius: int) -> DataFrame:
    """(fingerprint, other) links, one per member and shard at most.  ``shards`` has
    (shard, i, j, piece, fingerprint): tree of piece i, searches of piece j."""
    rows = (shards.repartition(partitions(shards.sparkSession), "shard", "i", "j")
            .sortWithinPartitions("shard", "i", "j"))

    def solve(part: pa.Table) -> pa.RecordBatch:
        shard, i, j, piece, signed = (part.column(c).to_numpy() for c in range(5))
        new = (shard[1:] != shard[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        cells = np.cumsum(np.append(False, new))
        label = joined(cells, signed.view(np.uint64), piece == i, piece == j, radius)
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(signed[linked]), pa.array(signed[label[linked]])],
                                          names=["fingerprint", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < ROWS:
                continue
            part = pa.Table.from_batches(held).combine_chunks()
            key = [part.column(c).to_numpy() for c in range(3)]
            other = np.flatnonzero((key[0] != key[0][-1]) | (key[1] != key[1][-1]) | (key[2] != key[2][-1]))
            whole = int(other[-1]) + 1 if len(other) else 0  # the last cell may go on
            if whole:
                yield solve(part.slice(0, whole))
            held = part.slice(whole).to_batches()
            size = part.num_rows - whole
        if size:
            yield solve(pa.Table.from_batches(held).combine_chunks())

    return in_arrow(rows, run, "fingerprint long, other long")


def to_shards(prints: DataFrame, radius: int) -> DataFrame:
    """The shard rows of distinct fingerprints; hot shards in pieces."""
    blocks = radius + 2
    edges = [64 * b // blocks for b in range(blocks + 1)]
    bits = [F.shiftrightunsigned("fingerprint", a).bitwiseAND(F.lit((1 << (b - a)) - 1))
            for a, b in zip(edges, edges[1:])]
    pairs = list(combinations(range(blocks), 2))
    width = max(b - a for a, b in zip(edges, edges[1:]))
    keys = [F.lit(t << 2 * width).bitwiseOR(F.shiftleft(bits[x], width)).bitwiseOR(bits[y])
            for t, (x, y) in enumerate(pairs)]
    rows = prints.select(F.explode(F.array(*keys)).alias("shard"), "fingerprint")
    hot = cut(rows.groupBy("shard").agg(F.count("*").alias("_n")).filter(F.col("_n") > SHARD)
              .select(F.col("shard").alias("_hot"), F.ceil(F.col("_n") / SHARD).cast("int").alias("_pieces")),
              "op1-hot-shards")
    pieced = (rows.join(hot, F.col("shard") == F.col("_hot"), "left")
              .withColumn("_pieces", F.coalesce("_pieces", F.lit(1)))
              .withColumn("piece", F.pmod(F.xxhash64("fingerprint"), F.col("_pieces")).cast("int"))
              .withColumn("_other", F.explode(F.expr("sequence(0, _pieces - 1)"))))
    return pieced.select("shard", F.least("piece", "_other").alias("i"), F.greatest("piece", "_other").alias("j"),
                         "piece", "fingerprint")


# --- components ------------------------------------------------------------
def components(links: DataFrame) -> DataFrame:
    """(node, root): every linked node but the roots, with its component's lowest node.

    Large-star: each node sends its higher neighbours to its lowest one.
    Small-star: each node sends itself and its lower neighbours to the lowest.
    The links are a star per component when neither changes anything."""
    edges = cut(links.select(F.greatest("fingerprint", "other").alias("a"), F.least("fingerprint", "other").alias("b"))
                .filter("a <> b").distinct(), "op1-links")
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("_b")).select(
            F.col("a").alias("_a"), F.least("a", "_b").alias("_low"))
        large = (both.join(low, F.col("a") == F.col("_a")).filter("b > a")
                 .select(F.col("b").alias("a"), F.col("_low").alias("b")).filter("a <> b").distinct())
        large = cut(large, "op1-large-star")
        low = large.groupBy("a").agg(F.min("b").alias("_low")).withColumnRenamed("a", "_a")
        moved = (large.join(low, F.col("a") == F.col("_a")).filter("b <> _low")
                 .select(F.col("b").alias("a"), F.col("_low").alias("b")))
        small = moved.union(low.select("_a", "_low")).filter("a <> b")
        edges = cut(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                    "op1-small-star")


def near_dup_components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS,
                        doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id."""
    prints = cut(fingerprints(docs, shingle, doc_id, text), "op1-fingerprints")
    nodes = cut(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("_first")), "op1-distinct")
    star = components(shard_links(to_shards(nodes.select("fingerprint"), radius), radius))
    rooted = (nodes.join(star, F.col("fingerprint") == F.col("node"), "left")
              .select("fingerprint", "_first", F.coalesce("root", "fingerprint").alias("_root")))
    rooted = cut(rooted, "op1-rooted")
    ids = rooted.groupBy("_root").agg(F.min("_first").alias("component_id")).withColumnRenamed("_root", "_r")
    named = cut(rooted.join(cut(ids, "op1-ids"), F.col("_root") == F.col("_r"))
                .select(F.col("fingerprint").alias("_print"), "component_id"), "op1-components")
    return prints.join(named, F.col("fingerprint") == F.col("_print")).select(
        F.col("doc_id").alias(doc_id), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS,
                     doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents whose component has a smaller id."""
    found = near_dup_components(docs, shingle, radius, doc_id, text)
    dropped = cut(found.filter(F.col(doc_id) != F.col("component_id"))
                  .select(F.col(doc_id).alias("_dropped")).distinct(), "op1-dropped")
    return unpacked(packed(docs).join(dropped, F.col("_row")[doc_id] == F.col("_dropped"), "left_anti"))


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup_components(table(spark, sf_dir, "documents"))
