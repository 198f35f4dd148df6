"""Phrase collocations by the stripes pattern.

Texts (only A-Z lower-cased) are cut at ``[.,;:!?]`` and line ends into pieces, pieces into words
``[^\\x20\\x09]+``; everything is counted per language.  A stripe belongs to a
prefix of 0 to 3 words and counts the words that follow it.  A task builds the
stripes of about ``RUN`` bytes of text at a time and sends those on, not the
phrases; stripes of one prefix are then merged elementwise.  Merged stripes give
all that scores need: entries of ``LEAST`` and more are the phrases one word longer,
with their frequencies; a prefix's own total is its entry in the stripe of its words
but the last (the empty prefix has the words themselves, and its total is the number
of all words); the greatest entry is the most frequent longer phrase that begins
with the prefix, and the greatest entry among phrases with the same last words the
most frequent one that ends so.  (A phrase in the middle of a longer one also ends a shorter one
that is no rarer, so these two maxima decide.)

Stripes grow word by word: a phrase can only reach ``LEAST`` if both its parts one
word shorter have, so a position is counted only if they pass a bit set of the
frequent phrases.  The bit set has 16 bits a phrase, at most ``BITS`` (16 MB); false
hits cost work only, as does a full bit set beyond that: counts stay exact.  It is
built from aggregated 64-bit words of it and is the only thing broadcast.

Hot prefixes: prefixes of ``HOT`` occurrences and more are marked in a second bit set
of the same kind, and their stripes are dealt to ``SLICES`` by the hash of the next
word; so is the empty prefix.  Stripes are merged in a sorted stream, one slice at a
time, so a task never holds more than a slice.

Rules: null text is empty, null ``lang`` is ``und``.  Repeated rows count as often as they
stand there.  Long texts are taken in runs cut at piece ends.  Scores use exact
decimals.  Of a candidate's cuts the lowest score counts (at ties the smallest k),
candidates of equal score and frequency go by the phrase's bytes.  Only ``text`` and
``lang`` are read.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geolex.llm.common import cut, in_arrow, named, table

#: Least frequency, longest phrase in words, per cent that subsumes, phrases reported per language.
LEAST, LONGEST, SUBSUMED, TOP = 30, 4, 80, 2000
#: Bytes of text whose stripes a task builds at once; most bits of a bit set.
RUN, BITS = 16 << 20, 1 << 27
#: A prefix of so many occurrences is hot; slices of a hot stripe; parts in which phrases are ranked first.
HOT, SLICES, PARTS = 1 << 20, 256, 64

END = b"\n"
FOLD = bytes.maketrans(bytes(range(ord("A"), ord("Z") + 1)) + b".,;:!?\x0b\x0c\r\t",
                       bytes(range(ord("a"), ord("z") + 1)) + END * 9 + b" ")


class Numbered(dict):
    """Numbers words as they are asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def word_hashes(words: list[bytes], lang: bytes) -> np.ndarray:
    seed, digest = xxhash.xxh32_intdigest(lang), xxhash.xxh64_intdigest
    return np.array([digest(w, seed) for w in words], np.uint64)


def mixed(hashes: list[np.ndarray]) -> np.ndarray:
    """One 64-bit hash of the words at the same place of each array."""
    out = np.zeros_like(hashes[0])
    for h in hashes:
        out = (out ^ h) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def phrase_hashes(lang: bytes, phrases: list[bytes]) -> np.ndarray:
    """Hashes of phrases that have as many words each."""
    return mixed([word_hashes(words, lang) for words in zip(*(p.split(b" ") for p in phrases))])


def inside(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(bits) * 64 - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def bit_set(phrases: DataFrame) -> Broadcast:
    """A bit set of (lang, phrase) of as many words each, its size a power of two from 16 bits a phrase."""
    spark = phrases.sparkSession
    size = min(BITS, 1 << max(16, (16 * phrases.count() - 1).bit_length()))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in batch.column(0).unique():
                phrases = batch.column(1).filter(pc.equal(batch.column(0), lang)).to_pylist()
                at = (phrase_hashes(lang.as_py(), phrases) & np.uint64(size - 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(at & 63, pa.int32())], names=["at", "bit"])

    given = phrases.select(F.col("lang").cast("binary"), F.col("phrase").cast("binary"))
    words = (in_arrow(given, hashed, "at long, bit int").groupBy("at")
             .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow())  # at most BITS / 64 rows
    out = np.zeros(size // 64, np.uint64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(out)


def runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[bytes, bytes]]:
    """(lang, folded text) of many texts of one language, of about ``size`` bytes together at most."""
    held: dict[bytes, list[bytes]] = {}
    sizes: dict[bytes, int] = {}
    total = 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            text = (text.as_py() or b"").translate(FOLD)
            lang = lang.as_py()
            while len(text) > size:
                end = text.rfind(END, 0, size)
                end = end if end > 0 else text.find(END, size)
                if end < 0:
                    break
                yield lang, text[:end]
                text = text[end + 1:]
            held.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text)
            total += len(text)
            if total > size:
                most = max(sizes, key=sizes.get)
                total -= sizes.pop(most)
                yield most, END.join(held.pop(most))
    for lang, texts in held.items():
        yield lang, END.join(texts)


#: ``key`` is prefix, slice and language, joined by END; ``nexts`` the next words, joined by spaces;
#: ``counts`` as many 64-bit integers.
STRIPE = "key binary, nexts binary, counts binary"


def packed_stripes(keys: list[bytes], starts: np.ndarray, nexts: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    """Stripes of which the i-th has the words and counts from ``starts[i]`` on."""
    ends = np.append(starts, len(counts)).astype(np.int32)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), nexts), b" ")
    raw = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends * 8), pa.py_buffer(
        np.ascontiguousarray(counts, np.int64))])
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), joined, raw], names=["key", "nexts", "counts"])


def unpacked_stripes(stripes: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The number of each entry's stripe, its word and its count."""
    words = pc.split_pattern(stripes.column(1), " ")
    sizes = words.value_lengths().to_numpy()
    counts = np.frombuffer(b"".join(stripes.column(2).to_pylist()), np.int64)
    return np.repeat(np.arange(len(sizes)), sizes), words.flatten(), counts


def stripes_of(lang: bytes, text: bytes, length: int, frequent: np.ndarray | None,
               hot: np.ndarray | None) -> pa.RecordBatch | None:
    """The stripes of a run of text for phrases of ``length`` words; none if there are no such phrases."""
    numbers = Numbered({END: 0})
    tokens = filter(None, text.replace(END, b" \n ").split(b" "))
    ids = np.fromiter(map(numbers.__getitem__, tokens), np.int64)
    words, many = list(numbers), len(numbers)
    hashes = word_hashes(words, lang)
    if len(ids) < length:
        return None
    if length == 1:
        counts = np.bincount(ids, minlength=many)
        nexts = np.arange(1, many)
        prefixes, counts = np.zeros(many - 1, np.int64), counts[1:]
        prefix_words = [b""]
        slices = (hashes[1:] % np.uint64(SLICES)).astype(np.int64)
    else:
        # both parts of length - 1 words must be frequent
        n = len(ids) - length + 2
        inner = ids > 0
        whole = inner[:n].copy()
        for j in range(1, length - 1):
            whole &= inner[j:j + n]
        part = np.flatnonzero(whole)
        good = np.zeros(n, bool)
        good[part] = inside(frequent, mixed([hashes[ids[part + j]] for j in range(length - 1)]))
        at = np.flatnonzero(good[:-1] & good[1:])
        if not len(at):
            return None
        code = ids[at]
        for j in range(1, length - 1):
            code = np.unique(code * many + ids[at + j], return_inverse=True)[1]
        code, first, counts = np.unique(code * many + ids[at + length - 1], return_index=True, return_counts=True)
        nexts = code % many
        starts = np.flatnonzero(np.diff(code // many, prepend=-1))
        prefixes = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(code)))
        columns = [ids[at[first[starts]] + j] for j in range(length - 1)]
        prefix_words = [b" ".join(p) for p in zip(*([words[i] for i in c.tolist()] for c in columns))]
        is_hot = inside(hot, mixed([hashes[c] for c in columns]))
        slices = np.where(is_hot[prefixes], (hashes[nexts] % np.uint64(SLICES)).astype(np.int64), 0)
    order = np.lexsort((slices, prefixes))
    prefixes, slices, nexts, counts = prefixes[order], slices[order], nexts[order], counts[order]
    starts = np.flatnonzero(np.diff(prefixes * SLICES + slices, prepend=-1))
    keys = [b"%b\n%d\n%b" % (prefix_words[p], part, lang)
            for p, part in zip(prefixes[starts].tolist(), slices[starts].tolist())]
    return packed_stripes(keys, starts, pa.array(words, pa.binary()).take(pa.array(nexts)), counts)


def merge_sorted(stripes: pa.RecordBatch) -> tuple[list[bytes], np.ndarray, pa.Array, np.ndarray]:
    """Stripes of equal keys, which follow each other, become one: (keys, starts, words, counts), with the end
    as last start."""
    keys = stripes.column(0).dictionary_encode()
    row, words, counts = unpacked_stripes(stripes)
    words = words.dictionary_encode()
    many = len(words.dictionary)
    code = keys.indices.to_numpy()[row].astype(np.int64) * many + words.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    code, sums = code[first], np.add.reduceat(counts[order], first)
    starts = np.append(np.flatnonzero(np.diff(code // many, prepend=-1)), len(code))
    return keys.dictionary.to_pylist(), starts, words.dictionary.take(pa.array(code % many)), sums


def finished(keys: list[bytes], starts: np.ndarray, words: pa.Array, counts: np.ndarray, least: int) -> pa.RecordBatch:
    """The whole stripes' totals and entries of ``least`` and more; those without any are left out, but for the
    empty prefix."""
    kept = counts >= least
    sizes, totals = np.add.reduceat(kept.astype(np.int64), starts[:-1]), np.add.reduceat(counts, starts[:-1])
    parts = [key.split(END, 2) for key in keys]
    told = np.flatnonzero((sizes > 0) | np.array([not prefix for prefix, _, _ in parts]))
    offsets = pa.array(np.append(0, np.cumsum(sizes[told])).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array([parts[i][2] for i in told], pa.binary()), pa.array([parts[i][0] for i in told], pa.binary()),
         pa.array(totals[told]), pa.ListArray.from_arrays(offsets, words.filter(pa.array(kept))),
         pa.ListArray.from_arrays(offsets, pa.array(counts[kept]))],
        names=["lang", "prefix", "total", "nexts", "counts"])


def merged_stripes(docs: DataFrame, length: int, frequent: Broadcast | None, hot: Broadcast | None, least: int,
                   run: int) -> DataFrame:
    """(lang, prefix, total, nexts, counts) of the merged slices."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in runs(batches, run):
            made = stripes_of(lang, text, length, frequent and frequent.value, hot and hot.value)
            for at in range(0, made.num_rows if made else 0, 8192):
                yield made.slice(at, 8192)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last stripe so far, which the next rows may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            stripes = pa.RecordBatch.from_arrays(batch.columns, names=["key", "nexts", "counts"])
            keys, starts, words, counts = merge_sorted(pa.concat_batches([held, stripes]) if held else stripes)
            last, entry = len(keys) - 1, int(starts[-2])
            held = packed_stripes(keys[last:], np.zeros(1, np.int64), words.slice(entry), counts[entry:])
            if last:
                yield finished(keys[:last], starts[:-1], words.slice(0, entry), counts[:entry], least)
        if held:
            yield finished(*merge_sorted(held), least)

    dealt = in_arrow(docs, build, STRIPE).repartition("key").sortWithinPartitions("key")
    return in_arrow(dealt, merge, "lang binary, prefix binary, total long, nexts array<binary>, counts array<long>")


def phrases_of(stripes: DataFrame) -> DataFrame:
    """(lang, phrase, prefix, f): the entries of merged stripes."""
    rows = stripes.select("lang", "prefix", F.inline(F.arrays_zip(F.col("nexts").alias("w"), F.col("counts").alias("f"))))
    return rows.select(F.col("lang").cast("string").alias("lang"), F.col("prefix").cast("string").alias("prefix"),
                       F.concat_ws(" ", F.when(F.length("prefix") > 0, F.col("prefix").cast("string")),
                                   F.col("w").cast("string")).alias("phrase"), "f")


def words_from(phrase: Column, first: Column, count: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, count), " ")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST,
         subsumed: int = SUBSUMED, top: int = TOP, run: int = RUN, hot: int = HOT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases."""
    given = docs.select(F.coalesce(named(lang).cast("string"), F.lit("und")).cast("binary").alias("lang"),
                        named(text).cast("binary").alias("text"))
    levels, frequent, marked = [], None, None
    for length in range(1, longest + 1):
        stripes = cut(merged_stripes(given, length, frequent, marked, least, run), f"op13-stripes-{length}")
        if length == 1:
            totals = stripes.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.sum("total").alias("n"))
        levels.append(cut(phrases_of(stripes), f"op13-phrases-{length}"))
        if length < longest:
            frequent = bit_set(levels[-1])
            marked = bit_set(levels[-1].filter(F.col("f") >= hot))
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    size = F.size(F.split("phrase", " "))
    longer = every.withColumn("_size", size).filter("_size > 2")
    maxima = (longer.select("lang", F.col("prefix").alias("phrase"), "f")
              .unionByName(longer.select("lang", words_from(F.col("phrase"), F.lit(2), F.col("_size") - 1).alias("phrase"), "f"))
              .groupBy("lang", "phrase").agg(F.max("f").alias("_longer")))
    candidates = (every.select("lang", "phrase", F.col("f").alias("a")).withColumn("_size", size).filter("_size > 1")
                  .join(maxima, ["lang", "phrase"], "left")
                  .filter(F.col("_longer").isNull() | (100 * F.col("_longer") < subsumed * F.col("a"))).drop("_longer"))
    cuts = (candidates.withColumn("_k", F.explode(F.expr("sequence(1, _size - 1)")))
            .withColumn("_first", words_from(F.col("phrase"), F.lit(1), F.col("_k")))
            .withColumn("_rest", words_from(F.col("phrase"), F.col("_k") + 1, F.col("_size") - F.col("_k"))))
    first = every.select("lang", F.col("phrase").alias("_first"), F.col("f").alias("l"))
    rest = every.select("lang", F.col("phrase").alias("_rest"), F.col("f").alias("r"))
    # a frequency has at most 19 digits, so the product has at most 26
    score = F.expr("(2000000 * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    scored = (cuts.join(first, ["lang", "_first"]).join(rest, ["lang", "_rest"]).withColumn("score", score)
              .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "_k", "l", "r")).alias("_cut"))
              .select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = Window.partitionBy("lang", "_part").orderBy(*order)
    best = (scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
            .withColumn("rank", F.row_number().over(parts)).filter(F.col("rank") <= top).drop("_part", "rank")
            .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
            .filter(F.col("rank") <= top))
    return (best.join(totals, "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM w, (VALUES (1), (2), (3), (4)) s(size) WHERE len(w) >= size)
  GROUP BY lang, size, phrase HAVING count(*) >= 30),
inside AS (
  SELECT lang, array_to_string(p[i:i + k - 1], ' ') AS phrase, max(f) AS longer
  FROM (SELECT lang, p, size, f, k, unnest(range(1, size - k + 2)) AS i
        FROM (SELECT lang, string_split(phrase, ' ') AS p, size, f FROM f), (VALUES (2), (3)) s(k) WHERE k < size)
  GROUP BY ALL),
c AS (
  SELECT f.lang, f.phrase, f.size, f.f AS a FROM f LEFT JOIN inside i ON f.lang = i.lang AND f.phrase = i.phrase
  WHERE f.size > 1 AND (i.longer IS NULL OR 100 * i.longer < 80 * f.f)),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(p[1:k], ' ') AS first, array_to_string(p[k + 1:], ' ') AS rest
  FROM (SELECT lang, phrase, a, string_split(phrase, ' ') AS p, unnest(range(1, size)) AS k FROM c)),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score, k
  FROM cuts JOIN f x ON cuts.lang = x.lang AND cuts.first = x.phrase JOIN f y ON cuts.lang = y.lang AND cuts.rest = y.phrase
  QUALIFY row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY score, k) = 1)
SELECT scored.lang, row_number() OVER (PARTITION BY scored.lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score
FROM scored JOIN n ON scored.lang = n.lang
QUALIFY row_number() OVER (PARTITION BY scored.lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
