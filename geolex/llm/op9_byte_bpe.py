"""Byte-level BPE with vectorised pre-tokenisation, and its inverse.

A text becomes an array of code points.  A table gives each its class (letter,
number, white space, other); with one look at the neighbours each position
becomes a symbol, and each symbol is a function on the splitter's eight
states.  Those functions form a small monoid, so a prefix scan of table
look-ups (doubling its reach, and touching only positions whose function is
not yet constant) yields the state at every position, and with it every
boundary, without a regular expression.  The slices between boundaries go
through the merge ranks; slices already seen come from a bounded cache.
Decoding gathers the ids' bytes by offset.

The split is that of ``public_tokenizers.PATTERN``: contractions ('s 't 're
've 'm 'll 'd), runs of letters, of numbers, of others, each with an optional
space before it, and white space.

Rules: null text counts as empty; empty text has no ids.  Bytes that are not
UTF-8 are read as U+FFFD.  Special tokens are ordinary text.  Rows are
independent, so repeated rows, null ids and any extra columns do no harm.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField

from geolex.llm.common import named, replaced, table

#: Characters handled at once in a task (more if one text has more), and slices
#: that the cache may hold.
CHUNK_CHARS = 1 << 18
CACHE_SLICES = 1 << 18
CACHED_BYTES = 64
BATCH_SLICES = 1 << 13

# --- the splitter: classes, symbols, states -------------------------------
LETTER, NUMBER, OTHER, SPACE = range(4)
# INSIDE: white space before white space or the end; LEAD: a space before
# something else; BREAK: other white space before something else; QUOTE1/2: an
# apostrophe that one / two letters may complete to a contraction.
S_LETTER, S_NUMBER, S_OTHER, S_INSIDE, S_LEAD, S_BREAK, S_QUOTE1, S_QUOTE2 = range(8)
# FRESH: the next position begins a slice whatever it is; LEADING: a space that
# the next position joins; NEED1/2: letters that the contraction still takes.
FRESH, LETTERS, NUMBERS, OTHERS, BLANKS, LEADING, NEED1, NEED2 = range(8)

#: Unicode White_Space (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
               0x205F, 0x3000]

#: Letters and numbers that Unicode 16 added, as (first, last) (fixed values); the tokenizer
#: library follows that version, Python's tables may be older.
LETTERS_16 = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
              (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
              (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
              (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
              (0x1E5F0, 0x1E5F0)]
NUMBERS_16 = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
              (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]


def step(symbol: int, state: int) -> tuple[int, bool]:
    """Next state, and whether a slice begins here."""
    if state in (NEED1, NEED2) and symbol == S_LETTER:
        return (FRESH if state == NEED1 else NEED1), False
    joins = state == LEADING
    if symbol == S_LETTER:
        return LETTERS, not (joins or state == LETTERS)
    if symbol == S_NUMBER:
        return NUMBERS, not (joins or state == NUMBERS)
    if symbol == S_OTHER or (symbol in (S_QUOTE1, S_QUOTE2) and (joins or state == OTHERS)):
        return OTHERS, not (joins or state == OTHERS)
    if symbol in (S_QUOTE1, S_QUOTE2):
        return (NEED1 if symbol == S_QUOTE1 else NEED2), True
    if symbol == S_INSIDE:
        return BLANKS, state != BLANKS
    return (LEADING if symbol == S_LEAD else FRESH), True


@lru_cache(maxsize=1)
def machine() -> tuple[np.ndarray, ...]:
    """Generators of the monoid by symbol, its multiplication table, the state that
    an element's function always gives (255 if it is not constant), the
    boundary flags, and the constant element of each state."""
    functions = [tuple(step(s, q)[0] for q in range(8)) for s in range(8)]
    known = dict.fromkeys(functions + [(q,) * 8 for q in range(8)])  # 14 in the end, so products fit a byte
    while True:
        new = {tuple(g[x] for x in f) for f in known for g in known} - known.keys()
        if not new:
            break
        known |= dict.fromkeys(sorted(new))
    index = {f: i for i, f in enumerate(known)}
    times = np.array([[index[tuple(g[x] for x in f)] for g in known] for f in known], np.uint8)
    constant = np.array([f[0] if len(set(f)) == 1 else 255 for f in known], np.uint8)
    begins = np.array([[step(s, q)[1] for q in range(8)] for s in range(8)])
    return (np.array([index[f] for f in functions], np.uint8), times, constant, begins,
            np.array([index[(q,) * 8] for q in range(8)], np.uint8))


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    out[WHITE_SPACE] = SPACE
    for kind, added in ((LETTER, LETTERS_16), (NUMBER, NUMBERS_16)):
        for first, last in added:
            out[first:last + 1] = kind
    return out


def slice_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Positions at which slices begin, in the code points of several texts laid end
    to end; ``firsts`` are the positions of the (non-empty) texts' first ones."""
    generators, times, constant, begins, constants = machine()
    kind = classes()[points]
    last = np.zeros(len(points), bool)
    last[firsts[1:] - 1] = last[-1] = True
    follow = np.append(points[1:], 0)
    symbol = kind.copy()  # letter, number and other are numbered alike
    blank = kind == SPACE
    before_text = blank & np.append(~blank[1:], False) & ~last
    symbol[blank] = S_INSIDE
    symbol[before_text] = S_BREAK
    symbol[before_text & (points == 0x20)] = S_LEAD
    quote = np.flatnonzero((points == 0x27) & ~last)
    if len(quote):
        one = follow[quote]
        two = np.where(last[quote + 1], 0, follow[np.minimum(quote + 1, len(points) - 1)])
        symbol[quote[np.isin(one, [ord(c) for c in "stmd"])]] = S_QUOTE1
        pair = one.astype(np.int64) << 32 | two
        symbol[quote[np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])]] = S_QUOTE2

    element = generators[symbol]
    element[firsts] = constants[constant[times[constants[FRESH], element[firsts]]]]
    flat, base = times.ravel(), np.uint8(len(times))
    for reach in (1, 2):  # most functions are constant by now
        element[reach:] = flat[element[:-reach] * base + element[reach:]]
    reach, open_ = 4, np.flatnonzero(constant[element] == 255)
    while len(open_):
        element[open_] = times[element[open_ - reach], element[open_]]
        open_ = open_[constant[element[open_]] == 255]
        reach *= 2
    state = np.empty(len(points), np.uint8)
    state[1:] = constant[element[:-1]]
    state[firsts] = FRESH
    return np.flatnonzero(begins.ravel()[symbol * np.uint8(8) + state])


# --- merging ---------------------------------------------------------------
class Vocabulary:
    """The rank file's tables, and a bounded cache from slice to the bytes of its ids
    (unsigned 32-bit, little-endian)."""

    def __init__(self, rank_file: bytes):
        pairs = [line.split() for line in rank_file.splitlines() if line]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        words: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for word, i in self.ranks.items():
            words[i] = word
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(words), np.uint8)
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.none = len(words)
        self.hash_pairs()
        self.cache: dict[bytes, bytes] = {}

    def hash_pairs(self) -> None:
        """An open-addressing table from a pair of ids to the id of the joined word."""
        ranks = self.ranks
        found = {ranks[w[:k]] << 32 | ranks[w[k:]]: i for w, i in ranks.items() for k in range(1, len(w))
                 if w[:k] in ranks and w[k:] in ranks}
        keys, joined = np.array(list(found), np.int64), np.array(list(found.values()), np.int64)
        self.bits = max(4, int(np.ceil(np.log2(4 * len(keys) + 1))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.joined = np.full(1 << self.bits, self.none, np.int64)
        slot = self.slot(keys)
        while len(keys):
            self.keys[slot] = np.where(self.keys[slot] == -1, keys, self.keys[slot])  # one of those that meet
            here = self.keys[slot] == keys
            self.joined[slot[here]] = joined[here]
            keys, joined, slot = keys[~here], joined[~here], (slot[~here] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id of each joined pair, ``none`` if there is none (or an id is -1)."""
        keys = left << 32 | right
        slot = self.slot(keys)
        out = np.full(len(keys), self.none, np.int64)
        left_over = np.flatnonzero((left >= 0) & (right >= 0))
        while len(left_over):
            at = slot[left_over]
            same = self.keys[at] == keys[left_over]
            out[left_over[same]] = self.joined[at[same]]
            left_over = left_over[~same & (self.keys[at] != -1)]
            slot[left_over] = (slot[left_over] + 1) & ((1 << self.bits) - 1)
        return out

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """The id bytes of slices of similar length, merged side by side: in each round
        every slice joins its adjacent pair of the lowest rank, the leftmost first."""
        width = max(map(len, pieces))
        sizes = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        column = np.arange(width)
        ids = np.where(column < sizes[:, None], self.single[raw], -1)
        costs = np.full(ids.shape, self.none)  # of joining a column and the next
        costs[:, :-1] = self.join(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        rows = np.arange(len(ids))
        while len(rows):
            at = costs[rows].argmin(1)
            least = costs[rows, at]
            going = least < self.none
            rows, at, least = rows[going], at[going], least[going]
            if not len(rows):
                break
            take = np.minimum(column + (column > at[:, None]), width - 1)
            now, price = np.take_along_axis(ids[rows], take, 1), np.take_along_axis(costs[rows], take, 1)
            k = np.arange(len(rows))
            now[:, -1] = -1
            price[:, -1] = self.none
            now[k, at] = least
            price[k, at] = self.join(least, now[k, np.minimum(at + 1, width - 1)])
            inner = np.flatnonzero(at)
            price[inner, at[inner] - 1] = self.join(now[inner, at[inner] - 1], least[inner])
            ids[rows], costs[rows] = now, price
            sizes[rows] -= 1
        data = ids.astype("<u4").tobytes()
        return [data[4 * i * width:4 * (i * width + n)] for i, n in enumerate(sizes.tolist())]

    def merge_long(self, piece: bytes) -> list[int]:
        """The ids of one slice of any length, with a heap of pairs over linked parts."""
        ranks, n = self.ranks, len(piece)
        end, left, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

        def pair(i: int) -> tuple[int, int, int] | None:
            rank = ranks.get(piece[i:end[end[i]]]) if end[i] < n else None
            return None if rank is None else (rank, i, end[end[i]])

        heap = [x for x in map(pair, range(n)) if x]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            alive[end[i]] = False
            end[i] = stop
            if stop < n:
                left[stop] = i
            for j in (i, left[i]):
                if j >= 0 and (x := pair(j)):
                    heapq.heappush(heap, x)
        return [ranks[piece[i:end[i]]] for i in range(n) if alive[i]]

    def learn(self, pieces: set[bytes]) -> dict[bytes, bytes]:
        """Brings new slices into the cache; returns those too long to be kept there."""
        if len(self.cache) > CACHE_SLICES:
            self.cache.clear()
        groups, long = {}, {}
        for piece in pieces.difference(self.cache):
            if piece in self.ranks:
                self.cache[piece] = self.ranks[piece].to_bytes(4, "little")
            elif len(piece) > CACHED_BYTES:
                long[piece] = np.array(self.merge_long(piece), "<u4").tobytes()
            else:
                groups.setdefault(-(-len(piece) // 8), []).append(piece)
        for same in groups.values():
            for i in range(0, len(same), BATCH_SLICES):
                batch = same[i:i + BATCH_SLICES]
                self.cache.update(zip(batch, self.merge_all(batch)))
        return long

    def encode(self, texts: list[str]) -> list[bytes]:
        """The id bytes of each text."""
        sizes = np.array([len(t) for t in texts], np.int64)
        out = [b""] * len(texts)
        full = np.flatnonzero(sizes)
        if not len(full):
            return out
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        firsts = (np.cumsum(sizes) - sizes)[full]
        starts = slice_starts(points, firsts)
        width = (points >= 0x80).view(np.uint8) + (points >= 0x800) + (points >= 0x10000) + np.uint8(1)
        at = (np.cumsum(width, dtype=np.int64) - width)[starts].tolist()
        data = joined.encode()
        pieces = [data[a:b] for a, b in zip(at, [*at[1:], len(data)])]
        long = self.learn(set(pieces))
        known = self.cache | long if long else self.cache
        pieces = list(map(known.__getitem__, pieces))
        cuts = [*np.searchsorted(starts, firsts).tolist(), len(pieces)]
        for i, a, b in zip(full.tolist(), cuts, cuts[1:]):
            out[i] = b"".join(pieces[a:b])
        return out

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids' bytes and the offset at which each id's bytes begin."""
        lengths = self.lengths[ids]
        offsets = np.cumsum(lengths) - lengths
        where = np.repeat(self.starts[ids] - offsets, lengths)
        return self.bytes[where + np.arange(len(where))], offsets


    def encode_all(self, raw: list[bytes | None]) -> list[bytes]:
        return [ids for run in chunks(raw) for ids in self.encode(run)]

    def decode_all(self, raw: list[bytes | None]) -> list[bytes]:
        return [self.decode(np.frombuffer(ids or b"", "<u4"))[0].tobytes() for ids in raw]


@lru_cache(maxsize=2)
def vocabulary(rank_file: bytes) -> Vocabulary:
    return Vocabulary(rank_file)


def chunks(texts: list[bytes | None]) -> Iterator[list[str]]:
    """Texts in runs of about CHUNK_CHARS; a longer text is a run of its own."""
    run, size = [], 0
    for raw in texts:
        text = (raw or b"").decode("utf-8", "replace")
        if run and size + len(text) > CHUNK_CHARS:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def read_ranks(path: str | None = None) -> bytes:
    """The rank file's bytes (under 1 MB); shipped to the tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``df`` with ``ids`` (unsigned 32-bit little-endian) in place of the text."""
    rank_file = df.sparkSession.sparkContext.broadcast(read_ranks(path))

    def make(raw: list[bytes | None]) -> list[pa.Array]:
        return [pa.array(vocabulary(rank_file.value).encode_all(raw), pa.binary())]

    return replaced(df, text, [StructField("ids", BinaryType())], make)


def decode(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` with the bytes ``decoded`` in place of ``ids``."""
    rank_file = df.sparkSession.sparkContext.broadcast(read_ranks(path))

    def make(raw: list[bytes | None]) -> list[pa.Array]:
        return [pa.array(vocabulary(rank_file.value).decode_all(raw), pa.binary())]

    return replaced(df, "ids", [StructField("decoded", BinaryType())], make)


def encode_and_decode(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``df`` with ``ids`` and the bytes ``decoded`` from them in place of the text: both
    directions in one worker."""
    rank_file = df.sparkSession.sparkContext.broadcast(read_ranks(path))

    def make(raw: list[bytes | None]) -> list[pa.Array]:
        words = vocabulary(rank_file.value)
        ids = words.encode_all(raw)
        return [pa.array(ids, pa.binary()), pa.array(words.decode_all(ids), pa.binary())]

    return replaced(df, text, [StructField("ids", BinaryType()), StructField("decoded", BinaryType())], make)


def encoded_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encodes, decodes again, and keeps counts and digests of both (and the ids)."""
    both = encode_and_decode(docs.select(named(doc_id).alias("doc_id"), named(text).alias("text")))
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
                       *["ids"] * keep_ids)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(table(spark, sf_dir, "documents"))
