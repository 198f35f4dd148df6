"""Packing, ranked search and collocations against brute force."""
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geolex.llm import op11_best_fit_packing as op11, op12_ranked_search as op12, op13_phrase_collocations as op13
from tests.conftest import SF001

BENCHMARK = "item_id long, text string"


def docs_of(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet")


# ---------------------------------------------------------------- op11
@pytest.fixture(scope="module")
def files():
    import public_tokenizers as P
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read(), op11.read_ranks(), P.PATTERN


@pytest.fixture(scope="module")
def whole(files):
    from tokenizers import Tokenizer
    t = Tokenizer.from_str(files[0])
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_are_the_tokenizers_on_every_code_point(files, whole):
    encode = op11.Encoder(*files).encode
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 64):
        text = "".join(f"a{c}b {c}1 1{c} .{c}a\n{c}  {c}'{c}s" for c in points[at:at + 64])
        assert encode(text) == whole(text), hex(ord(points[at]))


@pytest.mark.parametrize("text", ["", " ", " " * 300_000 + "x", "\n" * 200_000, "a" * 200_000, "<|endoftext|> x",
                                  "é" * 100_000, " \t\n" * 5000, "12 " * 100_000])
def test_ids_of_long_and_odd_texts(files, whole, text):
    assert op11.Encoder(*files).encode(text) == whole(text)


def expected_pieces(text, whole):
    ids = [*whole(text or ""), op11.END]
    over = len(ids) % op11.CAP
    starts = [0] if len(ids) <= op11.CAP else list(range(over or op11.CAP, len(ids), op11.CAP))
    if len(ids) > op11.CAP:
        starts = [0, *starts]
    ends = [*starts[1:], len(ids)]
    return [(k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))) for k, (a, b) in enumerate(zip(starts, ends))]


def assert_gapless(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= op11.CAP
    return len(by)


def test_packing_of_whole_documents(spark, whole):
    docs = docs_of(spark)
    rows = op11.op11_best_fit_packing(spark, SF001).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    assert {d: sorted(p) for d, p in got.items()} == {d: expected_pieces(t, whole) for d, t in texts.items()}
    used = assert_gapless(rows)
    bound = op11.lower_bound(np.bincount([r.length for r in rows], minlength=op11.CAP + 1), op11.CAP)
    assert bound <= used <= bound * 1.01 + 1


def test_packing_of_odd_tables(spark, odd, none, clashing, whole):
    packed = op11.pack_documents(odd).cache()
    rows = packed.collect()
    assert_gapless(rows)
    want = sorted(repr((r.doc_id, *p)) for r in odd.collect() for p in expected_pieces(r.text, whole))
    assert sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows) == want
    again = op11.pack_documents(clashing).collect()
    assert sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in again) == want
    assert op11.pack_documents(none).collect() == []
    # the sequences themselves: their pieces' ids one after another
    for r in op11.sequences(packed).collect():
        mine = sorted((p.offset, p.ids) for p in rows if p.sequence_id == r.sequence_id)
        assert r.ids == [i for _, ids in mine for i in ids]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=7))
def test_bounds_never_exceed_the_best_packing(sizes):
    cap = 12

    def fits(items, rooms):
        if not items:
            return True
        return any(rooms[i] >= items[0] and fits(items[1:], [*rooms[:i], rooms[i] - items[0], *rooms[i + 1:]])
                   for i in range(len(rooms)) if rooms[i] not in rooms[:i])

    sizes = sorted(sizes, reverse=True)
    best = next(n for n in range(1, len(sizes) + 1) if fits(sizes, [cap] * n))
    assert op11.lower_bound(np.bincount(sizes, minlength=cap + 1), cap) <= best
    bins, places, used = op11.best_fit(sizes, cap)
    assert best <= used <= len(sizes)
    loads = np.bincount(bins, sizes)
    assert (loads <= cap).all()


def test_bound_beats_the_sum_where_pieces_do_not_pair(spark):
    counts = np.zeros(1025, np.int64)
    counts[600] = 10
    assert op11.lower_bound(counts, 1024) == 10
    counts[:] = 0
    counts[400] = 9  # two of them fit
    assert op11.lower_bound(counts, 1024) == 5


def test_partitions_exchange_until_the_bound_is_met(spark):
    sizes = spark.range(3000).select(F.expr("cast(1 + pmod(xxhash64(id), 300) as long)").alias("length"),
                                     F.col("id").alias("doc_id"))
    packed = op11.pack(sizes, group=100)
    assert packed.count() == 3000
    used, bound = op11.certificate(packed)
    alone = sum(op11.best_fit(sorted(part, reverse=True), op11.CAP)[2] for part in np.array_split(
        [r.length for r in sizes.collect()], 30))
    assert used == assert_gapless(packed.collect())
    assert bound <= used <= bound + 1 < alone


def test_one_hot_length(spark):
    same = spark.range(2000).select(F.lit(500).cast("long").alias("length"))
    assert op11.certificate(op11.pack(same, group=128)) == (1000, 1000)
    with pytest.raises(ValueError):
        op11.pack(spark.range(1).select(F.lit(1025).alias("length")))


# ---------------------------------------------------------------- op12
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_search(docs, items, k=10):
    held = [(d, Counter(split_terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    N, L = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in held:
            m = 10 + 90 * c.total() * N // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                    for t in set(split_terms(text)) if t in c)
            if s > 0:
                scores.append((-s, d is None, d if d is not None else 0))
        out += [(item, r, None if absent else d, -s) for r, (s, absent, d) in enumerate(sorted(scores)[:k], 1)]
    return out


def test_terms_are_the_runs_of_the_pattern():
    text = "A1-b_c Ünï\x7fx 中文,é\x00Z"
    assert op12.terms(text.encode()) == {t.encode(): n for t, n in Counter(split_terms(text)).items()}
    long = "ab cd " * 300
    assert op12.terms(long.encode()) == {b"ab": 300, b"cd": 300}


def test_long_texts_are_read_in_stretches(monkeypatch):
    monkeypatch.setattr(op12, "STRETCH", 7)
    for text in ("abcdefghijklmnop qr", "a b c d e f g h i j", "a" * 50, "   " * 9 + "xyz", "abcdefg hi"):
        assert op12.terms(text.encode()) == {t.encode(): n for t, n in Counter(split_terms(text)).items()}


@pytest.mark.parametrize("limit", [op12.POSTINGS, 500])
def test_search_equals_brute_force(spark, limit):
    docs, items = docs_of(spark), spark.read.parquet(f"{SF001}/benchmark.parquet")
    got = sorted(map(tuple, op12.search(docs, items, limit=limit).collect()))
    want = brute_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got == sorted(want)


def test_search_of_odd_tables(spark, odd, none, clashing):
    queries = spark.createDataFrame([(1, "the cat sat"), (2, None), (3, ""), (4, "zebra"), (None, "der Hund Dog"),
                                     (5, "l'été the the fox"), (5, "l'été the the fox"), (6, "!!!")], BENCHMARK)
    want = sorted(map(repr, brute_search([(r.doc_id, r.text) for r in odd.collect()],
                                         [(r.item_id, r.text) for r in queries.collect()])))
    for docs in (odd, clashing):
        assert sorted(repr(tuple(r)) for r in op12.search(docs, queries).collect()) == want
        assert sorted(repr(tuple(r)) for r in op12.search(docs, queries, block=8).collect()) == want  # several blocks
    assert op12.search(none, queries).collect() == []
    assert op12.search(odd, queries.limit(0)).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 4), st.integers(0, 6)), max_size=80),
       st.sets(st.integers(0, 5), min_size=1), st.integers(1, 5), st.integers(0, 8), st.integers(1, 4))
def test_best_positions_give_the_best_documents(postings, query, k, floor, depth):
    impacts = {(d, t): i for d, t, i in postings}
    owner, term = (np.array([p[j] for p in impacts], np.int64) for j in (0, 1))
    shard = op12.Shard(np.arange(31), owner, term, np.array(list(impacts.values()), np.int64))
    found, scores, _ = shard.best(np.array(sorted(query)), k, floor, depth)
    total = Counter()
    for (d, t), i in impacts.items():
        if t in query:
            total[d] += i
    want = sorted((-s, d) for d, s in total.items() if s > 0 and s >= floor)[:k]
    assert [(-s, d) for d, s in zip(found.tolist(), scores.tolist())] == want


def test_search_stops_before_the_lists_end():
    many = 5000
    owner = np.tile(np.arange(many), 2)
    term = np.repeat([0, 1], many)
    impact = np.concatenate([10 * np.arange(many), 7 * np.arange(many)])
    found, _, read = op12.Shard(np.arange(many), owner, term, impact).best(np.array([0, 1]), 10, 0)
    assert found.tolist() == list(range(many - 1, many - 11, -1)) and read < 200


# ---------------------------------------------------------------- op13
def brute_mine(docs, least=30, top=2000):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    often = {p: c for p, c in f.items() if c >= least}
    longer = defaultdict(int)
    for (lang, p), c in often.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                longer[lang, p[i:i + k]] = max(longer[lang, p[i:i + k]], c)
    found = defaultdict(list)
    for (lang, p), a in often.items():
        if len(p) > 1 and 100 * longer[lang, p] < 80 * a:
            score, _, l, r = min((2000000 * a // (often[lang, p[:k]] + often[lang, p[k:]]), k, often[lang, p[:k]],
                                  often[lang, p[k:]]) for k in range(1, len(p)))
            found[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -score) for lang, rows in found.items()
                  for rank, (score, a, p, l, r) in enumerate(sorted(rows)[:top], 1))


def mined(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize("settings_", [{}, {"least": 3, "run": 5000, "hot": 50}, {"least": 2, "top": 20, "hot": 10}])
def test_phrases_equal_brute_force(spark, settings_):
    docs = docs_of(spark)
    rows = [(r.lang, r.text) for r in docs.collect()]
    want = brute_mine(rows, settings_.get("least", 30), settings_.get("top", 2000))
    assert mined(op13.mine(docs, **settings_)) == want and want


def test_phrases_of_odd_tables(spark, odd, none, clashing):
    rows = [(r.lang, r.text) for r in odd.collect()]
    for docs in (odd, clashing):
        assert mined(op13.mine(docs)) == brute_mine(rows)
        assert mined(op13.mine(docs, least=2, run=100)) == brute_mine(rows, 2)
    assert mined(op13.mine(none)) == []


def test_a_hot_prefix_is_dealt_in_slices(spark):
    text = " ".join(f"the w{i % 400} of" for i in range(20000))
    docs = spark.createDataFrame([("en", text), ("en", text)], "lang string, text string")
    assert mined(op13.mine(docs, hot=1000)) == brute_mine([("en", text)] * 2)
    frequent = op13.bit_set(spark.createDataFrame([("en", w) for w in ("the", "of", *(f"w{i}" for i in range(400)))],
                                                  "lang string, phrase string"))
    hot = op13.bit_set(spark.createDataFrame([("en", "the")], "lang string, phrase string"))
    rows = op13.stripes_of(b"en", text.encode(), 2, frequent.value, hot.value).column(0).to_pylist()
    parts = [key.split(b"\n") for key in rows]
    assert len({part for prefix, part, _ in parts if prefix == b"the"}) > 100
    assert {part for prefix, part, _ in parts if prefix == b"of"} == {b"0"}


def test_a_full_bit_set_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(op13, "BITS", 64)
    docs = docs_of(spark)
    assert mined(op13.mine(docs, least=5)) == brute_mine([(r.lang, r.text) for r in docs.collect()], 5)


def test_scores_past_64_bits(spark):
    value = spark.sql("SELECT (2000000 * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) "
                      "AS s FROM VALUES (9000000000000000000L, 9000000000000000000L, 9000000000000000000L) t(a, l, r)")
    assert value.first().s == 1000000
