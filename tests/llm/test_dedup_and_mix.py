"""Exact dedup, SimHash near-dedup and mixing against brute force."""
import hashlib
import math
import os
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from geolex.llm import common, op1_simhash_near_dedup as op1, op2_mix_sources as op2, op3_exact_dedup as op3
from tests.conftest import SF001

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet")


# ------------------------------------------------------------------ running sums
def test_running_sum_is_a_prefix_sum(spark):
    rows = [(k, i, (7 * i) % 5) for k in ("a", "b", None) for i in range(50)]
    df = common.running_sum(spark.createDataFrame(rows, "k string, i int, v long"), ["k"], ["i"], "v", "t")
    for r in df.collect():
        assert r.v_before == sum(v for k, i, v in rows if k == r.k and i < r.i)


# ------------------------------------------------------------------ exact dedup
def brute_groups(rows):
    by = {}
    for doc_id, text, *_ in rows:
        by.setdefault(text or "", []).append(doc_id)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in by.items()}


def test_exact_groups(spark, odd):
    want = brute_groups([tuple(r) for r in odd.collect()])
    got = op3.exact_groups(odd.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)),
                           carry=("sha",)).collect()
    digests = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
    assert len(got) == odd.count()
    for r in got:
        keep, size = digests[r.sha]
        assert (r.keep_id, r.group_size, r.kept) == (keep, size, r.doc_id == keep)


def test_prefix_alone_does_not_make_copies(spark):
    same = "p" * 400
    rows = [(1, same + "a"), (2, same + "b"), (3, same + "a"), (4, same + "abc")]
    got = {r.doc_id: (r.keep_id, r.kept) for r in op3.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (3, False), 2: (2, True), 3: (3, True), 4: (4, True)}


def test_drop_copies_keeps_one_of_each(clashing):
    out = op3.drop_copies(clashing)
    assert out.columns == clashing.columns
    rows = out.collect()
    want = brute_groups([(r.doc_id, r.text) for r in clashing.collect()])
    assert sorted(r.text or "" for r in rows) == sorted(want)
    assert all(r.doc_id == want[r.text or ""][0] for r in rows)


# ------------------------------------------------------------------ SimHash
def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORDS.findall(low)
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, ids, radius=3):
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                label[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i in range(len(prints)):
        groups.setdefault(root(i), []).append(ids[i])
    return [min((x for x in groups[root(i)] if x is not None), default=None) for i in range(len(prints))]


def check_components(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    prints = [brute_print(t) for _, t in rows]
    named = brute_components(prints, [i for i, _ in rows])
    want = [(i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, named)]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in op1.near_dup_components(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("n", [0, 1, 3, 1_000_000])
def test_bit_set_holds_its_keys_and_few_others(spark, n):
    """The share let through by chance is the same however many prefixes are shared (buckets of
    a fixed number let 63 % through at a million)."""
    keys = spark.range(n).select(F.xxhash64("id").alias("_key"))
    blocks, bits = op3.bit_set(keys)
    held = op3.with_hits(keys, blocks, bits, F.col("_key"))
    assert held.filter("_hit").count() == n and held.columns == ["_key", "_hit"]
    others = spark.range(10**9, 10**9 + 200_000).select(F.xxhash64("id").alias("_key"))
    assert op3.with_hits(others, blocks, bits, F.col("_key")).filter("_hit").count() < 200_000 * 0.065
    nulls = spark.range(5).select(F.lit(None).cast("long").alias("_key"))
    assert op3.with_hits(nulls, blocks, bits, F.col("_key")).filter("NOT _hit").count() == 5
    assert blocks.count() * op3.BLOCK <= bits <= op3.MOST_BITS


def test_cuts_can_be_removed(spark, monkeypatch):
    monkeypatch.setattr(common, "_written", [])
    kept = common.cut(spark.range(5), "gone")
    path = common._written[0]
    assert kept.count() == 5 and os.path.exists(path)
    assert common.remove_cuts(spark) == 1 and not os.path.exists(path) and common.remove_cuts(spark) == 0


def test_full_hash_only_where_length_and_prefix_are_shared(spark):
    texts = ["a" * 300 + "x", "a" * 300 + "y", "b" * 301, "c" * 5, "c" * 6, None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    hashed = {r.id: r._full is not None for r in op3.with_full_hash(docs, F.col("text")).collect()}
    assert hashed == {0: True, 1: True, 2: False, 3: False, 4: False, 5: True, 6: True}


def test_simhash_on_the_table(spark):
    check_components(docs_of(spark))


def test_simhash_odd_rows(odd):
    check_components(odd)


def test_python_hash_is_sparks(spark):
    text = "Ünïcode thrée wörds"
    want = spark.sql(f"SELECT xxhash64('{text}') h").first().h
    assert xxhash.xxh64_intdigest(text.encode(), 42) == want % (1 << 64)


@pytest.mark.parametrize("shard", [4, 4096])
def test_forest_links_all_within_radius(spark, monkeypatch, shard):
    """Chains of near fingerprints, in shards that are cut into pieces and in whole ones."""
    monkeypatch.setattr(op1, "SHARD", shard)
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 63, 12, np.uint64)
    prints = []
    for s in seeds:
        p = int(s)
        for _ in range(25):
            prints.append(p)
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                p ^= 1 << int(b)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    star = {r.node: r.root for r in op1.components(op1.shard_links(op1.to_shards(df, 3), 3)).collect()}
    label = brute_components(prints, signed)
    assert [star.get(p, p) for p in signed] == label


def test_frontier_is_cut_without_loss(monkeypatch):
    monkeypatch.setattr(op1, "FRONTIER", 7)
    rng = np.random.default_rng(2)
    p = np.unique(rng.integers(0, 4096, 300).astype(np.uint64))
    cells = np.zeros(len(p), np.int64)
    found = set()
    for a, b in op1.Forest(p, cells).links(p, cells, 2):
        found |= set(zip(a.tolist(), b.tolist()))
    x, y = np.nonzero(np.bitwise_count(p[:, None] ^ p) <= 2)
    assert found == set(zip(x.tolist(), y.tolist()))


def test_drop_near_copies(clashing):
    out = op1.drop_near_copies(clashing)
    assert out.columns == clashing.columns
    found = {r.doc_id: r.component_id for r in op1.near_dup_components(clashing).collect() if r.doc_id is not None}
    ids = sorted(r.doc_id for r in out.collect() if r.doc_id is not None)
    assert ids == sorted(r.doc_id for r in clashing.collect() if r.doc_id is not None and found[r.doc_id] == r.doc_id)
    assert sum(r.doc_id is None for r in out.collect()) == sum(r.doc_id is None for r in clashing.collect())


# ------------------------------------------------------------------ mixing
def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return {**capped, **share}
        capped |= {s: 3.0 * sizes[s] for s in over}


def check_mix(df):
    plan = [r.asDict() for r in op2.allot(df).collect()]
    sizes = {}
    for r in df.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(WORDS.findall(r.text or ""))
    want = brute_targets(sizes)
    taken = {}
    for p in plan:
        assert p["source_size"] == sizes[p["source"]]
        assert math.isclose(p["target"], want[p["source"]], abs_tol=1e-6)
        assert 0 <= p["taken"] <= 3 * p["size"]
        taken[p["source"]] = taken.get(p["source"], 0) + p["taken"] * p["_rows"]
    for s, t in taken.items():
        assert abs(t - want[s]) <= 2


def test_mix_takes_the_targets(spark, odd):
    check_mix(docs_of(spark))
    check_mix(odd)


def test_query_reruns_agree(spark):
    runs = [sorted(map(tuple, op2.op2_mix_sources(spark, SF001).collect())) for _ in range(2)]
    assert runs[0] == runs[1]


def test_invert_is_the_inverse_of_the_integral(spark):
    knots = ((0.0, 1.0), (0.25, 3.0), (0.5, 0.0), (1.0, 2.0))
    shares = [i / 50 for i in range(51)]
    got = [r.t for r in spark.createDataFrame([(s,) for s in shares], "s double")
           .select("s", op2.invert(F.col("s"), knots).alias("t")).orderBy("s").collect()]

    def area(t):
        xs = np.unique(np.append(np.linspace(0, t, 4001), [k for k, _ in knots if k <= t]))
        return np.trapezoid(np.interp(xs, *zip(*knots)), xs)
    whole = area(1.0)
    assert np.allclose([area(t) / whole for t in got], shares, atol=1e-6)


def test_mix_rows_follow_the_plan(spark, clashing):
    out = op2.mix(clashing)
    assert out.columns == clashing.columns
    assert op2.mix(docs_of(spark)).count() > 0
    counts = {}
    for r in op2.mix(docs_of(spark)).collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    for r in op2.allot(docs_of(spark)).collect():
        n = r._epochs + (1 if r.last_words and 2 * r.last_words >= r.size else 0)
        assert counts.get(r._doc, 0) == n <= 3


# ------------------------------------------------------------------ empty tables, SQL
def test_empty_tables(none):
    assert op3.exact_groups(none).count() == 0 and op3.drop_copies(none).count() == 0
    assert op1.near_dup_components(none).count() == 0 and op1.drop_near_copies(none).count() == 0
    assert op2.allot(none).count() == 0 and op2.mix(none).count() == 0


def test_all_empty_texts_have_no_target(spark):
    df = spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in op2.allot(df).collect()] == [(0, 0.0, 0)] * 2

