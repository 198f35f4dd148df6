"""T14 learned boundaries: a small corpus and a brute-force twin."""
import math
import random
import re
from collections import Counter

import pytest

from geolex.operators import sentences as sn

NOUNS = "street letter garden river window market doctor teacher picture morning".split()
VERBS = "saw found liked crossed opened watched passed painted".split()


@pytest.fixture(scope="module")
def corpus():
    """Sentences that start with one of three words and hold abbreviations in their middle."""
    rnd = random.Random(11)
    texts = []
    for i in range(250):
        out = []
        for _ in range(6):
            who = rnd.choice([f"Dr. {rnd.choice(NOUNS).title()}", f"a {rnd.choice(NOUNS)}", f"Mr. {rnd.choice(NOUNS).title()}"])
            out.append(f"{rnd.choice(['The', 'We', 'They'])} {rnd.choice(NOUNS)} {rnd.choice(VERBS)} {who}, e.g. in the "
                       f"{rnd.choice(NOUNS)}{rnd.choice('...!?')}")
        texts.append(" ".join(out))
    return texts


def strip(token):
    return re.sub(r"^[^\w]+|[.!?]+$", "", token.lower())


def brute_model(texts):
    n, k, after, ends = Counter(), Counter(), [], 0
    for text in texts:
        toks = text.split()
        for t, nxt in zip(toks, [*toks[1:], None]):
            n[strip(t)] += 1
            k[strip(t)] += t.endswith(".")
            if t[-1] in ".!?":
                after.append((t, nxt))
    N, K = sum(n.values()), sum(k.values())

    def like(hits, of, p):
        return (hits * math.log(p) if hits else 0) + ((of - hits) * math.log(1 - p) if of - hits else 0)

    abbr = {}
    for w in n:
        size = len(w.replace(".", ""))
        if k[w] and re.fullmatch(r"[^\W\d_]+(\.[^\W\d_]+)*", w):
            s = -2 * (like(k[w], n[w], K / N) - like(k[w], n[w], .99)) * math.exp(-size) * (w.count(".") + 1) * size ** -(n[w] - k[w])
            if s >= .3:
                abbr[w] = s
    follow = Counter(strip(x) for t, x in after if x and not (t.endswith(".") and strip(t) in abbr))
    B = sum(follow.values())
    start = set()
    for w, a in follow.items():
        p = n[w] / N
        s = -2 * (like(a, B, p) + like(n[w] - a, N - B, p) - like(a, B, a / B) - like(n[w] - a, N - B, (n[w] - a) / (N - B)))
        if a / B > p and s >= 30:
            start.add(w)
    return abbr, start


def brute_sentences(text, abbr, start):
    out = []
    for fragment in re.split(r"(?<=[.!?])\s+", text):
        if not fragment.strip():
            continue
        last = out[-1].split()[-1] if out else "!"
        first = fragment.split()[0]
        if last.endswith(".") and strip(last) in abbr and not (first[0].isupper() and strip(first) in start):
            out[-1] += " " + fragment
        else:
            out.append(fragment)
    return out


def model_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    counts = sn.end_counts(docs).cache()
    abbrevs = sn.abbreviations(counts).cache()
    return docs, abbrevs, sn.sentence_starters(counts, abbrevs).cache()


def test_learned_boundaries_equal_brute_force(spark, corpus):
    docs, abbrevs, starters = model_of(spark, corpus)
    abbr, start = brute_model(corpus)
    assert {r.word: pytest.approx(r.score) for r in abbrevs.collect()} == abbr
    assert {"dr", "mr", "e.g"} <= set(abbr) and not set(abbr) & set(NOUNS)
    assert {r.word for r in starters.collect()} == start >= {"the", "we", "they"}
    got = {}
    for r in sn.learned_sentences(docs, "id", "text", abbrevs, starters).orderBy("doc_id", "sent_no").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == {i: brute_sentences(t, abbr, start) for i, t in enumerate(corpus)}
    assert all(len(s) == 6 for s in got.values())  # neither "Dr. Garden" nor "e.g. in" ends one


def test_learned_boundaries_of_odd_texts(spark, corpus):
    _, abbrevs, starters = model_of(spark, corpus)
    odd = [(1, None), (2, ""), (3, "  \n"), (4, "Dr."), (5, "Dr. Dr. Dr. x"), (6, "we met Dr. The street was long."),
           (7, "we met Dr. the street"), (7, "we met Dr. the street"), (8, "One! Two? Three."), (9, "... . !")]
    docs = spark.createDataFrame(odd, "id long, text string")
    rows = sorted((r.doc_id, r.sent_no, r.text) for r in sn.learned_sentences(docs, "id", "text", abbrevs, starters).collect())
    assert rows == [(4, 0, "Dr."), (5, 0, "Dr. Dr. Dr. x"), (6, 0, "we met Dr."), (6, 1, "The street was long."),
                    (7, 0, "we met Dr. the street"), (7, 0, "we met Dr. the street"), (8, 0, "One!"), (8, 1, "Two?"),
                    (8, 2, "Three."), (9, 0, "..."), (9, 1, "."), (9, 2, "!")]
    none = spark.createDataFrame([], "id long, text string")
    counts = sn.end_counts(none)
    assert sn.abbreviations(counts).count() == 0 == sn.sentence_starters(counts, sn.abbreviations(counts)).count()
    assert sn.learned_sentences(none, "id", "text", abbrevs, starters).count() == 0
