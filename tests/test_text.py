"""T1-T16 on the hand fixtures (FIXTURES.md §3) plus properties."""
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geolex.functions import text as tx
from tests.conftest import one_col


def col(spark, values, fn, dtype="string"):
    df = one_col(spark, values, dtype=dtype)
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_t1_collapse_tail(spark):
    assert col(spark, ["miamiiiii", "iii", "", None, "aab", "a\n\n"], tx.collapse_tail) == \
        ["miami", "i", "", None, "aab", "a\n"]


def test_t2_place_name(spark):
    assert col(spark, ["Kings County", "Nome Census Area", "Miami-Dade", "County", "San  Juan Municipio"],
               tx.place_name) == ["kings", "nome", "miami-dade", None, "sanjuan"]


def test_t3_split_location(spark):
    out = col(spark, ["Miami, FL, USA", "Miami", None, "", "Dade County, fl l"], tx.split_location)
    assert [(r.state, r.county) if r else None for r in out] == [
        ("fl", "miami"), (None, "miami"), (None, None), (None, None), ("fl", "dade")]


def test_t4_tokens_python_whitespace(spark):
    s = "a b c\x1cd  e\tf　g​h"
    assert col(spark, [s], tx.tokens) == [s.split()]


def test_t5_stop_words_case_sensitive_duplicates_kept(spark):
    out = col(spark, ["The cat and the cat"], lambda c: tx.strip_stop_words(c, ["the", "and"]))
    assert out == ["The cat cat"]


def test_t9_token_class(spark):
    assert col(spark, ["http://a.b😀", "hi😀", "hi", "https:///x", "©"], tx.token_class) == \
        ["url", "emoji", "word", "url", "emoji"]


def test_t11_trim_word(spark):
    assert col(spark, ["(@bob!)", "...", "_x_", "[a]", "café!", "été", "éé"], tx.trim_word) == \
        ["@bob", "", "x", "a", "caf", "t", ""]


def test_t12_strip_special(spark):
    assert col(spark, ["It's  a_b - test! ok", "  héllo,   wörld  "], tx.strip_special) == \
        ["Its ab test ok", "héllo wörld"]


def test_t13_apostrophe(spark):
    assert col(spark, ["don’t"], tx.ascii_apostrophe) == ["don't"]


def test_t2_designators_are_whole_words(spark):
    assert col(spark, ["Countyline Road", "Tareac", "King COUNTY", "Census Area"], tx.place_name) == [
        "countylineroad", "tareac", "king", None]


def test_t8_emoji_property(spark):
    import regex
    points = [c for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000 and (c % 37 == 0 or 0x2000 <= c < 0x2C00
                                                                             or 0x1F000 <= c < 0x1FB00)]
    got = col(spark, [chr(c) for c in points], tx.is_emoji)
    assert got == [regex.match(r"\p{Emoji}", chr(c)) is not None for c in points]
    assert col(spark, ["★", "✓", "❶", "➜", "7", "#", "a😀"], tx.is_emoji) == [False] * 6 + [True]


def test_t14_sentences(spark):
    assert col(spark, ["One. Two!  Three? four"], tx.sentences) == [["One.", "Two!", "Three?", "four"]]


def test_t15_parse_vector(spark):
    assert col(spark, ["[0.1 0.2  3]", "[]", "[x 1]"], tx.parse_vector) == [[0.1, 0.2, 3.0], [], [None, 1.0]]


def test_t16_parse_lat_long(spark):
    out = col(spark, ["43.5, -79.6", "n/a", "1"], tx.parse_lat_long)
    assert [(r.lat, r.long) for r in out] == [(43.5, -79.6), (None, None), (1.0, None)]


def one_tail(s):
    """All trailing copies of the last character off, one put back."""
    return s.rstrip(s[-1:]) + s[-1:] if s else s


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab i 😀.\n", max_size=12), min_size=30, max_size=60))
def test_t1_matches_model_and_is_idempotent(spark, values):
    out = col(spark, values, tx.collapse_tail)
    assert out == [one_tail(v) for v in values]
    assert col(spark, out, tx.collapse_tail) == out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n  \x1f　.,", max_size=15), min_size=30, max_size=60))
def test_t4_matches_str_split(spark, values):
    assert col(spark, values, tx.tokens) == [v.split() for v in values]
