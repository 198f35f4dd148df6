"""Column-level text functions.

Every function takes and returns a ``Column`` built only from Spark's
built-in expressions, so it runs inside whole-stage codegen (or, for the
higher-order ``filter``/``transform`` calls, in the JVM without any Python
worker). Nothing here triggers a job.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Whitespace as Python's ``str.split()`` sees it (``str.isspace``): ASCII
# tab, LF, VT, FF, CR, the separators U+001C-U+001F, space, U+0085, U+00A0,
# U+1680, U+2000-U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.  Spelled
# out so the same class means the same thing in Java regex and in RE2.
WS_CLASS = (
    r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WS_RUN = "[" + WS_CLASS + "]+"
# The same runs for Java regex alone: letters fail the few ranges in front, not every range of the class.
WS_RUN_JAVA = r"[\x00-\x20\x{85}\x{A0}\x{1680}-\x{3000}&&[" + WS_CLASS + "]]+"
# No letter, digit or whitespace; ASCII letters, digits and the space fail the ranges in front.
SPECIAL_JAVA = (r"[\x00-\x1F\x21-\x2F\x3A-\x40\x5B-\x60\x{7B}-\x{10FFFF}&&[^\p{L}\p{N}" + WS_CLASS + "]]")

# Place-name designators removed before matching (case-insensitive, D3).
PLACE_DESIGNATORS = ("county", "borough", "municipio", "municipality", "census", "area")

# URL token: any token containing http:// or https:// (one or more slashes).
URL_PATTERN = r"https?://+"

# Code points with the Unicode property Emoji, without the ASCII digits, '#' and '*' that carry it too.
EMOJI_POINTS = """
00A9 00AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 23F8-23FA 24C2
25AA-25AB 25B6 25C0 25FB-25FE 2600-2604 260E 2611 2614-2615 2618 261D 2620 2622-2623 2626 262A
262E-262F 2638-263A 2640 2642 2648-2653 265F-2660 2663 2665-2666 2668 267B 267E-267F 2692-2697
2699 269B-269C 26A0-26A1 26A7 26AA-26AB 26B0-26B1 26BD-26BE 26C4-26C5 26C8 26CE-26CF 26D1
26D3-26D4 26E9-26EA 26F0-26F5 26F7-26FA 26FD 2702 2705 2708-270D 270F 2712 2714 2716 271D 2721
2728 2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2764 2795-2797 27A1 27B0 27BF 2934-2935
2B05-2B07 2B1B-2B1C 2B50 2B55 3030 303D 3297 3299 1F004 1F0CF 1F170-1F171 1F17E-1F17F 1F18E
1F191-1F19A 1F1E6-1F1FF 1F201-1F202 1F21A 1F22F 1F232-1F23A 1F250-1F251 1F300-1F321 1F324-1F393
1F396-1F397 1F399-1F39B 1F39E-1F3F0 1F3F3-1F3F5 1F3F7-1F4FD 1F4FF-1F53D 1F549-1F54E 1F550-1F567
1F56F-1F570 1F573-1F57A 1F587 1F58A-1F58D 1F590 1F595-1F596 1F5A4-1F5A5 1F5A8 1F5B1-1F5B2 1F5BC
1F5C2-1F5C4 1F5D1-1F5D3 1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF 1F5F3 1F5FA-1F64F 1F680-1F6C5
1F6CB-1F6D2 1F6D5-1F6D9 1F6DC-1F6E5 1F6E9 1F6EB-1F6EC 1F6F0 1F6F3-1F6FC 1F7E0-1F7EB 1F7F0
1F90C-1F93A 1F93C-1F945 1F947-1F9FF 1FA70-1FA7C 1FA80-1FAC6 1FAC8 1FACC-1FADD 1FADF-1FAEB
1FAEF-1FAFA
"""
EMOJI_CLASS = "[" + "".join(
    "-".join(rf"\x{{{point}}}" for point in span.split("-")) for span in EMOJI_POINTS.split()) + "]"
# What lies between the first and the last of them: three ranges, quickly tested.
EMOJI_SPAN = r"\x{A9}\x{AE}\x{203C}-\x{1FAFA}"

# Characters kept at both ends of a word by ``trim_word`` (D8: ASCII only).
WORD_EDGE_KEEP = "A-Za-z0-9@"
# --- end of fixed values ----------------------------------------------------


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def collapse_tail(col: Column | str) -> Column:
    """Collapse a trailing run of one character to a single one.

    ``miamiiiii`` -> ``miami``; ``''`` and null pass through unchanged.
    """
    return F.regexp_replace(_c(col), r"(?s)(.)\1+\z", "$1")


def place_name(col: Column | str) -> Column:
    """Canonical place name: strip designators (whole words), lower, drop spaces, T1.

    Empty results become null so '' never matches a gazetteer row.
    """
    pattern = r"(?i)\b(" + "|".join(PLACE_DESIGNATORS) + r")\b"
    x = F.regexp_replace(_c(col), pattern, "")
    x = F.replace(F.lower(x), F.lit(" "), F.lit(""))
    return F.nullif(collapse_tail(x), F.lit(""))


def split_location(col: Column | str) -> Column:
    """Free-text location -> struct(state, county).

    The text is lower-cased and split at commas; part 1 is the county (T2),
    part 2 the state (spaces removed, T1); further parts are ignored.
    """
    parts = F.split(F.lower(_c(col)), ",")
    county = place_name(F.get(parts, 0))
    state = F.nullif(collapse_tail(F.replace(F.get(parts, 1), F.lit(" "), F.lit(""))), F.lit(""))
    return F.struct(state.alias("state"), county.alias("county"))


def tokens(col: Column | str) -> Column:
    """T4: whitespace tokeniser with Python ``str.split()`` semantics."""
    return F.array_remove(F.split(_c(col), WS_RUN_JAVA), "")


def has_tokens(col: Column | str) -> Column:
    """T4: whether there is any token, that is any character that is no whitespace."""
    return _c(col).rlike("[^" + WS_CLASS + "]")


def strip_stop_words(col: Column | str, stop_words: Iterable[str]) -> Column:
    """T5: drop stop-word tokens (case-sensitive, duplicates kept), rejoin by ' '.

    One pass over the tokens; ``isin`` looks a token up in a hash set."""
    stop = set(stop_words or ())
    if not stop:
        return F.array_join(tokens(col), " ")
    drop = sorted(stop | {""})
    return F.array_join(F.filter(F.split(_c(col), WS_RUN_JAVA), lambda t: ~t.isin(*drop)), " ")


def text_length(col: Column | str) -> Column:
    """Length in characters."""
    return F.char_length(_c(col))


def is_url(col: Column | str) -> Column:
    """Token contains ``http://`` or ``https://``.

    The regex runs only on tokens containing ``://`` (a necessary condition;
    ``AND`` short-circuits), so ordinary words never reach it.
    """
    c = _c(col)
    return (F.instr(c, "://") > 0) & c.rlike(URL_PATTERN)


def is_emoji(col: Column | str) -> Column:
    """Token contains at least one emoji code point.

    Every emoji code point is outside ASCII, so the regexes run only on tokens
    whose UTF-8 length exceeds their character count, and the one of many
    ranges only on their characters between the first and the last emoji.
    """
    c = _c(col)
    between = F.regexp_replace(c, f"[^{EMOJI_SPAN}]+", "")
    return (F.octet_length(c) > F.char_length(c)) & c.rlike(f"[{EMOJI_SPAN}]") & between.rlike(EMOJI_CLASS)


def token_class(col: Column | str) -> Column:
    """T9: 'url', else 'emoji', else 'word'."""
    c = _c(col)
    return F.when(is_url(c), "url").when(is_emoji(c), "emoji").otherwise("word")


def lower(col: Column | str) -> Column:
    """T10."""
    return F.lower(_c(col))


def _kept_code(code: Column) -> Column:
    return (((code >= 48) & (code <= 57)) | ((code >= 64) & (code <= 90)) | ((code >= 97) & (code <= 122)))


def trim_word(col: Column | str) -> Column:
    """Trim everything but ASCII letters, digits and '@' at both ends.

    Words whose first and last characters are already kept (most words)
    skip the two regexes; the check reads two character codes.
    """
    c = _c(col)
    x = F.regexp_replace(c, "^[^" + WORD_EDGE_KEEP + "]+", "")
    trimmed = F.regexp_replace(x, "[^" + WORD_EDGE_KEEP + "]+$", "")
    clean = _kept_code(F.ascii(c)) & _kept_code(F.ascii(F.substring(c, -1, 1)))
    return F.when(clean, c).otherwise(trimmed)


def strip_special(col: Column | str) -> Column:
    """Drop everything but letters, digits and whitespace (underscore
    included in the drop), collapse whitespace runs to one space, strip."""
    x = F.regexp_replace(_c(col), SPECIAL_JAVA, "")
    x = F.regexp_replace(x, WS_RUN_JAVA, " ")
    return F.trim(x)


def ascii_apostrophe(col: Column | str) -> Column:
    """Typographic apostrophe -> ASCII."""
    return F.replace(_c(col), F.lit("’"), F.lit("'"))


SENTENCE_MARK = "\u0001"


def sentences(col: Column | str) -> Column:
    """Split a text after '.', '!' or '?' followed by whitespace."""
    marked = F.regexp_replace(_c(col), "([.!?])" + WS_RUN, "$1" + SENTENCE_MARK)
    return F.split(marked, SENTENCE_MARK)


def parse_vector(col: Column | str) -> Column:
    """``"[0.1 0.2]"`` -> array<double>; unparsable items become null."""
    body = F.regexp_replace(_c(col), r"[\[\]]", "")
    return F.transform(tokens(body), lambda v: v.try_cast("double"))


def parse_lat_long(col: Column | str) -> Column:
    """``"lat,long"`` -> struct(lat, long); invalid parts are null."""
    parts = F.split(_c(col), ",")
    lat = F.trim(F.get(parts, 0)).try_cast("double")
    lon = F.trim(F.get(parts, 1)).try_cast("double")
    return F.struct(lat.alias("lat"), lon.alias("long"))
