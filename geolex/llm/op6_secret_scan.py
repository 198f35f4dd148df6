"""Secret scan: fixed patterns plus assignment-aware lexing.

The patterns find assignments to five names, access-key ids and long runs of
hex digits.  The lexer then reads the text as source or configuration syntax: a
target (identifier, dotted or subscripted name, variable, quoted key) followed
by ``=  :=  :  =>`` and an expression of string literals (with prefixes, triple
quotes), bare configuration values, references, operators, calls and brackets,
which may go on over line ends.  References
are resolved through all of the document's assignments of the name, so a literal is judged
by every name it reaches: ``A = "..."`` and ``db_password = A`` make A's literal
a password.  A value of several parts is judged as a whole too: a name in it stands
for its nearest earlier assignment, or else for the first one that follows (see
``Resolution``), so that secrets in pieces are found.  A literal is reported when the
sensitivity of its best target name and the randomness of its value together reach
``THRESHOLD`` and no pattern already covers it.  Of a value with white space the words
are judged one by one: those after an authorisation scheme (``Basic ...``), and others of
at least ``MIN_WORD`` characters of three kinds.

Rules: null text counts as empty; no text has no spans.  Positions are code
points, ends exclusive.  Matches of a pattern are leftmost and do not overlap;
those that are too short are dropped after matching.  Spans are ordered by
start, then kind (assign, access, hex, lexed), then end.  Rows are
independent, so repeated rows, null ids and extra columns do no harm.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolex.llm.common import replaced, table

# --- fixed values: the patterns of the contract ------------------------------
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # leftmost maximal runs, the same as [0-9a-f]+ of 24 and more
MIN_VALUE, MIN_ACCESS = 6, 20
STEMS = ("passw", "secret", "token", "apikey", "api_key")
# --- end of fixed values -------------------------------------------------------

KINDS = ("assign", "access", "hex", "lexed")
THRESHOLD = 1.2

#: What parts of a target's name say about its value.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 0.9, "token": 0.8,
             "apikey": 1.0, "credential": 0.8, "credentials": 0.8, "bearer": 0.8, "private": 0.5, "auth": 0.5,
             "key": 0.5, "api": 0.4, "access": 0.4, "signing": 0.4, "encryption": 0.4, "salt": 0.4,
             "pass": 0.75, "pw": 0.75, "passcode": 0.9, "cred": 0.75, "creds": 0.75, "authorization": 0.7, "jwt": 0.7,
             "cookie": 0.6, "session": 0.5, "cert": 0.5, "hmac": 0.5}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|\$?\{.*\}|%.*%|(?:your|my|the|some|an?)[-_ ].*|.*(?:example|changeme"
                         r"|change_me|placeholder|redacted|dummy|todo).*|none|null|true|false|yes|no|test|password"
                         r"|secret|token)$")
NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

SCHEME = r"(?i:basic|bearer|digest|negotiate|token|apikey)"
#: An authorisation scheme and its bare credential, alone up to a line's end or a delimiter.
SCHEMED = re.compile(SCHEME + r"[\x20\t]++([^\s\"'`,;#(){}\[\]<>]++)(?=[\x20\t]*+(?:$|[\r\n,;}#]))")
WORD = re.compile(r"\S+")
MIN_WORD = 12

LEXEME = re.compile(r"""
    (?P<triple>[rRbBuUfF]{0,2}(?P<quotes>\"{3}|'{3})(?P<inner>[\s\S]*?)(?P=quotes))
  | (?P<string>(?:[rRbBuUfFL]{1,2}|u8|b?r\#+|\$@|@\$|[@$])?
      (?:"(?:[^"\\\r\n]|\\[^\r\n])*"|'(?:[^'\\\r\n]|\\[^\r\n])*'|`[^`\r\n]*`))
  | (?P<subscript>\[\s*(?:"[^"\r\n]*"|'[^'\r\n]*')\s*\])
  | (?P<reference>\$\{\w+\}|\$\w+)
  | (?P<name>[A-Za-z_][\w-]*(?:\.[A-Za-z_][\w-]*)*)
  | (?P<compare>[=!<>]=)
  | (?P<assign>:=|=>|=|:(?!//))
  | (?P<space>(?:[\x20\t]|\\(?:\r\n|\r|\n))+)
  | (?P<newline>(?:\r\n|\r|\n)(?:[\x20\t]*+(?:\r\n|\r|\n))*+)
  | (?P<other>\\[^\r\n]|.)
""", re.VERBOSE)
LINE = re.compile(r"[^\r\n]+")  # lines end at \r\n, \r or \n
#: A run of characters that a bare value may have; the empty group says that a line's end or a delimiter follows.
RUN = re.compile(r"[^\s\"'`,;#(){}\[\]<>]++(?=[\x20\t]*+(?:$|[\r\n,;}#])())?")
BLANK = re.compile(r"[\x20\t]*")
ASSIGNS = re.compile(r"[=:]")
#: The start of a line that is an assignment of its own.
STATEMENT = re.compile(r"[\x20\t]*(?:(?:export|const|let|var|final|static|public|private)[\x20\t]+)?"
                       r"[A-Za-z_][\w.-]*[\x20\t]*[-+*/%|&^]?(?::=|=>|=|:)(?![=/])(?=.)")
#: YAML's block values: what follows the colon, and a line of the block that is one value.
BLOCK = re.compile(r"[\x20\t]*[|>][-+0-9]*[\x20\t]*(\r\n|\r|\n)")
BLOCK_LINE = re.compile(r"([\x20\t]*)([^\r\n]*)(?:\r\n|\r|\n|$)")
BLOCK_HEAD = re.compile(r".*:[\x20\t]*[|>][-+0-9]*[\x20\t]*$")
VALUE_LINE = re.compile(r"\S+")
#: An argument that names a setting, and is no value of it: words in one case each.
SETTING = re.compile(r"(?:[A-Z]+|[A-Z]?[a-z]+(?:[A-Z][a-z]+)*)\d{0,2}"
                     r"(?:[_./: -](?:[A-Z]+|[A-Z]?[a-z]+(?:[A-Z][a-z]+)*)\d{0,2})*")
CLOSING = {"(": ")", "[": "]", "{": "}"}
#: After these an expression goes on, as it does before them on the next line.
OPERATORS, JOINING, PREFIXES = frozenset("+|&?%."), frozenset("+%."), frozenset("!&*@-")
WORDS = frozenset({"or", "and", "if", "else", "not", "new", "await"})

#: A bare value that may be a name: a reference, unless it has a digit and nothing has that name.
REFERENCE = re.compile(r"[A-Za-z_]+(?:[.-][A-Za-z_]+)*|\$\{?\w+\}?")

Literal = tuple[str, int, int, bool]  # value, start, end, and whether it is bare and so may be a name
Term = Literal | str | int  # a literal, a name, or the number of an assignment inside


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    folded = text.lower()
    if any(stem in folded for stem in STEMS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def value_lines(text: str, start: int, end: int) -> list[Literal]:
    """The lines of a part of the text that are one value each, without their margins."""
    return [(m[0], m.start(), m.end(), False) for line in LINE.finditer(text, start, end)
            if (m := VALUE_LINE.search(text, line.start(), line.end())) and not text[m.end():line.end()].strip()]


def block_lines(text: str, at: int, hi: int, indent: int) -> list[Literal]:
    """The values of a YAML block that begins at ``at`` and whose key is indented by ``indent``."""
    out = []
    while at < hi and (m := BLOCK_LINE.match(text, at, hi)) and (not m[2] or len(m[1]) > indent):
        if BLOCK_HEAD.match(m[2]):
            break
        if not STATEMENT.match(m[2]):
            out += value_lines(text, m.start(2), m.end(2))
        at = m.end()
    return out


class Lexer:
    """The assignments of a text in one pass: ``found`` has (target, terms) in order of the targets.

    The value of an assignment goes on over operators, calls and brackets, whose strings and
    names are its terms too, and over line ends inside brackets, after an operator, and where
    the value has not begun.  An assignment inside the parentheses of a call is a term of the
    outer one; in braces and lists each key judges its own value.  Arguments that look like
    the name of a setting (``getenv("API_KEY")``) are no values."""

    def __init__(self, text: str):
        self.text, self.found = text, []
        self.read(0, len(text))

    def next(self, at: int, hi: int) -> re.Match | None:
        m = LEXEME.match(self.text, at, hi)
        return LEXEME.match(self.text, m.end(), hi) if m and m.lastgroup == "space" else m

    def line_from(self, at: int, hi: int) -> int:
        """The start of the first line from ``at`` on that assigns something."""
        m = ASSIGNS.search(self.text, at, hi)
        return max(at, self.text.rfind("\n", at, m.start()) + 1, self.text.rfind("\r", at, m.start()) + 1) if m else hi

    def element(self, owner: int | None) -> int | None:
        """A nameless assignment for one argument, list element or alternative of the owner's value."""
        if owner is None:
            return None
        self.found.append(("", []))
        self.found[owner][1].append(len(self.found) - 1)
        return len(self.found) - 1

    def read(self, lo: int, hi: int) -> None:
        text, found = self.text, self.found
        pos = self.line_from(lo, hi)
        runs = RUN.finditer(text, pos, hi)  # each found once, however many assignments begin in it
        run = next(runs, None)
        # open brackets in values: what closes them, whose value is in them, whose goes on after them, if it is a call
        frames: list[tuple[str, int | None, int | None, bool]] = []
        target: str | None = None
        value: int | None = None  # the assignment whose value is read
        want = bare = False  # whether an operand must follow, and whether that may be a bare value
        operand = None  # the kind of the operand just read: it may turn out to be a target
        crossed = colon = dash = ternary = False
        indent = base = BLANK.match(text, pos, hi).end() - pos
        while pos < hi and (m := LEXEME.match(text, pos, hi)):
            kind, start, pos = m.lastgroup, m.start(), m.end()
            if kind == "space":
                continue
            if kind == "newline":
                after = self.next(pos, hi)
                margin = BLANK.match(text, pos, hi).end() - pos
                target, before = None, operand
                if frames:
                    if margin <= base and STATEMENT.match(text, pos, hi):
                        frames.clear()  # a bracket was never closed
                        value, want = None, False
                    else:
                        operand = before
                if not frames:
                    sign = after[0] if after else ""
                    if value is not None and want and (margin > indent or sign[-1:] in ('"', "'") or sign == "-"):
                        bare = True
                    elif value is not None and not want and operand and (
                            sign in OPERATORS or dash and sign == "-" and margin >= indent):
                        want = dash and sign == "-"
                        bare = want
                    else:
                        value, want, operand, dash = None, False, None, False
                        pos = self.line_from(pos, hi)
                        indent = BLANK.match(text, pos, hi).end() - pos
                crossed = True
                continue
            if value is not None and want and bare:
                if schemed := SCHEMED.match(text, start, hi):
                    found[value][1].append((schemed[1], *schemed.span(1), False))
                    pos, want, bare, operand, target = schemed.end(), False, False, "bare", None
                    continue
                while run and run.end() <= start:
                    run = next(runs, None)
                if run and run.start() <= start and run[1] is not None:
                    given = text[start:run.end()]
                    if not REFERENCE.fullmatch(given) and not (crossed and STATEMENT.match(given)):
                        found[value][1].append((given, start, run.end(), True))
                        pos, want, bare, operand, target = run.end(), False, False, "bare", None
                        continue
                bare = crossed and kind == "other"  # after a list's dash
            if kind in ("string", "triple"):
                if kind == "triple":
                    parts = value_lines(text, *m.span("inner"))
                    if ASSIGNS.search(text, *m.span("inner")):
                        self.read(*m.span("inner"))
                else:
                    quote = next(i for i, c in enumerate(m[0]) if c in "\"'`")
                    parts = [(m[0][quote + 1:-1], start + quote + 1, pos - 1, False)]
                if value is not None and (want or operand == "string"):
                    called = frames and frames[-1][3]
                    found[value][1].extend(part for part in parts if not (called and SETTING.fullmatch(part[0])))
                    operand, want = "string", False
                else:
                    operand = None
                target = parts[0][0] if kind == "string" else None
            elif kind in ("name", "reference"):
                target = m[0].strip("${}")
                if value is not None and target in WORDS:
                    value, want, operand, target = self.element(value), True, None, None
                elif value is not None and want and not (crossed and colon and not frames):
                    found[value][1].append(target)
                    operand, want = "name", False
                else:
                    operand = None
                    if value is not None and not frames:
                        value, want = None, False
            elif kind == "subscript":
                if value is not None and want:
                    part = m[0].strip("[] \t\r\n")
                    at = start + m[0].index(part)
                    found[value][1].append((part[1:-1], at + 1, at + len(part) - 1, False))
                    operand, want, target = "list", False, None
                elif target:
                    target += "." + m[0].strip("[]\t\r\n '\"")
            elif kind == "assign" and ternary and value is not None and m[0] == ":":
                value, want, operand, ternary, target = self.element(value), True, None, False, None
            elif kind == "assign" and target:
                outer = value
                if outer is not None and operand in ("string", "name") and found[outer][1]:
                    last = found[outer][1][-1]
                    if target == (last[0] if isinstance(last, tuple) else last):
                        found[outer][1].pop()  # it was no operand
                value = len(found)
                found.append((target, []))
                if outer is not None and (frames[-1][0] == ")" if frames else m[0] == "=" and not crossed):
                    found[outer][1].append(value)
                want, bare, operand, target = True, True, None, None
                crossed, colon, dash, ternary = False, m[0] == ":", False, False
                if colon and not frames and sensitivity(found[value][0]) and (block := BLOCK.match(text, pos, hi)):
                    found[value][1].extend(block_lines(text, block.end(), hi, indent))
                    value, want, pos = None, False, block.start(1)
            elif kind == "assign" and value is not None and not want:
                want = bare = True  # name: some[type] = value
                crossed = False
            elif m[0] in CLOSING and (frames or value is not None):
                if not frames:
                    base = indent
                owner = value if want or m[0] == "(" else None  # else an index or a block
                called = m[0] == "(" and (not want or bool(frames) and frames[-1][3])
                frames.append((CLOSING[m[0]], owner, value, called))
                value = self.element(owner)
                want, bare, operand, target = value is not None, False, None, None
            elif frames and m[0] in (")", "]", "}"):
                for up in range(1, min(4, len(frames)) + 1):
                    if frames[-up][0] == m[0]:
                        value = frames[-up][2]
                        del frames[-up:]
                        break
                operand, want, target = "list", False, None
            elif m[0] == "," and frames:
                value = self.element(frames[-1][1])
                want, bare, operand, target, ternary = value is not None, False, None, None, False
            elif value is not None and m[0] in OPERATORS and not want:
                want, operand, target = True, None, None
                ternary = ternary or m[0] == "?"
                if m[0] not in JOINING:
                    value = self.element(value)
            elif value is not None and want and (m[0] in OPERATORS or m[0] in PREFIXES):
                dash = dash or m[0] == "-" and crossed
                target = None
            elif m[0] not in ("+", "?") or value is not None:
                value, want, bare, operand, target = None, False, False, None, None


def sensitivity(name: str) -> float:
    parts = [p.lower() for p in NAME_PART.findall(name.rsplit("/", 1)[-1])]
    return min(1.0, sum(SENSITIVE.get(p, 0.0) for p in dict.fromkeys([*parts, "".join(parts[-2:])][:len(parts) + 1])))


def weight(entropy: float, length: float, kinds: int) -> float:
    """Up to 1 for long values of many different characters of three kinds and more."""
    return min(1.0, entropy / 3.5 * min(1.0, length / 12)) * (0.4 if kinds == 1 else 0.8 if kinds == 2 else 1.0)


def kinds(value: str) -> tuple[bool, ...]:
    return tuple(any(map(f, value)) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))


def randomness(value: str) -> float:
    """0 for placeholders, short or plain words, up to 1 for long mixed ones."""
    if len(value) < MIN_VALUE or PLACEHOLDER.match(value) or any(c.isspace() for c in value) or "://" in value:
        return 0.0
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    return weight(entropy, len(value), sum(kinds(value)))


def named(term: Term) -> str | None:
    return term if isinstance(term, str) else term[0] if isinstance(term, tuple) and term[3] else None


class Whole(NamedTuple):
    """What the randomness of a value depends on, in bounded space however long the value."""

    counts: np.ndarray  # characters, by code point modulo BINS
    length: float
    kinds: tuple[bool, ...]
    odd: bool  # has white space or a link, or is long and has a placeholder's word in a part
    ends: str  # the value, or its first and last characters if it is longer than ENDS

    @staticmethod
    def of(value: str) -> Whole:
        codes = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
        odd = any(map(str.isspace, value)) or "://" in value or len(value) > ENDS and bool(PLACEHOLDER.match(value))
        return Whole(np.bincount(codes % BINS, minlength=BINS).astype(float), float(len(value)), kinds(value), odd,
                     clipped(value))

    @staticmethod
    def together(parts: list[Whole]) -> Whole:
        """The parts one after the other.  Beyond ``LONGEST`` characters only the shares of the characters are kept."""
        counts, length = sum((p.counts for p in parts), np.zeros(BINS)), sum(p.length for p in parts)
        scale = min(1.0, LONGEST / length) if length else 1.0
        return Whole(counts * scale, length * scale, tuple(any(p.kinds[k] for p in parts) for k in range(4)),
                     any(p.odd for p in parts), clipped("".join(p.ends for p in parts)))

    def randomness(self) -> float:
        if self.length < MIN_VALUE or self.odd or "://" in self.ends or PLACEHOLDER.match(self.ends):
            return 0.0
        shares = self.counts[self.counts > 0] / self.length
        return weight(float(-(shares * np.log2(shares)).sum()), self.length, sum(self.kinds))


BINS, ENDS, LONGEST = 128, 64, 1e12


def clipped(value: str) -> str:
    return value if len(value) <= ENDS else value[:ENDS // 2] + value[-ENDS // 2:]


class Resolution:
    """The whole values of assignments of several terms, in time linear in the terms.

    Assignments inside another one's value (arguments, elements, alternatives) have values of
    their own and are no part of it; their ``root`` is the outermost one.  A name stands
    for its nearest assignment before the root.  Those references cannot go
    round in circles, so one pass over the roots in order finds every value from
    finished ones.  A name without an earlier assignment stands for its first later one, but
    only in the value where it is written, after that value's other parts; so these do not either.
    A value that is used no more is released."""

    def __init__(self, found: list, places: dict[str, list[int]], reached: dict[int, tuple[float, str]]):
        self.found, self.places = found, places
        self.root = list(range(len(found)))
        for i, (_, terms) in enumerate(found):
            for term in terms:
                if isinstance(term, int):
                    self.root[term] = self.root[i]  # inner ones follow outer ones
        self.order = sorted(reached, key=lambda i: (self.root[i], i))
        self.parts: dict[int, list[Literal | int]] = {}  # of each assignment: literals, and assignments it stands on
        self.later: dict[int, list[int]] = {}
        uses: Counter[int] = Counter()
        for i in self.order:
            parts, later = [], []
            for term in found[i][1]:
                if (name := named(term)) in places:
                    of = places[name]
                    k = bisect_left(of, self.root[i])
                    if k:
                        parts.append(of[k - 1])
                    elif self.root[of[0]] > self.root[i]:
                        later.append(of[0])
                elif isinstance(term, tuple):
                    parts.append(term)
            self.parts[i] = parts
            uses.update(p for p in parts if isinstance(p, int))
            if later:
                self.later[i] = later
                uses.update([i, *later])
        self.whole: dict[int, float] = {}
        kept: dict[int, Whole] = {}

        def use(j: int) -> Whole:
            uses[j] -= 1
            return kept[j] if uses[j] else kept.pop(j)

        for i in self.order:
            several = len(found[i][1]) > 1
            if several or uses[i]:
                value = Whole.together([use(p) if isinstance(p, int) else Whole.of(p[0]) for p in self.parts[i]])
                if uses[i]:
                    kept[i] = value
                if several and i not in self.later:
                    self.whole[i] = value.randomness() * 0.9
            else:
                for p in self.parts[i]:
                    if isinstance(p, int):
                        use(p)
        for i, later in self.later.items():
            value = Whole.together([use(i), *map(use, later)])
            if len(found[i][1]) > 1:
                self.whole[i] = value.randomness() * 0.9

    def best(self, reached: dict[int, tuple[float, str]]) -> dict[int, tuple[float, str]]:
        """Of each assignment: the best score and name among the whole values that it is part of."""
        own = {i: (reached[i][0] + whole, reached[i][1]) for i, whole in self.whole.items()}
        out = dict(own)

        def give(j: int, score: tuple[float, str]) -> None:
            if score[0] > out.get(j, (0.0, ""))[0]:
                out[j] = score

        for i in self.later:
            if i in own:
                for j in self.later[i]:
                    give(j, own[i])
        for i in reversed(self.order):
            if i in out:
                for j in self.parts[i]:
                    if isinstance(j, int):
                        give(j, out[i])
        return out


def words_of(literal: Literal) -> list[Literal]:
    """A literal, or those of its words that may be secrets if it has white space."""
    value, start, _, _ = literal
    if not any(map(str.isspace, value)):
        return [literal]
    out, before = [], ""
    for m in WORD.finditer(value):
        if re.fullmatch(SCHEME, before) or len(m[0]) >= MIN_WORD and sum(kinds(m[0])) > 2:
            out.append((m[0], start + m.start(), start + m.end(), False))
        before = m[0]
    return out


def lexed_spans(text: str) -> list[tuple[str, int, int, str, float]]:
    """Literals that assignments, directly or through constants, give to sensitive names.  A
    reference stands for every assignment of its name, so a reassigned name loses none."""
    found = Lexer(text).found
    places = defaultdict(list)  # a name's assignments, in order
    for i, (target, terms) in enumerate(found):
        if target and terms:
            places[target].append(i)
    # each assignment's most sensitive name among those that its value reaches
    reached: dict[int, tuple[float, str]] = {}
    followed = set()
    worths = {name: sensitivity(name) for name in places}
    for first in sorted((i for i, (t, _) in enumerate(found) if worths.get(t)), key=lambda i: -worths[found[i][0]]):
        todo = [first]
        while todo:
            i = todo.pop()
            if i in reached:
                continue
            reached[i] = (worths[found[first][0]], found[first][0])
            todo += [term for term in found[i][1] if isinstance(term, int)]
            for name in map(named, found[i][1]):
                if name in places and name not in followed:
                    followed.add(name)
                    todo += places[name]
    best: dict[tuple[int, int], tuple[float, str]] = {}
    if not reached:
        return []
    wholes = Resolution(found, places, reached).best(reached)
    for i, (worth, target) in reached.items():
        for literal in found[i][1]:
            if not isinstance(literal, tuple) or named(literal) in places:
                continue
            whole = wholes.get(i, (0.0, ""))
            for value, start, end, _ in words_of(literal):
                score, name = max((worth + randomness(value), target), whole, key=lambda x: x[0])
                if score >= THRESHOLD and value and score > best.get((start, end), (0.0, ""))[0]:
                    best[start, end] = (score, name)
    return [("lexed", s, e, name, score) for (s, e), (score, name) in best.items()]


def spans(text: str) -> list[dict]:
    base = base_spans(text)
    added = lexed_spans(text) if "=" in text or ":" in text else []
    out = [dict(kind=k, start=s, end=e, name=None, score=None) for k, s, e in base]
    out += [dict(kind=k, start=s, end=e, name=name, score=score) for k, s, e, name, score in added
            if not any(a <= s and e <= b for _, a, b in base)]
    return sorted(out, key=lambda x: (x["start"], KINDS.index(x["kind"]), x["end"]))


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``spans`` in place of the text: kind, start, end, and for lexed ones
    the target's name and the score."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                               ("name", pa.string()), ("score", pa.float64())]))
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                         T.StructField("end", T.IntegerType()), T.StructField("name", T.StringType()),
                         T.StructField("score", T.DoubleType())])

    def make(raw: list[bytes | None]) -> list[pa.Array]:
        return [pa.array([spans((t or b"").decode("utf-8", "replace")) for t in raw], kind)]

    return replaced(docs, text, [T.StructField("spans", T.ArrayType(span))], make)


def listing(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS[:3]]
    base = F.filter("spans", lambda x: x["kind"] != "lexed")
    return found.select("doc_id", *counts, F.sha2(listing(base).cast("binary"), 256).alias("base_sha256"),
                        listing(F.col("spans")).alias("spans"))
