"""Python regular expressions as Java ones with the same matches.

A pattern is read by Python's own parser and written again for Java with every class spelled out, because the two languages
mean different things by the same signs: Java counts marks, joiners and enclosed letters as word characters and Python does
not, Python counts fractions and raised digits, U+001C to U+001F are blanks in Python only, and both fold case in their own
way.  No Java flag is needed for the result.

``plain=True`` gives a shorter and faster form for texts of ASCII characters; :mod:`.matching` picks it for them.
"""

from __future__ import annotations

import re
import sys
from functools import lru_cache
from re import _constants as sre
from re import _parser as parser

# Blanks, and the letters, numbers and decimal digits assigned in Unicode 14.0 to 15.1, which the classes of
# older Java versions do not hold yet.
SPACE = ((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029),
         (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
NEW_WORD = (
    (0x870, 0x887), (0x889, 0x88E), (0x8B5, 0x8B5), (0x8C8, 0x8C9), (0xC5D, 0xC5D), (0xCDD, 0xCDD), (0x170D, 0x170D), (0x171F, 0x171F),
    (0x1B4C, 0x1B4C), (0x2C2F, 0x2C2F), (0x2C5F, 0x2C5F), (0x9FFD, 0x9FFF), (0xA7C0, 0xA7C1), (0xA7D0, 0xA7D1), (0xA7D3, 0xA7D3),
    (0xA7D5, 0xA7D9), (0xA7F2, 0xA7F4), (0x10570, 0x1057A), (0x1057C, 0x1058A), (0x1058C, 0x10592), (0x10594, 0x10595),
    (0x10597, 0x105A1), (0x105A3, 0x105B1), (0x105B3, 0x105B9), (0x105BB, 0x105BC), (0x10780, 0x10785), (0x10787, 0x107B0),
    (0x107B2, 0x107BA), (0x10F70, 0x10F81), (0x11071, 0x11072), (0x11075, 0x11075), (0x1123F, 0x11240), (0x11740, 0x11746),
    (0x11AB0, 0x11ABF), (0x11F02, 0x11F02), (0x11F04, 0x11F10), (0x11F12, 0x11F33), (0x11F50, 0x11F59), (0x12F90, 0x12FF0),
    (0x1342F, 0x1342F), (0x13441, 0x13446), (0x16A70, 0x16ABE), (0x16AC0, 0x16AC9), (0x1AFF0, 0x1AFF3), (0x1AFF5, 0x1AFFB),
    (0x1AFFD, 0x1AFFE), (0x1B11F, 0x1B122), (0x1B132, 0x1B132), (0x1B155, 0x1B155), (0x1D2C0, 0x1D2D3), (0x1DF00, 0x1DF1E),
    (0x1DF25, 0x1DF2A), (0x1E030, 0x1E06D), (0x1E290, 0x1E2AD), (0x1E4D0, 0x1E4EB), (0x1E4F0, 0x1E4F9), (0x1E7E0, 0x1E7E6),
    (0x1E7E8, 0x1E7EB), (0x1E7ED, 0x1E7EE), (0x1E7F0, 0x1E7FE), (0x2A6DE, 0x2A6DF), (0x2B735, 0x2B739), (0x2EBF0, 0x2EE5D),
    (0x31350, 0x323AF),
)
NEW_DIGIT = ((0x11F50, 0x11F59), (0x16AC0, 0x16AC9), (0x1E4F0, 0x1E4F9))
# End of fixed values.

_ASCII = "".join(map(chr, range(128)))


def _char(point: int) -> str:
    """A character in or out of a class.  Non-ASCII ones stand for themselves: beyond 16 bits Java looks back by whole
    characters only if one is written so."""
    c = chr(point)
    if point > 127 or c.isalnum() or c in "_@%":
        return c
    return rf"\x{point:02x}" if point < 33 or point == 127 else "\\" + c


def _ranges(ranges) -> str:
    return "".join(_char(a) if a == b else f"{_char(a)}-{_char(b)}" for a, b in ranges)


def _runs(points) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for p in sorted(points):
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return [(a, b) for a, b in out]


def _with_new(base: str, new) -> str:
    """``base`` and the new characters; one comparison tells most characters that they are none of these."""
    return rf"{base}[{_ranges([(new[0][0], new[-1][1])])}&&[{_ranges(new)}]]"


_MEMBERS = {
    sre.CATEGORY_DIGIT: _with_new(r"\p{Nd}", NEW_DIGIT),
    sre.CATEGORY_SPACE: _ranges(SPACE),
    sre.CATEGORY_WORD: _with_new(r"\p{L}\p{N}_", NEW_WORD),
}
_OPPOSITE = {sre.CATEGORY_NOT_DIGIT: sre.CATEGORY_DIGIT, sre.CATEGORY_NOT_SPACE: sre.CATEGORY_SPACE, sre.CATEGORY_NOT_WORD: sre.CATEGORY_WORD}
_PYTHON = {
    sre.CATEGORY_DIGIT: r"\d", sre.CATEGORY_NOT_DIGIT: r"\D", sre.CATEGORY_SPACE: r"\s", sre.CATEGORY_NOT_SPACE: r"\S",
    sre.CATEGORY_WORD: r"\w", sre.CATEGORY_NOT_WORD: r"\W",
}


@lru_cache(maxsize=1)
def _cased() -> str:
    return "".join(c for c in map(chr, range(sys.maxunicode + 1)) if not "\ud800" <= c <= "\udfff" and (c.lower() != c or c.upper() != c))


def _source(items: list) -> str:
    """The members of a class in Python's notation, without brackets."""
    point = lambda p: f"\\U{p:08x}"
    out = ""
    for op, value in items:
        if op is sre.LITERAL:
            out += point(value)
        elif op is sre.RANGE:
            out += f"{point(value[0])}-{point(value[1])}"
        elif op is sre.CATEGORY:
            out += _PYTHON[value]
        else:
            raise ValueError(f"class member {op} is not supported")
    return out


@lru_cache(maxsize=4096)
def _class(items: tuple, negated: bool, ignore_case: bool, ascii_only: bool, plain: bool) -> str:
    """A Java class with the characters that Python matches."""
    source = _source(list(items))
    flags = (re.IGNORECASE if ignore_case else 0) | (re.ASCII if ascii_only else 0)
    if plain:
        here = {ord(c) for c in re.findall(f"[{source}]", _ASCII, flags)}
        if negated:
            here = set(range(128)) - here
        return f"[{_ranges(_runs(here))}]" if here else "(?!)"
    if ascii_only:  # \d, \s and \w hold ASCII characters only; all others stand for themselves
        letters = {ord(c) for c in re.findall(f"[{source}]", _ASCII, flags)}
        beyond = [i for i in items if i[0] is not sre.CATEGORY]
        members = _ranges(_runs(letters)) + "".join(
            _ranges([(max(lo, 128), hi)]) for op, v in beyond for lo, hi in [(v, v) if op is sre.LITERAL else v] if hi > 127)
        if any(op is sre.CATEGORY and v in _OPPOSITE for op, v in items):
            members += r"\x{80}-\x{10ffff}"
    else:
        members = ""
        for op, value in items:
            if op is sre.CATEGORY:
                members += f"[^{_MEMBERS[_OPPOSITE[value]]}]" if value in _OPPOSITE else _MEMBERS[value]
            else:
                members += _ranges([(value, value) if op is sre.LITERAL else value])
        if ignore_case:
            exact = set(re.findall(f"[{source}]", _cased()))
            members += _ranges(_runs({ord(c) for c in re.findall(f"[{source}]", _cased(), re.IGNORECASE)} - {ord(c) for c in exact}))
    return f"[{'^' if negated else ''}{members}]"


def _kind(items, negated: bool) -> str:
    """``w``: word characters only, ``n``: none, ``?``: both or unknown."""
    if negated:
        return "n" if items == [(sre.CATEGORY, sre.CATEGORY_WORD)] else "?"
    kinds = set()
    for op, value in items:
        if op is sre.LITERAL:
            kinds.add("w" if chr(value).isalnum() or value == 95 else "n")
        elif op is sre.RANGE and value[1] < 128:
            kinds |= {"w" if chr(p).isalnum() or p == 95 else "n" for p in range(value[0], value[1] + 1)}
        elif op is sre.CATEGORY:
            kinds.add({sre.CATEGORY_DIGIT: "w", sre.CATEGORY_WORD: "w", sre.CATEGORY_SPACE: "n", sre.CATEGORY_NOT_WORD: "n"}.get(value, "?"))
        else:
            kinds.add("?")
    return kinds.pop() if len(kinds) == 1 else "?"


_ZERO_WIDTH = (sre.AT, sre.ASSERT, sre.ASSERT_NOT)
_REPEATS = {sre.MAX_REPEAT: "", sre.MIN_REPEAT: "?", sre.POSSESSIVE_REPEAT: "+"}


def _edge(nodes: list, last: bool) -> str:
    """Kind of the first (or last) character that ``nodes`` match; ``""`` if they may match nothing."""
    seen = set()
    for op, value in reversed(nodes) if last else nodes:
        if op in _ZERO_WIDTH:
            continue
        if op is sre.LITERAL:
            seen.add(_kind([(op, value)], False))
        elif op is sre.IN:
            negated = value[0][0] is sre.NEGATE
            seen.add(_kind(value[1:] if negated else value, negated))
        elif op is sre.SUBPATTERN or op is sre.ATOMIC_GROUP or op is sre.BRANCH or op in _REPEATS:
            parts = value[1] if op is sre.BRANCH else [value[2] if op in _REPEATS else value[-1] if op is sre.SUBPATTERN else value]
            kinds = {_edge(list(p), last) for p in parts}
            seen |= kinds - {""}
            if "" in kinds or (op in _REPEATS and value[0] == 0):
                continue
        else:
            seen.add("?")
        return seen.pop() if len(seen) == 1 else "?"
    return ""


class _Writer:
    def __init__(self, plain: bool):
        self.plain = plain

    def word(self, ascii_only: bool) -> str:
        return _class(((sre.CATEGORY, sre.CATEGORY_WORD),), False, False, ascii_only, self.plain)

    def boundary(self, before: str, after: str, ahead: str, flags: int) -> str:
        """``ahead``: a test of the next character, which is quicker than a look back."""
        if self.plain:
            return r"\b"
        w = self.word(bool(flags & re.ASCII))
        if after == "w":
            return {"w": "(?!)", "n": ""}.get(before, f"{ahead}(?<!{w})")
        if after == "n":
            return {"n": "(?!)", "w": ""}.get(before, f"(?<={w})")
        if before in ("w", "n"):
            return f"(?!{w})" if before == "w" else f"(?={w})"
        return f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))"

    def sequence(self, nodes, flags: int) -> str:
        nodes = list(nodes)
        return "".join(self.node(op, value, flags, nodes, i) for i, (op, value) in enumerate(nodes))

    def one(self, items: list, negated: bool, flags: int) -> str:
        return _class(tuple(items), negated, bool(flags & re.IGNORECASE), bool(flags & re.ASCII), self.plain)

    def literal(self, point: int, flags: int) -> str:
        if flags & re.IGNORECASE and (chr(point).lower() != chr(point) or chr(point).upper() != chr(point)):
            return self.one([(sre.LITERAL, point)], False, flags)
        return "(?!)" if self.plain and point > 127 else _char(point)

    def node(self, op, value, flags: int, nodes: list, i: int) -> str:
        if op is sre.LITERAL:
            return self.literal(value, flags)
        if op is sre.NOT_LITERAL:
            return self.one([(sre.LITERAL, value)], True, flags)
        if op is sre.IN:
            negated = value[0][0] is sre.NEGATE
            return self.one(value[1:] if negated else value, negated, flags)
        if op is sre.ANY:
            return r"[\x{0}-\x{10ffff}]" if flags & re.DOTALL else "[^\\n]"
        if op is sre.AT:
            return self.place(value, flags, nodes, i)
        if op is sre.BRANCH:
            return "(?:" + "|".join(self.sequence(p, flags) for p in value[1]) + ")"
        if op is sre.SUBPATTERN:
            group, add, drop, inner = value
            return ("(?:" if group is None else "(") + self.sequence(inner, (flags | add) & ~drop) + ")"
        if op is sre.ATOMIC_GROUP:
            return f"(?>{self.sequence(value, flags)})"
        if op in _REPEATS:
            low, high, inner = value
            inner = list(inner)
            body = self.sequence(inner, flags)
            single = len(inner) == 1 and inner[0][0] in (sre.LITERAL, sre.NOT_LITERAL, sre.IN, sre.ANY, sre.SUBPATTERN, sre.ATOMIC_GROUP)
            body = body if single else f"(?:{body})"
            times = {(0, 1): "?", (0, sre.MAXREPEAT): "*", (1, sre.MAXREPEAT): "+"}.get(
                (low, high), f"{{{low}}}" if low == high else f"{{{low},{'' if high is sre.MAXREPEAT else high}}}")
            return body + times + _REPEATS[op]
        if op in (sre.ASSERT, sre.ASSERT_NOT):
            direction, inner = value
            return f"(?{'<' if direction < 0 else ''}{'=' if op is sre.ASSERT else '!'}{self.sequence(inner, flags)})"
        if op is sre.GROUPREF:
            return f"(?iu:\\{value})" if flags & re.IGNORECASE else f"(?:\\{value})"
        if op is sre.FAILURE:
            return "(?!)"
        raise ValueError(f"{op} is not supported")

    def ahead(self, nodes: list, flags: int) -> str:
        while nodes and nodes[0][0] in _REPEATS and nodes[0][1][0] > 0:
            nodes = list(nodes[0][1][2])
        return f"(?={self.node(*nodes[0], flags, nodes, 0)})" if nodes and nodes[0][0] in (sre.LITERAL, sre.IN) else ""

    def place(self, where, flags: int, nodes: list, i: int) -> str:
        if where in (sre.AT_BOUNDARY, sre.AT_NON_BOUNDARY):
            if where is sre.AT_BOUNDARY:
                return self.boundary(_edge(nodes[:i], True), _edge(nodes[i + 1 :], False), self.ahead(nodes[i + 1 :], flags), flags)
            w = self.word(bool(flags & re.ASCII))
            return rf"(?:(?<={w})(?={w})|(?<!{w})(?!{w})(?!\A\z))"
        if where is sre.AT_BEGINNING:
            return "(?<![^\\n])" if flags & re.MULTILINE else r"\A"
        if where is sre.AT_END:
            return "(?![^\\n])" if flags & re.MULTILINE else r"(?=\n?\z)"
        return {sre.AT_BEGINNING_STRING: r"\A", sre.AT_END_STRING: r"\z"}[where]


def needed_literals(regex: str, flags: int = 0) -> list[str]:
    """Runs of ASCII characters, in lower case, each of which stands in every match of a pattern (see :func:`folded`)."""
    tree = parser.parse(regex, int(flags))
    out, run = [], ""

    def end() -> None:
        nonlocal run
        if run:
            out.append(run)
        run = ""

    def walk(nodes) -> None:
        nonlocal run
        for op, value in nodes:
            if op is sre.LITERAL and value < 128:
                run += chr(value).lower()
            elif op is sre.SUBPATTERN:
                walk(value[3])
            elif op is sre.ATOMIC_GROUP:
                walk(value)
            elif op in _REPEATS and value[0] > 0:
                same = value[0] == value[1]
                for _ in range(min(value[0], 8) if same else 1):
                    if not same:
                        end()
                    walk(value[2])
                if not same or value[0] > 8:
                    end()
            elif op not in _ZERO_WIDTH:
                end()

    walk(tree)
    end()
    return out


def looks_no_further(regex: str, flags: int = 0) -> bool:
    """Whether a match in a blank-separated word of a text is always one in the text, too.

    So it is if a pattern asks nothing about its surroundings but for word boundaries, which blanks and ends of a text are alike,
    and each way to match stays open.
    """
    plain = (sre.LITERAL, sre.NOT_LITERAL, sre.IN, sre.ANY)

    def free(nodes) -> bool:
        return all(
            op in plain or op is sre.AT and value is sre.AT_BOUNDARY or op is sre.SUBPATTERN and free(value[3])
            or op is sre.BRANCH and all(free(way) for way in value[1]) or op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and free(value[2])
            for op, value in nodes)

    return free(parser.parse(regex, int(flags)))


#: Characters that Python takes for an ASCII letter when it ignores case, and that lower-casing does not change into it.
FOLDS = ("\u017f\u0131\u0130", "sii")


def literal_tree(words) -> str:
    """Java expression for any of ``words`` of ASCII characters, factored by common beginnings, longest first."""
    out, before = "(?:", ""
    for word in sorted(words, reverse=True):
        c = 0
        while c < min(len(before), len(word)) and before[c] == word[c]:
            c += 1
        out += (")" * (len(before) - c) + "|" if before else "") + "".join(_char(ord(x)) + "(?:" for x in word[c:])
        before = word
    return out + ")" * len(before) + ")"


@lru_cache(maxsize=4096)
def to_java(regex: str, flags: int = 0, plain: bool = False) -> str:
    """The Java form of a Python ``str`` pattern.

    ``re.error`` if Python does not take the pattern; ``ValueError`` for conditional groups, which Java lacks.  ``plain``: for
    texts of ASCII characters only.
    """
    tree = parser.parse(regex, int(flags))
    return _Writer(plain).sequence(tree, tree.state.flags)
