"""Regular expressions: the dialect of policies and detectors, as Java's."""

from __future__ import annotations

import re
from functools import cache, reduce
from operator import or_
from re import _parser as sre_parse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = "A-Za-z0-9_"
#: construct -> the spelling of the same meaning by look-around (ASCII word boundaries).
_BOUNDARY = "(?:(?<!{w})(?={w})|(?<={w})(?!{w}))"
_NOT_BOUNDARY = "(?:(?<={w})(?={w})|(?<!{w})(?!{w}))"
#: Named sets as ranges of code points. RE2's.
SETS = {
    "alnum": [(48, 57), (65, 90), (97, 122)], "alpha": [(65, 90), (97, 122)], "ascii": [(0, 127)], "blank": [(9, 9), (32, 32)], "cntrl": [(0, 31), (127, 127)],
    "digit": [(48, 57)], "graph": [(33, 126)], "lower": [(97, 122)], "print": [(32, 126)], "punct": [(33, 47), (58, 64), (91, 96), (123, 126)], "space": [(9, 13), (32, 32)],
    "upper": [(65, 90)], "word": [(48, 57), (65, 90), (95, 95), (97, 122)], "xdigit": [(48, 57), (65, 70), (97, 102)],
}
_SHORT = {"d": SETS["digit"], "w": SETS["word"], "s": [(9, 10), (12, 13), (32, 32)]}
_CONTROL = {"a": 7, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11}
MOST_REPEATS, LAST_CODE = 1000, 0x10FFFF


class PatternError(ValueError):
    """A pattern that RE2 does not take."""


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in any order as ascending ones that do not touch."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _others(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges that ``ranges`` (ascending) leave."""
    out, at = [], 0
    for lo, hi in ranges:
        if at < lo:
            out.append((at, lo - 1))
        at = hi + 1
    return [*out, (at, LAST_CODE)] if at <= LAST_CODE else out


class _Reader:
    """Reads an RE2 pattern once and writes it for Java or for Python's ``regex``."""

    def __init__(self, pattern: str, java: bool):
        self.p, self.i, self.java, self.out = pattern, 0, java, []

    def char(self, code: int) -> str:
        if code < 128:
            return chr(code) if chr(code).isalnum() else f"\\x{code:02x}"
        return f"\\x{{{code:x}}}" if self.java else f"\\U{code:08x}"

    def ranges(self, rs: list[tuple[int, int]]) -> str:
        return "".join(self.char(a) if a == b else f"{self.char(a)}-{self.char(b)}" for a, b in rs)

    def members(self, rs: list[tuple[int, int]], properties: list[str], negative: bool, folds: bool) -> str:
        """The class of ``rs`` and ``properties``, or of all others.

        Java looks characters below 256 up in one table if they are written one by one, but tries ranges one after the other;
        under ``(?i)`` the two fold differently, so ranges stay there.
        """
        if self.java and not folds:
            rs = _joined(rs)
            if not properties and rs and rs[-1][1] == LAST_CODE:
                rs, negative = _others(rs), not negative
            low = [(c, c) for a, b in rs for c in range(a, min(b, 255) + 1)]
            rs = low + [(max(a, 256), b) for a, b in rs if b > 255]
        body = self.ranges(rs) + "".join(properties)
        if not body:  # nothing, or everything
            body, negative = self.ranges([(0, LAST_CODE)]), not negative
        return f"[{'^' if negative else ''}{body}]"

    def fail(self, why: str):
        raise PatternError(f"{why} at {self.i} in {self.p!r}")

    def escape(self) -> tuple[str, object]:
        """The escape at ``i``: ("char", code), ("set", ranges), ("property", text) or ("place", letter); moves on."""
        if self.i + 1 >= len(self.p):
            self.fail("a backslash at the end")
        c = self.p[self.i + 1]
        rest = self.p[self.i + 1 :]
        if m := re.match(r"[pP](\{(\^?)(\w+)\}|[A-Z])", rest):
            name = m[3] or m[1]
            negative = (c == "P") != bool(m[2])
            self.i += 1 + m.end()
            if name == "Any":
                return "set", [] if negative else [(0, LAST_CODE)]
            script = f"Is{name}" if self.java and len(name) > 2 else name
            return "property", f"\\{'P' if negative else 'p'}{{{script}}}"
        if m := re.match(r"x(?:\{([0-9A-Fa-f]+)\}|([0-9A-Fa-f]{2}))", rest):
            self.i += 1 + m.end()
            code = int(m[1] or m[2], 16)
            return ("char", code) if code <= LAST_CODE else self.fail("no such character")
        if m := re.match(r"0[0-7]{0,2}|[1-7][0-7]{1,2}", rest):
            self.i += 1 + m.end()
            return "char", int(m[0], 8)
        self.i += 2
        if c in _CONTROL:
            return "char", _CONTROL[c]
        if c in "dws":
            return "set", _SHORT[c]
        if c in "DWS":
            return "set", _others(_SHORT[c.lower()])
        if c in "AzbB":
            return "place", c
        if ord(c) < 128 and not c.isalnum():
            return "char", ord(c)
        self.i -= 2
        self.fail(f"unknown escape \\{c}")

    def boundary(self, folds: bool) -> str:
        """A word's boundary: its beginning if what follows at ``i`` can only be a letter or digit (k and s fold with letters that are none)."""
        group = re.match(r"\((?:\?:)?([^()\[\]\\]*)\)(?![?*{])", self.p[self.i :])
        firsts = group[1].split("|") if group else [self.p[self.i :]]
        if not all(re.match(rf"[{_WORD}](?![?*{{])", x) for x in firsts) or (folds and any(x[0] in "KkSs" for x in firsts)):
            return "b"
        return f"(?<!{self.word(folds)})" + (f"(?=[{_WORD}])" if folds and any(x[0] in "Ii" for x in firsts) else "")  # Java folds a dotless i

    def beside(self, place: str, folds: bool) -> str | None:
        """A boundary, or none, before a character at ``i`` that is of no word: one look at what is before it."""
        if self.java and not folds and re.match(rf"[^\\\[\](){{}}.*+?|^${_WORD}](?![?*{{])", self.p[self.i :]):
            return f"(?<{'=' if place == 'b' else '!'}{self.word(folds)})"

    def word(self, folds: bool) -> str:
        """The class of a word's characters."""
        return self.members(SETS["word"], [], False, folds) if self.java and not folds else f"[{_WORD}]"

    def klass(self, folds: bool) -> str:
        """The bracketed class at ``i``."""
        p, self.i = self.p, self.i + 1
        negative = p.startswith("^", self.i)
        self.i += negative
        ranges, properties, first = [], [], True
        while True:
            if self.i >= len(p):
                self.fail("a class without end")
            if p[self.i] == "]" and not first:
                self.i += 1
                break
            first = False
            if m := re.match(r"\[:(\^?)(\w+):\]", p[self.i :]):
                if m[2] not in SETS:
                    self.fail("unknown class")
                ranges += _others(SETS[m[2]]) if m[1] else SETS[m[2]]
                self.i += m.end()
                continue
            kind, value = self.one()
            if kind == "char" and p.startswith("-", self.i) and self.i + 1 < len(p) and p[self.i + 1] != "]":
                self.i += 1
                to, last = self.one()
                if to != "char" or last < value:
                    self.fail("not a range")
                ranges.append((value, last))
            elif kind == "property":
                properties.append(value)
            else:
                ranges += [(value, value)] if kind == "char" else value
        return self.members(ranges, properties, negative, folds)

    def one(self) -> tuple[str, object]:
        """A character or an escape in a class."""
        if self.p[self.i] != "\\":
            self.i += 1
            return "char", ord(self.p[self.i - 1])
        kind, value = self.escape()
        return self.fail("a place in a class") if kind == "place" else (kind, value)

    def run(self) -> str:
        p, out = self.p, []
        flags = {"i": False, "m": False, "s": False, "U": False}
        stack, again = [], None  # again: what a quantifier may repeat ("yes", "no", or it follows one)
        while self.i < len(p):
            c = p[self.i]
            if c == "\\":
                if p.startswith("\\Q", self.i):
                    end = p.find("\\E", self.i)
                    text = p[self.i + 2 : end if end >= 0 else len(p)]
                    out += [self.char(ord(x)) for x in text]
                    self.i = end + 2 if end >= 0 else len(p)
                else:
                    kind, value = self.escape()
                    if kind == "place" and value in "bB":
                        value = self.beside(value, flags["i"]) or (self.boundary(flags["i"]) if value == "b" else value)
                    out.append(
                        self.char(value) if kind == "char" else (self.members(value, [], False, flags["i"]) if value else "(?!)") if kind == "set" else value if kind == "property"
                        else {"A": r"\A", "z": r"\z" if self.java else r"\Z", "b": _BOUNDARY.format(w=self.word(flags["i"])), "B": _NOT_BOUNDARY.format(w=self.word(flags["i"]))}.get(value, value)
                    )
                again = "yes"
            elif c == "[":
                out.append(self.klass(flags["i"]))
                again = "yes"
            elif c == "(":
                again = None
                if m := re.match(r"\(\?P?<(\w+)>", p[self.i :]):
                    stack.append(dict(flags))
                    out.append("(")
                    self.i += m.end()
                elif m := re.match(r"\(\?([imsU]*)(?:-([imsU]+))?([:)])", p[self.i :]):
                    if m[3] == ":":
                        stack.append(dict(flags))
                    flags |= {f: True for f in m[1]} | {f: False for f in m[2] or ""}
                    on, off = ("".join(("iu" if self.java else "i") if f == "i" else f for f in "is" if flags[f] is v) for v in (True, False))
                    out.append(f"(?{on}{'-' + off if off else ''}{m[3]}")
                    self.i += m.end()
                elif p.startswith("(?", self.i):
                    self.fail("unknown group")
                else:
                    stack.append(dict(flags))
                    out.append("(")
                    self.i += 1
            elif c == ")":
                if not stack:
                    self.fail("a parenthesis too many")
                flags = stack.pop()
                out.append(c)
                self.i += 1
                again = "yes"
            elif (m := re.match(r"(?:[*+?]|\{(\d+)(?:(,)(\d*))?\})(\??)", p[self.i :])) and c in "*+?{":
                if again != "yes":
                    self.fail("nothing to repeat" if again is None else "a repetition of a repetition")
                least, most = int(m[1] or 0), int(m[3] or m[1] or 0)
                if least > MOST_REPEATS or most > MOST_REPEATS or (m[3] and most < least):
                    self.fail("a repetition of this size")
                lazy = bool(m[4]) != flags["U"]
                out.append(m[0].removesuffix("?") if c != "?" else "?")
                out += ["?"] if lazy else []
                self.i += m.end()
                again = "no"
            else:
                places = {"^": "(?<![^\\n])" if flags["m"] else r"\A", "$": "(?![^\\n])" if flags["m"] else r"\z" if self.java else r"\Z"}
                out.append(places.get(c) or (c if c in "|." else self.char(ord(c))))
                self.i += 1
                again = None if c == "|" else "yes"
        if stack:
            self.fail("a parenthesis without end")
        return "".join(out)


def re2_to_java(pattern: str) -> str:
    """The Java pattern that matches what ``pattern`` matches in RE2; raises PatternError where RE2 takes none.

    Lines end at line feed only; letters fold by Unicode under ``(?i)``; ``$`` without ``(?m)`` is the very end;
    classes by name and by letter are ASCII; named groups lose their names; ``(?U)`` swaps greed.
    """
    return "(?d)" + _Reader(pattern, True).run()


def re2_to_python(pattern: str) -> str:
    """The same for Python's ``regex`` module."""
    return "(?V1)(?-f)" + _Reader(pattern, False).run()


def check_pattern(pattern: str) -> None:
    """Raises PatternError unless RE2 takes the pattern and, in a session, Java compiles its translation."""
    from pyspark import SparkContext

    java = re2_to_java(pattern)
    if (sc := SparkContext._active_spark_context) is not None:
        try:
            sc._jvm.java.util.regex.Pattern.compile(java)
        except Exception as e:
            raise PatternError(f"{pattern!r}: {str(e).splitlines()[0]}") from e


def glob_to_java(glob: str) -> str:
    """``*`` any run, ``?`` any character, ``a|b`` either; the whole name."""
    return "|".join(r"\A" + "".join(".*" if c == "*" else "." if c == "?" else _escape(c) for c in part.strip()) + r"\z" for part in glob.split("|"))


def _escape(c: str) -> str:
    return c if c.isalnum() or c == "_" else "\\" + c


def name_pattern(pattern: str) -> str:
    """A tool pattern: ``/regex/`` (anywhere), else a glob."""
    if len(pattern) > 1 and pattern.startswith("/") and pattern.endswith("/"):
        return re2_to_java(pattern[1:-1])
    return glob_to_java(pattern)


@cache
def compiled(pattern: str):
    """An RE2 pattern for Python tasks."""
    import regex

    return regex.compile(re2_to_python(pattern))


def name_matches(pattern: str, name: str) -> bool:
    """Does a tool pattern fit a name? (On the driver; columns use ``name_pattern``.)"""
    if len(pattern) > 1 and pattern.startswith("/") and pattern.endswith("/"):
        return compiled(pattern[1:-1]).search(name) is not None
    return re.search(glob_to_java(pattern).replace(r"\z", r"\Z"), name) is not None


def required_literals(pattern: str) -> list[frozenset[str]]:
    """Sets of lower-case texts of an RE2 pattern: whatever it matches holds, lower-cased, at least one text of every set.

    Read off the parsed pattern: runs of literals in a sequence, the union over the arms of an alternative.
    Literals that are not ASCII end a run, short ones of letters say too little and are left out.
    """
    if re.search(r"\[:|\\[QEpPxz0-9]|\(\?[a-zA-Z-]*[-U]", pattern):  # what the parser below takes for something else
        return []
    try:
        tree = sre_parse.parse(pattern)
    except re.error:  # RE2 allows more, such as flags half-way: nothing is known then
        return []
    telling = lambda s: len(s) >= 3 or (s and not s.isalnum())

    def sets_of(seq) -> list[frozenset[str]]:
        out, run = [], [""]

        def close():
            if run[0] != "":
                out.append(frozenset(run))
            run[:] = [""]

        for op, arg in seq:
            name = str(op)
            if name == "LITERAL" and arg < 128:
                run[:] = [r + chr(arg).lower() for r in run]
                continue
            if name == "AT":
                continue  # places match nothing
            close()
            if name == "SUBPATTERN":
                out += sets_of(arg[3])
            elif name == "BRANCH":
                # the arms' most telling sets, together: one of them must be there
                arms = [best(sets_of(a)) for a in arg[1]]
                if all(arms):
                    out.append(frozenset().union(*arms))
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
                out += sets_of(arg[2])
            elif name == "IN" and len(arg) <= 4 and all(str(o) == "LITERAL" and a < 128 for o, a in arg):
                out.append(frozenset(chr(a).lower() for _, a in arg))
        close()
        return [s for s in out if all(telling(x) for x in s)]

    def best(sets):
        return max(sets, key=lambda s: (min(map(len, s)), -len(s)), default=None)

    return list(dict.fromkeys(sets_of(tree)))


def lowered(text: Column) -> Column:
    """The text as ``may_match`` reads it: lower-cased, the long s as s (case folding takes them for one letter)."""
    return F.replace(F.lower(text), F.lit("ſ"), F.lit("s"))


def may_match(low: Column, pattern: str) -> Column:
    """A cheap condition on the ``lowered`` text without which the RE2 pattern matches nowhere."""
    out = F.lit(True)
    for texts in sorted(required_literals(pattern), key=len):
        out = out & reduce(or_, (low.contains(t) for t in sorted(texts)))
    return out


def matches(text: Column, low: Column, pattern: str) -> Column:
    """Does the RE2 pattern match? The regular expression only runs where its literals are."""
    return may_match(low, pattern) & text.rlike(re2_to_java(pattern))


def spread(rows: DataFrame, row_group: int = 128 << 20) -> DataFrame:
    """``rows`` dealt to all cores if they are too few bytes for that many row groups; larger inputs stay where they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores * row_group else rows
