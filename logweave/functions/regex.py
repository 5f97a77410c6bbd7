"""Regex dialect: patterns written for the .NET engine, run by Java's ``Pattern``.

A pattern is read into a small tree (alternatives, pieces with quantifiers, groups,
classes, escapes) by the rules of the dialect it was written in, and the tree is written
out in Java's.  What the tree cannot hold is an error while a plan is built, never
a pattern that means something else:

* named groups ``(?<name>...)`` / ``(?'name'...)`` may use ``_`` and repeat a name;
  Java rejects both, so they become positional groups with a side list of names; back
  references by name or number are renumbered (numbers count unnamed groups first);
* explicit capture (the regex parser's mode) means unnamed ``(`` does not capture;
* ``\\d \\w \\b \\s`` and case folding are Unicode-aware -> ``(?U)``;
* ``.`` and ``$`` treat only ``\\n`` as a line end -> ``(?d)``;
* ``\\p{IsGreek}`` is a block there and a script in Java; ``\\v`` one character there and
  a class in Java; ``a{,3}`` and a lone ``{`` are literal there; comments go;
* Java's own syntax -- possessive quantifiers, ``\\h``, ``\\R``, ``\\X``, ``\\Q..\\E``, POSIX
  classes, other flags -- is rejected, as the dialect does, and so are balancing groups
  and conditionals, which have no Java form.

Nothing here runs per row.  The translated pattern is a literal in the plan, so
the JVM compiles it once per task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


class InvalidPatternError(ValueError):
    """A pattern that cannot be used (bad syntax or an unsupported construct)."""


@dataclass(frozen=True)
class JavaPattern:
    pattern: str
    # group_names[i] is the name of positional group i + 1 (None: unnamed group)
    group_names: tuple[str | None, ...]

    def named_groups(self) -> list[tuple[str, list[int]]]:
        """Names in first-appearance order with every group index carrying it."""
        out: dict[str, list[int]] = {}
        for i, n in enumerate(self.group_names, start=1):
            if n is not None:
                out.setdefault(n, []).append(i)
        return list(out.items())


_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_COUNT = re.compile(r"\{(\d+)(?:,(\d*))?\}")
_OPTIONS = re.compile(r"\?([imsnx]*)(?:-([imsnx]*))?([:)])")
# General categories a pattern may name, and a block with another name in Java.
_CATEGORIES = frozenset("L Lu Ll Lt Lm Lo M Mn Mc Me N Nd Nl No P Pc Pd Ps Pe Pi Pf Po S Sm Sc Sk So Z Zs Zl Zp C Cc Cf Cs Co Cn".split())
_BLOCKS = {"GreekandCoptic": "Greek", "PrivateUse": "PrivateUseArea", "CombiningMarksforSymbols": "CombiningDiacriticalMarksforSymbols"}
# Escapes with one meaning in both dialects, in a class or not; and outside classes only.
_SHARED = frozenset("adDefnrsStwW")
_ANCHORS = frozenset("AbBGzZ")


# ---- tree -----------------------------------------------------------------------
@dataclass
class Text:
    """A piece that reads the same in Java."""

    java: str


@dataclass
class Reference:
    """A back reference, by name or by number."""

    to: str | int


@dataclass
class Class:
    """A character class: its members, and the class taken from them."""

    negated: bool
    members: list[str]
    minus: Class | None = None

    def java(self) -> str:
        own = f"[{'^' if self.negated else ''}{''.join(self.members)}]"
        return own if self.minus is None else f"[{own}&&{self.minus.complement()}]"

    def complement(self) -> str:
        if self.minus is not None:
            raise InvalidPatternError("a subtraction inside a subtraction is not supported")
        return f"[{'' if self.negated else '^'}{''.join(self.members)}]"


@dataclass
class Group:
    """``head`` is what follows the bracket; a capturing group has a place among the groups."""

    head: str
    body: list
    place: int | None = None


@dataclass
class Repeat:
    piece: object
    times: str


class _Reader:
    def __init__(self, pattern: str, explicit_capture: bool):
        self.pattern, self.explicit, self.at = pattern, explicit_capture, 0
        self.names: list[str | None] = []
        self.spaced = False  # option x: white space and # comments mean nothing

    def error(self, why: str) -> InvalidPatternError:
        return InvalidPatternError(f"{why} in {self.pattern!r}")

    def peek(self, n: int = 1) -> str:
        return self.pattern[self.at:self.at + n]

    # -- alternatives and pieces
    def alternatives(self, closing: bool) -> list:
        """Branches up to the closing bracket or the end, each a list of pieces."""
        branches: list[list] = [[]]
        outer = self.spaced
        while self.at < len(self.pattern):
            c = self.peek()
            if c == ")":
                if not closing:
                    raise self.error("Too many )'s")
                break
            if c == "|":
                self.at += 1
                branches.append([])
                continue
            if self.spaced and (c.isspace() or c == "#"):
                self._skip_spaces()
                continue
            if c in "*+?" or _COUNT.match(self.pattern, self.at):
                raise self.error(f"Quantifier {c} following nothing")
            piece = self._piece()
            if piece is not None:
                branches[-1].append(self._repeated(piece))
        if closing:
            self.spaced = outer
        return branches

    def _skip_spaces(self) -> None:
        while self.at < len(self.pattern) and (self.peek().isspace() or self.peek() == "#"):
            if self.peek() == "#":
                end = self.pattern.find("\n", self.at)
                self.at = len(self.pattern) if end < 0 else end
            else:
                self.at += 1

    def _quantifier(self) -> str | None:
        if self.spaced:
            self._skip_spaces()
        c = self.peek()
        if c and c in "*+?":
            self.at += 1
            return c
        m = _COUNT.match(self.pattern, self.at)
        if m:
            self.at = m.end()
            if m.group(2) and int(m.group(2)) < int(m.group(1)):
                raise self.error("Illegal {x,y} with x > y")
            return m.group(0)
        return None

    def _repeated(self, piece):
        times = self._quantifier()
        if times is None:
            return piece
        if self.peek() == "?":
            self.at += 1
            times += "?"
        if self._quantifier() is not None:
            raise self.error("Nested quantifier")
        return Repeat(piece, times)

    def _piece(self):
        c = self.peek()
        if c == "\\":
            return self._escape()
        if c == "[":
            self.at += 1
            return self._class()
        if c == "(":
            self.at += 1
            return self._group()
        self.at += 1
        if c in "^$":
            return Text(c)
        return Text("\\" + c if c in "{}]" or (self.spaced and c in " #") else c)

    # -- escapes
    def _escape(self, in_class: bool = False):
        """The piece of an escape; in a class always a ``Text``."""
        self.at += 1
        c = self.peek()
        if not c:
            raise self.error("Illegal \\ at end of pattern")
        self.at += 1
        if c in _SHARED:
            return Text("\\" + c)
        if c in "pP":
            return Text(f"\\{c}{{{self._property()}}}")
        if c == "b" and in_class:
            return Text("\\x08")
        if c in _ANCHORS and not in_class:
            return Text("\\" + c)
        if c == "v":
            return Text("\\x0B")
        if c in "xu":
            digits = self.peek(2 if c == "x" else 4)
            if not re.fullmatch("[0-9a-fA-F]{%d}" % (2 if c == "x" else 4), digits):
                raise self.error("Insufficient hexadecimal digits")
            self.at += len(digits)
            return Text(f"\\{c}{digits}")
        if c == "c":
            letter = self.peek().upper()
            if not letter or not "@" <= letter <= "_":
                raise self.error("Unrecognized control character")
            self.at += 1
            return Text("\\x%02X" % (ord(letter) - 64))
        if c == "k" and not in_class:
            m = re.compile(r"<([^>]*)>|'([^']*)'").match(self.pattern, self.at)
            if not m:
                raise self.error("Malformed \\k<...> named back reference")
            self.at = m.end()
            name = m.group(1) if m.group(1) is not None else m.group(2)
            return Reference(int(name) if name.isdigit() else name)
        if c.isdigit():
            return self._number(c, in_class)
        if c.isalnum() or c == "_":
            raise self.error(f"Unrecognized escape sequence \\{c}")
        return Text("\\" + c)

    def _number(self, first: str, in_class: bool):
        if first != "0" and not in_class:
            m = re.compile(r"\d*").match(self.pattern, self.at)
            self.at = m.end()
            return Reference(int(first + m.group(0)))
        m = re.compile("[0-7]{0,2}").match(self.pattern, self.at)
        self.at = m.end()
        if first > "7":
            raise self.error(f"Unrecognized escape sequence \\{first}")
        return Text("\\x%02X" % (int(first + m.group(0), 8) & 0xFF))

    def _property(self) -> str:
        m = re.compile(r"\{(\^?[\w-]+)\}").match(self.pattern, self.at)
        if not m:
            raise self.error("Malformed \\p{X} character escape")
        self.at = m.end()
        name = m.group(1)
        if name in _CATEGORIES:
            return name
        if name.startswith("Is") and len(name) > 2:
            return "In" + _BLOCKS.get(name[2:], name[2:])
        raise self.error(f"Unknown property {name!r}")

    # -- classes
    def _class(self) -> Class:
        out = Class(self.peek() == "^", [])
        self.at += out.negated
        first = True
        while True:
            c = self.peek()
            if not c:
                raise self.error("Unterminated [] set")
            if c == "]" and not first:
                self.at += 1
                return out
            if c == "-" and self.peek(2) == "-[" and not first:
                self.at += 2
                out.minus = self._class()
                if self.peek() != "]":
                    raise self.error("A subtraction must be the last element of a class")
                continue
            first = False
            if c == "\\":
                out.members.append(self._escape(in_class=True).java)
                continue
            self.at += 1
            out.members.append("\\" + c if c in "[]&# \t\n" else c)

    # -- groups
    def _group(self):
        if self.peek() != "?":
            return self._capture(None) if not self.explicit else self._closed("?:")
        rest = self.pattern[self.at:]
        if rest.startswith("?("):
            raise InvalidPatternError("conditional groups (?(...) are not supported")
        if rest.startswith("?#"):
            end = rest.find(")")
            if end < 0:
                raise self.error("Unterminated (?#...) comment")
            self.at += end + 1
            return None
        for head in ("?:", "?=", "?!", "?>", "?<=", "?<!"):
            if rest.startswith(head):
                self.at += len(head)
                return self._closed(head)
        if rest[1:2] in ("<", "'"):
            end = rest.find(">" if rest[1] == "<" else "'", 2)
            if end < 0:
                raise self.error("Unterminated group name")
            name = rest[2:end]
            if "-" in name:
                raise InvalidPatternError("balancing groups are not supported")
            if not name.isdigit() and not _NAME.fullmatch(name):
                raise InvalidPatternError(f"Invalid group name {name!r}")
            self.at += end + 1
            return self._capture(None if name.isdigit() else name)
        m = _OPTIONS.match(rest)
        if not m:
            raise self.error("Unrecognized grouping construct")
        on, off = m.group(1), m.group(2) or ""
        if "n" in on + off:
            raise InvalidPatternError("inline option n is not supported")
        self.at += m.end()
        outer = self.spaced
        self.spaced = ("x" in on or outer) and "x" not in off
        # white space is taken out here; Java's x would also take it out of classes
        head = "?" + on.replace("x", "") + ("-" + off.replace("x", "") if off.replace("x", "") else "")
        if m.group(3) == ")":
            return Text(f"({head})") if len(head) > 1 else None
        group = self._closed(head + ":")
        self.spaced = outer
        return group

    def _capture(self, name: str | None) -> Group:
        self.names.append(name)
        place = len(self.names)
        group = self._closed("")
        group.place = place
        return group

    def _closed(self, head: str) -> Group:
        body = self.alternatives(closing=True)
        if self.peek() != ")":
            raise self.error("Not enough )'s")
        self.at += 1
        return Group(head, body)


def _written(branches: list, names: list[str | None]) -> str:
    return "|".join(_branch(branch, names) for branch in branches)


def _branch(pieces: list, names: list[str | None]) -> str:
    out = ""
    for k, piece in enumerate(pieces):
        text = _piece_written(piece, names)
        if k and isinstance(pieces[k - 1], Reference) and text[:1].isdigit():
            text = f"(?:{text[0]}){text[1:]}"  # no part of the reference's number
        out += text
    return out


def _piece_written(piece, names: list[str | None]) -> str:
    if isinstance(piece, Text):
        return piece.java
    if isinstance(piece, Class):
        return piece.java()
    if isinstance(piece, Repeat):
        return _piece_written(piece.piece, names) + piece.times
    if isinstance(piece, Group):
        return f"({piece.head}{_written(piece.body, names)})"
    places = _places(piece.to, names)
    if not places:
        raise InvalidPatternError(f"Reference to undefined group {piece.to!r}")
    return f"\\{places[-1]}"


def _places(to: str | int, names: list[str | None]) -> list[int]:
    """Places of the groups a reference means: numbers count unnamed groups, then names."""
    if isinstance(to, str):
        return [k for k, n in enumerate(names, start=1) if n == to]
    numbered = [[k] for k, n in enumerate(names, start=1) if n is None]
    numbered += [_places(n, names) for n in dict.fromkeys(n for n in names if n is not None)]
    return numbered[to - 1] if 0 < to <= len(numbered) else []


def translate(pattern: str, *, explicit_capture: bool = False, ignore_case: bool = False) -> JavaPattern:
    """Rewrite a .NET pattern into an equivalent Java pattern."""
    if pattern is None:
        raise InvalidPatternError("pattern is null")
    reader = _Reader(pattern, explicit_capture)
    tree = reader.alternatives(closing=False)
    flags = "(?iU)" if ignore_case else "(?U)"
    return JavaPattern(flags + "(?d)" + _written(tree, reader.names), tuple(reader.names))


def literal(text: str) -> str:
    """Quote text so it matches literally (the .NET ``Regex.Escape`` role)."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def validate(spark, jp: JavaPattern) -> None:
    """Compile the pattern on the driver's JVM so bad input fails at plan build."""
    try:
        jvm = spark.sparkContext._jvm if spark is not None else None
    except Exception:  # Spark Connect: no JVM handle on the client
        jvm = None
    if jvm is None:
        return
    try:
        jvm.java.util.regex.Pattern.compile(jp.pattern)
    except Exception as exc:  # py4j wraps PatternSyntaxException
        raise InvalidPatternError(str(exc).splitlines()[0]) from None


def java_regex(pattern: str, *, ignore_case: bool = False, spark=None) -> str:
    """Translate and (when a session is at hand) validate; returns the Java pattern."""
    jp = translate(pattern, ignore_case=ignore_case)
    if spark is not None:
        validate(spark, jp)
    return jp.pattern
