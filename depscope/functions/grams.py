"""What a text must hold for a regular expression to match it: three-character substrings that its literals have."""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser as P

#: Alternatives that are multiplied out.
MOST = 16
#: Escapes that mean the same to Python, which reads the expression here, and to Java, which matches it.
_SAFE_ESCAPES = re.compile(r"\\[dDwWsSbBnrt.\\/()\[\]{}+*?^$|\-]")
#: A conjunction: of each member at least one alternative must hold, a set of substrings that all occur.
Needs = list[list[frozenset[str]]]


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _plain(text: str) -> str | None:
    """The text in lower case; None if a character's lower case depends on its neighbours or on who computes it."""
    low = text.lower()
    if len(low) != len(text) or any(not c.isascii() and (c.lower() != c or c in "ςσ") for c in low):
        return None
    return low


def of_text(text: str) -> Needs:
    """For a fixed text, in any case."""
    runs: list[str] = [""]
    for c in text:
        low = _plain(c)
        if low is None or c in "Σσς":
            runs.append("")
        else:
            runs[-1] += low
    return [[_grams(r)] for r in runs if len(r) > 2]


class _Reader:
    """Walks through a parsed expression with the literal texts that may end where it stands."""

    def __init__(self) -> None:
        self.needs: Needs = []
        self.ends: list[str] = [""]

    def cut(self) -> None:
        """Whatever comes next needn't follow directly."""
        if all(len(x) > 2 for x in self.ends):
            self.needs.append([_grams(x) for x in self.ends])
        self.ends = [""]

    def add(self, texts: list[str]) -> None:
        if len(self.ends) * len(texts) > MOST:
            self.cut()
        if len(texts) > MOST:
            self.cut()
            return
        self.ends = list(dict.fromkeys(a + b for a in self.ends for b in texts))

    def walk(self, parts) -> None:
        for kind, value in parts:
            texts = _exact(kind, value)
            if texts is not None:
                self.add(texts)
            elif kind in (C.AT, C.ASSERT, C.ASSERT_NOT):
                continue  # of no length
            elif kind is C.SUBPATTERN:
                self.walk(value[-1])
            elif kind is C.ATOMIC_GROUP:
                self.walk(value)
            elif kind in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0]:
                once = _exact(C.SUBPATTERN, (None, 0, 0, value[2]))
                if once is not None:  # the first occurrence follows what stands before, the last one precedes what comes
                    self.add(once)
                    self.cut()
                    self.add(once)
                else:
                    self.cut()
                    self.walk(value[2])
                    self.cut()
            elif kind is C.BRANCH:
                self.cut()
                self.needs += _either(value[1])
            else:
                self.cut()


def _either(branches) -> Needs:
    """One member: of each branch the alternatives of its most demanding need; nothing if a branch needs nothing."""
    out: list[frozenset[str]] = []
    for b in branches:
        needs = _needs(b)
        if not needs:
            return []
        out += max(needs, key=lambda n: min(map(len, n)))
    return [out] if len(out) <= MOST else []


def _exact(kind, value) -> list[str] | None:
    """All texts that a part matches, in lower case, if these are few."""
    if kind is C.LITERAL:
        low = _plain(chr(value))
        return None if low is None else [low]
    if kind is C.IN:
        if any(k not in (C.LITERAL, C.RANGE) for k, _ in value):
            return None
        codes = [c for k, v in value for c in ([v] if k is C.LITERAL else range(v[0], min(v[1] + 1, v[0] + MOST + 1)))]
        texts = [_plain(chr(c)) for c in codes]
        return None if len(texts) > MOST or None in texts else list(dict.fromkeys(texts))
    if kind in (C.SUBPATTERN, C.ATOMIC_GROUP):
        out = [""]
        for k, v in value[-1] if kind is C.SUBPATTERN else value:
            texts = _exact(k, v)
            if texts is None or len(out) * len(texts) > MOST:
                return None
            out = [a + b for a in out for b in texts]
        return list(dict.fromkeys(out))
    if kind is C.BRANCH:
        parts = [_exact(C.SUBPATTERN, (None, 0, 0, b)) for b in value[1]]
        if any(p is None for p in parts) or sum(map(len, parts)) > MOST:
            return None
        return list(dict.fromkeys(t for p in parts for t in p))
    if kind in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        least, most, part = value
        if most == 1:
            texts = _exact(C.SUBPATTERN, (None, 0, 0, part))
            return None if texts is None else list(dict.fromkeys([*([""] if not least else []), *texts]))
    return None


def _needs(parts) -> Needs:
    reader = _Reader()
    reader.walk(parts)
    reader.cut()
    return reader.needs


def of_expression(pattern: str) -> Needs:
    """For a regular expression in any case; nothing where the two dialects of expressions may differ."""
    rest = _SAFE_ESCAPES.sub("", pattern)
    if "\\" in rest or "&&" in rest or re.search(r"\[[^\]]*\[", rest) or "(?" in rest.replace("(?:", "").replace("(?i)", ""):
        return []
    try:
        parsed = P.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return []
    return _needs(parsed)


def code(gram: str) -> int:
    """Three characters as one number."""
    a, b, c = map(ord, gram)
    return a << 42 | b << 21 | c
