"""Items of one Rust source text: a tokenizer that knows comments and strings, and a walk over matched brackets."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Blanks and one token; a word that begins as no text does is tried first.
_TOKEN = re.compile(
    r"""(?:\s++|//[^\n]*+)*+(?:(?P<plain>(?![bcr])[^\W\d]\w*)|(?P<comment>/\*)|(?P<raw>(?:b|c)?r(?P<fence>\#*)"(?s:.*?)"(?P=fence))|(?P<text>[bc]?"(?:\\(?s:.)|[^"\\])*")|(?P<char>b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])')
    |(?P<life>'[^\W\d]\w*)|(?P<word>(?:r\#)?[^\W\d]\w*)|(?P<number>\d\w*(?:\.\d\w*)?)|(?P<mark>::|->|=>|[^\w\s]))""",
    re.X,
)
_COMMENT = re.compile(r"/\*|\*/")
_CLOSES = {"(": ")", "[": "]", "{": "}"}
#: Words that begin an item, and what the item is called: fixed values.
_KINDS = {"fn": "function", "struct": "struct", "enum": "enum", "union": "union", "trait": "trait", "type": "type_alias", "const": "const", "static": "static", "mod": "module"}
_BEFORE_FN = frozenset(("const", "async", "unsafe", "extern", "default", "auto", "safe"))


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    end: int


@dataclass
class Item:
    kind: str
    name: str
    module: str
    visibility: str
    signature: str
    start_line: int
    end_line: int
    attributes: list[str] = field(default_factory=list)
    type_display: str | None = None
    trait_display: str | None = None
    methods: list[dict] = field(default_factory=list)
    uses: list[dict] = field(default_factory=list)
    patterns: list[str] = field(default_factory=list)


def tokens(text: str) -> list[Token]:
    """The tokens of a text without blanks and comments. What isn't closed ends with the text."""
    out, at = [], 0
    match, add = _TOKEN.match, out.append
    while (m := match(text, at)) is not None:  # else the end, or a quote that nothing closes
        kind = m.lastgroup
        start, end = m.span(kind)
        if kind == "comment":
            depth = 1
            while depth:
                c = _COMMENT.search(text, end)
                if c is None:
                    return out
                depth, end = depth + (1 if c[0] == "/*" else -1), c.end()
        else:
            add(Token("word" if kind == "plain" else kind, text[start:end], start, end))
        at = end
    return out


def _matches(found: list[Token]) -> list[int]:
    """For each opening bracket the place of the one that closes it, for all others their own; at the end if none does."""
    out, open_ones = list(range(len(found))), []
    for i, t in enumerate(found):
        if t.kind == "mark":
            if t.text in _CLOSES:
                open_ones.append(i)
            elif open_ones and t.text == _CLOSES[found[open_ones[-1]].text]:
                out[open_ones.pop()] = i
    for i in open_ones:
        out[i] = len(found) - 1
    return out


class _Walk:
    def __init__(self, text: str):
        self.text, self.found = text, tokens(text)
        self.n = len(self.found)
        self.closes = _matches(self.found)
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.items: list[Item] = []

    def line(self, at: int) -> int:
        from bisect import bisect_left

        return bisect_left(self.breaks, at) + 1

    def shown(self, first: int, last: int) -> str:
        """The text from one token to before another, comments left out, blanks squeezed."""
        parts, before = [], None
        for t in self.found[first:last]:
            if before is not None and t.start > before:
                parts.append(" ")
            parts.append(t.text)
            before = t.end
        return "".join(parts)

    def is_(self, i: int, *texts: str) -> bool:
        return i < self.n and (t := self.found[i]).text in texts and (t.kind == "mark" or t.kind == "word")

    def body(self, i: int, end: int) -> int:
        """The `{` or `;` that ends what begins at i; brackets in between are passed over."""
        while i < end and not self.is_(i, "{", ";"):
            i = self.closes[i] + 1
        return min(i, end - 1)

    def walk(self, i: int, end: int, module: str, methods: list[dict] | None = None) -> None:
        """Read the items between two places; methods: where the functions of an implementation or a trait go."""
        while i < end:
            attributes = []
            while self.is_(i, "#") and (self.is_(i + 1, "[") or self.is_(i + 1, "!") and self.is_(i + 2, "[")):
                opening = i + 1 if self.is_(i + 1, "[") else i + 2
                if opening == i + 1:
                    attributes.append(self.shown(opening + 1, self.closes[opening]))
                i = self.closes[opening] + 1
            first, visibility = i, "private"
            if self.is_(i, "pub"):
                visibility, i = "public", i + 1
                if self.is_(i, "("):
                    visibility, i = f"pub({self.shown(i + 1, self.closes[i])})", self.closes[i] + 1
            while i < end and (self.is_(i, *_BEFORE_FN) and not (self.is_(i, "const", "static") and not self.is_(i + 1, "fn", *_BEFORE_FN)) or self.found[i].kind == "text"):
                i += 1
            if i >= end:
                return
            word = self.found[i].text if self.found[i].kind == "word" else ""
            if word == "union" and not (i + 1 < end and self.found[i + 1].kind == "word"):
                word = ""
            if word == "use":
                last = i
                while last < end - 1 and not self.is_(last, ";"):
                    last = self.closes[last] + 1
                last = min(last, end - 1)
                self.add(Item("use", "", module, visibility, self.shown(first, last), 0, 0, attributes, uses=use_tree([t.text for t in self.found[i + 1 : last]])), first, last)
            elif word == "impl":
                last = self.body(i, end)
                self.add(self.implementation(i, last, module, visibility, first, attributes), first, self.closes[last])
                last = self.closes[last]
            elif word == "macro_rules" and self.is_(i + 1, "!") and i + 3 < end:
                last = self.closes[i + 3]
                self.add(Item("macro", self.found[i + 2].text, module, "public" if "macro_export" in attributes else visibility, self.shown(first, i + 3), 0, 0, attributes), first, last)
            elif word in _KINDS and i + 1 < end:
                last = self.item(word, i, end, module, visibility, first, attributes, methods)
            elif self.is_(i, "{") and any(t.text == "extern" for t in self.found[first:i]):
                self.walk(i + 1, self.closes[i], module)
                last = self.closes[i]
            else:  # a macro call, an extern crate, or what no item begins with
                last = i
                while last < end and not self.is_(last, ";", "{"):
                    last = self.closes[last] + 1 if self.is_(last, "(", "[") else last + 1
                last = self.closes[last] if last < end else end
            i = last + 1

    def add(self, item: Item, first: int, last: int) -> None:
        last = min(last, len(self.found) - 1)
        item.start_line, item.end_line = self.line(self.found[first].start), self.line(self.found[last].end - 1)
        self.items.append(item)

    def item(self, word: str, i: int, end: int, module: str, visibility: str, first: int, attributes: list[str], methods: list[dict] | None) -> int:
        at = i + 1
        while self.is_(at, "mut"):
            at += 1
        name = self.found[at].text.removeprefix("r#") if at < end else ""
        last = self.body(at, end)
        if word in ("const", "static", "type"):  # their values may hold braces
            while last < end - 1 and self.is_(last, "{"):
                last = self.body(self.closes[last] + 1, end)
        signature, closing = self.shown(first, last), self.closes[last]
        if methods is not None:
            if word == "fn":
                methods.append({"name": name, "signature": signature, "line": self.line(self.found[first].start), "has_body": self.is_(last, "{")})
            return closing
        own = Item(_KINDS[word], name, module, visibility, signature, 0, 0, attributes)
        if word in ("enum", "struct"):  # messages in attributes of the type or of its variants
            own.patterns = [m for a in attributes if (m := message(a)) is not None]
            for k in range(last, closing):
                if self.is_(k, "#") and self.is_(k + 1, "[") and (m := message(self.shown(k + 2, self.closes[k + 1]))) is not None:
                    own.patterns.append(m)
        if word == "struct" and self.is_(last, "{") is False and self.is_(last, ";") is False:
            closing = last
        self.add(own, first, closing)
        if word == "mod" and self.is_(last, "{"):
            self.walk(last + 1, closing, f"{module}::{name}")
        elif word == "trait" and self.is_(last, "{"):
            self.walk(last + 1, closing, module, own.methods)
        return closing

    def implementation(self, i: int, last: int, module: str, visibility: str, first: int, attributes: list[str]) -> Item:
        """What stands between `impl` and its body: parameters, maybe a trait and `for`, the type, maybe conditions."""
        at, depth, cut, until = i + 1, 0, None, last
        if self.is_(at, "<"):
            while at < last:
                depth += self.is_(at, "<") - self.is_(at, ">")
                at += 1
                if not depth:
                    break
        begun = at
        while at < last:
            depth += self.is_(at, "<") - self.is_(at, ">")
            if not depth and self.is_(at, "for") and not self.is_(at + 1, "<"):
                cut = at
            if not depth and self.is_(at, "where"):
                until = at
                break
            at = self.closes[at] + 1
        made = Item("impl", "", module, visibility, self.shown(first, last), 0, 0, attributes)
        made.type_display = self.shown(begun if cut is None else cut + 1, until)
        made.trait_display = None if cut is None else self.shown(begun, cut)
        made.name = last_name(made.type_display)
        if self.is_(last, "{"):
            made.patterns = self.patterns(last + 1, self.closes[last])
            self.walk(last + 1, self.closes[last], module, made.methods)
        return made

    def patterns(self, i: int, end: int) -> list[str]:
        """The texts that code between two places writes: first ones of write! and writeln!, and those of write_str."""
        out = []
        for k in range(i, end):
            opening = k + 2 if self.is_(k, "write", "writeln") and self.is_(k + 1, "!") else k + 1 if self.is_(k, "write_str") else end
            if opening < end and self.is_(opening, "(", "[", "{"):
                first = next((t for t in self.found[opening + 1 : self.closes[opening]] if t.kind in ("text", "raw")), None)
                if first is not None:
                    out.append(literal(first.text))
        return out


def literal(text: str) -> str:
    """What a string token stands for, its plain escapes read."""
    raw = re.fullmatch(r"[bc]?r(#*)\"(.*)\"\1", text, re.S)
    if raw:
        return raw[2]
    inner = text[text.index('"') + 1 : -1]
    inner = re.sub(r"\\\n\s*", "", inner)
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}.get(m[1], m[1]), inner, flags=re.S)


def message(attribute: str) -> str | None:
    """The text of an error("...") attribute."""
    found = re.match(r'(?:\w+\s*::\s*)*(?:error|display)\s*\(\s*((?:r#*)?".*)', attribute, re.S)
    token = _TOKEN.match(found[1]) if found else None
    return literal(token[0]) if token and (token["text"] or token["raw"]) else None


def last_name(path: str) -> str:
    """The name that a written type or trait is looked up by: references and arguments aside, the last part of its path."""
    bare = re.sub(r"^(?:!|&|\s|'\w+\s|mut\s|dyn\s|impl\s)+", "", path)
    return re.sub(r"[<(\[\s].*$", "", bare, flags=re.S).rpartition("::")[2]


def use_tree(words: list[str]) -> list[dict]:
    """The leaves of a use declaration: what each leads to, and the name that it gives it; None for all names of a module."""
    out, prefix, stack, path = [], [], [], []

    def leaf() -> None:
        nonlocal path
        if not path:
            return
        name = path[-1]
        whole = [*prefix, *path[: path.index("as") if "as" in path else None]]
        if "as" in path:
            name = path[path.index("as") + 1] if path.index("as") + 1 < len(path) else "_"
        is_glob = whole[-1] == "*"
        if whole[-1] in ("*", "self") and len(whole) > 1:
            whole = whole[:-1]
            name = whole[-1] if name == "self" else name
        out.append({"path": "::".join(whole), "name": None if is_glob else name})
        path = []

    for w in words:
        if w == "{":
            stack.append(len(prefix))
            prefix += path
            path = []
        elif w in (",", "}"):
            leaf()
            if w == "}" and stack:
                del prefix[stack.pop() :]
        elif w != "::":
            path.append(w)
    leaf()
    return out


def items(text: str, module: str = "crate") -> list[Item]:
    """Items at the top of a text and in modules within, in order; methods stand with their implementation or trait."""
    walk = _Walk(text)
    walk.walk(0, len(walk.found), module)
    return walk.items
