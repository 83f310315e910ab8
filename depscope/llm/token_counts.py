"""Token counts of every prefix, by dynamic programming over prefixes.

For byte-pair encoding, the tokens of a prefix without its last one are the tokens of a shorter prefix, and a token
may follow another if encoding just the two gives them back. So the state of a prefix of a pre-token, its last token
and its count inside a longer word and its count as a whole word, is found from the states of shorter prefixes. A word
ends with the model's end-of-word form of its last token.

Pre-tokens do not depend on each other, so the count of a prefix of the text is the sum over the pre-tokens before,
plus the state of the one that the prefix ends in. Counts after every character are kept for each distinct part of a
text (PartTable) and laid out for whole texts: budgets and truncation are answered from these numbers alone.

Parts of printable Latin-1 are cut by the pre-tokenizer's expression. In other parts each character's class, and what
the normalizer makes of a character and the marks that it takes up, are asked of the library, once for each character;
states are extended and taken back character by character. Strings of added tokens count one when complete.

States are kept by place in the word, so memory is linear in the longest word. Short words get theirs many at a time,
place by place: substrings are looked up in the vocabulary by 64 bits of hash and held against its bytes.
Defined cases: a null text is empty and has no tokens; rows are treated one by one; an empty table gives an empty
result; a character with n combining marks costs n steps while these are of one class, and n for each place where a
mark of another class comes in; a text of any length is one row; an input column with the name of a new one, in any
case, is replaced.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesops as B
from .byte_letters import byte_letters
from .memo import Memo
from .part_table import KeyTable, PartTable
from .rows import with_arrow_columns

CACHE_ENTRIES = 200_000
LIMIT = 2048
#: Words of up to so many bytes get their states together, place by place.
_TOGETHER = 32


@cache
def _second_characters() -> frozenset[str]:
    """Characters that the one before may take up when composed."""
    found = {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    for c in range(0x110000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and parts[0][0] != "<":
            found.add(chr(int(parts[1], 16)))
    return frozenset(found)


def _joins(c: str) -> bool:
    return c > "\u02ff" and (unicodedata.combining(c) > 0 or c in _second_characters())


class _Run:
    """The states of a pre-token that may go on."""

    __slots__ = ("kind", "tail", "last", "count", "end", "text")

    def __init__(self, kind: str):
        self.kind, self.tail, self.last, self.count, self.end, self.text = kind, "", [""], [0], [0], ""

    def cut(self, n: int, tail: str, text: str) -> None:
        del self.last[n:], self.count[n:], self.end[n:]
        self.tail, self.text = tail, text


class PrefixCounter:
    _LETTER, _NUMBER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
    _cut = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+|\n").findall
    _plain = re.compile("[\x21-\x7e\xa1-\xff]*").fullmatch

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        whole = json.loads(self.library.to_str())
        model = whole["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(pairs)}
        self.suffix = model["end_of_word_suffix"] or ""
        #: 1: may stand inside a word; 2: may end one.
        self.kinds: dict[str, int] = {}
        for t in model["vocab"]:
            bare, kind = (t[: -len(self.suffix)], 2) if self.suffix and t.endswith(self.suffix) else (t, 1 if self.suffix else 3)
            self.kinds[bare] = self.kinds.get(bare, 0) | kind
        self.longest = max(map(len, self.kinds))
        self.added = re.compile("|".join(re.escape(x["content"]) for x in whole["added_tokens"]) or "x^")
        self.added_bytes = re.compile(self.added.pattern.encode()).finditer
        self.letters = byte_letters()
        self.follows: dict[tuple[str, str, bool], bool] = {}
        self.words = Memo(self._word, CACHE_ENTRIES)
        self.class_of = Memo(self._class, CACHE_ENTRIES)
        self.normal = Memo(self.library.normalizer.normalize_str, CACHE_ENTRIES)
        self.composes = Memo(lambda k: len(k) < 2 or self.library.normalizer.normalize_str(k) != self.normal[k[0]] + self.normal[k[1:]], CACHE_ENTRIES)
        self.parts = PartTable(self._make, np.int32)
        self._vocabulary()
        # a contraction that is not complete is an apostrophe and a letter
        self.open_contraction = {"'" + c: self._word("'")[0] + self._word(c[0])[0] for c in ("re", "ve", "ll")}

    def _may_follow(self, a: str, b: str, last: bool) -> bool:
        """Whether encoding a then b (the end of a word if last) gives just these two tokens."""
        want = [a, b + self.suffix if last else b] if a else [b + self.suffix if last else b]
        symbols = list(a + b)
        if last:
            symbols[-1] += self.suffix
        while len(symbols) > 1:
            rank, i = min((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == 1 << 60:
                break
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols == want

    def _state(self, tail: str, last: list[str], count: list[int], k: int) -> tuple[str, int, int]:
        """(last token, count, count as a whole word) of the first k letters of a word, which end as tail does."""
        token_in, n_in, n_end = "", -1, -1
        for size in range(min(k, self.longest), 0, -1):
            token = tail[-size:]
            kind = self.kinds.get(token)
            if kind is None:
                continue
            before = last[k - size]
            for want, is_last in ((1, False), (2, True)):
                if kind & want and (n_end if is_last else n_in) < 0:
                    key = (before, token, is_last)
                    ok = self.follows.get(key)
                    if ok is None:
                        ok = self.follows[key] = self._may_follow(before, token, is_last)
                    if ok and is_last:
                        n_end = count[k - size] + 1
                    elif ok:
                        token_in, n_in = token, count[k - size] + 1
            if n_in >= 0 and n_end >= 0:
                return token_in, n_in, n_end
        raise ValueError(f"no token ends {tail!r}")

    def _word(self, letters: str) -> list[int]:
        """Counts of each prefix of a pre-token in byte letters, as a whole word."""
        last, count, end = [""], [0], []
        for k in range(1, len(letters) + 1):
            state = self._state(letters[max(0, k - self.longest) : k], last, count, k)
            last.append(state[0])
            count.append(state[1])
            end.append(state[2])
        return end

    def _ends(self, word: str) -> list[int]:
        """Counts of each prefix of a normalised pre-token, by bytes."""
        letters = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
        return self.words[letters] if len(letters) <= _TOGETHER else self._word(letters)

    def _vocabulary(self) -> None:
        """The tokens' bytes, for look-ups of many substrings; token 0 is the beginning of a word."""
        byte = {letter: b for b, letter in enumerate(self.letters)}
        self.token = ["", *self.kinds]
        raw = [bytes([byte[c] for c in t]) for t in self.token]
        self.token_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.token_first = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        self.token_kind = np.array([0, *self.kinds.values()])
        keys = B.span_hash(B.prefix_hash(self.token_bytes), self.token_first[1:-1], self.token_first[2:])
        assert len(np.unique(keys)) == len(keys)
        self.by_hash = KeyTable()
        self.by_hash.add(keys, np.arange(1, len(self.token)))
        #: Whether a token may follow another: (token before, token, whether it ends the word).
        self.pairs = KeyTable()

    def _pairs_ok(self, before: np.ndarray, token: np.ndarray, last: int) -> np.ndarray:
        keys = ((before << 32) | (token << 1) | last).astype(np.uint64)
        ok, found = self.pairs.find(keys)
        if not found.all():
            new = np.unique(keys[~found])
            ok = np.array([self._may_follow(self.token[k >> 32], self.token[(k & 0xFFFFFFFF) >> 1], bool(last)) for k in new.tolist()], np.int64)
            self.pairs.add(new, ok)
            ok, _ = self.pairs.find(keys)
        return ok > 0

    def _ends_together(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Counts of each prefix of many pre-tokens, as whole words: one number for each of their bytes."""
        if not len(data):
            return np.empty(0, np.int64)
        size = np.diff(first)
        word = B.row_of(first)
        place = np.arange(len(data)) - first[:-1][word]
        # substrings that are tokens: where they begin, how long they are, and which
        sums = B.prefix_hash(data)
        begins, ends, tokens = [], [], []
        for n in range(1, min(self.longest, int(size.max())) + 1):
            at = np.flatnonzero(place + n <= size[word])
            token, found = self.by_hash.find(B.span_hash(sums, at, at + n))
            at, token = at[found], token[found]
            same = self.token_first[token + 1] - self.token_first[token] == n
            at, token = at[same], token[same]
            for j in range(n):
                same = self.token_bytes[self.token_first[token] + j] == data[at + j]
                at, token = at[same], token[same]
            begins.append(at)
            ends.append(at + n)
            tokens.append(token)
        begin, end, token = np.concatenate(begins), np.concatenate(ends), np.concatenate(tokens)
        # in the order of the place where they end, longer ones last, so that they decide
        order = np.argsort(place[end - 1], kind="stable")
        begin, end, token = begin[order], end[order], token[order]
        cut = np.searchsorted(place[end - 1], np.arange(int(size.max()) + 1))
        # behind each byte: last token and count inside a longer word, and count of the word that ends there
        out = np.full(len(data), -1, np.int64)
        kept_last, kept_count = np.zeros(len(data), np.int64), np.full(len(data), -1, np.int64)
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            s, e, t = begin[a:b], end[a:b], token[a:b]
            inner = place[s] > 0
            before, so_far = np.where(inner, kept_last[s - 1], 0), np.where(inner, kept_count[s - 1], 0)
            for kind in (1, 2):
                use = np.flatnonzero(self.token_kind[t] & kind)
                use = use[self._pairs_ok(before[use], t[use], kind - 1)]
                if kind == 1:
                    kept_last[e[use] - 1], kept_count[e[use] - 1] = t[use], so_far[use] + 1
                else:
                    out[e[use] - 1] = so_far[use] + 1
        if (out < 0).any():
            raise ValueError("no token ends some word")
        return out

    def _class(self, c: str) -> str:
        """Letter, symbol, number or white, as the library's pre-tokenizer takes a character."""
        cut = lambda text: len(self.library.pre_tokenizer.pre_tokenize_str(text))
        return "W" if not cut(c) else "L" if cut(f"a{c}") == 1 else "S" if cut(f"!{c}") == 1 else "N"

    def _push(self, closed: int, run: _Run | None, c: str) -> tuple[int, _Run | None]:
        """The state after one more normalised character."""
        kind = self.class_of[c]
        if run and run.text == "'" and kind == "L" and c in "stmd":
            return closed + self._ends("'" + c)[-1], None
        if run and run.kind == "A" and run.text + c in ("re", "ve", "ll"):
            return closed - self._ends("'")[-1] + self._ends("'" + run.text + c)[-1], None
        lone = run is not None and run.text == "'"
        if run and (kind != ("L" if run.kind == "A" else run.kind) or kind == "N"):
            closed, run = closed + run.end[-1], None
        if kind == "W":
            return closed, None
        if run is None:
            # A: letters right behind an apostrophe that stands alone
            run = _Run("A" if lone and kind == "L" else kind)
        for letter in c if c in self.kinds and c.isascii() else [self.letters[b] for b in c.encode()]:
            run.tail = (run.tail + letter)[-self.longest :]
            state = self._state(run.tail, run.last, run.count, len(run.last))
            run.last.append(state[0])
            run.count.append(state[1])
            run.end.append(state[2])
        run.text = (run.text + c)[:3]
        return closed, run

    def _scan(self, text: str) -> list[int]:
        """Counts of each prefix of a text without added tokens, by characters."""
        out: list[int] = []
        state: tuple[int, _Run | None] = (0, None)
        before, saved, cluster, shown = state, (0, "", ""), "", ""
        for c in text:
            rank = unicodedata.combining(c)
            if cluster and _joins(c) and (rank or self.composes[shown[-1:] + c]):
                cluster += c
                if rank and all(unicodedata.combining(x) == rank for x in shown[-1:] + self.normal[c]):
                    # behind a mark of its own class a mark takes the last place and composes with nothing
                    more = self.normal[c]
                else:
                    if before[1]:
                        before[1].cut(*saved)
                    state, shown = before, ""
                    more = self.normal[cluster] if len(cluster) < 4 else self.library.normalizer.normalize_str(cluster)
            else:
                cluster, before, shown = c, state, ""
                saved = (len(state[1].last), state[1].tail, state[1].text) if state[1] else saved
                more = self.normal[c]
            shown += more
            for x in more:
                state = self._push(*state, x)
            out.append(state[0] + (state[1].end[-1] if state[1] else 0))
        return out

    def _odd_part(self, part: str) -> list[int]:
        out, base, start = [], 0, 0
        for m in self.added.finditer(part):
            counts = self._scan(part[start : m.end() - 1])
            out += [base + n for n in counts]
            base += (counts[m.start() - start - 1] if m.start() > start else 0) + 1
            out.append(base)
            start = m.end()
        return out + [base + n for n in self._scan(part[start:])]

    def _plain_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """_make() for parts of printable Latin-1 without added tokens; lower-casing keeps their places."""
        found = self._cut("\n".join(parts).lower() + "\n")
        number: dict[str, int] = {}
        which = np.array([number.setdefault(w, len(number)) for w in found], np.int64)
        words = [w.encode() for w in number]
        size = np.fromiter(map(len, words), np.int64, len(words))
        first = np.concatenate([[0], np.cumsum(size)])
        counts = np.zeros(first[-1], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        long = np.flatnonzero(size > _TOGETHER)
        for i in long:
            counts[first[i] : first[i + 1]] = self._word("".join([self.letters[b] for b in words[i]]))
        short = np.repeat((size <= _TOGETHER) & (data[first[:-1]] != 10), size)
        kept = np.concatenate([[0], np.cumsum(size[(size <= _TOGETHER) & (data[first[:-1]] != 10)])])
        counts[short] = self._ends_together(data[short], kept)
        for w, n in self.open_contraction.items():
            if w in number:
                counts[first[number[w]] + 1] = n
        # line breaks part the parts and count nothing
        values, ends = B.ragged_take(counts, first, which)
        each = np.where(size[which] > 0, counts[first[which + 1] - 1], 0)
        is_break = which == number["\n"]
        total = np.cumsum(each) - each
        part_of = np.cumsum(is_break) - is_break
        start = np.append(0, np.flatnonzero(is_break)[:-1] + 1)
        values = values + np.repeat(total - total[start][part_of], np.diff(ends))
        inside = np.repeat(~is_break, np.diff(ends))
        return values[inside], np.bincount(part_of[~is_break], np.diff(ends)[~is_break], minlength=len(parts)).astype(np.int64)

    def _make(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Counts after each byte of many parts; only those where a character ends mean something."""
        if len(self.follows) > 4 * CACHE_ENTRIES:
            self.follows.clear()
        if self.pairs.n > 16 * CACHE_ENTRIES:
            self.pairs = KeyTable()
        texts = [p.decode() for p in parts]
        plain = [bool(self._plain(t)) and not self.added.search(t) for t in texts]
        values, count = self._plain_parts([t for t, ok in zip(texts, plain, strict=True) if ok]) if any(plain) else (np.empty(0, np.int64), np.empty(0, np.int64))
        if all(plain):
            return values.astype(np.int32), count
        found = iter(np.split(values, np.cumsum(count)[:-1]))
        out = []
        for raw, text, ok in zip(parts, texts, plain, strict=True):
            if ok:
                out.append(next(found))
                continue
            counts = np.array(self._odd_part(text), np.int64)
            lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
            out.append(counts[np.cumsum(lead) - 1])
        return np.concatenate(out).astype(np.int32), np.fromiter(map(len, out), np.int64, len(out))

    def table(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, totals): tokens of every prefix of every text, after each of its bytes, and of whole texts."""
        inside = B.NOT_SPACE[data]
        begins = np.zeros(len(data), bool)
        kind = _KIND[data]
        begins[1:] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0) | inside[1:] & ~inside[:-1]
        begins[off[:-1][np.diff(off) > 0]] = True
        begins &= inside
        for m in self.added_bytes(data.tobytes()):
            begins[m.start() + 1 : m.end()] = False
        starts = np.flatnonzero(begins)
        # a part ends where the next one begins, at white space or at the text's end
        stop = np.append(~inside, True)
        stop[off[1:]] = True
        stop[starts] = True
        at = np.flatnonzero(stop)
        ends = at[np.searchsorted(at, starts, side="right")]
        inner, first = self.parts.lists(data, starts, ends)
        each = inner[first[1:] - 1].astype(np.int64)
        before = np.cumsum(each) - each
        grown = np.zeros(len(data) + 1, np.int64)
        grown[ends] = each
        counts = np.cumsum(grown)[: len(data)]
        where = np.arange(len(inner)) + np.repeat(starts - first[:-1], np.diff(first))
        counts[where] = inner + np.repeat(before, np.diff(first))
        # counts run on over texts: each text starts from what came before it
        own = np.append(0, counts)[off]
        return (counts - np.repeat(own[:-1], np.diff(off))).astype(np.int32), np.diff(own)


#: ASCII letters (1) and ASCII punctuation (2) but "'": a pre-token ends between the two.
_KIND = np.zeros(256, np.int8)
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'"]] = 2
_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def tokens_of_prefix(prefix_counts: np.ndarray, n: int) -> int:
    """Tokens of the first n characters of a text, from its counts after every character."""
    return int(prefix_counts[n - 1]) if n else 0


def longest_prefix(prefix_counts: np.ndarray, budget: int) -> int:
    """The length of the longest prefix of at most `budget` tokens, from a text's counts."""
    fit = np.flatnonzero(prefix_counts <= budget)
    return int(fit[-1]) + 1 if len(fit) else 0


FIELDS = [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_tokens", "n_parts", "fit_bytes")]
EVERY = T.StructField("prefix_counts", T.ArrayType(T.IntegerType(), False))


def prefix_tables(docs: DataFrame, tokenizer: str, budget: int = LIMIT, text: str = "text", keep: list[str] | None = None, every: bool = True) -> DataFrame:
    """docs with each text's bytes, tokens, parts between white space, and the bytes of its longest prefix, in whole
    characters, within the budget. every: also with prefix_counts, the tokens of the prefix up to each character."""

    def run(texts: pa.Array) -> list[pa.Array]:
        data, off = B.text_bytes(texts)
        counts, tokens = counter(tokenizer).table(data, off)
        n_parts = np.diff(B.word_spans(data, off)[2])
        ends = np.ones(len(data), bool)
        ends[:-1] = (data[1:] & 0xC0) != 0x80
        fit = np.diff(off)
        for i in np.flatnonzero(tokens > budget):
            s = slice(off[i], off[i + 1])
            ok = np.flatnonzero((counts[s] <= budget) & ends[s])
            fit[i] = ok[-1] + 1 if len(ok) else 0
        made = [pa.array(np.diff(off)), pa.array(tokens), pa.array(n_parts), pa.array(fit)]
        if every:
            made.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(ends))[off], pa.int32()), pa.array(counts[ends])))
        return made

    return with_arrow_columns(docs, text, [*FIELDS, EVERY] if every else FIELDS, run, keep)


def op5_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = prefix_tables(docs, tokenizer, keep=["doc_id"], every=False)
    return made.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "fit_bytes", "n_parts")
