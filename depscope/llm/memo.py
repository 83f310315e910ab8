"""A bounded memory of results."""

from __future__ import annotations

from collections.abc import Callable


class Memo(dict):
    """Results by key, made on demand, in two generations: what was not used while one filled up is forgotten."""

    def __init__(self, make: Callable, entries: int):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key):
        if len(self) > self.entries:
            self.old = dict(self)
            self.clear()
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        self[key] = out
        return out
