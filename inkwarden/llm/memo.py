"""A bounded memory of a worker: what is met again stays, what isn't goes."""

from __future__ import annotations

from collections.abc import Callable, Hashable


class Memo(dict):
    """``memo[key]`` is ``make(key)``, remembered. At ``limit`` entries the memory becomes the older of two
    generations; a key met again returns from there, the generation before is forgotten."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: Hashable):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self.put(key, found)
        return found

    def put(self, key: Hashable, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
