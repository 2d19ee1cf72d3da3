"""A bounded cache of what a word is encoded to."""

from __future__ import annotations

from collections.abc import Callable


class Memo(dict):
    """Two generations of at most `most` entries each: a full one becomes the old one, what is used again moves over."""

    def __init__(self, make: Callable[[str], object], most: int = 250_000) -> None:
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, word: str):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = value
        return value
