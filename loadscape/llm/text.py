"""Words of UTF-8 texts, and bounded caches of what is known about a word."""

from __future__ import annotations

from collections.abc import Callable, Iterator

#: Bytes of a text that are turned into words at once.
CHUNK = 1 << 20
SPACE = b" \t\n\v\f\r"


def word_chunks(data: bytes, keep: int = 0) -> Iterator[list[bytes]]:
    """Words of a text (runs of anything but ASCII white space), a block at a time, so that long texts stay small.

    Each block after the first starts with the last ``keep`` words of the one before.
    """
    at, last = 0, []
    while at < len(data):
        end = at + CHUNK
        while end < len(data) and data[end] not in SPACE:
            end += 1
        words = last + data[at:end].split()
        if len(words) > len(last):
            yield words
        last, at = words[max(0, len(words) - keep) :], end


def plain(word: bytes) -> str:
    """The word lower-cased, without what is no letter or digit at either end."""
    w = word.decode("utf-8", "replace").lower()
    a, b = 0, len(w)
    while a < b and not w[a].isalnum():
        a += 1
    while a < b and not w[b - 1].isalnum():
        b -= 1
    return w[a:b]


class Known(dict):
    """What ``make`` says of each word, kept for at most ``most`` words of LONGEST bytes each and ``most_bytes`` in all.

    A longer word is made anew each time it comes: such words hardly repeat, and texts of them would fill the memory.
    """

    LONGEST = 100

    def __init__(self, make: Callable[[bytes], int], most: int = 300_000, most_bytes: int = 8 << 20):
        self.make, self.most, self.most_bytes, self.bytes = make, most, most_bytes, 0

    def __missing__(self, word: bytes) -> int:
        if len(word) > self.LONGEST:
            return self.make(word)
        if len(self) >= self.most or self.bytes + len(word) > self.most_bytes:
            self.clear()
            self.bytes = 0
        self[word] = out = self.make(word)
        self.bytes += len(word)
        return out
