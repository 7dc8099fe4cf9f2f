"""Words of texts, as leakage and subjects see them."""

from __future__ import annotations

import re
from functools import cache

import numpy as np

TAG = re.compile(r"<[^<>]*>")
#: Soft hyphens, zero-width spaces and the like, which don't count.
UNSEEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
WORD = re.compile(r"[^\W_]+")
LETTERS = re.compile(r"[^\W\d_]+")
LINE_END = re.compile("[\r\n\f\u2028\u2029]+")
#: Passages stand between line ends.
PASSAGE = re.compile(rf"\s*{LINE_END.pattern}\s*")
#: What a character is to ``passage_hashes``, if not of no account.
IN_WORD, ENDS_LINE = 1, 2
#: Words hashed at a time.
AT_ONCE = 1 << 15


def plain(text: str | None) -> str:
    """Text without tags and unseen characters, in lower case."""
    text = text or ""
    if "<" in text:
        text = TAG.sub("", text)
    if not text.isascii():
        for c in UNSEEN:  # each is a fast search; ``translate`` would look up every character
            text = text.replace(c, "")
    return text.lower()


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, in lower case; tags in angle brackets are dropped."""
    return WORD.findall(plain(text))


def passages(text: str | None) -> list[list[str]]:
    """The words (letters only) of each passage that has any."""
    return [found for part in PASSAGE.split(plain(text)) if (found := LETTERS.findall(part))]


@cache
def _kinds() -> np.ndarray:
    """The kind of every character, by the patterns above."""
    every = np.arange(0x110000, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
    kinds = np.zeros(len(every), np.uint8)
    for pattern, kind in ((LETTERS, IN_WORD), (LINE_END, ENDS_LINE)):
        for m in pattern.finditer(every):
            kinds[m.start() : m.end()] = kind
    return kinds


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers, spread over all bits; in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def _hashed(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of words that follow each other in ``codes``: sums over their characters, mixed with their places."""
    first = np.cumsum(sizes) - sizes
    salts = _mixed(np.arange(1, sizes.max() + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = codes.astype(np.uint64)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x += salts[np.arange(len(x)) - np.repeat(first, sizes)]
    return np.add.reduceat(_mixed(x), first)


def passage_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the words, words of each passage, passages of each text): what ``passages`` finds, without making the words."""
    lines = [plain(t) for t in texts]
    codes = np.frombuffer("\n".join([*lines, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = _kinds()[codes]
    letter = kinds == IN_WORD
    edges = np.flatnonzero(np.diff(letter, prepend=False))
    begin, end = edges[::2], edges[1::2]  # the text ends with a line end
    hashes = np.empty(len(begin), np.uint64)
    for at in range(0, len(begin), AT_ONCE):
        b, e = begin[at : at + AT_ONCE], end[at : at + AT_ONCE]
        hashes[at : at + AT_ONCE] = _hashed(codes[b[0] : e[-1]][letter[b[0] : e[-1]]], e - b)
    breaks = np.flatnonzero(kinds == ENDS_LINE)
    sizes = np.diff(np.searchsorted(begin, breaks), prepend=0)
    last = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)) + 1) - 1
    owner = np.searchsorted(last, breaks[sizes > 0])
    return hashes, sizes[sizes > 0], np.bincount(owner, minlength=len(lines))
