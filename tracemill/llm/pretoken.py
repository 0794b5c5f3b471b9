"""The pre-tokenizer of the public byte-level BPE vocabularies, over arrays of code points.

The pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` cuts a text at changes
between letters, numbers, white space and other characters; what else it does is stated at each step of ``cut``.
"""

from functools import lru_cache

import numpy as np
import regex

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every code point, read off the same Unicode properties that the pattern names."""
    points = np.full(0x110000, OTHER, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            for a, b in ((m.start(), min(m.end(), 0xD800)), (max(m.start(), 0xD800), m.end())):
                if a < b:
                    points[a + (0x800 if a >= 0xD800 else 0) : b + (0x800 if a >= 0xD800 else 0)] = kind
    return points


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number, and of its inverse, modulo 2^64."""
    base, inverse = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)])) for x in (base, inverse))


def points_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts on end, and where each text begins, with the end."""
    whole = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    return whole, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def cut(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of texts on end begin, in order; bounds are the texts' begins and the end."""
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = _classes()[points]
    edge = np.ones(n + 1, dtype=bool)  # a text or a run of one class begins here
    edge[1:n] = kind[1:] != kind[:-1]
    edge[bounds] = True
    first = np.zeros(n + 1, dtype=bool)
    first[bounds] = True
    begins = np.nonzero(edge[:-1])[0]
    ends = np.append(begins[1:], n)
    mark = edge[:-1].copy()
    # of white space before something else in the text, the last character stands apart; a blank joins what follows
    blank = (kind[begins] == SPACE) & ~first[ends]
    last = ends[blank] - 1
    mark[last] = True
    joined = last[points[last] == 32]
    mark[joined + 1] = False
    # an apostrophe that no blank precedes, before s t m d re ve ll: one token, and the letters after it another
    one = begins[(kind[begins] == OTHER) & (ends - begins == 1) & (points[begins] == 39) & mark[begins] & ~first[ends]]
    if len(one):
        a = points[one + 1]
        far = one + 2 < n
        b = np.where(far & ~first[np.minimum(one + 2, n)], points[np.minimum(one + 2, n - 1)], 0)
        short = np.isin(a, [ord(c) for c in "stmd"])
        long = (a == 114) & (b == 101) | (a == 118) & (b == 101) | (a == 108) & (b == 108)
        for at, width in ((one[short], 1), (one[long], 2)):
            mark[at + 1] = False
            after = at + 1 + width
            mark[after[after < n]] = True
    return np.nonzero(mark)[0]


def keys(points: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit key of each span of code points, by its characters and length. Spans of one key may differ."""
    size = 1 << max(16, int(len(points)).bit_length())
    powers, inverse = _powers(size)
    with np.errstate(over="ignore"):
        mixed = (points.astype(np.uint64) + np.uint64(1)) * _MIX
        mixed ^= mixed >> np.uint64(29)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * powers[: len(points)])])
        out = (sums[ends] - sums[begins]) * inverse[begins]
        out ^= out >> np.uint64(32)
        return out * _MIX + (ends - begins).astype(np.uint64)


def gathered(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of all items of spans, one span after the other."""
    stop = np.cumsum(size)
    return np.arange(stop[-1] if len(stop) else 0) + np.repeat(begin - (stop - size), size)


def same_spans(a: np.ndarray, a_begin: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_begin: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Of spans of ``a`` and ``b`` in pairs, which are alike in length and in every code point."""
    same = a_size == b_size
    begin, size = a_begin[same], a_size[same]
    differ = a[gathered(begin, size)] != b[gathered(b_begin[same], size)]
    count = np.concatenate([[0], np.cumsum(differ)])
    stop = np.cumsum(size)
    same[same] = count[stop] == count[stop - size]
    return same


class Words:
    """Tokens of pre-tokens already met, kept while they are few enough, and those of whole texts.

    A key finds a pre-token's tokens, and its code points prove them: where those differ, as keys of a hash may
    collide, the pre-token is encoded by itself. encode: token ids of each of a list of pre-tokens.
    """

    def __init__(self, encode, most: int = 400_000, characters: int = 8_000_000):
        self.encode, self.most, self.characters = encode, most, characters
        self._clear()

    def _clear(self) -> None:
        none = np.zeros(0, np.int64)
        self.key, self.begin, self.size, self.ids = np.zeros(0, np.uint64), none, none, np.zeros(0, np.uint32)
        self.point_begin, self.point_size, self.points = none, none, np.zeros(0, np.uint32)

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words on end, and how many each has."""
        ids = self.encode(words)
        return np.concatenate([np.zeros(0, np.uint32), *(np.asarray(x, dtype=np.uint32) for x in ids)]), np.array([len(x) for x in ids], dtype=np.int64)

    def _learn(self, key: np.ndarray, words: list[str]) -> None:
        flat, size = self._encoded(words)
        points, bounds = points_of(words)
        order = np.argsort(np.concatenate([self.key, key]), kind="stable")
        merged = lambda old, new: np.concatenate([old, new])[order]
        self.begin, self.size = merged(self.begin, len(self.ids) + np.cumsum(size) - size), merged(self.size, size)
        self.point_begin, self.point_size = merged(self.point_begin, len(self.points) + bounds[:-1]), merged(self.point_size, np.diff(bounds))
        self.key, self.ids, self.points = merged(self.key, key), np.concatenate([self.ids, flat]), np.concatenate([self.points, points])

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and where each text's begin, with the end."""
        points, bounds = points_of(texts)
        begins = cut(points, bounds)
        if not len(begins):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        ends = np.append(begins[1:], len(points))
        key, place, back = np.unique(keys(points, begins, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.key, key)
        new = (self.key[np.minimum(at, max(len(self.key) - 1, 0))] != key) if len(self.key) else np.ones(len(key), bool)
        whole = "".join(texts)
        if new.any():
            if len(self.key) and (len(self.key) + new.sum() > self.most or len(self.points) > self.characters):
                self._clear()
                new[:] = True
            self._learn(key[new], [whole[begins[i] : ends[i]] for i in place[new]])
            at = np.searchsorted(self.key, key)
        own = at[back]
        size, begin, ids = self.size[own], self.begin[own], self.ids
        other = np.nonzero(~same_spans(points, begins, ends - begins, self.points, self.point_begin[own], self.point_size[own]))[0]
        if len(other):
            more, sizes = self._encoded([whole[begins[i] : ends[i]] for i in other])
            size[other], begin[other] = sizes, len(ids) + np.cumsum(sizes) - sizes
            ids = np.concatenate([ids, more])
        # the number of pre-tokens before each text gives its place among the ids
        return ids[gathered(begin, size)], np.concatenate([[0], np.cumsum(size)])[np.searchsorted(begins, bounds)]


def portions(texts: list[str], most: int = 1_000_000):
    """Texts in order, in lists of about ``most`` characters at most; a longer text stands alone."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > most:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part
