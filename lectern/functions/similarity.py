"""String similarity by longest common subsequence, whole, windowed and by tokens; scores from 0 to 100."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np


def places_of(a: str) -> dict[str, int]:
    """For each character the places it has, as bits."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    return places


def lcs(a: str, b: str, places: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, one machine-word-like step per character of b, best the shorter one (bit-parallel).
    `places`: those of a, if they are at hand."""
    at = (places_of(a) if places is None else places).get
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = at(c)
        if hit:
            hit &= row
            row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


class Beside:
    """Texts beside each other in one whole number, an empty bit behind each: the longest common subsequence of another text with all
    of them takes as many steps as with one. Texts come at the end and leave at the beginning."""

    def __init__(self):
        self.sizes: list[int] = []
        self.places: dict[str, int] = {}
        self.full = self.width = 0

    def add(self, a: str) -> None:
        for c, bits in places_of(a).items():
            self.places[c] = self.places.get(c, 0) | bits << self.width
        self.full |= (1 << len(a)) - 1 << self.width
        self.width += len(a) + 1
        self.sizes.append(len(a))

    def leave(self, n: int) -> None:
        """The first n texts leave."""
        gone = sum(self.sizes[:n]) + n
        self.sizes, self.full, self.width = self.sizes[n:], self.full >> gone, self.width - gone
        self.places = {c: left for c, bits in self.places.items() if (left := bits >> gone)}

    def lcs(self, b: str) -> list[int]:
        row = full = self.full
        for hit in map(self.places.get, b):
            if hit:
                hit &= row
                row = (row + hit | row - hit) & full
        out = []
        for size in self.sizes:
            out.append(size - (row & (1 << size) - 1).bit_count())
            row >>= size + 1
        return out


_GRAM = 6


def _grams(a: str, bits: int) -> np.ndarray:
    """How many grams of a fall into each of 2^bits classes."""
    codes = np.frombuffer(a.encode("ascii", "replace"), np.uint8).astype(np.uint64)
    grams = np.zeros(len(codes) - _GRAM + 1, np.uint64)
    for k in range(_GRAM):
        grams = grams << np.uint64(8) | codes[k : k + len(grams)]
    return np.bincount((grams * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)


def grams_reach(a: str, b: str, least: int) -> bool:
    """Whether two texts have enough grams in common for blocks of so many characters. A stretch of blocks begins at the start or
    behind a character that is in none, so there is at most one more than these, and each has fewer grams than characters."""
    need = least - (_GRAM - 1) * (1 + len(a) + len(b) - 2 * least)
    if need <= 0:
        return True
    bits = min(20, max(len(a), len(b)).bit_length() + 3)
    return int(np.minimum(_grams(a, bits), _grams(b, bits)).sum()) >= need


def seeds_of(b: str) -> dict[str, list[int]]:
    """Where each character stands, without those that SequenceMatcher holds for too frequent to begin a block."""
    most = len(b) // 100 + 1 if len(b) >= 200 else len(b)
    seeds: dict[str, list[int]] = {c: [] for c in set(b) if b.count(c) <= most}
    for c, at in seeds.items():
        j = b.find(c)
        while j >= 0:
            at.append(j)
            j = b.find(c, j + 1)
    return seeds


def _first_longest(a: str, b: str, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """The longest stretch of a that is in b too, the first of equals: places and length."""
    part, at, size = b[blo:bhi], alo, 0
    for i in range(alo, ahi):
        while i + size < ahi and a[i : i + size + 1] in part:
            at, size = i, size + 1
        if i + size >= ahi:
            break
    return at, blo + part.find(a[at : at + size]), size


def _first_seeded(a: str, b: str, alo: int, ahi: int, blo: int, bhi: int, seeds: dict[str, list[int]], marks: list[int]) -> tuple[int, int, int]:
    """The same of what begins with the longest run of seeds."""
    besti, bestj, size = alo, blo, 0
    runs, last = {}, -2
    for i in marks:
        before, runs = runs if i == last + 1 else {}, {}
        last = i
        at = seeds[a[i]]
        for j in at[bisect_left(at, blo) :] if blo else at:
            if j >= bhi:
                break
            k = runs[j] = before.get(j - 1, 0) + 1 if before else 1
            if k > size:
                besti, bestj, size = i - k + 1, j - k + 1, k
    while besti > alo and bestj > blo and a[besti - 1] == b[bestj - 1]:
        besti, bestj, size = besti - 1, bestj - 1, size + 1
    while besti + size < ahi and bestj + size < bhi and a[besti + size] == b[bestj + size]:
        size += 1
    return besti, bestj, size


def blocks_reach(a: str, b: str, least: int, seeds: dict[str, list[int]]) -> bool:
    """Whether the matching blocks of difflib's SequenceMatcher(None, a, b) have at least so many characters in all. Looks only at
    characters that may begin a block (`seeds`, those of b), and stops as soon as the answer is known."""
    marks = [i for i, c in enumerate(a) if c in seeds]
    found, hope, todo = 0, 0, []  # hope: what the stretches left to do can give at most

    def leave(alo: int, ahi: int, blo: int, bhi: int) -> None:
        nonlocal found, hope
        lo, hi = bisect_left(marks, alo), bisect_left(marks, ahi)
        if lo < hi and blo < bhi:
            hope += min(ahi - alo, bhi - blo)
            todo.append((alo, ahi, blo, bhi, marks[lo:hi]))
        else:  # no block begins here, but one that begins at the edge goes on from it
            while alo < ahi and blo < bhi and a[alo] == b[blo]:
                found, alo, blo = found + 1, alo + 1, blo + 1

    leave(0, len(a), 0, len(b))
    while todo and found < least <= found + hope:
        alo, ahi, blo, bhi, some = todo.pop()
        hope -= min(ahi - alo, bhi - blo)
        i, j, size = _first_seeded(a, b, alo, ahi, blo, bhi, seeds, some) if len(b) >= 200 else _first_longest(a, b, alo, ahi, blo, bhi)
        if size:
            found += size
            leave(alo, i, blo, j)
            leave(i + size, ahi, j + size, bhi)
    return found >= least


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string with a stretch of the longer one of at most its length, ends included."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    m, known, best = len(a), set(a), 0.0
    for end in range(1, len(b) + m):
        part = b[max(0, end - m) : end]
        edge = part[-1] if end <= len(b) else part[0]  # a stretch that ends in a foreign character is never the best
        if edge in known:
            best = max(best, ratio(a, part))
    return best


def _tokens(a: str, b: str) -> tuple[str, str, str, str, str]:
    x, y = set(a.split()), set(b.split())
    joined = lambda s: " ".join(sorted(s))
    return joined(x & y), joined(x - y), joined(y - x), " ".join(sorted(a.split())), " ".join(sorted(b.split()))


def token_ratio(a: str, b: str) -> float:
    both, only_a, only_b, all_a, all_b = _tokens(a, b)
    if both and (not only_a or not only_b):
        return 100.0
    gap = len(both) + bool(both)
    la, lb = gap + len(only_a), gap + len(only_b)
    best = max(ratio(all_a, all_b), 200.0 * (gap + lcs(only_a, only_b)) / (la + lb) if la + lb else 100.0)
    if both:
        best = max(best, 200.0 * len(both) / (len(both) + la), 200.0 * len(both) / (len(both) + lb))
    return best


def partial_token_ratio(a: str, b: str) -> float:
    both, only_a, only_b, all_a, all_b = _tokens(a, b)
    return 100.0 if both else max(partial_ratio(all_a, all_b), partial_ratio(only_a, only_b))


def weighted_ratio(a: str, b: str, cutoff: float = 0.0) -> float:
    """The weighted ratio; 0 where it is below cutoff."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if longer < 1.5:
        best = max(best, 0.95 * token_ratio(a, b))
    else:
        scale = 0.9 if longer <= 8 else 0.6
        best = max(best, scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))
    return best if best >= cutoff else 0.0


def _joined(words) -> str:
    return " ".join(sorted(words))


class _Names:
    """Names as rows of numbers of their characters, longest first, for subsequences with one other name at a time."""

    LONGEST = 64  # characters of a name that fit a machine word

    def __init__(self, names: list[str], letters: dict[str, int]):
        self.size = np.array([len(n) for n in names], np.int64)
        self.order = np.argsort(-self.size, kind="stable")
        self.codes = np.full((int(self.size.max(initial=0)), len(names)), len(letters), np.int32)  # a column for each name
        for column, i in enumerate(self.order.tolist()):
            self.codes[: len(names[i]), column] = [letters[c] for c in names[i]]
        self.live = np.searchsorted(-self.size[self.order], -np.arange(len(self.codes)), "left").tolist()  # names longer than t
        self.letters = letters

    def lcs(self, name: str) -> np.ndarray:
        """Length of the longest common subsequence with each name; of what name has beyond 64 characters, all may count (an upper bound)."""
        head = name[: self.LONGEST]
        places = np.zeros(len(self.letters) + 1, np.uint64)
        for i, c in enumerate(head):
            if c in self.letters:
                places[self.letters[c]] |= np.uint64(1 << i)
        full = np.uint64((1 << len(head)) - 1)
        row = np.full(len(self.order), full)
        for t, m in enumerate(self.live):
            hit = row[:m] & places[self.codes[t, :m]]
            row[:m] = row[:m] + hit | row[:m] - hit
        out = np.empty(len(row), np.int64)
        out[self.order] = len(head) - np.bitwise_count(row & full).astype(np.int64)
        return np.minimum(out + len(name) - len(head), self.size)


class Block:
    """Keys that many queries meet. What the weighted ratio with each key is, or can reach at most, comes from subsequences
    with all keys at once; only keys that may be among the best are scored one by one."""

    def __init__(self, keys: list[str]):
        self.keys = keys
        self.letters = {c: i for i, c in enumerate(sorted({c for k in keys for c in k}))}
        self.plain = _Names(keys, self.letters)
        self.turned = _Names([_joined(k.split()) for k in keys], self.letters)
        self.length = self.plain.size
        words = [k.split() for k in keys]
        self.twice = np.array([len(set(w)) < len(w) for w in words], bool)
        self.holders: dict[str, list[int]] = {}
        for i, own in enumerate(words):
            for w in set(own):
                self.holders.setdefault(w, []).append(i)
        self.rest: dict[str, tuple[np.ndarray, _Names]] = {}  # of a word: its holders, and what else they say
        self.scored = 0

    def _without(self, word: str) -> tuple[np.ndarray, _Names]:
        if word not in self.rest:
            at = self.holders[word]
            self.rest[word] = np.array(at), _Names([_joined(set(self.keys[i].split()) - {word}) for i in at], self.letters)
        return self.rest[word]

    def bound(self, query: str) -> np.ndarray:
        """What the weighted ratio of query with each key is at most."""
        words, n = set(query.split()), len(query)
        both = np.zeros(len(self.keys), np.int64)  # characters of words in common, and a blank for each
        often = np.zeros(len(self.keys), np.int64)
        for w in words:
            at = self.holders.get(w, [])
            both[at] += len(w) + 1
            often[at] += 1
        common = self.plain.lcs(query)
        total = self.length + n
        ratio = 200.0 * common / np.maximum(total, 1)
        tokens = 200.0 * self.turned.lcs(_joined(query.split())) / np.maximum(total, 1)
        for w in words:  # of keys with one word in common: the rest compared, and the word with each side
            if w in self.holders:
                at, names = self._without(w)
                rest = _joined(words - {w})
                mine, theirs = len(w) + 1 + len(rest), len(w) + 1 + names.size
                got = 200.0 * (len(w) + 1 + names.lcs(rest)) / (mine + theirs)
                got = np.maximum(got, np.maximum(200.0 * len(w) / (len(w) + mine), 200.0 * len(w) / (len(w) + theirs)))
                got[(names.size == 0) | (not rest)] = 100.0
                one = often[at] == 1
                tokens[at[one]] = np.maximum(tokens[at[one]], got[one])
        loose = (often > 1) | self.twice | (len(words) < len(query.split()))
        tokens[loose] = 100.0
        short, long = np.minimum(self.length, n), np.maximum(self.length, n)
        near = long < 1.5 * short
        scale = np.where(long <= 8 * short, 0.9, 0.6)
        part = 200.0 * np.minimum(common, short) / np.maximum(short + np.minimum(common, short), 1)  # a stretch is at least as long as what it has in common
        common = np.minimum(self.turned.lcs(_joined(query.split())), short)
        turned = 200.0 * common / np.maximum(short + common, 1)
        far = np.maximum(scale * part, 0.95 * scale * np.where((often > 0) | loose, 100.0, turned))
        return np.maximum(ratio, np.where(near, 0.95 * tokens, far))

    def best(self, query: str, cutoff: float, limit: int) -> list[tuple[int, float]]:
        """The places of the best keys with their scores, best first, equal scores in the order of keys."""
        if not query or not self.keys:
            return []
        bound = self.bound(query)  # by the formulas of the score itself, so that equal values are equal
        some = np.flatnonzero(bound >= cutoff)
        found: list[tuple[float, int]] = []
        for i in some[np.argsort(-bound[some], kind="stable")].tolist():
            if len(found) == limit and (-bound[i], i) > found[-1]:
                break
            self.scored += 1
            score = weighted_ratio(query, self.keys[i])
            if score >= cutoff and (len(found) < limit or (-score, i) < found[-1]):
                insort(found, (-score, i))
                del found[limit:]
        return [(i, -s) for s, i in found]


def best_of_all(queries: list[str], keys: list[str], cutoff: float, limit: int) -> list[tuple[str, list[tuple[int, float]]]]:
    """For each query the places of its best keys with their scores, best first, equal scores in the order of keys."""
    block = Block(keys)
    return [(q, block.best(q, cutoff, limit)) for q in queries]
