"""Runs of repeated words: maximal stretches with a smallest period q, at least two periods and `least` words long.

1. Words become numbers, exactly. A run of period q holds a stretch of at least `least` / 2 words that stands again q words
   later, and such stretches cover it. So words that no repeated gram of that length covers belong to no run, and what is
   left falls into parts, in which the same holds again. This leaves out most of a text and never a run.
2. Of each part, a suffix automaton over its words. Its states are taken from the longest down; the end positions of a
   state, an ordered set, go into the set of its suffix link, the smaller set into the larger. A newly inserted position
   whose neighbour is no further than the state's length marks a square, and with it a run of that distance.
3. A square is extended to both sides as far as words a period apart are equal. Every run has a square whose two ends
   become neighbours in the state of their longest common suffix. A distance that is a multiple of the period finds the
   same stretch again; the smaller one stays.

Documents are independent: nothing is shuffled. A task holds the numbers of about 4 MB of texts, or of one longer text,
and the automaton of one part at a time, about 700 bytes a word of it; a text that is not periodic has no such part.

Defined cases: null, empty and blank texts have no words and no run; a null doc_id is never looped; repeated rows and ties
each get their row; texts may be of any length; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import sliced
from .suffix_automaton import automaton

LEAST = 12
#: Bytes of texts whose words are looked at together, and bytes that are split into words at a time.
TOGETHER, PIECE = 4 << 20, 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


class Numbers(dict):
    """Words -> 0, 1, 2, ... in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def numbered(text: bytes, known: Numbers) -> np.ndarray:
    """The words of a text as numbers. bytes.split knows the six ASCII white-space characters only."""
    parts, at = [], 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            found = _BLANK.search(text, end)
            end = found.start() if found else len(text)
        words = text[at:end].split()
        parts.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.int32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _covered(words: np.ndarray, part: np.ndarray, gram: int) -> np.ndarray:
    """Which words a gram covers that occurs again in the same part. Grams are compared by hash, so a few words too many may be covered."""
    n = len(words) - gram + 1
    if n < 2:
        return np.zeros(len(words), bool)
    mixed, key = _mixed(words), _mixed(part[:n])
    for j in range(gram):
        key += mixed[j : j + n] * np.uint64(2 * (0x5851F42D4C957F2D * (j + 1) % (1 << 62)) + 1)
    key = _mixed(key)
    inside = part[:n] == part[gram - 1 :]
    ordered = np.sort(key[inside])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    again = np.zeros(n, bool)
    if len(twice):
        mask = np.uint64((1 << 20) - 1)
        seen = np.zeros(1 << 20, bool)
        seen[twice & mask] = True
        maybe = np.flatnonzero(inside & seen[key & mask])
        place = np.searchsorted(twice, key[maybe])
        again[maybe[twice[np.minimum(place, len(twice) - 1)] == key[maybe]]] = True
    out = np.zeros(len(words), bool)
    for j in range(gram):
        out[j : j + n] |= again
    return out


def parts_of(words: np.ndarray, text: np.ndarray, least: int, rounds: int = 6) -> Iterator[tuple[int, int]]:
    """The parts [from, to) that may hold runs. text: the number of the text of each word, ascending. Fewer rounds leave more words and no fewer runs."""
    at, part = np.arange(len(words)), text
    for _ in range(rounds):
        kept = _covered(words[at], part, least // 2)
        before = len(at)
        old, at = part[kept], at[kept]
        if not len(at):
            return
        opens = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(old) != 0)))
        part = np.cumsum(opens)
        long = np.bincount(part)[part] >= least
        at, part = at[long], part[long]
        if len(at) == before or not len(at):
            break
    first = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(first, [*first[1:], len(part)]):
        yield int(at[a]), int(at[b - 1]) + 1


class Places:
    """An ordered set of positions, in lists of bounded length, so that an insertion moves little however large the set is."""

    LOAD = 512
    __slots__ = ("lists", "least", "size")

    def __init__(self, ordered: list[int]):
        self.lists = [ordered[i : i + self.LOAD] for i in range(0, len(ordered), self.LOAD)]
        self.least = [x[0] for x in self.lists]
        self.size = len(ordered)

    def __len__(self) -> int:
        return self.size

    def __iter__(self) -> Iterator[int]:
        for x in self.lists:
            yield from x

    def insert(self, x: int) -> tuple[int, int]:
        """The neighbours of x, which was not in the set: -1 and an endless number where there is none."""
        k = max(0, bisect_right(self.least, x) - 1)
        own = self.lists[k]
        i = bisect_left(own, x)
        before = own[i - 1] if i else -1
        after = own[i] if i < len(own) else self.least[k + 1] if k + 1 < len(self.lists) else 1 << 62
        own.insert(i, x)
        self.size += 1
        if not i:
            self.least[k] = x
        if len(own) > 2 * self.LOAD:
            self.lists[k : k + 1] = [own[: self.LOAD], own[self.LOAD :]]
            self.least[k : k + 1] = [own[0], own[self.LOAD]]
        return before, after


def squares(words: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(x, q, m): the m words up to and with x stand q words before too, q <= m. m is at least `least` / 2, as it is for some square of every run."""
    length, link, prefix = automaton(words)[:3]
    ends: list[list[int] | Places | None] = [None] * len(length)
    for i, state in enumerate(prefix):
        ends[state] = [i]
    shortest = least // 2
    for state in np.argsort(-np.array(length), kind="stable").tolist():
        up = link[state]
        if up < 0 or length[up] < shortest:
            ends[state] = None
            continue
        small, large, m = ends[state], ends[up], length[up]
        ends[state] = None
        if large is None:
            ends[up] = small
            continue
        if len(small) > len(large):
            small, large = large, small
        for x in small:
            if type(large) is list:
                i = bisect_left(large, x)
                before = large[i - 1] if i else -1
                after = large[i] if i < len(large) else 1 << 62
                large.insert(i, x)
                if len(large) > Places.LOAD:
                    large = Places(large)
            else:
                before, after = large.insert(x)
            if before >= 0 and x - before <= m:
                yield x, x - before, m
            if after - x <= m:
                yield after, after - x, m
        ends[up] = large


def _equal(words: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words from a and from b on, in steps of 1 or -1, are equal in pairs; a < b."""
    n = len(words) - b if step > 0 else a + 1
    done, size = 0, 32
    while done < n:
        size = min(size, n - done)
        if step > 0:
            same = words[a + done : a + done + size] == words[b + done : b + done + size]
        else:
            same = (words[a - done - size + 1 : a - done + 1] == words[b - done - size + 1 : b - done + 1])[::-1]
        if not same.all():
            return done + int(same.argmin())
        done += size
        size *= 2
    return done


def runs_of_part(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, in order."""
    starts: dict[int, list[int]] = {}
    stops: dict[int, list[int]] = {}
    for x, q, m in squares(words.tolist(), least):
        first = starts.setdefault(q, [])
        k = bisect_right(first, x - 2 * q + 1) - 1
        if k >= 0 and stops[q][k] > x:
            continue  # runs of one period overlap by less than it, so a square lies in one only
        a = x - m + 1
        a -= _equal(words, a - q - 1, a - 1, -1) if a > q else 0
        b = x + 1 + _equal(words, x - q + 1, x + 1, 1)
        first.insert(k + 1, a - q)
        stops.setdefault(q, []).insert(k + 1, b)
    least_period: dict[tuple[int, int], int] = {}
    for q, first in starts.items():
        for a, b in zip(first, stops[q]):
            if b - a >= max(least, 2 * q):
                least_period[a, b] = min(q, least_period.get((a, b), q))
    return sorted((a, b - a, q) for (a, b), q in least_period.items())


def loop_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """What the contract of op13 makes of a text of n words: from word a on it repeats a's first p words. None: nothing."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, loop: Callable[[int | None, int], tuple[int, int] | None] | None = None, with_runs: bool = False) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli (of the longest run), runs_sha256, collapsed_sha256 for each row of docs.

    A word is dropped from the collapsed text if a run contains it after its first period. loop: what becomes of a text
    beforehand, from its id and number of words. with_runs: also runs, an array of (start, length, period), and collapsed, the text.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    schema += ", runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string" * with_runs
    struct = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def solve(ids: list, words: list[np.ndarray], known: Numbers) -> pa.RecordBatch:
        flat = np.concatenate(words)
        begins = np.concatenate(([0], np.cumsum([len(w) for w in words])))
        own: dict[int, list[tuple[int, int, int]]] = {}
        for a, b in parts_of(flat, np.repeat(np.arange(len(words)), np.diff(begins)), least):
            k = int(np.searchsorted(begins, a, "right")) - 1
            own.setdefault(k, []).extend((int(a - begins[k]) + s, n, q) for s, n, q in runs_of_part(flat[a:b], least))
        spelt = list(known)
        rows, wholes = [], []
        for k, w in enumerate(words):
            runs = own.get(k, [])
            if runs:
                edge = np.zeros(len(w) + 1, np.int64)
                for s, n, q in runs:
                    edge[s + q] += 1
                    edge[s + n] -= 1
                w = w[np.cumsum(edge[:-1]) == 0]
            digest, pieces = hashlib.sha256(), []
            for at in range(0, len(w), PIECE):
                piece = b" " * bool(at) + b" ".join(map(spelt.__getitem__, w[at : at + PIECE].tolist()))
                digest.update(piece)
                pieces += [piece] if with_runs else []
            best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
            told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
            rows.append((len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256(told.encode()).hexdigest(), digest.hexdigest()))
            if with_runs:
                wholes.append(([{"start": s, "length": n, "period": q} for s, n, q in runs], b"".join(pieces).decode()))
        columns = [pa.array([r[i] for r in rows], pa.int64() if i < 5 else pa.string()) for i in range(7)]
        columns += [pa.array([x[0] for x in wholes], struct), pa.array([x[1] for x in wholes], pa.string())] if with_runs else []
        names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *columns], names=names[: len(columns) + 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            first, size, words, known = 0, 0, [], Numbers()
            for k, value in enumerate(batch.column(1)):
                buffer = value.as_buffer()
                text = buffer.to_pybytes() if buffer is not None else b""
                if words and size + len(text) > TOGETHER:
                    yield solve([batch.column(0).slice(first, k - first)], words, known)
                    first, size, words, known = k, 0, [], Numbers()
                w = numbered(text, known)
                looped = loop(batch.column(0)[k].as_py(), len(w)) if loop else None
                if looped:
                    a, p = looped
                    w[a:] = w[a + np.arange(len(w) - a) % p]
                words.append(w)
                size += len(text)
            if words:
                yield solve([batch.column(0).slice(first)], words, known)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
