"""Removal of long repeated byte strings by comparing suffixes at sampled places.

The dealt method sorts triples at the places of a difference cover, recurses on their names and merges the remaining
suffixes. Its first round alone moves more than the disk allowed (README), so only its idea is kept: compare suffixes
through a sample that any two equal ones share. The sample is chosen by content, the smallest 64-byte gram of each
200-byte window: equal windows hold their sampled place at the same distance, so a window need only be compared with
others of the same sample. No triples are sorted and no ranks are made; names are hashes.

1. Sampled grams get names; names that occur once leave, by a Bloom filter and then exactly.
2. Consecutive windows that share a sample form a run, named by its sample and a hash of its whole text. Runs whose
   name repeats are repeated throughout and are settled in one comparison.
3. What is left are the borders of repeats. Their texts meet those of one representative of every other run of the
   same sample, and the names of all their windows are sorted together.
4. Adjacent equal names are repeats; their spans go back to the documents, merged there.

What decides is a hash of the whole text compared: XXH3 for runs, and for windows two polynomials modulo the prime
2^31 - 1 with random bases, which no pair of different windows is built to meet in. The faster polynomial modulo 2^64
only chooses and names samples, where a collision costs a comparison and no result. Every shuffle is pre-aggregated or
joins a side with one row per key, names of very many runs are salted, and no step gathers a group of equals in one place.

Defined cases: a null text is empty; texts shorter than a window lose nothing; repeated rows (same doc_id and text)
are occurrences of each other; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from ._common import materialize, text_or_empty

LENGTH, GRAM = 200, 64
#: A sample with more different runs than this is compared window by window, in no task as a whole.
CROWD = 4096
#: Names that more than one in OFTEN of all rows bear, so at most OFTEN of them, are dealt over SALTS tasks each.
OFTEN, SALTS = 2000, 64
_SEGMENT = 1 << 17  # windows handled at a time
_PLACE = (1 << 18) - 1


class Hasher:
    """Hashes of substrings, vectorised: differences of prefix sums of byte codes times powers of an odd base, modulo 2^64."""

    def __init__(self, size: int, seed: int):
        r = np.random.RandomState(seed)
        codes = r.randint(0, 1 << 32, (2, 256), np.int64).astype(np.uint64)
        self.codes = (codes[0] << np.uint64(32)) | codes[1]
        base = int(r.randint(1 << 30, 1 << 31)) << 32 | int(r.randint(0, 1 << 31)) << 1 | 1
        base = base // 8 * 8 + 5
        self.powers = np.full(size + 1, base, np.uint64)
        self.inverses = np.full(size + 1, pow(base, -1, 1 << 64), np.uint64)
        self.powers[0] = self.inverses[0] = 1
        np.multiply.accumulate(self.powers, out=self.powers)
        np.multiply.accumulate(self.inverses, out=self.inverses)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.codes[data] * self.powers[: len(data)], out=out[1:])
        return out

    def grams(self, prefix: np.ndarray, n: int) -> np.ndarray:
        out = prefix[n:] - prefix[:-n]
        out *= self.inverses[: len(out)]
        return out


class PrimeHasher:
    """Names of substrings by two polynomials with random bases modulo the prime 2^31 - 1, side by side in 64 bits.

    Prefix sums of a segment of up to 2^18 residues stay under 2^50, so nothing overflows.
    """

    P = np.uint64((1 << 31) - 1)

    def __init__(self, size: int, seed: int):
        r = np.random.RandomState(seed)
        p = int(self.P)
        self.parts = []
        for _ in range(2):
            codes = r.randint(1, p, 256, np.int64).astype(np.uint64)
            base = int(r.randint(1 << 20, p - 1, dtype=np.int64))
            self.parts.append((codes, self._powers(base, size + 1), self._powers(pow(base, -1, p), size + 1)))

    def _powers(self, base: int, n: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        done = 1
        while done < n:  # doubling: out[k + done] = out[k] * base^done
            take = min(done, n - done)
            out[done : done + take] = self._fold(self._fold(out[:take] * np.uint64(pow(base, done, int(self.P)))))
            done += take
        return out

    def _fold(self, x: np.ndarray) -> np.ndarray:
        return (x & self.P) + (x >> np.uint64(31))

    def prefix(self, data: np.ndarray) -> list[np.ndarray]:
        out = []
        for codes, powers, _ in self.parts:
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(self._fold(self._fold(codes[data] * powers[: len(data)])), out=sums[1:])
            out.append(sums)
        return out

    def names(self, prefix: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The name of each data[a:b]."""
        halves = []
        for sums, (_, _, inverses) in zip(prefix, self.parts):
            x = self._fold(self._fold(self._fold(sums[b] - sums[a]) * inverses[a]))
            x = self._fold(x)
            halves.append(np.where(x == self.P, np.uint64(0), x))
        return halves[0] << np.uint64(31) | halves[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values: block-wise running minima from both ends."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs_of(data: np.ndarray, hasher: Hasher, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Sample name, run name, first window and number of windows of every run of a document."""
    for at in range(0, len(data) - length + 1, _SEGMENT):
        part = data[at : at + _SEGMENT + length - 1]
        prefix = hasher.prefix(part)
        names = hasher.grams(prefix, gram)
        order = mixed(names) & np.uint64(~_PLACE & 0xFFFFFFFFFFFFFFFF) | np.arange(len(names), dtype=np.uint64)
        place = (sliding_min(order, length - gram + 1) & np.uint64(_PLACE)).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
        last = np.concatenate((first[1:] - 1, [len(place) - 1]))
        where = place[first]
        text = part.tobytes()
        digest = xxhash.xxh3_64_intdigest
        whole = np.fromiter((digest(text[a:b]) for a, b in zip(first.tolist(), (last + length).tolist())), np.uint64, len(first))
        shape = ((where - first) * 65536 + (last - first)).astype(np.uint64)
        yield names[where], mixed(whole ^ mixed(shape + np.uint64(1))), first + at, last - first + 1


def _bytes(value: pa.Scalar) -> np.ndarray:
    buffer = value.as_buffer()
    return np.frombuffer(buffer, np.uint8) if buffer is not None else np.empty(0, np.uint8)


def _signed(parts: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64))


def _named_windows(batch: pa.RecordBatch | pa.Table, hasher: PrimeHasher, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of border runs (d, t, i, a, w, text): the row, place in the run's text and name of each window."""
    texts = batch.column(5)
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)
    rows, places, names, k = [], [], [], 0
    while k < len(texts):
        end = max(k + 1, int(np.searchsorted(at, at[k] + _SEGMENT, "right")) - 1)
        prefix = hasher.prefix(data[at[k] : at[end]])
        count = at[k + 1 : end + 1] - at[k:end] - length + 1
        row = np.repeat(np.arange(k, end), count)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = at[row] - at[k] + place
        rows.append(row)
        places.append(place)
        names.append(mixed(hasher.names(prefix, start, start + length)))
        k = end
    return np.concatenate(rows), np.concatenate(places), np.concatenate(names)


def _compare(batches: Iterator[pa.RecordBatch], length: int, block: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Border runs sorted by sample -> spans of the windows that a second run of the same sample holds too."""
    hasher, held, rows = PrimeHasher(_SEGMENT + 2 * length, 1), [], 0

    def solve(part: pa.Table) -> pa.RecordBatch:
        row, place, name = _named_windows(part, hasher, length)
        sample, first, weight = (part.column(c).to_numpy() for c in (3, 2, 4))
        name = name ^ mixed(sample.astype(np.int64).view(np.uint64))[row]
        order = np.argsort(name, kind="stable")
        equal = name[order][1:] == name[order][:-1]  # adjacent names
        twice = np.zeros(len(name), bool)
        twice[order[1:][equal]] = twice[order[:-1][equal]] = True
        twice &= weight[row] == 1
        at = np.flatnonzero(twice)  # rows, then places, ascend: neighbours make one span
        opens = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(row[at]) != 0))) if len(at) else np.empty(0, bool)
        closes = np.concatenate((opens[1:], [True])) if len(at) else opens
        begin, end = at[opens], at[closes]
        own = row[begin]
        take = pa.array(own)
        ids = [part.column(c).combine_chunks().take(take) for c in (0, 1)]
        ids = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in ids]
        return pa.RecordBatch.from_arrays([*ids, pa.array(first[own] + place[begin]), pa.array(first[own] + place[end] + length)], names=["d", "t", "s", "e"])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= block:
            table = pa.Table.from_batches(held).combine_chunks()
            sample = table.column(3).to_numpy()
            cut = int(np.searchsorted(sample, sample[-1], "left"))
            if cut:
                yield solve(table.slice(0, cut).combine_chunks())
            held, rows = table.slice(cut).to_batches(), table.num_rows - cut
    if rows:
        yield solve(pa.Table.from_batches(held).combine_chunks())


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Border runs -> each of their windows with its name."""
    hasher = PrimeHasher(_SEGMENT + 2 * length, 1)
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = pa.Table.from_batches([batch.slice(at, 2000)]).combine_chunks()
            row, place, name = _named_windows(part, hasher, length)
            take = pa.array(row)
            columns = [pa.concat_arrays(part.column(c).take(take).chunks) for c in (0, 1, 3)]
            first, weight = (part.column(c).to_numpy() for c in (2, 4))
            yield pa.RecordBatch.from_arrays([*columns, _signed([name]), pa.array(first[row] + place), pa.array(weight[row])], names=["d", "t", "a", "h", "s", "w"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and with_text: kept, binary) for each row of docs."""
    text = text_or_empty(docs, text_col)
    plain = docs.select(F.col(id_col).alias("d"), F.xxhash64(text).alias("t"), text.cast("binary").alias("text"))
    kind = plain.schema["d"].dataType.simpleString()
    size = _SEGMENT + length

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(size, 1)
        for batch in batches:
            row, a, r, i, n = [], [], [], [], []
            for k, value in enumerate(batch.column(2)):
                for names, wholes, first, count in runs_of(_bytes(value), hasher, length, gram):
                    row.append(np.full(len(names), k))
                    a.append(names)
                    r.append(wholes)
                    i.append(first)
                    n.append(count)
            take = _signed(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), _signed(a), _signed(r), _signed(i), _signed(n)], names=["d", "t", "a", "r", "i", "n"])

    runs = materialize(plain.mapInArrow(scan, f"d {kind}, t long, a long, r long, i long, n long"), "runs")
    total = runs.count()
    bits = bloom.bits_for(total)
    sampled = F.xxhash64("a")
    some = bloom.probe(runs, sampled, bloom.repeated_filter(runs.select("a"), sampled, bits, 1), bits, "_maybe", 1).filter("_maybe").drop("_maybe")

    often = total // OFTEN
    named = materialize(some.groupBy("a", "r").agg(F.count("*").alias("times"), F.min(F.struct("d", "t", "i", "n")).alias("one")), "all-named-runs")
    shapes = materialize(named.groupBy("a").agg(F.count("*").alias("shapes")), "shapes")
    named = _dealt(named, shapes, ["a"], F.col("shapes") > often, F.xxhash64("r"), "inner").filter("times > 1 or shapes > 1")
    named = materialize(named.select("a", "r", "times", "one", "shapes"), "named-runs")
    twice = named.filter("times > 1").select("a", "r", "times")
    whole = _dealt(some, twice, ["a", "r"], F.col("times") > often, F.xxhash64("d", "t", "i"), "left_semi")
    spans = whole.select("d", "t", F.col("i").alias("s"), (F.col("i") + F.col("n") - 1 + length).alias("e"))

    # the borders: every run that is alone of its name, and one of each repeated run beside them, with their texts
    lone = named.filter("shapes > 1")
    asked = lone.select("one.d", "one.t", F.struct("one.i", "one.n", F.col("a"), F.least("times", F.lit(2)).alias("w"), F.col("shapes")).alias("x"))
    asked = materialize(asked.groupBy(F.col("d").alias("_d"), F.col("t").alias("_t")).agg(F.sort_array(F.collect_list("x")).alias("x")), "borders")  # a document's own runs
    bordering = _only(plain, asked).join(asked, F.col("d").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t"))).select("d", "t", "text", "x")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, texts, fields = [], [], []
            for k, value in enumerate(batch.column(2)):
                data, x = value.as_py(), batch.column(3)[k].values
                row.append(np.full(len(x), k))
                fields.append(x)
                first, count = (x.field(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                texts += [data[i:e] for i, e in zip(first.tolist(), (first + count - 1 + length).tolist())]
            take = _signed(row)
            own = [pa.concat_arrays([x.field(c) for x in fields]) if fields else pa.array([], pa.int64()) for c in (0, 2, 3, 4)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *own, pa.array(texts, pa.binary())], names=["d", "t", "i", "a", "w", "shapes", "text"])

    each = bordering.mapInArrow(contexts, f"d {kind}, t long, i long, a long, w long, shapes long, text binary")
    hot = not lone.filter(F.col("shapes") > crowd).isEmpty()
    if hot:
        each = materialize(each, "border-runs")
    columns = f"d {kind}, t long, s long, e long"
    near = each.filter(F.col("shapes") <= crowd) if hot else each
    near = near.drop("shapes").repartition("a").sortWithinPartitions("a")
    spans = spans.unionByName(near.mapInArrow(lambda batches: _compare(batches, length), columns))
    if hot:  # samples that very many runs share: their windows are named and counted one by one, in no task together
        one = each.filter(F.col("shapes") > crowd).drop("shapes").mapInArrow(lambda batches: _windows(batches, length), f"d {kind}, t long, a long, h long, s long, w long")
        one = materialize(one, "border-windows")
        met = one.groupBy("a", "h").agg(F.sum("w").alias("much")).filter("much > 1").select(F.col("a").alias("_a"), F.col("h").alias("_h"))
        met = materialize(met, "met-windows")  # a table of its own, so that the rows of a window in very many documents can be split in the join
        single = one.filter("w = 1").join(met, (F.col("a") == F.col("_a")) & (F.col("h") == F.col("_h")), "left_semi")
        spans = spans.unionByName(single.select("d", "t", "s", (F.col("s") + length).alias("e")))
    found = spans.groupBy(F.col("d").alias("_d"), F.col("t").alias("_t")).agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("x"))
    found = materialize(found, "spans")

    bits = bloom.bits_for(docs.count())
    key = F.xxhash64("d", "t")
    told = bloom.probe(plain, key, bloom.member_filter(found.select(F.col("_d").alias("d"), F.col("_t").alias("t")), key, bits), bits, "_cut")
    kept = ", kept binary" if with_text else ""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, many, shas, left = [], [], [], [], []
            lists = batch.column(2)
            for k, value in enumerate(batch.column(1)):
                data, pieces, at, lost, count = value.as_py(), [], 0, 0, 0
                if lists[k].is_valid:
                    x = lists[k].values
                    starts, ends = x.field(0).to_numpy(zero_copy_only=False), np.maximum.accumulate(x.field(1).to_numpy(zero_copy_only=False))
                    opens = np.concatenate(([True], starts[1:] > ends[:-1]))
                    closes = np.concatenate((opens[1:], [True]))
                    for s, e in zip(starts[opens].tolist(), ends[closes].tolist()):
                        pieces.append(data[at:s])
                        at, lost, count = e, lost + e - s, count + 1
                pieces.append(data[at:])
                rest = b"".join(pieces)
                total.append(len(data))
                gone.append(lost)
                many.append(count)
                shas.append(hashlib.sha256(rest).hexdigest())
                if with_text:
                    left.append(rest)
            columns = [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(many, pa.int64()), pa.array(shas, pa.string())]
            columns += [pa.array(left, pa.binary())] if with_text else []
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if with_text else 5])

    changed = told.filter("_cut").join(found, F.col("d").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t")), "left").select("d", "text", "x")
    changed = changed.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{kept}")
    zero = F.lit(0).cast("long")
    same = told.filter("not _cut").select(F.col("d").alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), *([F.col("text").alias("kept")] if with_text else []))
    return same.unionByName(changed)


def _dealt(rows: DataFrame, side: DataFrame, keys: list[str], heavy: Column, by: Column, how: str) -> DataFrame:
    """rows joined with side, a table with one row for each key; rows of its heavy keys, at most OFTEN, are dealt over SALTS tasks each."""
    hot = F.broadcast(side.filter(heavy).select(*[F.col(k).alias(f"_hot_{k}") for k in keys], F.lit(True).alias("_hot")))
    same = lambda prefix: reduce(Column.__and__, [F.col(k) == F.col(prefix + k) for k in keys])
    salted = rows.join(hot, same("_hot_"), "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(by, F.lit(SALTS)).cast("int")).otherwise(0))
    salts = F.when(heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    other = side.select(*[F.col(k).alias(f"_side_{k}") for k in keys], *[c for c in side.columns if c not in rows.columns], F.explode(salts).alias("_of"))
    out = salted.join(other, same("_side_") & (F.col("_salt") == F.col("_of")), how)
    return out.select(*rows.columns, *([] if how == "left_semi" else [c for c in side.columns if c not in rows.columns]))


def _only(plain: DataFrame, keys: DataFrame) -> DataFrame:
    """Documents whose key may be among keys (_d, _t); the others stay out of the shuffle."""
    bits = bloom.bits_for(plain.count())
    key = F.xxhash64("d", "t")
    return bloom.probe(plain, key, bloom.member_filter(keys.select(F.col("_d").alias("d"), F.col("_t").alias("t")), key, bits), bits, "_asked").filter("_asked").drop("_asked")
