"""Best-fit packing of tokenised documents, large items first.

Pieces of one length are interchangeable, so only the histogram of lengths (at most `capacity` numbers) is
packed: pieces above a third of the capacity are matched greedily, at most two to a bin, then smaller ones
best-fit the remaining gaps, longest first. The plan is a list of runs of ranks, and each piece finds its
bin by its rank among the pieces of its length. Nothing the driver sees grows with the number of documents.

Defined cases: a null or empty text is the closing id alone; a null doc_id sorts first; repeated rows are
packed one by one; texts may be of any length; an empty table gives an empty result; other columns, whatever their
names, are not looked at.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import LONGEST_REMEMBERED, materialize, power_of_two, sliced

CAPACITY, CLOSING_ID, VOCABULARY = 2048, 0, "word_bpe_49k.json"
#: Chunks between white space whose ids a task remembers at a time.
REMEMBERED = 400_000


#: Chunks of these characters alone need no Unicode normalisation and split as the tokenizer's own pattern splits them.
_PLAIN = re.compile("[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")
#: The byte-level alphabet: bytes without a visible Latin-1 character stand at 256 and after, in order.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
_BYTE_LEVEL = {b: 256 + k for k, b in enumerate(_HIDDEN)}


class _Ids(dict):
    """White-space separated chunk of UTF-8 -> its ids as little-endian unsigned 32-bit bytes, for the vocabulary VOCABULARY alone.

    Its tokenizer drops white space and never joins across it, so chunks are encoded by themselves. A new chunk of
    plain characters is put together from its parts, which are far fewer; any other goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.parts = Tokenizer.from_file(path), {}
        self.model = self.tokenizer.model

    def part(self, text: str) -> bytes:
        out = self.parts.get(text)
        if out is None:
            if len(self.parts) > REMEMBERED:
                self.parts.clear()
            word = text if text.isascii() else text.encode().decode("latin-1").translate(_BYTE_LEVEL)
            out = np.array([t.id for t in self.model.tokenize(word)], "<u4").tobytes()
            if len(text) <= LONGEST_REMEMBERED:
                self.parts[text] = out
        return out

    def of(self, text: bytes) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        return b"".join(map(self.__getitem__, text.split()))

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8")
        if _PLAIN.fullmatch(text) and "<|" not in text:
            out = b"".join(map(self.part, _PARTS.findall(text.lower())))
        else:
            out = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(chunk) <= LONGEST_REMEMBERED:
            self[chunk] = out
        return out


class _WholeIds:
    """Ids of texts by any other vocabulary: whole texts go through its tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def of(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode("utf-8"), add_special_tokens=False).ids, "<u4").tobytes()


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, vocabulary: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""
    closing = np.array([CLOSING_ID], "<u4").tobytes()
    kind = docs.schema[id_col].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = (_Ids if vocabulary == VOCABULARY else _WholeIds)(vocabulary_path(vocabulary))
        for batch in sliced(batches):
            rows, numbers, starts, lengths, crcs = [], [], [], [], []
            for k, text in enumerate(batch.column(1).cast(pa.large_binary())):
                blob = ids.of(text.as_py() or b"") + closing
                for j, at in enumerate(range(0, len(blob), 4 * capacity)):
                    part = blob[at : at + 4 * capacity]
                    rows.append(k)
                    numbers.append(j)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    crcs.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(x, t) for x, t in ((numbers, pa.int32()), (starts, pa.int64()), (lengths, pa.int64()), (crcs, pa.int64()))]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(split, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, rank after the last, first bin, pieces of this length in each bin, offset) and the number of bins."""
    left = {n: c for n, c in histogram.items() if c}
    open_bins: dict[int, list] = defaultdict(list)  # gap -> [bins alike, ((length, times), ...)]
    gaps: list[int] = []

    def keep(bins: int, gap: int, held: tuple) -> None:
        if bins:
            if gap not in open_bins or not open_bins[gap]:
                insort(gaps, gap)
            open_bins[gap].append((bins, held))

    large = sorted(n for n in left if 3 * n > capacity)
    for a in reversed(large):
        k = bisect_left(large, capacity - a + 1) - 1  # the largest that fits beside a
        while left[a]:
            while k >= 0 and (large[k] > a or left[large[k]] < 1 + (large[k] == a)):
                k -= 1
            if k < 0:
                keep(left[a], capacity - a, ((a, 1),))
                left[a] = 0
            elif large[k] == a:
                n = left[a] // 2
                keep(n, capacity - 2 * a, ((a, 2),))
                left[a] -= 2 * n
            else:
                n = min(left[a], left[large[k]])
                keep(n, capacity - a - large[k], ((a, 1), (large[k], 1)))
                left[a] -= n
                left[large[k]] -= n
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[s]:
            k = bisect_left(gaps, s)
            if k == len(gaps):
                gap, bins, held = capacity, -(-left[s] // (capacity // s)), ()
            else:
                gap = gaps[k]
                bins, held = open_bins[gap].pop()
                if not open_bins[gap]:
                    gaps.pop(k)
            times = gap // s
            n = min(bins, left[s] // times)
            keep(n, gap - times * s, (*held, (s, times)))
            left[s] -= n * times
            rest = bins - n
            if rest and left[s] and left[s] < times:
                keep(1, gap - left[s] * s, (*held, (s, left[s])))
                left[s] = 0
                rest -= 1
            if held or gap < capacity:
                keep(rest, gap, held)
    runs, ranks, at = [], defaultdict(int), 0
    for groups in open_bins.values():
        for bins, held in groups:
            offset = 0
            for n, times in held:
                runs.append((n, ranks[n], ranks[n] + bins * times, at, times, offset))
                ranks[n] += bins * times
                offset += n * times
            at += bins
    runs.sort()
    return np.array(runs, np.int64).reshape(-1, 6), at


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, spread: int | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece. vocabulary: a file of public_tokenizers."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, id_col, text_col, capacity, vocabulary), "pieces")
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    runs, _ = plan(histogram, capacity)
    told = spark.sparkContext.broadcast(runs)  # a few runs for each length and gap

    # ranks within each length; a length is spread over sub-groups, so that a common one is no single task's work
    spread = spread or power_of_two(sum(histogram.values()) // 1_000_000, 16, 4096)
    cut = cut.withColumn("_sub", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(spread)).cast("int"))
    counts = cut.groupBy("length", "_sub").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_sub")) - F.col("_n")
    counts = counts.select(F.col("length").alias("_l"), F.col("_sub").alias("_s"), before.alias("_before"))
    order = Window.partitionBy("length", "_sub").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("_rn", F.row_number().over(order)).join(counts, (F.col("length") == F.col("_l")) & (F.col("_sub") == F.col("_s")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_rn") - 1).cast("long").alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = told.value
        big = 1 << 45
        keys = r[:, 0] * big + r[:, 1]
        for batch in batches:
            if batch.num_rows:
                length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
                run = r[np.searchsorted(keys, length * big + rank, "right") - 1]
                step, nth = np.divmod(rank - run[:, 1], run[:, 4])
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(run[:, 3] + step), pa.array(run[:, 5] + nth * length)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
