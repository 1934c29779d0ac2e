"""One large CSV file read by many tasks, with line breaks in quoted cells.

A task that starts in the middle of a file does not know whether it starts inside a cell. So a first pass tells of every line in
what it changes that (built-in expressions over the line, whose two answers fit a byte), and of every block what all its lines do
together: for a start outside a cell and for one inside. Blocks are few; in their order, what each begins with follows. The second
pass then cuts each block into records on its own. Records that go over the end of a block, at most one for each, are put together
from their parts. Quotes count as the CSV reader counts them: they open a cell only at its start, are told twice inside one, and
one in the middle of an unquoted cell is a character like others.

Defined cases: blank lines are no records; a cell that is never closed reaches to the end of its file, but for a last line feed; lines end in a line feed, or
in a carriage return before it if the first line of the input does; bytes may be any; an empty file has no records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import sinks

#: What a line does: bit 0, whether the next begins inside a cell if this one begins outside; bit 1, the same if it begins inside.
KEEPS = 2


def _effect(value: Column, sep: str) -> Column:
    quoted, s = r'(?:[^"]++|"")*+', "\\" + sep if sep != "\t" else r"\t"
    cell = rf'(?:"{quoted}"[^{s}]*+|(?!")[^{s}]*+)'
    opened = rf'(?:{cell}{s})*+"{quoted}\z'
    out = value.rlike(rf"(?s)\A{opened}")
    inside = value.rlike(rf'(?s)\A{quoted}(?:\z|"[^{s}]*+{s}{opened})')
    return F.when(~value.contains('"'), F.lit(KEEPS)).otherwise(out.cast("int") + 2 * inside.cast("int")).cast("tinyint")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def after(effects: np.ndarray, inside: bool) -> np.ndarray:
    """Whether a cell is open behind each line: as the last line says that says so whatever comes before, turned by every line since that turns it."""
    fixed = (effects == 0) | (effects == 3)
    last = np.maximum.accumulate(np.where(fixed, np.arange(len(effects)), -1))
    turns = np.concatenate(([0], np.cumsum(effects == 1)))
    begins = np.where(last < 0, inside, effects[last] == 3)
    return begins ^ ((turns[1:] - turns[last + 1]) % 2).astype(bool)


def _parts(batch: pa.RecordBatch, *columns: int) -> Iterator[pa.RecordBatch]:
    """The slices of a batch in which the columns, numbers, do not change."""
    change = np.zeros(max(0, batch.num_rows - 1), bool)
    for c in columns:
        x = batch.column(c).to_numpy(zero_copy_only=False)
        change |= x[1:] != x[:-1]
    cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, start, file, effect of lines in order -> for each block, whether a cell is open at its end: a from outside, b from inside."""
    block, file, ends = None, None, (False, True)
    made = lambda: pa.RecordBatch.from_arrays([pa.array([x]) for x in (*block, file, *ends)], names=["key", "start", "file", "a", "b"])
    for batch in batches:
        for part in _parts(batch, 0, 1):
            own = part.column(0)[0].as_py(), part.column(1)[0].as_py()
            if own != block:
                if block:
                    yield made()
                block, file, ends = own, part.column(2)[0].as_py(), (False, True)
            effects = part.column(3).to_numpy()
            ends = tuple(bool(after(effects, x)[-1]) for x in ends)
    if block:
        yield made()


class _Cutter:
    """Cuts the lines of one block, some at a time, into records."""

    def __init__(self, block: int, inside: bool, skip: bool, returns: bool):
        self.block, self.open, self.skip, self.blank = block, inside, skip, (b"", b"\r") if returns else (b"",)
        self.row, self.held, self.early = 0, [], inside  # early: what is held began in an earlier block

    def made(self, rows: list[int], pieces: list[int], records: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([self.block] * len(rows), pa.int64()), pa.array(rows, pa.int64()), pa.array(pieces, pa.int8()), records], names=["block", "row", "piece", "record"])

    def add(self, effects: np.ndarray, lines: pa.Array) -> pa.RecordBatch:
        behind = after(effects, self.open)
        plain = not (self.open or self.skip or behind.any())  # the usual case: each line is a record
        self.open = bool(behind[-1])
        if plain:
            for blank in self.blank:
                lines = lines.filter(pc.not_equal(lines, blank))
            rows = range(self.row, self.row + len(lines))
            self.row += len(lines)
            return self.made(list(rows), [0] * len(lines), lines)
        rows, pieces, records = [], [], []
        for line, goes_on in zip(lines.to_pylist(), behind.tolist()):
            self.held.append(line)
            if goes_on:
                continue
            record, self.held = b"\n".join(self.held), []
            if self.early:
                self.early = False
                rows.append(-1)
                pieces.append(2)
                records.append(record)
            elif record not in self.blank:
                if self.skip:
                    self.skip = False
                    continue
                rows.append(self.row)
                pieces.append(0)
                records.append(record)
                self.row += 1
        return self.made(rows, pieces, pa.array(records, pa.binary()))

    def left(self) -> Iterator[pa.RecordBatch]:
        if self.held and not self.skip:
            yield self.made([-1 if self.early else self.row], [3 if self.early else 1], pa.array([b"\n".join(self.held)], pa.binary()))


def _cut(batches: Iterator[pa.RecordBatch], header: bool, returns: bool) -> Iterator[pa.RecordBatch]:
    """block, inside, first, effect, line, in order -> block, row, piece, record. piece: 0 a whole record, 1 one that goes on in the next
    block, 2 the end of one from before, 3 a block that is all one part of it."""
    cutter = None
    for batch in batches:
        for part in _parts(batch, 0):
            block = part.column(0)[0].as_py()
            if cutter is None or cutter.block != block:
                if cutter:
                    yield from cutter.left()
                cutter = _Cutter(block, part.column(1)[0].as_py(), header and part.column(2)[0].as_py(), returns)
            yield cutter.add(part.column(3).to_numpy(), part.column(4))
    if cutter:
        yield from cutter.left()


def records(spark: SparkSession, path: str, sep: str = ",", header: bool = True) -> DataFrame:
    """block, row (in the order of the input), record: the text of each record but the headers, one in each file if header."""
    lines = _lines(spark, path)
    first = lines.select("value").head(1)
    returns = bool(first) and (first[0][0] or "").endswith("\r")
    key = F.xxhash64("file")
    effect = _effect(F.col("value"), sep)
    folded = lines.select(key.alias("key"), "start", "file", effect.alias("effect")).mapInArrow(_fold, "key long, start long, file string, a boolean, b boolean")
    blocks = sinks.materialize(folded, "csv-blocks")
    # in the order of a file's blocks: as the last block says whatever comes before, turned by every block since that turns it
    earlier = Window.partitionBy("file").orderBy("start")
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    fixed, turns = F.col("a") == F.col("b"), F.coalesce(F.count_if(F.col("a") & ~F.col("b")).over(before), F.lit(0))
    blocks = blocks.withColumns({"_turns": turns, "_till": F.coalesce(F.count_if(F.col("a") & ~F.col("b")).over(earlier), F.lit(0))})
    says = F.last(F.when(fixed, F.struct("a", "_till")), True).over(before)
    blocks = blocks.withColumn("_says", says).withColumn("inside", (F.coalesce(F.col("_says.a"), F.lit(False)).cast("int") + F.col("_turns") - F.coalesce(F.col("_says._till"), F.lit(0))) % 2 == 1)
    told = blocks.select("key", "start", (F.row_number().over(Window.orderBy("file", "start")) - 1).cast("long").alias("block"), "inside", (F.row_number().over(earlier) == 1).alias("first"))
    told = sinks.materialize(told, "csv-starts").select(F.col("key").alias("_key"), F.col("start").alias("_start"), "block", "inside", "first")
    # 26 bytes for each block of the input, which is 128 MB unless told otherwise
    placed = lines.join(F.broadcast(told), (key == F.col("_key")) & (F.col("start") == F.col("_start")))
    placed = placed.select("block", "inside", "first", effect.alias("effect"), F.col("value").cast("binary").alias("line"))
    pieces = placed.mapInArrow(lambda batches: _cut(batches, header, returns), "block long, row long, piece tinyint, record binary")
    cut = pieces.filter("piece > 0").join(F.broadcast(told.select(F.col("block").alias("_b"), F.col("_key").alias("of"))), F.col("block") == F.col("_b")).drop("_b")
    group = F.count_if(F.col("piece") == 1).over(Window.partitionBy("of").orderBy("block", "row"))
    whole = cut.withColumn("group", group).groupBy("of", "group").agg(F.min(F.struct("block", "row")).alias("at"), F.sort_array(F.collect_list(F.struct("block", "row", "record"))).alias("parts"))  # the parts of one record
    text = F.array_join(F.transform("parts", lambda p: p["record"].cast("string")), "\n")
    out = pieces.filter("piece = 0").select("block", "row", F.col("record").cast("string").alias("record")).unionByName(whole.select("at.block", "at.row", text.alias("record")))
    return out.withColumn("record", F.when(F.col("record").endswith("\r"), F.expr("left(record, length(record) - 1)")).otherwise(F.col("record"))) if returns else out
