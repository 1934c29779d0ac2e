"""URL filters on a sorted digest array.

Rules are (host, path) pairs; a rule fits its host and all subdomains if the url's path starts with its path,
and the longest fitting rule decides. The 64-bit xxhash keys of all rules lie sorted in a file that workers
map into memory and probe by vectorised binary search; a hit counts only if the stored rule is the same string.

Defined cases: a null or empty url, or one without ://, has an empty host and path; without a fitting rule the verdict
is `default`; length is that of host and path together, and of fitting rules equally long the one with the longer host
decides; of rules with the same host and path the last one given counts; without rules all get `default`; repeated rows
and null page_ids each get their row; urls may be of any length; an empty table gives an empty result; other columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ascii_lower


_FOLDER: list[str] = []  # of this process, for the files that it serves to executors; removed at its end


def _served(name: str, blob: bytes) -> str:
    """The path of a file of that content; written once, and complete as soon as it bears its name."""
    if not _FOLDER:
        _FOLDER.append(os.path.realpath(tempfile.mkdtemp(prefix="lectern-rules-")))
        atexit.register(shutil.rmtree, _FOLDER[0], ignore_errors=True)
    path = os.path.join(_FOLDER[0], name)
    if not os.path.exists(path):
        handle, part = tempfile.mkstemp(dir=_FOLDER[0])
        with open(handle, "wb") as f:
            f.write(blob)
        os.replace(part, path)
    return path


def build(spark: SparkSession, rules: list[tuple[str, str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """rules: (verdict, host, path). Ships the digest file to all executors; returns its name and the lengths of hosts and paths in use."""
    rules = sorted({(h, p): (v, h, p) for v, h, p in rules}.values(), key=lambda r: xxhash.xxh64_intdigest(r[1] + r[2]))
    keys = np.array([xxhash.xxh64_intdigest(h + p) for _, h, p in rules], "<u8")
    strings = [f"{v}\0{h}\0{p}".encode() for v, h, p in rules]
    ends = np.cumsum([len(s) for s in strings], dtype="<u8")
    blob = np.array([len(rules)], "<u8").tobytes() + keys.tobytes() + ends.tobytes() + b"".join(strings)
    name = f"lectern-rules-{hashlib.sha256(blob).hexdigest()[:16]}.bin"
    spark.sparkContext.addFile(_served(name, blob))
    return name, sorted({(len(h), len(p)) for _, h, p in rules})


class Digests:
    def __init__(self, path: str):
        self.file = np.memmap(path, np.uint8, "r")
        n = int(self.file[:8].view("<u8")[0])
        self.keys, self.ends = self.file[8 : 8 + 8 * n].view("<u8"), self.file[8 + 8 * n : 8 + 16 * n].view("<u8")
        self.base = 8 + 16 * n

    def rule(self, i: int) -> list[str]:
        a, b = (int(self.ends[i - 1]) if i else 0), int(self.ends[i])
        return self.file[self.base + a : self.base + b].tobytes().decode().split("\0")

    def match(self, hosts: list[str], paths: list[str], lengths: list[tuple[int, int]]) -> list[tuple[str, str] | None]:
        """The longest fitting rule of each url as (rule, verdict). Only ends of a host that are as long as some rule's are asked for, so a host of very many labels costs no more."""
        owner, keys, asked = [], [], []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            size = len(host)
            for m, n in lengths:
                if host and n <= len(path) and (m == size or m < size and host[size - m - 1] == "."):
                    owner.append(i)
                    asked.append((host[size - m :], path[:n]))
                    keys.append(xxhash.xxh64_intdigest(host[size - m :] + path[:n]))
        found: list[tuple[str, str] | None] = [None] * len(hosts)
        best = [(-1, -1)] * len(hosts)
        if not keys or not len(self.keys):
            return found
        probe = np.array(keys, np.uint64)
        place = np.searchsorted(self.keys, probe)
        hit = place < len(self.keys)
        hit[hit] = self.keys[place[hit]] == probe[hit]
        for k in np.flatnonzero(hit):
            p, (host, path) = int(place[k]), asked[k]
            while p < len(self.keys) and self.keys[p] == probe[k]:  # equal digests of different strings lie side by side
                verdict, h, q = self.rule(p)
                if (h, q) == (host, path):
                    i = owner[k]
                    if (len(h + q), len(h)) > best[i]:
                        best[i] = (len(h + q), len(h))
                        found[i] = (h + q, verdict)
                p += 1
        return found


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict."""
    name, lengths = build(pages.sparkSession, rules)
    kind = pages.schema[id_col].dataType.simpleString()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = Digests(SparkFiles.get(name))
        for batch in batches:
            found = digests.match(batch.column(1).to_pylist(), batch.column(2).to_pylist(), lengths)
            rule = pa.array([f and f[0] for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, pa.array([f[1] if f else default for f in found], pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    url = F.col(url_col).cast("string")
    return pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path")).mapInArrow(probe, f"page_id {kind}, host string, path string, rule string, verdict string")
