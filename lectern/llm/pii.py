"""Personal data: fixed patterns, and information-theoretic sanitisation of the terms around them.

Every value that a pattern finds (an address, a number) is an entity to protect. A term (a run of three letters or more)
among the `reach` terms on either side of an entity, however far they are, discloses it by their pointwise mutual
information, measured over all documents; a term whose information reaches the share `disclosure` of the entity's own
information content, in at least `support` different contexts, gives the entity away and is a span of kind `term`
wherever it occurs. Pairs, entities and terms count once for each distinct text that holds them, so copies of a document
neither show nor hide anything. With `classes`, what a value belongs to is an entity as well: the domain of an address, the
first three parts of an ip, the first six digits of a card, a phone number but for its last four digits. So a name that stands
near different addresses of one domain gives that away, though no address is told often enough. Pairs and term counts are aggregated before they are shuffled, and terms are counted in
one pass over the texts. Up to `most_told` keys of terms are broadcast, 8 bytes each, as a sorted array that tasks search;
more of them meet the documents' own terms in a join, with equal results.

A string that carries much information by itself is a span of kind `secret`: a run of at least 16 ASCII letters and digits,
both among them and eight of them different, that is all upper case or changes between letters and digits three times
(keys, tokens, hashed passwords). Runs inside a fixed pattern's span are none.

Defined cases: a null text is empty and has no spans; repeated rows each get their row; a null doc_id is a value like
others; copies of a text count once; texts may be of any length; a term equal to part of an entity is no span inside it;
an empty table gives an empty result; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LONGEST_REMEMBERED, materialize, sliced

DISCLOSURE, SUPPORT, REACH, TOLD, COUNTED = 0.9, 3, 6, 4_000_000, 2_000_000
#: Hashes of repeated texts are broadcast up to this many, 16 bytes each; beyond it they are joined by shuffle.
COPIED = 1_000_000
KINDS = ("email", "ip", "card", "phone", "secret", "term")
LOCAL_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits begins, and takes each run whole: one pass, however long the runs are.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")
RUN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{16,}+")
CHANGE = re.compile(r"(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    doubled = [int(c) * 2 for c in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def _ip_ok(text: str) -> bool:
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in (p.lstrip("0") for p in text.split(".")))


def _card_ok(text: str) -> bool:
    digits = NOT_DIGIT.sub("", text)
    return 12 <= len(digits) <= 19 and luhn(digits)


def _phone_ok(text: str) -> bool:
    return 9 <= len(NOT_DIGIT.sub("", text)) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses. Each @ is met once: what may stand before it is read backwards from it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(LOCAL_CHARS))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end), sorted."""
    out = [(a, 0, b) for a, b in emails(text)]
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if _ip_ok(m[0])]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if m.end() - m.start() >= 12 and _card_ok(m[0])]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if _phone_ok(m[0])]
    return sorted(out)


def _is_secret(run: str) -> bool:
    if run.isalpha() or run.isdigit() or len(set(run)) < 8:
        return False
    return run.isupper() or len(CHANGE.findall(run)) >= 3


def secrets(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Strings of much information outside the base spans, as those are."""
    found = [(m.start(), 4, m.end()) for m in RUN.finditer(text) if _is_secret(m[0])]
    covered = _Covered(base) if found else None
    return [x for x in found if not covered.overlaps(x[0], x[2])]


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.lower())


def _entity(text: str, kind: int) -> int:
    return xxhash.xxh64_intdigest(text.lower() if kind == 0 else text if kind == 1 else NOT_DIGIT.sub("", text), kind)


def _class(text: str, kind: int) -> int:
    """What a value belongs to, as the key of an entity of its own kind."""
    if kind < 2:
        return xxhash.xxh64_intdigest(text.lower().rpartition("@")[2] if kind == 0 else text.rpartition(".")[0], 10 + kind)
    digits = NOT_DIGIT.sub("", text)
    return xxhash.xxh64_intdigest(digits[:6] if kind == 2 else digits[:-4], 10 + kind)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


class _Covered:
    """Tells whether a range overlaps any of the given spans, by binary search in their union."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, _, b in spans:  # sorted by start
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def overlaps(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b) - 1  # the last that begins before b
        return k >= 0 and self.ends[k] > a


def _near(text: str, spans: list[tuple[int, int, int]], reach: int) -> Iterator[tuple[int, list[int], int]]:
    """Each entity of a text with the keys of the `reach` terms before it and the `reach` after it, however far they are, and its class; terms inside a span do not count."""
    covered = _Covered(spans)
    terms = [m.span() for m in TERM.finditer(text) if not covered.overlaps(*m.span())] if spans else []
    starts = [t[0] for t in terms]
    for a, kind, b in spans:
        k = bisect_left(starts, a)
        yield _entity(text[a:b], kind), [_key(text[x:y]) for x, y in terms[max(0, k - reach) : k] + terms[bisect_left(starts, b) :][:reach]], _class(text[a:b], kind)


def disclosing_terms(texts: DataFrame, disclosure: float, support: int, reach: int, most_told: int = TOLD, classes: bool = False) -> DataFrame:
    """texts: one column text. t: keys of the terms that give an entity away, or with classes a class of them."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda *lists: pa.RecordBatch.from_arrays([_signed(x) for x in lists], names=["e", "t", "c", "h"])
        for batch in sliced(batches):
            e, t, c, h = [], [], [], []
            for text in batch.column(0).to_pylist():
                once, digest = set(), None
                for value, terms, kin in _near(text, base_spans(text), reach) if text else ():
                    digest = digest or xxhash.xxh64_intdigest(text)
                    context = xxhash.xxh64_intdigest(np.array(terms, np.uint64).tobytes())
                    for entity in (value, kin) if classes else (value,):
                        for term in {0, *terms}:  # 0 stands for the entity itself
                            if (entity, term, context) not in once:
                                once.add((entity, term, context))
                                e.append(entity)
                                t.append(term)
                                c.append(context)
                                h.append(digest)
                if len(e) > 100_000:
                    yield made(e, t, c, h)
                    e, t, c, h = [], [], [], []
            yield made(e, t, c, h)

    near = texts.mapInArrow(pairs, "e long, t long, c long, h long")
    near = near.groupBy("e", "t").agg(F.count_distinct("h").alias("n_both"), F.count_distinct("c").alias("contexts"))
    near = materialize(near, "near-terms")
    alone = near.filter("t = 0").select(F.col("e").alias("_e"), F.col("n_both").alias("n_entity"))
    both = near.filter((F.col("t") != 0) & (F.col("contexts") >= support)).join(alone, F.col("e") == F.col("_e")).select("t", "n_both", "n_entity")
    both = materialize(both, "supported-terms")
    terms = materialize(both.select("t").distinct(), "terms")
    few = terms.limit(most_told + 1).count() <= most_told
    told = _told(terms, few)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, totals, size = _Membership(told.value if few else None), defaultdict(Counter), 0

        def tell() -> Iterator[pa.RecordBatch]:
            for copies, total in totals.items():
                yield pa.RecordBatch.from_arrays([_signed(list(total)), pa.array([copies] * len(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["t", "copies", "n"])
            totals.clear()

        for batch in sliced(batches):
            for text, copies in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    own = set(map(known.__getitem__, set(TERM.findall(text))))
                    own.discard(0)
                    totals[copies].update(own)
                    size += len(own)
            if size > COUNTED:  # a bound on what a task holds
                yield from tell()
                size = 0
        yield from tell()

    # one pass over all texts: of the wanted terms alone where their keys can be told to all tasks, else of all terms, which then meet the wanted ones
    counted = _copies(texts).mapInArrow(count, "t long, copies long, n long").groupBy("t", "copies").agg(F.expr("sum(n) div copies").alias("n"))  # all copies of a text hold its terms
    counted = counted.groupBy("t").agg(F.sum("n").alias("n_term")).withColumnRenamed("t", "_t")
    n = max(2, texts.count())
    information = F.log(F.lit(float(n)) * F.col("n_both") / (F.col("n_entity") * F.col("n_term")))
    content = F.log(F.lit(float(n)) / F.col("n_entity"))
    return both.join(counted, F.col("t") == F.col("_t")).filter((content > 0) & (information >= disclosure * content)).select("t").distinct()


def _told(terms: DataFrame, few: bool):
    """The sorted keys of terms, broadcast; nothing where there are too many."""
    keys = terms.toArrow().column("t").to_numpy() if few else np.empty(0, np.int64)  # at most TOLD numbers
    return terms.sparkSession.sparkContext.broadcast(np.sort(keys.view(np.uint64)))


def _copies(texts: DataFrame) -> DataFrame:
    """text, copies: how many rows have the same text. Only hashes of repeated texts are joined, up to COPIED by broadcast."""
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    repeated = materialize(texts.select(own.alias("_h")).groupBy("_h").agg(F.count("*").alias("_m")).filter("_m > 1"), "repeated")
    repeated = F.broadcast(repeated) if repeated.limit(COPIED + 1).count() <= COPIED else repeated
    return texts.join(repeated, own == F.col("_h"), "left").select("text", F.coalesce("_m", F.lit(1).cast("long")).alias("copies"))


class _Membership(dict):
    """word -> its key if that is among the wanted (sorted), else 0; every key is wanted if wanted is None. Forgets when it has grown large."""

    def __init__(self, wanted: np.ndarray | None):
        self.wanted = wanted
        if wanted is not None:  # a byte for each of many ranges of keys tells that it holds none, before the search
            self.shift = 64 - min(25, max(8, len(wanted).bit_length() + 3))
            flags = np.zeros(1 << (64 - self.shift), np.uint8)
            flags[(np.asarray(wanted, np.uint64) >> np.uint64(self.shift)).astype(np.int64)] = 1
            self.flags = flags.tobytes()

    def __missing__(self, word: str) -> int:
        key = _key(word)
        if self.wanted is not None:
            if self.flags[key >> self.shift]:
                at = int(np.searchsorted(self.wanted, np.uint64(key)))
                key = key if at < len(self.wanted) and int(self.wanted[at]) == key else 0
            else:
                key = 0
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) > 300_000:
                self.clear()
            self[word] = key
        return key


def _own_terms(plain: DataFrame, terms: DataFrame) -> DataFrame:
    """plain (doc_id, text) with _own: which of the terms each document holds; documents without any have null."""
    kind = plain.schema["doc_id"].dataType.simpleString()
    keyed = plain.withColumn("_t", F.xxhash64("text"))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            row, found = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                keys = {_key(w) for w in set(TERM.findall(text or ""))}
                row += [k] * len(keys)
                found += keys
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), _signed(found)], names=["d", "h", "t"])

    pairs = keyed.mapInArrow(held, f"d {kind}, h long, t long")
    own = pairs.join(terms.select(F.col("t").alias("_k")), F.col("t") == F.col("_k"), "left_semi").groupBy("d", "h").agg(F.collect_set("t").alias("_own"))  # a document's own terms
    return keyed.join(own, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("_t") == F.col("h")), "left").select("doc_id", "text", "_own")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE, support: int = SUPPORT, reach: int = REACH, most_told: int = TOLD, classes: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end, comma-joined) and n_spans, their number, for each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    terms = materialize(disclosing_terms(texts, disclosure, support, reach, most_told, classes), "disclosing")
    few = terms.limit(most_told + 1).count() <= most_told
    told = _told(terms, few)
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if not few:
        plain = _own_terms(plain, terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Membership(told.value)
        joined = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
        for batch in sliced(batches):
            counts, shas, every, total = [[], [], [], []], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                text = text or ""
                base = base_spans(text)
                spans = sorted(base + more) if (more := secrets(text, base)) else base
                if not few:
                    known = _Membership(np.sort(np.array(batch.column(2)[k].as_py() or [], np.int64).view(np.uint64)))
                if len(known.wanted):
                    covered = _Covered(spans)
                    more = [(m.start(), 5, m.end()) for m in TERM.finditer(text) if known[m[0]] and not covered.overlaps(*m.span())]
                    spans = sorted(spans + more) if more else spans
                for i in range(4):
                    counts[i].append(sum(k == i for _, k, _ in base))
                shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
                every.append(joined(spans))
                total.append(len(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(shas, pa.string()), pa.array(every, pa.string()), pa.array(total, pa.int64())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    return plain.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def sanitise(text: str | None, spans: str) -> str:
    """text with every span generalised to the name of its kind; overlapping spans become one."""
    out, at, text = [], 0, text or ""
    for kind, a, b in sorted((s.split(":") for s in spans.split(",") if s), key=lambda s: (int(s[1]), -int(s[2]))):
        a, b = int(a), int(b)
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])
