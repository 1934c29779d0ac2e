"""Quality classifier: Naive Bayes support vectors.

Features are indicators of n-grams, one and two long, of two kinds: of words (lower-cased white-space tokens), and of
token shapes (letter case, digits and punctuation of a word, and whether it repeats the word before; a word of more than
RUNS runs is as many words as its pieces), each shape at several levels of frequency within the text. They are hashed
into 2^BITS places. An indicator's value is its class log-count ratio; a linear hinge-loss model over them is fitted by
dual coordinate descent, and its margin is turned into a probability by a logistic fit on documents that the fit had
left out.

The model is fitted on at most `per_class` labelled documents of each class, those with the smallest hash of doc_id;
everything else reads every whole text. Weights are 2^BITS numbers, whatever the input.

Defined cases: null and empty texts have only the feature "no token" and are scored like others; labels without a
document, null labels and repeated labels (the lowest counts) are allowed; if a class has no labelled document,
nothing can be learned: the score is 0 if all labels are 0, else 1; repeated rows each get their row; a null doc_id is
never learned from and not held out; texts and tokens may be of any length; an empty table gives an empty result; other
columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import LONGEST_REMEMBERED, sliced

BITS, PER_CLASS, THRESHOLD, LEVELS, RUNS, SEVERAL = 20, 4000, 0.7, (0.0, 0.01, 0.05, 0.15, 0.4), 8, 0
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_LEVEL_KEYS = np.arange(len(LEVELS), dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


class _Kinds(dict):
    """code point -> the kind of its character: A, a, 0, or the character itself."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        out = self[code] = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return out


_RUN = re.compile(r"(.)\1*", re.S)


def _runs(kinds: str) -> list[str]:
    """The shapes of the runs of like kinds."""
    return [m[1] if m[1] == "a" or m.end() - m.start() == 1 else m[1] + "+" for m in _RUN.finditer(kinds)]


def shape(token: str) -> str:
    return "".join(_runs(token.translate(_Kinds())))


def pieces(token: bytes) -> tuple[list[bytes], list[int]]:
    """The whole token in consecutive pieces of at most RUNS runs, and the key of each piece's shape."""
    text = token.decode("utf-8", "replace")
    kinds = text.translate(_Kinds())
    runs, cuts = _runs(kinds), [*[m.start() for m in _RUN.finditer(kinds)][::RUNS], len(text)]
    return [text[a:b].encode() for a, b in zip(cuts, cuts[1:])], [xxhash.xxh64_intdigest("".join(runs[k : k + RUNS])) for k in range(0, len(runs), RUNS)]


class _Shapes(dict):
    """token -> the key of its shape, or SEVERAL if it has more than one piece. Tokens of the same kinds share one."""

    def __init__(self):
        self.kinds, self.keys_of = _Kinds(), {}

    def __missing__(self, token: bytes) -> int:
        kinds = token.decode("utf-8", "replace").translate(self.kinds)
        out = self.keys_of.get(kinds)
        if out is None:
            runs = _runs(kinds)
            out = xxhash.xxh64_intdigest("".join(runs)) if len(runs) <= RUNS else SEVERAL
        if len(token) <= LONGEST_REMEMBERED:
            for known, key in ((self, token), (self.keys_of, kinds)):
                if len(known) > 300_000:
                    known.clear()
                known[key] = out
        return out


class _Words(dict):
    """token -> the key of the token in lower case."""

    def __missing__(self, token: bytes) -> int:
        out = xxhash.xxh64_intdigest(token.lower(), 5)
        if len(token) <= LONGEST_REMEMBERED:
            if len(self) > 300_000:
                self.clear()
            self[token] = out
        return out


def _grams(one: np.ndarray, same: np.ndarray | None = None) -> np.ndarray:
    """Keys of the pairs of neighbours; same tells which of them are one token twice."""
    two = (one[:-1] * _SPREAD) ^ one[1:]
    return two if same is None else two ^ (same * np.uint64(0xA5A5A5A5))


def features(text: bytes | None, shapes: _Shapes, words: _Words, bits: int = BITS) -> np.ndarray:
    """Distinct places of the indicators of a text."""
    tokens = (text or b"").split()
    if not tokens:
        return np.zeros(1, np.int64)
    said = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    said = np.concatenate((said, _grams(said) + np.uint64(1)))
    one = np.fromiter(map(shapes.__getitem__, tokens), np.uint64, len(tokens))
    if (one == SEVERAL).any():  # from here on, their pieces stand for them
        split = [pieces(t) if k == SEVERAL else ([t], [k]) for t, k in zip(tokens, one.tolist())]
        tokens = [t for part, _ in split for t in part]
        one = np.array([k for _, keys in split for k in keys], np.uint64)
    same = np.fromiter(map(bytes.__eq__, tokens, tokens[1:]), bool, len(tokens) - 1)
    two = _grams(one, same)
    grams, counts = np.unique(np.concatenate((one, two, two[same] * np.uint64(0) + np.uint64(77))), return_counts=True)
    share = counts / len(tokens)
    found = [grams[share > level] + key for key, level in zip(_LEVEL_KEYS, LEVELS)]
    x = np.concatenate([*found, said])
    x = (x ^ (x >> np.uint64(31))) * _SPREAD
    return np.unique((x >> np.uint64(64 - bits)).astype(np.int64))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    count = np.ones((2, size))
    for x, label in zip(rows, y):
        count[int(label > 0), x] += 1
    count /= count.sum(axis=1, keepdims=True)
    return np.log(count[1] / count[0])


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, values: np.ndarray, c: float = 0.1, rounds: int = 15, seed: int = 3) -> np.ndarray:
    """Weights of the linear model with L2 penalty and hinge loss; the last one is the bias."""
    size = len(values)
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    xs = [np.append(values[x], 1.0) for x in rows]
    at = [np.append(x, size) for x in rows]
    q = np.array([v @ v for v in xs])
    random = np.random.RandomState(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in random.permutation(len(rows)):
            gradient = y[i] * (w[at[i]] @ xs[i]) - 1
            new = min(max(alpha[i] - gradient / q[i], 0.0), c)
            if new != alpha[i]:
                moved = max(moved, abs(new - alpha[i]))
                w[at[i]] += (new - alpha[i]) * y[i] * xs[i]
                alpha[i] = new
        if moved < 1e-4 * c:
            break
    return w


def logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(1) = 1 / (1 + exp(-(a m + b))), by damped Newton steps."""
    a, b = 1.0, 0.0
    t = (y > 0) * 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = weight * (p - t)
        h = weight * p * (1 - p) + 1e-6
        hess = np.array([[h @ margin**2 + 1e-3, h @ margin], [h @ margin, h.sum() + 1e-3]])
        step = np.linalg.solve(hess, np.array([g @ margin + 1e-3 * (a - 1), g.sum() + 1e-3 * b]))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def remainder(id_col: Column, n: int) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(n))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS, bits: int = BITS) -> dict:
    """Weights and calibration, from labelled rows whose crc32(doc_id) mod 4 is not 2."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (remainder(F.col(id_col), 4) != 2)).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_y"))
    totals = {r[0]: r[1] for r in known.groupBy("_y").count().collect()}
    if len(totals) < 2:
        return {"constant": float(0 not in totals)}
    chosen = [known.filter(F.col("_y") == k).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for k in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])  # at most 2 x per_class ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, words = _Shapes(), _Words()
        for batch in sliced(batches):
            found = [features(t.as_py(), shapes, words, bits).astype(np.int32).tobytes() for t in batch.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["y", "x"])

    plain = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("text"))
    got = plain.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("_y", "text").mapInArrow(run, "y int, x binary").collect()  # the bounded sample
    if len({r[0] for r in got}) < 2:
        return {"constant": float(all(r[0] for r in got))}
    got.sort(key=lambda r: (r[0], bytes(r[1])))  # the same model however the rows arrive
    rows = [np.frombuffer(r[1], np.int32) for r in got]
    y = np.array([2.0 * r[0] - 1 for r in got])
    part = np.random.RandomState(11).randint(0, 5, len(rows))
    margins = np.zeros(len(rows))
    weights = []
    for fold in (0, None):  # a fifth is left out for the calibration, then all is used
        use = np.flatnonzero(part != fold) if fold is not None and len({*y[part != fold]}) > 1 and len({*y[part == fold]}) > 1 else np.arange(len(rows))
        r = log_count_ratios([rows[i] for i in use], y[use], 1 << bits)
        w = dual_coordinate_descent([rows[i] for i in use], y[use], r)
        weights = np.append(w[:-1] * r, w[-1])
        if fold == 0:
            margins = np.array([weights[x].sum() + weights[-1] for x in rows])
            rest = np.flatnonzero(part == 0) if len(use) < len(rows) else use
    prior = np.where(y > 0, totals[1] / max(1, (y > 0).sum()), totals[0] / max(1, (y < 0).sum()))
    a, b = logistic(margins[rest], y[rest], prior[rest] / prior[rest].mean())
    return {"weights": weights.astype(np.float32), "a": max(a, 1e-3), "b": b, "bits": bits}


def _scorer(model: dict):
    shapes, words = _Shapes(), _Words()

    def score(text: bytes | None) -> float:
        if "constant" in model:
            return model["constant"]
        w = model["weights"]
        margin = float(w[features(text, shapes, words, model["bits"])].sum() + w[-1])
        return float(1 / (1 + np.exp(-np.clip(model["a"] * margin + model["b"], -30, 30))))

    return score


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    told = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, **options))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = _scorer(told.value)
        for batch in sliced(batches):
            found = np.array([rate(t.as_py()) for t in batch.column(2).cast(pa.large_binary())], float)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(remainder(F.col(id_col), 4) == 2, F.lit(False))
    return docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def accept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns."""
    told = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, **options))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = _scorer(told.value)
        for batch in sliced(batches):
            yield batch.filter(pa.array([rate(t.as_py()) >= threshold for t in batch.column(place).cast(pa.large_binary())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
