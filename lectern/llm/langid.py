"""Language identification of mixed text.

The scripts of a word (by Unicode range, letter by letter) narrow the candidate languages: one that is not written in
all of them cannot label the word. Each word is scored per remaining language from word counts, with character trigrams
behind them for rare words; Viterbi decoding with a penalty for switching labels spans, and the language with most words
is the document's. A word is a run of letters (str.isalpha), lower-cased.

Word, trigram and script counts are taken over every document that may be learned from, aggregated per partition
before they are shuffled, in 2^WORD_BITS + 2^GRAM_BITS hashed places; the driver gets one row for each place, with a
number for each language, whatever the input.

Defined cases: null and letterless texts (digits, number signs, punctuation) are `und` with score 0; without anything to
learn from all is `und`; a word in scripts that no language is written in favours none; ties go to the language that
sorts first; repeated rows each get their row; a null doc_id is learned from and not held out; texts may be of any
length; an empty table gives an empty result; other columns, whatever their names, are not looked at.

What a task holds does not grow with a text's words times the languages: long texts are decoded in parts, forwards with the scores of
paths noted where parts begin, then backwards, part by part.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import sliced
from .quality import remainder

WORD_BITS, GRAM_BITS, PENALTY, FLOOR = 18, 16, 4.0, 0.01
#: Scores that a task remembers at a time (a word has one for each language), and characters of their words.
REMEMBERED, REMEMBERED_CHARS = 1_200_000, 20_000_000
#: Scores that are looked at together: of words times languages. A text of more characters is decoded in parts.
TOGETHER = 4_000_000
#: Characters of text a task counts words of before it hands its counts on.
COUNTED_CHARS = 100_000_000
#: Log score of a language that a word's scripts exclude.
EXCLUDED = -1e6
_ALNUM = r"[^\W\d_]"
WORD = re.compile(_ALNUM + "+")
#: Letters only: number signs such as U+00B2 or U+2167, which re counts among word characters, left out.
LETTERS = re.compile(r"[^\W\d_" + "".join(c for c in re.findall(_ALNUM, "".join(map(chr, range(0x80, 0x110000)))) if not c.isalpha()) + "]+")
#: First code points of scripts, in order; a script reaches to the next entry.
SCRIPT_STARTS = [(0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x900, "indic"), (0xE00, "thai"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han")]
SCRIPTS = sorted({name for _, name in SCRIPT_STARTS})
_LATIN = SCRIPTS.index("latin")
_STARTS = np.array([a for a, _ in SCRIPT_STARTS])
_SCRIPT_AT = (1 << WORD_BITS) + (1 << GRAM_BITS)


def lowered(text: str) -> str:
    """text in lower case, character by character: only U+0130 would become two."""
    return text.replace("\u0130", "i").lower()


def found_words(low: str) -> list[str]:
    """Runs of letters. The pattern without number signs is slow, and asked only for texts in which there are some."""
    out = WORD.findall(low)
    return out if low.isascii() or not out or "".join(out).isalpha() else LETTERS.findall(low)


def scripts(word: str) -> list[int]:
    """The scripts of a word's letters."""
    if word.isascii() or max(word) < "\u0370":
        return [_LATIN]
    at = np.searchsorted(_STARTS, np.fromiter(map(ord, word), np.int64, len(word)), "right") - 1
    return sorted({SCRIPTS.index(SCRIPT_STARTS[k][1]) for k in set(at.tolist())})


def places(word: str) -> tuple[int, list[int], list[int]]:
    """Places of a word, of its trigrams and of its scripts."""
    bound = f"^{word}$"
    grams = [(1 << WORD_BITS) + (xxhash.xxh32_intdigest(bound[i : i + 3]) >> (32 - GRAM_BITS)) for i in range(len(bound) - 2)]
    return xxhash.xxh32_intdigest(word) >> (32 - WORD_BITS), grams, [_SCRIPT_AT + s for s in scripts(word)]


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = defaultdict(Counter)

        def tell() -> pa.RecordBatch:
            out = []
            for lang, seen in words.items():
                total: Counter = Counter()
                for word, n in seen.items():
                    w, grams, own = places(word)
                    total[w] += n
                    for g in grams + own:
                        total[g] += n
                out += [(lang, k, n) for k, n in total.items()]
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64()))], names=["lang", "place", "n"])

        read = 0
        for batch in sliced(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    words[lang].update(found_words(lowered(text)))
                    read += len(text)
                    if read > COUNTED_CHARS or sum(map(len, words.values())) > 400_000:
                        yield tell()
                        read = 0
        yield tell()

    may = docs.filter(F.col(lang_col).isNotNull() & F.coalesce(remainder(F.col(id_col), 5) != 0, F.lit(True)))
    counts = may.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string")).mapInArrow(count, "lang string, place int, n long")
    langs = sorted(r[0] for r in may.select(F.col(lang_col).cast("string").alias("lang")).distinct().collect())  # the languages
    table = np.zeros((_SCRIPT_AT + len(SCRIPTS), len(langs)), np.float32)
    if langs:
        summed = [F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)).cast("float").alias(f"n{i}") for i, lang in enumerate(langs)]
        rows = counts.groupBy("place").agg(*summed).toArrow()  # a row for each place, 4 bytes for each language
        table[rows.column("place").to_numpy()] = np.stack([rows.column(f"n{i}").to_numpy() for i in range(len(langs))], axis=1)
    return {"langs": langs, "table": table}


class _Scores:
    """Log scores of words, a row of a growing table for each word seen; new words are scored many at a time."""

    def __init__(self, model: dict):
        table = model["table"]
        n = len(model["langs"])
        words, grams, scripts = table[: 1 << WORD_BITS], table[1 << WORD_BITS : _SCRIPT_AT], table[_SCRIPT_AT:]
        self.words = words / np.maximum(words.sum(axis=0), 1) * max(1.0, float(words.sum() / max(1, n)))
        self.grams = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * len(grams)))
        self.allowed = scripts >= 0.001 * np.maximum(scripts.sum(axis=0), 1)
        self.at: dict[str, int] = {}
        self.chars = 0
        self.rows = np.zeros((1024, n), np.float32)

    def prepare(self, words: list[list[str]]) -> None:
        """Make sure that every word has a row."""
        n = max(1, self.rows.shape[1])
        if len(self.at) * n > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.at.clear()
            self.chars = 0
            self.rows = self.rows[:1024].copy() if self.rows.size > 4 * REMEMBERED else self.rows
        new = list(set().union(*words).difference(self.at))
        step = max(1, 4 * REMEMBERED // n)
        for k in range(0, len(new), step):
            self._add(new[k : k + step])

    def _add(self, new: list[str]) -> None:
        found = [places(w) for w in new]
        grams = np.fromiter((g for _, gs, _ in found for g in gs), np.int64)
        starts = np.cumsum([0, *(len(gs) for _, gs, _ in found[:-1])])
        guess = np.add.reduceat(self.grams[grams - (1 << WORD_BITS)], starts, axis=0)
        guess = np.exp(guess - guess.max(axis=1, keepdims=True))
        allowed = self.allowed[np.array([own[0] for _, _, own in found]) - _SCRIPT_AT]
        for k, (_, _, own) in enumerate(found):
            for s in own[1:]:
                allowed[k] &= self.allowed[s - _SCRIPT_AT]
        mass = (self.words[np.array([w for w, _, _ in found])] + 2 * guess / guess.sum(axis=1, keepdims=True)) * allowed
        total = mass.sum(axis=1, keepdims=True)
        likely = np.where(allowed, np.log(np.maximum(mass / np.where(total > 0, total, 1), FLOOR)), EXCLUDED)
        out = np.where(total > 0, likely, 0.0)
        first = len(self.at)
        while first + len(new) > len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
        self.rows[first : first + len(new)] = out
        self.at.update(zip(new, range(first, first + len(new))))
        self.chars += sum(map(len, new))

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.at.__getitem__, words), np.int32, len(words))


def viterbi(words: list[np.ndarray], rows: np.ndarray, penalty: float) -> list[np.ndarray]:
    """Best path of each document, given the rows of its words; many documents at a time, longest first, so that each
    step is a few operations on (documents that have a word there, languages)."""
    out: list = [None] * len(words)
    order = sorted(range(len(words)), key=lambda k: -len(words[k]))
    n = rows.shape[1]
    while order:
        longest = len(words[order[0]])
        take = max(1, min(512, TOGETHER // (longest * max(1, n))))
        some, order = order[:take], order[take:]
        ends = np.array([len(words[k]) for k in some])
        s = np.zeros((longest, len(some), n), np.float32)
        for j, k in enumerate(some):
            s[: ends[j], j] = rows[words[k]]
        best, line = s[0].copy(), np.arange(len(some))
        came = np.zeros((longest, len(some)), np.int16)
        jump = np.zeros((longest, len(some), n), bool)
        live = np.searchsorted(-ends, -np.arange(longest), "left")  # documents longer than t
        for t in range(1, longest):
            m = live[t]
            now = best[:m]
            came[t, :m] = top = now.argmax(axis=1)
            switched = now[line[:m], top][:, None] - penalty
            np.greater(switched, now, out=jump[t, :m])
            np.maximum(now, switched, out=now)
            now += s[t, :m]
        at = best.argmax(axis=1).astype(np.int16)
        path = np.zeros((longest, len(some)), np.int16)
        for t in range(longest - 1, 0, -1):
            m = live[t]
            path[t, :m] = at[:m]
            np.copyto(at[:m], came[t, :m], where=jump[t, line[:m], at[:m]])
        path[0] = at
        for j, k in enumerate(some):
            out[k] = path[: ends[j], j].copy()
    return out


def parts_of(text: str, size: int) -> list[tuple[int, int]]:
    """Cuts of a text, about `size` characters apart, none inside a word."""
    cuts, at = [], 0
    while at < len(text):
        end = at + size
        while end < len(text) and text[end].isalnum():
            end += 1
        cuts.append((at, min(end, len(text))))
        at = end
    return cuts


def long_path(text: str, scores: _Scores, penalty: float, size: int) -> np.ndarray:
    """As viterbi(), of one lower-cased text, whose words are made and scored `size` characters at a time."""

    def scored(a: int, b: int) -> np.ndarray:
        words = found_words(text[a:b])
        scores.prepare([words])
        return scores.rows[scores.of(words)]

    def step(now: np.ndarray, own: np.ndarray) -> tuple[int, np.ndarray]:
        top = int(now.argmax())
        switched = now[top] - np.float32(penalty)
        jump = switched > now
        np.maximum(now, switched, out=now)
        now += own
        return top, jump

    cuts, begins, best = parts_of(text, size), [], None
    for a, b in cuts:
        begins.append(None if best is None else best.copy())
        for own in scored(a, b):
            if best is None:
                best = own.copy()
            else:
                step(best, own)
    if best is None:
        return np.empty(0, np.int16)
    at, paths = int(best.argmax()), []
    for (a, b), now in zip(reversed(cuts), reversed(begins)):
        s = scored(a, b)
        came, jump, path = np.full(len(s), -1, np.int32), np.zeros(s.shape, bool), np.empty(len(s), np.int16)
        for t, own in enumerate(s):
            if now is None:
                now = own.copy()
            else:
                came[t], jump[t] = step(now, own)
        for t in range(len(s) - 1, -1, -1):
            path[t] = at
            if came[t] >= 0 and jump[t, at]:
                at = int(came[t])
        paths.append(path)
    return np.concatenate(paths[::-1])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", penalty: float = PENALTY, with_spans: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score (and with_spans: spans, lang:start:end in code points, comma-joined) for each row."""
    told = docs.sparkSession.sparkContext.broadcast(learn(docs, id_col, text_col, lang_col))
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "held_out", "lang_pred", "score", "spans"][: 5 if with_spans else 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = told.value
        langs, scores = model["langs"], _Scores(model)
        held: list[tuple[pa.RecordBatch, list[str], list]] = []
        long = max(1, TOGETHER // max(4, len(langs)))  # characters

        def label() -> Iterator[pa.RecordBatch]:
            lists = [w for _, _, words in held for w in words]
            scores.prepare(lists)
            some = [k for k, w in enumerate(lists) if w]
            paths = dict(zip(some, viterbi([scores.of(lists[k]) for k in some], scores.rows, penalty)))
            k = 0
            every = [t for _, texts, _ in held for t in texts]
            for j, t in enumerate(every):
                if langs and len(t) > long:
                    path = long_path(t, scores, penalty, long)
                    if len(path):
                        paths[j] = path
            for batch, texts, words in held:
                preds, shares, spans = [], [], []
                for text in texts:
                    path = paths.get(k)
                    k += 1
                    if path is None:
                        preds.append("und")
                        shares.append(0.0)
                        spans.append("")
                        continue
                    count = np.bincount(path, minlength=len(langs))
                    preds.append(langs[int(count.argmax())])
                    shares.append(float(count.max() / len(path)))
                    if with_spans:
                        at = [m.span() for m in LETTERS.finditer(text)]
                        cut = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
                        spans.append(",".join(f"{langs[path[a]]}:{at[a][0]}:{at[b - 1][1]}" for a, b in zip(cut, cut[1:])))
                made = [batch.column(0), batch.column(1), pa.array(preds, pa.string()), pa.array(shares, pa.float64())] + ([pa.array(spans, pa.string())] if with_spans else [])
                yield pa.RecordBatch.from_arrays(made, names=names)
            held.clear()

        n = 0
        for batch in sliced(batches):
            texts = [lowered(x or "") for x in batch.column(2).to_pylist()]
            words = [found_words(t) if langs and len(t) <= long else [] for t in texts]
            held.append((batch, texts, words))
            n += sum(map(len, words))
            if n * max(1, len(langs)) > TOGETHER:  # the longer the run, the fewer steps with few documents
                yield from label()
                n = 0
        yield from label()

    held = F.coalesce(remainder(F.col(id_col), 5) == 0, F.lit(False))
    schema = f"doc_id {kind}, held_out boolean, lang_pred string, score double" + (", spans string" if with_spans else "")
    return docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
