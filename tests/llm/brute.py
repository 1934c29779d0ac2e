"""Plain restatements of the contracts, for small tables. Documents are lists of (doc_id, text)."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

A2A = {c: c + 32 for c in range(65, 91)}


def low(text):
    return (text or "").translate(A2A)


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def op1(docs, n=200):
    data = {d: (t or "").encode() for d, t in docs}
    seen = Counter(b[i : i + n] for b in data.values() for i in range(len(b) - n + 1))
    out = {}
    for d, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, sha(kept))
    return out


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def op2(docs):
    fps = {d: fingerprint(t) for d, t in docs}
    ids = sorted(fps)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 3]
    return {d: (f"{fps[d]:016x}", c) for d, c in roots(ids, links).items()}


def op3_sizes(docs):
    return {d: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs}


def op6(docs):
    groups = defaultdict(list)
    for d, t in docs:
        groups[low(t)].append(d)
    return {d: (max(g), len(g), d == max(g), sha(k)) for k, g in groups.items() for d in g}


def op7(urls, rules):
    out = {}
    for i, u in urls:
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = low(host)
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        out[i] = (host, path, best[1], best[2])
    return out


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def op9(docs, items, n=10):
    windows = defaultdict(set)
    for i, t in items:
        w = bench_words(t)
        m = min(n, len(w))
        for s in range(len(w) - m + 1) if m else ():
            windows[tuple(w[s : s + m])].add(str(i))
    sizes = {len(w) for w in windows}
    out = {}
    for d, t in docs:
        w, hit, found = bench_words(t), set(), set()
        for m in sizes:
            for s in range(len(w) - m + 1):
                got = windows.get(tuple(w[s : s + m]))
                if got:
                    hit.update(range(s, s + m))
                    found |= got
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def op10_base(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    out.sort()
    n = Counter(k for _, _, k, _ in out)
    return (n["email"], n["ip"], n["card"], n["phone"], sha(",".join(f"{k}:{s}:{e}" for s, _, k, e in out)))


M64 = (1 << 64) - 1
SPREAD, LEVEL_KEY = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def crc_remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def shape_pieces(token, runs=8):
    """Runs of like characters, `runs` of them to a piece: (text of the piece, its shape)."""
    kind = lambda c: "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
    found = []
    for c in token:
        if found and kind(found[-1][0]) == kind(c):
            found[-1] += c
        else:
            found.append(c)
    told = lambda r: kind(r[0]) + ("+" if len(r) > 1 and kind(r[0]) != "a" else "")
    return [("".join(found[k : k + runs]), "".join(map(told, found[k : k + runs]))) for k in range(0, len(found), runs)]


def op4_features(text, bits=20, levels=(0.0, 0.01, 0.05, 0.15, 0.4)):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not tokens:
        return {0}
    place = lambda k: (((k ^ k >> 31) * SPREAD) & M64) >> (64 - bits)
    words = [xxhash.xxh64_intdigest(low(t).encode(), 5) for t in tokens]
    out = {place(w) for w in words} | {place(((a * SPREAD & M64) ^ b) + 1 & M64) for a, b in zip(words, words[1:])}
    parts = [(p, xxhash.xxh64_intdigest(s)) for t in tokens for p, s in shape_pieces(t)]
    count = Counter(s for _, s in parts)
    for (p, a), (q, b) in zip(parts, parts[1:]):
        count[(a * SPREAD & M64) ^ b ^ (0xA5A5A5A5 if p == q else 0)] += 1
        if p == q:
            count[77] += 1
    for k, n in count.items():
        for i, level in enumerate(levels):
            if n / len(parts) > level:
                out.add(place(k + i * LEVEL_KEY & M64))
    return out


def op4(docs, labels, bits=20, c=0.1, rounds=15):
    """doc_id -> score. labels: doc_id -> 0 or 1."""
    import math

    import numpy as np

    text = dict(docs)
    known = [d for d in text if d in labels and crc_remainder(d, 4) != 2]
    rows = sorted((labels[d], np.array(sorted(op4_features(text[d])), np.int32).tobytes()) for d in known)
    xs, ys = [np.frombuffer(b, np.int32).tolist() for _, b in rows], [2 * y - 1 for y, _ in rows]
    part = np.random.RandomState(11).randint(0, 5, len(rows))

    def fitted(use):
        seen = {s: Counter(k for i in use if ys[i] == s for k in xs[i]) for s in (1, -1)}
        total = {s: sum(seen[s].values()) + (1 << bits) for s in seen}
        ratio = lambda k: math.log((seen[1][k] + 1) / total[1]) - math.log((seen[-1][k] + 1) / total[-1])
        w, bias, alpha, random = defaultdict(float), 0.0, [0.0] * len(use), np.random.RandomState(3)
        r = {k: ratio(k) for i in use for k in xs[i]}
        for _ in range(rounds):
            moved = 0.0
            for j in random.permutation(len(use)):
                x, y = xs[use[j]], ys[use[j]]
                g = y * (sum(w[k] * r[k] for k in x) + bias) - 1
                new = min(max(alpha[j] - g / (sum(r[k] ** 2 for k in x) + 1), 0.0), c)
                step, alpha[j] = (new - alpha[j]) * y, new
                moved = max(moved, abs(step))
                for k in x:
                    w[k] += step * r[k]
                bias += step
            if moved < 1e-4 * c:
                break
        return lambda x: sum(w[k] * (r[k] if k in r else ratio(k)) for k in x) + bias

    rest = [i for i in range(len(rows)) if part[i] == 0]
    margin, final = fitted([i for i in range(len(rows)) if part[i] != 0]), fitted(list(range(len(rows))))
    pos, neg = sum(y > 0 for y in ys), sum(y < 0 for y in ys)
    assert pos and neg and rest and len({ys[i] for i in rest}) == 2
    m = [margin(xs[i]) for i in rest]
    a, b = 1.0, 0.0
    for _ in range(300):  # Newton for the two numbers; all labelled rows are in the fit, so both classes weigh the same
        p = [1 / (1 + math.exp(-max(-30, min(30, a * v + b)))) for v in m]
        e = [q - (ys[i] > 0) for q, i in zip(p, rest)]
        h = [q * (1 - q) + 1e-6 for q in p]
        ga, gb = sum(x * v for x, v in zip(e, m)) + 1e-3 * (a - 1), sum(e) + 1e-3 * b
        haa, hab, hbb = sum(x * v * v for x, v in zip(h, m)) + 1e-3, sum(x * v for x, v in zip(h, m)), sum(h) + 1e-3
        det = haa * hbb - hab * hab
        da, db = (ga * hbb - gb * hab) / det, (gb * haa - ga * hab) / det
        a, b = a - da, b - db
        if max(abs(da), abs(db)) < 1e-6:
            break
    return {d: 1 / (1 + math.exp(-max(-30, min(30, max(a, 1e-3) * final(op4_features(t)) + b)))) for d, t in docs}


def letters(text):
    """Runs of letters, lower-cased."""
    return "".join(c if c.isalpha() else " " for c in (text or "").replace("İ", "i").lower()).split()


def op5(docs, langs, word_bits=18, gram_bits=16, penalty=4.0, floor=0.01):
    """doc_id -> (lang_pred, score), for texts in Latin letters. langs: doc_id -> lang or None."""
    import math

    h = lambda s, bits: xxhash.xxh32_intdigest(s) >> (32 - bits)
    grams = lambda w: [h(f"^{w}$"[i : i + 3], gram_bits) for i in range(len(w))]
    names = sorted({langs[d] for d, _ in docs if langs[d] and crc_remainder(d, 5)})
    words, tri = {x: Counter() for x in names}, {x: Counter() for x in names}
    for d, t in docs:
        if langs[d] and crc_remainder(d, 5):
            for w in letters(t):
                words[langs[d]][h(w, word_bits)] += 1
                tri[langs[d]].update(grams(w))
    n_words, n_tri = {x: sum(words[x].values()) for x in names}, {x: sum(tri[x].values()) for x in names}
    scale = max(1.0, sum(n_words.values()) / len(names))

    def scores(w):
        guess = [sum(math.log((tri[x][g] + 0.5) / (n_tri[x] + 0.5 * 2**gram_bits)) for g in grams(w)) for x in names]
        guess = [math.exp(g - max(guess)) for g in guess]
        mass = [words[x][h(w, word_bits)] / max(1, n_words[x]) * scale + 2 * g / sum(guess) for x, g in zip(names, guess)]
        return [math.log(max(m / sum(mass), floor)) for m in mass]

    known, out = {}, {}
    for d, t in docs:
        path, back = None, []
        for w in letters(t):
            if w not in known:
                known[w] = scores(w)
            if path is None:
                path = list(known[w])
                continue
            top = max(range(len(names)), key=lambda k: path[k])
            came = [top if path[top] - penalty > path[k] else k for k in range(len(names))]
            path = [path[came[k]] - (penalty if came[k] != k else 0) + known[w][k] for k in range(len(names))]
            back.append(came)
        if path is None:
            out[d] = ("und", 0.0)
            continue
        at = max(range(len(names)), key=lambda k: path[k])
        labels = [at]
        for came in reversed(back):
            at = came[at]
            labels.append(at)
        count = Counter(labels)
        best = min(count, key=lambda k: (-count[k], k))
        out[d] = (names[best], count[best] / len(labels))
    return out


def op10_found(text):
    text, out = text or "", []
    kinds = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    for k, pattern in enumerate(kinds):
        for m in re.finditer(pattern, text):
            d = re.sub(r"[^0-9]", "", m[0])
            if k == 0 or (k == 1 and all(int(p) <= 255 for p in m[0].split("."))) or (k == 2 and 12 <= len(d) <= 19 and luhn(d)) or (k == 3 and 9 <= len(d) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def op10_spans(docs, disclosure, support, reach, classes=False):
    """doc_id -> spans. docs: (doc_id, text)."""
    import math

    term = re.compile(r"[^\W\d_]{3,}")
    entity_texts, term_texts, both_texts, contexts = defaultdict(set), defaultdict(list), defaultdict(set), defaultdict(set)
    free = lambda m, base: all(m.end() <= a or m.start() >= b for a, _, b in base)
    for _, t in docs:
        for w in {m[0].lower() for m in term.finditer(t or "")}:
            term_texts[w].append(t)
    for t in {t or "" for _, t in docs}:
        base = op10_found(t)
        near = [m for m in term.finditer(t) if free(m, base)]
        for a, k, b in base:
            name = (k, t[a:b].lower() if k == 0 else t[a:b] if k == 1 else re.sub(r"[^0-9]", "", t[a:b]))
            around = [m[0].lower() for m in near if m.end() <= a][-reach:] + [m[0].lower() for m in near if m.start() >= b][:reach]
            kin = ("class", k, [lambda v: v.split("@")[1], lambda v: ".".join(v.split(".")[:3]), lambda v: v[:6], lambda v: v[:-4]][k](name[1])) if classes else name
            for x in {name, kin}:
                entity_texts[x].add(t)
                for w in set(around):
                    both_texts[x, w].add(t)
                    contexts[x, w].add(tuple(around))
    n, told = max(2, len(docs)), set()
    for (name, w), texts in both_texts.items():
        content = math.log(n / len(entity_texts[name]))
        if len(contexts[name, w]) >= support and content > 0 and math.log(n * len(texts) / (len(entity_texts[name]) * len(set(term_texts[w])))) >= disclosure * content - 1e-12:
            told.add(w)
    out = {}
    for d, t in docs:
        base = op10_found(t)
        for m in re.finditer(r"[A-Za-z0-9]+", t or ""):
            kinds = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", "0", m[0]))
            if len(m[0]) >= 16 and len(set(m[0])) >= 8 and len(kinds) > 1 and (m[0] == m[0].upper() or len(kinds) > 3) and free(m, op10_found(t)):
                base.append((m.start(), 4, m.end()))
        spans = sorted(base + [(m.start(), 5, m.end()) for m in term.finditer(t or "") if m[0].lower() in told and free(m, base)])
        out[d] = ",".join(f"{('email', 'ip', 'card', 'phone', 'secret', 'term')[k]}:{a}:{b}" for a, k, b in spans)
    return out


def first_fit_decreasing(lengths, capacity):
    """The number of bins of another packing."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        for k, g in enumerate(gaps):
            if g >= n:
                gaps[k] -= n
                break
        else:
            gaps.append(capacity - n)
    return len(gaps)


def rebuilt(rows, family=100, most=6):
    """rows: (conv_id, turn, role, text). Each conversation as the contract of op11 rebuilds it: conv_id -> list of (role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, *digests(role or "", text or ""), role or "", text or ""))
    own = {c: [t[-2:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        out[c] = own.get(c - int(math.fmod(c, family)), [])[:h] + turns[h:]
    return out


def digests(role, text):
    """Spark's xxhash64 of (role, text) and of (text, role, 1), signed: the order of turns with the same number."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    h = xxhash.xxh64_intdigest
    a = h(text.encode(), h(role.encode(), 42))
    b = h((1).to_bytes(4, "little"), h(role.encode(), h(text.encode(), 42)))
    return signed(a), signed(b)


def op11(conversations):
    """conv_id -> list of turns. (conv_id, depth) -> the other columns."""
    members = defaultdict(list)
    for c, turns in sorted(conversations.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(own) - 1) * len(p[-1][1]) if p else 0
    out = {}
    for p, own in members.items():
        ends = ",".join(str(c) for c in own if len(conversations[c]) == len(p))
        out[own[0], len(p)] = (members[p[:-1]][0] if p else None, len(own), children[p], leaves[p], saved[p], sha(ends))
    return out


SPLIT12 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def op12_base(text, phrases):
    words = re.findall(SPLIT12, low(text))
    at = [(i, label) for phrase, label in phrases for n in [len(phrase.split())] for i in range(len(words) - n + 1) if words[i : i + n] == phrase.split()]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def op12_matches(words, templates, least):
    """templates: lists of words, phrases among them as (words, False). (template, start, end, at) of every match."""

    def longest(i):
        for n in range(i + 1, 0, -1):
            part = words[i + 1 - n : i + 1]
            ends = {(k, j + n) for k, (t, _) in enumerate(templates) for j in range(len(t) - n + 1) if t[j : j + n] == part}
            if ends:
                return n, {e for e in ends if templates[e[0]][1]}
        return 0, set()

    known = [longest(i) for i in range(len(words))] + [(0, set())]
    return {(k, i + 1 - n, i + 1, e - n) for i, (n, ends) in enumerate(known[:-1]) if n >= least for k, e in ends if known[i + 1][0] != n + 1 or (k, e + 1) not in known[i + 1][1]}


def runs(words, least=12):
    """(start, length, period) of every run, from all pairs of equal words at each distance."""
    out, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        j = 0
        while j + q < n:
            s = j
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - s + q >= max(least, 2 * q):
                out.setdefault((s, j - s + q), q)  # distances ascend, so the first is the smallest period
            j += j == s
    return sorted((s, n, q) for (s, n), q in out.items())


def op13(doc_id, text, looped=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if looped and doc_id is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = runs(words)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(kept))
