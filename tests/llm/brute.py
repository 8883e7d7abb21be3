"""Plain Python versions of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NOT_SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op6(docs, k=13):
    words = [(d, NOT_SPACE.findall(t or "")) for d, t in docs]
    least = {}
    for d, w in words:
        for i in range(len(w) - k + 1):
            x = tuple(w[i : i + k])
            least[x] = min(least.get(x, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - k + 1):
            if least[tuple(w[i : i + k])] < d:
                gone.update(range(i, i + k))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out)


def op9(docs, items):
    index = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        for s in range(max(1, len(w) - 7)) if w else ():
            index[tuple(w[s : s + 8])] |= set() if i is None else {str(i)}
    lengths = {len(x) for x in index}
    out = []
    for d, t in docs:
        w, hit, found = ALNUM.findall((t or "").translate(LOWER)), set(), set()
        for s in range(len(w)):
            for n in lengths:
                x = tuple(w[s : s + n])
                if len(x) == n and x in index:
                    hit.update(range(s, s + n))
                    found |= index[x]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), len(found) >= 2))
    return sorted(out)


def op2(docs):
    sets = {}
    for d, t in docs:
        w = NOT_SPACE.findall((t or "").translate(LOWER))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    by_set, where = defaultdict(list), defaultdict(list)
    for d, s in sets.items():
        by_set[s].append(d)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = sorted((find(a), find(b)))
        parent[b] = a

    for s, ds in by_set.items():
        if s:
            for d in ds[1:]:
                join(ds[0], d)
            for x in s:
                where[x].append(s)
    common = Counter()
    for group in where.values():
        for i, a in enumerate(group):
            for b in group[i + 1 :]:
                common[a, b] += 1
    both = Counter()
    for (a, b), n in common.items():
        both[(a, b) if min(by_set[a]) < min(by_set[b]) else (b, a)] += n
    for (a, b), n in both.items():
        if 100 * n >= 75 * (len(a) + len(b) - n):
            join(by_set[a][0], by_set[b][0])
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets.items())


def op4_base(text):
    w = NOT_SPACE.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if NOT_SPACE.search(line):
            dup += line in seen
            seen.add(line)
    count = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = set()
    for i in range(len(w) - 2):
        if count[tuple(w[i : i + 3])] > 1:
            rep.update(range(i, i + 3))
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(rep), n < 50 or 100 * len(rep) > 50 * n


def op8(docs, templates, window=8, stride=4, least=0.8):
    """Every window of every text against every template, without bands; the same places and neighbourhoods."""
    word = re.compile(r"[^\W_]+")
    pairs = lambda w: {(a, b) for a, b in zip(w, w[1:])}  # noqa: B905, E731
    forms = {k: word.findall(v.lower()) for k, v in templates.items()}
    out = []
    for d, t in docs:
        w, found = word.findall((t or "").lower()), {}
        for at in range(1, max(len(w) - 1, 1) + 1, stride):
            own = pairs(w[at - 1 : at - 1 + window])
            for k, f in forms.items():
                if own & pairs(f):
                    lo, n = max(1, at - len(f)), window + 2 * len(f)
                    share = len(pairs(f) & pairs(w[lo - 1 : lo - 1 + n])) / len(pairs(f))
                    if share >= least:
                        found[k] = max(found.get(k, 0), share)
        out.append((d, len(found), ",".join(sorted(found)), max(found.values(), default=0.0)))
    return sorted(out)


def op4_kept(rows, floors, cutoff=49.0):
    """rows: (lang, source, base_failed, statistics or None) to kept; estimates by group in plain loops, many random starts."""
    floors, p = np.array(floors), len(floors)
    groups = defaultdict(list)
    for i, (lang, source, _, x) in enumerate(rows):
        if x is not None:
            groups[lang, source, False].append(i)
    for key in [k for k, v in groups.items() if len(v) <= p + 1]:
        groups[key[0], None, True] += groups.pop(key)

    def inverse(m):
        value, vector = np.linalg.eigh(m)
        value = np.maximum(value, 1)
        return vector @ np.diag(1 / value) @ vector.T, np.log(value).sum()

    def mcd(x, rng):
        half, found = (len(x) + p + 1) // 2, []
        middle = np.median(x, axis=0)
        starts = [(middle, np.diag((1.4826 * np.median(abs(x - middle), axis=0)) ** 2))]
        starts += [(y.mean(axis=0), np.cov(y.T, bias=True)) for y in (x[rng.choice(len(x), p + 1, replace=False)] for _ in range(100))]
        for c, s in starts:
            for _ in range(40):
                d = np.array([(r - c) @ inverse(s)[0] @ (r - c) for r in x])
                near = x[np.argsort(d, kind="stable")[:half]]
                c, s = near.mean(axis=0), 1.913 * np.cov(near.T, bias=True)
                if found and abs(inverse(s)[1] - found[-1]) < 1e-12:
                    break
                found.append(inverse(s)[1])
            yield inverse(s)[1], c, s

    rng, own = np.random.default_rng(77), {}
    for key, at in groups.items():
        if len(at) > p + 1:
            x = np.array([rows[i][3] for i in at]) / floors
            _, c, s = min(mcd(x, rng), key=lambda r: r[0])
            own[key] = (len(at), c, s)

    def pool(parts):
        n = np.array([q[0] for q in parts], float)
        c = sum(w * q[1] for w, q in zip(n, parts)) / n.sum()
        s = sum(w * (q[2] + np.outer(q[1] - c, q[1] - c)) for w, q in zip(n, parts)) / n.sum()
        return n.sum(), c, s

    def lean(a, b):
        if a is None or b is None:
            return a or b
        w = a[0] / (a[0] + 30)
        return a[0], w * a[1] + (1 - w) * b[1], w * a[2] + (1 - w) * b[2]

    langs = {k: pool([v for g, v in own.items() if g[0] == k]) for k in {g[0] for g in own}}
    top = pool(list(langs.values())) if langs else None
    small = {k for k, v in Counter((r[0], r[1]) for r in rows if r[3] is not None).items() if v <= p + 1}
    out = []
    for lang, source, failed, x in rows:
        if failed or x is None:
            out.append(False)
            continue
        model = lean(own.get((lang, None, True) if (lang, source) in small else (lang, source, False)), lean(langs.get(lang), top))
        d = 0.0
        if model:
            z = np.array(x) / floors - model[1]
            d = z @ inverse(model[2])[0] @ z
        out.append(bool(d <= cutoff))
    return out


def op5(learn, texts, d, sharpness):
    """(lang_pred, score) of texts by plain loops: `learn` has (text, lang)."""
    letters = {}

    def letter(c):
        if c not in letters:
            letters[c] = np.random.default_rng([20, ord(c)]).integers(0, 2, d, dtype=np.int8).astype(float) * 2 - 1
        return letters[c]

    def bundle(text):
        low = [(c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or ""]
        padded, count = [" ", *low, " "], Counter()
        for i in range(1, len(padded) - 1):
            if padded[i] != " ":
                count["".join(padded[i - 1 : i + 2])] += 1
        v = np.zeros(d)
        for (a, b, c), n in count.items():
            v += math.log1p(n) * np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
        size = math.sqrt((v * v).sum())
        return v / size if size else v

    sums = defaultdict(lambda: np.zeros(d))
    for t, lang in learn:
        sums[lang] += bundle(t)
    names = sorted(sums)
    unit = lambda m: m / np.sqrt((m * m).sum(axis=1, keepdims=True))
    table = unit(np.array([sums[k] for k in names]))
    table = unit(table - table.mean(axis=0))
    out = []
    for t in texts:
        v = bundle(t)
        z = np.exp(sharpness * (table @ v))
        out.append((names[int(z.argmax())], float(z.max() / z.sum())) if v.any() else ("und", 0.0))
    return out


def op10_features(text):
    """The classifier's features of one text, byte by byte."""
    data = (text or "").encode()
    small, large, digit, mark = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"-()"
    kind = lambda b: 0 if b in b" \t\n\x0b\x0c\r" else 1 if b in small or b >= 128 else 2 if b in large else 3 if b in digit else 4 if b in mark else 5
    words = [x.encode() for x in NOT_SPACE.findall(text or "")]
    n, out = max(len(words), 1), [0.0] * 216
    for w in words:
        out[(kind(w[0]) * 6 + kind(w[max(len(w) - 2, 0)])) * 6 + kind(w[-1])] += 1
    out = [math.sqrt(x / n) for x in out]
    each, chars, repeats = Counter(map(kind, data)), max(len(data), 1), op4_base(text)[4]
    out += [math.log1p(len(words)) / 5, float(bool(words)), *[math.sqrt(each[k] / chars) for k in range(1, 6)], len(data) / n / 10]
    out += [math.sqrt(x / n) for x in (data.count(b"\n"), repeats, each[5], each[2])]
    share = [0.0] * 8
    share[sum(repeats / n > e for e in (0.0, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75))] = 1.0
    length = [0.0] * 16
    length[min(int(math.log2(len(words) + 1)), 15)] = 1.0
    return out + share + length
