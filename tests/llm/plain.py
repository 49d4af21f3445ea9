"""Plain versions of the corpus operators, for small inputs."""

import hashlib
import math
import re
import unicodedata  # noqa: F401
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def smallest_by_group(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def vectors(rows, cosine=0.98):
    """{id: (links, component)}"""
    unit = {}
    for i, x, label in rows:
        if label is None or not x or any(v is None for v in x) or not np.isfinite(np.array(x, float)).all() or not any(x):
            continue
        v = np.array(x, float)
        unit[i] = (label, v / np.linalg.norm(v))
    ids = [i for i, _, _ in rows]
    links = [
        (a, b) for a in unit for b in unit if a < b and unit[a][0] == unit[b][0] and len(unit[a][1]) == len(unit[b][1]) and unit[a][1] @ unit[b][1] >= cosine
    ]
    count = Counter(i for pair in links for i in pair)
    return {i: (count[i], c) for i, c in smallest_by_group(ids, links).items()}


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def jaccard(rows, percent=75):
    """{id: (set size, component)}"""
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both * 100 >= percent * len(sets[a] | sets[b]):
                links.append((a, b))
    return {i: (len(sets[i]), c) for i, c in smallest_by_group(ids, links).items()}


def line_dedup(rows, size=3):
    """{id: text}, rows in order of id"""
    seen, out = set(), {}
    for i, text in sorted(rows):
        if text is None:
            out[i] = None
            continue
        lines = text.split("\n")
        gone = set()
        for at in range(len(lines) - size + 1):
            window = tuple(lines[at : at + size])
            if not re.search(r"[^\x20\x09-\x0D]", "".join(window)):
                continue
            if window in seen:
                gone.update(range(at, at + size))
            seen.add(window)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def license_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    places = [(i, label) for i in range(len(words)) for phrase, label in PHRASES.items() if tuple(words[i : i + len(phrase)]) == phrase]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def digits(value):
    return re.sub("[^0-9]", "", value)


KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(digits(v)) <= 19 and luhn(digits(v))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(digits(v)) <= 15),
)


def personal(text):
    return [f"{kind}:{m.start()}:{m.end()}" for kind, pattern, ok in KINDS for m in re.finditer(pattern, text or "") if ok(m.group())]


def common_subsequence(left, right):
    row = [0] * (len(right) + 1)
    for a in left:
        before = 0
        for j, b in enumerate(right, 1):
            before, row[j] = row[j], before + 1 if a == b else max(row[j], row[j - 1])
    return row[-1]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    values = [row[0], row[3], row[2], row[4], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """Root of a list of hashes and the siblings (left, right) of each on the way up."""
    paths = [[] for _ in nodes]
    spans = [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        up, over = [], []
        for at in range(0, len(nodes), 3):
            run = nodes[at : at + 3]
            for k in range(len(run)):
                for i in spans[at + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(sha("".join(run)))
            over.append(sum(spans[at : at + 3], []))
        nodes, spans = up, over
    return (nodes or [None])[0], paths


def manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of rows (doc_id, text, lang, source, n_chars)."""
    by_source = {}
    for row in rows:
        by_source.setdefault(row[3], []).append((row[0] is not None, row[0] or 0, leaf(row, row[1]), row))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in sources}
    root, tops = tree([trees[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops):
        subroot, paths = trees[s]
        for (_, _, own, row), path in zip(sorted(by_source[s], key=lambda x: x[:3]), paths):
            tampered = row[0] is not None and row[1] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            h = leaf(row, row[1].replace("\n", "")) if tampered else own
            for left, right in path + top:
                h = sha(left + h + right)
            out.append((row[0], own, subroot, root, sha("".join(a + b for a, b in path + top)), h, h == root))
    return out


def runs(words, least_words=24, least_repeats=3):
    """All (start, length, period) by trying every period."""
    found = {}
    for q in range(1, len(words) // least_repeats + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least_words, least_repeats * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def run_row(doc_id, text):
    """The row of the periodic-run query."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    gone = {i for a, length, q in found for i in range(a + q, a + length)}
    return (
        doc_id,
        len(found),
        *best,
        1000 * best[1] // best[2] if found else None,
        sha("".join(f"{a},{b},{c}\n" for a, b, c in found)),
        sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def walked(text, classes, jumps, cycle):
    """The step at which each character is reached, and the steps in all, one by one."""
    t, out = 0, []
    for c in classes:
        out.append(t)
        t += int(jumps[int(c) * cycle + t % cycle])
    return out, t


def kneser_ney(texts):
    """Two smoothed bigram models of (text, toxic) pairs, word by word; returns text -> log-likelihood ratios of its words."""
    split = lambda text: re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", text.lower())
    one, two = [Counter(), Counter()], [Counter(), Counter()]
    for text, toxic in texts:
        w = split(text)
        one[not toxic].update(w)
        two[not toxic].update(zip(w, w[1:]))
    one.append(one[0] + one[1])
    two.append(two[0] + two[1])

    def smaller(counter):
        n = [sum(1 for c in counter.values() if c == k) for k in (1, 2, 3, 4)]
        by = {k: k / 2 for k in (1, 2, 3)}
        if all(n):
            share = n[0] / (n[0] + 2 * n[1])
            by = {k: min(max(k - (k + 1) * share * n[k] / n[k - 1], 0.1), 0.98 * k) for k in (1, 2, 3)}
        return lambda c: c - by[min(c, 3)] if c else 0.0

    less1, less2 = [smaller(c) for c in one], [smaller(c) for c in two]
    total = [sum(c.values()) for c in one]
    bin_of = lambda c: c if c < 4 else 4 + int(math.log2(c / 4))
    mass, lost = Counter(), [Counter(), Counter()]
    for w, c in one[2].items():
        mass[bin_of(c)] += c
        for k in (0, 1):
            lost[k][bin_of(c)] += one[k][w] - less1[k](one[k][w])
    contexts = Counter(b for _, b in two[2])
    left = sum(c - less1[2](c) for c in one[2].values()) / total[2]
    every = sum(contexts.values()) + 0.5 * (len(one[2]) + 1)

    def tilt(k, w):
        c = one[2][w]
        if c == 0:
            return 1.0
        own = less1[k](one[k][w]) + (lost[k][bin_of(c)] + 0.5) / mass[bin_of(c)] * c
        return own / total[k] / (c / total[2])

    after = [Counter(), Counter(), Counter()]
    for k in range(3):
        for (a, _), c in two[k].items():
            after[k][a] += less2[k](c)
    spare = lambda k, w: max(1 - after[k][w] / one[k][w], 1e-6) if one[k][w] else 1.0

    def likelihood(k, a, b):
        shared = less1[2](one[2][b]) / total[2] + left * (contexts[b] + 0.5) / every
        own = lambda j: less2[j](two[j][a, b]) / max(one[j][a], 1)
        return own(k) + spare(k, a) * (own(2) + spare(2, a) * shared) * tilt(k, b)

    def ratios(text):
        w = split(text)
        first = [math.log(tilt(0, w[0]) / tilt(1, w[0]))] if w else []
        return first + [math.log(likelihood(0, a, b) / likelihood(1, a, b)) for a, b in zip(w, w[1:])]

    return ratios
