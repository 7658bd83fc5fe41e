"""Plain single-process versions of the operators, for comparison on small tables."""

from __future__ import annotations

import collections
import hashlib
import math
import re
from fractions import Fraction

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = " \t\n\x0b\x0c\r"


def words(text):
    return WORD.findall(text or "")


# ---- line dedup -------------------------------------------------------------------------------

def line_key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACES))


def line_dedup(rows, min_docs=10):
    """rows: (doc_id, text) -> [(doc_id, n_lines, n_dropped, kept_text)]"""
    seen = collections.defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            seen[line_key(line)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if line_key(x) == "" or len(seen[line_key(x)]) < min_docs]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


# ---- substring dedup --------------------------------------------------------------------------

def order(doc_id):
    return (1, 0) if doc_id is None else (0, doc_id)


def substring_dedup(rows, n=13):
    """rows: (doc_id, text) -> [(doc_id, n_words, n_removed, kept_text)]"""
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - n + 1):
            k = tuple(w[i:i + n])
            if k not in first or order(d) < first[k]:
                first[k] = order(d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i:i + n])] < order(d):
                gone[i:i + n] = [True] * n
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


# ---- n-gram Jaccard ---------------------------------------------------------------------------

def shingles(text, n=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n \
        else frozenset([tuple(w)])


def near_duplicates(rows, threshold=Fraction(4, 5), n=5):
    """rows: (doc_id, text) with distinct ids -> {doc_id: (class_id, n_links)}"""
    sets = {d: shingles(t, n) for d, t in rows}
    ids = sorted(sets)
    links, root = collections.Counter(), {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            union = len(sets[a] | sets[b])
            if sets[a] and sets[b] and Fraction(len(sets[a] & sets[b]), union) >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (find(d), links[d]) for d in ids}


# ---- quality rules ----------------------------------------------------------------------------

def base_statistics(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = set()
    for i in range(len(w) - 4):
        if windows[tuple(w[i:i + 5])] > 1:
            covered.update(range(i, i + 5))
    return {"n_words": len(w), "word_chars": sum(map(len, w)),
            "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"),
            "n_dup_lines": len(lines) - len(set(lines)), "n_lines": len(lines),
            "n_repeat_words": len(covered)}


def chi2_cdf(x, dof):
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def chi2_quantile(p, dof=4):
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, dof) < p else (low, mid)
    return high


def scatter(x, words_, lines, core=0.75, steps=5):
    """Concentration steps over integer vectors (of 1 / 4096), from quartiles. No deviation is below
    the chance noise at the median numbers of words and lines."""
    at = max(0, math.ceil(0.5 * len(x)) - 1)
    w, n = sorted(words_)[at], sorted(lines)[at]
    floors = np.array([0.5 / math.sqrt(w + 30), 1 / math.sqrt(w + 20), 0.5 / math.sqrt(n + 3),
                       math.sqrt(10) / 2 / math.sqrt(w + 20)])
    factor = core / chi2_cdf(chi2_quantile(core), 6)
    q = [np.sort(x, axis=0)[max(0, math.ceil(p * len(x)) - 1)] for p in (0.25, 0.5, 0.75)]
    mean = q[1] / 4096
    inverse = np.diag(1 / np.maximum(floors, (q[2] - q[0]) / (1.349 * 4096)) ** 2)
    for _ in range(steps):
        gap = x / 4096 - mean
        bins = np.floor(64 * np.log(1 + np.minimum(np.einsum("ij,jk,ik->i", gap, inverse, gap), 1e12)))
        nearer = np.searchsorted(np.sort(bins), bins)
        own = x[nearer < core * len(x)]
        mean = own.sum(0) / len(own) / 4096
        cov = (own.T @ own) / len(own) / 4096 ** 2 - np.outer(mean, mean)
        cov = cov * factor + np.diag(floors ** 2)
        inverse = np.linalg.inv(cov)
    return len(x), mean, cov


def judge(rows, prior=50.0, alpha=1e-6):
    """rows: (doc_id, text, lang, source) -> [(doc_id, base_failed, kept)]"""
    stats, vectors, units = [], {}, {}
    for i, (d, t, lang, source) in enumerate(rows):
        s = base_statistics(t)
        failed = s["n_words"] < 10 or 100 * s["n_repeat_words"] > 20 * s["n_words"]
        stats.append(failed)
        if not failed:
            n = s["n_words"]
            v = [math.log((s["word_chars"] + 150) / (n + 30)), math.sqrt(s["n_symbols"] / (n + 20)),
                 math.sqrt(s["n_dup_lines"] / (s["n_lines"] + 3)),
                 math.sqrt(s["n_repeat_words"] / (n + 20))]
            units[i] = (n, s["n_lines"])
            vectors[i] = np.array([math.floor(abs(y) * 4096 + 0.5) * (1 if y >= 0 else -1) for y in v])
    groups = collections.defaultdict(list)
    for i in vectors:
        for key in ((), (rows[i][2],), (rows[i][2], rows[i][3])):
            groups[key].append(i)
    fits = {k: scatter(np.array([vectors[i] for i in own]), *zip(*[units[i] for i in own]))
            for k, own in groups.items()}

    def lean(fit, above):
        share = fit[0] / (fit[0] + prior)
        return (fit[0], share * fit[1] + (1 - share) * above[1], share * fit[2] + (1 - share) * above[2])

    langs = {k: lean(f, fits[()]) for k, f in fits.items() if len(k) == 1}
    own = {k: lean(f, langs[k[:1]]) for k, f in fits.items() if len(k) == 2}
    out = []
    for i, (d, _, lang, source) in enumerate(rows):
        kept = False
        if i in vectors:
            _, mean, cov = own[(lang, source)]
            gap = vectors[i] / 4096 - mean
            kept = bool(gap @ np.linalg.inv(cov) @ gap <= chi2_quantile(1 - alpha))
        out.append((d, stats[i], kept))
    return out


# ---- mixing -----------------------------------------------------------------------------------

def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def targets(sizes, weights=(5, 2, 1), share=Fraction(3, 2), cap=2):
    """{source: size} -> {source: target}, by repeated clamping and sharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    clamped, total = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in clamped]
        left = total - sum(clamped.values())
        over = [s for s in open_ if left * weight[s] >= cap * sizes[s] * sum(weight[x] for x in open_)]
        if not over:
            return clamped | {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        clamped |= {s: Fraction(cap * sizes[s]) for s in over}


def mix(rows, **kw):
    """rows: (doc_id, text, source) with distinct ids -> {doc_id: (whole, extra)}"""
    size = {d: len(words(t)) for d, t, _ in rows}
    sizes = collections.Counter()
    for d, _, s in rows:
        sizes[s] += size[d]
    goal = targets(dict(sizes), **kw)
    out = {}
    for source in sizes:
        whole = int(goal[source] // sizes[source]) if sizes[source] else 0
        room = math.floor(float(goal[source])) - whole * sizes[source]
        own = [d for d, _, s in rows if s == source]
        for d in sorted(own, key=lambda d: (md5(f"mix-{'null' if d is None else d}"), d or 0)):
            extra = max(0, min(room, size[d]))
            out[d] = (whole, extra)
            room -= size[d]
    return out


# ---- sharding ---------------------------------------------------------------------------------

def shard(doc_id, n):
    key = "null" if doc_id is None else str(doc_id)
    scores = [(-1 / math.log((int(md5(f"{key}-{s}")[:13], 16) + 0.5) / 16 ** 13), s) for s in range(n)]
    return max(scores)[1]
