"""Plain single-process versions of the word operators: spelling variants, tokens, phrases."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def spelling_words(rows, modulus=97):
    n = Counter()
    for d, t in rows:
        for run in map(ascii_lower, RUN.findall(t or "")):
            h = zlib.crc32(f"{'null' if d is None else d}:{run}".encode())
            if h % modulus == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            n[run] += 1
    return n


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def spelling_variants(rows, modulus=97, min_chars=5, min_count=3, ratio=2):
    """rows: (doc_id, text) -> {word: (form, root, n, n_near, form_n)}; every pair of words is compared."""
    n = {w: c for w, c in spelling_words(rows, modulus).items() if len(w) >= min_chars and c >= min_count}
    near, words = defaultdict(list), sorted(n)
    for i, a in enumerate(words):
        for b in words[i + 1:]:
            if abs(len(a) - len(b)) <= 1 and one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = {}
    for w, f in form.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (f, root, n[w], len(near[w]), n[f] if f else None)
    return out


def collocations(rows, longest=3, min_count=10, cover=50, top=2000):
    """rows: (lang, text) -> [(lang, rank, phrase, a, l, r, n, score)], every n-gram counted on its own."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", ascii_lower(text or "")):
            words = tuple(re.findall("[^ \t]+", piece))
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(words[i:i + k] for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) >= 2 and a >= min_count}
        covered = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    covered[p[i:i + k]] = max(covered[p[i:i + k]], a)
        ranked = []
        for p, a in found.items():
            if p in covered and 100 * covered[p] >= cover * a:
                continue
            cuts = [(1_000_000 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            ranked.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)
