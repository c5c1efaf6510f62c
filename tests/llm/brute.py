"""Plain versions of the operators' results, written from the contracts."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def invented(rng, n):
    stock = "the of and to in er th on an re he ti en at ed nd ha or es is it st ar te se le al de la".split()
    return " ".join("".join(rng.choice(stock) for _ in range(rng.randint(1, 3))) for _ in range(n))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    seen, repeated_lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated_lines += line in seen
            seen.add(line)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if counts[w] > 1 for j in range(3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated_lines, len(covered), n < 50 or 100 * len(covered) > 50 * n


def secrets(text):
    """(start, order, end, kind) of the base kinds."""
    text, found = text or "", []
    either = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    for m in re.finditer(rf"""({either})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end(), "assign"))
    for order, kind, pattern, least in ((1, "access", "AKIA[A-Z0-9]+", 20), (2, "hex", "[0-9a-f]+", 24)):
        found += [(m.start(), order, m.end(), kind) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(found)


def contamination(docs, items, window=13):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    words_of = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for item, text in items:
        words = words_of(text)
        for k in range(max(1, len(words) - window + 1) if words else 0):
            windows[tuple(words[k : k + window])].add(item)
    out = []
    for _, text in docs:
        words, hit, found = words_of(text), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= {x for x in windows[tuple(words[k : k + n])] if x is not None}
        out.append((len(words), len(hit), sorted(map(str, found))))
    return out


def dedup(docs, window=20):
    """By (id, text); documents come in the order of their ids, NULL last."""
    seen, out = {}, {}
    for doc, text in sorted(set(docs), key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest())):
        words, gone = WORD.findall(text or ""), set()
        for k in range(len(words) - window + 1):
            if tuple(words[k : k + window]) in seen:
                gone.update(range(k, k + window))
            seen.setdefault(tuple(words[k : k + window]), (doc, k))
        out[doc, text] = len(words), len(gone), sha(" ".join(w for k, w in enumerate(words) if k not in gone))
    return out


def shingles(text, size=5):
    words = WORD.findall(text or "")
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1)))


def links(docs, threshold=0.8):
    """(class id, number of links) per row."""
    sets = [shingles(t) for _, t in docs]
    near = [[] for _ in docs]
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and 10 * common >= round(10 * threshold) * len(a | sets[j]):
                near[i].append(j)
                near[j].append(i)
    out = []
    for i in range(len(docs)):
        reach, todo = {i}, [i]
        while todo:
            new = set(near[todo.pop()]) - reach
            reach |= new
            todo += new
        out.append((min((docs[k][0] for k in reach if docs[k][0] is not None), default=None), len(near[i])))
    return out
