"""Prefix trie, periodic runs and license scans against plain versions and hostile rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from brute import WORD, sha
from traitlens.llm import license_scan, periodic_runs, prefix_trie

# ---- trie -------------------------------------------------------------------------------------


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, mark, (role, text)))
    own = {c: [x[3] for x in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        rebuilt[conv] = own.get(conv - conv % 20, [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for conv in sorted(rebuilt):
        path = tuple(rebuilt[conv])
        for d in range(len(path) + 1):
            members[path[:d]].append(conv)
        ends[path].append(conv)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        if node:
            kids[node[:-1]] += 1
    for node in sorted(members, key=len, reverse=True):
        leaves[node] += not kids[node]
        saved[node] += (len(members[node]) - 1) * len(WORD.findall(node[-1][1])) if node else 0
        if node:
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), kids[n], leaves[n], saved[n], sha(",".join(map(str, ends[n])))) for n, m in members.items()
    )


TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]
                     + [T.StructField(c, T.StringType()) for c in ("key", "depth", "n", "conv", "path", "words", "parent")])


def trie_of(spark, rows, **bounds):
    df = spark.createDataFrame([(*r, *["x"] * 7) for r in rows], TURNS).repartition(3)
    if bounds:
        keyed = prefix_trie.trie(prefix_trie.with_family_heads(prefix_trie.conversations(df)), **bounds)
        return sorted((r.conv, r.depth, r.n, r.children, r.leaves, r.saved, r.ends_sha256) for r in keyed.collect())
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in prefix_trie.trie_nodes(df).collect())


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(8)
    rows = []
    for conv in range(160):
        shared = rng.random() < 0.5
        for turn in range(rng.randint(1, 7)):
            word = f"hello there {turn}" if shared and turn < rng.randint(1, 6) else f"own {rng.randint(0, 3)} word {turn}"
            rows.append((conv, turn, "user" if turn % 2 == 0 else "bot", word))
    rows += [(200, t, "user", f"long {t}") for t in range(300)] + [(201, t, "user", f"long {t}") for t in range(300)]
    rows += [(c, t, "user", "copy of all") for c in range(300, 500) for t in range(3)]
    rows += [(600, 0, None, None), (600, None, "user", None), (600, 1, "", ""), (601, 0, "a", "bc"), (602, 0, "ab", "c"), (603, 3, "x", "y"), (603, 3, "x", "y"), (603, 3, "x", "a")]
    rows += [(None, 0, "user", "nobody's"), (None, None, None, None), (681, 0, "user", "only turn")]
    return rows


def test_trie_equals_plain_version(spark_llm, turns):
    assert trie_of(spark_llm, turns) == plain_trie(turns)


def test_trie_does_not_depend_on_where_levels_are_split(spark_llm, turns):
    some = [r for r in turns if r[0] is None or r[0] < 200]
    one, two = trie_of(spark_llm, some, upper_levels=1), trie_of(spark_llm, some, upper_levels=2, subtree_turns=20)
    assert one == two == sorted((r[0], r[1], *r[3:]) for r in plain_trie(some))


def test_trie_of_no_turns(spark_llm):
    assert trie_of(spark_llm, []) == []
    assert trie_of(spark_llm, [(None, 1, "user", "text")]) == []


# ---- runs -------------------------------------------------------------------------------------


def plain_runs(words):
    n, out, known = len(words), [], {}
    ids = np.asarray([known.setdefault(w, len(known)) for w in words], int)
    for p in range(1, n // 4 + 1):
        i = 0
        if np.count_nonzero(ids[p:] == ids[:-p]) < max(6 - p, 3 * p):
            continue
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(6, 4 * p):
                part = words[i : i + length]
                if not any(part[q:] == part[:-q] for q in range(1, p)):
                    out.append((i, length, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_document(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(runs), *figures, sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_runs_equal_definition():
    rng = random.Random(3)
    for _ in range(600):
        k, n = rng.choice([1, 2, 2, 3, 5, 30]), rng.randint(0, 90)
        words = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            a, p = rng.randrange(max(1, n)), rng.randint(1, 12)
            for i in range(a, min(n, a + p * rng.randint(2, 7) + rng.randint(0, 3))):
                words[i] = words[a + (i - a) % p]
        text = " ".join(map(str, words))
        assert periodic_runs.judged(None, text) == plain_document(None, text)


def test_trees_answer_extensions_and_order():
    rng = random.Random(5)
    for _ in range(60):
        seq = [rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randint(1, 40))]
        order, least = periodic_runs.SuffixTree(np.asarray(seq)).tour()
        assert order.tolist() == sorted(range(len(seq) + 1), key=lambda i: seq[i:])
        right = periodic_runs.Extensions(order, least)
        pairs = [(i, j) for i in range(len(seq) + 1) for j in range(len(seq) + 1) if i != j]
        common = lambda i, j: next((k for k in range(len(seq)) if i + k >= len(seq) or j + k >= len(seq) or seq[i + k] != seq[j + k]), len(seq))
        a, b = np.asarray(pairs).T
        assert right.of(a, b).tolist() == [common(i, j) for i, j in pairs]


def test_long_stretches_and_many_words():
    words = [f"w{i}" for i in range(30_000)]
    words[4_000:] = [words[4_000 + i % 1_700] for i in range(26_000)]
    n_runs, start, length, period, milli, *_ = periodic_runs.judged(None, " ".join(words))
    assert (n_runs, start, length, period, milli) == (1, 4_000, 26_000, 1_700, 15_294)
    assert periodic_runs.judged(None, "a " * 50_000)[:5] == (1, 0, 50_000, 1, 50_000_000)
    ids = np.arange(12) % 3
    assert periodic_runs.stretches(ids, 3) == periodic_runs.stretches(ids, 3_000_000) == [(0, 12)]


def test_runs_of_hostile_rows(docs, rows, no_docs):
    found = sorted((tuple(r) for r in periodic_runs.periodic_runs(docs).collect()), key=repr)
    assert found == sorted(((d, *plain_document(d, t)) for d, t in rows), key=repr)
    assert periodic_runs.periodic_runs(no_docs).count() == 0


# ---- licenses ---------------------------------------------------------------------------------

SAMPLES = [
    (1, "x Under the MIT-License y under\nthe mit license. (CC BY NC) cc by nc cc by nc"),
    (2, "apache license, version 2 and Apache License version 20 and apache license version 2.0"),
    (3, "Intro. " + license_scan.TEMPLATES["mit"][0] + " then more"),
    (4, "Intro. " + license_scan.TEMPLATES["bsd"][0].replace("source and", "any source or") + " then more"),
    (5, "free of charge to nobody, under the license, permission is not granted"),
    (6, " ".join(license_scan.TEMPLATES["gpl"][0].split()[:14])),
    (7, "cc by"), (8, "cc by né cc by nc"), (9, None), (10, ""), (11, "... ---"), (None, "under the mit license"), (None, None),
    (12, "copy under the mit license copy"), (12, "copy under the mit license copy"), (13, "copy under the mit license copy"),
    (14, "cc by nc " * 500 + "word " * 20_000 + license_scan.TEMPLATES["unlicense"][0]),
]


def plain_base(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for label, phrase in license_scan.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def by_text(spark, samples, **options):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())] + [T.StructField(c, T.StringType()) for c in ("key", "spans", "gram", "template", "f")])
    df = spark.createDataFrame([(d, t, *["x"] * 5) for d, t in samples], schema).repartition(3)
    return sorted((tuple(r) for r in license_scan.licenses(df, **options).collect()), key=repr)


def test_base_places_are_exact(spark_llm):
    found = by_text(spark_llm, SAMPLES)
    assert [(r[0], *r[1:6]) for r in found] == sorted([(d, *plain_base(t)) for d, t in SAMPLES], key=lambda r: repr((r[0], *r[1:])))
    assert all(set(filter(None, r[5].split(","))) <= set(r[6].split(",")) and 0 <= r[7] <= 1 for r in found)


def test_edited_templates_are_found_by_their_diagonals(spark_llm):
    found = {r[0]: r for r in by_text(spark_llm, [s for s in SAMPLES if s[0] is not None])}
    assert found[3][6:] == ("mit", 1.0)
    assert found[4][6] == "bsd" and 0.6 <= found[4][7] < 1
    assert found[5][6:] == ("", 0.0) and found[6][6:] == ("", 0.0)
    assert found[14][6] == "cc-by-nc,unlicense" and found[14][2] == 500
    strict = {r[0]: r for r in by_text(spark_llm, [s for s in SAMPLES if s[0] == 4], least_share=1.0)}
    assert strict[4][6] == ""


def test_licenses_of_hostile_rows(docs, rows, no_docs):
    found = sorted((tuple(r)[:6] for r in license_scan.licenses(docs).collect()), key=repr)
    assert found == sorted(((d, *plain_base(t)) for d, t in rows), key=repr)
    assert license_scan.licenses(no_docs).count() == 0
