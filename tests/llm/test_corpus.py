"""Operators that look across documents, against plain versions."""

import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from brute import invented
from pyspark.sql import functions as F

from traitlens.llm import bin_packing, common, components, jaccard_join, language_id, positional_index, substring_dedup, toxicity
from traitlens.llm.common import settle
from traitlens.llm.queries import tokenizer_path
from traitlens.llm.word_hash import text_hashes, windows

WORDS = tokenizer_path("word_bpe_49k.json")


def bag(rows):
    return Counter(tuple(r) for r in rows)


def test_contamination(spark_llm, docs, no_docs, rows, item_rows):
    items = spark_llm.createDataFrame(item_rows, "item_id long, text string").withColumn("shard", F.lit("x"))
    want = bag((d, n, hit, ",".join(found)) for (d, _), (n, hit, found) in zip(rows, brute.contamination(rows, item_rows)))
    for block_bytes in (positional_index.BLOCK_BYTES, 60):
        found = positional_index.contamination(docs, items, block_bytes=block_bytes)
        got = bag((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"])) for r in found.collect())
        assert got == want
    assert positional_index.contamination(no_docs, items).count() == 0
    assert positional_index.contamination(docs, items.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_proximity_stays_in_one_document(spark_llm):
    df = spark_llm.createDataFrame([(1, "red x x blue"), (2, "red"), (3, "blue y red"), (4, "red x x x x blue")], "doc_id long, text string").coalesce(1)
    index = positional_index.build_index(df)
    shared = spark_llm.sparkContext.broadcast({"q": ("red", "blue")})
    found = {(r["doc_id"], r["position"]) for r in positional_index.search_near(index, shared, 3).collect()}
    assert found == {(1, 3), (3, 0)}  # places of the rarer term


def test_dedup(docs, no_docs, rows):
    want = brute.dedup(rows)
    found = substring_dedup.kept_words(docs).collect()
    text = defaultdict(list)
    for d, t in rows:
        text[d].append(t)
    assert len(found) == len(rows)
    with_id = [r for r in found if r["doc_id"] is not None]
    assert bag(with_id) == bag((d, *want[d, t]) for d, t in rows if d is not None)
    assert bag(tuple(r)[1:] for r in found if r["doc_id"] is None) == bag(want[None, t] for t in text[None])
    assert substring_dedup.kept_words(no_docs).count() == 0


def test_dedup_orders_by_id_and_keeps_text(spark_llm):
    passage = " ".join(f"w{i}" for i in range(25))
    df = spark_llm.createDataFrame([(9, f"a {passage} b"), (2, f"c {passage} d"), (5, f"{passage} {passage}")], "doc_id long, text string")
    found = {r["doc_id"]: r["kept_text"] for r in substring_dedup.deduplicated(df).collect()}
    assert found == {2: f"c {passage} d", 9: "a b", 5: ""}


def test_levels_lose_nothing():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 6, 400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    levels = substring_dedup._Levels(words, 20)
    for length in (5, 10):
        seeds = levels.seeds(length)
        for k in range(len(levels.whole)):
            inside = seeds[(seeds >= k) & (seeds <= k + 20 - length)]
            assert levels.places[length][inside].min() == levels.chosen[length][k]
    assert (levels.whole == windows(words, 20)).all()


def test_jaccard(docs, no_docs, rows):
    want = bag((d, c, n) for (d, _), (c, n) in zip(rows, brute.links(rows)) if d is not None)
    found = jaccard_join.similar_documents(docs).collect()
    assert bag(r for r in found if r["doc_id"] is not None) == want
    assert len(found) == len(rows)
    assert jaccard_join.similar_documents(no_docs).count() == 0


def test_jaccard_reads_settled_rows_again(docs, rows):
    numbered = settle(docs.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text"))
    as_rows = lambda **o: bag(jaccard_join.similar_documents(numbered, **o).collect())
    assert as_rows(unique_ids=True) == as_rows()


def test_jaccard_splits_large_buckets(docs, rows, monkeypatch):
    monkeypatch.setattr(jaccard_join, "_UNIT", 3)
    want = bag((d, c, n) for (d, _), (c, n) in zip(rows, brute.links(rows)) if d is not None)
    assert bag(r for r in jaccard_join.similar_documents(docs).collect() if r["doc_id"] is not None) == want


def test_jaccard_reads_one_text_per_class_where_ids_repeat(spark_llm, monkeypatch):
    rng = random.Random(6)
    rows = []
    for i in range(60):
        words = invented(rng, 60).split()
        near = [*words[:-1], "other"]
        rows += [(None if i % 2 else 8, " ".join(words)), (None if i % 3 else 8, " ".join(near))]
    read = []
    join = jaccard_join.join_small
    monkeypatch.setattr(jaccard_join, "join_small", lambda *a, **k: read.append(join(*a, **k)) or read[-1])
    found = jaccard_join.similar_documents(spark_llm.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["n_links"] for r in found) == sorted(n for _, n in brute.links(rows))
    assert [x.count() for x in read] == [120]


def test_posterior_is_a_beta_tail():
    rng = np.random.default_rng(0)
    draws = rng.beta(13, 5, 200_000)
    assert abs(jaccard_join.posterior(12, 16, 0.8) - (draws >= 0.8).mean()) < 0.01


def test_components(spark_llm):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    found = {r["node"]: r["component"] for r in components.components(spark_llm.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def test_packing(docs, no_docs, rows, tokenizer):
    capacity = 256
    found = bin_packing.pack(docs, WORDS, capacity).toPandas()
    by_bin = found.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    for _, one in by_bin:
        assert (one["offset"] == one["length"].cumsum() - one["length"]).all() and one["length"].sum() <= capacity
    want = Counter()
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = np.asarray(ids[at : at + capacity], "<u4")
            want[-1 if d is None else d, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    got = found.fillna({"doc_id": -1})
    assert Counter(zip(got["doc_id"].astype(int), got["piece"], got["start"], got["length"], got["ids_crc32"])) == want
    least = -(-int(found["length"].sum()) // capacity)
    assert found["sequence_id"].nunique() <= least + 1
    assert bin_packing.pack(no_docs, WORDS).count() == 0


def test_words_of_a_text_give_its_ids(tokenizer):
    ids, rng = bin_packing.word_ids(WORDS), random.Random(1)
    odd = [" ", "\n", "\x1c", "\x85", "\xa0", "​", "é", "İ", "İ", "ß", "漢字", "'s", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "<|start", "of", "12", "ΑΣ", "foo.", "B,", ".", "😀", "\x00", "ǅ"]
    for _ in range(1500):
        text = "".join(rng.choice(odd) for _ in range(rng.randint(0, 8)))
        assert np.frombuffer(ids.of([text])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_words_of_letters_need_the_model_only(tokenizer, monkeypatch):
    """Every letter of Latin-1, lowered or not, apart and within words, with and without signs at the end."""
    ids = bin_packing.WordIds(WORDS)
    letters = "".join(chr(c) for c in range(0x41, 0x100) if chr(c).isalpha() and c not in (0xAA, 0xB5, 0xBA))
    ids.of([". , ... !?"])
    text = " ".join([*letters, letters, letters.replace("ÿ", "").upper(), "Straße naïve. çà, été... ÀÉ!?"])
    want = tokenizer.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(ids, "_joined", None)
    assert np.frombuffer(ids.of([text])[0], "<u4").tolist() == want
    ids.forget()
    assert not ids.known and not ids.earlier


def test_workers_give_memory_back(monkeypatch):
    """Freed memory goes to the system at the end of a task, also of one that fails."""
    import psutil

    blocks = [bytes(2_000 + i % 3) for i in range(100_000)]
    held = blocks[-1:] + blocks[::1_000]
    del blocks
    before = psutil.Process().memory_info().rss
    common.give_back()
    assert before - psutil.Process().memory_info().rss > 100e6 and len(held) == 101
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    assert list(common.lean(lambda batches: (2 * b for b in batches))(iter([1, 2]))) == [2, 4] and len(calls) == 1
    with pytest.raises(ZeroDivisionError):
        list(common.lean(lambda batches: (1 // b for b in batches))(iter([1, 0])))
    assert len(calls) == 2


def test_fullest_is_optimal():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(rng.randint(0, 6))}
        room = rng.randint(0, 60)
        sums = {0}
        for x, n in counts.items():
            sums |= {s + k * x for s in sums for k in range(n + 1) if s + k * x <= room}
        chosen = bin_packing.fullest(room, counts)
        assert sum(chosen) == max(sums) and all(chosen.count(x) <= counts[x] for x in chosen)


def test_plan_uses_every_length_once():
    histogram = {700: 1_000_003, 4096: 5, 3000: 77, 1096: 100, 1: 10}
    plan = bin_packing.plan_bins(histogram)
    used = Counter()
    for combination, bins in plan:
        assert sum(combination) <= 4096
        for x in combination:
            used[x] += bins
    assert dict(used) == histogram and len(plan) <= 20


@pytest.fixture(scope="module")
def small(spark_llm):
    return "/root/testdata/sf0.01"


def test_language_accuracy(spark_llm, small):
    docs = spark_llm.read.parquet(f"{small}/documents.parquet")
    model = language_id.train(docs)
    assert model.languages == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    found = language_id.predicted(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    held = found.where("crc32(cast(doc_id as string)) % 4 = 2")
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98
    odd = spark_llm.createDataFrame([(None, None), (1, ""), (2, "12 !?"), (3, "x" * 600_000), (3, "the of and")], "doc_id long, text string")
    odd = odd.withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit("clash"))
    by_id = sorted(((r["doc_id"], r["lang_pred"] == "und", 0 <= r["score"] <= 1) for r in language_id.predicted(odd, model).collect()), key=str)
    assert by_id == sorted([(None, True, True), (1, True, True), (2, True, True), (3, False, True), (3, False, True)], key=str)
    assert language_id.accepted(odd, model, 0.0).columns == odd.columns
    assert language_id.accepted(odd, model, 0.0).count() == 2


@pytest.mark.parametrize("shared", [None, 3, 8])
def test_language_sample_where_ids_repeat(spark_llm, shared):
    rng = random.Random(2)
    rows = [(shared, f"{invented(rng, 8)} number{i}", "en") for i in range(3000)] + [(100_000 + i, f"mot {i} {invented(rng, 8)}", "fr") for i in range(3000)]
    rows += [(shared, "one and the same", "en")] * 1500 + [(200_000 + i, "dieser Text", "de") for i in range(3)]
    df = spark_llm.createDataFrame(rows, "doc_id long, text string, lang string")
    sizes = {r["lang"]: r["n"] for r in language_id.training_vectors(df, 300).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert 120 <= sizes["en"] <= 420 and 200 <= sizes["fr"] <= 420 and sizes["de"] >= 1


def test_language_without_labels(spark_llm):
    df = spark_llm.createDataFrame([(1, "text here", None)], "doc_id long, text string, lang string")
    model = language_id.train(df)
    assert [tuple(r) for r in language_id.predicted(df, model).collect()] == [(1, "und", 0.0)]
    one = spark_llm.createDataFrame([(1, "text here", "xx"), (2, "more", "xx")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.predicted(one, language_id.train(one)).collect()} == {"xx"}


def test_toxicity_accuracy(spark_llm):
    docs, labels = (spark_llm.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.scored(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 4 = 2")
    counts = {(r["toxic"], r["p"]): r["n"] for r in found.groupBy("toxic", (F.col("score") >= 0.3).alias("p")).agg(F.count("*").alias("n")).collect()}
    assert counts[1, True] / (counts[1, True] + counts[1, False]) > 0.9
    assert counts.get((0, True), 0) / (counts[0, False] + counts.get((0, True), 0)) < 0.01


def test_toxicity_edge_rows(spark_llm, docs, rows):
    none = spark_llm.createDataFrame([], "doc_id long, toxic int")
    found = toxicity.scored(docs, toxicity.train(docs, none)).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    labels = spark_llm.createDataFrame([(1, 1), (1, None), (None, 0), (999_999, 1), (3, 0), (3, 0)], "doc_id long, toxic int")
    assert toxicity.scored(docs.limit(0), toxicity.train(docs, labels)).count() == 0
    insult = spark_llm.createDataFrame([(1, "you idiot"), (2, "you there")], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.scored(insult, toxicity.lexicon_scorer()).collect()}
    assert scores[1] > 0.3 > scores[2]


def test_label_model_discounts_copied_voters():
    rng = np.random.default_rng(5)
    truth = rng.random(4000) < 0.3
    a = np.where(rng.random(4000) < 0.8, truth, ~truth)
    b = np.where(rng.random(4000) < 0.7, truth, ~truth)
    noisy = np.where(rng.random(4000) < 0.9, truth, ~truth)
    votes = np.column_stack([a, a, a, b, noisy, ~noisy]).astype(float)
    model = toxicity.fit_label_model(votes, noisy.astype(int))
    assert np.allclose(model.weight[:3], 1 / 3, atol=0.05) and model.weight[3] > 0.8
    assert model.in_toxic[0] > 0.6 > model.in_clean[0]


def test_word_hashes_follow_words():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["ab", "c", "dé", "\tx", "yy\n"]) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", "  ", "x" * 3_000_000, "a b " * 400_000]
    known = {}
    for text, hashes in zip(texts, text_hashes(texts), strict=True):
        words = text.encode().split()
        assert len(words) == len(hashes)
        for word, h in zip(words[:500], hashes[:500].tolist()):
            assert known.setdefault(word, h) == h
    assert len(set(known.values())) == len(known)
