"""The pipeline on the smallest tables against plain Python, stage by stage."""

import zlib
from collections import Counter

import brute
import corpus_pipeline
import numpy as np
import pytest

from traitlens.llm import language_id
from traitlens.llm.common import settle
from traitlens.llm.queries import tokenizer_path

SMALL = "/root/testdata/sf0.001"


def redacted(text):
    out, at = "", 0
    for start, _, end, _ in brute.secrets(text):
        if start >= at:
            out += text[at:start] + "[REDACTED]"
        at = max(at, end)
    return out + text[at:]


@pytest.fixture(scope="module")
def docs(spark_llm):
    return spark_llm.read.parquet(f"{SMALL}/documents.parquet")


def test_stages_match_plain_versions(spark_llm, docs):
    model = language_id.train(docs)
    judged = {r["doc_id"]: r for r in language_id.predicted(docs, model).collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    want = [(d, t) for d, t in rows if judged[d]["lang_pred"] != "und" and judged[d]["score"] >= corpus_pipeline.LEAST_LANGUAGE_SCORE]
    assert len(want) > 0.95 * len(rows)

    now = settle(corpus_pipeline.identify_languages(spark_llm, docs, SMALL))
    assert sorted((r["doc_id"], r["text"]) for r in now.collect()) == want

    want = [row for row, (smallest, _) in zip(want, brute.links(want)) if row[0] == smallest]
    now = settle(corpus_pipeline.drop_near_duplicates(spark_llm, now, SMALL))
    assert sorted((r["doc_id"], r["text"]) for r in now.collect()) == want

    items = [tuple(r) for r in spark_llm.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    want = [row for row, (n, hit, _) in zip(want, brute.contamination(want, items)) if not (hit and 20 * hit >= n)]
    now = settle(corpus_pipeline.drop_contaminated(spark_llm, now, SMALL))
    assert sorted((r["doc_id"], r["text"]) for r in now.collect()) == want

    want = [(d, redacted(t)) for d, t in want]
    now = settle(corpus_pipeline.redact_secrets(spark_llm, now, SMALL))
    assert now.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in now.collect()) == want
    assert all(r["n_chars"] == len(r["text"]) for r in now.collect())

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    pieces = Counter()
    for d, t in want:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = np.asarray(ids[at : at + 4096], "<u4")
            pieces[d, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    packed = corpus_pipeline.pack_sequences(spark_llm, now, SMALL).collect()
    assert Counter(tuple(r)[:5] for r in packed) == pieces


def test_repeated_rows_and_missing_ids(spark_llm, docs):
    some = docs.limit(40)
    odd = some.unionByName(some).unionByName(some.limit(3).selectExpr("cast(null as long) as doc_id", "concat(text, ' another') as text", "lang", "source", "n_chars"))
    kept = corpus_pipeline.drop_near_duplicates(spark_llm, odd, SMALL)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert len(ids) == len(set(ids))
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark_llm, none, SMALL).count() == 0


def test_verdicts_hold_for_rows_not_ids(spark_llm, docs):
    texts = [r["text"] for r in docs.where("length(text) > 400").orderBy("doc_id").limit(60).collect()]
    item = spark_llm.read.parquet(f"{SMALL}/benchmark.parquet").where("length(text) > 200").orderBy("item_id").first()["text"]
    base = texts[:8]
    # Near copies and benchmark texts under NULL and shared ids, among unrelated texts with the same ids.
    rows = [(None if k % 2 else 7, t) for k, t in enumerate(texts)]
    rows += [(i, t + " one more word") for t in base for i in (None, 7, 3)] + [(None, item), (7, item + " end")]
    rows += [(None, " "), (None, " "), (7, " "), (7, None), (7, None)]
    odd = spark_llm.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "length(text) as n_chars")

    # Against brute force: groups by row numbers, of each the smallest id with NULL last.
    worded = [r for r in rows if brute.shingles(r[1])]
    groups = {}
    for k, (group, _) in enumerate(brute.links([(k, t) for k, (_, t) in enumerate(worded)])):
        groups.setdefault(group, []).append(worded[k][0])
    smallest = Counter(min(ids, key=lambda i: (i is None, i or 0)) for ids in groups.values())
    now = settle(corpus_pipeline.drop_near_duplicates(spark_llm, odd, SMALL))
    kept = [(r["doc_id"], r["text"]) for r in now.collect()]
    assert Counter(d for d, t in kept if brute.shingles(t)) == smallest
    assert Counter(r for r in kept if not brute.shingles(r[1])) == Counter([(None, " "), (7, " "), (7, None)])
    groups_kept = Counter(group for group, _ in brute.links([(k, t) for k, (_, t) in enumerate(r for r in kept if brute.shingles(r[1]))]))
    assert set(groups_kept.values()) == {1} and len(groups_kept) == len(groups)

    items = [tuple(r) for r in spark_llm.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    want = Counter(r for r, (n, hit, _) in zip(rows, brute.contamination(rows, items)) if not (hit and 20 * hit >= n))
    assert len(rows) - sum(want.values()) >= 2 and sum(want.values()) > len(base)
    clean = corpus_pipeline.drop_contaminated(spark_llm, odd, SMALL)
    assert Counter((r["doc_id"], r["text"]) for r in clean.collect()) == want
    assert clean.columns == odd.columns


def test_stage_list_is_in_the_order_agreed():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "secrets", "packing"]
