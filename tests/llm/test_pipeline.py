"""The pipeline's stages against brute-force versions."""

from collections import defaultdict

import pytest
import tokenizers

import corpus_pipeline
from duowave.llm import simhash

from .helpers import FOLDER, corpus, frame, groups_brute, removed_brute, words

STAGE = dict(corpus_pipeline.STAGES)


def test_order_of_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_dedup", "substring_dedup", "source_mix", "token_ids"]


@pytest.mark.parametrize("name", ["quality_rules", "simhash_dedup", "substring_dedup", "source_mix"])
def test_stages_keep_the_columns(spark, name):
    docs = frame(spark)
    out = STAGE[name](spark, docs, FOLDER)
    assert out.dtypes == docs.dtypes
    assert STAGE[name](spark, docs.limit(0), FOLDER).count() == 0
    assert set(r["doc_id"] for r in out.collect()) <= set(r[0] for r in corpus())


def test_substring_stage(spark):
    got = {(r["doc_id"], r["text"]) for r in STAGE["substring_dedup"](spark, frame(spark), FOLDER).collect()}
    rows = corpus()
    want = {(r[0], r[1] if not gone else kept) for r, (_, n, gone, kept) in zip(rows, removed_brute(rows)) if not gone or gone < n}
    assert got == want
    assert all(r["n_chars"] == len(r["text"]) for r in STAGE["substring_dedup"](spark, frame(spark), FOLDER).collect()
               if r["text"] and r["doc_id"] is not None and r["doc_id"] != 9)


def test_run(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = STAGE["simhash_dedup"](spark, STAGE["quality_rules"](spark, docs, FOLDER), FOLDER)
    good = {r["doc_id"]: r["text"] for r in STAGE["quality_rules"](spark, docs, FOLDER).collect()}
    order = sorted(good)
    groups = defaultdict(list)
    for i, g in zip(order, groups_brute([simhash.fingerprint(good[i].encode()) for i in order])):
        groups[g].append(i)
    survivors = {min(v) for v in groups.values()}
    assert {r["doc_id"] for r in kept.collect()} == survivors
    texts = {i: kept for (i, n, gone, kept) in removed_brute([(i, good[i]) for i in sorted(survivors)]) if not gone or gone < n}
    import public_tokenizers
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in corpus_pipeline.run(spark, FOLDER).collect():
        # Joining words by one space changes no token.
        assert r["token_ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(r["token_ids"]) and words(texts[r["doc_id"]])
