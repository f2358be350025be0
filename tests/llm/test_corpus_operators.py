"""Operators on documents: awkward rows, brute force, libraries and SQL."""

import hashlib
import math
import random
import time
import textwrap
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

import __spark_entry__ as contract
from compare import database, difference
from duowave.llm import backtracking, components, licenses, merges, mixing, ppm, quality, simhash, substrings
from duowave.llm.registry import ORACLES, QUERIES

from .helpers import FOLDER, corpus, frame, groups_brute, ppm_brute, removed_brute, table, words

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_result_as_sql(spark, name):
    got = contract.queries()[name](spark, FOLDER).toPandas()
    assert difference(got, database(FOLDER).execute(ORACLES[name]).df()) is None


def test_every_operator_is_registered():
    assert [sum(q.startswith(f"op{n}_") for q in contract.queries()) for n in range(1, 11)] == [1] * 10
    assert "pipeline" in contract.queries()


# 1: substring dedup


def test_cover_has_every_shift_once():
    substrings.check_cover(substrings.PERIOD, substrings.COVER)
    with pytest.raises(ValueError):
        substrings.check_cover(31, (0, 1, 3))


def test_removed_words(docs):
    got = docs.transform(substrings.remove_repeats).select("id", "n_words", "n_removed", "kept_text").collect()
    assert plain(got) == plain(removed_brute(corpus()))


def test_removed_words_with_frequent_anchors(docs, monkeypatch):
    monkeypatch.setattr(substrings, "FREQUENT_COUNT", 3)
    monkeypatch.setattr(substrings, "REPORTED_COUNT", 2)
    got = substrings.remove_repeats(docs).select("id", "n_words", "n_removed", "kept_text").collect()
    assert plain(got) == plain(removed_brute(corpus()))


def test_spans_and_carried_columns(docs):
    for r in substrings.remove_repeats(docs, carry=["id", "row", "doc_id"]).collect():
        gone = [i for s in r["removed"] for i in range(s["start"], s["stop"])]
        kept = [w for i, w in enumerate(words(r["text"])) if i not in set(gone)]
        assert len(gone) == len(set(gone)) == r["n_removed"] and " ".join(kept) == r["kept_text"]
        assert r["row"]["doc_id"] == r["id"]


def test_other_window(docs):
    got = substrings.remove_repeats(docs, window=12, period=7, cover=(0, 1, 3)).select("id", "n_words", "n_removed", "kept_text")
    assert plain(got.collect()) == plain(removed_brute(corpus(), 12))


# 2: quality rules


def test_base_statistics():
    for text in [r[1] for r in corpus()] + ["a b c a b c", "x x x x", "a\n a\na\na\n\n \n"]:
        w, t = words(text), text or ""
        triples = Counter(zip(w, w[1:], w[2:]))
        covered = {k + s for k in range(len(w) - 2) if triples[tuple(w[k:k + 3])] > 1 for s in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        marks = sum(c.isascii() and c.isprintable() and not c.isalnum() and c != " " for c in t)
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered),
                len("".join(w).encode()), marks, sum(len(x.encode()) <= 3 for x in w), len(set(w)))
        assert quality.base_statistics(t.encode()) == want


def _robust_brute(vectors):
    """Rows, centre and scatter by concentration steps on whole arrays, from the same start."""
    step = quality.GRID // quality.VALUE_BINS
    value = (vectors // step + 0.5) / quality.VALUE_BINS

    def middle(v):
        return np.sort(v)[int(np.ceil(len(v) / 2)) - 1]

    floor = np.eye(4) / 12 / quality.GRID**2
    centre = np.array([middle(v) for v in value.T])
    scatter = np.diag([(1.4826 * middle(np.abs(v - c))) ** 2 for v, c in zip(value.T, centre)]) + floor
    x = vectors / quality.GRID
    for _ in range(quality.STEPS):
        distances = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(scatter), x - centre)
        bins = np.floor(np.log2(1 + np.maximum(distances, 0)) * quality.DISTANCE_BINS)
        inner = bins <= np.sort(bins)[min(int(np.ceil(quality.SUPPORT * len(x))), len(x)) - 1]
        centre, scatter = x[inner].mean(axis=0), quality.CONSISTENCY * np.cov(x[inner].T, bias=True) + floor
    return len(x), centre, scatter


def _with_rows_of(own, larger):
    """Mean and covariance of a sample that has rows of both estimates."""
    (n, c, s), (m, d, t) = own, larger
    m = min(m, quality.PRIOR_ROWS)
    mean = (n * c + m * d) / (n + m)
    return n + m, mean, (n * (s + np.outer(c - mean, c - mean)) + m * (t + np.outer(d - mean, d - mean))) / (n + m)


def test_verdicts_equal_whole_array_estimates_on_all_levels(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn(
        "source", F.when(F.col("source") != "src3", F.col("source")))
    got = quality.quality_verdicts(docs).toPandas()
    stats = quality.with_statistics(quality._packed(docs, "text", "lang", "source", id=docs["doc_id"])).toPandas()
    stats[["lang", "source"]] = stats[["lang", "source"]].fillna("?")
    fit = stats[(stats.n_words >= 50) & (100 * stats.n_repeat_words <= 50 * stats.n_words)]
    vector = ["x0", "x1", "x2", "x3"]
    different = fit.drop_duplicates(["lang", "source", *vector])
    general = _robust_brute(different[vector].to_numpy())
    want = {}
    for lang, here in different.groupby("lang"):
        by_lang = _with_rows_of(_robust_brute(here[vector].to_numpy()), general)
        for source, group in here.groupby("source"):
            n, centre, scatter = _with_rows_of(_robust_brute(group[vector].to_numpy()), by_lang)
            rows = fit[(fit.lang == lang) & (fit.source == source)]
            gap = rows[vector].to_numpy() / quality.GRID - centre
            d = np.einsum("ij,jk,ik->i", gap, np.linalg.inv(scatter), gap)
            want |= dict(zip(rows.id, zip(d, np.broadcast_to(quality.f_point(quality.REJECT, np.array([n]))[0], len(d)))))
    assert set(got[~got.base_failed].id) == set(want)
    for r in got.itertuples():
        if r.id in want:
            d, cutoff = want[r.id]
            assert r.distance2 == pytest.approx(d, rel=1e-6, abs=1e-9) and r.cutoff == pytest.approx(cutoff, rel=1e-9)
            assert r.kept == (d <= cutoff)


def test_point_of_distances():
    # The tail of F(4, 20) is the beta function's; of many rows it becomes that of chi-square.
    f = quality.f_point(1e-3, np.array([24]))[0] / (4 * (24 * 24 - 1) / (24 * 20))
    x = 20 / (20 + 4 * f)
    assert x**10 * (1 + 10 * (1 - x)) == pytest.approx(1e-3, rel=1e-9)
    assert quality.f_point(1e-5, np.array([10**7]))[0] == pytest.approx(quality.chi2_point(1e-5, 4), rel=1e-4)


def test_constant_estimate_gives_other_verdicts(spark):
    """The estimates of the groups decide, not only the cut."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    stats = quality.with_statistics(quality._packed(docs, "text", "lang", "source", id=docs["doc_id"])).persist()
    estimates = quality.fit_estimates(stats).persist()
    constant = estimates.orderBy("g_lang", "g_source").limit(1).select("centre", "precision", "cutoff").first()
    same = estimates.select("g_lang", "g_source", F.lit(constant["cutoff"]).alias("cutoff"),
                            F.array(*map(F.lit, constant["centre"])).alias("centre"),
                            F.array(*map(F.lit, constant["precision"])).alias("precision"))
    one, other = (quality.judge(stats, e).where("NOT base_failed").select("id", F.col("kept").alias(n)) for e, n in ((estimates, "a"), (same, "b")))
    assert one.join(other, "id").where("a <> b").count() > 20


def test_verdicts_follow_the_labels(spark):
    folder = "/root/testdata/sf0.01"
    got = quality.quality_verdicts(spark.read.parquet(f"{folder}/documents.parquet")).toPandas().merge(
        table("labels", folder), left_on="id", right_on="doc_id")
    judged = got[~got.base_failed]
    assert (judged.kept == (judged.quality == 1)).mean() > 0.98
    assert not got[got.base_failed].kept.any()


def test_quality_takes_awkward_rows(spark, docs):
    got = quality.quality_verdicts(docs).collect()
    assert len(got) == len(corpus()) and all(r["base_failed"] for r in got if r["n_words"] < 50)
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.quality_verdicts(docs.limit(0)).count() == 0 and quality.keep_good(docs.where("n_chars < 5")).count() == 0


def test_repetition_alone_is_rejected(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("aeiou") + rng.choice("rstlmn") for _ in range(rng.choice((1, 2, 2, 3)))) for _ in range(2000)]

    def prose(n):
        return " ".join(vocabulary[int(2000 * rng.random() ** 3)] for _ in range(n))

    # Lines of one word, in an order without a repeated triple: 60 of 65 lines are repeated, and no words.
    lines, seen = ["am"] * 3, {("am",) * 3}
    while len(lines) < 66:
        word = next(w for w in ("os", "ir", "en", "am") if (*lines[-2:], w) not in seen)
        seen.add((*lines[-2:], word))
        lines.append(word)
    rows = [(i, prose(rng.randint(60, 250))) for i in range(400)]
    # Repeated lines, a passage many times, both, then one repeated line among three and an ordinary text.
    rows += [(1000, "\n".join([prose(60), *lines])), (1001, prose(160) + " " + " ".join([prose(5)] * 24)),
             (1002, "\n".join([prose(80), *["ab cd"] * 30])), (1003, "\n".join([short := prose(3), prose(60), short])), (1004, prose(200))]
    df = spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")
    got = {r["id"]: r for r in quality.quality_verdicts(df).collect()}
    assert got[1000]["n_dup_lines"] == 62 and not any(got[i]["base_failed"] for i in (1000, 1001, 1002))
    assert not any(got[i]["kept"] for i in (1000, 1001, 1002))
    assert [r for i, r in got.items() if i not in (1000, 1001, 1002) and not r["kept"]] == []


# 3 and 7: tokens


def texts_with_oddities():
    rng = random.Random(3)
    letters = list("abcdeinrst  \n\tABZ0123'!?.,éüßñ▁ΣσİK你好́‍\x1c\x85\xa0🎉<>|")
    odd = ["".join(rng.choices(letters, k=rng.randint(1, 50))) for _ in range(800)]
    odd += ["<|startoftext|> hi <|endoftext|>x", "<s> </s><unk> <0x0A>", "it's we'LL", "ΑΣ ΟΔΟΣ", "a" * 700, " " * 70, "▁▁a ▁"]
    return odd + [r[1] or "" for r in corpus()] + table("documents").text.tolist()


def test_merge_counts_equal_the_library():
    counter = merges.MergeCounter(merges.pieces_of(open(PIECES, "rb").read()))
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = texts_with_oddities()
    assert [counter.count(t) for t in texts] == [len(x) for x in library.encode(texts)]


def test_encoding_and_decoding_equal_the_library():
    source = open(WORD_BPE).read()
    encoder, decoder, library = backtracking.WordEncoder(source), backtracking.OffsetTable(source), tokenizers.Tokenizer.from_file(WORD_BPE)
    texts = texts_with_oddities()
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        got = encoder.encode(text)
        assert got == want.ids
        assert decoder.decode(np.array(got, dtype=np.int32)).decode() == library.decode(want.ids, skip_special_tokens=False)


def test_token_columns_on_awkward_rows(docs):
    coded = backtracking.decode(backtracking.encode(docs, "text", WORD_BPE), "token_ids", WORD_BPE)
    counted = merges.token_counts(coded, "text", PIECES, out="N_WORDS")
    library, pieces = tokenizers.Tokenizer.from_file(WORD_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = counted.collect()
    assert len(rows) == len(corpus()) and "n_words" not in counted.columns
    for r in rows:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["token_ids"] == want and r["decoded"] == library.decode(want, skip_special_tokens=False)
        assert r["N_WORDS"] == len(pieces.encode(r["text"] or ""))
    assert backtracking.encode(docs.limit(0), "text", WORD_BPE).count() == 0


def test_query_digests(spark):
    library = tokenizers.Tokenizer.from_file(WORD_BPE)
    texts = dict(zip(table("documents").doc_id, table("documents").text))
    for r in QUERIES["op7_backtracking_bpe"](spark, FOLDER).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


# 4: scores


@pytest.mark.parametrize("order", [3, 5])
def test_scores_equal_brute_force(spark, docs, order):
    rows = [(r[0], (r[1] or "")[:900] if r[1] is not None else None) for r in corpus()]
    got = plain(ppm.ppm_scores(spark.createDataFrame(rows, "doc_id long, text string"), order=order, chunk_bytes=4000).collect())
    want = plain(ppm_brute(rows, order))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-8)


def test_scores_of_no_rows_and_no_training(spark, docs):
    assert ppm.ppm_scores(docs.limit(0)).count() == 0
    got = ppm.ppm_scores(spark.createDataFrame([(1, "ab")], "doc_id long, text string"), out_of_training=F.lit(True)).first()
    assert got["score"] == pytest.approx(-3 * math.log10(255)) and got["train_tokens"] == 0


# 6: licences


def test_licences(spark):
    mit = licenses.KNOWN[0][1]
    spelled = "Copyright (c) 2020 A B\n\n" + mit.upper().replace(",", " ;").replace("SUBLICENSE", "sub-licence")
    rows = [(1, mit), (1, mit), (2, spelled), (3, mit + " more"), (4, None), (5, ""), (6, "..."), (7, "x\nReleased under the MIT Licence!\ny"),
            (None, "Licensed under CC-BY 4.0"), (8, "© 1999\nAll rights reserved.\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit(1)).withColumn("digest", F.lit(2))
    got = plain((r["id"], r["license"], r["notices"]) for r in licenses.scan(df).collect())
    assert got == plain([(1, "MIT", []), (1, "MIT", []), (2, "MIT", []), (3, None, []), (4, None, []), (5, None, []), (6, None, []),
                         (7, None, ["MIT"]), (None, "CC-BY-4.0", ["CC-BY-4.0"]), (8, None, [])])
    assert licenses.scan(df.limit(0)).count() == 0
    own = spark.createDataFrame([("own", "Use it, whilst you can"), ("void", "")], "license string, text string")
    assert [r["license"] for r in licenses.scan(spark.createDataFrame([(1, "use it while you CAN.")], "doc_id long, text string"), own).collect()] == ["own"]


def test_licences_in_very_long_texts(spark):
    mit = licenses.KNOWN[0][1]
    rows = [(1, "Copyright (c) 2020 A B\n" * 1_000_000 + mit), (2, "Это не лицензия\n" * 1_000_000), (3, "©" * 3_000_000),
            (4, "Это не слова\n" * 200_000 + mit + "\n" * 200_000), (5, "copyright " * 300_000), (6, "Copyright\n" * 300_000)]
    start = time.monotonic()
    got = {r["id"]: (r["license"], r["notices"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", []), 2: (None, []), 3: (None, []), 4: ("MIT", []), 5: (None, []), 6: (None, [])}
    assert time.monotonic() - start < 60


def test_known_licences_at_any_line_width(spark):
    rows, want = [], []
    for width in (*range(12, 60, 7), 60, 66, 70, 72, 74, 76, 78, 79, 80, 100):
        for name, text in (*licenses.KNOWN, *licenses.TITLED):
            wrapped = "\n".join(textwrap.fill(x, width, break_long_words=False, break_on_hyphens=False) for x in text.split("\n"))
            for notice in ("", "Copyright (c) 2020 A B\n\n", "Copyright Acme Inc.\n# copyright 1999, 2001 by C\n"):
                rows.append((len(rows), notice + wrapped))
                want.append(name)
    isc = ("ISC License\n\nCopyright © 2020, A B\n\nPermission to use, copy, modify, and/or distribute this software for any\n"
           "purpose with or without fee is hereby granted, provided that the above\n"
           "copyright notice and this permission notice appear in all copies.\n\n") + licenses._ISC_WARRANTY
    rows.append((len(rows), isc))
    got = {r["id"]: r["license"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert [got[i] for i in range(len(rows))] == [*want, "ISC"]


# 8: near duplicates


def test_masks_cover_every_small_difference():
    rng = random.Random(1)
    masks = simhash.covering_masks(4)
    for _ in range(3000):
        difference = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
        assert any(not m & difference for m in masks)


def _prints(rng, n):
    seeds = [rng.getrandbits(64) for _ in range(n // 20)]
    out = set(seeds)
    for s in seeds:
        at = s
        for _ in range(19):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                at ^= 1 << b
            out.add(at)
    return sorted(out)


@pytest.mark.parametrize("limit", [4096, 2])
def test_links_connect_like_all_pairs(spark, limit):
    prints = _prints(random.Random(2), 400)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    found = components.connected_components(simhash.fingerprint_links(df, bucket_limit=limit)).collect()
    roots = {r["node"] % (1 << 64): r["root"] for r in found}
    groups, want = defaultdict(set), defaultdict(set)
    for p, g in zip(prints, groups_brute(prints)):
        want[g].add(p)
        groups[roots.get(p, ("alone", p))].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_near_duplicates_and_survivors(docs):
    rows = corpus()
    prints = [simhash.fingerprint((r[1] or "").encode()) for r in rows]
    groups = defaultdict(list)
    for r, g in zip(rows, groups_brute(prints)):
        groups[g].append(r)
    want = [(r[0], min((x[0] for x in rs if x[0] is not None), default=None)) for rs in groups.values() for r in rs]
    got = simhash.near_duplicates(docs)
    assert plain((r["id"], r["component"]) for r in got.collect()) == plain(want)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(
        (min((x[0] for x in rs if x[0] is not None), default=None) for rs in groups.values()), key=repr)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (7, 6)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}


# 9: mixing


def test_mix_of_awkward_rows(docs):
    rows = mixing.pareto_mix(docs, "doc_id", "source", mixing.word_count(docs["text"]), F.md5("text")).collect()
    assert len(rows) == len(corpus())
    sums, taken, target, largest = Counter(), Counter(), {}, Counter()
    for r in rows:
        assert 0 <= r["copies"] <= 2 and r["size"] <= r["source_size"]
        sums[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert sum(target.values()) == pytest.approx(min(1.5, 2.0) * sum(sums.values()))
    for s in sums:
        assert target[s] <= 2 * sums[s] + 1e-9 and abs(taken[s] - target[s]) <= largest[s]
    mixed = mixing.repeat_by_mix(docs, "doc_id", "source", mixing.word_count(docs["text"]), F.md5("text"))
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] for r in rows)
    assert mixing.pareto_mix(docs.limit(0), "doc_id", "source", mixing.word_count(docs["text"]), F.md5("text")).count() == 0


def test_mix_does_not_depend_on_bins_or_partitions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")

    def run(df, bins):
        return plain(mixing.pareto_mix(df, "doc_id", "source", mixing.word_count(df["text"]), F.md5("text"), bins=bins).collect())

    assert run(docs, 4096) == run(docs.repartition(7), 8) == run(docs, 2)


def test_equal_rows_at_the_end_are_taken_one_by_one(spark):
    text = "a b c d e f g h"
    rows = [(None, text, "a")] * 400 + [(i, text, "b") for i in range(100)] + [(7, None, "b"), (8, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.pareto_mix(df, "doc_id", "source", mixing.word_count(df["text"]), F.md5("text"), share_percent=70).toPandas()
    assert len(got) == len(rows)
    for source, part in got.groupby("source"):
        assert abs((part["size"] * part["copies"]).sum() - part["target"].iloc[0]) <= 4
    mixed = mixing.repeat_by_mix(df, "doc_id", "source", mixing.word_count(df["text"]), F.md5("text"), share_percent=70)
    assert mixed.where("text IS NOT NULL AND text <> ''").count() == got[got["size"] > 0]["copies"].sum()


def test_inclusion_frequencies_follow_the_probabilities(spark):
    sizes = [1, 2, 3, 5, 8, 13, 20, 40, 60, 100] * 12
    df = spark.createDataFrame([(i, "a", n, seed) for seed in range(150) for i, n in enumerate(sizes)],
                               "doc_id long, source string, n long, seed long")
    # Every seed is a source of equal weight, with its own draws.
    rows = df.select("doc_id", F.concat("source", F.lpad("seed", 3, "0")).alias("source"), "n", "seed")
    options = {"weights": (1,), "share_percent": 40}
    taken = mixing.pareto_mix(rows, "doc_id", "source", F.col("n"), F.col("seed"), **options).toPandas()
    assert (abs((taken["size"] * taken["copies"]).groupby(taken["source"]).sum() - taken.groupby("source")["target"].first()) <= 50).all()
    seen = taken.groupby("size")["copies"].mean()
    total = sum(sizes)
    classes = {n: 1 << n.bit_length() - 1 for n in sizes}
    wanted, certain = 0.4 * total, set()
    while True:
        c = (wanted - sum(n for n in sizes if n in certain)) / sum(n * classes[n] for n in sizes if n not in certain)
        over = {n for n in sizes if n not in certain and c * classes[n] >= 1}
        if not over:
            break
        certain |= over
    for n in set(sizes):
        p = 1.0 if n in certain else c * classes[n]
        assert seen[n] == pytest.approx(p, abs=4 * math.sqrt(p * (1 - p) / 1800) + 0.02), n
