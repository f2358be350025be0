"""Main text of pages and nearest neighbours."""

import html
import math
import re
import time

import numpy as np
import pytest

from duowave.llm import collisions, dom
from duowave.llm.registry import QUERIES

from .helpers import FOLDER, table


@pytest.fixture(scope="module")
def model():
    return dom.train(dom.labelled_pages())


def test_held_out_pages(model):
    right = total = 0
    for page in map(dom.Page, dom.labelled_pages(150, seed=11)):
        chance = dom.marginals(page, model)
        for node, _ in page.runs:
            total += 1
            right += (chance[node] > 0.5) == (page.label[node] == "1")
    assert right / total > 0.99


def test_marginals_equal_sums_over_all_states(model):
    source = ('<body><div class="menu"><a href="/">x y</a></div><article><h1>Some words here</h1><p>a b c, d e f. g</p>'
              '<div class="comments"><p>so so</p></div></article></body>')
    page = dom.Page(source)
    n = len(page.parent)
    own = []
    for i in range(n):
        p = 1 / (1 + math.exp(-model["bias"] - sum(model["weights"].get(f, 0.0) for f in dom.features(page, i))))
        own.append((1 - p, p))
    sums = np.zeros((n, 2))
    for state in range(1 << n):
        bits = [state >> i & 1 for i in range(n)]
        weight = own[0][bits[0]]
        for i in range(1, n):
            weight *= own[i][bits[i]] * model["pair"][bits[page.parent[i]]][bits[i]]
        for i in range(n):
            sums[i, bits[i]] += weight
    assert dom.marginals(page, model) == pytest.approx((sums[:, 1] / sums.sum(axis=1)).tolist())


def test_pages_of_the_table(spark):
    got = {r["page_id"]: r for r in QUERIES["op5_dom_model"](spark, FOLDER).collect()}
    pages = table("pages")
    assert len(got) == len(pages)
    for r in pages.itertuples():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1).replace("<br>", " ")
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", article))
        assert got[r.page_id]["text"] == "\n".join(b for b in blocks if b)
        assert got[r.page_id]["n_chars"] == len(got[r.page_id]["text"]) and got[r.page_id]["url"] == r.url


def test_awkward_pages(spark, model):
    long = "<article><h1>t</h1>" + "<p>Words of a long page, and more of them.</p>" * 3000 + "</article>"
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (None, "u", long), (3, "u", deep), (4, "u", "<" * 500), (5, "u", "<!-- a"),
            (6, "u", "<article><p>a &lt;b&gt; &amp; c&nbsp;d <script>no</script><style>p{}</style>\n e.<br>f</p><p>One, two.")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS id")
    got = dom.extract(df, model=model).collect()
    texts = {r["id"]: r["text"] for r in got}
    assert len(got) == len(rows) and texts[1] == "" and texts[2] == "" and texts[None].count("\n") == 3000
    assert texts[6] == "a <b> & c d e. f\nOne, two."
    assert dom.extract(df.limit(0), model=model).count() == 0


def test_omitted_optional_tags(model):
    top = "<title>No</title><meta charset=utf-8><style>p{}</style><script>var no;</script><noscript><img src=x></noscript>"
    words = "Words of an article, and more of them. " * 4
    inner = f"<article><h1>Title of it</h1><p>{words}</p><ul><li>One of the items, it is.</li><li>{words}</li></ul><p>{words}</p></article>"
    whole = dom.main_text(f"<!doctype html><html><head>{top}</head><body>{inner}</body></html>", model)
    assert whole.count("\n") == 4 and "No" not in whole and "var" not in whole
    for page in (f"<html><head>{top}<body>{inner}</body></html>", f"<html><head>{top}{inner}</html>", f"<head>{top}\n<body class=x>{inner}",
                 f"<html>{top}<body>{inner}", f"{top}{inner}", f"<head><body>{inner}", f"<html><head>{top}</head>{inner}",
                 f"<head>{top}<body>" + re.sub("</(p|li)>", "", inner)):
        assert dom.main_text(page, model) == whole, page[:80]
    # Text ends a head too; what can stand in it does not.
    runs = dom.Page("<head><title>no</title> Some words<p>more").runs
    assert ["".join(parts).strip() for _, parts in runs] == ["Some words", "more"]


def test_formulas_stay_in_their_sentence(model):
    text = "so that it is less than the others, as was shown before."
    page = (f"<html><body><article><p>Let <math display='inline'><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn><mspace/></mrow>"
            f"<annotation encoding='tex'>no</annotation></semantics></math> hold, {text}</p></article></body></html>")
    assert dom.main_text(page, model) == f"Let x=2 hold, {text}"


def _exact(ids, vectors, k=20, every=20):
    out = {}
    for i, v in zip(ids, vectors):
        if i % every == 0:
            scores = sorted(((-float(np.dot(v, w)), j) for j, w in zip(ids, vectors) if j != i))[:k]
            out[i] = [j for _, j in scores]
    return out


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_recall(spark, folder):
    e = table("embeddings", folder)
    vectors = np.array(e.embedding.tolist(), dtype=float)
    want = _exact(e.vec_id.tolist(), vectors) if len(e) <= 2000 else None
    got = QUERIES["op10_collision_counting"](spark, folder).toPandas().sort_values(["query_id", "rank"])
    by_id = dict(zip(e.vec_id, vectors))
    found = got.groupby("query_id").vec_id.apply(list)
    assert np.mean([len(set(found[i]) & set(j)) / 20 for i, j in want.items()]) >= 0.9
    for _, part in got.groupby("query_id"):
        assert part["rank"].tolist() == list(range(1, 21))
        assert list(zip(-part.score, part.vec_id)) == sorted(zip(-part.score, part.vec_id))
    assert all(abs(s - np.dot(by_id[a], by_id[b])) < 1e-12 for a, b, s in zip(got.query_id, got.vec_id, got.score))


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 3.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]),
            (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (10, [-1.0, 0.5]), (10, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS v", "3 AS q")
    got = collisions.nearest(df, df["vec_id"] % 20 == 0, k=4).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 0] == [
        (1, 2.0), (2, 2.0), (20, 0.0), (10, -1.0)]
    assert {r["query_id"] for r in got} == {0, 20}
    few = collisions.nearest(df, df["vec_id"] == 20, k=50).collect()
    assert sorted(r["vec_id"] for r in few) == [0, 1, 2, 10, 10]
    assert collisions.nearest(df.limit(0), df["vec_id"] % 20 == 0).count() == 0


def test_query_blocks_and_index_blocks_agree_when_all_is_verified(spark):
    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    whole = collisions.nearest(df, df["vec_id"] % 20 == 0, verify=1.0)
    cut = collisions.nearest(df, df["vec_id"] % 20 == 0, verify=1.0, block_vectors=64, query_bytes=5000)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect()))
    e = table("embeddings")
    want = _exact(e.vec_id.tolist(), np.array(e.embedding.tolist(), dtype=float))
    found = whole.toPandas().sort_values(["query_id", "rank"]).groupby("query_id").vec_id.apply(list)
    assert all(found[i] == j for i, j in want.items())


@pytest.mark.parametrize("unit", ["<div>", "<li>", "<body>", "<td>", "<table><tr>", "<span>"])
def test_open_elements_take_linear_time(unit):
    start = time.perf_counter()
    page = dom.Page(unit * (200_000 // len(unit)) + "end")
    # 0.2 MB; a walk over all open elements at each start would take minutes.
    assert time.perf_counter() - start < 20
    assert "".join(page.runs[-1][1]) == "end"
