"""Neighbours against brute force, page texts, and components."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from provena.llm import common, components, htmltext, neighbours
from tests.llm.cases import clashing, frame


@pytest.fixture(autouse=True)
def prepared(spark):
    common.prepare(spark)


def brute(ids, x, is_query, top=20):
    out = {}
    for i in np.flatnonzero(is_query):
        s = x @ x[i]
        order = np.lexsort((ids, -s))
        out[int(ids[i])] = [int(ids[k]) for k in order if ids[k] != ids[i]][:top]
    return out


def vectors(spark, ids, x):
    return frame(spark, [(int(i), [float(v) for v in row]) for i, row in zip(ids, x)], "vec_id long, embedding array<float>")


@pytest.mark.parametrize("lengths", [False, True])
def test_recall_against_brute_force(spark, lengths):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if lengths:
        x *= rng.uniform(0.5, 2, (4000, 1)).astype(np.float32)
    x[100:400] = x[99]  # one vector very common
    ids = np.arange(4000)
    got = neighbours.search(vectors(spark, ids, x), F.col("vec_id") % 20 == 0, neighbours.Params(group=500)).toPandas()
    truth = brute(ids, x.astype(float), ids % 20 == 0)
    hits = sum(len(set(t) & set(got[got.query_id == q].vec_id)) for q, t in truth.items())
    assert hits / (20 * len(truth)) > 0.9
    best = got[got.query_id == 120].sort_values("rank")
    assert best.vec_id.tolist() == truth[120]
    assert np.allclose(best.score, [x[120].astype(float) @ x[v].astype(float) for v in best.vec_id], rtol=0, atol=1e-12)


def test_two_polytopes_and_small_tables(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 8)).astype(np.float32)
    ids = np.arange(2000)
    p = neighbours.Params(single=10, cell=40, second=20, group=300, tables=16)
    assert neighbours.measure(neighbours.valid(vectors(spark, ids, x)), p).axes[1] > 0
    got = neighbours.search(vectors(spark, ids, x), F.col("vec_id") % 20 == 0, p).toPandas()
    truth = brute(ids, x.astype(float), ids % 20 == 0)
    assert sum(len(set(t) & set(got[got.query_id == q].vec_id)) for q, t in truth.items()) / (20 * len(truth)) > 0.9
    few = neighbours.search(vectors(spark, ids[:6], x[:6]), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in few] == brute(ids[:6], x[:6].astype(float), ids[:6] == 0)[0]


@pytest.mark.parametrize("norms", ["two", "many"])
def test_recall_at_size_where_norms_differ(spark, norms):
    rng = np.random.default_rng(5)
    n = 40_000
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= np.where(np.arange(n) % 2 == 0, 0.3, 1.0)[:, None] if norms == "two" else np.exp(0.5 * rng.normal(size=(n, 1)))
    ids, asked = np.arange(n), np.arange(n) % 400 == 0
    got = neighbours.search(spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": list(x)})), F.col("vec_id") % 400 == 0).toPandas()
    truth = brute(ids, x, asked)
    assert sum(len(set(t) & set(got[got.query_id == q].vec_id)) for q, t in truth.items()) / (20 * len(truth)) > 0.9


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [0.5, 0.5]), (7, [0.6, 0.0]), (8, [1.0, 0.0, 0.0]), (9, []), (0, [1.0, 0.0])]
    df = clashing(frame(spark, rows, "vec_id long, embedding array<float>"))
    got = [(r["rank"], r["vec_id"], round(r["score"], 6)) for r in neighbours.search(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(1, 1, 1.0), (2, 7, 0.6)]
    assert neighbours.search(df.limit(0), F.col("vec_id") == 0).count() == 0


PAGE = (
    '<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header class="site-header"><h1>My site</h1></header><nav><ul><li><a href=/>Home'
    "</a><li><a href=/b>Blog</a></ul></nav><div class='cookie-notice'>We use cookies.</div><article><h1>A title</h1><p>First <b>bold</b> text &amp; more.<p>Second\n\n paragraph"
    "<br>with a line.<!-- hidden --><aside class=related><a href=x>Related things</a></aside><form><label>Mail</label><button>Send</button></form></article>"
    "<section id=comments><p>I liked it.</p></section><footer>&copy; Me</footer></body></html>"
)


def test_blocks_decode_and_close():
    got = [b.text for b in htmltext.blocks(PAGE)]
    assert got == ["T", "My site", "Home", "Blog", "We use cookies.", "A title", "First bold text & more.", "Second paragraph", "with a line.", "Related things", "MailSend" if "MailSend" in got else "Mail", *(["Send"] if "Send" in got else []), "I liked it.", "© Me"]
    assert [b.text for b in htmltext.blocks("a < b <i>c</i> <script>never ends")] == ["a < b c"]
    assert htmltext.blocks(None) == [] and htmltext.blocks("<p></p>") == [] and len(htmltext.blocks("<div>" * 5000 + "deep")) == 1
    assert htmltext.blocks('<a href="' * 3000) is not None


def test_labeller_learns_and_is_the_same_alone_or_in_a_batch(spark):
    pages = [(i, f"http://x/{i}", PAGE.replace("First", f"Word{i}")) for i in range(20)] + [(20, None, None), (21, "u", ""), (22, "u", "<p> </p>"), (None, "u", PAGE), (0, "http://x/0", PAGE.replace("First", "Word0"))]
    df = clashing(frame(spark, pages, "page_id long, url string, html string"))
    model = htmltext.fit(df, htmltext.Params(pages=20, laid=250))
    rows = htmltext.extract(df, model).collect()
    assert len(rows) == len(pages)
    by = {r["page_id"]: r for r in rows}
    for i in range(20):
        assert by[i]["text"] == f"A title Word{i} bold text & more. Second paragraph with a line."
        assert by[i]["n_chars"] == len(by[i]["text"])
    assert {by[k]["text"] for k in (20, 21, 22)} == {""}
    rng, reader = np.random.default_rng(77), htmltext.Reader()
    right = total = 0
    read = []
    for _ in range(150):
        page, truth = htmltext.lay_out(rng, ["ka", "lo", "mine", "tor"])
        known = {" ".join(t.split()): label for t, label in truth}
        found = htmltext.blocks(page)
        read.append(reader.read(found))
        said = model.predict([read[-1]])[0]
        right += sum((q >= 0.5) == bool(known.get(b.text, 0)) for b, q in zip(found, said))
        total += len(found)
    assert right / total > 0.93
    together = model.predict(read)
    assert all(np.allclose(model.predict([r])[0], t) for r, t in zip(read, together))
    assert htmltext.extract(df.limit(0), model).count() == 0


def test_gradients_are_those_of_the_loss():
    p = htmltext.Params(hidden=3, path_width=2, word_width=2, epochs=1, batch=2, rate=0.0)
    net, reader = htmltext.Labeller(p), htmltext.Reader()
    page, truth = htmltext.lay_out(np.random.default_rng(1), ["ka", "lo"])
    read = reader.read(htmltext.blocks(page))
    label = (np.arange(len(read[1])) % 2).astype(float)
    seen = {}

    def loss():
        q = np.clip(net.predict([read])[0], 1e-12, 1 - 1e-12)
        return -(label * np.log(q) + (1 - label) * np.log(1 - q)).mean()


    original = htmltext.Labeller._back
    htmltext.Labeller._back = lambda self, x, way, hs, cs, gs, d, grads: seen.setdefault("grads", grads) is None or original(self, x, way, hs, cs, gs, d, grads)
    try:
        net.fit([read], [label])
    finally:
        htmltext.Labeller._back = original
    grads = seen["grads"]
    for name in ("xf", "hf", "hb", "out", "own", "cf"):
        at = tuple(0 for _ in net.w[name].shape)
        for step in (1e-5,):
            net.w[name][at] += step
            up = loss()
            net.w[name][at] -= 2 * step
            down = loss()
            net.w[name][at] += step
            assert np.isclose((up - down) / (2 * step), grads[name][at], rtol=1e-3, atol=1e-7), name


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 150)] + [(200, 201), (201, 200), (300, 300)]
    got = {r["node"]: r["comp"] for r in components.connected(frame(spark, links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 150)}, 200: 200, 201: 200}
