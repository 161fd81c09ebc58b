import random
import time
import tracemalloc

import numpy as np

from tessera.llm import htmlmain as hm

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy now.</div>
<article><h1>A   title &amp; more</h1><p><b>First &lt;line&gt;.<br><p>Second
 line&nbsp;here, with <a href="x">a link</a>.</article><div class="comments"><h3>Replies</h3><div class="comment"><p>Nice one.</p></div></div>
<footer>&copy; someone</footer></body></html>"""


def test_main_text_of_a_page():
    assert hm.main_text(hm.network(), [PAGE]) == ["A title & more\nFirst <line>.\nSecond line here, with a link."]


def test_odd_pages():
    w = hm.network()
    odd = [None, "", "<", "<p", "text < only > &amp", "<script>x", "<!--", "</p></div>", "<p " + 'a="' * 2000, "<div>" * 3000 + "x"]
    assert len(hm.main_text(w, odd)) == len(odd)
    assert hm.main_text(w, [None, "", "<script>x", "<!-- a"]) == [""] * 4
    long = "<article><h1>Long</h1>" + "".join(f"<p>Sentence number {i} of the text, quite plain.</p>" for i in range(3000)) + "</article>"
    got = hm.main_text(w, [long])[0].split("\n")
    assert got[-1] == "Sentence number 2999 of the text, quite plain."


def test_held_out_accuracy():
    rng, w = random.Random(4242), hm.network()
    right = n = 0
    for _ in range(120):
        page, article = hm.synthetic_page(rng)
        found = hm.blocks(page)
        assert article <= {b.text for b in found}
        for b, y in zip(found, hm.label(w, [found])[0], strict=True):
            right += y == (b.text in article)
            n += 1
    assert right / n > 0.97


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    w = {k: v.astype(float) for k, v in hm._start().items()}
    x, mask, y = rng.normal(size=(4, 3, hm.INPUT)), np.ones((4, 3)), rng.integers(0, 2, (4, 3)).astype(float)
    mask[2:, 1] = 0
    loss, grad = hm.gradients(w, x, mask, y)
    for k, at in (("xf", (3, 5)), ("hb", (2, 30)), ("cf", (25,)), ("o", (7,))):
        old = w[k][at]
        w[k][at] = old + 1e-3
        more = hm.gradients(w, x, mask, y)[0]
        w[k][at] = old - 1e-3
        less = hm.gradients(w, x, mask, y)[0]
        w[k][at] = old
        assert abs((more - less) / 2e-3 - grad[k][at]) < 1e-4


def test_frame(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "u", "", "x"), (1, "u", PAGE, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = hm.extract(df).collect()
    assert sorted((r.page_id or 0, r.n_chars, len(r.text)) for r in got) == [(0, 0, 0), (1, 59, 59), (1, 59, 59), (2, 0, 0)]
    assert hm.extract(df.limit(0)).count() == 0


def test_labels_equal_a_plain_network():
    w, rng = hm.network(), random.Random(77)
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def plain(page):
        x, states = hm.features(page).astype(float), []
        for d, order in (("f", range(len(page))), ("b", range(len(page) - 1, -1, -1))):
            h, c, seen = np.zeros(hm.HIDDEN), np.zeros(hm.HIDDEN), [None] * len(page)
            for t in order:
                z = x[t] @ w[f"x{d}"] + h @ w[f"h{d}"] + w[f"c{d}"]
                i, f, o, g = (z[k * hm.HIDDEN : (k + 1) * hm.HIDDEN] for k in range(4))
                c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
                h = sigmoid(o) * np.tanh(c)
                seen[t] = h
            states.append(seen)
        return [float(np.concatenate([a, b]) @ w["o"] + w["oc"][0]) for a, b in zip(*states, strict=True)]

    pages = [hm.blocks(hm.synthetic_page(rng)[0]) for _ in range(9)]
    got = hm._scores(w, pages)
    for j, page in enumerate(pages):
        assert np.allclose(got[: len(page), j], plain(page), atol=1e-3)


def test_spans_give_the_same(monkeypatch):
    w, rng = hm.network(), random.Random(78)
    pages = [hm.blocks(hm.synthetic_page(rng)[0]) for _ in range(6)]
    whole = hm._scores(w, pages)
    monkeypatch.setattr(hm, "SPAN", 7)
    parts = hm._scores(w, pages)
    for j, page in enumerate(pages):
        assert np.allclose(whole[: len(page), j], parts[: len(page), j], atol=1e-4)


def test_long_and_deep_pages_in_bounded_memory():
    w = hm.network()
    many = "<article><h1>Long</h1>" + "".join(f"<p>Sentence number {i} of the text, quite plain, and a bit longer than others.</p>" for i in range(60_000)) + "</article>"
    tracemalloc.start()
    got = hm.main_text(w, [many, *["<p>short</p>"] * 31])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.count("\n") >= 59_990 and peak < 600 << 20
    began = time.time()
    hm.blocks("<div>x" * 20_000)
    hm.blocks("<p>" + "<b>word</b> " * 60_000)
    assert time.time() - began < 20


OTHER = """<html><body><div id=top><a href=/>Site</a> <a href=/n>News</a> <a href=/s>Sport</a> <a href=/c>Culture</a></div>
<div class=post><h2>Rain over the hills</h2><p>It rained all week, and the river rose by a metre. Nobody could cross it.
<p>On Sunday the sun came back, and people went out to look at the fields.</div>
<div class=related><h4>More</h4><ul><li><a href=/1>Snow in spring</a><li><a href=/2>A dry year</a></ul></div>
<div id=footer>Copyright 2020. All rights reserved.</div></body></html>"""


def test_hand_labelled_page_of_another_template():
    # Precision 1; recall 2 of 3 at least: a headline that is no h1 may be missed there.
    got = hm.main_text(hm.network(), [OTHER])[0].split("\n")
    want = ["Rain over the hills", "It rained all week, and the river rose by a metre. Nobody could cross it.", "On Sunday the sun came back, and people went out to look at the fields."]
    assert set(got) <= set(want) and set(want[1:]) <= set(got)
