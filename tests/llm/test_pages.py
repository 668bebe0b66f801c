import html
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from foliant.llm import pages


def texts(page):
    return [b.text for b in pages.blocks(page)]


def test_blocks_mend_markup():
    page = '<html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p><p>no";</script></head><body><!-- <p>no</p> --><p>a <b>b</b>c<br>d<p>e&nbsp;&lt;f <i>g</p>h</i></div><li>1<li>2</ul>&#233;x'
    assert texts(page) == ["a bc", "d", "e <f g", "h", "1", "2", "éx"]
    assert pages.blocks("<div class='Side-bar x' id=q><p>t")[0].path == ("div side bar x q", "p")
    assert pages.blocks("<p><b>x<br><p>y</p></article>z")[1].path == ("p",)


@pytest.mark.parametrize("page", ["", " ", "plain text", "<", "<<p", "a < b > c", "<p", "<p class=\"x", "</p></div>", "<script>", "<!-- open", "&", "&#xD800;", "<p " + "a" * 10000, "<![CDATA[x<y]]>z", "<p a='>\">t"])
def test_odd_pages(page):
    pages.blocks(page)


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    model = pages.Labeller.new(3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x = rng.normal(size=(2, 4, pages.PATH + pages.WORDS + pages.SHAPE)).astype(np.float32)
    mask = np.array([[1, 1, 1, 1], [1, 1, 0, 0]], bool)
    y = (rng.random((2, 4)) > 0.5).astype(np.float32)

    def loss():
        p = model.probabilities(x, mask)
        return -np.where(mask, y * np.log(p) + (1 - y) * np.log(1 - p), 0).sum() / mask.sum()

    grad = model.gradients(x, y, mask)
    for k in model.p:
        at = tuple(rng.integers(0, n) for n in model.p[k].shape)
        held = model.p[k][at]
        model.p[k][at] = held + 1e-2
        up = loss()
        model.p[k][at] = held - 1e-2
        down = loss()
        model.p[k][at] = held
        assert grad[k][at] == pytest.approx((up - down) / 2e-2, abs=2e-4)


def test_forward_pass_matches_a_plain_version():
    rng = np.random.default_rng(5)
    model = pages.Labeller.new(2)
    examples = [rng.normal(size=(n, pages.PATH + pages.WORDS + pages.SHAPE)).astype(np.float32) for n in (1, 7, 4)]
    x, mask = pages.padded(examples)
    got = model.probabilities(x, mask)
    h_n, sigmoid = pages.HIDDEN_UNITS, lambda z: 1 / (1 + np.exp(-z))
    for own, row in zip(examples, got):
        states = []
        for way, order in (("f", range(len(own))), ("b", range(len(own) - 1, -1, -1))):
            h, c, out = np.zeros(h_n), np.zeros(h_n), {}
            for t in order:
                z = [sum(own[t] * model.p[f"x{way}"][:, j]) + sum(h * model.p[f"h{way}"][:, j]) + model.p[f"b{way}"][j] for j in range(4 * h_n)]
                i, f, o, g = (np.array(z[k * h_n : (k + 1) * h_n]) for k in range(4))
                c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
                h = sigmoid(o) * np.tanh(c)
                out[t] = h
            states.append(out)
        for t in range(len(own)):
            p = sigmoid(states[0][t] @ model.p["o"][:h_n] + states[1][t] @ model.p["o"][h_n:] + model.p["ob"][0])
            assert row[t] == pytest.approx(p, abs=1e-4)


def test_all_blocks_of_a_sampled_page_are_learned_from(monkeypatch):
    seen = []
    monkeypatch.setattr(pages, "train", lambda examples, **_: seen.extend(examples) or pages.Labeller.new())
    page = "<article>" + "".join(f"<p>Paragraph {i} of the article has some words in it.</p>" for i in range(400)) + "</article>"
    pages.learn([page], made=0)
    assert sum(len(y) for _, y in seen) == 400 and max(len(y) for _, y in seen) <= pages.TRAINED_BLOCKS


def test_a_very_long_page(spark):
    page = "<nav><a>menu</a></nav><article><h1>Title of the page</h1>" + "<p>Some words of the main text are here, in a long line of it.</p>" * 6000 + "</article>"
    got = pages.extract(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"), sample_pages=0).collect()[0]
    assert got.text.count("Some words") == 6000 and "menu" not in got.text


@pytest.fixture(scope="module")
def model():
    return pages.learn([], 400)


def test_held_out_made_pages(model):
    rng = random.Random(99)
    made = [pages.made_page(rng) for _ in range(150)]
    found = model.label([pages.vectors([b for b, _ in p]) for p in made])
    right = total = 0
    for page, got in zip(made, found):
        right += sum(y == g for (_, y), g in zip(page, got.tolist()))
        total += len(page)
    assert right > 0.96 * total


def articles(page):
    """Plain text of the article of a supplied page."""
    own = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    own = re.sub(r"</?(?:p|h1|br)>", "\0", own)
    own = re.sub(r"<[^>]*>", "", own).split("\0")
    return " ".join(x for x in (" ".join(html.unescape(x).split()) for x in own) if x)


def test_supplied_pages(spark):
    path = "/root/testdata/sf0.01/pages.parquet"
    right = {r["page_id"]: articles(r["html"]) for r in pq.read_table(path).to_pylist()}
    got = {r.page_id: r for r in pages.extract(spark.read.parquet(path)).collect()}
    assert len(got) == len(right)
    assert sum(got[k].text == right[k] for k in right) >= 0.98 * len(right)
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_rows(spark):
    rows = [(1, "u", None, "t"), (1, "u", "", "t"), (None, None, "<article><h1>Title of it</h1><p>Some words of the main text are here, in a long line.</p></article>", "t"), (2, "u", "<nav><a>x</a></nav>", "t")]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert sorted(((r.page_id, r.n_chars > 0) for r in got.collect()), key=str) == [(1, False), (1, False), (2, False), (None, True)]
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
