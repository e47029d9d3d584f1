import itertools
from html.parser import HTMLParser

import numpy as np

from wavemark.llm import extraction, html_blocks, page_samples

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{margin:0}</style><script>var t="</p><p>not text</p>";</script></head>
<body><div class="cookie-notice">We use cookies. <button>Accept all</button></div><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>
<!-- a > b --><div class="ad">Buy the best ones here today.</div><article><h1>A &lt;fine&gt; title</h1><p><b>First&nbsp;words<br>of the
 text &#233;&copy; and more of it follow here.<p>Second <a href="x">linked</a> paragraph, a bit longer than the first one was.</p><form><p>Your mail</p><input></form>
<p>Yes.</p></article><section class="comments"><h3>2 comments</h3><div class="comment"><p>I liked it a lot, thanks for that.</p></div></section>
<footer>&copy; site.example.com &middot; All rights reserved.</footer></body></html>"""


def test_extracts_the_article(spark):
    rows = [(1, "u", PAGE, 1), (2, None, None, 2), (3, "v", "", 3), (None, "w", "<p", 4), (1, "u", PAGE, 5), (4, "x", "<script>never closed <p>a</p>", 6), (5, "y", "<<<>>> < a &&& &#xZ; &#99999999;", 7)]
    got = extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text long")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    want = "A <fine> title First words of the text é© and more of it follow here. Second linked paragraph, a bit longer than the first one was. Yes."
    assert by[1].text == want and by[1].n_chars == len(want) and by[1].url == "u"
    assert (by[2].text, by[2].n_chars, by[3].text, by[4].text) == ("", 0, "", "")
    assert extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_held_out_layouts():
    model, right, total, wrong = extraction.train(), 0, 0, 0
    for seed in range(50_000, 50_150):
        text, labels = page_samples.page(seed)
        found = html_blocks.blocks(text)
        assert len(found) == len(labels)
        want = sum(len(b.text) for b, k in zip(found, labels, strict=True) if k)
        got = extraction.main_text(text, model)
        kept = set(got.split())
        total += want
        right += sum(len(b.text) for b, k in zip(found, labels, strict=True) if k and set(b.text.split()) <= kept)
        wrong += max(0, len(got) - want)
    assert right / total > 0.97 and wrong / total < 0.03


def test_viterbi_and_chances_equal_brute_force():
    r = np.random.default_rng(1)
    for n in (1, 2, 5):
        score, move = r.normal(size=(n, 2)), r.normal(size=(2, 2))
        value = {y: sum(score[k, v] for k, v in enumerate(y)) + sum(move[a, b] for a, b in itertools.pairwise(y)) for y in itertools.product((0, 1), repeat=n)}
        assert tuple(extraction.viterbi(score.tolist(), move.tolist())) == max(value, key=value.get)
        z = np.exp(np.array(list(value.values()))).sum()
        chance, steps = extraction._forward_backward(score, move)
        for k in range(n):
            assert np.isclose(chance[k, 1], sum(np.exp(v) for y, v in value.items() if y[k]) / z)
        assert np.isclose(steps[0, 1], sum(np.exp(v) * sum(p == (0, 1) for p in itertools.pairwise(y)) for y, v in value.items()) / z)


def test_very_long_page_is_read_whole():
    text = "<article>" + "".join(f"<p>Sentence number {i} of a very long article, which goes on.</p>" for i in range(5000)) + "</article>"
    assert extraction.main_text(text, extraction.train()).count("Sentence number") == 5000
    assert len(html_blocks.blocks("<div>" * 5000 + "x" + "</div>" * 5000)) == 1


ARTICLE = "<article><h1>A fine title</h1><p>First words of the text and more of it follow here, enough for a paragraph.</p><p>Second paragraph, a bit longer than the first one was.</p></article>"


def test_depth_changes_nothing():
    model = extraction.train()
    page = lambda n: f"<body><nav><ul><li><a href='/'>Home</a></ul></nav>{'<div>' * n}{ARTICLE}{'</div>' * n}<footer>© site</footer></body>"
    want = extraction.main_text(page(1), model)
    assert want.startswith("A fine title First words")
    for n in (195, 199, 200, 260, 300, 5000):
        assert extraction.main_text(page(n), model) == want, n
    assert len(html_blocks.blocks("<div class=a>x" * 20_000 + "</p></li></td>" * 20_000)) == 20_000


class _Plain(HTMLParser):
    """Block texts by the standard library's parser, for pages whose elements are all closed."""

    def __init__(self):
        super().__init__()
        self.found, self.text, self.stack, self.hidden = [], "", [], 0

    def flush(self):
        if joined := " ".join(self.text.split()):
            self.found.append((joined, self.stack[-1] if self.stack else "body"))
        self.text = ""

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in html_blocks.HIDDEN
        if tag in html_blocks.BLOCK:
            self.flush()
            if tag not in ("body", *html_blocks.VOID):
                self.stack.append(tag)
        if tag == "br":
            self.text += "\n"

    def handle_endtag(self, tag):
        self.hidden -= tag in html_blocks.HIDDEN
        if tag in html_blocks.BLOCK:
            self.flush()
            if tag in self.stack:
                while self.stack.pop() != tag:
                    pass

    def handle_data(self, data):
        if not self.hidden:
            self.text += data


def test_blocks_equal_those_of_the_standard_parser():
    for seed in range(300):
        text, _ = page_samples.page(60_000 + seed)
        plain = _Plain()
        plain.feed(text)
        plain.close()
        plain.flush()
        assert [b.text for b in html_blocks.blocks(text)] == [t for t, _ in plain.found], seed
