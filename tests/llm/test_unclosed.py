"""Hidden elements that are never closed and odd comments hide no more of a page than they must."""

import pytest

from wavemark.llm import extraction, html_blocks

BODY = "<article><h1>The title of it all</h1><p>First words of the article, which go on for quite a while here.</p><p>Second words of the article, which are about as many again.</p></article>"
TEXT = "The title of it all First words of the article, which go on for quite a while here. Second words of the article, which are about as many again."


@pytest.fixture(scope="module")
def model():
    return extraction.train()


def shown(page):
    return " ".join(b.text for b in html_blocks.blocks(page))


@pytest.mark.parametrize("before", [
    "<button>Accept", "<svg viewBox='0 0 1 1'><path d='M0'>", "<audio controls>", "<object data='x'>", "<video src=a>", "<canvas>", "<math><mi>x", "<select><option>A<option>B", "<datalist>", "<template>",
    "<!-->", "<!--->", "<!-- a --!>", "<!-- a -- > b -->", "<!---->", "<!--a--->", "<button>A<button>B<svg>", "<svg><title>x</title><button>y",
])
def test_the_article_is_shown(before, model):
    page = f"<html><head><title>T</title></head><body><nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav>{before}{BODY}<footer>&copy; All rights reserved.</footer></body></html>"
    assert TEXT in shown(page) and "Accept" not in shown(page)
    assert extraction.main_text(page, model) == TEXT


def test_what_has_an_end_hides_all_up_to_it():
    assert shown("<p>a<button>b<div>c</div></button>d<svg><text>e</text><svg><text>f</text></svg><text>g</text></svg>h</p>") == "a dh"
    assert shown("<p>a<svg><path/>b</p><p>c<svg><text>d</text></svg>e</p>") == "a ce"
    assert shown("<p>a<button>b<button>c</button>d</p><p>e</button>f</p>") == "ad ef"
    assert shown("<p>a<object>b<object>c</object>d</object>e</p>") == "ae" and shown("<p>a<svg/>b</p>") == "ab"
    assert shown("<head><meta x><p>no end of the head</p>") == "no end of the head"
    assert shown("a<!-- never closed <p>b</p>") == "a" and shown("a<script>never closed <p>b</p>") == "a"


def test_very_many_without_an_end():
    assert shown("<svg><button>x" * 20_000 + "<p>shown</p>") == "shown"


@pytest.mark.parametrize(("name", "head"), [("kommentare", "3 Kommentare"), ("commentaires", "2 commentaires"), ("comentarios", "4 comentarios"), ("comments", "Comments")])
@pytest.mark.parametrize("tag", ["ol", "ul", "div"])
def test_comments_of_other_languages(name, head, tag, model):
    item = "div" if tag == "div" else "li"
    page = f"<html><body><nav><a href=/>Home</a></nav>{BODY}<h3>{head}</h3><{tag} class={name}><{item}><p>I liked it a lot, thanks for that and for more.</p></{item}><{item}><p>So did I, it was well worth the while to read.</p></{item}></{tag}></body></html>"
    got = extraction.main_text(page, model)
    assert got.startswith(TEXT) and "liked" not in got and "So did I" not in got
