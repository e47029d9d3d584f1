from wavemark.llm import extraction, html_blocks

ARTICLE = "<article><h1>A fine title</h1><p>First words of the text and more of it follow here, enough for a paragraph.</p><p>Second paragraph, a bit longer than the first one was.</p></article>"


def texts(page):
    return [b.text for b in html_blocks.blocks(page)]


def test_options_without_end_tags_hide_nothing_after_their_list():
    want = texts(ARTICLE)
    assert len(want) == 3
    for before in ("<select><option>A<option>B</select>", "<select><optgroup label=x><option>A<option>B</optgroup></select>", "<input list=d><datalist id=d><option>A<option>B</datalist>", "<select><option>A</option><option>B</option></select>"):
        assert texts(f"<form>{before}</form>{ARTICLE}") == want


def test_an_end_tag_ends_what_is_open_in_its_element_alone():
    assert texts("<object><svg><canvas>x</object><p>shown</p>") == ["shown"]
    assert texts("<select>a</button></svg>b</select><p>shown</p>") == ["shown"]
    assert texts("<button>a<svg>b</svg>c</button><p>shown</p>") == ["shown"]
    assert texts("<head><svg>x</head><p>shown</p>") == ["shown"] and texts("<select><option>x<body><p>shown</p>") == ["shown"]


def test_article_behind_a_menu_is_extracted():
    model = extraction.train()
    assert extraction.main_text(f"<html><body><form><select><option>A<option>B</select></form>{ARTICLE}</body></html>", model) == extraction.main_text(f"<html><body><form></form>{ARTICLE}</body></html>", model) != ""
