"""Main text of pages in many templates, and what the tree decides by."""

import numpy as np
import pytest

from twinweave.llm import html_blocks as hb

A = "The council met on Tuesday to discuss the new bridge over the river, which the engineers had measured in spring."
B = "Its report names three designs, of which the second costs least and leaves the old market square as it is today."
C = "Work could begin in summer if the members agree, said the mayor, who has long asked for a safer way to school."
S = "So it goes."
TEXT = f"The new bridge|{A}|{B}|{S}|{C}"
BODY = f"<h1>The new bridge</h1><p>{A}</p><p>{B}</p><p>{S}</p><p>{C}</p>"
MENU = '<ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li><li><a href="/c">Contact</a></li></ul>'
NEXT = '<ul><li><a href="/1">Ten ways to cross a river</a></li><li><a href="/2">What the mayor said</a></li><li><a href="/3">Old maps of the town</a></li></ul>'

PAGES = {
    "landmarks": f"<header>{MENU}</header><nav>{MENU}</nav><main><article>{BODY}</article></main><aside><p>Sign up now</p>{NEXT}</aside><footer><p>All rights kept</p></footer>",
    "blog classes on the article": f'<nav>{MENU}</nav><article class="post tag-python category-nav hentry">{BODY}</article><footer>x</footer>',
    "blog classes on the body": f'<body class="has-sidebar single single-post comments-closed"><div id="page" class="site"><nav>{MENU}</nav><article id="post-7" class="post-7 post type-post status-publish format-standard hentry">{BODY}</article></div></body>',
    "body that hints": f'<body class="sidebar navbar-fixed"><main>{BODY}</main></body>',
    "title in the article's header": f'<nav>{MENU}</nav><article><header class="entry-header"><h1>The new bridge</h1></header><div class="entry-content"><p>{A}</p><p>{B}</p><p>{S}</p><p>{C}</p></div><footer class="entry-footer"><a href="/t">town</a></footer></article>',
    "comments that are articles": f'<article class="post">{BODY}</article><section id="comments"><h2>3 comments</h2><article class="comment"><p>{C}</p></article><article class="comment"><p>No!</p></article></section>',
    "comment list": f'<main>{BODY}<ol class="commentlist"><li class="comment"><p>{A}</p></li><li class="comment"><p>First!</p></li></ol><div id="respond"><h3>Leave a reply</h3><form><label>Name</label></form></div></main>',
    "advert inside": f'<article><h1>The new bridge</h1><p>{A}</p><div class="ad-slot">Buy two, pay one</div><p>{B}</p><p>{S}</p><div class="share-buttons"><a href="#">Share</a></div><p>{C}</p></article>',
    "aside inside": f'<article><h1>The new bridge</h1><p>{A}</p><aside><h3>See also</h3>{NEXT}</aside><p>{B}</p><p>{S}</p><p>{C}</p></article>',
    "named boxes": f'<div class="site-header">Town paper</div><div class="nav-menu">{MENU}</div><div class="content">{BODY}</div><div class="sidebar"><h3>More</h3>{NEXT}</div><div class="site-footer">Town paper, Bridge street</div>',
    "cookie notice": f'<div class="cookie-banner"><p>We keep cookies so that you need not log in again.</p><a href="/p">More</a></div><div id="main-content">{BODY}</div><div id="footer">{MENU}</div>',
    "modal and newsletter": f'<div class="modal" role="dialog"><p>Join our list of readers</p></div><div class="post-body">{BODY}</div><div class="newsletter-signup"><p>Get our letter each week</p></div>',
    "old tables": f"<table><tr><td>{MENU}</td></tr><tr><td>{BODY}</td></tr><tr><td>{NEXT}</td></tr></table>",
    "bare boxes": f"<div>Town paper</div><div>{MENU}</div><div>{BODY}</div><div>{NEXT}</div><div>Bridge street</div>",
    "menu of paragraphs": f'<p><a href="/">Home</a></p><p><a href="/n">News</a></p><p><a href="/s">Sport</a></p>{BODY}<p><a href="/1">Ten ways to cross a river</a></p><p><a href="/2">What the mayor said</a></p>',
    "menu with bars": f'<div><a href="/">Home</a> | <a href="/n">News</a> | <a href="/s">Sport</a></div><div>{BODY}</div><div><a href="/">Home</a> | <a href="/i">Imprint</a></div>',
    "no head end": f"<html><head><title>t</title><meta charset=utf-8><body><div>{MENU}</div>{BODY}<div>{NEXT}</div>",
    "upper case": f"<BODY><NAV>{MENU}</NAV><ARTICLE>{BODY.replace('<p>', '<P>').replace('</p>', '</P>')}</ARTICLE></BODY>",
    "paragraphs left open": f"<nav>{MENU}</nav><article><h1>The new bridge</h1><p>{A}<p>{B}<p>{S}<p>{C}</article><footer>{NEXT}</footer>",
    "role names": f'<div role="navigation">{MENU}</div><div role="main">{BODY}</div><div role="contentinfo"><p>Town paper</p></div>',
    "script between": f'<main><h1>The new bridge</h1><p>{A}</p><script>if (a < b) document.write("<p>no</p>")</script><p>{B}</p><style>p > a {{}}</style><p>{S}</p><noscript><img src=x></noscript><p>{C}</p></main>',
    "attributes": f"""<article data-x="a > b"><h1 title='say "hi"'>The new bridge</h1><p title="it's">{A}</p><p data-y='{{"a": ">"}}'>{B}</p><p>{S}</p><p title="it's more">{C}</p></article>""",
    "hidden box": f'<article>{BODY}<div style="display: none"><p>{A}</p></div></article>',
    "text alone": BODY,
}


@pytest.mark.parametrize("name", PAGES)
def test_templates(name):
    assert hb.extract(PAGES[name]) == TEXT.replace("|", "\n\n")


def test_the_tree_looks_at_neighbours():
    used = hb.default_tree().uses()
    assert {"words", "link_density"} <= used and len(used & {"prev_words", "prev_link_density", "next_words", "next_link_density"}) >= 3


def test_neighbours_decide_where_nothing_else_does():
    """The same short block is main text between paragraphs, and none between menus."""
    short = "<p>As in the year before</p>"
    assert "As in the year before" in hb.extract(f"<div>{MENU}</div><div><p>{A}</p>{short}<p>{B}</p></div><div>{NEXT}</div>")
    assert "As in the year before" not in hb.extract(f"<div>{MENU}</div>{short}<div>{NEXT}</div><div><p>{A}</p><p>{B}</p></div><div>{NEXT}</div>")


def test_held_out_pages():
    tree = hb.default_tree()
    x, y = hb.table_of(hb.labelled_pages(seed=77, each=40))
    assert np.mean([tree.predict(r) == v for r, v in zip(x.tolist(), y.tolist(), strict=True)]) > 0.98


def test_nothing_in_an_article_is_dropped_for_its_size():
    for n in (1, 2, 5, 30, 99, 101, 500, 5000):
        for link in (False, True):
            words = " ".join(["word"] * n)
            text = f'<a href="#">{words}</a>' if link else words
            assert hb.extract(f"<nav>{MENU}</nav><article><p>a b</p><p>{text}</p><p>{B}</p></article>") == f"a b\n\n{words}\n\n{B}"


LONG = " ".join(f"{A} {B} {C}".split()[:72])
AD = "Buy two jars of our honey today and get the third one for free, only this week and only in our shop at the market square."
REAL = {
    **{f"{tag} around the page": f"<body><{tag}><div>{MENU}</div><div>{BODY}</div><div>{NEXT}</div></{tag}></body>" for tag in ("form", "fieldset", "dialog", "menu", "aside")},
    "server-side form": f'<body><form method="post" action="./x.aspx" id="aspnetForm"><input type="hidden" value="x"><div id="header">{MENU}</div><div id="content">{BODY}</div><div id="footer"><p>Town paper</p></div></form></body>',
    "page builder": f'<div class="elementor elementor-12"><section class="elementor-section"><div class="elementor-element elementor-widget elementor-widget-heading"><h1>The new bridge</h1></div>'
    + "".join(f'<div class="elementor-element elementor-widget elementor-widget-text-editor"><p>{x}</p></div>' for x in (A, B))
    + f'<div class="elementor-element elementor-widget"><p>{S}</p><p>{C}</p></div></section></div>',
    "page builder in main": f'<nav>{MENU}</nav><main><div class="elementor-element elementor-widget"><h1>The new bridge</h1></div>' + "".join(f'<div class="elementor-element elementor-widget"><p>{x}</p></div>' for x in (A, B, S, C)) + "</main>",
    **{f"title in a header, {x}": f"<header>{MENU}{y}</header><div><p>{A}</p><p>{B}</p><p>{S}</p><p>{C}</p></div><footer>{NEXT}</footer>" for x, y in (("bare", "<h1>The new bridge</h1>"), ("in a box", "<div><h1>The new bridge</h1></div>"))},
    **{f"{name} in an article": f'<article><h1>The new bridge</h1><p>{A}</p><p>{B}</p><div class="{name}"><p>{AD}</p></div><p>{S}</p><p>{C}</p></article>' for name in ("advert", "sponsored", "related", "newsletter", "share", "promo", "ad-slot", "cookie-notice")},
}


@pytest.mark.parametrize("name", REAL)
def test_real_shapes(name):
    assert hb.extract(REAL[name]) == TEXT.replace("|", "\n\n")


@pytest.mark.parametrize("name", ["header-wrap", "widget-text", "social-page", "banner-content", "topbar-inner"])
def test_names_are_weak_hints(name):
    page = f'<div>{MENU}</div><div class="{name}"><h1>The new bridge</h1><p>{LONG}</p><p>{B}</p><p>{LONG}</p></div><div>{NEXT}</div>'
    assert hb.extract(page) == f"The new bridge\n\n{LONG}\n\n{B}\n\n{LONG}"


def test_items_of_a_list_share_a_verdict():
    page = f"<nav>{MENU}</nav><div><h1>The new bridge</h1><p>{A}</p><ul><li>{B}</li><li>stone</li><li>iron and wood</li><li>{C}</li><li>glass</li></ul><p>{A}</p></div><div>{NEXT}</div>"
    assert hb.extract(page) == f"The new bridge\n\n{A}\n\n{B}\n\nstone\n\niron and wood\n\n{C}\n\nglass\n\n{A}"


def test_short_pages():
    assert hb.extract(f"<nav>{MENU}</nav><div><p>We are closed today.</p><p>Come back on Monday.</p></div><footer><p>Town</p></footer>") == "We are closed today.\n\nCome back on Monday."
    assert hb.extract(f"<nav>{MENU}</nav><footer><p>Town</p></footer>") == ""


def test_hints_decide_few_blocks():
    """A tree that never sees the hint of class names errs on hardly more held-out blocks."""
    x, y = hb.table_of(hb.labelled_pages())
    held, want = hb.table_of(hb.labelled_pages(seed=78, each=40))
    hint = hb.FEATURES.index("hint")
    blind = x.copy()
    blind[:, hint] = 0
    tree, other = hb.default_tree(), hb.DecisionTree(blind, y)
    right = [np.mean([t.predict(r) == v for r, v in zip(rows.tolist(), want.tolist(), strict=True)]) for t, rows in ((tree, held), (other, np.where(np.arange(held.shape[1]) == hint, 0, held)))]
    assert right[0] > 0.98 and right[0] - right[1] < 0.02


def test_time_is_in_proportion_to_the_page():
    import time

    def took(n):
        began = time.process_time()
        hb.extract("<div class='widget'>" * n + "".join(f"<div><p>{A}</p>" for _ in range(n)) + "</nav>" * n)
        return time.process_time() - began

    took(500)
    assert took(16_000) < 12 * took(4000) + 0.5
