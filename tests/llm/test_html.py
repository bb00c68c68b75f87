"""Pages laid out otherwise than those the classifier learns from, and pages that are broken, hostile or very long."""

import time

import pytest

from lattica.llm import html

P = ["The harbour was quiet when the ferry left, and nobody on deck spoke for the first mile.", "By noon the wind had turned and the captain, who had seen worse, ordered tea.", "Nothing in the log explains what happened after the second bell.", "We reached the island at dusk and found the lamps already lit."]
TITLE = "A quiet crossing"
BODY = " ".join([TITLE, *P])
PS = "".join(f"<p>{x}</p>" for x in P)
MENU = "<ul><li><a href=/a>Home</a></li><li><a href=/b>World news</a></li><li><a href=/c>About us</a></li></ul>"

PAGES = {
    "blog": f'<body class="single has-sidebar"><div id="page" class="site"><header id="masthead" class="site-header"><h1 class="site-title"><a href=/>My log</a></h1><nav>{MENU}</nav></header><div id="primary"><main><article class="post-17 post type-post hentry category-travel"><h1 class="entry-title">{TITLE}</h1><div class="entry-content">{PS}</div></article><div id="comments" class="comments-area"><ol class="comment-list"><li><article class="comment-body"><p>Lovely story, thank you for writing it down.</p></article></li></ol></div></main></div><div id="secondary" class="widget-area"><section class="widget"><p>Follow this log by email.</p></section></div><footer class="site-footer">&copy; 2024 My log. All rights reserved.</footer></div></body>',
    "columns": f'<div class="container"><div class="row"><div class="col-md-12">{MENU}</div></div><div class="row"><div class="col-md-8"><h1>{TITLE}</h1>{PS}</div><div class="col-md-4"><p>Buy two lamps and save.</p><p>Free shipping today!</p></div></div></div>',
    "table": f"<table width=100%><tr><td>{MENU}</td><td><h1>{TITLE}</h1>{PS}</td></tr></table>",
    "form": f'<form id="aspnetForm" method=post><div class="top-nav">{MENU}</div><div id="content"><h1>{TITLE}</h1>{PS}</div><div class="footer-links"><a href=/x>Terms</a> <a href=/y>Privacy</a></div></form>',
    "article form": f"<article><h1>{TITLE}</h1>{PS}<form action=/s><p>Subscribe to our letter</p><label>Email</label><input name=e><button>Go</button></form></article>",
    "wrapper": f'<div class="layout-sidebar-left no-ads"><div class="banner-page"><main><h1>{TITLE}</h1>{PS}</main></div></div>',
    "notice": f'<div id="cookie-consent"><p>We use cookies to make this site work for you.</p><button>Accept</button></div><article><h1>{TITLE}</h1>{PS}</article><aside><h2>Most read</h2>{MENU}</aside>',
    "inline": f'<section class="story"><h1>{TITLE}</h1><p>The <b>harbour</b> was <em>quiet</em> when the <a href=/f>ferry</a> left,<br>and nobody on deck spoke for the first mile.{PS.removeprefix("<p>" + P[0] + "</p>")}</section><div class="related"><h3>Related</h3><p><a href=/z>Another crossing</a></p></div>',
    "longer comments": f'<article><h1>{TITLE}</h1>{PS}</article><section class="comments">' + "".join(f'<article class="comment"><p>Reader {i} says that the captain was right and the tea was good, all things considered.</p></article>' for i in range(12)) + "</section>",
}


@pytest.mark.parametrize("name", PAGES)
def test_other_layouts(name):
    assert html.main_text(f"<!DOCTYPE html><html><head><title>t</title></head><body>{PAGES[name]}</body></html>", html.weights()) == BODY


@pytest.mark.parametrize("names", ["page no-sidebar", "site-header-fixed", "has-comments", "post share-enabled", "main-banner", "with-widgets"])
def test_names_of_states_and_wrappers(names):
    inner = f"<article><h1>{TITLE}</h1>{PS}</article>"
    assert html.main_text(f'<nav>{MENU}</nav><div class="{names}">{inner}</div>', html.weights()) == BODY


def test_names_still_count():
    w = html.weights()
    for kind in ("advert", "sidebar-left", "site-footer", "newsletterSignup"):
        assert html.main_text(f'<div class="{kind}"><p>Some words that are not the story.</p></div><article><h1>{TITLE}</h1>{PS}</article>', w) == BODY


HOSTILE = {
    "open tags": "<a" * 100_000, "one open tag": "<a" * 100_000 + ">", "open quotes": '<a b="' * 80_000, "closed in quotes": '<a b=">"' * 60_000, "mixed quotes": "<a b='x\" " * 60_000 + ">", "angles": "<" * 300_000,
    "comments": "<!--" * 100_000, "deep": "<div>" * 100_000, "closing": "<div>" * 50_000 + "</p>" * 50_000, "deep links": "<a><div>x" * 20_000, "areas": "<textarea>" * 50_000, "scripts": "<script></script>" * 30_000,
    "paragraphs": "<p>a" * 50_000, "adverts": "<p>a b c.<div class=ad>b</div>" * 10_000, "amps": "&" * 300_000, "declarations": "<!x" * 100_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_time_in_proportion(name):
    w = html.weights()
    began = time.process_time()
    html.main_text(HOSTILE[name], w)
    assert time.process_time() - began < 8


def test_tags_are_read_as_browsers_read_them():
    w = html.weights()
    say = lambda x: html.main_text(f"<article><p>{x}</p></article>", w)
    assert say('a <i title="x > y">b</i> c') == "a b c" and say("a <i title=it's>b</i> c") == "a b c"
    assert say("1 < 2 and 3 > 2") == "1 < 2 and 3 > 2" and say("<!-- x > <p>no</p> -->a<!DOCTYPE z>b") == "ab"
    assert say("&lt;p&gt; &amp;amp; &#x41;&nbsp;&euro;") == "<p> &amp; A €"


def test_very_long_page():
    long = " ".join(f"word{i}" for i in range(200_000))
    assert html.main_text(f"<nav>{MENU}</nav><article><p>{long}</p></article>", html.weights()) == long
