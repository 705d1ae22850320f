"""Main text of pages without an article: everything beside the best container that is text."""

from veriscore.llm.html_text import main_text

LONG = "".join(f"<p>Paragraph {i}, which says a few things, one after another.</p>" for i in range(6))
TEXT = " ".join(f"Paragraph {i}, which says a few things, one after another." for i in range(6))
PARTS = f"<h2>Head</h2><div>{LONG}</div><div>One closing paragraph of a usual length.</div><ul><li>one</li><li>two</li><li>three</li></ul>"
WHOLE = f"Head {TEXT} One closing paragraph of a usual length. one two three"
LINKS = "<ul><li><a href=a>Other page</a></li><li><a href=b>Another page</a></li></ul>"


def test_no_article():
    for start, end in (("<main>", "</main>"), ("<div role=main>", "</div>"), ("<div id=page>", "</div>")):
        assert main_text(f"<html><body>{start}{PARTS}{LINKS}{end}<footer>(c)</footer></body></html>") == WHOLE
    assert main_text(f"<body><main>{PARTS}</main><div>Words outside the main element, long enough.</div>") == WHOLE


def test_short_containers_and_headings():
    assert main_text("<body><div><p>First part.</p></div><div><p>Second part.</p></div>") == "First part. Second part."
    assert main_text(f"<body><div><h3>Head</h3><div>{LONG}</div>{LINKS}</div>") == f"Head {TEXT}"
    assert main_text("<body><article><p>First, one.</p></article><article><p>Second, one.</p></article>") == "First, one. Second, one."
    assert main_text(f"<body><div>{LONG}<p><a href=x>A paragraph that is a link</a></p></div>") == f"{TEXT} A paragraph that is a link"


def test_sections_of_one_block():
    sections = LONG.replace("<p>", "<section><p>").replace("</p>", "</p></section>")
    assert main_text(f"<body><div id=x><b>Menu</b></div><div><h2>Head</h2>{sections}</div><div>(c) us</div>") == f"Head {TEXT}"


STORY = "<article><h1>T</h1><p>Long, long paragraph, of some words.</p><p>Second, one.</p></article>"
STORY_TEXT = "T Long, long paragraph, of some words. Second, one."


def test_names_around_an_article_do_not_drop_it():
    for start, end in (('<div class="layout has-sidebar">', "</div>"), ('<div class="page no-banner">', "</div>"), ('<section id="news-alert">', "</section>"), ('<div class="menu">', "</div>"), ("<form action=x><input>", "</form>"), ('<div class="sidebar"><div id=nav>', "</div></div>")):
        assert main_text(f"<body>{start}{STORY}{end}<footer>(c)</footer></body>") == STORY_TEXT
    assert main_text('<article><div class="entry-header header"><h1>T</h1></div><p>Long, long paragraph, of some words.</p></article>') == "T Long, long paragraph, of some words."
    plain = "<p>" + "words of a story, " * 8 + "</p>"
    assert main_text(f"<form><div>{plain}{plain}</div></form>") == " ".join(["words of a story, " * 8] * 2).replace("  ", " ").strip()


def test_whole_unwanted_names_are_left_out():
    for name in ("sidebar", "ad", "adBanner", "comment-list", "cookie-notice", "site-footer", "nav_menu", "widget-area", "comments comment-12", "side-bar", "related"):
        assert main_text(f'<body>{STORY}<div class="{name}"><p>Buy, this, now, really, good, one</p></div></body>') == STORY_TEXT
        inside = STORY.replace("<p>Second", f'<div id="{name}"><p>Buy, this</p></div><p>Second')
        assert main_text(inside) == STORY_TEXT
    assert main_text(f"{STORY}<div id=comments><article class=comment><p>Nice, post, really, good, one</p></article></div>") == STORY_TEXT
    assert main_text('<div class="cookie-notice"><p>We use cookies, ok.</p></div>') == "" == main_text("<form><p>User, name</p><input></form>")
