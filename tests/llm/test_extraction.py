"""The main text of pages that are laid out in many ways around blocks that are known."""

import random
import time

import pytest

from territoria.llm.html_extract import main_text

PROSE = "A sentence of some length, with commas, that reads like prose and goes on for a while until it ends."


def blocks(seed, n=6):
    """(html, text) of an article's blocks."""
    r = random.Random(seed)
    out = [("<h2>The heading of it</h2>", "The heading of it")]
    for k in range(n):
        words = " ".join(r.choice(("alpha", "beta", "gamma,", "delta", "epsilon")) for _ in range(r.randrange(25, 70)))
        out.append(r.choice(((f"<p>{k} {words}</p>", f"{k} {words}"), (f"<p>{k} <b>{words}</b> <a href=x>link</a></p>", f"{k} {words} link"), (f"<ul><li>{k} {words}</li></ul>", f"{k} {words}"))))
    return [*out, (f"<p>{PROSE} {PROSE}</p>", f"{PROSE} {PROSE}")]


NAV = '<nav><a href="/">Home</a> <a href="/b">Blog</a></nav>'
SIDE = f'<div class="sidebar"><p>{PROSE}</p><p>{PROSE}</p></div>'
FOOT = f"<footer><p>Imprint. {PROSE}</p></footer>"
COMMENTS = "".join(f"<div class=entry-{k}><p>I say, well, {PROSE} {PROSE}</p></div>" for k in range(30))

#: What stands around an article; {} is its place.
AROUND = {
    "blog": '<div id="page" class="site">' + NAV + '<div id="content" class="site-content"><div id="primary" class="content-area"><main id="main" class="site-main"><article class="post hentry"><div class="entry-content">{}</div></article></main></div>' + SIDE + "</div></div>" + FOOT,
    "page-wrapper": '<div id="page-wrapper">' + NAV + "<article>{}</article>" + FOOT + "</div>",
    "page-container": '<div class="page-container"><div class="page-body">' + NAV + '<div class="text">{}</div></div></div>' + FOOT,
    "alert-article": NAV + '<article class="alert">{}</article>' + FOOT,
    "site-inner": '<div class="site-inner"><div class="page-section">{}</div>' + SIDE + "</div>",
    "media-body": '<div class="media"><div class="media-body"><div class="media-content">{}</div></div></div>' + FOOT,
    "sticky": '<div class="sticky-posts"><div>{}</div></div>' + FOOT,
    "form": '<form method="post" action="./p.aspx"><input type="hidden" name="v"><div class="top">' + NAV + "</div><div id=body>{}</div></form>" + FOOT,
    "form-and-form": '<form id="aspnetForm"><div class="cols"><div id="c">{}</div></div></form><form><p>Write to us, please. ' + "Yes, do. " * 20 + "</p></form>",
    "form-in-article": "<article>{}<form><input><p>Your address, please, so that we can write to you about all this.</p></form></article>",
    "page-content-in-article": '<article><div class="page-content">{}</div></article>',
    "reader-comments": "<div><div class=text>{}</div><div class='reader-comments'>" + COMMENTS + "</div></div>",
    "discussion": "<main><div>{}</div><section class='discussion'>" + COMMENTS + "</section></main>",
    "comments-as-articles": "<article>{}</article><ol class='comment-list'>" + "".join(f"<li><article class=c{k}><p>{PROSE} {PROSE} {PROSE}</p></article></li>" for k in range(30)) + "</ol>",
    "comments-id": "<div class=post>{}</div><div id=comments>" + COMMENTS + "</div>",
    "related-as-articles": NAV + "<main><article>{}</article><section class='related-posts'>" + f"<article><p>{PROSE}</p></article>" * 9 + "</section></main>",
    "main-in-form": "<form><main>{}</main></form>" + FOOT,
    "role-main": NAV + "<div role=main>{}</div>" + SIDE,
    "table": "<table><tr><td class=menu><ul><li><a href=1>Home</a></ul></td><td>{}</td></tr></table>",
    "cookie": "{}<div class='cookie-notice'><p>We use cookies, as all do. " + PROSE + "</p></div><div id=cookieBanner>" + PROSE + "</div>",
    "ads": "<article>{}<div class=ad><p>Buy this, now. " + PROSE + "</p></div></article>",
    "hidden": "<div>{}<div style='display:none'><p>" + PROSE + "</p></div><div aria-hidden=true>" + PROSE + "</div></div>",
    "prev-next": "<main><div class=x><a href=1>The previous article, with a long title</a> <a href=2>The next one, with a longer title still</a></div><div class=y>{}</div></main>",
    "old-article": "<div class=teasers>" + "<article><h3>Other</h3><p>Only a teaser here, short.</p></article>" * 3 + "</div><div class=text>{}</div>",
    "scripts": "<div><script>var a = '<p>x</p>';</script><style>p {}</style>".replace("{}", "{{}}") + "{}<noscript><p>Switch it on.</p></noscript></div>",
    "bare": "{}",
}


@pytest.mark.parametrize("name", sorted(AROUND))
def test_layouts(name):
    for seed in range(25):
        body = blocks(f"{name}{seed}")
        page = "<html><head><title>T</title></head><body>" + AROUND[name].replace("{}", "".join(x for x, _ in body), 1).replace("{{}}", "{}") + "</body></html>"
        if name == "scripts":
            page = "<body><div><script>var a = '<p>x</p>';</script><style>p {}</style>" + "".join(x for x, _ in body) + "<noscript><p>Switch it on.</p></noscript></div></body>"
        assert main_text(page) == "\n".join(x for _, x in body)


@pytest.mark.parametrize("before,after", [("", ""), ("<main>", "</main>"), ("<div class=page-wrapper>", "</div>"), ("<article>", "</article>")])
def test_sections_in_boxes_side_by_side(before, after):
    """Lead, middle and end stand in boxes of their own; the middle has nearly all points."""
    lead, end = f"Lead. {PROSE}", f"End. {PROSE}"
    body = blocks("s", 12)
    page = f"<body>{NAV}{before}<div class=lead><p>{lead}</p></div><div>{''.join(x for x, _ in body)}</div><div class=closing><p>{end}</p></div>{after}{SIDE}{FOOT}</body>"
    assert main_text(page) == "\n".join([lead, *(x for _, x in body), end])


def test_short_pages_and_pages_that_are_marked_as_a_whole():
    assert main_text("<body><form><p>Short.</p></form></body>") == "Short."
    assert main_text("<body><div class=sidebar><p>Short.</p></div></body>") == "Short."
    assert main_text(f"<body><div class=comments><p>{PROSE}</p></div></body>") == PROSE
    assert main_text("<body><main>Short.</main><nav>x</nav></body>") == "Short."
    assert main_text("<body><nav>x</nav></body>") == main_text("<body><main></main></body>") == ""


def test_time_is_linear_in_pages_of_many_marked_boxes():
    took = []
    for n in (2_000, 20_000):
        page = "<body>" + "<div class='page-wrapper comments'>" * 500 + f"<div class=ad><p>{PROSE}</p></div><form><p>{PROSE}</p>" * n
        began = time.process_time()
        main_text(page)
        took.append(time.process_time() - began)
    assert took[1] < 30 * max(took[0], 0.05)
