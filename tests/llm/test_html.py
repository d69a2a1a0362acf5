"""HTML extraction: the linear scan against brute force, kinds of furniture, and pages that are broken or long."""

import random
import time

import pytest

from ledgerloom.llm import html_text

#: As pages with articles, and links around them, give them.
WEIGHTS = {"w:p": 1.0, "w:h1": 1.0, "w:div": 0.2, "w:body": -0.9, "w:li": 0.5, "p": -0.01, "/p": -0.01, "h1": -0.01, "/h1": -0.01, "div": -0.5, "/div": -0.5, "a": -1.5, "/a": -1.5, "article": -0.01, "/article": -0.01}


def test_the_region_is_the_best_one():
    rng = random.Random(1)
    for _ in range(500):
        scores = [rng.choice([-3, -1, -0.5, 0, 0.5, 1, 2]) for _ in range(rng.randrange(12))]
        sums = [sum(scores[a : b + 1]) for a in range(len(scores)) for b in range(a, len(scores))]
        first, last = html_text.best_region(scores)
        assert sum(scores[first : last + 1]) == max([0, *sums])
        assert (last < 0) == (max([0, *sums]) == 0)


BODY = "<h1>Title</h1><p>First words of the page.</p>{}<p>Last words of the page.</p>"
WANT = "Title\nFirst words of the page.\nLast words of the page."


@pytest.mark.parametrize("around", ["<body><article>{}</article></body>", "<body><div class='content'>{}</div></body>", "<body>{}</body>", "<body><form id=aspnetForm>{}</form></body>"])
@pytest.mark.parametrize(
    "inside",
    [
        '<p class="advert">Buy this thing now</p>',
        '<span class="ad-slot">Buy this</span>',
        '<a class="share-button" href=x>Share</a>',
        '<h3 class="sponsored">From our sponsor</h3>',
        '<div class="commentList"><p>nice post</p></div>',
        '<section class="comments"><article class="comment"><p>I like it</p></article></section>',
        '<article class="comment-body"><p>I like it</p></article>',
        '<aside class="related"><article><h2>Teaser</h2></article></aside>',
        '<div class="post-comments user-comment">nice</div>',
        '<p class="notice">We use your data.</p>',
        '<p class="advert">Never closed',
        '<form><label>Name</label><select><option>one<option>two</select><button>Send</button></form>',
        '<div role="complementary">aside</div><div hidden>x</div><div style="display: none">x</div>',
        '<ul class="nav"><li>Home<li>More</ul>',
        "<nav><p>one<p>two</nav>",
    ],
)
def test_furniture_is_left_out(around, inside):
    assert html_text.extract(around.format(BODY.format(inside)), WEIGHTS) == WANT


@pytest.mark.parametrize("name", ["search-engines-article", "post social history", "history-of-advertising", "entry-content", "shared-memory", "headers-explained", "navigationless", "article-page"])
def test_names_that_only_look_like_furniture(name):
    assert html_text.extract(f'<body><div class="{name}">{BODY.format("")}</div><div class="nav">x</div></body>', WEIGHTS) == WANT


@pytest.mark.parametrize(
    "page",
    [
        '<p title="hidden valley" data-x="class=ad" width=3>{}</p>',
        "<p data-hidden=1 href='?id=share'>{}</p>",
        "<head><title>Site</title><body><p>{}",
        "<head><p>{}",
        "<body><p alt='a > b'>{}</p>",
        "<body><p it's>{}</p>",
    ],
)
def test_attributes_and_open_heads(page):
    assert html_text.extract(page.format("Some words &lt;here&gt; of&nbsp;it"), WEIGHTS) == "Some words <here> of it"


def test_a_page_is_scored_alike_with_and_without_an_article():
    inner = "<p>Ten words that are the text of this page here.</p><p>Short.</p>"
    links = "<div><a>One</a> <a>Two</a> <a>Three</a></div>"
    for page in (f"<body>{links}<article>{inner}</article>{links}</body>", f"<body>{links}<div>{inner}</div>{links}</body>"):
        assert html_text.extract(page, WEIGHTS) == "Ten words that are the text of this page here.\nShort."


def test_weights_come_from_marked_pages(spark):
    rows = [(k, "u", f"<body><div><a>Link {k}</a><a>Other</a></div><article><h1>T</h1><p>Some words.</p><nav>x</nav></article></body>") for k in range(5)]
    weights = html_text.learn_weights(spark.createDataFrame([*rows, (9, "u", None), (10, "u", "<p>unmarked")], "page_id long, url string, html string"))
    assert weights["w:p"] > 0.5 and weights["w:h1"] > 0.5 and weights["w:div"] < 0
    assert weights["a"] < -2 and -0.1 < weights["p"] < 0 and "w:nav" not in weights


@pytest.mark.parametrize("part", ["<a ", "<a x='\">'", "<p class='", "<!--", "<script>", "< ", "<div>", "<b>", "</x>", "<li>", "<svg><p>", "<form>x", "<p><div class=ad>x", "<a ='\""])
def test_time_grows_with_length_only(part):
    began = time.time()
    html_text.extract(part * 100_000, WEIGHTS)
    assert time.time() - began < 20


def test_a_long_page():
    page = "<body><article>" + "<p>some more words</p>" * 50_000 + "</article><footer>end</footer>"
    assert html_text.extract(page, WEIGHTS) == "\n".join(["some more words"] * 50_000)


@pytest.mark.parametrize("name", ["content sidebar-right", "post sidebar", "page comments", "main banner"])
@pytest.mark.parametrize("element", ["div", "article", "section"])
def test_a_content_name_on_an_element_wins(element, name):
    assert html_text.extract(f'<body><{element} class="{name}">{BODY.format("")}</{element}><div class="nav">x</div></body>', WEIGHTS) == WANT


@pytest.mark.parametrize(
    "name", ["google-ad", "dfp-ad", "adunit", "taboola", "outbrain", "paid-content", "cookieconsent", "popup-overlay", "sitenav", "side-bar", "fb-comments", "commentarea", "discussion", "responses"]
)
def test_more_names_of_furniture_inside_an_article(name):
    assert html_text.extract(f'<body><article>{BODY.format(f"<div class={name}><p>Other words stand here.</p></div>")}</article></body>', WEIGHTS) == WANT


def test_notes_labels_and_sections_that_are_content():
    assert html_text.extract('<article role="note"><p>He <label>said</label> so.</p></article>', {}) == "He said so."
    assert html_text.extract('<article><p>One.</p><section id="discussion"><h2 class="discussion">Talk</h2><p>Two.</p></section></article>', {}) == "One.\nTalk\nTwo."


#: Pages with an article, their menus, slogans and adverts beside it, as a table of pages has them.
TRAINING = [
    f"<body><nav><ul><li><a href=x>Home {k}</a><li><a href=y>News</a><li><a href=z>More</a></ul></nav><div>Our slogan {k}</div><div class=ad>Buy one thing now.</div><article><h1>Title number {k} of these</h1>"
    + "<p>Words of the text that go on and on, with commas and all that, until there are many of them in it, more than thirty in any case, since texts are long.</p><p>A shorter one of some ten words, more or less.</p>" * (1 + k % 3)
    + f"</article><table><tr><td><a href=a>May {k}</a><td><a href=b>June</a></table><footer>Imprint of {k}</footer></body>"
    for k in range(40)
]


@pytest.fixture(scope="module")
def learned(spark):
    return html_text.learn_weights(spark.createDataFrame([(k, "u", h) for k, h in enumerate(TRAINING)], "page_id long, url string, html string"))


TEXT = "<h1>A title of this page</h1><p>" + "Some long text with many words that tell a story about things, and it goes on for a while so that nobody takes it for a menu. " * 2 + "</p><p>Its last paragraph is not as long, but it has some words.</p>"
PLAIN_TEXT = "A title of this page\n" + ("Some long text with many words that tell a story about things, and it goes on for a while so that nobody takes it for a menu. " * 2).strip() + "\nIts last paragraph is not as long, but it has some words."
LINKS = "<div><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div>"


@pytest.mark.parametrize(
    ("before", "after"),
    [("<div>Site slogan words here</div>", ""), (LINKS, LINKS), ("", "<table><tr><td><a href=a>May 2020</a><td><a href=b>June 2020</a></table>"), ("<ul><li><a href=1>Home</a><li><a href=2>News</a></ul>", "<div>All rights reserved</div>")],
)
def test_the_scan_cuts_what_stands_beside_the_text(learned, before, after):
    """Without names of classes: the region is the article, and a page without that element gets the same text."""
    for page in (f"<body>{before}<article>{TEXT}</article>{after}</body>", f"<body>{before}<div>{TEXT}</div>{after}</body>"):
        assert html_text.extract(page, learned) == PLAIN_TEXT
        assert html_text.extract(page, learned, lambda scores: (0, len(scores) - 1)) != PLAIN_TEXT


def test_long_text_beside_an_article_goes(learned):
    beside = "<div>" + "This site is about many things and has been here for many years, which we tell at length on each page. " * 3 + "</div>"
    assert html_text.extract(f"<body>{beside}<article>{TEXT}</article>{beside}</body>", learned) == PLAIN_TEXT


def test_nothing_of_an_article_is_cut(learned):
    inside = TEXT + "<ul><li><a href=1>Link</a><li>item</ul><div class=comments>" + "<p>I like it very much indeed.</p>" * 300 + "</div><p>End, see <a href=x>here</a>.</p>"
    assert html_text.extract(f"<body><nav><a>x</a></nav><article>{inside}</article></body>", learned) == PLAIN_TEXT + "\nLink\nitem\nEnd, see here."


def test_small_articles_that_hold_little_of_a_page_are_no_article(learned):
    teaser = "<article><h2>Teaser</h2></article>"
    assert PLAIN_TEXT in html_text.extract(f"<body><div>{TEXT}</div>{teaser}{teaser}</body>", learned)


def test_the_scan_finds_the_text_without_lists_of_furniture(learned, monkeypatch):
    """Pages as the table has them: with no element or name taken for furniture the weights and the scan give the same text."""
    want = [html_text.extract(page, learned) for page in TRAINING]
    bare = [page.replace("<article>", "<div>").replace("</article>", "</div>") for page in TRAINING]
    monkeypatch.setattr(html_text, "_furniture", lambda name, attributes: 0)
    assert [html_text.extract(page, learned) for page in TRAINING] == want
    assert [html_text.extract(page, learned) for page in bare] == want
    assert all(html_text.extract(page, learned, lambda scores: (0, len(scores) - 1)) != text for page, text in zip(TRAINING, want, strict=True))
