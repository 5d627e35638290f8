"""Texts of articles that names of their parts must not hide, pages inside forms, and pages that nothing closes."""

import time

import pytest

from lodestar.llm import html


def texts(page):
    return [b.text for b in html.read_page(page).kept]


def article(part):
    return f"<html><body><nav>menu</nav><article><h1>Title</h1><p>First.</p>{part}<p>Last.</p></article><footer>foot</footer></body></html>"


@pytest.mark.parametrize(
    ("part", "kept"),
    [
        ('<section id="discussion"><h2>Discussion</h2><p>We discuss.</p></section>', ["Discussion", "We discuss."]),
        ('<section class="related-work"><p>Others did.</p></section>', ["Others did."]),
        ('<h2 id="login">Login</h2><p>How to.</p>', ["Login", "How to."]),
        ('<h2 id="search">Search</h2>', ["Search"]),
        ('<p id="share-price">Prices fell.</p>', ["Prices fell."]),
        ('<p class="notice-of-appeal">The appeal.</p>', ["The appeal."]),
        ("<p>Let <math><mi>x</mi><mo>+</mo><mn>1</mn><annotation>x+1</annotation></math> be.</p>", ["Let x+1 be."]),
        ("<p>Before <svg>after</p>", ["Before after"]),
        ("<object><p>Inside.</p>", ["Inside."]),
        ('<div class="comments"><p>First!</p></div>', []),
        ('<div class="related-posts"><p>More.</p></div>', []),
        ('<p class="ad">Buy.</p>', []),
        ("<form>Your address <input></form>", []),
        ('<h2 hidden>Secret</h2><p style="display:none">gone</p>', []),
    ],
)
def test_parts_of_an_article(part, kept):
    assert texts(article(part)) == ["Title", "First.", *kept, "Last."]


def test_a_form_around_the_page_hides_nothing():
    body = "<p>" + "Words of the page. " * 20 + "</p>"
    whole = [("Words of the page. " * 20).strip()]
    assert texts(f'<body><form id="aspnetForm">{body}<div class="ad">Buy.</div></form></body>') == whole
    assert texts(f'<body><form id="aspnetForm"><nav>menu</nav><article>{body}</article></form></body>') == whole
    assert texts(f"<body>{body}<form>Log in</form></body>") == whole


def test_nested_wrappers_take_linear_time():
    def seconds(n):
        began = time.perf_counter()
        html.read_page('<div class="no-sidebar">x ' * n + "<p>text</p>" + "</div>" * n)
        return time.perf_counter() - began

    seconds(100)
    assert seconds(8000) < 12 * seconds(2000) + 0.5
