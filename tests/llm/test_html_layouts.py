"""Pages laid out by hand, each with its article's blocks and what is not to be in the text."""

import pytest

from parlance.llm import html_text

ONE = "One sentence of some ninety-five characters stands here as the only text that the article does have."
TWO = "The council met on Tuesday evening and agreed, after a long debate, to repair the old bridge before winter comes."
THREE = "Nobody spoke against the plan, although the cost of it had been a matter of dispute for several years."
FEW = "Short."
NAV = '<nav><a href="/">Home</a> <a href="/news">News</a> <a href="/sport">Sport</a></nav>'
P = lambda *texts: "".join(f"<p>{t}</p>" for t in texts)
LINKS = "<ul><li><a href=a>The first report of it</a></li><li><a href=b>The second report</a></li><li><a href=c>All minutes of the meeting</a></li></ul>"
SIDE = "<ul><li><a href=a>Most read</a></li><li><a href=b>Latest</a></li><li><a href=c>Videos</a></li></ul>"

PAGES = {
    "main and article": (f"<main><article>{P(ONE)}</article></main>", [ONE]),
    "a division named content": (f'<div class="content">{P(ONE)}</div>', [ONE]),
    "a division around an article": (f'<div class="content"><article>{P(ONE)}</article></div>', [ONE]),
    "comments as articles after main": (f"<main><article>{P(ONE)}</article></main><article><p>I liked this one.</p></article><article><p>So did I, really.</p></article>", [ONE]),
    "comments as articles in main": (f'<main><article>{P(ONE, TWO)}</article><article class="comment"><p>Nice words indeed.</p></article></main>', [ONE, TWO]),
    "a section of comments": (f'<article>{P(TWO, THREE)}</article><section class="comments"><article><p>{ONE}</p></article></section>', [TWO, THREE]),
    "a name that lies": (f'<article class="cookie-policy"><h1>Cookies we use</h1>{P(ONE, TWO)}</article>', ["Cookies we use", ONE, TWO]),
    "another name that lies": (f'<body>{NAV}<article id="banner-history"><h1>A history of banners</h1>{P(TWO)}</article></body>', ["A history of banners", TWO]),
    "a list of links in an article": (f"<article>{P(ONE)}{LINKS}</article>", [ONE, "The first report of it", "The second report", "All minutes of the meeting"]),
    "a paragraph that is a link": (f"<article><p><a href=x>{ONE}</a></p>{P(TWO)}</article>", [ONE, TWO]),
    "one short word": (f"<article>{P(FEW)}</article>", [FEW]),
    "a long plain footer": (f"<p>{TWO}</p><footer>{ONE} {TWO} {THREE} {ONE}</footer>", [TWO]),
    "rights reserved": (f"<p>{TWO}</p><div>All rights reserved.</div>", [TWO]),
    "a bare page": (f"<html><body>{P(TWO, THREE)}</body></html>", [TWO, THREE]),
    "a menu before bare paragraphs": (f"<body>{NAV}{P(TWO, THREE)}</body>", [TWO, THREE]),
    "a sidebar in main": (f'<main>{P(TWO, THREE)}<aside><h3>Popular</h3>{SIDE}</aside></main>', [TWO, THREE]),
    "a sidebar by name": (f'<div class="page"><div class="sidebar">{SIDE}</div><div class="article">{P(TWO, THREE)}</div></div>', [TWO, THREE]),
    "an advert between paragraphs": (f'<article>{P(TWO)}<div class="ad"><p>Buy two and get three of them now!</p></div>{P(THREE)}</article>', [TWO, THREE]),
    "a newsletter form": (f'<article>{P(TWO)}<form class="newsletter"><p>Get our letter every week.</p><input><button>Sign up</button></form>{P(THREE)}</article>', [TWO, THREE]),
    "a cookie notice first": (f'<div class="cookie-consent"><p>We use cookies to make this site better for you.</p><button>Accept</button></div><article>{P(TWO)}</article>', [TWO]),
    "a header with a slogan": (f"<header><h1>The Daily Page</h1><p>News since 1901</p></header><main><h1>A bridge</h1>{P(TWO, THREE)}</main>", ["A bridge", TWO, THREE]),
    "headings and quotes": (f"<article><h1>A bridge</h1>{P(TWO)}<h2>Costs</h2><blockquote><p>{THREE}</p></blockquote></article>", ["A bridge", TWO, "Costs", THREE]),
    "a table in the article": (f"<article>{P(TWO)}<table><tr><td>Year</td><td>Cost</td></tr><tr><td>1998</td><td>17</td></tr></table></article>", [TWO, "Year", "Cost", "1998", "17"]),
    "unclosed paragraphs": (f"<article><p>{TWO}<p>{THREE}</article>{NAV}", [TWO, THREE]),
    "text straight in the article": (f"<article>{TWO}<br><br>{THREE}</article>", [f"{TWO} {THREE}"]),
    "two menus and a copyright line": (f'{NAV}<div id="main">{P(TWO, THREE)}</div>{NAV}<footer>&copy; The Daily Page</footer>', [TWO, THREE]),
    "share buttons": (f'<article>{P(TWO)}<div class="share"><a href=x>Tweet</a> <a href=y>Mail</a></div></article>', [TWO]),
    "related links by name": (f'<article>{P(TWO, THREE)}<div class="related"><h3>See also</h3>{SIDE}</div></article>', [TWO, THREE]),
    "a login form": (f'<form class="login"><label>Name</label><input><button>Log in</button></form><main><article>{P(ONE)}</article></main>', [ONE]),
    "breadcrumbs": (f'<div class="breadcrumbs"><a href=x>Home</a> / <a href=y>News</a></div><article><h1>A bridge</h1>{P(ONE)}</article>', ["A bridge", ONE]),
    "references and white space": ("<article><p>Fish &amp; chips\n\t cost &lt;&nbsp;5 &euro; in the old town since years, they say.</p></article>", ["Fish & chips cost < 5 € in the old town since years, they say."]),
    "scripts and styles": (f"<head><style>p {{ color: red }}</style></head><script>var a = '<p>no</p>';</script><article>{P(ONE)}<script>track()</script></article>", [ONE]),
    "nothing": ("", []),
    "a menu alone": (f"<body>{NAV}</body>", []),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    page, want = PAGES[name]
    assert html_text.trained().text(page).split("\n") == (want or [""])
