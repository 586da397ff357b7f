"""Articles are read whole, and nothing beside them."""

import random
import tracemalloc

import pytest

from lodestar.llm import html_extract

BODY = "".join(f"<p>Sentence {k} of a long body, with words, and with marks.</p>" for k in range(40))
ARTICLE = "<body><nav>Menu</nav><article><h1>Head</h1><p>First, long, text.</p>{}<p>Second one.</p></article><footer>f</footer></body>"


def test_heading_and_lead_beside_the_body():
    for tag in ("article", "main"):
        page = f"<body><nav><a href='/'>Menu</a></nav><{tag}><h1>Title</h1><p>The lead.</p><div class='entry-content'>{BODY}</div></{tag}><footer>f</footer></body>"
        for path in [None, *{p for p, _ in html_extract.votes(page)}]:
            lines = html_extract.extract(page, path).split("\n")
            assert lines[:2] == ["Title", "The lead."] and len(lines) == 42


@pytest.mark.parametrize(
    "noise",
    [
        '<p class="advert">Buy</p>', '<p class="cookie-notice">C</p>', "<p hidden>H</p>", '<p style="display: none">D</p>', "<em class=ad>x</em>",
        '<div class="share-buttons">S</div>', '<div class="sidebarLeft">S</div>', "<div id=comments><p>Nice, very nice.</p></div>",
        '<article class="comment"><p>Reply</p></article>', '<div class="related-posts">r</div>', "<form><input><label>Mail</label></form>",
    ],
)
def test_noise_within_an_article(noise):
    assert html_extract.extract(ARTICLE.format(noise), None) == "Head\nFirst, long, text.\nSecond one."


@pytest.mark.parametrize(
    "part",
    [
        '<div class="follow-up">kept</div>', '<section class="social-history">kept</section>', "<p title=it's>kept</p>", '<p title="a>b">kept</p>',
        '<p title="never ended>kept</p>', "<header><h2>kept</h2></header>", "<header><h2>kept</h2>" + "<div>" * 500 + "</div>" * 500 + "</header>",
    ],
)
def test_parts_of_an_article(part):
    assert html_extract.extract(ARTICLE.format(part), None) == "Head\nFirst, long, text.\nkept\nSecond one."


def test_page_in_one_form():
    assert html_extract.extract("<body><form><nav>m</nav><div><h1>T</h1><p>Text, more text.</p></div></form></body>", None) == "T\nText, more text."
    assert html_extract.extract("<body><form><p>Text, more text.</p></form></body>", None) == "Text, more text."


def test_memory_in_proportion():
    page = "<body>" + "<div class=part>" * 20_000 + "deep" + "</div>" * 20_000
    tracemalloc.start()
    assert html_extract.extract(page, None) == "deep" and len(html_extract.votes(page)) == 3
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * len(page)


NOISE = [
    "<nav><ul><li><a href=/>Home</a><li><a href=/b>More</a></ul></nav>", '<div class="cookie-notice"><p>We use cookies, as all do.</p></div>',
    "<aside><p>Elsewhere, on this site.</p></aside>", '<div id="sidebar"><p>Popular, new, and old.</p></div>', "<script>var x = '<p>no</p>';</script>",
    "<footer><p>All of it, 2024.</p></footer>", '<form action="/s"><input name=q><button>Go</button></form>', '<p class="advert">Buy, now.</p>',
    '<section class="comments"><p>First, I say.</p></section>', "<!-- <p>no</p> -->", "<style>p { margin: 0 }</style>", "<noscript>No, scripts.</noscript>",
]


def test_made_pages(spark):
    """Articles of random blocks among random noise, in a container by host, against the blocks that they were made of."""
    rng, pages, wanted = random.Random(9), [], {}
    shells = ["<article>{}</article>", '<div class="post-{k}"><div class="entry-content">{}</div></div>', "<main><section>{}</section></main>", '<table><tr><td id="text">{}</td></tr></table>']
    for k in range(120):
        blocks, body = [], []
        for j in range(rng.randint(2, 9)):
            said = [rng.choice(["one", "two,", "thr&eacute;e", "A&amp;B", "&lt;b&gt;", "x.", "end;"]) for _ in range(rng.randint(3, 30))]
            tag = rng.choice(["p", "p", "p", "h2", "li", "blockquote", "pre"])
            inner = [f"<{t}>{w}</{t}>" if (t := rng.choice(["", "", "b", "i", "span"])) else w for w in said]
            block = rng.choice([" ", "\n  ", "\t", "&nbsp;"]).join(inner)
            body.append(f"<ul><li>{block}</ul>" if tag == "li" else f"<p>{block}" if tag == "p" else f"<{tag}>{block}</{tag}>")
            blocks.append(" ".join(said).replace("&eacute;", "é").replace("&amp;", "&").replace("&lt;", "<").replace("&gt;", ">"))
            if rng.random() < 0.3:
                body.append(rng.choice(NOISE[1:]))
        around = [rng.choice(NOISE) for _ in range(rng.randint(0, 5))]
        shell = shells[k % 4].replace("{k}", str(k)).replace("{}", "\n".join(body))
        pages.append((k, f"http://host{k % 4}.example/{k}", f"<html><body>{' '.join(around)}{shell}{rng.choice(NOISE)}</body></html>"))
        wanted[k] = "\n".join(blocks)
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html_extract.extract_pages(df).collect()}
    assert found == wanted
