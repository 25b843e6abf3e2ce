import itertools
import random

import pytest

from nearfold.llm import html_extract as h

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<!-- ad --><div class="ad">Buy now, cheap.</div><div class="cookie-notice"><p>We use cookies.</p></div>
%s
<aside class="sidebar"><p>Related things that you may like to read some day.</p></aside>
<section id="comments"><div class="comment"><p>First! I do not agree with any of this at all.</p></div></section>
<form><label>Mail</label><input name="m"><button>Subscribe</button></form>
<footer>&copy; 2020 somebody &middot; all rights</footer></body></html>"""


@pytest.mark.parametrize(
    "body,want",
    [
        ("<article><h1>Head</h1><p>One &amp; two\n three.</p><p>Four<br>five <b>six</b></p></article>", "Head\n\nOne & two three.\n\nFour five six"),
        ("<article><h1>Head</h1><p><b>Open bold.<br><p>Next one &lt;here&gt;.</p></article>", "Head\n\nOpen bold.\n\nNext one <here>."),
        ("<main><div><p>Some text that is fairly long, as texts go.</p><div class='advert'>Ad text</div><p>And more of it.</p></div></main>", "Some text that is fairly long, as texts go.\n\nAnd more of it."),
        ("<div id='content'><h2>Title</h2><p>Words and words and words, and some more words.</p><ul><li>point one</li><li>point two</li></ul></div>", "Title\n\nWords and words and words, and some more words.\n\npoint one\n\npoint two"),
        ("", ""),
    ],
)
def test_article_only(body, want):
    assert h.extract(PAGE % body) == want


LONG = "<p>" + "Words of a long text that somebody wants to read. " * 8 + "</p>"


@pytest.mark.parametrize("names", ["single-post has-sidebar", "no-sidebar", "with-menu", "social-on", "comments-open", "has-sidebar no-comments ad"])
@pytest.mark.parametrize(
    "form",
    [
        "<html class='{n}'><body>{s}<article>{a}</article>{s}</body></html>",
        "<body class='{n}'>{s}<article>{a}</article>{s}</body>",
        "<body class='{n}'>{s}<div>{a}</div>{s}</body>",
        "<div id='{n}'>{s}<article>{a}</article>{s}</div>",
        "<div class='{n}'><div class='{n}'>{s}<main>{a}</main></div>{s}</div>",
        "<div class='{n}'>{s}<div role='main' class='{n}'>{a}</div></div>",
        "<div class='{n}'>{s}<article>{a}</article><article>{a}</article></div>",
        "<div class='{n}'>{s}<div><h1>Head</h1>{a}</div>{s}</div>",
    ],
)
def test_names_on_wrappers(names, form):
    side = "<nav class='menu'><a href='/'>Home</a></nav><div class='sidebar'><p>Other things to read.</p></div><section id='comments'><article class='comment'><p>I do not agree at all.</p></article></section>"
    got = h.extract(form.format(n=names, s=side, a=LONG))
    assert got.removeprefix("Head\n\n").split("\n\n")[0] == LONG[3:-4].strip()
    assert "Home" not in got and "Other" not in got and "agree" not in got


def test_side_blocks_with_articles_stay_out():
    side = "<div class='related'><article><h1>Else</h1><p>Another text.</p></article></div>"
    for page in (f"<article>{LONG}</article>{side}", f"<main>{LONG}{side}</main>", f"<div>{LONG}</div>{side}"):
        assert h.extract(page) == LONG[3:-4].strip()


@pytest.mark.parametrize(
    "attributes",
    ["title='The hidden cost of x'", 'data-title="a hidden life"', 'style="overflow: hidden !important"', "title=hidden", "data-hidden", "data-style='display: none'", "aria-hidden=false title='aria-hidden=true'", "data-class='sidebar' title=\"class='ad'\"", "style='x-display: none'"],
)
def test_words_in_values_hide_nothing(attributes):
    assert h.extract(f"<article {attributes}><p>Some <a {attributes}>linked</a> text.</p></article>") == "Some linked text."


@pytest.mark.parametrize("attributes", ["hidden", "HIDDEN=''", "class=x hidden", 'hidden="hidden"', "aria-hidden=true", 'ARIA-HIDDEN = "true"', "style='color: red; Display : None'", "style=display:none!important", "style='display&#58; none'"])
def test_hidden_elements_are_silent(attributes):
    assert h.extract(f"<article><p>Shown.</p><div {attributes}><p>Never shown.</p></div></article>") == "Shown."


@pytest.mark.parametrize("page", ["", "<", "<p", "plain", "<!-- open", "<p>a<script>never closed", "</div></p>x", "<a <b>c", "a < b > c &am &#x41;", "<p title='>'>q</p>"])
def test_broken_pages_do_not_crash(page):
    assert isinstance(h.extract(page), str)


def test_cut_off_page_keeps_its_article():
    page = PAGE % "<article><p>The text is here, and it is long enough.</p></article>"
    cut = page[: page.index("</article>") - 20]
    assert h.extract(cut) == "The text is here, and it"


def test_cut_is_minimal():
    """Against all labellings of small graphs."""
    rng = random.Random(3)
    for _ in range(150):
        n = rng.randrange(1, 8)
        odds = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]

        def cost(lab):
            return sum(max(0, -v) if x else max(0, v) for v, x in zip(odds, lab)) + sum(w for a, b, w in edges if lab[a] != lab[b])

        best = min(cost(x) for x in itertools.product((False, True), repeat=n))
        assert abs(cost(h.min_cut(odds, edges)) - best) < 1e-9


def test_neighbours_settle_a_doubtful_block():
    blocks = [h.Block("a", 3, 1), h.Block("b", -0.5, 1), h.Block("c", 3, 1)]
    assert h.label(blocks) == [True, True, True]
    blocks[1].odds = -6
    assert h.label(blocks) == [True, False, True]


def test_pages_hold_their_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in h.extract_pages(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = r.html.split("<article>")[1].split("</article>")[0]
        want = [b.text for b in h.blocks_of("<article>" + inner + "</article>")]
        assert got[r.page_id].text == "\n\n".join(want) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_odd_rows(spark):
    rows = [(1, None, None, "x"), (None, "u", "", "x"), (2, "u", "<p>a</p>", "x"), (2, "u", "<p>a</p>", "x"), (3, "u", "<article>" + "<p>some words here.</p>" * 5000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.n_chars) for r in h.extract_pages(df).collect())
    assert [g for g in got if g[0] in (0, 1)] == [(0, 0), (1, 0)] and got[-1][1] == 5000 * len("some words here.") + 2 * 4999
    assert h.extract_pages(df.limit(0)).count() == 0


QUOTES = "The story goes on for a while, and nobody minds that it does."


@pytest.mark.parametrize("tag", ["<p class=don't>", "<p title=o'neill>", '<p title=6"inch class=x>', "<p a=b'c d='e>f' g>", "<p hidden=\"\" >x</p><p>", "<p data-x='a>b' title=\"c>d\">", "<p / >", "<P\nCLASS = 'x'>"])
def test_quotes_inside_values(tag):
    assert h.extract(f"<article>{tag}{QUOTES}</p><p>{QUOTES} Twice.</p></article>") == f"{QUOTES}\n\n{QUOTES} Twice."


@pytest.mark.parametrize("name", ["class='cookieBanner'", "class='commentList'", "id='discussion'", "class='site-info'", "class='responses'", "id='userComments'", "class='GDPRNotice'", "class='adverts'"])
def test_names_of_side_parts(name):
    side = f"<div {name}><p>Something else that is written here beside the text, and it is not short.</p></div>"
    assert h.extract(f"<article>{LONG}{side}</article>") == LONG[3:-4].strip()
    assert h.extract(f"<div>{LONG}</div>{side}") == LONG[3:-4].strip()


@pytest.mark.parametrize("names", ["post search-result", "legal-news", "news-search", "share-price story", "socialHistory"])
def test_subjects_in_names_of_the_text(names):
    side = "<div class='sidebar'><p>Other things to read.</p></div><div class='share'><p>Tell your friends.</p></div>"
    assert h.extract(f"<body><div class='{names}'>{LONG}{LONG}</div>{side}</body>") == "\n\n".join([LONG[3:-4].strip()] * 2)


@pytest.mark.parametrize("page", ["<p " * 330_000, "<a b='" * 160_000, "<b>" * 150_000, "<b></i>" * 80_000, "<div>" * 100_000 + "</p>" * 50_000, "<!--" * 250_000, "<" * 1_000_000, "<script>" * 120_000, "<script>x</script " * 50_000, "<p>x" * 100_000, "=\"" * 400_000, "<a " + "b " * 400_000, "<a " + "=" * 800_000])
def test_long_pages_are_linear(page):
    import time

    begin = time.perf_counter()
    h.blocks_of(page)
    assert time.perf_counter() - begin < 4


def plain_blocks(page):
    """Blocks of a well-formed page by the standard library's parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.words = [], []

        def cut(self, tag):
            if tag == "br":
                self.words.append(" ")
            elif tag not in h._INLINE:
                self.out.append(" ".join("".join(self.words).split()))
                self.words = []

        def handle_starttag(self, tag, attrs):
            self.cut(tag)

        def handle_endtag(self, tag):
            self.cut(tag)

        def handle_data(self, data):
            self.words.append(data)

    r = Reader()
    r.feed(page)
    r.close()
    r.cut("div")
    return [x for x in r.out if x]


@pytest.mark.parametrize("seed", range(40))
def test_extraction_equals_brute_force_on_small_pages(seed):
    """Blocks by another parser; labels by trying all labellings."""
    rng = random.Random(seed)

    def grow(depth):
        out = ""
        for _ in range(rng.randint(1, 3)):
            kind = rng.random()
            if kind < 0.5 or depth > 3:
                words = " ".join(rng.choice(["alpha", "beta &amp; co", "<b>gamma</b>", "<a href='x>y'>delta</a>", "it's", "6 &lt; 7", "x<br>y"]) for _ in range(rng.randint(1, 9)))
                out += f"<p class={rng.choice(['a', 'don-t', chr(34) + 'comment x' + chr(34), 'menuItem'])}>{words}</p>"
            else:
                tag = rng.choice(["div", "section", "article", "nav", "ul", "footer"])
                out += f"<{tag} id='{rng.choice(['main', 'searchBox', 'story', 'z'])}'>{grow(depth + 1)}</{tag}>"
        return out

    page = f"<body>{grow(0)}</body>"
    blocks = h.blocks_of(page)
    assert [b.text for b in blocks] == plain_blocks(page)
    if len(blocks) > 12:
        return
    edges, last = [], {}
    for i, b in enumerate(blocks):
        edges += [(i - 1, i, h.NEXT_EDGE)] if i else []
        edges += [(last[b.parent], i, h.PARENT_EDGE)] if b.parent in last else []
        last[b.parent] = i

    def energy(keep):
        return sum(max(0, -b.odds) if k else max(0, b.odds) for b, k in zip(blocks, keep)) + sum(w for a, b, w in edges if keep[a] != keep[b])

    least = min(energy(k) for k in itertools.product([False, True], repeat=len(blocks)))
    keep = h.label(blocks)
    assert abs(energy(keep) - least) < 1e-9
    assert h.extract(page) == "\n\n".join(b.text for b, k in zip(blocks, keep) if k)
