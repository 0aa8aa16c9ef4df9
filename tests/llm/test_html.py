from collections import Counter
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from lexloom.llm import contracts, html_labels, html_text


class Article(HTMLParser):
    """Blocks of the article of a page whose boilerplate stands outside of it."""

    def __init__(self):
        super().__init__()
        self.on, self.blocks, self.now = False, [], []

    def cut(self):
        text = " ".join("".join(self.now).split())
        self.blocks += [text] if text else []
        self.now = []

    def handle_starttag(self, tag, attrs):
        self.on |= tag == "article"
        if tag == "br":
            self.now.append(" ")
        elif tag not in html_text.INLINE:
            self.cut()

    def handle_endtag(self, tag):
        if tag not in html_text.INLINE:
            self.cut()
        if tag == "article":
            self.on = False

    def handle_data(self, data):
        if self.on:
            self.now.append(data)


def test_query_equals_a_plain_parser(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = contracts.op5_html(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        plain = Article()
        plain.feed(pages[r.page_id].html)
        plain.close()
        assert r.text == "\n".join(plain.blocks) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def gold(page):
    """Blocks of the marked words of a labelled page."""
    blocks = {}
    for r in html_text.runs_of(page):
        if not r.name and html_labels.MARK in r.text:
            blocks.setdefault(r.block, []).append(r.text.replace(html_labels.MARK, ""))
    return "\n".join(t for x in blocks.values() if (t := " ".join("".join(x).split())))


def test_words_of_unseen_pages():
    """Pages of another seed than those that gave the weights."""
    both = found = true = 0
    for page in html_labels.pages(200, seed=5):
        a, b = Counter(gold(page).split()), Counter(html_text.main_text(page.replace(html_labels.MARK, "")).split())
        both, found, true = both + (a & b).total(), found + b.total(), true + a.total()
    assert both / found > 0.97 and both / true > 0.98


P = "A paragraph that is long enough to count as content of a page, with many words in it."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        (None, ""),
        ("plain words without any tag at all", "plain words without any tag at all"),
        (f"<nav>Home News</nav><main><h1>T&eacute;st &amp; more</h1><p>{P}</p></main><footer>(c)</footer>", f"Tést & more\n{P}"),
        (f"<article><p>{P}<br>next\n\t line&nbsp;end</p><script>if (a < b) alert('</p>')</script><p>{P}</p></article>", f"{P} next line end\n{P}"),
        (f"<article><p>{P}</p><div class='ad-box'>Buy <b>now</b> and save</div><p>{P}</p></article><div id=comments><p>{P}</p></div>", f"{P}\n{P}"),
        (f"<article><p>{P}</p><section class=comments><article><p>I agree with every word of this.</p></article></section></article>", P),
        (f"<article><header><h1>Title</h1></header><p>{P}</p><form><input><button>Send</button></form></article>", f"Title\n{P}"),
        (f"<div class='cookie-notice'>We use cookies</div><div><p>{P}</p><p>{P}</p></div><aside>Most read</aside>", f"{P}\n{P}"),
        (f"<article><!-- <p>gone</p> --><p>{P}<p>second <i>in</i>line</article><style>p{{}}</style>", f"{P}\nsecond inline"),
        (f"<article><p title='a > b'>{P}</p><ul><li>one</li><li>two</li></ul></article>", f"{P}\none\ntwo"),
        ("<nav>Home</nav><footer>Imprint</footer>", ""),
        (f"<nav><a href=/>Home</a></nav><main class='with-sidebar'><article><h1>Title here</h1><p>{P}</p></article></main><footer>(c) x</footer>", f"Title here\n{P}"),
        (f"<div id='content' class='has-sidebar'><article><h1>Title here</h1><p>{P}</p></article></div>", f"Title here\n{P}"),
        (f"<article><div class='post-header'><h1>Title here</h1></div><p>{P}</p></article>", f"Title here\n{P}"),
        (f"<article><h1>Title</h1><p>{P}</p><p class='advert'>Buy boots now and save a lot of money today.</p><p>{P}</p></article>", f"Title\n{P}\n{P}"),
        (f"<article><h1>Title</h1><p>{P} <span class='ad'>Buy boots</span> more words</p></article>", f"Title\n{P} more words"),
        (f"<article><h1>Title</h1><p>{P}</p></article><ol><li class='comment'>{P}</li><li class='comment'>{P}</li></ol>", f"Title\n{P}"),
        (f"<table><tr><td class='sidebar'>Most read<td><p>{P}<p class='sponsored'>Buy<p>{P}</table>", f"{P}\n{P}"),
        (f"<article><p>{P} &#x41;&#66; &lt;b&gt; &unknown; 1 < 2</p>", f"{P} AB <b> &unknown; 1 < 2"),
    ],
)
def test_pages(page, text):
    assert html_text.main_text(page) == text


def test_region_by_brute_force():
    weights = html_text.learned_weights()
    pages = [f"<nav><a>Home</a> <a>News</a></nav><article><p>{P}</p><ul><li><a>x</a></li></ul><p>{P}</p></article><footer><a>i</a></footer>", *(p.replace(html_labels.MARK, "") for p in html_labels.pages(8, seed=3))]
    for page in pages:
        score = html_text.scored(page, weights)[1]
        sums = {(i, j): sum(score[i:j]) for i in range(len(score)) for j in range(i + 1, len(score) + 1)}
        best = max([0.0, *sums.values()])
        lo, hi = html_text.region(score)
        assert best == 0 == hi or sum(score[lo:hi]) == pytest.approx(best)


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "u", ""), (None, "v", f"<p>{P}</p>"), (3, "w", f"<article><p>{P}</p>" + "<div>" * 3000 + "deep words"), (3, "w", "<p>x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("own"), "tag": F.lit("own")})
    got = html_text.extract_text(pages).collect()
    assert len(got) == 5 and {r.tag for r in got} == {"own"} and [r.text for r in got if r.page_id in (1, 2)] == ["", ""]
    assert html_text.extract_text(pages.where("false")).count() == 0
