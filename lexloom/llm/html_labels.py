"""Labelled pages for the weights of html_text, made from templates under a fixed seed.

Every page is put together from parts that web pages commonly have: a wrapper of the article, a title, paragraphs, lists and the like,
and around and within them navigation, notices, adverts, forms, sidebars, footers and reader comments under the tags and class names that
sites give them. Each word of the article carries MARK, so the label of any run of words can be read off the page; MARK is taken
out before anything is measured.
"""

from __future__ import annotations

import random

MARK = ""
N_PAGES, SEED = 1500, 11

_SYLLABLES = "ka ro mi ten sul va der lo ni pra es tu gor an bel che dou fin hast ir".split()
#: class or id names, by what they mark on common sites; {} stands for the words of a part
_LINKS = ["<nav>{}</nav>", "<nav class='main-navigation'>{}</nav>", "<div class='menu'>{}</div>", "<div id='nav'>{}</div>", "<ul class='navbar'>{}</ul>", "<div class='breadcrumbs'>{}</div>", "<div role='navigation'>{}</div>", "<div class='top-menu'>{}</div>", "<div class='pagination'>{}</div>", "<div class='tags'>{}</div>"]
_HEADS = ["<header>{}</header>", "<header class='site-header'>{}</header>", "<div id='header'>{}</div>", "<div class='masthead'>{}</div>", "<div class='topbar'>{}</div>", "<div class='site-branding'>{}</div>", "<div role='banner'>{}</div>"]
_NOTICES = ["<div class='cookie-notice'>{}</div>", "<div id='cookie-banner'>{}</div>", "<div class='consent'>{}</div>", "<section class='gdpr'>{}</section>", "<p class='notice'>{}</p>", "<div class='alert'>{}</div>", "<div role='dialog'>{}</div>", "<dialog open>{}</dialog>", "<div class='modal popup'>{}</div>", "<div role='alert'>{}</div>", "<div class='paywall-notice'>{}</div>", "<div class='privacy-notice'>{}</div>"]
_ADS = ["<div class='ad'>{}</div>", "<div class='ads'>{}</div>", "<p class='advert'>{}</p>", "<div class='advertisement'>{}</div>", "<div id='banner-ad'>{}</div>", "<div class='ad-box'>{}</div>", "<section class='sponsored'>{}</section>", "<div class='promo'>{}</div>", "<aside class='ad-slot'>{}</aside>", "<ins class='adsbygoogle'>{}</ins>", "<div class='sponsor'>{}</div>", "<div class='advert promo-box'>{}</div>", "<div aria-label='Advertisement'>{}</div>", "<span class='ad'>{}</span>", "<span class='sponsored-link'>{}</span>", "<div class='ad-container'>{}</div>"]
_FORMS = ["<form>{}<input><button>Go</button></form>", "<form class='search'><label>{}</label><input></form>", "<div class='newsletter'>{}</div>", "<div class='subscribe-box'>{}</div>", "<form id='login'>{}</form>", "<div class='signup'>{}</div>", "<fieldset>{}</fieldset>", "<div class='search-form'>{}</div>", "<form class='newsletter-signup'><p>{}</p></form>"]
_SIDES = ["<aside>{}</aside>", "<div class='sidebar'>{}</div>", "<div id='sidebar'>{}</div>", "<aside class='sidebar'>{}</aside>", "<div class='widget'>{}</div>", "<section class='related'>{}</section>", "<div class='related-posts'>{}</div>", "<div class='recommended'>{}</div>", "<div role='complementary'>{}</div>", "<div class='most-read'>{}</div>", "<div class='share'>{}</div>", "<ul class='social-share'>{}</ul>", "<div class='share-buttons'>{}</div>", "<td class='sidebar'>{}</td>", "<div class='author-bio sidebar-box'>{}</div>", "<div class='right-column'>{}</div>"]
_FEET = ["<footer>{}</footer>", "<footer class='site-footer'>{}</footer>", "<div class='footer'>{}</div>", "<div id='footer'>{}</div>", "<p class='copyright'>{}</p>", "<div class='legal'>{}</div>", "<div role='contentinfo'>{}</div>", "<div class='footer-links'>{}</div>"]
_COMMENTS = ["<section id='comments'><h2>{}</h2>{}</section>", "<div class='comments'>{}{}</div>", "<ol class='comment-list'><li class='comment'>{}</li><li class='comment'>{}</li></ol>", "<div class='comment'>{}</div><div class='comment'>{}</div>", "<ul><li class='comment'><p>{}</p></li><li class='comment even'><p>{}</p></li></ul>", "<div id='disqus_thread'>{}<p>{}</p></div>", "<section class='discussion replies'><p>{}</p><p>{}</p></section>", "<div class='reader-comments'><div class='reply'>{}</div><p>{}</p></div>", "<div id='respond'><h3>{}</h3><p>{}</p></div>", "<ol><li class='comment'>{}</li><li class='comment'>{}</li></ol>", "<p class='comment'>{}</p><p class='comment'>{}</p>", "<div class='user-comment'><p>{}</p></div>", "<div class='comment-body'>{}{}</div>"]
_NESTED = ["<section><article>{}</article><article>{}</article></section>", "<section class='comments'><article><p>{}</p></article><article><p>{}</p></article></section>", "<div id='comments'><article class='comment'>{}</article><article class='comment'><p>{}</p></article></div>"]
_WRAPS = [
    "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<main class='with-sidebar'><article>{}</article></main>", "<div id='content' class='has-sidebar'>{}</div>", "<div class='content'>{}</div>", "<div id='main-content'>{}</div>",
    "<div class='post'>{}</div>", "<article class='post hentry'><div class='entry-content'>{}</div></article>", "<div class='container'><div class='article-body'>{}</div></div>", "<section class='story'>{}</section>", "<div class='page-wrapper'>{}</div>", "<div>{}</div>", "{}",
    "<table><tr><td>{}</td></tr></table>", "<main id='main' class='site-main no-sidebar'>{}</main>", "<div class='layout sidebar-right'><article>{}</article></div>", "<div class='row'><div class='col main-column'>{}</div></div>", "<div role='main'>{}</div>", "<body class='single comments-open has-sidebar'>{}", "<article itemprop='articleBody'>{}</article>",
    "<div class='nav-open cookies-accepted'><article>{}</article></div>", "<div class='header-fixed'><main>{}</main></div>", "<div class='with-comments'><article>{}</article></div>", "<div class='ad-free'><article>{}</article></div>", "<article class='sponsored-by-none with-ads'>{}</article>", "<main class='has-ads'>{}</main>", "<div class='with-sidebar'>{}</div>", "<div class='no-ads'>{}</div>",
]
_TITLES = ["<h1>{}</h1>", "<header><h1>{}</h1></header>", "<div class='post-header'><h1>{}</h1></div>", "<h1 class='entry-title'>{}</h1>", "<div class='article-header'><h1>{}</h1></div>", "<header class='entry-header'><h2>{}</h2></header>", "<h2 class='headline'>{}</h2>", "<div class='title'>{}</div>"]
_BODIES = ["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>", "<p class='lead'>{}</p>", "<p class='text'>{}</p>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<ol><li>{}</li></ol>", "<h2>{}</h2>", "<section><p>{}</p></section>", "<pre>{}</pre>", "<figure><img src=x><figcaption>{}</figcaption></figure>", "<table><tr><td>{}</td></tr></table>", "<dl><dd>{}</dd></dl>", "<div class='paragraph'>{}</div>"]


class _Maker:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def words(self, n: int, mark: str = "") -> str:
        r = self.rng
        out = ["".join(r.choice(_SYLLABLES) for _ in range(r.randrange(1, 4))) for _ in range(n)]
        return " ".join(mark + w for w in out)

    def sentences(self, n: int, mark: str = "") -> str:
        r = self.rng
        return " ".join(self.words(r.randrange(4, 18), mark).capitalize() + r.choice("...!?") for _ in range(n))

    def links(self) -> str:
        r, sep = self.rng, self.rng.choice([" ", " | ", "</li><li>"])
        links = [f"<a href='/{i}'>{self.words(r.randrange(1, 7))}</a>" for i in range(r.randrange(1, 9))]
        return f"<ul><li>{sep.join(links)}</li></ul>" if "li" in sep else sep.join(links)

    def aside(self, kinds: list[list[str]]) -> str:
        r = self.rng
        kind = r.choice(kinds)
        part = r.choice(kind)
        texts = []
        for _ in range(part.count("{}")):
            if kind is _LINKS:
                texts.append(self.links())
            elif kind in (_COMMENTS, _NESTED):
                texts.append(self.sentences(r.randrange(1, 6)))
            else:
                closed = part.startswith(("<p", "<span", "<ins"))  # no paragraph fits in
                texts.append(self.sentences(r.randrange(1, 4)) if closed else r.choice([self.links, lambda: self.words(r.randrange(1, 9)), lambda: self.sentences(r.randrange(1, 4)), lambda: f"<p>{self.sentences(r.randrange(1, 5))}</p>"])())
        return part.format(*texts)

    def body(self) -> str:
        r = self.rng
        part = r.choice(_BODIES)
        short = part.startswith(("<h2", "<ul", "<ol", "<fig", "<table", "<dl")) or r.random() < 0.15
        text = self.words(r.randrange(1, 9), MARK) if short else self.sentences(r.randrange(1, 8), MARK)
        if not short and r.random() < 0.3:
            a, b = text[: len(text) // 3], text[len(text) // 3 :]
            cut = a.rfind(" ")
            if cut > 0:
                text = f"{a[:cut]} <{(tag := r.choice(['a href=/x', 'b', 'em', 'i', 'span']))}>{self.words(2, MARK)}</{tag.split()[0]}>{a[cut:]}{b}"
        return part.format(text)

    def page(self) -> str:
        r = self.rng
        outer = [_LINKS, _HEADS, _NOTICES, _ADS, _FORMS, _SIDES]
        inner = [_ADS, _ADS, _FORMS, _SIDES, _NOTICES, _LINKS]
        parts = [r.choice(_TITLES).format(self.words(r.randrange(2, 9), MARK))] if r.random() < 0.9 else []
        for _ in range(r.randrange(1, 12)):
            parts.append(self.body())
            if r.random() < 0.2:
                parts.append(self.aside(inner))
        if r.random() < 0.25:
            parts.append(self.aside([_COMMENTS, _NESTED]))
        before = "".join(self.aside(outer) for _ in range(r.randrange(0, 5)))
        after = "".join(self.aside([_SIDES, _COMMENTS, _COMMENTS, _FORMS, _ADS, _LINKS]) for _ in range(r.randrange(0, 4))) + (self.aside([_FEET]) if r.random() < 0.9 else "")
        return f"<!DOCTYPE html><html><head><title>{self.words(4)}</title><style>a{{}}</style></head><body>{before}{r.choice(_WRAPS).format(''.join(parts))}{after}</body></html>"


def pages(n: int = N_PAGES, seed: int = SEED) -> list[str]:
    """n labelled pages; the same for the same seed."""
    maker = _Maker(seed)
    return [maker.page() for _ in range(n)]
