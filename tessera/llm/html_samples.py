"""A small labelled table of page blocks for the extractor's decision tree.

Every block's text begins with + (main text) or - (anything else); the mark
is taken off before features are computed.
"""

_WORDS = ("the river rose after three days of rain and the lower road was closed while crews moved sand "
          "to the bridge where the old wall had given way in spring").split()


def _say(mark: str, n: int, end: str = ".") -> str:
    """A marked sentence of n words."""
    return mark + " ".join(_WORDS[i % len(_WORDS)] for i in range(n)) + end


def _p(n: int) -> str:
    return f"<p>{_say('+', n)}</p>"


def _links(n: int, words: int = 1) -> str:
    return "".join(f'<li><a href="/{i}">{_say("-", words, "")}</a></li>' for i in range(n))


PAGES = [
    # news page with everything around the article
    f'<head><title>{_say("-", 6, "")}</title></head><body><header><h1>{_say("-", 2, "")}</h1></header>'
    f'<nav><ul>{_links(6)}</ul></nav><div class="ad">{_say("-", 9)}</div>'
    f'<article><h1>{_say("+", 8, "")}</h1>{_p(40)}{_p(3)}{_p(1)}<h2>{_say("+", 3, "")}</h2>{_p(80)}{_p(2)}'
    f'<ul><li>{_say("+", 4)}</li><li>{_say("+", 7)}</li></ul>{_p(15)}</article>'
    f'<aside><h3>{_say("-", 2, "")}</h3><p>{_say("-", 25)}</p><ul>{_links(4, 5)}</ul></aside>'
    f'<section class="comments"><h3>{_say("-", 1, "")}</h3><p>{_say("-", 30)}</p><p>{_say("-", 4)}</p></section>'
    f'<footer>{_say("-", 12)}<p>{_say("-", 20)}</p></footer></body>',
    # the same without much text in the article
    f'<nav><ul>{_links(5)}</ul></nav><div class="advert">{_say("-", 7)}</div>'
    f'<article><h1>{_say("+", 10, "")}</h1>{_p(1)}</article><footer>{_say("-", 9)}</footer>',
    f'<ul class="menu">{_links(4, 2)}</ul><main><h1>{_say("+", 2, "")}</h1>{_p(2)}{_p(6)}'
    f'<blockquote>{_say("+", 12)}</blockquote><table><tr><td>{_say("+", 1)}</td><td>{_say("+", 2)}</td></tr></table>'
    f'<div class="share">{_say("-", 3)}</div></main><form><label>{_say("-", 3)}</label><p>{_say("-", 14)}</p></form>'
    f'<div id="footer">{_say("-", 22)}</div>',
    # links inside the article, related links after it
    f'<div class="cookie-notice"><p>{_say("-", 28)}</p><button>{_say("-", 1)}</button></div>'
    f'<article>{_p(20)}<p>{_say("+", 6, "")} <a href="#">the old wall</a> and the bridge.</p>'
    f'<p><a href="#">{_say("+", 4, "")}</a> was closed.</p><p><a href="#">{_say("+", 5, "")}</a></p>'
    f'<div class="related"><h4>{_say("-", 2, "")}</h4><ul>{_links(5, 6)}</ul></div>{_p(30)}</article>'
    f'<div class="comment-list"><div>{_say("-", 45)}</div><div>{_say("-", 2)}</div></div>',
    # no article element: length and links decide
    f'<div>{_say("-", 2, "")}</div><div><a href="#">{_say("-", 2, "")}</a> | <a href="#">{_say("-", 1, "")}</a></div>'
    f'<div><div>{_say("+", 45)}</div><div>{_say("+", 60)}</div><div>{_say("+", 5)}</div><div>{_say("+", 35)}</div>'
    f'<div>{_say("+", 90)}</div></div><div><a href="#">{_say("-", 3, "")}</a> <a href="#">{_say("-", 4, "")}</a></div>'
    f'<div>{_say("-", 4)}</div>',
    f'<table><tr><td><a href="#">{_say("-", 1, "")}</a></td><td><a href="#">{_say("-", 2, "")}</a></td></tr></table>'
    f'<h2>{_say("+", 5, "")}</h2><p>{_say("+", 55)}</p><p>{_say("+", 25)}</p><p>{_say("+", 70)}</p>'
    f'<ul>{_links(8, 3)}</ul><p>{_say("-", 5)}</p>',
    # notices and a dialog with long text, sidebar by class, long legal footer
    f'<dialog><p>{_say("-", 50)}</p></dialog><div class="sidebar"><p>{_say("-", 60)}</p><p>{_say("-", 8)}</p></div>'
    f'<article><header><h1>{_say("+", 7, "")}</h1><p>{_say("+", 5)}</p></header><section>{_p(33)}{_p(7)}</section>'
    f'<div class="ad">{_say("-", 11)}</div>{_p(4)}<aside>{_say("-", 18)}</aside>{_p(52)}'
    f'<footer><p>{_say("-", 9)}</p></footer></article>'
    f'<div class="newsletter"><p>{_say("-", 16)}</p></div><footer><p>{_say("-", 90)}</p></footer>',
    # pages cut off inside the article, and articles that are the whole page
    f'<nav><ul>{_links(3)}</ul></nav><article><h1>{_say("+", 5, "")}</h1>{_p(44)}<p>{_say("+", 2, "")}',
    f'<article><p>{_say("+", 1, "")}</p></article>',
    f'<article>{_p(3)}{_p(2)}{_p(50)}{_p(1)}</article>',
    f'<main><p>{_say("+", 4)}</p></main>',
    f'<div class="ad">{_say("-", 6)}</div><article>{_p(2)}</article>',
    f'<article>{_p(60)}<p>{_say("+", 9)}</p></article><footer>{_say("-", 7)}</footer>',
    f'<div>{_say("-", 3, "")}</div>',
    f'<ul>{_links(3, 2)}</ul><div>{_say("-", 5)}</div>',
    # class words that tell how the whole page is laid out
    f'<body class="page has-sidebar"><nav><ul>{_links(4)}</ul></nav><div class="content with-sidebar">'
    f'<article class="post comment-open"><h1>{_say("+", 6, "")}</h1>{_p(30)}{_p(4)}</article></div>'
    f'<div class="sidebar"><p>{_say("-", 24)}</p></div></body>',
    f'<main id="search-main"><h1>{_say("+", 4, "")}</h1>{_p(25)}{_p(3)}</main><div class="site-footer">{_say("-", 8)}</div>',
    f'<div class="sidebar"><article class="widget">{_p(28)}{_p(5)}</article></div><div class="comment-list"><p>{_say("-", 26)}</p></div>',
]
