"""Hand-labelled pages: ``data-main`` marks main text (1) and what is not (0).

Short pages of invented sites that show the usual furniture around and inside
an article.  The model is trained on them together with pages of the table.
"""

from __future__ import annotations

_TEXT = (
    "The river had risen again in the night, and by morning the lower meadow was under water from the mill to the bridge.",
    "Nobody in the village could remember an autumn like it. The carts stood in the yards, and the post came two days late.",
    "When the council met, it was agreed that the old wall should be raised by half a metre before the winter storms began.",
    "A short note.",
    'As <a href="/paper">the paper</a> wrote, <b>not one</b> of them complained, <a href="/mill">the mill</a> least of all.',
    'See <a href="/map">the map</a>.',
    "Work began on Monday. Twelve people carried stones until it was too dark to see, and returned on Tuesday to carry more.",
)


def _paragraphs(*which: int) -> str:
    return "".join(f"<p>{_TEXT[i]}</p>" for i in which)


_MENU = '<ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li><li><a href="/c">Contact</a></li></ul>'
_COOKIES = '<div class="cookie-notice consent banner" role="alert" data-main="0"><p>We use cookies to improve our site. By going on you agree.</p><button>Accept</button></div>'
_COMMENT = '<div class="comment"><p>Great read, thank you! I remember that winter too, my uncle lived by the mill.</p></div>'
_COMMENTS = f'<div id="comments" class="comments discussion" data-main="0"><h3>2 comments</h3>{_COMMENT}{_COMMENT}</div>'
_SIDE = '<h3>Most read</h3><ul><li><a href="/1">Ten ways to cook beans</a></li><li><a href="/2">The lost valley</a></li></ul><p>Sign up for letters from our editors, every week.</p>'
_FORM = '<form action="/s"><label>Your address</label><input name="q"><p>We never pass on your address.</p></form>'

LABELLED: list[str] = [
    f'<html><head><title>The river</title></head><body><header><h2>The Daily Meadow</h2></header><nav>{_MENU}</nav><main data-main="1"><article><h1>The river</h1>{_paragraphs(0, 4, 1, 5, 2)}</article></main><aside data-main="0">{_SIDE}</aside><footer><p>All pages by the Meadow, since 1901. Contact and terms.</p></footer></body></html>',
    f'<html><body><div id="top-menu" class="menu navbar">{_MENU}</div><div id="content" class="post entry" data-main="1"><h1>Raising the wall</h1>{_paragraphs(2, 6, 5, 3, 1, 4)}<blockquote><p>{_TEXT[6]}</p></blockquote></div><div id="sidebar" class="widget">{_SIDE}</div><div id="footer"><p>Copyright of this page belongs to the village.</p></div></body></html>',
    f'<html><body>{_COOKIES}<div class="header masthead"><p>The Meadow, a paper for the valley</p></div><article data-main="1"><header><h1>Stones</h1></header>{_paragraphs(6, 0, 5)}<div class="ad advert sponsored" data-main="0"><p>Buy two carts and get a third one at half the price, only this week.</p></div>{_paragraphs(1)}<div class="share social" data-main="0"><a href="/t">Send</a> <a href="/f">Post</a></div></article>{_COMMENTS}<div class="footer">{_MENU}</div></body></html>',
    f'<html><body><nav class="breadcrumb breadcrumbs" data-main="0"><a href="/">Home</a> <a href="/n">News</a></nav><div class="article-body story content" data-main="1"><h1>A wet year</h1><h2>Autumn</h2>{_paragraphs(0, 3, 4, 1)}<ul><li>{_TEXT[3]}</li><li>{_TEXT[2]}</li></ul><section class="related recommended" data-main="0"><h3>More on this</h3>{_SIDE}</section>{_COMMENTS}</div>{_FORM}<footer>{_MENU}</footer></body></html>',
    f'<html><body><div class="banner promo promotion"><p>Our autumn sale has begun, come and see.</p></div><div class="page wrapper container"><div class="sidebar left rail">{_MENU}</div><div class="main text" data-main="1"><p>{_TEXT[0]}</p><p>{_TEXT[1]}</p><table><tr><td>Monday</td><td>{_TEXT[3]}</td></tr></table></div><div class="sidebar right rail">{_SIDE}</div></div><div class="newsletter subscribe signup popup modal"><p>Get our letter every Friday morning, free of charge, with all news of the valley.</p>{_FORM}</div></body></html>',
    f'<html><body><section id="comments-list" class="responses replies" data-main="0"><h2>Replies</h2>{_COMMENT}</section><article class="post" data-main="1">{_paragraphs(2, 4, 0)}<figure><figcaption>{_TEXT[3]}</figcaption></figure><section class="comments reader" data-main="0"><h3>Readers say</h3>{_COMMENT}{_COMMENT}</section><div class="notice disclaimer" data-main="0"><p>Views are those of the writer and not of the paper.</p></div></article><aside class="advert"><p>Carts, new and used. Ask at the mill.</p></aside></body></html>',
    f'<html><body><header><nav>{_MENU}</nav><div class="notice alert"><p>Notice: the site will be down on Sunday from two to four in the morning.</p></div></header><main><article data-main="1"><h1>The bridge</h1><p class="byline">By our writer</p>{_paragraphs(1, 6, 4, 2, 5)}<aside class="pullquote" data-main="0"><p>{_TEXT[3]}</p></aside><footer data-main="0"><p>Filed under news, weather and more.</p></footer></article><div class="pagination pager" data-main="0"><a href="/2">Next page</a></div></main><div class="cookie gdpr privacy"><p>Please accept our cookies. See our privacy notes for all details of what we keep.</p></div></body></html>',
    f'<html><body><div id="ad" class="ads ad"><p>{_TEXT[3]} Buy now.</p></div><div id="main" data-main="1"><h1>Winter</h1><div>{_paragraphs(0)}</div><div>{_paragraphs(6, 4, 3, 1)}</div></div><div class="tags meta author bio" data-main="0"><p>Anna writes about water, walls and wind for this paper.</p></div></body></html>',
]
