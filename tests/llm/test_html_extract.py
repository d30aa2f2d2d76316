from __future__ import annotations

import random

import pytest
from helpers import prose
from hypothesis import given, settings
from hypothesis import strategies as st
from larkspur.llm import html_extract as H

TREE = H.train()


def page(rng, paragraphs, article=True):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    nav = "".join(f'<li><a href="/{i}">{prose(rng, 1)}</a></li>' for i in range(6))
    wrap = ("<article>", "</article>") if article else ('<div class="text">', "</div>")
    return (
        f'<!DOCTYPE html><html><head><title>{prose(rng, 5)}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul>{nav}</ul></nav><!-- <p>no</p> -->'
        f'<div class="ad">{prose(rng, 12)}</div>{wrap[0]}<h1>Título &amp; más</h1>{body}{wrap[1]}<section id="comments"><p>{prose(rng, 30)}</p></section>'
        f'<form><label>{prose(rng, 3)}</label><textarea>{prose(rng, 9)}</textarea></form><aside><p>{prose(rng, 40)}</p></aside><footer>&copy; {prose(rng, 12)}</footer></body></html>'
    )


def test_articles():
    rng = random.Random(1)
    for n in range(30):
        parts = [" ".join(prose(rng, rng.choice([1, 3, 20, 90])).split()) for _ in range(1 + n % 6)]
        assert H.main_text(page(rng, parts), TREE) == "\n".join(["Título & más", *parts])


def test_short_notice_before_a_long_article():
    words = " ".join(["palabra"] * 110)
    for n in range(1, 40):
        notice = " ".join(["aviso"] * n)
        assert H.main_text(f'<nav><a href="/">uno</a></nav><div class="ad">{notice}</div><article><h1>{words}</h1><p>{words}</article>', TREE) == f"{words}\n{words}"


def test_without_article():
    rng = random.Random(2)
    parts = [" ".join(prose(rng, 60).split()) for _ in range(4)]
    assert H.main_text(page(rng, parts, article=False), TREE) == "\n".join(["Título & más", *parts])


def test_built_pages():
    """Pages put together at random, whose text is known by construction."""
    rng = random.Random(5)
    flat = lambda n: " ".join(prose(rng, n).split())
    outside = [
        lambda: f'<nav><ul><li><a href="/">{flat(2)}</a><li><a href="/x">{flat(1)}</a></ul></nav>', lambda: f'<div class="{rng.choice(["ad", "ad-slot", "top-banner", "cookie-notice", "adsBox"])}"><p>{flat(rng.randint(1, 50))}</p></div>',
        lambda: f"<aside><p>{flat(rng.randint(5, 60))}</p></aside>", lambda: f'<section id="{rng.choice(["comments", "comment-list", "related-posts"])}"><p>{flat(rng.randint(5, 90))}</p><article><p>{flat(40)}</p></article></section>',
        lambda: f"<form><p>{flat(rng.randint(2, 30))}</p><select><option>{flat(1)}</select></form>", lambda: f"<svg><text>{flat(2)}</text><svg><text>{flat(1)}</text></svg><text>{flat(3)}</text></svg>", lambda: f'<script>"<p>{flat(9)}</p>"</script><!-- <p>{flat(5)}</p> -->',
        lambda: f"<footer><p>{flat(rng.randint(2, 60))}</p></footer>", lambda: f"<template><div><template>{flat(4)}</template>{flat(5)}</div></template>",
    ]
    wrap = [("", ""), ('<div class="content with sidebar">', "</div>"), ('<div id="search-results"><div>', "</div></div>"), ('<div class="page with-sidebar no-comments">', "</div>"), ('<form action="/x">', "</form>"), ('<div class="sidebar-left layout"><main>', "</main></div>")]
    for _ in range(120):
        text, inner = [], []
        for i in range(rng.randint(1, 7)):
            n = rng.choice([1, 3, 12, 40, 120])
            words = flat(n)
            text.append(words)
            inner.append(f'<div class="entry-header"><h1>{words}</h1></div>' if i == 0 else rng.choice([f"<p>{words}</p>", f"<p>{words}", f"<div>{words}</div>", f"<h2>{words}</h2>", f'<ul><li>{words}</ul>', f'<blockquote><p>{words.replace(" ", chr(10), 1)}</blockquote>']))
            if rng.random() < 0.4:
                inner.append(rng.choice(outside[:-2])())
        a, b = rng.choice(wrap)
        around = [f() for f in rng.sample(outside, 4)]
        assert H.main_text(f"<html><body>{around[0]}{around[1]}{a}<article>{''.join(inner)}</article>{b}{around[2]}{around[3]}</body></html>", TREE) == "\n".join(text)


@pytest.mark.parametrize(("source", "text"), [
    ('<div class="content with sidebar"><article><p>uno</p></article></div>', "uno"), ('<div id="search-results"><article>uno</article></div>', "uno"), ('<div id="main" class="no-comments"><article>uno</article></div>', "uno"),
    (f'<article><p>a</p><div class="related-work"><p>{"b " * 40}</p></div></article>', "a\n" + "b " * 39 + "b"), (f'<article><p>a</p><div class="related-posts"><p>{"b " * 40}</p></div></article>', "a"),
    (f'<div class="post"><h2>uno</h2><p>dos</p><p>{"b " * 40}</p><p>tres</p></div><div class="footer">no</div>', "uno\ndos\n" + "b " * 39 + "b\ntres"),
    (f'<article><p>a</p><article class="comment"><p>{"b " * 40}</p></article><div class="ad">c</div></article>', "a"), ("<article>a<svg><svg><text>x</text></svg><text>y</text></svg>b</article>", "ab"),
    (f'<div class="post"><p>{"b " * 40}</p><div class="ad">c</div></div>', "b " * 39 + "b"), ("<article><p>a</p><object><object>x</object>y</object><p>b</article>", "a\nb"),
])
def test_names_and_nesting(source, text):
    assert H.main_text(source, TREE) == text


def test_the_tree_asks_for_words_and_links():
    """Two pages without any name that say what is text: only the numbers of words and links differ."""

    def asked(tree):
        return set() if tree.feature < 0 else {H.FEATURES[tree.feature]} | asked(tree.low) | asked(tree.high)

    assert {"words", "links", "siblings"} <= asked(TREE) | {"words"} and asked(TREE) & {"words", "words_before", "words_behind"} and "links" in asked(TREE)
    body = lambda a, b: f"<body><div>{a}</div><div>{b}</div></body>"
    long, menu = "<p>" + "uno " * 60 + "</p>", "<p>" + '<a href="/">dos</a> ' * 60 + "</p>"
    assert H.main_text(body(long, menu), TREE) == ("uno " * 60).strip()
    assert H.main_text(body(menu, "<p>uno dos</p>"), TREE) == ""


@pytest.mark.parametrize(("source", "text"), [
    ("", ""), (None, ""), ("<article><p>uno<br>dos <b>tres\n\t cua</b>tro</article>", "uno dos tres cuatro"), ("<article><p>a &lt;b&gt; &#233;&nbsp;c", "a <b> é c"),
    ("<article><p>uno<p>dos", "uno\ndos"), ("<article><div class=comment>no</div><p>sí</p></article>", "sí"), ("<ARTICLE><P>uno</P></ARTICLE><FOOTER>no</FOOTER>", "uno"),
    ('<article><p title="a > b">uno</p></article>', "uno"), ("<article><script>if (a < b) x('</p>')</script>uno</article>", "uno"), ("<article>uno<!-- dos", "uno"), ("<article>1 < 2 y 3 > 2</article>", "1 < 2 y 3 > 2"),
    ("<main><header><h1>T</h1></header>uno</main>", "T\nuno"), ("<article><ul><li>a<li>b</ul></article>", "a\nb"),
])
def test_markup(source, text):
    assert H.main_text(source or "", TREE) == text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<a href='x'>", "</a>", "<article>", "</article>", "<!--", "-->", "<script>", "</script>", "<", ">", "&amp;", '"', "uno", " dos\n", "<nav>", "</nav>"]), max_size=40))
def test_any_markup(parts):
    text = H.main_text("".join(parts), TREE)
    assert all(line == " ".join(line.split()) and line for line in text.split("\n")) or text == ""


def test_long_broken_page():
    assert H.main_text("<" * 20_000, TREE) == ""
    assert H.main_text('<article><p "' * 5_000, TREE) == ""
    assert len(H.main_text("<article>" + "<p>" + "uno " * 200_000, TREE)) == 4 * 200_000 - 1


def test_pages(spark):
    rows = [(1, "u", "<article>ñ é", "x"), (1, "u", "<article>ñ é", "x"), (2, None, None, "y"), (None, "v", "", "z")]
    got = H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(str, got.collect())) == sorted(map(str, [*[got.collect()[0]] * 2, *got.where("n_chars = 0").collect()]))
    assert got.where("n_chars = 3").count() == 2 and got.count() == 4
    assert H.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def some(sign, n):
    return " ".join([sign] * n)


A, B, C, NO = some("a", 80), some("b", 80), some("c", 80), some("n", 30)


@pytest.mark.parametrize(("source", "text"), [
    (f"<body><p>{some('a', 18)}</p><p>{some('b', 20)}</p></body>", f"{some('a', 18)}\n{some('b', 20)}"), (f"<body><p>{some('a', 18)}</p></body>", some("a", 18)), (some("a", 25), some("a", 25)), ("uno dos tres", "uno dos tres"),
    (f"<form id=aspnetForm><input type=hidden name=x><div id=main><h1>t t</h1><p>{A}</p><p>{B}</p></div></form>", f"t t\n{A}\n{B}"), (f"<form><div><p>{A}</p><p>{B}</p><p>{C}</p></div></form>", f"{A}\n{B}\n{C}"),
    (f'<form><input><input><p>{NO}</p><textarea></textarea></form><div class="post"><p>{A}</p></div>', A),
    (f"<div><h1>t t t</h1><p>{A}</p><ul><li>first point here</li><li>second point</li><li>third</li></ul><p>{B}</p></div>", f"t t t\n{A}\nfirst point here\nsecond point\nthird\n{B}"),
    (f"<div><h1>t t t</h1><p>{A}</p><ul><li>first point here</li><li>second point</li><li>third</li></ul></div>", f"t t t\n{A}\nfirst point here\nsecond point\nthird"),
    (f'<article><p>{A}</p><div class="article-comments"><p>{NO}</p></div></article>', A), (f'<div class="content"><p>{A}</p><div class="post-comments"><p>{NO}</p></div></div>', A), (f'<article><p>{A}</p><div class="entry-footer">{some("n", 12)}</div></article>', A),
    (f'<main><section class="news-ticker"><p>{some("n", 12)}</p></section><p>{A}</p></main>', A), (f'<div class="page-with-sidebar"><article><p>{A}</p></article></div>', A), (f'<div class="post"><div class="post-header"><h1>t</h1></div><p>{A}</p></div>', f"t\n{A}"),
])
def test_small_pages_forms_lists_and_comments(source, text):
    assert H.main_text(source, TREE) == text


@pytest.mark.parametrize("wrap", [("<form id=aspnetForm><input type=hidden><div id=main>", "</div></form>"), ('<div class="post">', "</div>"), ('<div id="content" class="page-with-sidebar">', "</div>"), ("<main>", "</main>")])
def test_built_pages_without_article(wrap):
    """Texts with lists in the containers pages are made of, with notices, comments and input forms inside and around."""
    rng = random.Random(11)
    flat = lambda n: " ".join(prose(rng, n).split())
    outside = [lambda: f'<nav><a href="/">{flat(2)}</a></nav>', lambda: f'<div class="ad-slot"><p>{flat(rng.randint(1, 40))}</p></div>', lambda: f"<form><input><p>{flat(rng.randint(2, 20))}</p><textarea></textarea></form>", lambda: f"<footer>{flat(rng.randint(2, 30))}</footer>"]
    inside = [lambda: f'<div class="article-comments"><p>{flat(rng.randint(5, 60))}</p></div>', lambda: f'<div class="entry-footer">{flat(rng.randint(2, 30))}</div>', lambda: f'<section class="news-ticker">{flat(9)}</section>']
    for _ in range(60):
        text, body = [], []
        for i in range(rng.randint(3, 7)):
            items = [flat(rng.choice([1, 3, 8])) for _ in range(rng.randint(2, 5))] if i % 3 == 2 else [flat(rng.choice([3, 8])) if i == 0 else flat(rng.choice([25, 60, 120]))]
            text += items
            body.append(f"<h1>{items[0]}</h1>" if i == 0 else f"<p>{items[0]}</p>" if len(items) == 1 else "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
        if rng.random() < 0.5:
            body.append(rng.choice(inside)())
        around = [f() for f in rng.sample(outside, 2)]
        assert H.main_text(f"<html><body>{around[0]}{wrap[0]}{''.join(body)}{wrap[1]}{around[1]}</body></html>", TREE) == "\n".join(text)
