"""Main text of pages: labelled pages, hostile markup, blocks against nested pages built beside their blocks."""

from __future__ import annotations

import random
import time

import pytest

from factfeed.llm import main_text

TREE = main_text.grow_tree(main_text.LABELLED)
LONG = "Rain fell on the old town for three days and the river rose above the lower bridge before noon."
MORE = "People carried their chairs and books up the stairs while the boats were tied to the lamp posts."

# name, html, and the article's blocks
LABELLED_PAGES = [
    ("names that begin with furniture", f'<article><h1>T</h1><p>{LONG}</p><div class="side-effects"><p>{MORE}</p></div></article>', ["T", LONG, MORE]),
    ("share prices", f'<article><h1>T</h1><p>{LONG}</p><p class="share-prices">{MORE}</p><p>{LONG}</p></article>', ["T", LONG, MORE, LONG]),
    ("whole names", f'<article><h1>T</h1><p>{LONG}</p><div class="google-ads">{MORE}</div><p>{LONG}</p></article>', ["T", LONG, LONG]),
    ("names in camel case", f'<article><p>{LONG}</p><div id="userComments">{MORE}</div></article>', [LONG]),
    ("one-word heading, no article", f'<body><div class="menu"><a href=a>Home</a></div><h2>Flood</h2><p>{LONG}</p><p>{MORE}</p></body>', ["Flood", LONG, MORE]),
    ("marked body", f'<body class="has-sidebar menu"><article><h1>T</h1><p>{LONG}</p></article></body>', ["T", LONG]),
    ("marked layout", f'<div class="sidebar"><article><h1>T</h1><p>{LONG}</p></article></div><div class="sidebar"><p>{MORE}</p></div>', ["T", LONG]),
    ("form around the page", f'<form id="f"><main><h1>T</h1><p>{LONG}</p><p>{MORE}</p></main><input></form>', ["T", LONG, MORE]),
    ("header of the article", f'<article><div class="header"><h1>T</h1></div><p>{LONG}</p></article>', ["T", LONG]),
    ("header of the site", f'<div class="header"><p>{MORE}</p></div><article><h1>T</h1><p>{LONG}</p></article>', ["T", LONG]),
    ("comments as articles", f'<article><h1>T</h1><p>{LONG}</p></article><section id="comments"><article class="comment"><p>{MORE}</p></article></section>', ["T", LONG]),
    ("notice", f'<article><p>{LONG}</p><div role="alert">{MORE}</div></article>', [LONG]),
    ("hidden", f'<article><p>{LONG}</p><p hidden>{MORE}</p><p style="display: none">{MORE}</p></article>', [LONG]),
    ("end tags left out", f'<head><title>x</title><article><p class="ad">{MORE}<p>{LONG}<ul><li class="ad">{MORE}<li>{LONG}</ul></article>', [LONG, LONG]),
    ("quote never closed", f'<article><p title="x>{LONG}</p><p>{LONG}</p></article>', [LONG, LONG]),
    ("quotes in text and tags", f"""<article><p title='a > "b'>{LONG}</p><p>5 < 6 "and</p><p>{MORE}</p></article>""", [LONG, '5 < 6 "and', MORE]),
    ("references across tags", f"<article><p>{LONG}</p><p>&<b>amp; &lt;i&gt;</b> x</p><p>{MORE}</p></article>", [LONG, "&amp; <i> x", MORE]),
    ("role", f'<div role="main"><p>{LONG}</p><p>{MORE}</p></div><div class="footer">{MORE}</div>', [LONG, MORE]),
    ("dropped elements", f"<article><p>{LONG}<button>Go <b>on</b></button></p><svg><title>a</title><text>b</text></svg><select><option>c</select><p>{MORE}</p></article>", [LONG, MORE]),
    ("nothing", "<nav><a href=a>Home</a></nav>", []),
]


@pytest.mark.parametrize(("page", "want"), [p[1:] for p in LABELLED_PAGES], ids=[p[0] for p in LABELLED_PAGES])
def test_labelled_pages(page, want):
    assert main_text.main_text(page, TREE).split("\n\n") == (want or [""])


@pytest.mark.parametrize(
    "page",
    [
        "<a " * 300_000 + '"',
        '<a b="' * 150_000,
        "<a b='\" " * 120_000 + "'",
        "<div>" * 90_000 + "</span>" * 90_000,
        "<p><b>" * 150_000,
        "<!--" * 250_000,
        "<script>" * 120_000,
        "<" * 1_000_000,
        "&" * 1_000_000,
        '<div class="side x">w ' * 45_000,
        "<a>" * 300_000,
        "<ul><li>" * 120_000,
        "</p>" * 250_000,
        " " * 1_000_000 + "<p" + " " * 1_000_000,
    ],
    ids=range(14),
)
def test_a_megabyte_of_hostile_markup_takes_time_in_proportion(page):
    started = time.process_time()
    main_text.main_text(page, TREE)
    whole = time.process_time() - started
    started = time.process_time()
    main_text.main_text(page[: len(page) // 8], TREE)
    part = time.process_time() - started
    assert whole < 10 and whole < 24 * part + 0.5


def _nested(rng, depth, out, path):
    """Markup of a random well-nested tree; appends (word, path of block elements)."""
    html = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if kind < 0.5 or depth == 0:
            word = f"w{len(out)}"
            out.append((word, tuple(path)))
            html.append(f" {word}{rng.choice([' ', chr(10), '&nbsp;', '&#32;'])}")
        elif kind < 0.65:
            tag = rng.choice(["b", "span", "i", "em"])
            html += [f"<{tag} title='x > y'>", *_nested(rng, depth - 1, out, path), f"</{tag}>"]
        elif kind < 0.75:
            html.append(rng.choice(["<!-- <p> -->", "<script>'<p>'</script>", "<img src=a>", "<style>p{}</style>", "<br/>"]))
        else:
            tag = rng.choice(["div", "section", "blockquote", "DIV"])
            _nested.cuts += 1
            path.append(_nested.cuts)
            html += [f'<{tag} data-x="a">', *_nested(rng, depth - 1, out, path), f"</{tag} >"]
            path.pop()
            _nested.cuts += 1
            out.append((None, ()))  # the end of an element cuts as well
    return html


def test_blocks_of_nested_pages_against_their_trees():
    rng = random.Random(5)
    for _ in range(300):
        out: list = []
        _nested.cuts = 0
        page = "".join(_nested(rng, 5, out, []))
        want, last = [], None
        for word, path in out:
            if word is None:
                last = None
            elif last == path and want:
                want[-1] += f" {word}"
            else:
                want.append(word)
                last = path
        assert [b.text for b in main_text.blocks(page)] == want
