"""Main text: pages without article or main, built from known parts, and parser edge cases."""
import random
import time

import pytest

from roadpulse.llm import html_text as H

WORDS = "river stone light window garden market letter bridge winter story paper music road field house".split()


def sentence(rnd, n):
    return (" ".join(rnd.choice(WORDS) for _ in range(n)) + ".").capitalize()


def links(rnd, n=6):
    return "".join(f"<li><a href=/{i}>{rnd.choice(WORDS)} {i}</a></li>" for i in range(n))


def article(rnd):
    """Heading and paragraphs, long and short ones mixed; the last may be short."""
    return [("h1", sentence(rnd, 4))] + [("p", sentence(rnd, rnd.choice((4, 30, 60, 90)))) for _ in range(rnd.randrange(4, 9))] + [("p", sentence(rnd, 80))] * (
        rnd.random() < 0.5) + [("p", sentence(rnd, 5))]


def page(seed):
    """(html, main text) of a page in one of six layouts."""
    rnd = random.Random(seed)
    parts = article(rnd)
    text = "\n".join(t for _, t in parts)
    plain = "".join(f"<{n}>{t}</{n}>" for n, t in parts)
    unclosed = "".join(f"<{n}>{t}" + (f"</{n}>" if n != "p" else "") for n, t in parts)
    boxes = "".join(f"<{'h2' if n == 'h1' else 'div'}>{t}</{'h2' if n == 'h1' else 'div'}>" for n, t in parts)
    halves = len(parts) // 2
    grouped = "".join(f"<section>{''.join(f'<{n}>{t}</{n}>' for n, t in g)}</section>" for g in (parts[:halves], parts[halves:]))
    top, end = f"<div><ul>{links(rnd)}</ul></div>", f"<div><ul>{links(rnd, 4)}</ul></div><div>{sentence(rnd, 3)}</div>"
    html = [
        f"<body>{top}<div id=wrap><div class=content>{plain}</div></div>{end}</body>",
        f"<body><ul>{links(rnd)}</ul>{unclosed}<ul>{links(rnd, 3)}</ul></body>",
        f"<table><tr><td><ul>{links(rnd)}</ul><td>{unclosed}<tr><td><td><a href=x>{sentence(rnd, 3)}</a></table>",
        f"<body>{top}<div>{boxes}</div>{end}</body>",
        f"<body>{top}<div class=story>{grouped}</div><div><span>{sentence(rnd, 4)}</span> <a href=t>{sentence(rnd, 6)}</a></div></body>",
        f"<div class='ad'>{sentence(rnd, 40)}</div><div><div>{plain}</div><div><a href=1>{sentence(rnd, 5)}</a> {sentence(rnd, 2)}</div></div>",
    ][seed % 6]
    return html, text


def test_pages_without_article():
    """The clustering finds the article's lines, all of them, and on most pages leaves lines out."""
    decided = 0
    for seed in range(60):
        html, want = page(seed)
        assert H.main_text(html) == want, (seed, html)
        decided += want != "\n".join(x.text for x in H.parsed(html).lines)
    assert decided >= 50


def test_article_wins_over_longer_text_beside_it():
    reader = "a reader says a lot " * 30
    assert H.main_text(f"<body><article><p>Short one.<p>Short two.</article><section>{reader}</section>") == "Short one.\nShort two."
    assert H.main_text(f"<main><p>Only this.</main><div>{reader}</div>") == "Only this."
    assert H.main_text("<main></main><div><p>" + reader + "</div>") == reader.strip()


@pytest.mark.parametrize("inner", ["<noscript><div>n</div></noscript>", "<span class=ad><div>n</div></span>", "<video><p>n<p>m</video>",
                                   "<p class=notice>n", "<form><ul><li>n<li>m</ul></form>", "<button><div>n</div></button>"])
def test_nothing_leaves_a_skipped_element(inner):
    assert H.main_text(f"<article><p>a{inner}<p>b</article>") == "a\nb"


@pytest.mark.parametrize("name", "ad-container ad-wrapper sidebar-left nav-wrapper comment-body related-posts footer-inner header-top promo-inner site-footer x_ad".split())
def test_class_names_skipped(name):
    assert H.main_text(f"<article><p>x</p><div class='{name}'>y</div></article>") == "x"


@pytest.mark.parametrize("name", "no-sidebar has-comments with-ads shadow address-list headerless".split())
def test_class_names_kept(name):
    assert H.main_text(f"<article><p>x</p><div class='{name}'>y</div></article>") == "x\ny"


def test_deep_and_long_pages_take_linear_time():
    for build in (lambda n: "<div>" * n + "x" + "</div>" * n, lambda n: "<p>a<table>" + "<div>" * n + "x", lambda n: "<ul><li>a" * n,
                  lambda n: "<div>" + "<p>word " * n + "</div>", lambda n: "<div><a href=x>y</a></div>" * n, lambda n: "</p>" * n + "<b>" * n + "x"):
        times = []
        for n in (4_000, 16_000):
            start = time.process_time()
            H.main_text(build(n))
            times.append(time.process_time() - start)
        assert times[1] < 10 * times[0] + 0.2
    assert H.main_text("<div>" + "<p>word " * 50_000 + "</div>") == "\n".join(["word"] * 50_000)


def test_odd_columns(spark):
    rows = [(1, "u", "<article>a</article>"), (None, None, None), (1, "u", "<article>a</article>"), (2, "v", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "7 AS n_chars")
    got = H.extracted(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(
        [(1, "u", "a", 1), (None, None, "", 0), (1, "u", "a", 1), (2, "v", "", 0)], key=str)
