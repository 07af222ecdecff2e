"""Main text: containers, links, stop words, broken markup and defined cases."""

from shelfsight.llm.html_text import extract, main_text

LONG = "The house of the miller stood at the end of the road and it was old, with a roof that the wind had taken in parts. "
ART = f"<h1>A title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}2</p>"
WANT = f"A title\n{LONG.strip()}\nShort.\n{LONG}2"


def page(body, around=True):
    menu = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News of the day</a></li></ul></nav>"
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{menu * around}{body}<footer>&copy; 2024 us</footer></body></html>"


def test_what_stands_around_goes():
    around = [
        f'<header><p>{LONG}</p></header>', f'<aside><p>{LONG}</p></aside>', f'<div class="ad">{LONG}</div>', f"<div id='cookie-notice'><p>{LONG}</p></div>", f'<div class="sidebar left"><p>{LONG}</p></div>',
        f"<form><label>{LONG}</label><input></form>", f"<section class='comments'><p>{LONG}</p></section>", f"<div role=complementary>{LONG}</div>", f"<script>var t='</p>{LONG}';</script>", f"<!-- <p>{LONG}</p> -->",
        f"<noscript>{LONG}</noscript>", f'<ul class="menu"><li>{LONG}</li></ul>', f'<div class="newsletter-signup">{LONG}</div>', '<p><a href="/x">' + LONG + "</a></p>",
    ]
    for extra in around:
        for html in (page(extra + f"<article>{ART}</article>"), page(f"<article>{ART}</article>" + extra), page(extra + f"<div class=content>{ART}</div>")):
            assert main_text(html) == WANT, extra


def test_inside_an_article():
    assert main_text(page(f'<article><header><h1>A title</h1></header><p>{LONG}</p><div class="ad">Buy the thing of the day</div><p>Short.</p><p>{LONG}2</p></article>')) == WANT


def test_cards_that_are_links_as_a_whole():
    card = f'<a href="/x"><div><h3>Another title</h3><p>{LONG}</p><p>More of it</p></div></a>'
    for cards in (card * 3, f"<div class=teasers>{card * 3}</div>", f"<ul>{f'<li>{card}</li>' * 3}</ul>"):
        for body in (f"<article>{ART}</article>{cards}", f"<div class=content>{ART}</div>{cards}", f"{cards}<div class=content>{ART}</div>"):
            assert main_text(page(body)) == WANT, body
    for start in ("<a href=/x>", "<a href=/x><a href=/y>", "<a name=top>"):  # never closed, or no link
        assert main_text(page(f"<div><p>{start}</p>{ART}</div>")) == WANT, start
    assert main_text(page(f"<a name=top><article>{ART}</article></a>")) == WANT
    assert main_text("<p><a href=/x>y" * 20_000 + f"</p>{ART}") == WANT


def test_copyright_signs():
    told = "The sign \N{COPYRIGHT SIGN} stands before a year."
    assert main_text(page(f"<div><h1>A title</h1><p>{LONG}</p><p>{told}</p><p>{LONG}2</p></div>")) == WANT.replace("Short.", told)
    for notice in ("&copy; The Miller", "Copyright &copy; 2024 The Miller", "The Miller &copy; 2024", "The Miller, 2024 &copy;", "&copy The Miller. All rights reserved."):
        assert main_text(page(f"<div>{ART}<p>{notice}</p></div>")) == WANT, notice


def test_containers_around_the_whole_text():
    for tag in (
        '<form id="aspnetForm" action="x">', '<div id=page class="site no-sidebar">', '<div class="header-fixed">', '<div class="wrap has-comments with-menu">', '<div class="menu-layout">', '<div class="layout sidebar-left">',
    ):
        end = "</form>" if tag.startswith("<form") else "</div>"
        for body in (f"<article>{ART}</article>", f"<main>{ART}</main>", f"<div class=content>{ART}</div>"):
            more = f'<div class="sidebar"><p>{LONG}</p></div><section class=comments><p>{LONG}</p></section>'
            assert main_text(page(f"{tag}{body}{more}{end}")) == WANT, (tag, body)
    assert main_text(page(f'<article><div class="post-header"><h1>A title</h1></div><p>{LONG}</p><p>Short.</p><p>{LONG}2</p></article>')) == WANT


def test_long_parts_beside_the_text_still_go():
    for extra in (f"<section class=comments>{f'<article><p>{LONG}</p></article>' * 9}</section>", f"<div class=comments>{f'<p>{LONG}</p>' * 9}</div>", f"<div class='cookie-notice'><p>{LONG}</p></div>"):
        assert main_text(page(f"<article>{ART}</article>{extra}")) == WANT, extra
    assert main_text(page(f"<div>{ART}</div><section class=comments>{f'<article><p>{LONG}</p></article>' * 9}</section>")) == WANT
    assert main_text(page(f"<div class=menu-layout><article>{ART}</article></div><section class=comments><article><p>{LONG}</p></article></section>")) == WANT


def test_deep_and_many_containers():
    assert main_text("<div class=layout-menu>" * 50_000 + ART) == WANT
    assert main_text(f"<div>{ART}</div>" + "<div class=ad>word</div>" * 50_000) == WANT


def test_broken_markup():
    assert main_text(page(f"<article><h1>A title</h1><p><b>{LONG}<br><p>Short.<p>{LONG}2</article>")) == WANT
    assert main_text(f"<p>{LONG}<p>Short.<p>{LONG}<div class='x") == f"{LONG.strip()}\nShort.\n{LONG.strip()}"
    assert main_text(f"<script>never closed <p>{LONG}") == ""
    assert main_text(f"<p>1 < 2 & 3 > 2. {LONG}</p>").startswith("1 < 2 & 3 > 2.")
    assert main_text(f'<p title="a > b">{LONG}</p>') == LONG.strip()


def test_references_and_white_space():
    assert main_text(f"<p>{LONG}a&amp;&#233;&eacute;&nbsp; b\n\tc&lt;d&gt;</p>") == f"{LONG}a&éé b c<d>"


def test_open_blocks_follow_their_neighbours():
    low = "Zyx wvu tsrq ponm lkji hgfe dcba zyxw vuts rqpo nmlk jihg fedc bazy xwvu tsrq"
    assert main_text(f"<div><p>{LONG}</p><p>{low}</p><p>{LONG}</p></div>") == f"{LONG.strip()}\n{low}\n{LONG.strip()}"
    assert main_text(f"<nav>{LONG}</nav><div>{low}</div><footer>{LONG}</footer>") == ""
    assert main_text(low) == low


def test_texts_without_stop_words_stay():
    italian = "Nella vecchia casa sulla collina viveva molto tempo fa una famiglia numerosa, ogni sera tutti cantavano insieme davanti alla finestra."
    polish = "Dawno temu w starym domu przy lesie mieszkał młynarz, który każdego ranka chodził nad rzekę i wracał dopiero wieczorem."
    russian = "Давным-давно в старом доме у самого леса жил мельник, который каждое утро ходил к реке и возвращался только вечером."
    chinese = "很久以前，在森林边的一座老房子里住着一位磨坊主，他每天早晨都走到河边，直到傍晚才回家，村里的人都认识他。"
    notice = f'<div class="cookie-notice"><p>{LONG}</p></div>'
    for text in (italian, polish, russian, chinese):
        for times in (1, 3, 30):
            want = "\n".join([text] * times)
            for around in ("", notice):
                assert main_text(page(f"{around}<div>{f'<p>{text}</p>' * times}</div>")) == want, text
            assert main_text(page(f'<form id=aspnetForm><div class="main-menu"><a href=/>{text}</a></div><div>{f"<p>{text}</p>" * times}</div></form>')) == want, text
    cells = [f"cell {k}" for k in range(40)]
    rows = "".join(f"<tr><td>{c}</td></tr>" for c in cells)
    assert main_text(page(f"<table>{rows}</table>")) == "\n".join(cells)
    assert main_text(page("<ul>" + "".join(f"<li>{c}</li>" for c in cells) + "</ul>")) == "\n".join(cells)
    code = "x = f(y)\n" * 40
    assert main_text(page(f"<div><pre>{code}</pre></div>")) == " ".join(code.split())
    # Beside good blocks, long runs aren't lost to the footer either.
    assert main_text(page(f"<div>{ART}</div>" + f"<div><p>{italian}</p></div>" * 5)) == WANT + f"\n{italian}" * 5


def test_table(spark):
    rows = [(1, "u", page(f"<article>{ART}</article>"), 5), (2, None, None, 5), (None, "u", "", 5), (3, "v", "plain words", 5), (3, "v", "plain words", 5), (4, "w", f"<p>{LONG * 20_000}</p>", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in extract(pages, ["page_id", "url"]).collect()), key=str)
    big = (LONG * 20_000).strip()
    want = [(1, "u", WANT, len(WANT)), (2, None, "", 0), (None, "u", "", 0), (3, "v", "plain words", 11), (3, "v", "plain words", 11), (4, "w", big, len(big))]
    assert got == sorted(want, key=str)
    assert extract(pages.limit(0), ["page_id"]).count() == 0
