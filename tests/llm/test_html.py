import pytest

from emberline.llm.html_text import extract, main_text

BODY = "<p>First part, with a comma, and some more words to be long.</p><p>Second &amp; last\n\t part&nbsp;here.</p>"


def page(content, head="", tail=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p><p>no';</script></head><body>{head}{content}{tail}</body></html>"


TEXT = "First part, with a comma, and some more words to be long.\nSecond & last part here."
NAV = "<nav><ul><li><a href='/a'>A</a></li><li><a href='/b'>B</a></li></ul></nav>"
CASES = {
    "article": (page(f"<article><h1>Title</h1>{BODY}</article>", NAV), "Title\n" + TEXT),
    "div": (page(f"<div class='content'>{BODY}</div>", "<div id='menu'><a href='/'>Home</a></div>", "<div class='footer'>Copyright</div>"), TEXT),
    "adverts": (page(f"<div class='ad'>Buy now, it is cheap, really.</div><article>{BODY}<div class='advert'>Buy</div></article>"), TEXT),
    "comments": (page(f"<article>{BODY}<section id='comments'><p>I think, therefore, I write, a lot, here.</p></section></article>"), TEXT),
    "sidebar": (page(f"<main>{BODY}</main><aside><p>Related, other, things, to read, for long.</p></aside>"), TEXT),
    "form": (page(f"<article>{BODY}<form><p>Your name</p><input></form></article>"), TEXT),
    "notice": (page(f"<div class='cookie-notice'><p>We use cookies, as all do, for ads.</p></div><article>{BODY}</article>"), TEXT),
    "header": (page(f"<header><h1>Site name</h1></header><article><header><h1>Title</h1></header>{BODY}</article>"), "Title\n" + TEXT),
    "unclosed": (page("<article><h1>T<p><b>Bold text<br><p>Next para<p>Last"), "T\nBold text\nNext para\nLast"),
    "no article end": ("<article><p>Only this", "Only this"),
    "siblings": (page(f"<div><h2>Head</h2>{BODY}</div>"), "Head\n" + TEXT),
    "nested body": (page(f"<article><h1>Title</h1><div class='body'>{BODY}</div></article>"), "Title\n" + TEXT),
    "list in text": (page(f"<article>{BODY}<ul><li>one thing<li>another</ul></article>"), TEXT + "\none thing\nanother"),
    "link list": (page(f"<article>{BODY}<ul><li><a href='x'>one</a></li><li><a href='y'>two</a></li></ul></article>"), TEXT),
    "inline links": (page("<article><p>See <a href='x'>this</a> and <i>that</i>, too.</p></article>"), "See this and that, too."),
    "comment markup": (page(f"<article><!-- <p>hidden</p> -->{BODY}</article>"), TEXT),
    "hidden": (page(f"<article><p style='display: none'>secret</p><p hidden>x</p>{BODY}</article>"), TEXT),
    "references": (page("<article><p>&lt;b&gt; &copy; &#x41;&#66; &eacute; a &lt b & c</p></article>"), "<b> © AB é a < b & c"),
    "lone angle": (page("<article><p>1 < 2 and 3 > 2, it's \"so\"</p></article>"), "1 < 2 and 3 > 2, it's \"so\""),
    "attribute with sign": (page("<article><p title='a > b'>text one</p><p data-x=\"</p>\">text two</p></article>"), "text one\ntext two"),
    "table": (page(f"<article>{BODY}<table><tr><td>a<td>b</table></article>"), TEXT + "\na\nb"),
    "mark of two kinds": (page(f"<div class='layout has-sidebar'><article>{BODY}</article></div>"), TEXT),
    "reader content": (page(f"<div class='reader-content'>{BODY}</div>"), TEXT),
    "form around all": (page(f"<form id='aspnet'>{NAV}<div>{BODY}</div></form>"), TEXT),
    "marked page": (page(f"<div class='widget'><article>{BODY}</article></div>"), TEXT),
    "share price": (page(f"<article>{BODY}<div class='share-price'><p>It rose, as said.</p></div><section class='social-science'><p>More, of it.</p></section></article>"), TEXT + "\nIt rose, as said.\nMore, of it."),
    "share buttons": (page(f"<article>{BODY}<div class='share-buttons'>Tell, all, your friends</div></article>"), TEXT),
    "named paragraph": (page(f"<article><p class='reader'>Dear reader,</p>{BODY}<p class='notice'>So it is.</p></article>"), "Dear reader,\n" + TEXT + "\nSo it is."),
    "long comments": (page(f"<article>{BODY}</article><div class='comments'><article class='comment'>{BODY * 4}</article><article>{BODY * 3}</article></div>"), TEXT),
    "comments inside": (page(f"<article>{BODY}<div id='reader-comments'>{BODY * 5}</div></article>"), TEXT),
    "related": (page(f"<article>{BODY}</article><div class='related-posts'><article><p>Teaser, one, two, three.</p></article></div>"), TEXT),
    "two articles": (page(f"<article>{BODY}</article><article><p>Short.</p></article>"), TEXT + "\nShort."),
    "two mains": (page(f"<main>{BODY}</main><main>Short.</main>"), TEXT + "\nShort."),
    "long notice": (page(f"<div class='cookie-banner'>{BODY * 3}</div><main><p>Little, but main.</p></main>"), "Little, but main."),
    "stray ends": (page(f"</p></div></section><article></li></ul>{BODY}</td></article>"), TEXT),
    "plain": ("just words", "just words"),
    "empty": ("", ""),
    "only menu": (page("", NAV), ""),
}


@pytest.mark.parametrize("name", CASES)
def test_case(name):
    markup, text = CASES[name]
    assert main_text(markup) == text


def test_null_and_clashing_columns(spark):
    rows = [(1, "u", CASES["article"][0], "x", 3), (1, "u", CASES["article"][0], "x", 3), (None, None, None, None, None)]
    found = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    assert [(r.text, r.n_chars) for r in found] == [("Title\n" + TEXT, len("Title\n" + TEXT))] * 2 + [("", 0)]


def test_empty_table(spark):
    assert extract(spark.createDataFrame([], "page_id long, html string")).collect() == []


def test_long_and_hostile_pages_are_quick():
    import time

    start = time.time()
    assert main_text("<article>" + "<p>word, word" * 50_000 + "</article>").count("\n") == 49_999
    main_text("<div " * 20_000)
    main_text("<div>" * 3_000 + "x")
    main_text("<a href='" * 5_000)
    assert time.time() - start < 30


@pytest.mark.parametrize("end", ["", "</article></body>"])
def test_pages_of_the_test_tables(end):
    markup = f'<!DOCTYPE html><html lang="fr"><head><meta charset="utf-8"><title>T</title></head><body>{NAV}<!-- ad 0 --><div class="ad">Pub, pub.</div><article><h1>Un</h1><p><b>Deux&amp;<br><p>Trois.</p>{end}<footer>&copy; x</footer>'
    assert main_text(markup) == "Un\nDeux&\nTrois."


@pytest.mark.parametrize(
    "markup",
    ["<div>x, y" * 20_000, "<ul>" + "<div>" * 8_000 + "<li>a</li>" * 8_000, "<div>" * 20_000 + "</p>" * 20_000, "<section><p>a, b" * 12_000, "<table><tr><td>" * 6_000, "<h1>" * 20_000, "<textarea>" * 20_000, "<b" * 100_000, "<article><div class='a b c'>x" * 8_000, "<div class='" + "ad-" * 50_000 + "'>x</div>"],
    ids=range(10),
)
def test_time_grows_with_the_page(markup):
    import time

    start = time.time()
    main_text(markup)
    assert time.time() - start < 4


def scores_by_definition(markup):
    """The text by sums over all ancestors of every block, as the rule is told."""
    from emberline.llm import html_text as H

    nodes, blocks = H.parse(markup)
    H._refute(nodes, blocks)
    up = lambda n: list(H._ancestors(n))
    blocks = [b for b in blocks if not b.node.junk]
    chars, linked, points = {}, {}, {}
    for b in blocks:
        for n in up(b.node):
            chars[id(n)] = chars.get(id(n), 0) + len(b.text)
            linked[id(n)] = linked.get(id(n), 0) + b.linked
    menus = {id(n) for n in nodes if n.name in ("ul", "ol", "dl", "table") and linked.get(id(n), 0) > 0.8 * chars.get(id(n), 0)}
    blocks = [b for b in blocks if not any(id(n) in menus for n in up(b.node))]
    said = [b for b in blocks if b.node.name not in H.HEADINGS]
    if not said:
        return "\n".join(b.text for b in blocks)
    for b in said:
        worth = (1 + b.text.count(",") + min(len(b.text) / 100, 3)) * (1 - b.linked / len(b.text))
        holder = b.node if b.node.name in ("div", "section", "article", "main", "body", "html") else b.node.parent or b.node
        for depth, n in enumerate(up(holder)):
            points[id(n)] = points.get(id(n), 0) + worth / (1, 2, 6, 9, 12)[min(depth, 4)]
    score = lambda n: points.get(id(n), 0) * (1 - linked.get(id(n), 0) / max(chars.get(id(n), 0), 1))
    best = max((n for n in nodes if not n.junk and id(n) in points), key=lambda n: round(score(n), 9))
    whole = next((n for n in up(best) if n.name in ("article", "main")), None)
    best = whole or best
    kept = {id(best)}
    for n in best.parent.children if best.parent else ():
        c, k = chars.get(id(n), 0), linked.get(id(n), 0)
        like = score(n) >= max(3.0, 0.2 * score(best)) or (whole and n.name == whole.name and k < 0.5 * c) or (not whole and (n.name in H.HEADINGS or (n.name in ("p", "pre", "blockquote") and c and k < 0.25 * c)))
        if not n.junk and like:
            kept.add(id(n))
    return "\n".join(b.text for b in blocks if any(id(n) in kept for n in up(b.node)))


def test_equals_the_definition_on_random_pages():
    import random

    rng = random.Random(6)
    names = ["div", "p", "section", "article", "ul", "li", "h2", "nav", "aside", "table", "tr", "td", "a", "b", "form", "main", "blockquote", "header"]
    for _ in range(400):
        parts = []
        for _ in range(rng.randrange(1, 60)):
            n = rng.choice(names)
            parts.append(rng.choice([f"<{n}>", f"<{n} class='{rng.choice(['ad', 'comments', 'text', 'share box', 'widget'])}'>", f"</{n}>", "one, two, three ", "word " * rng.randrange(1, 40)]))
        markup = "".join(parts)
        assert main_text(markup) == scores_by_definition(markup), markup


def test_parts_of_an_article_that_look_like_furniture_stay():
    page = (
        "<body><nav><a href=x>Menu</a></nav><article><h1>T</h1><p>Long text, with commas, and more words to count.</p><ul><li><a href=1>One source</a></li><li><a href=2>Another</a></li></ul>"
        "<p>And <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding='t'>x = 2</annotation></math> ends.</p><section id='discussion'><h2>Discussion</h2><p>We discuss, at length, the results.</p></section>"
        "<div class='discussion thread'><p>a reader says</p></div><div class='comments'><p>first!</p></div></article><div id='discussion'><p>another reader</p></div></body>"
    )
    assert main_text(page).split("\n") == ["T", "Long text, with commas, and more words to count.", "One source", "Another", "And x=2 ends.", "Discussion", "We discuss, at length, the results."]


def test_a_menu_of_links_beside_an_article_goes():
    page = "<body><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul><div><p>Text of a page, without an article, that is long enough to count as its text.</p></div></body>"
    assert main_text(page) == "Text of a page, without an article, that is long enough to count as its text."


def test_a_list_of_links_under_a_heading_of_an_article_stays():
    page = "<article><p>Text of an article, that is long enough to count as its text.</p><h2>Sources</h2><ol><li><a href=1>One</a></li></ol><ul><li><a href=2>Next page</a></li></ul></article>"
    assert main_text(page).split("\n")[1:] == ["Sources", "One"]
