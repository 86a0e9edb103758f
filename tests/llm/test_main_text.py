"""Main text of pages whose furniture stands within the text or whose wrappers bear furniture's names."""

import pytest

from ledgerlens.llm import main_text
from ledgerlens.llm.common import tuned


def some(n, name):
    return " ".join(f"{name}{i}" for i in range(n))


AD = f"<div class='ad'>{some(20, 'buy')}</div>"
HEAD, BODY, END = some(8, "head"), some(90, "body"), some(15, "end")
#: Adverts outside the article only.
USUAL = f"<body>{AD}<div>{some(30, 'site')}</div><article><h1>{HEAD}</h1><p>{BODY}</p></article>{AD}<div>{some(30, 'foot')}</div></body>"


@pytest.fixture
def texts(spark):
    def run(*pages):
        tuned(spark)
        rows = [(i, page) for i, page in enumerate([*pages, *[USUAL] * 8])]
        got = {r["page_id"]: r["text"] for r in main_text.main_text(spark.createDataFrame(rows, "page_id long, html string")).collect()}
        assert got[len(pages)] == f"{HEAD} {BODY}"
        return [got[i] for i in range(len(pages))]

    return run


def test_furniture_amid_the_text_cuts_nothing(texts):
    share = "<ul class='share'><li><a href=x>Post this</a></li><li><a href=y>Send that</a></li></ul>"
    inner = [
        f"<h1>{HEAD}</h1>{AD}<p>{BODY}</p>", f"<p>{BODY}</p>{AD}<p>{END}</p>", f"<h1>{HEAD}</h1>{AD}{share}<p>{BODY}</p><aside><p>{some(60, 'side')}</p></aside>{AD}<p>{END}</p>",
    ]
    want = [f"{HEAD} {BODY}", f"{BODY} {END}", f"{HEAD} {BODY} {END}"]
    outside = f"<body>{AD}<div>{some(30, 'site')}</div>%s{AD}<div>{some(30, 'foot')}</div></body>"
    assert texts(*[outside % f"<article>{x}</article>" for x in inner]) == want
    # Without a label: between two blocks of text of one parent.
    assert texts(*[outside % f"<section>{x}</section>" for x in inner]) == want


def test_furniture_beside_the_text_still_cuts():
    weights = {"div": 0.5, "p": 1.0, "div!": -3.0}
    page = f"<body><div>{some(9, 'site')}</div>{AD}<div><p>{BODY}</p></div></body>"
    assert main_text.extract(page, weights) == BODY


NAMES = ["layout-sidebar-right", "content-with-sidebar", "right-sidebar", "nav-open", "js-modal-open", "comment-enabled", "page-search"]


@pytest.mark.parametrize("name", NAMES)
def test_names_of_wrappers_cut_nothing(name):
    weights = {"p": 1.0, "p!": -3.0, "h1": 1.0, "div": -1.0, "<div>": -3.0}
    side = f"<div class='sidebar'><p>{some(50, 'side')}</p></div>"
    for content in ("<main>%s</main>", "<article>%s</article>", "<div itemprop='articleBody'>%s</div>", "<div role='main'>%s</div>", "<main><article>%s</article></main>"):
        inner = content % f"<h1>{HEAD}</h1><p>{BODY}</p>{AD}<p>{END}</p>"
        within = f"<main><div class='{name}'>{inner}</div></main>" if "main" not in content else inner
        for page in (f"<body><div class='{name}'>{inner}{side}</div></body>", f"<body><div id='x' class='wide {name}'><div id='{name}'>{side}<div>{inner}</div></div></div></body>", f"<html class='{name}'><body>{within}{side}</body></html>"):
            assert main_text.parse(page)[1] == 1
            assert main_text.extract(page, weights) == f"{HEAD} {BODY} {END}"


def test_articles_in_marked_elements_stay_comments_and_teasers():
    weights = {"p": 1.0, "p!": -3.0, "h1": 1.0, "div": -1.0}
    said = "".join(f"<article><p>{some(30, f'says{i}x')}</p></article>" for i in range(3))
    text = f"<h1>{HEAD}</h1><p>{BODY}</p>"
    for box in ("id='comments'", "class='related-posts'", "class='sidebar'"):
        others = f"<div {box}>{said}</div>"
        for page in (f"<article>{text}</article>{others}", f"<main>{text}{others}</main>", f"<div>{text}</div>{others}", f"<div class='right-sidebar'><article>{text}</article>{others}</div>"):
            assert main_text.extract(f"<body>{page}</body>", weights) == f"{HEAD} {BODY}"


def test_quotes_open_values_only():
    from ledgerlens.llm.markup import plain_text

    assert plain_text("<p title=don't>Hello it's me</p><p>next</p>") == ["Hello it's me", "next"]
    assert plain_text("<p title = \"a > b\">one</p><p a='x>y' b=\"'\">two</p><p \"odd\" 'x>three</p>") == ["one", "two", "three"]
    assert plain_text("<script a=\"b>c\">no</script><script src=x/><p>yes</p><p a=\"never closed>tail</p>") == ["yes", "tail"]


def test_a_page_within_a_form_keeps_its_text():
    weights = {"p": 1.0, "h1": 1.0, "p!": -3.0, "<form>": -0.5}
    nav = "<nav><a href=x>Home</a> <a href=y>News</a></nav>"
    text = f"<h1>{HEAD}</h1><p>{BODY}</p>"
    for inner in (f"<main>{text}</main>", f"<article>{text}</article>", f"<div>{text}</div>"):
        page = f"<body><form id=aspnetForm>{nav}{inner}<aside>{some(20, 'side')}</aside></form></body>"
        assert main_text.extract(page, weights) == f"{HEAD} {BODY}"
    # A form of a page is still none of its text.
    page = f"<body><div>{text}</div><form><p>{some(40, 'ask')}</p><label>{some(9, 'name')}</label></form></body>"
    assert main_text.extract(page, weights) == f"{HEAD} {BODY}"


def test_time_follows_the_length_however_deep(spark):
    import time

    weights = {"p": 1.0}
    shapes = ["<div>", "<div class='menu x'>", "<blockquote><p>a b</p>", "<span>", "<a href=x>", "<article>", "<form>", "<ul><li>word", "<div><aside>x</aside>y"]
    for shape in shapes:
        page = shape * (200_000 // (shape.count("<") + 1)) + "<p>the end</p>"
        start = time.time()
        main_text.extract(page, weights)
        assert time.time() - start < 20, shape


def test_a_column_named_text_gives_way(spark):
    tuned(spark)
    pages = spark.createDataFrame([(1, USUAL, "old", 5)], "page_id long, html string, Text string, n long")
    out = main_text.main_text(pages)
    assert out.columns == ["page_id", "n", "text"] and out.first()["text"] == f"{HEAD} {BODY}"
