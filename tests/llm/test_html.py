import itertools
import random

from quern.llm import htmltext
from quern.llm.mincut import least_cut


def cost(side, source, sink, edges):
    return sum(source[i] for i, x in enumerate(side) if not x) + sum(sink[i] for i, x in enumerate(side) if x) + sum(w for i, j, w in edges if side[i] != side[j])


def test_least_cut_against_all_cuts():
    rng = random.Random(3)
    for _ in range(150):
        n = rng.randint(1, 8)
        source, sink = ([rng.randint(0, 9) for _ in range(n)] for _ in range(2))
        edges = [(*rng.sample(range(n), 2), rng.randint(0, 6)) for _ in range(rng.randint(0, 12))] if n > 1 else []
        got = least_cut(source, sink, edges)
        assert cost(got, source, sink, edges) == min(cost(s, source, sink, edges) for s in itertools.product((False, True), repeat=n))
    assert least_cut([], [], []) == []


BODY = "Enough words to be read as a paragraph of the article, with a stop at its end. " * 2


def test_article_with_everything_around_it():
    html = f"""<!DOCTYPE html><html><head><title>No</title><style>p{{x}}</style><script>var t="</p>";</script></head><body class="sidebar">
    <header><h1>Site name</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><!-- ad --><div class="ad">Buy now, {BODY}</div>
    <div id="cookie-notice"><p>We use cookies. {BODY}</p></div>
    <article><h1>Title &amp; more</h1><p><b>First&nbsp;para {BODY}<br><p>Sh is.</p><p>a<br>b <i>c</i>d &#233;</p>
    <div class="advert">{BODY}</div><aside>{BODY}</aside><ul><li>One <li>Two</ul><form><p>{BODY}<input></p></form></article>
    <section id="comments"><article><p>Nice article, I say. {BODY}</p></article></section><footer>&copy; x &middot; {BODY}</footer></body></html>"""
    body = BODY.strip()
    assert htmltext.main_text(html) == f"Title & more\n\nFirst para {body}\n\nSh is.\n\na b cd é\n\nOne\n\nTwo"


def test_pages_without_an_article():
    html = f"<body><div class=menu><a href=/>x</a> <a href=/y>y</a></div><div class=content><p>{BODY}</p><p>Short.</p><p>{BODY}</p></div><div>All rights reserved</div>"
    assert htmltext.main_text(html) == f"{BODY.strip()}\n\nShort.\n\n{BODY.strip()}"
    assert [htmltext.main_text(x) for x in (None, "", "  ", "<p>", "<script>x", "<nav>a</nav>")] == [""] * 6
    assert htmltext.main_text("<article>" + "<p>" + "x " * 200_000) == " ".join(["x"] * 200_000)


def test_head_without_end_tag():
    body = BODY.strip()
    head = "<!DOCTYPE html><html><head><meta charset=utf-8><title>No</title><style>p{}</style><noscript><img src=x></noscript><script>x</script>"
    for start in ("<body>", "", "<body><div>", "<div>", "<main>"):
        assert htmltext.main_text(f"{head}\n{start}<article><p>{BODY}</p></article>") == body
    assert htmltext.main_text(f"{head} {BODY}") == body
    assert htmltext.main_text(f"{head}<noscript><link><body><p>{BODY}</p>") == body
    assert htmltext.main_text(f"{head}<template><p>No</p></template><link></head><body><p>{BODY}</p>") == body


def test_svg_and_math():
    body = BODY.strip()
    page = lambda x: htmltext.main_text(f"<html><body><article><p>{BODY}</p>{x}<p>{BODY}</p></article></body></html>")
    for x in ("<svg/>", "<svg class=icon />", "<math/>", "<svg><title>No</title><path d=x /><g/></svg>", "<svg><path>", "<div><svg/></div>", "<svg><g><foreignObject><div/>No</foreignObject></g></svg>", "<svg><style/></svg>"):
        assert page(x) == f"{body}\n\n{body}", x
    assert page("<div><svg/>After it.</div>") == f"{body}\n\nAfter it.\n\n{body}"
    for x in ("<svg/>", "<svg><title>No</title><g><path d=x /></g></svg>"):
        assert page(f"<p>One {x} line.</p>") == f"{body}\n\nOne line.\n\n{body}"
    formula = "<math><semantics><mrow><msup><mi>x</mi><mn>2</mn></msup><mspace/><mo>=</mo><mn>4</mn></mrow><annotation encoding=TeX>x^2=4</annotation></semantics></math>"
    assert page(f"<p>Let {formula} hold.</p>") == f"{body}\n\nLet x2=4 hold.\n\n{body}"
    assert page("<p>Or <math><mi>y</p>") == f"{body}\n\nOr y\n\n{body}"


def test_the_cut_decides():
    """Short lines and list items of a page without an article are doubtful alone and content among their neighbours; a sentence in a footer of no name is the reverse."""
    page = f"<body><div><a href=/>Home</a> <a href=/x>About</a></div><div><p>{BODY}</p><ul><li>One thing</li><li>Two things</li></ul><p>{BODY}</p><div>Another line.</div><p>{BODY}</p></div><div><ul><li><a href=/1>x</a></li><li>Contact us by mail, at any time of the day.</li><li><a href=/2>y</a></li></ul></div></body>"
    body, blocks = BODY.strip(), htmltext.Blocks()
    blocks.feed(page)
    blocks.close()
    for b in blocks.blocks:
        b.good = 0.3
    signs = [b.text for b, x in zip(blocks.blocks, htmltext.capacities(blocks.blocks)) if x > 0]
    got = htmltext.main_text(page).split("\n\n")
    assert got == [body, "One thing", "Two things", body, "Another line.", body]
    assert signs == [body] * 3


def test_names_of_articles():
    text = "\n\n".join([BODY.strip()] * 3)
    inner = f"<p>{BODY}</p>" * 3
    for start in ("<article class='post legal'>", "<article id=related>", "<main class=search>", "<article><section class=search>", "<article><div class=social-story>", "<article class=notice>"):
        assert htmltext.main_text(f"<html><body><nav><a href=/>x</a></nav>{start}{inner}</body></html>") == text, start
    for name in ("advert", "newsletter", "cookie-notice", "comments"):
        assert htmltext.main_text(f"<article>{inner}<div class={name}><p>{BODY}</p></div></article>") == text
    assert htmltext.main_text(f"<article>{inner}<div class=related><a href=/1>One thing</a> <a href=/2>Another</a></div></article>") == text


def test_buttons_and_pages_without_tags():
    assert htmltext.main_text(f"<article><p>Press <button>Start</button> now. {BODY}</p><button>Share</button><p><button>Like</button></p></article>") == f"Press Start now. {BODY.strip()}"
    assert htmltext.main_text("Bare text &amp; no tag.\n  Two lines.") == "Bare text & no tag. Two lines."


def test_deep_pages_take_time_in_proportion():
    import time

    n = 15_000
    for open_, close in (("<div><p>x", ""), ("<b>", "<div>x</div>"), ("<svg><g>", "</i>"), ("<i><div>", "</i>"), ("<p><b>", "</section>")):
        began = time.perf_counter()
        htmltext.main_text("<article>" + open_ * n + close * n)
        assert time.perf_counter() - began < 10, open_


def test_table(spark):
    rows = [(1, "u", "<article><p>Hé</p></article>", "n"), (None, None, None, None), (1, "u", "<article><p>Hé</p></article>", "n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted(map(str, htmltext.extract(df).collect())) == sorted(["Row(page_id=1, url='u', text='Hé', n_chars=2)"] * 2 + ["Row(page_id=None, url=None, text='', n_chars=0)"])
    assert htmltext.extract(df.where("false")).count() == 0


def test_pages_keep_their_article(spark):
    import html
    import re

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        inner = re.search("<article>(.*)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert htmltext.main_text(r.html) == "\n\n".join(x for x in parts if x)
