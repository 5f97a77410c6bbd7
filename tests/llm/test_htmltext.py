import time

import pytest
from pyspark.sql import functions as F

from logweave.llm import htmltext as H

P1 = "The first paragraph is long, it has commas, and it says quite a lot."
P2 = "Another paragraph follows; it is also long, with marks, and it ends here."


def page(body, head="<title>T</title><style>p{}</style><script>var a='<p>no</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


CASES = {
    "article": (page(f"<nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>Title</h1><p>{P1}</p><p>Ok.</p></article>"
                     "<footer>&copy; Somebody, 2020.</footer>"), f"Title\n{P1}\nOk."),
    "unclosed": (page(f"<article><h1>Title</h1><p><b>{P1}<br><p>{P2}<p>No.</article>"), f"Title\n{P1}\n{P2}\nNo."),
    "advert": (page(f"<div class='ad'>Buy this, it is good, it is cheap, it is here, and only today.</div><article><p>{P1}</p></article>"), P1),
    "divs": (page(f"<div id=header><h1>Site</h1></div><div class=wrap><div class='side-bar sidebar'><p>{P2}</p></div><div class=content>"
                  f"<h2>Head</h2><p>{P1}</p><ul><li>One</li><li>Two</li></ul></div></div><div id=comments><p>{P2} {P2}</p></div>"),
             f"Head\n{P1}\nOne\nTwo"),
    "forms": (page(f"<main><p>{P1}</p><form><p>Your mail, please.</p><button>Go</button></form><p>{P2}</p></main>"), f"{P1}\n{P2}"),
    "hidden": (page(f"<article><p>{P1}</p><p style='display: none'>{P2}</p><p hidden>{P2}</p></article>"), P1),
    "notice": (page(f"<div class=cookie-notice><p>{P2}</p></div><article><p>{P1}</p><aside>{P2}</aside></article>"), P1),
    "entities": (page("<article><p>A&nbsp;&amp;&#32;&lt;b&gt; caf&eacute;,\n\t x &unknown; &#x41;.</p></article>"), "A & <b> café, x &unknown; A."),
    "inline": (page(f"<article><p>{P1} <i>in</i><a href='a>b'>link</a>, <em>x</em></p></article>"), f"{P1} inlink, x"),
    "comment": (page(f"<article><!-- <p>old</p> --><p>{P1}</p><!-- open"), P1),
    "truncated": (f"<html><body><article><p>{P1}</p><p>{P2}</p><a hre", f"{P1}\n{P2}"),
    "upper": (f"<BODY><ARTICLE CLASS=x><P>{P1}<P>{P2}</ARTICLE></BODY>", f"{P1}\n{P2}"),
    "plain": ("only a text, no tags", "only a text, no tags"),
    "table": (page(f"<article><table><tr><td>a<td>b<tr><td>c</table><p>{P1}</p></article>"), f"a\nb\nc\n{P1}"),
    "empty": ("", ""), "null": (None, ""), "nothing": (page("<nav>Menu</nav>"), ""),
}


@pytest.mark.parametrize("name", CASES)
def test_main_text(name):
    html, want = CASES[name]
    assert H.main_text(html) == want


def test_table_of_pages(spark):
    rows = [(i, f"u{i}", html) for i, (html, _) in enumerate(CASES.values())]
    rows += [(0, "u0", rows[0][2]), (None, None, rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted(map(tuple, H.page_texts(df).collect()), key=str)
    want = [(i, u, H.main_text(h), len(H.main_text(h))) for i, u, h in rows]
    assert got == sorted(want, key=str)
    kept = H.extract(df.withColumn("more", F.lit(1)))
    assert kept.columns == ["page_id", "url", "more", "text", "n_chars"]
    assert H.page_texts(df.limit(0)).count() == 0


def test_long_and_hostile_pages_take_linear_time():
    for unit in ("<div>", "<p><b>", "<a href=\"", "</p>", "<li>", "<!--", "<td>", "&amp;", "<p class='ad"):
        t = time.process_time()
        H.main_text(unit * 30_000 + P1)
        assert time.process_time() - t < 5, unit
    many = page("<article>" + f"<p>{P1}</p>" * 5_000 + "</article>")
    assert H.main_text(many) == "\n".join([P1] * 5_000)


def test_path_ratio_fuses_length_and_punctuation():
    import numpy as np
    z = H.fused_ratio(np.array([1, 1, 2, 2, 2, 2, 1, 1]), np.array([3.0, 4, 90, 2, 80, 70, 4, 3]), np.array([0.0, 0, 3, 0, 4, 2, 0, 0]))
    assert z[3] > z[0] and z[4] > z[7]  # a short node takes part in its path's ratio


WHOLE = {
    "sections": (f"<article><section><p>{P1 * 9}</p></section><section><h2>End</h2><p>{P2}</p></section></article>", f"{P1 * 9}\nEnd\n{P2}"),
    "lead": (f"<main><h1>Title</h1><p>{P1}</p><div><p>{P2 * 9}</p><p>{P2 * 9}</p></div></main>", f"Title\n{P1}\n{P2 * 9}\n{P2 * 9}"),
    "title": (f"<div><h1>Title</h1><div><p>{P2 * 9}</p></div></div>", f"Title\n{P2 * 9}"),
    "cell": (f"<article><p>{P1}</p><table><tr><td>{P2 * 20}<td>c</table><p>{P2}</p></article>", f"{P1}\n{P2 * 20}\nc\n{P2}"),
    "figure": (f"<article><p>{P1}</p><figure><figcaption>{P2 * 20}</figcaption></figure></article>", f"{P1}\n{P2 * 20}"),
    "divisions": (f"<div><div><p>{P1 * 20}</p></div><div><p>{P2}</p><p>Ok.</p></div></div>", f"{P1 * 20}\n{P2}\nOk."),
    "linked": (f"<article><p>{P1}</p><p><a href=x>{P2}</a></p><ol><li><a href=y>One, 2003.</a></li><li><a href=z>Two</a></li></ol></article>",
               f"{P1}\n{P2}\nOne, 2003.\nTwo"),
    "references": (f"<div><p>{P1 * 3}</p><p>{P2 * 3}</p><ul><li><a href=y>One</a></li></ul></div>", f"{P1 * 3}\n{P2 * 3}\nOne"),
    "links beside": (f"<div><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></div><div><h1>Title</h1><p>{P1}</p><p>{P2}</p></div>",
                     f"Title\n{P1}\n{P2}"),
}


@pytest.mark.parametrize("name", WHOLE)
def test_no_part_of_an_article_is_left_out(name):
    html, want = WHOLE[name]
    assert H.main_text(page(html)) == want


BODY = f"<h1>Title</h1><p>{P1}</p><p>{P2}</p>"
NAMES = {f"class {c}": (f"<nav>Menu</nav><div class='{c}'>{BODY}</div>", f"Title\n{P1}\n{P2}") for c in (
    "content no-sidebar", "with-sidebar", "entry ad-free", "post social-enabled", "search-result-page", "hasSidebar", "sidebar-right", "page-with-menu")}
NAMES |= {
    "id": (f"<div id=legal-text>{BODY}</div>", f"Title\n{P1}\n{P2}"),
    "not whole": (f"<article><p>{P1 * 9}</p><div class=legal-text><p>{P2}</p></div></article>", f"{P1 * 9}\n{P2}"),
    "form": (f"<form id=aspnetForm><div class=nav>Menu</div><div>{BODY}<label>Mail</label><input><button>Go</button></div></form>", f"Title\n{P1}\n{P2}"),
    "form and main": (f"<form><main>{BODY}</main></form><div>{f'<p>{P2}</p>' * 3}</div>", "\n".join(["Title", P1, *[P2] * 4])),
    "nested": (f"<div class='layout sidebar-right'>{BODY}<div class=sidebar-right><p>{P1}</p></div></div>", f"Title\n{P1}\n{P2}"),
    "long comments": (f"<div><p>{P1}</p></div><div class=comments-area><p>{P2 * 20}</p></div>", P1),
    "short article": (f"<div class=ad>{P2}</div><article><p>Ok, yes.</p></article>", "Ok, yes."),
    "box in article": (f"<article><p>Ok, yes, it is.</p><div class='ad-box'><p>{P2}</p></div></article>", "Ok, yes, it is."),
    "wrapper in article": (f"<article><h1>Title</h1><div class='sidebar-right'><p>{P1}</p><p>{P2}</p></div></article>", f"Title\n{P1}\n{P2}"),
    "whole names": (f"<article><p>{P1}</p><div class=cookieNotice><p>{P2}</p></div><div class=top-ads><p>{P2}</p></div><div id=side_bar>{P2}</div></article>", P1),
}


@pytest.mark.parametrize("name", NAMES)
def test_names_and_forms_do_not_take_the_page(name):
    html, want = NAMES[name]
    assert H.main_text(page(html)) == want


MARKUP = "<nav hidden class='ad'><form>Buy, now. </p>"
QUOTED = {f"{q} {n}": (f"<article><p data-x={q}{(MARKUP if q == chr(34) else MARKUP.replace(chr(39), '')) * n}{q} class=x>{P1}</p><p>{P2}</p></article>",
                       f"{P1}\n{P2}") for q in "\"'" for n in (1, 250, 5_000)}
QUOTED |= {
    "end tag": (f"<article><p>{P1}</p x='>'><p>{P2}</p></article>", f"{P1}\n{P2}"),
    "stray quotes": (f"<article><p it's>{P1}</p><p title=it's\">{P2}</p></article>", f"{P1}\n{P2}"),
    "open quote": (f"<article><p>{P1}</p><p class='x>{P2}</p></article>", f"{P1}\n{P2}"),
    "blanks": (f"<article><p>{P1}</p><p hidden = '>' >{P2}</p><p data-hidden id = \"x>\"\n>{P2}</p></article>", f"{P1}\n{P2}"),
}


@pytest.mark.parametrize("name", QUOTED)
def test_attribute_values_of_any_length_are_not_markup(name):
    html, want = QUOTED[name]
    assert H.main_text(page(html)) == want


def test_unended_tags_take_linear_time():
    for unit in ("<a x=\">\" ", "<a x=\">' ", "<a x='>\" y=\"", "<a x='>", "<p class = ", "<a b/='\">' ", "</a x='>' "):
        t = time.process_time()
        H.main_text(unit * 30_000 + P1)
        assert time.process_time() - t < 5, unit


LONG = "This is a long paragraph, with commas, and sentences. It goes on and on, and says things; many things. " * 4


def test_blocks_of_any_tag_between_paragraphs_of_an_article():
    kept = ["short div line", "another short div", "tail p"]
    body = f"<p>{LONG}</p><div>short div line</div><div>another short div</div><p>tail p</p>"
    for page in (f"<article>{body}</article>", f"<main>{body}<p>{LONG}</p></main>", f"<div class=story>{body}<p>{LONG}</p></div><footer>x</footer>"):
        lines = H.main_text(f"<body><nav><a href=/>Home</a></nav>{page}</body>").split("\n")
        assert [x for x in lines if x in kept] == kept and "Home" not in lines
    ends = H.main_text(f"<body><article><div>before</div><p>{LONG}</p><section><span>after</span></section></article><div>outside</div></body>")
    assert ends.split("\n")[0] == "before" and ends.split("\n")[-1] == "after"


def test_comment_words_inside_longer_names():
    for name in ("user-comments", "cookie-policy-text", "adbox", "post-comment-list-x", "leftnav", "topMenu"):
        text = H.main_text(f"<body><article><p>{LONG}</p><p>{LONG}</p><div class='{name}'><p>Beside it, one. And two, three.</p></div></article></body>")
        assert "Beside" not in text and text.startswith("This is")
    for name in ("no-comments", "post comments-open x", "entry has-comments", "article-with-comments"):
        assert "First" in H.main_text(f"<body><div class='{name}'><p>First {LONG}</p></div><p>x</p></body>")
    assert "First" in H.main_text(f"<body><div class='story-cookies-today'><p>First {LONG}</p></div><p>x</p></body>")  # most of the page


def test_deeply_nested_lists_take_linear_time():
    import time
    took = []
    for n in (4000, 16000):
        start = time.process_time()
        H.main_text("<ul><li><ul>" + "<div>" * n + "<li></li>" * n)
        took.append(time.process_time() - start)
    assert took[1] < 10 * took[0] + 0.2


def test_an_own_extraction_of_simple_pages():
    """Pages of known blocks: the texts of the content blocks in order, by a reading of its own."""
    import random
    import re
    rng = random.Random(12)
    for _ in range(60):
        blocks = [(rng.choice(["p", "div", "blockquote", "h2", "li", "section"]), rng.choice([LONG, "short", "two  words\n&amp; a mark"])) for _ in range(rng.randint(2, 9))]
        blocks[0] = ("p", LONG)
        inner = "".join(f"<{t}>{x}</{t}>" for t, x in blocks)
        junk = [f"<nav><ul><li><a href='/{i}'>menu {i}</a></li></ul></nav>" for i in range(2)] + ["<div class='sidebar'>side</div>", "<footer>foot</footer>"]
        page = f"<html><head><title>t</title></head><body>{junk[0]}<article>{inner}</article>{junk[2]}{junk[1]}{junk[3]}</body></html>"
        want = [" ".join(re.sub("&amp;", "&", x).split()) for _, x in blocks]
        assert H.main_text(page).split("\n") == want
