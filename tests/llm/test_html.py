import html as escapes
import random
import re

import pytest

from provenant.llm import html as wrapping
from provenant.llm.html import Page, align, content_slots, expression, extract, fold, infer, lifted, op3_html


def page(body, title="t"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body class='has-sidebar'>{body}</body></html>"


def test_fold_repeats():
    assert fold(list("abababc")) == [("+", ("a", "b")), "c"]
    assert fold(["p", "#", "/p"] * 5) == [("+", ("p", "#", "/p"))]
    assert fold(list("aaa")) == [("+", ("a",))]


def test_alignment_gives_optional_and_repeated_groups():
    pages = [page("<h1>a</h1><p>x</p>"), page("<h1>b</h1><p>x</p><p>y</p><p>z</p>"), page("<h1>c</h1><hr><p>x</p><p>q</p>")]
    wrapper = infer([Page(p).items for p in pages])
    assert expression(wrapper) == "html !head /head body.has.sidebar h1 # /h1 [hr] (p # /p)+ /body /html"
    again = align(wrapper, wrapper)
    assert [(x, o) for x, o, _ in again] == [(x, o) for x, o, _ in wrapper]


def test_content_without_article_is_the_container_with_most_text():
    body = '<div class="top"><a href="/">home</a></div><div id="post"><p>long text here</p><ul><li>and more</li></ul></div><div class="sidebar">ads ads ads ads ads ads ads</div>'
    one = Page(page(body))
    content = content_slots(lifted(one.items, one.statistics()))
    assert [p for p, good in zip(one.paths, content) if good] == ["/html/body.has.sidebar/div.post", "/html/body.has.sidebar/div.post/ul"]


CASES = {
    "menus": ("<nav><a>x</a></nav><article><h1>T</h1><p>a &amp; b</p></article><footer>f</footer>", "T a & b"),
    "inline": ("<article><p>fo<b>o</b> \n\t bar<br>baz<p>next</article>", "foo bar baz next"),
    "script": ('<article><script>var t="</p><p>no"</script><p>a &lt; b</p><style>x</style><!-- no <p>no</p> --></article>', "a < b"),
    "comments": ('<article><p>yes</p><section class="comments"><p>no</p></section><form>no</form><aside>no</aside></article>', "yes"),
    "unclosed": ("<article><p>one<b>two</article><footer>no", "onetwo"),
    "stray": ("</div><article></p><p>one</div> two</p></article>", "one two"),
    "empty": ("<nav>only menu</nav>", ""),
    "page classes": ('<main class="with-sidebar"><p>kept</p><article class="comment">no</article></main>', "kept"),
    "less": ("<article><p>1 < 2 &notanentity; &#233;&nbsp;x</p></article>", "1 < 2 ¬anentity; é x"),
}


def test_pages(spark):
    rows = [(k, f"https://h{k % 2}.example.org/{k}", page(b)) for k, (b, _) in enumerate(CASES.values())]
    rows += [(100, None, None), (101, "not a url", ""), (102, rows[0][1], rows[0][2]), (102, rows[0][1], rows[0][2]), (None, None, rows[1][2])]
    long_page = page("<article>" + "<p>word</p>" * 20000 + "</article>")
    rows.append((103, "http://big.example.org", long_page))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' as host", "1 as rule")
    got = extract(df).collect()
    assert len(got) == len(rows)
    by = {g.page_id: g for g in got}
    for k, (name, (_, text)) in enumerate(CASES.items()):
        assert by[k].text == text, name
        assert by[k].n_chars == len(text)
    assert by[100].text == by[101].text == "" and by[102].text == "T a & b" and by[None].text == "foo bar baz next"
    assert by[103].text == " ".join(["word"] * 20000)


def test_random_pages_equal_a_plain_reading(spark):
    r = random.Random(4)
    words = ["a", "bé", "c&d", "<e", "f>", "gg."]
    rows, want = [], {}
    for k in range(80):
        paras = [" ".join(r.choices(words, k=r.randint(1, 9))) for _ in range(r.randint(0, 6))]
        body = "".join(f"<p>{escapes.escape(p)}</p>" if r.random() < 0.7 else f"<div><p><b>{escapes.escape(p)}</b><br></div>" for p in paras)
        menu = "".join(f"<li><a href='#'>m{i}</a></li>" for i in range(r.randint(1, 5)))
        rows.append((k, f"http://site{k % 3}.org/", page(f"<header><ul>{menu}</ul></header><article class='a'>{body}</article><div class='cookie-notice'>ok</div>")))
        want[k] = re.sub(r"\s+", " ", " ".join(paras))
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {g.page_id: g.text for g in got} == want


def test_empty_table(spark):
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_of_a_smaller_template_keep_their_text(spark):
    story = "Some words of a story that stands in a plain container. " * 3
    main = [(k, "http://a.org/x", f"<body><article><p>{story}{k}</p></article></body>") for k in range(5)]
    plain = [(10, "http://a.org/y", f"<body><nav>Menu</nav><div class='story'><p>{story}</p></div></body>")]
    post = [(20 + k, "http://b.org/x", f"<body><div class='post'><p>{story}{k}</p></div></body>") for k in range(5)]
    other = [(30, "http://b.org/y", f"<body><div class='story'><p>{story}</p></div></body>")]
    lost = [(40, None, f"<body><article><p>{story}</p></article></body>"), (41, None, f"<body><div><p>{story}</p></div></body>")]
    rows = [*main, *plain, *post, *other, *lost, (50, "http://a.org/z", "<body><nav>Menu only</nav></body>")]
    got = {g.page_id: g.text for g in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[10] == got[30] == got[40] == got[41] == story.strip()
    assert got[50] == "" and got[3] == f"{story}3" and got[24] == f"{story}4"


def plain_pages(n=12, seed=3):
    """No <article>, no telling names: a box of links, a line that is the same on all pages, and the text."""
    r = random.Random(seed)
    line = lambda k: " ".join("".join(r.choices("abcdefg", k=r.randint(2, 8))) for _ in range(k))
    rows, want = [], {}
    for k in range(n):
        paras = [line(r.randint(8, 40)) for _ in range(r.randint(1, 4))]
        links = "".join(f"<li><a href='#'>{line(1)}</a></li>" for _ in range(r.randint(2, 5)))
        extra = f"<div class='qb'>{line(3)}</div>" if k % 3 == 0 else ""
        text = "".join(f"<p>{p}</p>" for p in paras)
        rows.append((k, "http://plain.org/a", f"<body><div class='qa'><ul>{links}</ul></div>{extra}<div class='qc'><p>All rights and wrongs of this site are kept by us and by nobody else at all, for ever</p>{text}<div class='qd'>same on all</div></div></body>"))
        want[k] = " ".join(paras)
    return rows, want


def test_names_that_tell_nothing(spark):
    rows, want = plain_pages()
    got = {g.page_id: g.text for g in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # the line that is the same on all pages is in one repeated group with the text, so nothing tells it from a paragraph
    assert {k: t.removeprefix("All rights and wrongs of this site are kept by us and by nobody else at all, for ever ") for k, t in got.items()} == want


def test_template_text_inside_the_region_is_left_out(spark):
    rows = [(k, "http://t.org/", f"<body><article><h1>Title {k}</h1><h4>Share this with your friends</h4><p>Text number {k} is here, and it is long enough.</p></article></body>") for k in range(8)]
    got = {g.page_id: g.text for g in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Title {k} Text number {k} is here, and it is long enough." for k in range(8)}
    same = [(k, "http://s.org/", rows[0][2]) for k in range(8)]
    got = {g.text for g in extract(spark.createDataFrame(same, "page_id long, url string, html string")).collect()}
    assert got == {"Title 0 Share this with your friends Text number 0 is here, and it is long enough."}


def test_the_wrapper_makes_the_text(spark, monkeypatch):
    """Another alignment gives other texts."""
    rows = [(k, "http://t.org/", f"<body><article><h1>T {k}</h1><h4>Same for all</h4>{'<hr>' * (k % 2)}<p>Text of page {k} here.</p></article></body>") for k in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = wrapping.wrappers(df.withColumn("host", wrapping.host_of())).collect()
    assert len(found) == 1 and found[0].n_pages == 12
    wrapper = wrapping._as_items(wrapping.json.loads(found[0].wrapper))
    assert "[hr]" in expression(wrapper)
    reader = lambda w: [wrapping.Reader().text("t.org", wrapping.json.dumps(w), r[2]) for r in rows]
    assert reader(wrapper) == [f"T {k} Text of page {k} here." for k in range(12)]
    junk = wrapper[:3]
    assert all(a != b for a, b in zip(reader(wrapper), reader(junk)))


@pytest.mark.parametrize("sent", [wrapping.SENT_TO_ALL, 0])
def test_trees_of_wrappers(spark, monkeypatch, sent):
    monkeypatch.setattr(wrapping, "SENT_TO_ALL", sent)
    monkeypatch.setattr(wrapping, "FAN_IN", 2)
    r = random.Random(8)
    rows, want = [], {}
    for k in range(40):
        parts = [f"<{t}>{t} {k} {i}</{t}>" for i, t in enumerate(r.choices(["p", "h2", "li", "blockquote"], k=r.randint(1, 6)))]
        rows.append((k, f"http://h{k % 2}.org/", f"<nav><a>menu</a></nav><main>{''.join(parts)}</main>"))
        want[k] = re.sub("<[^>]*>", " ", " ".join(parts)).split()
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {g.page_id: g.text.split() for g in got} == want


def test_query_and_clashing_columns(spark, tmp_path):
    rows, _ = plain_pages(3)
    rows += [rows[0], (None, None, None)]
    spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, wrapper string, copy int").write.parquet(str(tmp_path / "pages.parquet"))
    got = op3_html(spark, str(tmp_path)).collect()
    assert len(got) == 5 and all(g.n_chars == len(g.text) for g in got) and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
