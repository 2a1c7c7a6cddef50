import html
import random
import re
import time

import pyarrow.parquet as pq
import pytest

from recordloom.llm import htmlwrap
from recordloom.llm.queries import op8_main_text


def truth(page):
    """Main text of the synthetic pages: headings and paragraphs of their one article."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = []
    for part in re.split(r"</?(?:h1|p)>", inside):
        words = " ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", part)).split())
        if words:
            blocks.append(words)
    return "\n\n".join(blocks)


def test_small_table(spark, small):
    pages = {r["page_id"]: r["html"] for r in pq.read_table(f"{small}/pages.parquet").to_pylist()}
    found = op8_main_text(spark, small).collect()
    assert len(found) == len(pages)
    assert all(r.text == truth(pages[r.page_id]) and r.n_chars == len(r.text) for r in found)


def site(k, style):
    """A page of a host in one of several styles, and its main text."""
    rnd = random.Random(f"{k}-{style}")
    words = lambda n: " ".join(rnd.choice("lorem ipsum dolor sit amet consetetur elitr sed diam nonumy eirmod tempor".split()) for _ in range(n))
    title, paragraphs = words(5), [words(rnd.randint(8, 60)) for _ in range(rnd.randint(2, 6))]
    body = "".join(f"<p>{p} &amp; {k}</p>\n" for p in paragraphs)
    text = "\n\n".join([title, *(f"{p} & {k}" for p in paragraphs)])
    comments = "".join(f"<div class='comment'><p>{words(20)}</p></div>" for _ in range(rnd.randint(0, 5)))
    menu = "<ul class='nav-menu'>" + "".join(f"<li><a href='/{i}'>{words(1)}</a></li>" for i in range(rnd.randint(3, 9))) + "</ul>"
    if style == "article":
        return f"<html><head><title>{title}</title></head><body><header>{menu}</header><article><h1>{title}</h1>{body}</article><aside>{words(30)}</aside><footer>{words(9)}</footer></body></html>", text
    if style == "main":
        return f"<body><nav>{menu}</nav><main><h1>{title}</h1>{body}<form><input><button>Send</button></form><section id='comments'><h2>Comments</h2>{comments}</section></main><footer>(c)</footer></body>", text
    if style == "divs":
        return (
            f"<body><div id='header'><a href='/'>Site</a></div>{menu}<div class='cookie-notice'>We use cookies {words(10)}</div><div id='content'><h1>{title}</h1>{body}</div>"
            f"<div id='sidebar'><p>{words(12)}</p></div><div class='comments'>{comments}</div><div id='footer'>{words(9)}</div><script>var x = '<p>no</p>';</script></body>"
        ), text
    return f"<body><table><tr><td class='sidebar'>{menu}</td><td class='body'><h1>{title}</h1>{body}</td></tr></table><div class='footer'>{words(6)}</div></body>", text


@pytest.mark.parametrize("style", ["article", "main", "divs", "table"])
def test_styles_of_hosts(spark, style):
    made = {k: site(k, style) for k in range(40)}
    rows = [(k, f"https://{style}.example.com/p/{k}", page) for k, (page, _) in made.items()]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "1 AS wrapper", "2 AS rule").repartition(5)
    found = {r.page_id: r.text for r in htmlwrap.main_text(df).collect()}
    wrong = [k for k, (_, text) in made.items() if found[k] != text]
    assert not wrong, (found[wrong[0]], made[wrong[0]])


def test_alignment_finds_optional_and_repeated_groups():
    a = htmlwrap.items_of(htmlwrap.parse("<h1>a</h1><p>x</p><ul><li>1</li><li>2</li></ul>"))
    b = htmlwrap.items_of(htmlwrap.parse("<h1>b</h1><p>x</p><div>ad</div><ul><li>1</li></ul>"))
    both = htmlwrap.align(a, b)
    modes = {x[0]: x[1] for x in both}
    assert modes == {"h1": htmlwrap.ONCE, "p": htmlwrap.ONCE, "div": htmlwrap.OPTIONAL, "ul": htmlwrap.ONCE}
    items = {x[0]: x[5] for x in both}
    assert items["ul"][0][:2] == ["li", htmlwrap.REPEATED]
    assert items["h1"][0][3] == 0 and items["p"][0][3] != 0  # a slot, and a constant text


def test_broken_pages_and_odd_rows(spark):
    rows = [
        (1, None, None), (2, "no url at all", ""), (3, "http://a.example/x", "<p>open <b>bold<p>next &lt;tag&gt; &#233; &nbsp; end"),
        (4, "http://a.example/y", "plain text only"), (5, "http://a.example/z", "<script>x"), (6, "http://a.example/q", "<!-- c --><div" + " x" * 50), (None, "http://a.example/q", "<p>p</p>"),
        (7, "http://a.example/deep", "<div>" * 500 + "deep" + "</div>" * 500), (7, "http://a.example/deep", "<div>" * 500 + "deep" + "</div>" * 500),
        (8, "http://b.example/long", "<article><p>" + "word " * 100_000 + "</p></article>"),
    ]
    found = {}
    for r in htmlwrap.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        found.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    assert sum(map(len, found.values())) == len(rows)
    assert found[1] == [""] and found[2] == [""] and found[5] == [""]
    assert found[3] == ["open bold\n\nnext <tag> é end"]
    assert found[7] == ["deep", "deep"]
    assert found[8] == [("word " * 100_000).strip()]


def texts_of(spark, pages):
    rows = [(k, f"https://one.example/{k}", page) for k, page in enumerate(pages)]
    return [r.text for r in sorted(htmlwrap.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect())]


@pytest.mark.parametrize("n", [4, 12])
def test_nothing_beside_the_largest_group_is_lost(spark, n):
    words = lambda k, m: " ".join(f"w{k * 7 % 31}x{i * k % 17}" for i in range(m))
    body = lambda k: f"<p>{words(k, 60)}</p><p>{words(k + 50, 40)}</p>"
    own = "<div class='top'><p>Welcome to this site</p></div>"
    posts = [f"<body>{own}<div class='post'><h1>Title {k}</h1><p>lead {k}</p><div class='entry'>{body(k)}</div></div></body>" for k in range(n)]
    text = [f"{words(k, 60)}\n\n{words(k + 50, 40)}" for k in range(n)]
    assert texts_of(spark, posts) == [f"Title {k}\n\nlead {k}\n\n{text[k]}" for k in range(n)]
    mains = [f"<body>{own}<main><h1>Title {k}</h1><div>{body(k)}</div></main></body>" for k in range(n)]
    assert texts_of(spark, mains) == [f"Title {k}\n\n{text[k]}" for k in range(n)]
    two = [f"<body>{own}<div class='left'><p>{words(k, 65)}</p></div><div class='right'><p>{words(k + 9, 35)}</p></div><div><p>Thanks to all</p></div></body>" for k in range(n)]
    assert texts_of(spark, two) == [f"{words(k, 65)}\n\n{words(k + 9, 35)}" for k in range(n)]
    heads = [f"<body><article><h1>Title {k}</h1><h2>Summary</h2><p>short {k}</p><h2>More</h2><div>{body(k)}</div></article></body>" for k in range(n)]
    assert texts_of(spark, heads) == [f"Title {k}\n\nSummary\n\nshort {k}\n\nMore\n\n{text[k]}" for k in range(n)]


def test_what_follows_or_is_boilerplate_below_deep_nesting(spark):
    def page(k, deep):
        inner = f"<p>deep {k}</p><nav><ul><li>menu {k}</li></ul></nav><header>head {k}</header><div>a {k}<div>b {k}</div>c {k}</div>"
        return f"<body><article><h1>Title {k}</h1>" + "<div>" * deep + inner + "</div>" * deep + f"<p>after {k}</p></article><div><p>outside {k}</p></div></body>"

    for deep in (3, 62, 75, 3000):
        expected = [f"Title {k}\n\ndeep {k}\n\na {k}\n\nb {k}\n\nc {k}\n\nafter {k}" for k in range(3)]
        assert texts_of(spark, [page(k, deep) for k in range(3)]) == expected, deep
    inline = ["<body><p>" + "<b>" * 3000 + f"in {k}" + "</b>" * 3000 + f" out {k}</p></body>" for k in range(3)]
    assert texts_of(spark, inline) == [f"in {k} out {k}" for k in range(3)]


def test_empty_table(spark):
    assert htmlwrap.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def hosts_of_mixed_styles():
    """Pages of two hosts with all styles, notices on some pages, a shared lead, repeated pages, and levels of many keys."""
    rnd, rows = random.Random(7), []
    for k in range(160):
        page, text = site(k, ["article", "main", "divs", "table"][k % 4])
        if k % 3 == 0:
            page = page.replace("</h1>", "</h1>\n<p>A lead that many pages share.</p>", 1)
            text = text.replace("\n\n", "\n\nA lead that many pages share.\n\n", 1)
        if k % 10 == 9:
            page = page.replace("<body>", f"<body><div class='notice'>{k}</div>" + "".join(f"<div class='{rnd.choice('abcdefgh') * rnd.randint(1, 9)}'></div>" for _ in range(80)), 1)
        rows += [(k, f"https://{'one' if k % 5 else 'two'}.example/{k}", page, text)] * (3 if k % 40 == 1 else 1)
    return rows


def test_neither_order_nor_partitions_change_a_wrapper(spark):
    rows = [r[:3] for r in hosts_of_mixed_styles()]
    seen = []
    for seed, parts in ((1, 1), (2, 3), (3, 7)):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).repartition(parts, "page_id")
        seen.append((sorted(htmlwrap.wrappers(df).collect()), sorted(htmlwrap.main_text(df).collect())))
    assert seen[0] == seen[1] == seen[2]
    assert [w.host for w in seen[0][0]] == ["one.example", "two.example"] and len(seen[0][1]) == len(rows)


def test_wrappers_of_small_hosts_equal_a_plain_fold(spark):
    """Hosts of up to FAN_IN skeletons: pages of one skeleton first, then the rest in the order of their wrappers."""
    pages = [(k, f"https://{style}.example/{k}", site(k, style)[0]) for style in ("article", "main", "divs", "table") for k in range(3)]
    expected = []
    for host in ("article", "divs", "main", "table"):
        kept = {}
        for _, url, page in pages:
            if url.startswith(f"https://{host}."):
                items = htmlwrap.items_of(htmlwrap.parse(page))
                keys = htmlwrap.skeleton_of(items)
                kept[keys] = htmlwrap.align(kept[keys], items) if keys in kept else items
        whole = None
        for items in sorted(kept.values(), key=htmlwrap.json.dumps):
            whole = items if whole is None else htmlwrap.align(whole, items)
        expected.append((f"{host}.example", htmlwrap.json.dumps(whole)))
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    assert sorted(map(tuple, htmlwrap.wrappers(df).collect())) == expected


def test_levels_of_thousands_of_siblings_and_keys_lose_nothing(spark):
    letters = lambda n: "".join(chr(97 + int(d)) for d in str(n))
    def page(k, named):
        blocks = "".join(f"<div class='{named(k, i)}'><p>block {k} {i}</p></div><section>part {k} {i}</section>" for i in range(1500))
        return f"<body><div class='nav'>menu {k}</div><div class='page'><h1>Title {k}</h1>{blocks}</div></body>"

    text = ["\n\n".join([f"Title {k}", *(f"block {k} {i}\n\npart {k} {i}" for i in range(1500))]) for k in range(4)]
    for named in (lambda k, i: "same", lambda k, i: "x" + letters(i), lambda k, i: f"one two three four five {letters(k * 1500 + i)}"):
        assert texts_of(spark, [page(k, named) for k in range(4)]) == text
    tops = [f"<body><div class='nav'>menu {k}</div>" + "".join(f"<div class='y{letters(k * 1500 + i)}'>block {k} {i}</div>" for i in range(1500)) + "</body>" for k in range(4)]
    assert texts_of(spark, tops) == ["\n\n".join(f"block {k} {i}" for i in range(1500)) for k in range(4)]


def test_long_groups_repeat_and_hidden_groups_stay_out(spark):
    group = lambda k, i: "".join(f"<{t}>{t} {k} {i}</{t}>" for t in ("h3", "p", "ul", "p", "table", "blockquote", "pre"))
    items = htmlwrap.items_of(htmlwrap.parse("".join(group(0, i) for i in range(9))))
    assert [x[0] for x in items] == ["h3", "p", "ul", "p", "table", "blockquote", "pre"] and all(x[1] == htmlwrap.REPEATED for x in items)
    pages = [f"<body><div class='post' hidden>old {k}</div><div class='post'><h1>Title {k}</h1><p>text {k}</p></div></body>" for k in range(3)]
    assert texts_of(spark, pages) == [f"Title {k}\n\ntext {k}" for k in range(3)]


NAMES = [
    ("<body class='no-sidebar'>{m}<article><h1>{t}</h1>{b}</article></body>", ()),
    ("<body>{m}<article class='post comments-open'><h1>{t}</h1>{b}</article></body>", ()),
    ("<body>{m}<main class='layout-with-sidebar'><h1>{t}</h1>{b}</main></body>", ()),
    ("<body>{m}<article><h1>{t}</h1>{b}<p id='related-work'>earlier {k}</p></article></body>", ("earlier {k}",)),
    ("<body>{m}<article><h1>{t}</h1>{b}<section id='discussion'><h2>Discussion</h2><p>we discuss {k}</p></section></article></body>", ("Discussion", "we discuss {k}")),
    ("<body>{m}<article><h1>{t}</h1>{b}<section id='search-engines'><p>they search {k}</p></section></article></body>", ("they search {k}",)),
    ("<body><form id='aspnetForm' method='post'>{m}<article><h1>{t}</h1>{b}</article><input type='hidden' value='x'></form></body>", ()),
    ("<body><form id='form1'>{m}<div class='page'><h1>{t}</h1>{b}</div></form></body>", ()),
    ("<body class='home has-nav menu-open'><div class='sidebar-right columns'>{m}<div class='entry'><h1>{t}</h1>{b}</div><div class='sidebar'><p>side {k}</p></div></div></body>", ()),
    ("<body class='single-post'>{m}<article><h1>{t}</h1>{b}<div class='cookie-banner'>eat {k}</div><div class='share-buttons'><a href='x'>share {k}</a></div></article></body>", ()),
    ("<body>{m}<article><h1>{t}</h1>{b}<h2 id='cookie-recipes'>Cookies</h2><p>bake {k}</p></article></body>", ("Cookies", "bake {k}")),
    ("<body>{m}<article><h1>{t}</h1>{b}<ul class='related-posts'><li><a href='y'>other {k}</a></li></ul></article><div id='comments'><p>I say {k}</p></div></body>", ()),
    ("<body>{m}<div class='wrap widget-free'><article itemprop='x'><h1>{t}</h1>{b}</article></div><div class='site-footer'>foot {k}</div></body>", ()),
    ("<html class='no-js menu'><body role='menu' style='display: none'>{m}<main><h1>{t}</h1>{b}</main></body></html>", ()),
]


def named(k, style):
    rnd = random.Random(f"{k}/{style}")
    words = lambda n: " ".join(rnd.choice("lorem ipsum dolor sit amet elitr sed diam nonumy eirmod tempor".split()) for _ in range(n))
    title, paragraphs = words(4) + f" {k}", [words(rnd.randint(12, 50)) for _ in range(rnd.randint(2, 5))]
    page, more = NAMES[style]
    menu = "<nav><ul>" + "".join(f"<li><a href='/{i}'>{words(1)}</a></li>" for i in range(4)) + "</ul></nav>"
    made = page.format(m=menu, t=title, b="".join(f"<p>{p}</p>" for p in paragraphs), k=k)
    return made, "\n\n".join([title, *paragraphs, *(x.format(k=k) for x in more)])


def test_ordinary_names_do_not_remove_articles(spark):
    made = {(k, s): named(k, s) for s in range(len(NAMES)) for k in range(6)}
    rows = [(s * 100 + k, f"https://s{s}.example/{k}", page) for (k, s), (page, _) in made.items()]
    found = {r.page_id: r.text for r in htmlwrap.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert {(k, s): found[s * 100 + k] for k, s in made} == {x: text for x, (_, text) in made.items()}
    alone = {(k, s): htmlwrap.extract(page, None) for (k, s), (page, _) in made.items() if k == 0}
    assert alone == {x: made[x][1] for x in alone}


@pytest.mark.parametrize("piece", ["<a ", "<a x='\"", "<!-", "</script", "<script><p ", "<p class=\"a ", "<b>'<i \"", "</", "<div x=\"'<a y='\""])
def test_broken_pages_take_time_in_proportion(piece):
    start = time.monotonic()
    text = htmlwrap.extract("<article><p>before</p></article>" + piece * (1_000_000 // len(piece)), None)
    assert time.monotonic() - start < 15 and text.startswith("before")
    start = time.monotonic()
    htmlwrap.extract("<p>x</p>" + piece * (1_000_000 // len(piece)) + "'\">", None)
    assert time.monotonic() - start < 15


def test_unfinished_tags_end_at_the_next_one():
    assert htmlwrap.extract("<article><p>one <b two</p><p title=\"it's\">three</p><p class='a>b'>four</p></article>", None) == "one\n\nthree\n\nfour"
