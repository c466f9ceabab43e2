import itertools
import random

from pyspark.sql import functions as F

from tessera.llm import html_main as H

W = H.weights([])


def sums(xs):
    best = max((sum(xs[i:j]), 0) for i, j in itertools.combinations(range(len(xs) + 1), 2))[0] if xs else 0
    return max(0, best)


def test_best_region():
    rng = random.Random(1)
    for _ in range(300):
        xs = [rng.randint(-5, 5) for _ in range(rng.randint(0, 12))]
        i, j = H.best_region(xs)
        assert sum(xs[i:j]) == sums(xs)


PARAGRAPH = "These are quite a few plain words of the article, enough of them to count."


def test_templates():
    body = f"<h1>A title</h1><p>{PARAGRAPH} &amp; more&nbsp;of <a href=x>a link</a>.</p><p>{PARAGRAPH}</p>"
    want = f"A title\n{PARAGRAPH} & more of a link.\n{PARAGRAPH}"
    menu = "<nav><ul>" + "<li><a href='/a'>Menu item</a></li>" * 8 + "</ul></nav>"
    foot = "<footer>&copy; 2020 some site <a href=/>home</a></footer>"
    for page in (
        f"<html><head><title>T</title><style>p{{x:1}}</style><script>var a='</p>';</script></head><body>{menu}<article>{body}</article>{foot}</body></html>",
        f"<body>{menu}<main>{body}</main>{foot}",
        f"<body><header><h2>Site name and slogan</h2></header>{menu}<div class='content'>{body}</div><aside>See also this and that</aside>{foot}</body>",
        f"<body><div id='top-menu'><a href=1>One</a> <a href=2>Two</a></div><div>{body}</div><div class='comments'><p>I liked this article so very much indeed</p></div></body>",
        f"<body><div class='cookie-notice'>We use cookies, do you agree with them?</div><article>{body}<form><label>Mail</label><input name=m><button>Send</button></form></article></body>",
        f"<body class='has-sidebar'><table><tr><td><a href=1>Home</a><a href=2>News</a><td>{body}</table></body>",
    ):
        assert H.main_text(page, W) == want, page


def test_a_marked_article_keeps_head_and_tail():
    share = "<div class='share'>" + "<a href=x>Share this with friends</a> now and again " * 4 + "</div>"
    aside = "<aside><h3>More</h3><p>" + "An aside that is longer than the paragraph after it. " * 9 + "</p></aside>"
    deep = "<div><div><section>{}</section></div></div>"
    for learned in (W, H.weights([f"<nav><a href=x>Menu</a></nav><article>{share}<p>{PARAGRAPH}</p></article>"] * 50)):
        for inner, want in (
            (f"<h1>Five words of a title</h1>{share}<p>{PARAGRAPH}</p>", f"Five words of a title\n{PARAGRAPH}"),
            (f"<h1>A title</h1><p>{PARAGRAPH}</p>{aside}<p>The last words.</p>", f"A title\n{PARAGRAPH}\nThe last words."),
            (f"<h1>A title</h1>{share}<p>{PARAGRAPH}</p>{aside}{share}<p>End.</p>{share}", f"A title\n{PARAGRAPH}\nEnd."),
            (f"{deep.format('<h1>Title</h1>')}<div><div>{deep.format(f'<p>{PARAGRAPH}</p>')}</div></div>{deep.format('<p>End.</p>')}", f"Title\n{PARAGRAPH}\nEnd."),
        ):
            for mark in ("article", "main"):
                page = f"<body><nav><a href=1>One</a></nav>{share}<{mark}>{inner}</{mark}>{aside}<footer>Some site</footer></body>"
                assert H.main_text(page, learned) == want, page


def test_wrappers_with_an_outside_name_keep_their_content():
    body = f"<h1>A title</h1><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p>"
    want = f"A title\n{PARAGRAPH}\n{PARAGRAPH}"
    menu = "<nav>" + "<a href=1>Menu item</a> " * 9 + "</nav>"
    comments = "<div class='comments'><ul>" + f"<li class='comment'><article class='comment-body'><p>{PARAGRAPH[:40]}</p></article></li>" * 9 + "</ul></div>"
    side = "<div class='sidebar'><div class='widget'>Some words about this very site</div></div>"
    wrappers = ["div class='content-sidebar-wrap'", "div class='elementor-widget'", "div class='comments-open'", "form id='aspnetForm'", "div class='sidebar'", "div id='menu-wrapper'", "header", "div class='page-header'", "section role='form'"]
    for one in wrappers:
        for two in (None, *wrappers[:5]):
            head = f"<{one}>" + (f"<{two}>" if two else "")
            tail = (f"</{two.split()[0]}>" if two else "") + f"</{one.split()[0]}>"
            for content in (f"<article>{body}</article>", f"<main>{body}</main>", f"<div>{body}</div>"):
                assert H.main_text(f"<body>{menu}{head}{content}{side}{tail}<footer>Some site</footer></body>", W) == want, (one, two, content)
                assert H.main_text(f"<body>{menu}{head}{content}{tail}{side}<footer>Some site</footer></body>", W) == want, (one, two, content)
            assert H.main_text(f"<body>{menu}{head}<article>{body}</article>{comments}{tail}</body>", W) == want, (one, two)
            assert H.main_text(f"<body>{menu}{head}<article>{body}</article>{tail}{comments}</body>", W) == want, (one, two)
    # each block in a wrapper of its own
    blocks = [f"<div class='elementor-widget elementor-widget-text-editor'>{x}</div>" for x in ("<h1>A title</h1>", *[f"<p>{PARAGRAPH}</p>"] * 2)]
    for mark in ("article", "main"):
        assert H.main_text(f"<{mark}>{''.join(blocks)}</{mark}>{side}", W) == want
    assert H.main_text(f"{menu}<div>{blocks[1]}{blocks[2]}</div>{side}", W) == f"{PARAGRAPH}\n{PARAGRAPH}"
    # names of elements that are no content
    for name in ("site-footer", "main-nav", "cookie-notice", "post-comments", "related-posts", "ad-slot-1", "share-buttons", "social-share", "site-header"):
        assert H.main_text(f"<div>{body}</div><div class='{name}'>{PARAGRAPH[:30]}</div>", W) == want, name
    assert H.main_text(f"<nav>{PARAGRAPH}</nav>", W) == ""


def test_broken_markup():
    assert H.main_text(f"<article><p><b>{PARAGRAPH}<br><p>{PARAGRAPH}</p></article><footer>x y z", W) == f"{PARAGRAPH}\n{PARAGRAPH}"
    assert H.main_text(f"<article><p>{PARAGRAPH}<foo", W) == PARAGRAPH
    assert H.main_text(f"<p>{PARAGRAPH} a < b and 3 > 2 <!-- <p>no</p>", W) == f"{PARAGRAPH} a < b and 3 > 2"
    assert H.main_text(f"<p>{PARAGRAPH} &lt;b&gt; &#233;&#xe9; &am</p>", W) == f"{PARAGRAPH} <b> éé &am"
    assert H.main_text(None, W) == H.main_text("", W) == H.main_text("<div></div>", W) == ""
    assert H.main_text("<nav>a b c</nav>", W) == ""
    assert H.main_text("word " * 200_000, W) == ("word " * 200_000).strip()
    assert H.main_text("< " * 5000 + PARAGRAPH, W).endswith(PARAGRAPH)
    assert H.main_text("<a b='" * 3000, W) is not None


def truth(page):
    """The article element of this template, block by block."""
    import html
    import re

    inner = re.sub(r"</article.*", "", page.split("<article>", 1)[1], flags=re.S) if "<article>" in page else ""
    inner = re.sub(r"<[^>]*\Z", "", inner)
    parts = [re.sub(r"<[^>]*>", " ", x) for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)


def test_generated_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    raw = {r.page_id: r for r in pages.collect()}
    for r in H.extract(pages).collect():
        assert r.text == truth(raw[r.page_id].html), r.page_id
        assert r.n_chars == len(r.text) and r.url == raw[r.page_id].url
    # without its marks of content
    bare = {i: r.html.replace("<article>", "<div>").replace("</article>", "</div>") for i, r in raw.items()}
    w = H.weights([r.html for r in list(raw.values())[:100]])
    assert sum(H.main_text(bare[i], w) == truth(raw[i].html) for i in raw) > 0.97 * len(raw)


def test_awkward_rows(spark):
    rows = [(1, None, None, "x"), (2, "u", "", "y"), (None, "v", f"<p>{PARAGRAPH}", None), (3, "u", f"<p>{PARAGRAPH}", "z"), (3, "u", f"<p>{PARAGRAPH}", "z")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, H.extract(docs).collect()), key=str)
    assert got == sorted([(1, None, "", 0), (2, "u", "", 0), (None, "v", PARAGRAPH, len(PARAGRAPH))] + [(3, "u", PARAGRAPH, len(PARAGRAPH))] * 2, key=str)
    assert H.extract(docs.limit(0)).count() == 0


def test_sample_of_distinct_marked_pages(spark, monkeypatch):
    monkeypatch.setattr(H, "weights", lambda pages: pages)
    page = lambda i, mark: (i, f"u{i}", f"<{mark}><p>{PARAGRAPH} {i}</p></{mark}>")
    schema = "page_id long, url string, html string"
    rare = [page(i, "article" if i % 100 == 0 else "div") for i in range(6000)]
    assert sorted(H.learn(spark.createDataFrame(rare, schema))) == sorted(h for i, _, h in rare if i % 100 == 0)
    copies = [page(1, "main")] * 3000 + [page(i, "article") for i in range(1, 900)]
    for sample in (500, 2000):
        got = H.learn(spark.createDataFrame(copies, schema), sample)
        assert len(got) == len(set(got)) == min(sample, 900)
    assert H.learn(spark.createDataFrame(copies * 2, schema)) == H.learn(spark.createDataFrame(copies, schema))


def test_several_articles_are_kept():
    links = "".join(f"<li><a href='/{i}'>two words</a></li>" for i in range(30))
    page = f"<body><article><p>{'first ' * 20}</p></article><ul>{links}</ul><article><p>{'second ' * 15}</p></article></body>"
    for w in (H.weights([]), H.weights([page])):
        assert H.main_text(page, w) == ("first " * 20).strip() + "\n" + ("second " * 15).strip()


def test_a_list_of_links_inside_the_text_of_an_unmarked_page():
    links = "".join(f"<li><a href='/{i}'>two words</a></li>" for i in range(12))
    before, after = "before " * 60, "after " * 40
    page = f"<body><div><p>{before}</p><ul>{links}</ul><p>{after}</p></div></body>"
    text = H.main_text(page, H.weights([]))
    assert text.startswith("before") and text.endswith("after")


def test_the_scan_finds_the_content_without_marks(spark):
    """Pages of which the marks were taken off, through the operator's own path."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    bare = pages.withColumn("html", F.regexp_replace("html", "(?i)(</?)(article|main)\\b", "$1div"))
    want = {r.page_id: r.text for r in H.extract(pages).collect()}
    got = {r.page_id: r.text for r in H.extract(bare).collect()}
    assert sum(got[i] == t for i, t in want.items()) > 0.97 * len(want)


def test_long_and_deep_pages():
    deep = "<div>" * 20_000 + "<p>" + "word " * 200 + "</p>" + "</div>" * 20_000
    long = "<body>" + "<p>some words of a paragraph</p>" * 40_000 + "</body>"
    w = H.weights([])
    assert H.main_text(deep, w) == ("word " * 200).strip()
    assert H.main_text(long, w).count("\n") == 39_999


def test_maximal_subsequences():
    def recursive(xs, at=0):
        i, j = max(((i, j) for i in range(len(xs)) for j in range(i + 1, len(xs) + 1)), key=lambda r: (sum(xs[r[0] : r[1]]), -r[0], r[0] - r[1]), default=(0, 0))
        if i == j or sum(xs[i:j]) <= 0:
            return []
        return recursive(xs[:i], at) + [(at + i, at + j, sum(xs[i:j]))] + recursive(xs[j:], at + j)

    rng = random.Random(5)
    for _ in range(300):
        xs = [rng.choice([-7, -5, -3, -2, 1, 2, 3, 5, 11]) + rng.random() / 64 for _ in range(rng.randint(0, 14))]
        got = H.maximal(xs)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in recursive(xs)]


def test_comments_are_no_content_however_long():
    text, readers = "plain words " * 30, "what a reader says " * 22
    for mark in ("section id='comments'", "div class='comment-list'", "article class='comment'", "div class='comments'><article"):
        page = f"<body><div><p>{text}</p></div><{mark}><p>{readers}</p></{mark.split()[0]}></body>"
        assert H.main_text(page, W) == text.strip(), mark
    page = f"<body><article><p>One</p></article><article class='comment'><p>{readers}</p></article></body>"
    assert "reader" not in H.main_text(page, W)


def test_title_and_parts_beside_links():
    links = lambda n: "".join(f"<li><a href='/{i}'>linked words</a></li>" for i in range(n))
    page = f"<body><div><h1>A title</h1><a href=1>tag one</a> <a href=2>tag two</a> <a href=3>tag three</a><p>{'body ' * 60}</p></div></body>"
    text = H.main_text(page, W)
    assert text.startswith("A title\n") and text.endswith("body")
    page = f"<body><div><p>{'first ' * 60}</p><ul>{links(30)}</ul><p>{'second ' * 60}</p></div></body>"
    text = H.main_text(page, W)
    assert text.startswith("first") and text.endswith("second")
    page = f"<body><div><h2>Site name</h2><ul>{links(30)}</ul></div><div><p>{'body ' * 60}</p></div></body>"
    assert H.main_text(page, W) == ("body " * 60).strip()


def test_a_mark_of_little_does_not_decide():
    page = f"<body><article><p>Teaser words</p></article><div><p>{'body ' * 90}</p></div></body>"
    assert "body" in H.main_text(page, W)


def test_many_marked_parts_in_linear_time():
    import time

    part = "<article><p>some marked words</p></article><ul>" + "<li><a href=x>go there</a></li>" * 3 + "</ul>"
    began = time.process_time()
    assert H.main_text(part * 4000, W).count("some marked words") == 4000
    assert time.process_time() - began < 6  # about one second on an idle machine
