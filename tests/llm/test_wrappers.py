from workfeed.llm import wrappers as w

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<div class="sidebar-left"><p>Side</p></div><div id="post">{body}<div class="share">Share this story</div></div><section class="comments"><p>{comment}</p></section><footer>&copy; host</footer></body></html>"""


def host_of(pages):
    host = w.wrapper_of(w.nested(pages[0]))
    for p in pages[1:]:
        host = w.merged(host, w.wrapper_of(w.nested(p)))
    return host


def pages(n):
    return [(i, f"http://h.example/{i}", PAGE.format(body=f"<h2>Head {i}</h2>" + "".join(f"<p>Paragraph {i}-{j} of   text&nbsp;&amp; more<br>here</p>" for j in range(1 + i % 3)), comment=f"reader {i} says so")) for i in range(n)]


def test_main_text_by_the_host_wrapper(spark):
    df = spark.createDataFrame(pages(8), "page_id long, url string, html string")
    for limit in (8 << 20, 0):  # broadcast and joined
        got = {r.page_id: r.text for r in w.extract(df, broadcast_bytes=limit).collect()}
        assert got == {i: "\n".join([f"Head {i}"] + [f"Paragraph {i}-{j} of text & more here" for j in range(1 + i % 3)]) for i in range(8)}


def test_alignment_resolves_mismatches():
    one = w.wrapper_of(w.nested("<ul><li>a</li><li>b</li></ul><p>x</p>"))
    two = w.wrapper_of(w.nested("<ul><li>c</li></ul><div>new</div><p>x</p>"))
    assert w.expression(w.merged(one, two)) == "<ul> (<li> #TEXT </li>)+ </ul> (<div> 'new' </div>)? <p> 'x' </p>"


def test_article_malformed_and_empty_pages(spark):
    html = "<body><header>Top</header><article><h1>Big</h1><p><b>One<br><p>Two<form><p>no</p></form></article><p>out"
    assert w.main_text(html) == "Big\nOne\nTwo"
    rows = [(1, None, html, "x"), (2, "nohost", None, "x"), (3, "http://e.example", "", "x"), (3, "http://e.example", "<<>&lt;p", "x"), (4, "http://e.example", "<p>" + "w " * 50_000, "x")]
    got = w.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "html", "text"]
    texts = sorted((r.page_id, r.text) for r in got.collect())
    assert texts[0] == (1, "Big\nOne\nTwo") and texts[1] == (2, "") and texts[2] == (3, "") and len(texts[4][1]) == 99_999
    assert w.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_texts_that_begin_alike_and_headings_stay(spark):
    start = "The same opening words of every report on this host, far beyond eighty characters in length, "
    page = "<body><div>Site</div><article><div class='lead'>{s}{i}</div><h2>Summary</h2><ul><li>Item</li></ul><p>Text {i} <b>{s}{i}</b></p><div class='stamp'>Printed by host</div></article></body>"
    for n in (2, 4, 5, 12):
        rows = [(i, f"http://h.example/{i}", page.format(s=start, i=i)) for i in range(n)]
        got = {r.page_id: r.text for r in w.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert got == {i: f"{start}{i}\nSummary\nItem\nText {i} {start}{i}" for i in range(n)}


def test_a_constant_of_few_of_many_pages_stays():
    pages = [f"<article><p>Text {i}</p>{'<section>Rare</section>' if i < 6 else ''}</article>" for i in range(60)]
    assert w.main_text(pages[0], w.decided(host_of(pages))) == "Text 0\nRare"


def test_usual_class_names_do_not_cut_the_page():
    for page in (
        '<body class="has-sidebar"><div id="content" class="no-sidebar"><p>Text here</p></div></body>',
        '<body class="home widget"><article class="post comments-open"><p>Text here</p></article><div class="sidebar-left"><p>x</p></div></body>',
        '<body><div class="banner"><main class="widget"><p>Text here</p></main></div></body>',
        '<body><article><p>Text here</p><div class="share-buttons">Share</div><article class="comment"><p>Mine</p></article></article></body>',
    ):
        assert w.main_text(page) == "Text here"


def test_groups_of_several_items():
    group = "<dl> (<dt> #TEXT </dt> <dd> #TEXT </dd>)+ </dl>"
    two, one = w.wrapper_of(w.nested("<dl><dt>a<dd>b<dt>c<dd>d</dl>")), w.wrapper_of(w.nested("<dl><dt>e<dd>f</dl>"))
    assert w.expression(two) == w.expression(w.merged(two, one)) == w.expression(w.merged(one, two)) == group


LEGAL = "All rights belong to the house. " * 40


def boxes(i):
    notice = "<div>Today only: offer</div>" if i % 3 == 0 else ""
    return (
        f"<body><div><ul><li><a href=/>Home</a></li><li><a href='/x'>X</a></li></ul></div>{notice}<div><h1>Head {i}</h1><p>First {i * i}</p><p>Second {i}</p>"
        f"<ul><li>Item</li></ul></div><div><p>{LEGAL}</p></div></body>"
    )


def test_unnamed_boxes_are_told_apart_by_the_host(spark):
    rows = [(i, f"http://box.example/{i}", boxes(i), "h", "d") for i in range(9)]
    found = w.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string, decision string"))
    assert found.columns == ["page_id", "url", "html", "host", "decision", "text"]
    assert {r.page_id: r.text for r in found.collect()} == {i: f"Head {i}\nFirst {i * i}\nSecond {i}\nItem" for i in range(9)}
    # The page alone cannot know what its host repeats.
    assert LEGAL.strip() in w.main_text(boxes(1))


def test_names_of_single_pages_do_not_widen_the_wrapper():
    def page(i):
        return (
            f"<body class='p-{i} has-sidebar'><div id='post-{i}' class='post cat-{chr(97 + i % 26) * 3}'><div class='article-header'><h1>T {i}</h1></div>"
            f"<div class=part><p>alpha {i}</p></div><div class=part><h2>Sum</h2><p>beta {i} y</p><figure><img><figcaption>Cap {i}</figcaption></figure></div>"
            f"<section class=comments><p>{'reader says a lot ' * 30}{i}</p></section></div><div class=sidebar><p>side {i}</p></div></body>"
        )

    few, many = host_of([page(i) for i in range(30)]), host_of([page(i) for i in range(300)])
    assert len(w.expression(many)) == len(w.expression(few))
    assert w.main_text(page(77), w.decided(many)) == "T 77\nalpha 77\nSum\nbeta 77 y\nCap 77"


def test_streams_without_order_stay_bounded():
    def page(i):
        return "<article>" + "".join(f"<{t}>{t} {i}</{t}>" for j in range(60) for t in (("p", "h2", "ul", "pre", "table", "blockquote")[(i * j + j * j) % 6],)) + "</article>"

    host = host_of([page(i) for i in range(12)])
    assert len(w.expression(host)) < 800
    assert w.main_text(page(3), w.decided(host)).split("\n") == [f"{t} 3" for j in range(60) for t in (("p", "h2", "ul", "pre", "table", "blockquote")[(3 * j + j * j) % 6],)]


def test_very_deep_pages_are_read_whole_and_in_order():
    deep = "<div>" * 5000 + "a<p>b</p>" + "<nav>" * 3000 + "x" + "</nav>" * 3000 + "c" + "</div>" * 5000 + "tail"
    assert w.main_text(deep) == "a\nb\nc\ntail"
    # What every page has outside of the rest is the template's.
    assert w.main_text(deep, w.decided(host_of([deep] * 3))) == "a\nb\nc"


def test_an_article_keeps_its_own_header_captions_and_formulas():
    page = "<body><header>Top</header><article><header><h1>Title</h1></header><figure><figcaption>Cap</figcaption></figure><p>See <math>x</math></p><footer>f</footer></article></body>"
    assert w.main_text(page) == "Title\nCap\nSee x"


def test_words_of_asides_and_of_headings():
    page = (
        "<body><div class=site-header>Site</div><article><div class=header><h1>Title</h1></div><p>One</p><div class=ad_slot>Buy</div><p class=notice>We use cookies</p><p>Two</p>"
        "<fieldset>f</fieldset><div class=reader-comments><p>Mine</p></div><div class=newsletter-signup>Join</div></article><div class=main-menu>Menu</div></body>"
    )
    assert w.main_text(page) == "Title\nOne\nTwo"


def test_tags_that_never_end_take_linear_time(monkeypatch):
    import time

    for piece in ("<a ", "a<b ", '<a "', "<a b='", "</p ", "<!x", "<script "):
        began = time.time()
        w.main_text("<p>First</p>" + piece * (1_000_000 // len(piece)))
        assert time.time() - began < 20, piece
    many = "".join(f"x <b{i} " for i in range(40))
    assert w.main_text(f"<article><p>One</p>{many}") == f"One\n{many.strip()}"
    pages = ["<article>" + "a <b ' " * n + "<p>kept</p>" + "<i \"" * n + tail for n in (39, 40, 41) for tail in ("", "<p>end", "'>")]
    got = [w.main_text(p) for p in pages]
    monkeypatch.setattr(w, "OPEN_ENDS", 10**9)
    assert got == [w.main_text(p) for p in pages]
