import io
import zipfile

import pytest
from workfeed.operators import extract


@pytest.mark.parametrize("html, want", [
    (" \n ", ""), ("plain words", "plain words"), ("<section>left <b>open", "left open"), ("Fish &lt; chips, caf&eacute;", "Fish < chips, café"),
    ("<h3>Soup</h3><ol><li>Boil water<li>Add salt &amp; stir</ol>", "Soup\n1. Boil water\n2. Add salt & stir"), ("<ul><li>pear</li><li>fig <i>ripe</i></li></ul>after", "- pear\n- fig ripe\nafter"),
    ("<header>top</header>\n<main>in<br>the   middle</main>", "top\nin\nthe middle"), ("<div>first</div><br><br><br><br><div>last</div>", "first\n\nlast"),
    ('<p>Map: <a href="http://maps.test/m?q=2">of the city</a></p>', "Map: of the city (http://maps.test/m?q=2)"), ('<a href="next.html">Next</a> page', "Next page"),
    ('Go <a href="http://z.test/q">http://z.test/q</a> now', "Go http://z.test/q now"),
    ("<table><thead><tr><th>Bus</th><th>Min</th></tr></thead><tbody><tr><td>7</td><td>12</td></tr></tbody></table>", "Bus\tMin\n7\t12"),
    ("<p>Run</p><pre>a\n  b\n\n    c</pre><p>then</p>", "Run\na\n  b\n\n    c\nthen"), ("<noscript>off</noscript><script>if (1 < 2) x()</script><template>t</template>on", "on"),
    ('Look: <img alt="a cat" src="c.gif"><img src="d.gif">', "Look: [image: a cat]"),
])
def test_html(html, want):
    assert extract.html_text(html)[0] == want


def test_a_cut_reference_stays_where_only_closed_ones_are_decoded(spark):
    html = '<h1>up &amp; on &copy</h1><p>a &#38; b &lt &nosuch; c&amp</p><a href="/x?a=1&amp;b=2&c">go &gt; on</a>'
    assert extract.html_text(html, closed=True) == ("up & on &copy\na & b &lt &nosuch; c&amp\ngo > on", [("/x?a=1&b=2&c", "go > on", "")])
    assert extract.html_text(html)[0] == "up & on ©\na & b < &nosuch; c&\ngo > on"
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")
    assert [r.text.count("&copy") if r.text else 0 for r in extract.html_to_text(pages, closed=True).collect()] == [1, 0]


def test_links_in_order_first_of_each_target(spark):
    html = '<a href="/courses/1/files/42?w=1">One</a> <a href="https://a.b/c">x</a> <a href="/courses/1/files/42/download">again</a>'
    assert extract.html_text(html)[1] == [("/courses/1/files/42?w=1", "One", "42"), ("https://a.b/c", "x", "")]


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


def test_files_and_errors_are_rows(spark):
    w, a = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/main"
    docx = zipped({"word/document.xml": f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p><w:r><w:t>Three</w:t></w:r></w:p></w:body></w:document>'})
    slide = lambda t: f'<p xmlns:a="{a}"><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p>'
    pptx = zipped({"ppt/slides/slide10.xml": slide("ten"), "ppt/slides/slide2.xml": slide("two")})
    files = [("a.docx", None, docx), ("b.pptx", None, pptx), ("c.docx", None, b"junk"), ("d.bin", "x/y", b"1"), ("e.txt", None, "é".encode() * 50), ("f.html", None, b"<p>hi"), ("g.txt", None, b"x" * 5000), ("h.txt", None, None)]
    df = spark.createDataFrame(files, "path string, mime_type string, content binary")
    got = {r.path: (r.text, r.truncated, r.error) for r in extract.files_to_text(df, limit=61, ceiling=4000).collect()}
    assert got["a.docx"] == ("One\ttwo\nThree", False, None) and got["b.pptx"] == ("two\n\nten", False, None)
    assert got["c.docx"][2].startswith("cannot be read") and got["d.bin"] == (None, False, "unsupported type")
    # Bytes that are no UTF-8 go; a replacement character of the text's own stays.
    odd = spark.createDataFrame([("o.txt", None, b"a\xffb\xef\xbf\xbdc\xed\xa0\x80d \xef\xb7\x90e\xc3")], df.schema)
    assert extract.files_to_text(odd).first().text == "ab\ufffdcd \ufdd0e"
    assert got["e.txt"] == ("é" * 30, True, None) and got["f.html"] == ("hi", False, None) and got["g.txt"] == (None, False, "too large")


def test_chunks_keep_lines_whole(spark):
    body = "ab\ncdefgh\n" + "x" * 12 + "\ni\nj"
    rows = extract.chunks(spark.createDataFrame([(1, body), (2, "short"), (3, ""), (4, None)], "id int, text string"), "text", 9).collect()
    got = [(r.id, r.part, r.chunk) for r in rows]
    assert got == [(1, 0, "ab\n"), (1, 1, "cdefgh\n"), (1, 2, "x" * 12 + "\n"), (1, 3, "i\nj"), (2, 0, "short"), (3, 0, "")]


def test_a_tag_that_never_ends_is_text():
    assert extract.html_text("<p>one</p> two < three <b")[0] == "one\ntwo < three <b"
    assert extract.html_text('x <a href="y> z <i>w</i>')[0].startswith('x <a href="y>')
    assert extract.open_ends('<a b="<c>"> <d e=\'>') == [12]
    assert extract.open_ends("<!-- < <p <? <!x") == [5, 7, 10, 13]


@pytest.mark.parametrize("piece", ["<a ", "a<b ", '<a "', "<a '\"", "<!x", "<?", "</p ", "<a b='"])
def test_long_pages_of_tags_that_never_end_take_linear_time(piece):
    import time

    began = time.time()
    text, _ = extract.html_text(piece * (1_000_000 // len(piece)))
    assert time.time() - began < 20 and len(text) > 0 or piece in ("<!x", "<?")
