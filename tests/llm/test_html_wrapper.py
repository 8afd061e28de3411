import random

import pytest

from vacantia.llm import html_wrapper
from vacantia.llm.html_wrapper import LONGEST, TEXT, aligned, bounded, decide, extract, extract_main_text, page_text, parse, wrapper_of

SCHEMA = "page_id bigint, url string, html string"
WORDS = "Stone river cloud paper lantern meadow copper violet harbour winter signal garden".split()


def prose(rng, n=25):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def blog(rng, lines):
    """A labelled article among everything that is none."""
    links = "".join(f'<li><a href="/{rng.choice(WORDS)}">{rng.choice(WORDS)}</a></li>' for _ in range(5))
    body = "".join(f"<p>{line}</p>" for line in lines[1:])
    return f"""<!DOCTYPE html><html><head><title>{lines[0]}</title><style>p {{}}</style><script>if (a < b) "</p>";</script></head>
<body class="home"><header><a href="/">Site</a> {prose(rng)}</header><nav><ul>{links}</ul></nav>
<div class="cookie-notice">We use {prose(rng)}</div><!-- <p>{prose(rng)}</p> -->
<main><article id="post-{rng.randint(1, 999)}"><h1>{lines[0]}</h1>{body}<form><p>{prose(rng)}</p><input name="q"></form>
<div class="share-buttons">{prose(rng)}</div></article><section id="comments"><p>{prose(rng)}</p></section></main>
<aside><p>{prose(rng, 60)}</p></aside><div class="ad">{prose(rng)}</div><footer>&copy; {prose(rng)}</footer></body></html>"""


def plain_site(rng, lines):
    """Nothing says which part is the article; menus are lists of links, slogans never change."""
    menu = "".join(f'<li><a href="#">{rng.choice(WORDS)} {rng.choice(WORDS)}</a></li>' for _ in range(rng.randint(3, 9)))
    body = "".join(f"<p>{line}" for line in lines)  # paragraphs are never closed
    return f"""<body><table><tr><td><ul>{menu}</ul><td><div class="c1"><div>Printed on paper since 1901</div>{body}</div></table>"""


def crawl(rng, kind, n):
    pages = []
    for i in range(n):
        lines = [prose(rng, rng.randint(4, 40)) for _ in range(rng.randint(2, 9))]
        pages.append((kind(rng, lines), "\n".join(lines)))
    return pages


def texts(frame):
    return {r.page_id: r.text for r in frame.collect()}


def test_articles_of_two_sites(spark):
    rng = random.Random(1)
    blogs, plain = crawl(rng, blog, 40), crawl(rng, plain_site, 60)
    rows = [(i, f"https://blog.test/{i}", page) for i, (page, _) in enumerate(blogs)]
    rows += [(1000 + i, f"http://PLAIN.test/{i}?x", page) for i, (page, _) in enumerate(plain)]
    wanted = {i: text for i, (_, text) in enumerate(blogs)} | {1000 + i: text for i, (_, text) in enumerate(plain)}
    pages = spark.createDataFrame(rows, SCHEMA).repartition(6)
    found = extract_main_text(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    assert texts(found) == wanted
    assert {r.page_id: r.n_chars for r in found.collect()} == {i: len(t) for i, t in wanted.items()}
    # The same where wrappers are joined instead of sent to all tasks.
    assert texts(extract_main_text(pages, known_bytes=0)) == wanted


def test_many_hosts_in_one_task_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(html_wrapper, "HELD_NODES", 60)
    rng = random.Random(2)
    made = crawl(rng, blog, 24)
    pages = spark.createDataFrame([(i, f"http://h{i % 5}.test/", page) for i, (page, _) in enumerate(made)], SCHEMA)
    assert texts(extract_main_text(pages.coalesce(2))) == {i: text for i, (_, text) in enumerate(made)}


def test_lines_references_and_broken_markup(spark):
    page = (
        "<html><body><nav>menu</nav><article><h1>Fish&nbsp;&amp;  chips</h1>\n<p>one <b>two<br>three</b> &lt;p&gt; &#x27;&eacute;&copy"
        "<p>a<span class='x'>b</span>c <a href='?a>b'>linked</a>&unknown; <i>4 < 5</i></p>text <ul><li>x<li>y</ul>"
        "<table><tr><td>1<td>2</table><pre>k\n  l</pre><div hidden>no</div><div style='display: none'>no</div>"
        "<p>last <script>var x = '<p>';</script>line</p><footer>no</footer></article><p>outside"
    )
    wanted = "Fish & chips\none two three <p> 'é©\nabc linked&unknown; 4 < 5\ntext\nx\ny\n1\n2\nk l\nlast\nline"
    rows = [(1, "http://a/", page), (2, None, page), (3, "no host", page), (None, "http://b/", page), (4, "http://a/", None), (5, "http://a/", "")]
    found = sorted(((r.page_id or 0, r.text, r.n_chars) for r in extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert found == [(i, wanted, len(wanted)) for i in range(4)] + [(4, "", 0), (5, "", 0)]


def test_copies_of_one_page_stay_whole(spark):
    rng = random.Random(3)
    (page, text), *others = crawl(rng, blog, 3)
    rows = [(i, "http://a/", page) for i in range(60)] + [(i, "http://b/", page) for i in range(60, 63)]
    found = texts(extract_main_text(spark.createDataFrame(rows, SCHEMA).repartition(4)))
    assert set(found.values()) == {text}


def test_empty_table_and_clashing_columns(spark):
    assert extract_main_text(spark.createDataFrame([], SCHEMA)).collect() == []
    wide = spark.createDataFrame([("k", "http://a/", "<p>x</p>", "h", b"w", 1)], "page_id string, url string, html string, host string, wrapper binary, text int")
    assert [tuple(r) for r in extract_main_text(wide).collect()] == [("k", "http://a/", "x", 1)]


def own(page):
    return wrapper_of(parse(page))


def signs(items):
    return [(x.signature, x.optional, x.repeated) for x in items]


def test_mismatches_become_optional_and_repeated_groups():
    a, b = own("<h1>a</h1><p>x</p><p>y</p>"), own("<h1>b</h1><ul><li>1</li></ul><p>z</p>")
    assert signs(a) == [("h1", False, False), ("p", False, True)]
    both = aligned(a, b)
    assert signs(both) == [("h1", False, False), ("ul", True, False), ("p", False, True)]
    assert both[0].kids[0].signature == TEXT and both[0].kids[0].text == 0 and both[0].pages == 2
    series = own("<h2>a</h2><p>x</p><h2>b</h2><p>y</p><p>z</p><h2>c</h2><p>w</p>")
    assert signs(series) == [("(h2|p)", False, True)]
    once = aligned(series, own("<h2>only</h2><p>one</p>"))
    assert signs(once) == [("(h2|p)", False, True)] and [x.pages for x in once[0].kids] == [2, 2]


def test_texts_that_never_change_are_known():
    pages = [own(f"<div>Same</div><p>text {i}</p>") for i in range(9)]
    wrapper = pages[0]
    for page in pages[1:]:
        wrapper = aligned(wrapper, page)
    assert wrapper[0].kids[0].text != 0 and wrapper[1].kids[0].text == 0
    decide(wrapper, 9)
    assert extract("<div>Same</div><p>text</p>", wrapper) == "text"


@pytest.mark.parametrize("seed", range(5))
def test_any_page_can_be_aligned_and_no_text_is_lost(seed):
    """Random markup: of a page without boilerplate every word comes out, in order."""
    rng = random.Random(seed)
    tags = "div p ul li h2 table tr td section b i span blockquote pre dl dt dd".split()

    def page():
        out, number = [], 0
        for _ in range(rng.randint(1, 150)):
            tag = rng.choice(tags)
            out.append(rng.choice((f"<{tag}>", f"</{tag}>", f'<{tag} class="k{rng.randint(0, 3)}">', f" w{(number := number + 1)} ", "<br>", "<", "&amp;")))
        return "".join(out)

    made = [page() for _ in range(30)] + ["<p>" * 5000, "<div>" * 3000 + "deep", "".join(f"<x{i}>t</x{i}>" for i in range(300))]
    wrapper = own(made[0])
    for html in made[1:]:
        wrapper = bounded(aligned(wrapper, own(html)))
        assert len(wrapper) <= LONGEST

    def keep_all(items):
        for node in items:
            node.keep = True
            keep_all(node.kids)

    keep_all(wrapper)
    for html in made:
        tree = parse(html)

        def everything(block):
            for kid in block.kids:
                kid.keep = True
                if hasattr(kid, "kids"):
                    everything(kid)

        everything(tree)
        assert extract(html, wrapper) == page_text(tree)


def test_long_pages_take_time_in_proportion():
    page = "<p>word <a b='\n" * 30_000 + ">"
    assert page_text(parse(page)) == ""
    assert len(own("<a <b " * 50_000)) == 1
