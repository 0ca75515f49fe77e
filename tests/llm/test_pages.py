"""Pages without an article, and elements that are easily taken for the page's end."""

import pytest

from holdfast.llm import pages

FIRST, SECOND = "Most of the words stand in the first of two blocks. " * 3, "The others stand in the second one."


@pytest.mark.parametrize("page", [
    "<div id=content><div>{0}</div><div>{1}</div></div>",
    "<div id=content><div><p>{0}</p></div><div><p>{1}</p></div></div>",
    "<body><div>{0}</div><center>{1}</center></body>",
    "<body><section><div><p>{0}</p></div></section><table><tr><td>{1}</td></tr></table></body>",
])
def test_siblings_of_the_longest_block_stay(page):
    assert pages.main_text(page.format(FIRST, SECOND)) == f"{FIRST.strip()}\n{SECOND}"


def test_short_paragraphs_and_headings_stay():
    page = f"<nav><p>Not this.</p></nav><h1>Title</h1><div><p>{FIRST}</p></div><div><p>End</p></div><footer>Nor this one.</footer>"
    assert pages.main_text(page) == f"Title\n{FIRST.strip()}\nEnd"


def test_scripts_without_blanks_are_prose():
    assert pages.main_text(f"<div>{FIRST}</div><div>短い文章。</div>") == f"{FIRST.strip()}\n短い文章。"


@pytest.mark.parametrize("odd", [
    '<svg class="i"/>', "<math/>", "<object>", "<canvas/>", "<iframe>", "<textarea>", "<title>", "<select>", "<template>",
    "<noscript>", "<svg><title>a <b</title></svg>", "<svg><path d='m0'/><text>drawn</text></svg>",
    "<iframe src=x><p>not shown</p></iframe>", "<select><option>a<option>b</select>", "<template><p>no</p></template>",
])
def test_odd_elements_hide_nothing_else(odd):
    page = f"<article><p>One {odd} two</p><p>three</p><p>four <svg><g/></svg></p></article>"
    assert pages.main_text(page) == "One two\nthree\nfour"


def test_formulas_and_fallbacks_are_text():
    page = ("<article><p>As <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> is <object data=a><b>so</b>"
            "</object>, <canvas>that</canvas></p><noscript><p>and this</p></noscript></article>")
    assert pages.main_text(page) == "As x=2 is so, that\nand this"


def test_drawings_end_before_a_block():
    page = "<article><div>One <svg> two<p>three</p></div><p>four</p><svg><g></g></svg></article>"
    assert pages.main_text(page) == "One\nthree\nfour"
    page = '<article><p>One <svg class="i"> two</p><p>three</p><p>four <svg><g/></svg></p></article>'
    assert pages.main_text(page) == "One\nthree\nfour"


def test_names_that_only_begin_like_a_script():
    assert pages.main_text("<article><script-note>One</script-note><p>two</p></article>") == "One\ntwo"


@pytest.mark.parametrize("element", [
    '<section class="related-work">{0}</section>', '<p id="search">{0}</p>', '<p class="share-of-votes">{0}</p>',
    '<div class="banner-year history">{0}</div>', '<ul><li class="menu">{0}</li></ul>', '<h2 class="notice">{0}</h2>',
])
def test_words_in_names_take_no_text_away(element):
    page = f"<article><p>One.</p>{element.format('Two &amp; three.')}</article>"
    assert pages.main_text(page) == "One.\nTwo & three."


@pytest.mark.parametrize("name", ["comments", "comment-list", "ad", "ad-slot-3", "x related_posts", "share-buttons", "cookie-notice", "social"])
def test_parts_by_their_whole_name(name):
    assert pages.main_text(f'<article><p>One.</p><div class="{name}"><p>Not this.</p></div><p>Two.</p></article>') == "One.\nTwo."


def test_a_stub_gives_way_to_the_story():
    stub = "<article><p>A stub.</p></article>"
    assert pages.main_text(f"<div>{stub}</div><main><p>{FIRST}</p></main>") == FIRST.strip()
    assert pages.main_text(f"<main><p>{FIRST}</p>{stub}</main>") == "A stub."


def test_named_paragraphs_go_by_the_template(spark):
    """A paragraph named like a part goes where the host's pages have it, not on a host of one page;
    a text that every page has goes once chance is ruled out."""
    def page(host, n):
        return (f"http://{host}/{n}", f"<article><p>Story {host} {n}.</p><p class=notice>Seen {n * n} times.</p><p>Thanks.</p></article>")

    rows = [page("many", n) for n in range(9)] + [page("few", n) for n in range(4)] + [page("one", 0)]
    df = spark.createDataFrame(rows, "url string, html string")
    got = {r["url"]: r["text"] for r in pages.extract(df, "url", "html").collect()}
    assert all(got[f"http://many/{n}"] == f"Story many {n}." for n in range(9))
    assert all(got[f"http://few/{n}"] == f"Story few {n}.\nThanks." for n in range(4))
    assert got["http://one/0"] == "Story one 0.\nSeen 0 times.\nThanks."


def test_whole_texts_against_another_parser(spark):
    """Every given page against the standard library's parser: the article's text, block by block."""
    from html.parser import HTMLParser

    from holdfast.llm.queries import LLM_QUERIES

    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.open, self.blocks = [], [""]

        def handle_starttag(self, tag, attrs):
            if tag not in pages.VOID:
                self.open.append((tag, dict(attrs)))
            if tag in pages.BLOCK:
                self.blocks.append("")

        def handle_endtag(self, tag):
            if any(t == tag for t, _ in self.open):
                while self.open.pop()[0] != tag:
                    pass
            if tag in pages.BLOCK:
                self.blocks.append("")

        def handle_data(self, data):
            names = [t for t, _ in self.open]
            out = {"nav", "footer", "aside", "form", "script", "style", "head"} & set(names)
            if "article" in names and not out and not any(a.get("class") in ("ad", "comments") for _, a in self.open):
                self.blocks[-1] += data

    folder = "/root/testdata/sf0.01"
    source = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    wrong = []
    for r in LLM_QUERIES["op7_html_extraction"](spark, folder).collect():
        parser = Article()
        parser.feed(source[r["page_id"]] or "")
        parser.close()
        want = "\n".join(b for b in (" ".join(b.split()) for b in parser.blocks) if b)
        if r["text"] != want or r["n_chars"] != len(want):
            wrong.append((r["page_id"], r["text"][:200], want[:200]))
    assert len(source) > 100 and not wrong, wrong[:3]
