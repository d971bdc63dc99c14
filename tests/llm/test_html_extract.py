import html
import re

from graphloom.llm.html_extract import extract_main_text, main_text
from graphloom.llm.queries import op10_html_extract


def article(page):
    """The blocks of a page whose article is plain paragraphs, by splitting the source."""
    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?p>|</?h1>", inner)]
    return "\n".join(b for b in blocks if b)


def test_pages_table(spark, sf):
    want = {r.page_id: (r.url, article(r.html)) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = op10_html_extract(spark, sf).collect()
    assert {r.page_id: (r.url, r.text) for r in out} == want
    assert all(r.n_chars == len(r.text) for r in out)


BODY = "<p>The first paragraph of the story, which has a good many words in it.<p>The second one, with a <a href=x>link</a> inside, goes on as long as that."
WANT = "The first paragraph of the story, which has a good many words in it.\nThe second one, with a link inside, goes on as long as that."


def test_furniture_goes_whatever_the_frame():
    for frame in (
        "<body><nav><a href=1>Home</a><a href=2>News</a></nav><article>{}</article><footer>(c)</footer>",
        "<body><div id=header><a href=/>Site</a></div><div class=content>{}</div><div class='side-bar sidebar'><ul><li><a>one</a><li><a>two</a></ul></div>",
        "<main>{}<section class=comments><p>I say that this is quite wrong, and at great length too, as readers do</p></section></main>",
        "<article>{}<form><label>Mail</label><input><button>Go</button></form><div class='AdBox advert'>Buy now, it is cheap</div></article><aside>More</aside>",
        "<div class='page with-sidebar'><article><script>if (a < b) document.write('<p>no</p>')</script>{}<style>p {{}}</style></article></div>",
        "<div class=cookie-notice>We use cookies on this very site</div><article>{}</article><article class=comment><p>no, no, no</p></article>",
        "<p class=notice>Please note</p><div><div><div>{}</div></div></div><div role=contentinfo>me</div>",
    ):
        assert main_text(f"<!doctype html><html><head><title>T</title></head>{frame.format(BODY)}") == WANT, frame


def test_odd_pages():
    for page, text in {
        None: "", "": "", "  \n": "", "<p></p>": "", "just &lt;text&gt; &amp; more": "just <text> & more", "a < b": "a < b", "<b": "", "<p>x<!-- never ends": "x",
        "<p>a&nbsp; b\n\tc<br>d</p>": "a b c d", "<table><tr><td>1<td>2<tr><td>3</table>": "1 2\n3", "<ul><li>a<li>b</ul>": "a\nb", "<p>x</p></p></div>y": "x\ny",
        "<div hidden>no</div><p>yes": "yes", "<pre>a  b</pre>": "a b", "<p>&#x1F642;&eacute;&bogus;": "🙂é&bogus;", "<nav>only <a>links</a></nav>": "",
    }.items():
        assert main_text(page) == text, page
    assert main_text("<div>" * 3000 + "deep") == "deep"
    assert len(main_text("<p>word word</p>" * 20000).split("\n")) == 20000


def test_density_alone_finds_the_article(spark, sf):
    """Pages whose frames and names say nothing: all boxes are div, without class, id or role. What is left to density is
    a page whose one paragraph is as short as its line of rights."""
    same = []
    for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/pages.parquet").collect():
        plain = re.sub(r"<(/?)(article|nav|header|footer|aside|main|section|form)\b", r"<\1div", r.html)
        plain = re.sub(r"""\s(class|id|role)=("[^"]*"|'[^']*'|[^\s>]+)""", "", plain)
        same.append(main_text(plain) == article(r.html))
    assert len(same) == 250 and sum(same) >= 245


def test_columns_and_empty_table(spark):
    pages = spark.createDataFrame([(1, None, "t", 5), (1, "<p>é</p>", None, None)], "page_id long, html string, text string, _doc int")
    out = extract_main_text(pages)
    assert out.columns == ["page_id", "_doc", "text", "n_chars"]
    assert sorted((r.page_id, r._doc, r.text, r.n_chars) for r in out.select("page_id", "_doc", "text", "n_chars").fillna(0).collect()) == [(1, 0, "é", 1), (1, 5, "", 0)]
    assert extract_main_text(pages.limit(0)).count() == 0
    named = extract_main_text(pages.withColumnRenamed("_doc", "a `b`: c, d"))
    assert named.columns == ["page_id", "a `b`: c, d", "text", "n_chars"] and named.count() == 2


def test_names_made_from_headings_stay_in_an_article():
    for piece, text in (
        ("<section id='related-work'><h2 id='social-history'>Past</h2><p>Others did this before us.</p></section>", "Past\nOthers did this before us."),
        ("<div id='comments-on-the-draft'><p class='ad-hoc'>We thank all the readers.</p></div>", "We thank all the readers."),
        ("<h2 id=comments>Comments</h2><p>It is <math><mi>x</mi></math> here.</p>", "Comments\nIt is x here."),
        ("<div class='share-buttons'>Share it</div><div class='related-posts'>More</div><div id=comment-12>Me too</div>", ""),
    ):
        for tag in ("article", "main"):
            assert main_text(f"<body><{tag}>{BODY}{piece}</{tag}>") == "\n".join(x for x in (WANT, text) if x), (tag, piece)


def test_articles_beside_the_heart_stay_if_dense():
    more = BODY.replace("story", "sequel")
    both = f"{WANT}\n{WANT.replace('story', 'sequel')}"
    assert main_text(f"<body><article>{BODY}</article><article>{more}</article>") == both
    assert main_text(f"<body><div><article>{BODY}</article><section>{more}</section></div>") == both
    assert main_text(f"<body><article>{BODY}</article><article><a href=1>One</a> <a href=2>Two</a></article>") == WANT
