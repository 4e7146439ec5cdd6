"""Main texts of hand-made pages, of the pages table and of odd rows, by exact text."""

import html
import re

import pytest

from muralis.llm import html_extract

HAND = [
    ("<article><p>One two three four five six.</p><p>Math <math><mi>x</mi></math> and more end.</p></article>","One two three four five six.\nMath x and more end."),
    ('<article><p>Some words <span class="ad">Buy now</span> and the end of it.</p></article>',"Some words and the end of it."),
    ("<article><p>A short text here.</p><button>Share</button></article>","A short text here."),
    ("<p>Just a sentence on a bare page.</p>","Just a sentence on a bare page."),
    ('<article><p title="x>Hello there my friends</p><p>Second one.</p></article>',"Hello there my friends\nSecond one."),
    ("<html><body><nav><a href=1>Home</a></nav><article><h1>Title</h1><p>Body text.</p></article><footer>(c) me</footer></body></html>","Title\nBody text."),
    ("<html><body><div id=header><h1>Site</h1></div><div class=content><p>First paragraph of the story goes here.</p><p>Second.</p></div><div id=sidebar><p>Popular things</p></div></body></html>","First paragraph of the story goes here.\nSecond."),
    ("<html><body><main><h1>T</h1><p>Text with <svg width=1 /> picture.</p></main><aside><p>About us and so on.</p></aside></body></html>","T\nText with picture."),
    ("<body><article><h1>Big news</h1><form><label>Mail</label><input><button>Go</button></form><p>The news are here.</p><section class=comments><h2>Comments</h2><p>I like it very much</p></section></article></body>","Big news\nThe news are here."),
    ("<body><div class=cookie-banner><p>We use cookies</p></div><article><p>Real <a href=x>link</a> content with words.</p></article><script>x()</script></body>","Real link content with words."),
    ("<body><header><nav><ul><li><a href=a>A</a><li><a href=b>B</a></ul></nav></header><div class='post'><h2>Head</h2><ul><li>item one</li><li>item two</li></ul></div></body>","Head\nitem one\nitem two"),
    ("<html><body><article><h1>H</h1><p>x &lt; y &amp; z&nbsp;q</p><table><tr><td>a</td><td>b</td></tr></table></article></body></html>","H\nx < y & z q\na\nb"),
    ("<html><body><article><p>"+"word "*3000+"</p></article><div class=comments><p>"+"talk "*200+"</p></div></body></html>"," ".join(["word"]*3000)),
    ("<html><body><nav>Menu</nav><article><h1>Only a title</h1></article><div class='ad'>Buy</div></body></html>","Only a title"),
    ("<html><body><article><h1>A</h1><p>b<sup>2</sup> c</p><aside>Related: <a href=x>more</a></aside><p>d</p></article></body></html>","A\nb2 c\nd"),
]

#: Short articles, links in prose and in lists, raw elements inside blocks, odd names, loose text.
MORE = [
    ("<article><p>One.</p><p>Two <a href=x>link text only here</a></p></article>", "One.\nTwo link text only here"),
    ("<article><h1>Sources</h1><p>These were read.</p><ul><li><a href=1>First source</a></li><li><a href=2>Second source</a></li></ul></article>", "Sources\nThese were read.\nFirst source\nSecond source"),
    ("<article><h1>T</h1><p>Words<script>x</script> more</p><textarea>note</textarea></article>", "T\nWords more"),
    ("<article class='commentary'><p>My view of things.</p></article>", "My view of things."),
    ("<body>Loose body text</body>", "Loose body text"),
    ("<article><p><a href=x>All of this is a link</a></p></article>", "All of this is a link"),
    ("<main><p>Yes.</p></main>", "Yes."),
    ("<article><p>a</p></article>", "a"),
    ("<html><body><nav><a href=1>Home</a> <a href=2>News</a></nav><main><p>Short.</p></main></body></html>", "Short."),
    ("<article class='headline'><h2>Heads up</h2><p>The rest of it.</p></article>", "Heads up\nThe rest of it."),
    ("<article><p>See <a href=a>this</a>, <a href=b>that</a> and <a href=c>those</a>.</p></article>", "See this, that and those."),
    ("<div class=content><p>One <b>bold</b> word.</p><script>var a;</script><p>Two.</p></div>", "One bold word.\nTwo."),
    ("<body><div id=menu><a href=x>Home</a></div><article><p>Text.</p><ol><li>one<li>two</ol></article><div id=footer>Imprint</div></body>", "Text.\none\ntwo"),
    ("<article><h1>Only</h1><img src=a><img src=b><img src=c><p>Pictures</p></article>", "Only\nPictures"),
    ("<article><p>Before</p><style>.a{}</style><style>.b{}</style><script>1</script><script>2</script><p>After</p></article>", "Before\nAfter"),
    ("<article><p>Ask <em>us</em></p><form action=s><input name=q><button>Go</button></form></article>", "Ask us"),
    ("<html><head><title>No</title></head><body>Words that stand alone in the body of a page.<br>And more.</body></html>", "Words that stand alone in the body of a page. And more."),
    ("<article><table><tr><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table></article>", "1\n2\n3\n4"),
    ("<article><blockquote>To be or not</blockquote><p>He said.</p></article>", "To be or not\nHe said."),
    ("<article><pre>x = 1\ny = 2</pre></article>", "x = 1 y = 2"),
    ("<main><article><p>Inner words here.</p></article></main><aside class=sidebar><p>More to read</p></aside>", "Inner words here."),
    ("<article><p>News.</p><div class=comments><p>First!</p><p>Second!</p></div></article>", "News."),
    ("<article><p>News.</p><div class='comment-list'><div class=comment><p>First!</p></div></div></article>", "News."),
    ("<body><header class=masthead><h1>The Daily</h1></header><article><h1>Storm</h1><p>It rained.</p></article><footer><p>(c) Daily</p></footer></body>", "Storm\nIt rained."),
    ("<div class='post'><h1>A day</h1><p>It was fine.</p></div><div class='related-posts'><ul><li><a href=x>Another day</a></li></ul></div>", "A day\nIt was fine."),
    ("<article id=textual><p>Named oddly.</p></article>", "Named oddly."),
    ("<article class='sidewalk'><p>On the street.</p></article>", "On the street."),
    ("<article><p>x &lt;b&gt; y</p></article>", "x <b> y"),
    ("<article><dl><dt>Term</dt><dd>Meaning</dd></dl></article>", "Term\nMeaning"),
    ("<article><figure><img src=x><figcaption>A cat</figcaption></figure><p>Cats sleep.</p></article>", "A cat\nCats sleep."),
    ("<article><p>Buy <span class=price>5</span> eggs</p></article>", "Buy 5 eggs"),
    ("<article><section><h2>Part</h2><p>One</p></section><section><h2>Next</h2><p>Two</p></section></article>", "Part\nOne\nNext\nTwo"),
    ("<article><p>Up</p><div class=ad>Buy cheap things</div><p>Down</p></article>", "Up\nDown"),
    ("<article><p>Up</p><div class=advert><a href=x>Buy cheap things</a></div><p>Down</p></article>", "Up\nDown"),
    ("<body><div class=notice><p>We use cookies.</p></div><div class=content><p>Hi.</p></div></body>", "Hi."),
    ("<body><article><h1>Long</h1>" + "<p>Some words in a row.</p>" * 60 + "</article><ul class=menu><li><a href=x>Home</a></ul></body>", "\n".join(["Long"] + ["Some words in a row."] * 60)),
    ("<article><p>A<br>B</p><hr><p>C</p></article>", "A B\nC"),
    ("<article><h1><a href=x>Linked title</a></h1><p>Body.</p></article>", "Linked title\nBody."),
    ("<article><div><div><p>Deep.</p></div></div></article>", "Deep."),
    ("<article>Bare words in an article</article>", "Bare words in an article"),
    ("<article>Bare words <p>and a paragraph</p> and a tail</article>", "Bare words\nand a paragraph\nand a tail"),
    ("<main><h1>Recipe</h1><ul><li>2 eggs</li><li><a href=f>flour</a></li></ul><ol><li>Mix.</li><li>Bake.</li></ol></main>", "Recipe\n2 eggs\nflour\nMix.\nBake."),
    ("<article><p>Sum <math><mi>a</mi><mo>+</mo><mi>b</mi></math>.</p><iframe src=v></iframe></article>", "Sum a+b."),
    ("<article><noscript>Enable scripts</noscript><p>Words.</p></article>", "Words."),
]


@pytest.fixture(scope="module")
def model():
    return html_extract.train()


def test_hand_made_pages(model):
    got = html_extract.extract([source for source, _ in HAND], *model)
    assert [g for g, (_, want) in zip(got, HAND, strict=True) if g != want] == []


def test_more_pages(model):
    got = html_extract.extract([source for source, _ in MORE], *model)
    assert [g for g, (_, want) in zip(got, MORE, strict=True) if g != want] == []


def test_pages_table(spark):
    """Its pages have one article element, with headings, paragraphs, bold words and line breaks."""

    def article(source):
        m = re.search(r"<article.*?</article>", source, re.S)[0]
        m = re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", re.sub(r"</?(?:article|h1|p)>", "\0", m)))
        return "\n".join(x for x in (re.sub(r"\s+", " ", html.unescape(b)).strip() for b in m.split("\0")) if x)

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.main_text(pages).collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_odd_rows(spark):
    long = "<article><p>" + "many words of text " * 60_000 + "</p></article>"
    deep = "<div>" * 3000 + "<p>inside</p>"
    rows = [(1, "u", long, "x", 1), (1, "u", long, "x", 1), (None, None, None, None, None), (2, "u", deep, "y", 2), (3, "u", "<" * 5000 + "a b" * 5000, "y", 2), (4, "u", "<p x='" * 3000, "y", 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = html_extract.main_text(df).collect()
    assert len(got) == 6 and [r.n_chars for r in got if r.page_id == 1] == [len("many words of text " * 60_000) - 1] * 2
    assert [(r.text, r.n_chars) for r in got if r.page_id is None] == [("", 0)]
    assert html_extract.main_text(df.limit(0)).collect() == []
