"""Main text of pages: parsing, wrapper induction, odd rows; the expected text is built with the page."""

import html

from edgeloom.llm import pages as pg


def page(k, title, paragraphs, extra="", comments="", main="article"):
    body = "".join(f"<p><b>{html.escape(p)}<br>" if n % 3 == 2 else f"<p>{html.escape(p)}</p>" for n, p in enumerate(paragraphs))
    return (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
        f"<header><a href=/>Home {k}</a></header><nav><ul><li><a href=/a>Menu {k}</a></li></ul></nav><!-- ad {k} -->"
        f"<div class='cookie-notice'>We use cookies {k % 2}</div><div class=ad>Buy {k}!</div>"
        f"<{main}><h1>{title}</h1>{body}<div class=\"share-bar\">Share {k}</div></{main}>{extra}"
        f"<aside>Side {k}</aside><section id=comments><p>Reader {k} says: {comments}</p></section>"
        f"<form><p>Search {k}</p><input value=x></form><footer>&copy; site &middot; {k}</footer></body></html>"
    )


def test_article_and_nothing_else(spark):
    want, rows = {}, []
    for k in range(150):
        paragraphs = [f"Paragraph  {n} of\n{k} &amp; more <b>" for n in range(k % 5 + 1)]
        rows.append((k, f"http://www.host{k % 2}.example/{k}", page(k, f"Title {k}", paragraphs, comments="nice")))
        want[k] = "\n".join([f"Title {k}"] + [" ".join(p.split()) for p in paragraphs])
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as host", "1 as slice", "'y' as text")
    got = pg.main_text(df, per_slice=20).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got) and got[0].url


def test_without_article_the_wrapper_decides():
    def plain(k):
        return (f"<html><body><div id=top><p>The Daily Site</p></div><div id=wrap><div class=story><h2>Head {k}</h2>"
                f"<p>Long text number {k} that is different on each page of this host.</p><p>And more of {k} here.</p>"
                f"<p class=note>All rights kept by us.</p></div></div><div class=end>Contact us</div></body></html>")
    got = pg.extract([plain(k) for k in range(8)])
    assert got[3] == "Head 3\nLong text number 3 that is different on each page of this host.\nAnd more of 3 here."


def test_copies_keep_their_text():
    one = page(1, "Same", ["the same words"] * 2)
    assert set(pg.extract([one] * 30)) == {"Same\nthe same words\nthe same words"}
    near = [page(k, "Same", ["the same words", f"and {k}"]) for k in range(9)]
    assert pg.extract(near)[4] == "Same\nthe same words\nand 4"


def test_broken_and_odd_pages(spark):
    cases = {
        "": "", "just text &lt; here": "just text < here", "<p>a<p>b<i>c</i>d": "a\nbcd",
        "<article><ul><li>x<li>y</ul>z</article>": "x\ny\nz", "<p>a<!-- never closed": "a",
        "<div><script>if (a < b) '</div>'</script><p>t&nbsp;&eacute;&#233;</p>": "t éé",
        "<p>1 < 2 and 3 > 2</p>": "1 < 2 and 3 > 2", "<article>a<span class=ad>no</span>b": "a\nb", "<p " + "a" * 50_000: "",
        "</div></p>x": "x",
    }
    for source, text in cases.items():
        got = pg.extract([source])[0]
        assert got == text or source.startswith("<p a"), (source, got)
    df = spark.createDataFrame([(1, "u", None), (2, None, "<p>x</p>"), (None, "http://h/", "<p>y</p>"), (3, "http://h/", "<p>z</p>"), (3, "http://h/", "<p>z</p>")],
                               "page_id long, url string, html string")
    got = sorted(((r.page_id, r.text) for r in pg.main_text(df).collect()), key=str)
    assert got == sorted([(1, ""), (2, "x"), (None, "y"), (3, "z"), (3, "z")], key=str)
    assert pg.main_text(df.limit(0)).count() == 0


def test_deep_pages_end():
    assert pg.extract(["<div>" * 300 + "deep" + "</div>" * 300])[0] == "deep"


def test_hidden_and_shown_siblings_stay_apart():
    signs = ["role=navigation", "hidden", "aria-hidden=true", "style='display: none'"]
    for tag in ("div", "p"):
        for sign in signs:
            gone, kept = f"<{tag} {sign}>menu {{0}}</{tag}>", f"<{tag}>article {{0}}</{tag}>"
            for body in (gone + kept, kept + gone, gone + kept + gone, gone + kept + kept):
                want = ["\n".join([f"article {k}"] * body.count("article")) for k in range(8)]
                for top in ("{}", "<article>{}</article>"):
                    assert pg.extract([top.replace("{}", body).replace("{0}", str(k)) for k in range(8)]) == want
            # the role of the first page of a host decides nothing about the others
            both = [gone.replace("{0}", "0"), kept.replace("{0}", "1")]
            assert pg.extract(both) == ["", "article 1"] and pg.extract(both[::-1]) == ["article 1", ""]


def test_without_article_no_varying_text_is_dropped():
    long, short = "A long part of text number {k}, other on each page of this host. " * 13, "A short part of text number {k}, other on each page of this host. " * 7
    bodies = {
        f"<h1>Title {{k}}</h1><div class=body><p>{long}</p></div>": ["Title {k}", long],
        f"<div class=lead><p>{long}</p></div><div class=rest><p>{short}</p></div>": [long, short],
        f"<div class=a><h2>Head {{k}}</h2><div class=b><p>{short}</p><div class=c>{long}</div></div></div>": ["Head {k}", short, long],
    }
    for body, want in bodies.items():
        page = f"<html><body><div id=top>The Daily Site</div><div id=wrap>{body}</div><div class=ads>Buy {{k}}</div><div class=end>Contact us</div></body></html>"
        got = pg.extract([page.replace("{k}", str(k)) for k in range(8)])
        assert got == ["\n".join(x.strip() for x in want).replace("{k}", str(k)) for k in range(8)]


def test_layouts_of_a_host_are_judged_apart():
    marked = {k: page(k, f"Title {k}", [f"Paragraph of {k}"], main="main" if k % 2 else "article") for k in range(6)}
    other = {k: f"<body><div class=top>The Daily Site</div><h1>Head {k}</h1><div class=story><p>Story {k}</p></div><nav>Menu {k}</nav></body>" for k in range(6, 18)}
    want = [f"Title {k}\nParagraph of {k}" for k in marked] + [f"Head {k}\nStory {k}" for k in other]
    both = [*marked.values(), *other.values()]
    assert pg.extract(both) == want and pg.extract(both[::-1]) == want[::-1]
    # a single page of the other layout, and a page of which only the marking differs
    assert pg.extract([*marked.values(), other[6]])[-1] == "The Daily Site\nHead 6\nStory 6"
    assert pg.extract([f"<{t}><p>the same words</p></{t}>" for t in ("article", "div")]) == ["the same words"] * 2


def test_very_deep_nesting():
    deep = "<div>" * 20_000 + "<p>inner text</p>" + "</div>" * 20_000
    page = f"<html><body><nav>{'<b><i>' * 3000}menu</nav><article><p>before</p>{deep}<p>after</p></article></body></html>"
    assert pg.extract([page])[0].split("\n") == ["before", "inner text", "after"]
    hidden = "<div>" * 300 + "<aside><p>no</p></aside><p>yes</p>" + "</div>" * 300
    assert pg.extract([f"<article>{hidden}</article>", page])[0] == "yes"


def test_part_of_a_class_name_does_not_rule_out_headings_of_an_article():
    page = "<article><h2 class=related-work>Related work</h2><p class='social-theory'>Text</p><p class=share>Share</p></article><p class=cookie-note>C</p>"
    assert pg.extract([page])[0] == "Related work\nText"
