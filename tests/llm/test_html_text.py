"""HTML extraction on pages whose text is known."""

from collections import Counter

from cuewright.llm import html_text as H


def page(body, article=True, k=0):
    inner = "".join(f"<p>{b}</p>" for b in body)
    inner = f"<article><h1>Title {k} &amp; more</h1>{inner}</article>" if article else f"<div class='text'><h2>Title {k} &amp; more</h2>{inner}</div>"
    return (
        f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=x>one two</a></li></ul></nav>"
        f"<!-- ad --><div class='ad'>buy things now {k}</div>{inner}<aside>side words</aside><footer>&copy; words</footer></body></html>"
    )


BODY = ["One two  three\nfour <b>five</b>six.", "Seven &lt;eight&gt; nine&nbsp;ten", "last"]
TEXT = "One two three four fivesix.\nSeven <eight> nine ten\nlast"


def weights():
    seen = Counter()
    for k in range(40):
        H.observe(page(BODY, k=k), seen)
    return H.learnt(seen)


def test_articles_with_and_without_markup():
    w = weights()
    assert H.main_text(page(BODY, k=3), w) == f"Title 3 & more\n{TEXT}"
    assert H.main_text(page(BODY, article=False, k=4), w) == f"Title 4 & more\n{TEXT}"


def test_holes_inside_the_article():
    w = weights()
    body = [BODY[0], "<div class=advert>cheap</div>x", "<form><input>name <button>go</button></form>", "end"]
    text = H.main_text(page(body), w)
    assert "cheap" not in text and "name" not in text and text.endswith("end")
    comments = page(BODY).replace("</article>", "<section id='comments'><p>nice post indeed</p></section></article>")
    assert H.main_text(comments, w) == f"Title 0 & more\n{TEXT}"


PROSE = "The results agree with what earlier studies of the same river have found, although the floods of the last decade were not part of them."


def test_listed_words_do_not_decide_against_prose():
    w = weights()
    names = "discussion legal notice alert promotion rail menu tags post-header reply search cookie banner related-work social-history market-share popular-culture".split()
    for name in names:
        for block in (f"<section class='{name}'><p>{PROSE}</p></section>", f"<div id=section-{name}><h2>On it</h2><p>Short here.</p></div>"):
            text = H.main_text(page(BODY).replace("</article>", f"{block}</article>"), w)
            assert text.startswith(f"Title 0 & more\n{TEXT}\n") and ("same river" in text or "On it\nShort here." in text), name
    bare = f"Title 0 & more\n{TEXT}"
    for block in (
        f"<div class='advert'><p>{PROSE}</p></div>", f"<section id='comments'><h3>Two comments</h3><p>{PROSE}</p></section>", "<div class='tags'><a href=x>one</a> <a href=y>two three</a></div>",
        f"<div class='cookie notice'><p>{PROSE}</p><button>accept</button></div>", "<div class=share-bar>send this on</div>", f"<nav><p>{PROSE}</p></nav>", f"<form><p>{PROSE}</p></form>",
        "<ul class=menu>" + "<li><a href=x>many words in a link of a long menu</a></li>" * 9 + "</ul>", "<div class=notice>Closed on Monday.</div>",
    ):
        assert H.main_text(page(BODY).replace("</article>", f"{block}</article>"), w) == bare, block
    # Outside the content element the words still decide, and deep pages take no longer than their length.
    assert "river" not in H.main_text(page(BODY).replace("<aside>", f"<div class=notice><p>{PROSE}</p></div><aside>"), w)
    deep = "<div class=menu>" * 300 + f"<p>{PROSE}</p>" + "</div>" * 300
    assert H.main_text(page(BODY).replace("</article>", f"{deep}</article>"), w) == f"{bare}\n{PROSE}"


def test_odd_pages():
    w = weights()
    for odd in ["", " ", "<p", "<!--", "<script>x", "</div></p>", "<html><body></body></html>"]:
        assert H.main_text(odd, w) == ""
    assert H.main_text("just words", w) == "just words"
    assert H.main_text('<article><p title="a > b">x</p></article>', w) == "x"
    assert H.main_text("<article><p>a<p>b<br>c<li>d</article>", w) == "a\nb c\nd"
    long_ = " ".join(["word"] * 50_000)
    assert H.main_text(page([long_]), w).endswith(long_)


def test_best_region_is_the_best():
    import random

    rng = random.Random(1)
    for _ in range(200):
        s = [rng.randint(-5, 5) for _ in range(rng.randint(0, 12))]
        a, b = H.best_region(s)
        assert sum(s[a:b]) == max([0] + [sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1)])


def test_operator(spark):
    rows = [(k, f"u{k}", page(BODY, k=k), "x", 1) for k in range(30)] + [(None, None, None, "x", 1), (1, "u1", page(BODY, k=1), "x", 1), (77, "u", "", "x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = H.extract(df).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["text"] for r in got if r["page_id"] == 1} == {f"Title 1 & more\n{TEXT}"}
    assert {r["text"] for r in got if r["page_id"] in (None, 77)} == {""}
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_rare_features_count_as_frequent_ones_do(spark):
    # Every site has a class of its own whose words stand outside the content only.
    rows = []
    for site in range(12):
        for k in range(25):
            extra = f"<div class='zq{site}x'>{'menu words of this site ' * 30}</div>"
            rows.append((len(rows), f"s{site}", page(BODY, k=k).replace("<aside>", extra + "<aside>")))
        rows.append((len(rows), f"s{site}", page(BODY, article=False).replace("<aside>", extra + "<aside>")))
    rows += [(None, None, None), rows[0], rows[-1]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = sorted(map(str, H.extract(df).collect()))
    assert len(whole) == len(rows) and not any("menu words" in r for r in whole)
    for few in (0, 1, 8, 20):
        assert sorted(map(str, H.extract(df, most_features=few).collect())) == whole
    assert H._split(df, "html", 8)[1].count() > 0


def test_learnt_weights_decide_without_the_lists():
    def other(k, article):
        # Class names that no list knows, and no content element on the pages to be read.
        text = page(BODY, k=k).replace("class='ad'", "class='zq7'").replace("<nav>", "<div class='zq1'>").replace("</nav>", "</div>")
        text = text.replace("aside>", "section>").replace("<section>", "<section class='zq2'>").replace("<footer>", "<div class='zq3'>").replace("</footer>", "</div>")
        return text if article else text.replace("article>", "div>")

    seen = Counter()
    for k in range(40):
        H.observe(other(k, True), seen, lists=False)
    w = H.learnt(seen, lists=False)
    assert not w.lists and {"div.zq7", "div.zq1", "section.zq2", "div.zq3"} <= w.holes
    assert H.main_text(other(99, False), w) == f"Title 99 & more\n{TEXT}"
