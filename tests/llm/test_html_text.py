import random

from spendspark.llm import html_text as H

ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">x</a></li></ul></nav>
<!-- ad 3 --><div class="ad">Buy</div><article><h1>Head &amp; line</h1><p><b>Bold&nbsp; one<br><p>Two <i>th</i>ree   four</p><form><input>f</form><div class="reader-comments"><p>no</p></div><p>&lt;b&gt; &#233;</p></article><footer>&copy; f</footer>"""


def template(i, body):
    return f"<body><div>Site of things</div><p>Home - News</p>{body}<p>Contact us</p><div>Page {i}</div></body>"


def longest(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_subsequence_is_longest(monkeypatch):
    rng = random.Random(6)
    for bits in (1 << 28, 16):
        monkeypatch.setattr(H, "ALIGN_BITS", bits)
        for _ in range(400):
            a, b = ([rng.randrange(5) for _ in range(rng.randint(0, 20))] for _ in "ab")
            found = H.common_subsequence(a, b)
            assert found == sorted(set(found)) and len(found) == longest(a, b)
            rest = iter(b)
            assert all(a[i] in rest for i in found)


def test_lines():
    assert H.main_text(ARTICLE, None) == "Head & line Bold one Two three four <b> é"
    assert H.main_text(None, None) == "" and H.main_text("", None) == "" and H.main_text("plain &lt; text", None) == "plain < text"
    assert H.main_text("<div class=ad>x<article><p>in</article>", None) == "in"
    assert H.main_text('<p title="a > b">t</p><p class=\'x">y</p>', None).startswith("t")
    assert H.main_text("<article>a<article class='comment'>b</article>c</article>d", None) == "a c"
    assert H.main_text("<main><p>x<script>if (a < b) {}</script>y</main>", None) == "x y"
    assert len(H.main_text("<p>" + "<b>w </b>" * 100_000, None)) == 199_999
    assert H.main_text("<" * 50_000 + "<p>a", None).endswith("a")


def test_query_cases(spark, tmp_path):
    rows = [(1, "http://H.org/a/1", ARTICLE), (2, None, None), (3, "http://h.org/a/2", ""), (None, "u", "<p>alone</p>")]
    rows += [(10 + i, f"http://t.org/news/{i:02}", template(i, f"<p>Story {i} text</p><p>More {i}</p>")) for i in range(6)]
    rows += [(20, "http://t.org/news/03?utm=1", rows[7][2]), (13, "http://t.org/news/03", rows[7][2])]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, TEXT string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = H.op7(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[1] == "Head & line Bold one Two three four <b> é" and by[2] == "" and by[3] == "" and by[None] == "alone"
    for i in range(6):
        assert by[10 + i] == f"Story {i} text More {i} Page {i}"
    assert by[20] == by[13]
    assert H.extract(pages.limit(0)).count() == 0 and H.extract(pages).columns == ["page_id", "url", "text", "n_chars"]


def texts_of(spark, pages):
    rows = spark.createDataFrame(list(pages.items()), "url string, html string")
    return {r.url: r.text for r in H.extract(rows).collect()}


def test_pages_with_articles_are_differenced(spark):
    whole = {f"http://a.org/{i}": f"<p>Site</p><article><h1>Title of {i}</h1><p>Share this page</p><p>Own text of page {i}</p></article>" for i in range(4)}
    cards = {f"http://b.org/{i}": f"<p>Site</p><p>The long main text of page {i}</p><article>Teaser {i}</article><article>Teaser</article>" for i in range(4)}
    got = texts_of(spark, whole | cards | {"http://c.org/": "<p>The main text</p><article>Card</article>"})
    for i in range(4):
        assert got[f"http://a.org/{i}"] == f"Title of {i} Own text of page {i}"
        assert got[f"http://b.org/{i}"] == f"The long main text of page {i} Teaser {i}"
    assert got["http://c.org/"] == "The main text Card"
    # passages that two articles share are no template
    quoted = {f"http://d.org/{i}": f"<article><p>Text {i} at some length</p>{'<p>A quoted passage</p>' if i in (1, 2) else ''}</article>" for i in range(4)}
    assert texts_of(spark, quoted)["http://d.org/1"] == "Text 1 at some length A quoted passage"


def test_copies_of_any_number_and_short_pages(spark, monkeypatch):
    menu = "".join(f"<p>Menu {k}</p>" for k in range(20))
    story = "".join(f"<p>Sentence {k} of the story</p>" for k in range(10))
    pages = {f"http://a.org/b/{i:02}": f"<p>Site name</p>{story}<p>View {i}</p>" for i in range(14)} | {f"http://a.org/b/{i:02}?x=1": f"<p>Site name</p>{story}<p>Same</p>" for i in range(20)}
    pages |= {"http://a.org/a": "<p>Site name</p><p>Another text altogether, long enough</p>", "http://a.org/c": "<p>Site name</p><p>A third text altogether, long enough</p>"}
    pages |= {f"http://s.org/{i}": f"{menu}<p>Item no {i}</p>" for i in range(9)}
    # near copies alone on a host say nothing about a template
    pages |= {f"http://n.org/{i}": f"{story}<p>{i}</p>" for i in range(4)}
    for each in (4000, 5, 1):
        monkeypatch.setattr(H, "PAGES_EACH", each)
        got = texts_of(spark, pages)
        for i in range(14):
            assert got[f"http://a.org/b/{i:02}"].startswith("Sentence 0") and got[f"http://a.org/b/{i:02}"].endswith(f"View {i}"), (each, i)
        assert all(got[f"http://a.org/b/{i:02}?x=1"].endswith("story Same") and got[f"http://a.org/b/{i:02}?x=1"].startswith("Sentence") for i in range(20))
        assert got["http://a.org/a"] == "Another text altogether, long enough" and got["http://a.org/c"] == "A third text altogether, long enough"
        assert all(got[f"http://n.org/{i}"].startswith("Sentence 0") for i in range(4))
        assert [got[f"http://s.org/{i}"] for i in range(9)] == [f"Item no {i}" for i in range(9)], each


def test_deletions_equal_brute_force(spark):
    # Each line is one of a kind on its page, so a longest common subsequence with lines in one order is all that both have.
    rng = random.Random(12)
    shared, pages = [f"Template line {k}" for k in range(12)], {}
    for i in range(40):
        host, marked = f"h{i % 3}.org", rng.sample(range(4), rng.randint(2, 4))
        plain = sorted(rng.sample(range(4, 12), rng.randint(2, 6)))
        own = [f"Own text {i} {k} of some length, enough to be no template" for k in range(8)]
        rows = [("nav", shared[k]) for k in sorted(marked)] + [("nav", f"Advert {i}")] + [("p", shared[k]) for k in plain] + [("p", x) for x in own]
        pages[f"http://{host}/{''.join(rng.choices('ab', k=6))}{i:02}"] = rows
    html = {u: "".join(f"<{t}>{x}</{t}>" for t, x in rows) for u, rows in pages.items()}
    got = texts_of(spark, html)
    for url, rows in pages.items():
        host, path = url[7:13], url[13:]
        near = sorted((u for u in pages if u[7:13] == host), key=lambda u: u[13:])
        at = near.index(url)
        sides = [near[k] for k in (at - 1, at + 1) if 0 <= k < len(near)]
        best = max(sides, key=lambda u: H._agreeing(u[13:], path))
        there = {x for _, x in pages[best]}
        assert got[url] == " ".join(x for t, x in rows if t == "p" and x not in there), url
    # differencing itself finds the menu's lines; an advert of one page is left to the list
    lines = [(u, u[7:13], u[13:], [H.hash_of(x) for _, x in r], [len(x) for _, x in r], [H.MARKED if t == "nav" else H.PLAIN for t, _ in r]) for u, r in pages.items()]
    table = spark.createDataFrame(lines, "key string, host string, path string, lines array<bigint>, sizes array<int>, kinds array<tinyint>")
    found = {r.key: set(r.deleted) for r in H.deletions(table, every=True).collect()}
    assert all(found[u] and all(pages[u][k][1] in shared for k in found[u]) for u in pages) and any(pages[u][k][0] == "nav" for u in pages for k in found[u])


def test_article_text_is_kept_whatever_its_classes():
    page = '<article><p>Lunch<div class="menu">Soup 3 euros</div><p class="notice-board">Open</p><ul id="share-prices"><li>ABC 12</ul><p>End</article><div class="menu">Home</div>'
    assert H.main_text(page, None) == "Lunch Soup 3 euros Open ABC 12 End"
    assert H.main_text('<article><p>a</p><div class="reader-comments"><p>no</p></div><aside>b</aside><p>c</p></article>', None) == "a c"


def test_sentences_amid_articles_are_no_template(spark):
    said = "<p>All figures are in millions of euros.</p>"
    pages = {f"http://e.org/{i:02}": f"<article><h1>Year {i}</h1><p>Sales of {i} grew much</p>{said}<p>Outlook {i} is good</p><p>Share</p></article>" for i in range(12)}
    got = texts_of(spark, pages)
    for i in range(12):
        assert got[f"http://e.org/{i:02}"] == f"Year {i} Sales of {i} grew much All figures are in millions of euros. Outlook {i} is good"


def test_differencing_alone_on_pages_without_marks(spark):
    """Pages of which no element, role or class tells anything: precision and recall of the text, in characters of lines."""
    rng, pages, want = random.Random(21), {}, {}
    word = lambda: "".join(rng.choices("abcdefghijklmno", k=rng.randint(2, 8)))
    for site in range(12):
        head, foot = [" ".join(word() for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(3, 12))], [" ".join(word() for _ in range(rng.randint(3, 12))) for _ in range(rng.randint(2, 6))]
        section = {k: [" ".join(word() for _ in range(2)) for _ in range(3)] for k in "xyz"}
        for i in range(25):
            own = [" ".join(word() for _ in range(rng.randint(5, 40))) for _ in range(rng.randint(2, 12))]
            k = rng.choice("xyz")
            url = f"http://site{site}.org/{k}/{i:02}"
            want[url] = own
            lines = [*head, *section[k], *own, *foot] if rng.random() < 0.9 else [*head[:-1], *section[k], *own, *foot[1:]]
            pages[url] = "".join(f"<div>{x}</div>" for x in lines)
    got = texts_of(spark, pages)
    kept = sum(len(x) for u, own in want.items() for x in own if x in got[u])
    precision, recall = kept / sum(len(t.replace(" ", "")) + t.count(" ") for t in got.values()), kept / sum(len(x) for own in want.values() for x in own)
    assert precision >= 0.95 and recall >= 0.95, (precision, recall)
