from html.parser import HTMLParser

from fieldweave.llm import html_extraction as html


def test_blocks_and_zones():
    page = """<html><body class="has-sidebar"><header>Head</header><div id="sideBar">x</div><div class="cookie-notice">c</div>
    <article class="post"><header><h1>T &amp; U</h1></header><p>a<b>b</b>  c&nbsp;d<br>e<p>x &lt;b&gt; y <!-- no <p> --> z<aside>q</aside>
    <div class="comments"><p>c1</div><ul><li>one<li>two</ul></article><p title="a>b">after<script>x="</p>"</script><p unfinished"""
    assert html.main_texts([page]) == ["T & U\nab c d e\nx <b> y z\none\ntwo\nafter"]  # what no mark tells is kept unless the host repeats it
    assert [b.text for b in html.blocks(page) if b.zone == html.NEUTRAL] == ["after"]


def test_boilerplate_of_a_host_without_article():
    page = "<div><a>Home of all things that we sell here today</a></div><div>{}</div><div>Copyright of the host all rights reserved by us forever</div>"
    one, two = page.format("Only this page has these words in it right now"), page.format("Quite another text stands on the second page of them")
    texts = html.main_texts([one, two, one, None, ""])
    assert texts == ["Only this page has these words in it right now", "Quite another text stands on the second page of them", "Only this page has these words in it right now", "", ""]
    assert len(html.main_texts([one])[0].split("\n")) == 3  # nothing repeats on one page alone


def test_blocks_beside_an_article_are_judged_by_repetition():
    page = "<div>Every page of this host has this very sentence in it</div><article><p>{0}</p><p>A passage that two articles share with one another here</p></article><div>{1}</div>"
    one, two = page.format("First article", "An afterword on one page only"), page.format("Second article", "Nothing like the other one")
    shared = "A passage that two articles share with one another here"
    assert html.main_texts([one, two]) == [f"First article\n{shared}\nAn afterword on one page only", f"Second article\n{shared}\nNothing like the other one"]


def test_repeated_by_brute_force():
    import numpy as np

    rng = np.random.default_rng(1)
    streams = [rng.integers(1, 4, rng.integers(0, 30)).astype(np.uint64) for _ in range(12)]
    least = 5
    got = html.repeated(streams, least)
    for i, s in enumerate(streams):
        covered = set()
        for at in range(len(s) - least + 1):
            run = s[at : at + least].tobytes()
            if any(run in {o[k : k + least].tobytes() for k in range(len(o) - least + 1)} for o in streams if o.tobytes() != s.tobytes()):
                covered.update(range(at, at + least))
        assert set(np.flatnonzero(got[i]).tolist()) == covered


class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.on, self.blocks, self.text = False, [], ""

    def flush(self):
        joined, self.text = " ".join(self.text.split()), ""
        if joined and self.on:
            self.blocks.append(joined)

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text += " "
        elif tag not in ("b", "i", "a"):
            self.flush()
        self.on = self.on or tag == "article"

    def handle_endtag(self, tag):
        if tag not in ("b", "i", "a"):
            self.flush()
        self.on = self.on and tag != "article"

    def handle_data(self, data):
        self.text += data


def test_pages_against_another_parser(spark, small):
    got = {r.page_id: (r.text, r.n_chars) for r in html.op2_host_suffix_array(spark, small).collect()}
    pages = spark.read.parquet(f"{small}/pages.parquet").collect()
    assert len(got) == len(pages)
    for page in pages:
        parser = Plain()
        parser.feed(page.html)
        parser.flush()
        text = "\n".join(parser.blocks)
        assert got[page.page_id] == (text, len(text))


def test_odd_rows(spark):
    odd = [(1, None, "<article>a</article>", 1), (2, "http://h.example/x", None, 2), (2, "http://h.example/x", None, 2), (None, "no url", "", 3), (4, "http://h.example/y", "<article>" + "<p>w " * 20000, 4)]
    pages = spark.createDataFrame(odd, "page_id long, url string, html string, host int")
    got = sorted(((r.page_id or 0, r.text[:3], r.n_chars) for r in html.extract(pages).collect()), key=str)
    assert got == sorted([(1, "a", 1), (2, "", 0), (2, "", 0), (0, "", 0), (4, "w\nw", 39999)], key=str)
    assert html.extract(pages.limit(0)).count() == 0


def test_repeats_are_found_over_the_whole_host(spark):
    notice = "Copyright of the host all rights reserved by us forever"
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(12))
    page = lambda i, n: f"<div>{own(i)}</div><div>{n}</div>"
    rows = [(i, f"http://h.example/{i}", page(i, notice if i in (3, 150) else f"only here {own(1000 + i)}")) for i in range(200)]
    rows += [(200 + i, f"http://h.example/a{i}", f"<article>{own(2000)} {own(2001)}</article>" if i else f"<div>{own(2001)}</div>") for i in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    wanted = dict(zip([r[0] for r in rows], html.main_texts([r[2] for r in rows])))
    assert wanted[3] == own(3) and wanted[150] == own(150) and wanted[200] == ""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("1", "16", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            assert {r.page_id: r.text for r in html.extract(pages).collect()} == wanted
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
