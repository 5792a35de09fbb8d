import html
import re
import zlib

from faktum.llm import html_extraction, page
from faktum.llm.html_extraction import extract, op9_html_extraction

SF = "/root/testdata/sf0.001"


def article(source):
    inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?p>|</?h1>", inner)]
    return "\n".join(b for b in blocks if b)


def test_whole_table(spark):
    pages = {p.page_id: p for p in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op9_html_extraction(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, article(pages[r.page_id].html), len(r.text))


def read_host(sources):
    """The texts of one host's pages."""
    read = [page.read(s) for s in sources]
    tree = read[0][1]
    for _, other in read[1:]:
        page.align(tree, other)
    per = page.content(tree)
    return [page.main_text(blocks, *map(frozenset, per[page.template_of(blocks)])) for blocks, _ in read]


def renamed(source, host):
    """The page with all containers as div elements of meaningless classes."""
    containers = "article main nav aside header footer section form div".split()

    def tag(m):
        end, name, rest = m[1], m[2].lower(), m[3]
        if name not in containers:
            return m[0]
        letters = "".join(chr(97 + int(c, 16)) for c in f"{zlib.crc32(f'{host}|{name}|{rest}'.encode()):x}")
        return "</div>" if end else f'<div class="{letters}">'

    return re.sub(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\"[^\"]*\"|[^>\"])*)>", tag, source)


def test_the_wrapper_decides(spark):
    """Tags and classes that say nothing leave the texts as they are; without the wrapper's slots there is no text."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    hosts = {}
    for p in pages:
        hosts.setdefault(p.url.partition("://")[2].partition("/")[0], []).append(p.html)
    same = total = 0
    for host, sources in hosts.items():
        if len(sources) < 5:  # a wrapper needs pages to compare
            continue
        plain, other = read_host(sources), read_host([renamed(s, host) for s in sources])
        assert plain == [article(s) for s in sources]
        same += sum(a == b for a, b in zip(plain, other, strict=True))
        total += len(sources)
    assert total > 50 and same >= 0.9 * total
    assert page.main_text(page.read(pages[0].html)[0], frozenset(), frozenset()) == ""


def test_long_lists_and_generated_classes():
    items = lambda k: "".join(f'<div class="c{i * k}x{i}"><p>item {i} of {k}</p></div><h{1 + i * k % 6}>t</h{1 + i * k % 6}>' for i in range(1500))
    got = read_host([f"<body><article>{items(k)}</article></body>" for k in (3, 7, 11)])
    assert all(t.count("item") == 1500 for t in got)


def text(*sources):
    read = [page.read(s) for s in sources]
    tree = read[0][1]
    for _, other in read[1:]:
        page.align(tree, other)
    main, varied = map(set, page.content_paths(tree))
    return [page.main_text(blocks, main, varied) for blocks, _ in read], page.expression(tree)


def test_wrapper_is_a_union_free_expression():
    shell = "<body><ul><li>x</ul><article><h1>{}</h1>{}</article><footer>f</footer>"
    _, wrapper = text(shell.format("a", "<p>1<p>2"), shell.format("b", "<p>3</p>"), shell.format("c", "<h2>s</h2><p>3</p><table><tr><td>1<td>2<tr><td>3</table>"))
    assert wrapper == "<body><ul><li>#</li></ul><article><h1>#</h1>(<h2>#</h2>)?(<p>#</p>)+(<table>(<tr>(<td>#</td>)+</tr>)+</table>)?</article><footer>#</footer></body>"


def test_what_is_no_article_goes():
    source = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><p>menu</nav><div class="cookie-notice">ok?</div>
    <main><article><h1>Head &amp; line</h1><script>var t="<p>no</p>"</script><p>One<br>two <a href="x>y">three</a> &#x41;&nbsp;B <!-- <p>no</p> --></p><aside>also</aside>
    <div id="advert_1"><p>buy</div><form><p>mail</form><blockquote>said</blockquote><pre>a
      b</pre><ul><li>i<li>ii</ul><section class="comments"><p>first!</section></article></main><footer>f</footer></body>"""
    assert text(source)[0] == ["Head & line\nOne two three A B\nsaid\na b\ni\nii"]


def test_without_article_elements():
    def shell(i):
        return f"<div class=top>Same on all</div><div class=links><a href=1>l{i}</a><a href=2>m{i}</a></div><div class=body><h2>title {i}</h2><p>{'words ' * 40}{i}</p><p>more {i}</p></div><div class=end>Same</div>"

    got, _ = text(*map(shell, range(5)))
    assert got[2] == f"title 2\n{'words ' * 40}2\nmore 2"


def test_broken_markup():
    for source in ("", "<", "<p", "<p>a", "a<b", "<!-- x", "<script>x", "</p></div>", "<p class='x>y</p>", "<article><p>a<nav>b", "&amp &#0; &bogus;", "<p>" * 3000, "<div>" * 3000 + "x", "\x00<p>\x00"):
        page.read(source)
    assert text("<article><p>a &amp b &am</p>")[0] == ["a & b &am"]


def test_odd_rows_and_split_hosts(spark, monkeypatch):
    rows = [(1, None, None), (2, "http://h/a", None), (3, "http://h/a", ""), (4, None, "<article><p>x</article>"), (4, None, "<article><p>x</article>"), (None, "http://h/", "<article>y</article>"), (5, "http://h/", "<p>" + "long " * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS main")
    monkeypatch.setattr(html_extraction, "BROADCAST_BYTES", -1)
    got = sorted(((r.page_id, r.text, r.n_chars) for r in extract(df).collect()), key=str)
    assert [r for r in got if r[0] != 5] == sorted([(1, "", 0), (2, "", 0), (3, "", 0), (4, "x", 1), (4, "x", 1), (None, "y", 1)], key=str)
    assert extract(df.limit(0)).collect() == []


def test_each_page_and_template_keeps_its_text():
    def shell(i):
        return f"<div class=top>Same on all</div><div class=body><h2>title {i}</h2><p>{'words ' * 40}{i}</p><p>more {i}</p></div><div class=end>Same</div>"

    alone = "<div class=top>Same on all</div><div class=body><p>only one</p></div>"
    got, _ = text(*map(shell, range(5)), alone, "<section><h1>one <b>h1</b></h1></section>")
    assert got[5:] == ["only one", "one h1"]
    assert got[4] == f"title 4\n{'words ' * 40}4\nmore 4"
    major = [f"<body><article><p>{'long text ' * 50}{i}</p></article></body>" for i in range(8)]
    minor = [f"<body><div class=c><h2>t {i}</h2><p>{'short ' * 9}{i}</p></div><div class=e>Same</div></body>" for i in range(3)]
    third = [f"<body><div class=d><h3>u {i}</h3><p>{'other ' * 30}{i}</p></div></body>" for i in range(3)]
    got, _ = text(*major, *minor, *third)
    assert got[9] == f"t 1\n{'short ' * 9}1" and got[12] == f"u 1\n{'other ' * 30}1" and got[2] == f"{'long text ' * 50}2"


def test_constant_texts_inside_articles_go():
    def shell(i):
        return f"<body><article><div>Share this with all of your friends</div><h1>t {i}</h1><p>first {i}</p><p>second {i}</p><p>Copyright by the owners of this site</p></article></body>"

    got, _ = text(*map(shell, range(6)))
    assert got[3] == "t 3\nfirst 3\nsecond 3"
    # one page read many times isn't many pages
    assert text(*[shell(1)] * 6)[0][0].startswith("Share this")


def run(spark, *sources, host="h"):
    """The texts that `extract` gives, in the order of the pages."""
    rows = [(k, f"http://{host}/{k}", source) for k, source in enumerate(sources)]
    return [r.text for r in sorted(extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect(), key=lambda r: r.page_id)]


def test_copies_of_an_article_keep_their_paragraphs(spark):
    """Pages of one host that share whole paragraphs, in few and in many pages, with and without article elements."""
    shared = ["The first of two paragraphs that all of the copies share.", "And the second one, which follows it on each of the pages."]
    for n in (3, 12):
        for tag in ("article", "div class=x7"):
            made = [f"<body><{tag}><h1>Head {i}</h1><p>{shared[0]}</p><p>{shared[1]}</p><p>Last line {i}</p></{tag.split()[0]}><div class=e>Same</div></body>" for i in range(n)]
            assert run(spark, *made) == [f"Head {i}\n{shared[0]}\n{shared[1]}\nLast line {i}" for i in range(n)], (n, tag)
    whole = [f"<body><nav><a>{i}</a></nav><article><h1>One head</h1><p>{shared[0]}</p><p>{shared[1]}</p></article></body>" for i in range(7)]
    assert run(spark, *whole) == [f"One head\n{shared[0]}\n{shared[1]}"] * 7


def test_classes_are_no_veto(spark):
    """Unlucky words in classes inside an article, on one page and on several; furniture of the same classes goes."""
    inside = "<h1>Head {i}</h1><div class='share-price'>Price {i}</div><div class='related-work'><p>Work {i}</p></div><p class='notice'>Note {i}</p><p>Text {i}</p>"
    want = "Head {i}\nPrice {i}\nWork {i}\nNote {i}\nText {i}"
    for n in (1, 6):
        assert run(spark, *(f"<body><article>{inside.format(i=i)}</article></body>" for i in range(n))) == [want.format(i=i) for i in range(n)]
    doubted = [f"<body><article><h1>Head {i}</h1><div class=notice>Note {i} of this story</div><div class=share>Share this story</div><div class=related><a href=x>Other {i}</a></div><p>Text {i}</p><div class=ad>Buy {i}</div><section class=comments><p>Me {i}</p></section></article></body>" for i in range(6)]
    assert run(spark, *doubted) == [f"Head {i}\nNote {i} of this story\nText {i}" for i in range(6)]


def test_switching_slots_off_changes_texts(spark, monkeypatch):
    """With tags in place: without what its slots say, a template has all that tags and classes allow."""
    made = [f"<body><article><div>Share this with all of your friends</div><h1>Head {i}</h1><div class=notice>Note {i}</div><p>Text {i}</p></article></body>" for i in range(6)]
    told = run(spark, *made)
    assert told == [f"Head {i}\nNote {i}\nText {i}" for i in range(6)]
    monkeypatch.setattr(page, "align", lambda a, b, same_page=False: a.templates.update({t: {p: list(x) for p, x in own.items()} for t, own in b.templates.items()}))
    assert read_host(made)[0] != told[0]


def test_a_line_whose_count_falls_short_is_counted_again(spark):
    """A line of the site on 104 of 129 pages, barely enough, that goes and comes again while texts are counted."""
    line = "Read all our stories every morning."
    pages = []
    for k in range(129):
        own = [f"Paragraph {j} of page {k}, which no other has." for j in range(40)]
        own[20:20] = [line] if k == 0 or k > 25 else []
        pages.append((k, "http://one.example/", "<div>" + "".join(f"<p>{x}</p>" for x in own) + "</div>"))
    trees = [page.read(x)[1] for *_, x in pages]
    tree = trees[0]
    for other in trees[1:]:
        page.align(tree, other)
    assert page.unsure(tree) == {page.hash_of(line)}
    trees = [page.read(x)[1] for *_, x in pages]
    for x in trees:
        x.pinned = frozenset({page.hash_of(line)})
        if x is not trees[0]:
            page.align(trees[0], x)
    assert not page.unsure(trees[0]) and page.content_paths(trees[0])[0] == [page.key_of("/div/p", page.hash_of(line))]
    got = extract(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)).collect()
    assert len(got) == 129 and all(line not in r.text and r.text.count("\n") == 39 for r in got)


def test_bounds_of_counts_hold():
    """In any order of merging, what a text has lies between its count and what it can have; pinned texts are counted whole."""
    import random

    rng = random.Random(3)
    for _ in range(20):
        pages = [[f"text {rng.choice((rng.randrange(60), rng.randrange(10_000)))}" for _ in range(rng.randrange(1, 30))] for _ in range(120)]
        pinned = frozenset(page.hash_of(f"text {k}") for k in range(0, 60, 7))
        trees = [page.read("<div>" + "".join(f"<p>{x}</p>" for x in own) + "</div>")[1] for own in pages]
        for t in trees:
            t.pinned = pinned
        while len(trees) > 1:
            a, b = trees.pop(rng.randrange(len(trees))), trees.pop(rng.randrange(len(trees)))
            page.align(a, b)
            trees.append(a)
        (slot,) = (x for x in page._slots(trees[0]))
        true = {}
        for own in pages:
            for x in {page.hash_of(x) for x in own}:
                true[x] = true.get(x, 0) + 1
        assert slot.pages == 120 and slot.lost * page.RARE <= slot.pages
        for x, n in true.items():
            least, *_, more = slot.texts.get(x, (0, slot.lost))
            assert least <= n <= least + more and (x not in pinned or (least, more) == (n, 0))
