from tesselar.llm import wrappers as op


def page(i, body, extra=""):
    return f"<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=x>Home</a></li><li>About {i}</li></ul></nav><div class='ad'>Buy {i}</div><article><h1>Title {i}</h1>{body}</article>{extra}<footer>&copy; site {i}</footer></body></html>"


def test_articles():
    pages = [page(i, f"<p>One &amp; {i}<br>more</p><p><b>Two</b>{' three' * i}" + "<p>again</p>" * i, "<div id='comments'><p>first!</p></div>" * (i % 2)) for i in range(5)]
    w = op.infer(pages)
    assert any(n["shape"].endswith(")+") for n in w.nodes) and any(n["optional"] for n in w.nodes)
    halves = op.infer(pages[:2]).merge(op.Wrapper.load(op.infer(pages[2:]).dump()))
    assert [n["shape"] for n in halves.nodes] == [n["shape"] for n in w.nodes] and halves.bodies == w.bodies
    w = w.rules()
    for i, p in enumerate(pages):
        want = [f"Title {i}", f"One & {i} more", "Two" + " three" * i] + ["again"] * i
        assert op.extract(p, w) == "\n\n".join(want)


def test_unmarked_pages_by_what_changes():
    long = "Words that fill a line until it counts as running text and not as a label, number {}, and a little more."
    pages = [f"<body><div class=x>Site name</div><h2>About {i}</h2><div>{long.format(i)}</div><p>Short {i}</p><div>{long.format(i + 50)}</div><div>The same notice stands on every page of this site and it is long enough to look like running text.</div></body>" for i in range(4)]
    w = op.infer(pages).rules()
    assert op.extract(pages[2], w) == "\n\n".join(["About 2", long.format(2), "Short 2", long.format(52)])


def test_mending():
    none = op.Wrapper().rules()
    assert op.extract("<article><p>a<p>b<div>c", none) == "a\n\nb\n\nc"
    assert op.extract("<article><p>a</div></p><script>x</article>", none) == "a"
    assert op.extract("<main>1 &lt; 2 &#233;&nbsp;x < y</main>", none) == "1 < 2 é x < y"
    assert op.extract("<article><!-- <p>no</p> --><p hidden>no</p><p>yes</p><form>no</form><aside>no</aside></article>", none) == "yes"
    assert op.extract("", none) == op.extract("<<<>>>", none).replace("<<<>>>", "") == ""


def test_hosts_and_tables(spark):
    rows = [(i, f"https://User@Example.com:80/{i}", page(i, f"<p>Text {i}</p>"), 1, "x") for i in range(20)]
    rows += [(20, None, page(20, "<p>alone</p>"), None, None), (21, "no host", "", 1, ""), (22, "http://a.b/", None, 1, ""), (None, "http://a.b/", page(3, "<p>z</p>"), 1, ""), (5, "https://example.com/5", page(5, "<p>Text 5</p>"), 1, "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, host int, wrapper string").repartition(3)
    got = op.extract_pages(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert all(by[i] == f"Title {i}\n\nText {i}" for i in range(20))
    assert by[20] == "Title 20\n\nalone" and by[21] == by[22] == "" and by[None] == "Title 3\n\nz"
    assert op.extract_pages(df.limit(0)).collect() == []
    from pyspark.sql import functions as F

    assert df.where("page_id = 1").select(op.host(F.col("url"))).first()[0] == "example.com"


def test_marked_page_among_unmarked(spark):
    long = "Words that fill a line until it counts as running text and not as a label, number {}, and a little more."
    plain = [f"<body><div class=x>Site name</div><h2>About {i}</h2><div>{long.format(i)}</div><div>{long.format(i + 50)}</div></body>" for i in range(4)]
    marked = page(9, "<p>Marked nine</p>")
    want = [f"About {i}\n\n{long.format(i)}\n\n{long.format(i + 50)}" for i in range(4)] + ["Title 9\n\nMarked nine"]
    w = op.infer([*plain, marked]).rules()
    assert [op.extract(p, w) for p in [*plain, marked]] == want
    for url in ("http://a.b/x", None):
        df = spark.createDataFrame([(i, url, p) for i, p in enumerate([*plain, marked])], "page_id bigint, url string, html string")
        assert [r.text for r in op.extract_pages(df).orderBy("page_id").collect()] == want


def test_short_blocks_of_unmarked_pages():
    def dialogue(i):
        return [f"Scene {i}", *[f"A{i}{k}: yes." for k in range(6)]]

    def short(i, tail):
        head, *lines = dialogue(i)
        return f"<body><div class=x>Site name</div><div class=text><h2>{head}</h2>{''.join(f'<p>{x}</p>' for x in lines)}{tail}</div><div class=teasers><div>Next {i + 1}</div></div></body>"

    tails = ["", "<ul><li>one flour</li><li>two eggs</li></ul>", "<blockquote>the end, {}</blockquote>", "<table><tr><td>1</td><td>2</td></tr></table>"]
    last = [[], ["one flour", "two eggs"], ["the end, {}"], ["1", "2"]]
    pages = [short(i, t) for i, t in enumerate(tails)]
    w = op.infer(pages).rules()
    for i, p in enumerate(pages):
        assert op.extract(p, w) == "\n\n".join(dialogue(i) + last[i])
    cjk = [f"<body><p>前{i}</p><p>短{i}</p><p>{'文字' * 30}{i}</p><ul><li>終{i}</li></ul><div>© 站</div></body>" for i in range(3)]
    w = op.infer(cjk).rules()
    assert op.extract(cjk[1], w) == "\n\n".join(["前1", "短1", "文字" * 30 + "1", "終1"])
    parts = [f"<body><div class=post><h1>T{i}</h1><div class=s><p>a{i}</p><p>{'b' * 50}{i}</p></div><div class=s><p>c{i}</p></div></div></body>" for i in range(3)]
    assert op.extract(parts[0], op.infer(parts).rules()) == "\n\n".join(["T0", "a0", "b" * 50 + "0", "c0"])


def test_names_that_do_not_silence_an_article():
    none = op.Wrapper().rules()
    for top in ("<body class='has-sidebar'>", "<body class='no-sidebar with-header'>", "<body class='sidebar'>", "<body><div class='content has-sidebar'>", "<body><div id='sidebar-layout'>"):
        assert op.extract(f"{top}<nav>menu</nav><article><h1>Title</h1><p>Text</p><div class='share'>Share</div></article><div class='sidebar'>side</div>", none) == "Title\n\nText", top
    assert op.extract("<article><header><h1>Title</h1><p>by line</p></header><p>Text</p><footer>end</footer></article><header><h1>Site</h1></header>", none) == "Title\n\nText"
    assert op.extract("<article><p>Text</p></article><div class='comments'><article class='comment'><p>first!</p></article></div>", none) == "Text"


def unhinted(i):
    """A page of plain blocks whose article is short and whose links, which change too, are long."""
    links = "".join(f"<div><span>Link {i} {k} to a page with a rather long name</span></div>" for k in range(3))
    text = ["Short."] if i == 0 else [f"Paragraph {k} of page {i} " + "with running text " * 12 for k in range(4)]
    blocks = "".join(f"<p>{x}</p>" for x in text)
    return f"<body><div class=x1><div>Site</div>{links}</div><div class=x2><h2>Page {i}</h2>{blocks}</div><div class=x3><div>Made {i} with care</div></div></body>", "\n\n".join([f"Page {i}", *(x.strip() for x in text)])


def test_hosts_without_hints_need_their_wrapper():
    pages, want = zip(*(unhinted(i) for i in range(6)), strict=True)
    rules, none = op.infer(list(pages)).rules(), op.Wrapper().rules()
    assert [op.extract(p, rules) for p in pages] == list(want)
    assert op.extract(pages[0], none) != want[0]  # alone, its links look like the article


def story(i, k=4):
    return [f"Story {i}", *(f"Paragraph {j} of story {i} " + "with its own words " * (5 + i) for j in range(k))]


def blocks_of(i):
    head, *rest = story(i)
    return f"<h1>{head}</h1>" + "".join(f"<p>{x.strip()}</p>" for x in rest)


CARD = "<article class='card'><h3>Card {0} {1}</h3><p>See {0} {1}</p></article>"
HOSTS = {
    "lines.in.main": lambda i: f"<body><main><p>You are reading the daily</p>{blocks_of(i)}<p>Sign up to our letter today</p></main></body>",
    "cards.beside": lambda i: f"<body><div><article>{blocks_of(i)}</article></div><section>{''.join(CARD.format(i, k) for k in range(1 + i % 3))}</section></body>",
    "both": lambda i: f"<body><article>{blocks_of(i)}<div>All rights reserved by us</div></article><div>{''.join(CARD.format(i, k) for k in range(2 - i % 2))}</div></body>",
    "unmarked": lambda i: f"<body><div class=x1><div>Site</div>{''.join(f'<div><span>Link {i} {k} to a page with a rather long name</span></div>' for k in range(3))}</div><div class=x2>{blocks_of(i)}</div><div class=x3><div>Made {i} with care</div></div></body>" if i else "<body><div class=x1><div>Site</div><div><span>Link 0 0 to a page with a rather long name</span></div><div><span>Link 0 1 to a page with a rather long name</span></div><div><span>Link 0 2 to a page with a rather long name</span></div></div><div class=x2><h1>Story 0</h1><p>Short.</p></div><div class=x3><div>Made 0 with care</div></div></body>",
    "mixed": lambda i: f"<body><main><p>You are reading the daily</p>{blocks_of(i)}</main></body>" if i % 2 else f"<body><div class=x1>Site {i}</div><main><p>You are reading the daily</p><div>{blocks_of(i)}</div></main></body>",
    None: lambda i: f"<body><main><p>No address, one line for all</p>{blocks_of(i)}</main></body>",
}


def wanted(host, i):
    return "\n\n".join(["Story 0", "Short."] if host == "unmarked" and i == 0 else [x.strip() for x in story(i)])


def test_texts_come_through_the_wrapper(spark):
    """Right with the host's wrapper, wrong with an empty one, on every host."""
    none, rows = op.Wrapper().rules(), []
    for host, make in HOSTS.items():
        pages = [make(i) for i in range(6)]
        rules = op.infer(pages).rules()
        assert [op.extract(p, rules) for p in pages] == [wanted(host, i) for i in range(6)], host
        assert any(op.extract(p, none) != wanted(host, i) for i, p in enumerate(pages)), host
        rows += [(len(rows) + i, host and f"https://{host}/{i}", p) for i, p in enumerate(pages)]
    got = {r.page_id: r.text for r in op.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)).collect()}
    assert got == {6 * n + i: wanted(host, i) for n, host in enumerate(HOSTS) for i in range(6)}


def test_what_the_wrapper_must_leave():
    cards = [f"<body>{''.join(CARD.format(i, k) for k in range(4))}</body>" for i in range(5)]  # a list of articles is the page's text
    rules = op.infer(cards).rules()
    assert op.extract(cards[2], rules) == "\n\n".join(t for k in range(4) for t in (f"Card 2 {k}", f"See 2 {k}"))
    same = [f"<body><div>{i}</div><article>{blocks_of(1)}</article></body>" for i in range(5)]  # one article on pages that differ elsewhere
    assert op.extract(same[3], op.infer(same).rules()) == wanted("", 1)
    two = [f"<body><article>{blocks_of(i)}<p>a line of both</p></article></body>" for i in range(2)]  # too few pages to tell
    assert op.extract(two[0], op.infer(two).rules()) == wanted("", 0) + "\n\na line of both"


def accepts(wrapper, shapes):
    """Whether the wrapper, as a regular expression of optional nodes and groups, matches shapes: by trying every way."""
    spots = {0}
    for node in wrapper.nodes:
        body, found = node["body"], set()
        for at in spots:
            end = at
            while shapes[end : end + len(body)] == body:
                end += len(body)
                found.add(end)
                if node["shape"][0] != "(":
                    break
        spots = found | spots if node["optional"] else found
    return len(shapes) in spots


def test_wrappers_match_their_pages_by_brute_force():
    import random

    r = random.Random(4)
    for _ in range(30):
        pages = ["<body>" + "".join(r.choice(["<div>a</div>", "<p>b</p>", "<ul>" + "<li>c</li>" * r.randrange(1, 4) + "</ul>", "<h2>d</h2>", "text"]) for _ in range(r.randrange(1, 7))) for _ in range(4)]
        wrapper = op.infer(pages)
        for p in pages:
            assert accepts(wrapper, [op.shape(t) for t in op.stream(p)])


def test_wrappers_stay_bounded(monkeypatch):
    monkeypatch.setattr(op, "SUPPORT", 2)
    pages = [f"<body><div class=x>Site</div><div class=t><p>Text {i} {'words ' * 30}</p><p>More {i} {'words ' * 30}</p></div>" + "".join(f"<div class=c{i}-{k}><b>one {i} {k}</b></div>" for k in range(30)) + "</body>" for i in range(12)]
    wrapper = op.infer(pages)
    assert len(wrapper.nodes) <= 3 * 90 + 20 < 12 * 90  # what one page alone has leaves two pages later
    halves = op.infer(pages[:6]).merge(op.infer(pages[6:]))
    assert halves.pages == wrapper.pages == 12 and len(halves.nodes) <= 3 * 90 + 20
    got = op.extract(pages[5], wrapper.rules())
    assert f"Text 5 {'words ' * 30}".strip() in got and "Site" not in got


def test_groups_longer_than_the_limit():
    row = "<section>" + "".join(f"<h3>h{k} {{0}}</h3><p>text {k} {{0}} and more of it</p>" for k in range(9)) + "</section>"
    pages = [f"<body><div class=x>Site</div><div class=y>{''.join(row.format(f'{i}.{n}') for n in range(i + 1))}</div></body>" for i in range(3)]
    rules = op.infer(pages).rules()
    for i, p in enumerate(pages):
        assert op.extract(p, rules) == "\n\n".join(t for n in range(i + 1) for k in range(9) for t in (f"h{k} {i}.{n}", f"text {k} {i}.{n} and more of it"))


def test_very_long_page():
    body = "".join(f"<p>Paragraph {k}</p><table><tr><td>{k}</td></tr></table>" for k in range(20000))
    assert op.extract(f"<article>{body}</article>", op.infer([f"<article>{body}</article>", "<article><p>x</p></article>"]).rules()).count("\n\n") == 39999


def test_query_has_the_columns_asked_for(spark, tmp_path):
    spark.createDataFrame([(i, f"http://a.b/{i}", page(i, "<p>x</p>")) for i in range(3)], "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = op.op7_wrapper_extraction(spark, str(tmp_path))
    assert [(f.name, f.dataType.simpleString()) for f in got.schema.fields] == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")] and got.count() == 3
