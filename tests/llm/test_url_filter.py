from pantry.llm import url_filter as U

PAGE = '<html><head><link href="{}" rel="canonical"></head></html>'


def judged(spark, rows, **parameters):
    df = spark.createDataFrame([(*r, "r") for r in rows], "page_id long, url string, html string, rule string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(df, **parameters).collect()}


def test_rules(spark):
    rows = [
        (1, "http://A.example.ORG/es/x?y#z", None), (2, "http://example.org/en/12", ""), (3, "http://notexample.org/es/", ""), (4, "x://a.com/fr/1", ""),
        (5, "x://com/de/", ""), (6, "x://a.com/fr", ""), (7, None, "x"), (8, "no scheme", ""), (9, "http://a.org", ""), (10, "http://a.org?x/", ""), (11, "a://b://c.org/es/", ""),
    ]
    want = {
        1: ("a.example.org", "/es/x", "example.org/es/", "block"), 2: ("example.org", "/en/12", "example.org/en/1", "block"),
        3: ("notexample.org", "/es/", "org/", "allow"), 4: ("a.com", "/fr/1", "com/fr/", "allow"), 5: ("com", "/de/", "com/de/", "block"),
        6: ("a.com", "/fr", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("a.org", "", None, "allow"),
        10: ("a.org", "", None, "allow"), 11: ("b:", "//c.org/es/", None, "allow"),
    }
    assert judged(spark, rows) == want
    many = list(U.RULES) + [("block", f"h{i}.test", "/") for i in range(U.INLINE_RULES)]
    assert judged(spark, rows, rules=many) == want
    assert judged(spark, rows + [(12, "http://www.h7.test/", "")], rules=many)[12][2:] == ("h7.test/", "block")
    assert judged(spark, []) == {}


def test_blocks_reach_aliases_unless_one_is_allowed(spark):
    rows = [
        (1, "http://a.net/1", PAGE.format("http://b.com/de/1")),
        (2, "http://c.net/2", '<META content="0; url=http://a.net/1" http-equiv=refresh>'),
        (3, "http://d.net/x/3", PAGE.format("4")),
        (4, "http://d.net/x/4", PAGE.format("//e.com/de/")),
        (5, "http://d.net/5", PAGE.format("/x/4")),
        (6, "http://f.org/ok", PAGE.format("http://d.net/x/4")),
        (7, "http://g.net/7", PAGE.format("http://h.net/8")),
        (7, "http://g.net/7", PAGE.format("http://h.net/8")),
    ]
    got = {k: v[3] for k, v in judged(spark, rows).items()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow"}
    got = {k: v[3] for k, v in judged(spark, rows[:5]).items()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block"}
    more = spark.createDataFrame([("http://h.net/8", "http://z.com/de/9")], "src string, dst string")
    assert judged(spark, rows, more_edges=more)[7][3] == "block"


def links(spark, rows):
    df = spark.createDataFrame(rows, "url string, html string")
    return {(r.u, r.v) for r in U.link_edges(df).collect()}


def test_links_are_what_a_parser_reads(spark):
    """Every link of a page, against Python's HTML parser and its joining of urls."""
    from html.parser import HTMLParser
    from urllib.parse import urldefrag, urljoin, urlsplit

    targets = [
        "http://x.net/p?a=1&amp;b=2", "../z", "./y/../z", "../../../up", "/abs/./q", "//other.net/k", "?only=query", "#part", "deep/er/", "..", "http://X.net/a&#x2F;b", "&#104;ttp://h.net/&#38;c",
        "http://x.net/&#233;&#x1F600;", "http://x.net/&amp;amp;lt;", "mailto:a@b.c", " /spaces ", "x.html#frag", "a&quot;b", "http://y.net/&lt;&gt;", "q?u=http://z.net/..", "", "&#380;x", "&#38;#97;",
    ]
    pages = ["http://d.net/x/y/3?k=v", "http://D.net", "https://d.net/only"]
    rows = []
    for page in pages:
        for t in targets:
            rows += [(page, PAGE.format(t)), (page, f"<LINK REL='nofollow Canonical' data-href='no' HREF='{t}'>"), (page, f'<meta http-equiv="refresh" content="0; URL={t}">')]
    rows += [
        (pages[0], PAGE.format("one") + PAGE.format("two")), (pages[0], "<!-- " + PAGE.format("hidden") + " -->"), (pages[0], '<meta http-equiv=refresh content="900; url=late">'),
        (pages[0], '<meta content="0;url=soon" http-equiv=refresh>'), (pages[0], "<link rel=canonical href=bare>"), (pages[0], '<link rel="alternate" href="canonical">'), (pages[0], None), (None, PAGE.format("x")), ("no scheme", PAGE.format("x")),
    ]

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            a = {k: v or "" for k, v in attrs}
            if tag == "link" and "canonical" in a.get("rel", "").lower().split():
                self.found.append(a.get("href", ""))
            content = a.get("content", "").strip()
            if tag == "meta" and a.get("http-equiv", "").lower() == "refresh" and content.split(";")[0].strip() == "0":
                self.found.append(content.partition("=")[2].partition('"')[0])

        handle_startendtag = handle_starttag

    def node(url):
        s = urlsplit(url)
        return s.netloc.lower() + (s.path or "/") + ("?" + s.query if s.query else "")

    want = set()
    for page, html in rows:
        if page is None or html is None or "://" not in page:
            continue
        reader = Reader()
        reader.found = []
        reader.feed(html)
        for t in reader.found:
            full = urldefrag(urljoin(page, t.strip()))[0]
            if t.strip() and "://" in full and node(full) != node(page):
                want.add((node(page), node(full)))
    assert links(spark, rows) == want


def test_blocks_over_links_against_brute_force(spark):
    import random

    rng = random.Random(4)
    names = [f"http://h{i}.{rng.choice(['net', 'com', 'org'])}/{rng.choice(['de', 'fr', 'x'])}/{i}?a={i}&b=1" for i in range(60)]
    pages = [(i, n, "".join(PAGE.format(rng.choice(names).replace("&", "&amp;")) for _ in range(rng.choice([0, 0, 1, 2])))) for i, n in enumerate(names)]
    near = {n: {n} for n in names}
    for _, n, html in pages:
        for t in html.split('href="')[1:]:
            t = t.split('"')[0].replace("&amp;", "&")
            near[n].add(t)
            near[t].add(n)
    said = {n: U_verdict(n) for n in names}
    got = judged(spark, pages)
    for i, n, _ in pages:
        reach, work = {n}, [n]
        while work:
            for m in near[work.pop()] - reach:
                reach.add(m)
                work.append(m)
        kinds = {said[m] for m in reach}
        assert got[i][3] == (said[n] or ("block" if "block" in kinds and "allow" not in kinds else "allow")), n


def U_verdict(url):
    host, _, path = url.partition("://")[2].partition("/")
    hits = [(len(h + p), v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and ("/" + path.partition("?")[0]).startswith(p)]
    return max(hits)[1] if hits else None
