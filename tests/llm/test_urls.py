"""Path templates against a plain tree, rules, and odd urls."""

import random
from collections import defaultdict

from loanloom.llm import urls
from loanloom.llm.urls import Rule


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [i for i, c in enumerate(rest) if c in "?#"] + [len(rest)]
    rest = rest[: min(ends)]
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


def plain_templates(rows):
    """(host, path, good) rows to templates, one node and one level after the other."""
    found = [None] * len(rows)

    def grow(members, template, level):
        if len(members) < urls.LEAST_PAGES:
            for i, segments in members:
                found[i] = template + ("/**" if level < len(segments) else "")
            return
        children = defaultdict(list)
        for i, segments in members:
            if level == len(segments):
                found[i] = template
            else:
                children[segments[level]].append((i, segments))
        counts = defaultdict(lambda: [0, 0])
        named = {}
        for segment, own in children.items():
            stays = len(own) >= urls.LEAST_PAGES and len(own) * urls.MOST_BRANCHES >= len(members)
            named[segment] = segment if stays else None
            for i, _ in own:
                counts[named[segment]][0] += rows[i][2] is not None
                counts[named[segment]][1] += rows[i][2] is True
        texts = urls.merged_branches({s: tuple(c) for s, c in counts.items()})
        groups = defaultdict(list)
        for segment, own in children.items():
            groups[texts[named[segment]]] += own
        for text, own in groups.items():
            grow(own, f"{template}/{text}", level + 1)

    hosts = defaultdict(list)
    for i, (host, path, _) in enumerate(rows):
        hosts[host].append((i, path.split("/")[1:] if path else []))
    for own in hosts.values():
        grow(own, "", 0)
    return found


def verdicts(rows, templates):
    counts = defaultdict(lambda: [0, 0])
    for (host, _, good), template in zip(rows, templates):
        for key in ((), (host,), (host, template)):
            counts[key][0] += good is not None
            counts[key][1] += good is True
    overall = (counts[()][1] + 1) / (counts[()][0] + 2)

    def purity(host, template):
        of_host = (counts[(host,)][1] + urls.WEIGHT * overall) / (counts[(host,)][0] + urls.WEIGHT)
        return (counts[host, template][1] + urls.WEIGHT * of_host) / (counts[host, template][0] + urls.WEIGHT)

    return [purity(host, template) for (host, _, _), template in zip(rows, templates)]


def pages_of(draw):
    rows = []
    for i in range(1500):
        host = draw.choice(["A.example.org", "b.example.com", "b.example.com", f"h{draw.randrange(90)}.net"])
        kind = draw.choice(["news", "shop", "spam", "forum"])
        path = {
            "news": f"/site/{draw.choice(['de', 'fr'])}/news/{draw.randrange(10**6)}",
            "shop": f"/site/shop/{draw.choice(['a', 'b', 'c*'])}/item-{draw.randrange(10**6)}.html",
            "spam": f"/site/offers/{draw.randrange(40)}/x/{draw.randrange(10**6)}/",
            "forum": draw.choice(["", "/", "/site", "/site/forum"]),
        }[kind]
        good = None if draw.random() < 0.3 else (draw.random() < (0.1 if kind == "spam" else 0.9))
        rows.append((i, f"{draw.choice(['http', 'https'])}://{host}{path}{draw.choice(['', '?q=/a/b', '#x'])}", good))
    return rows + [(2000 + i, f"http://deep.net/a/very/long/path/that/all/share/{i}.html", None) for i in range(20)]


def test_templates_and_verdicts(spark):
    made = pages_of(random.Random(3)) + [(9000, None, None), (9001, "no scheme", True), (9002, "://", None), (None, "http://q.net/", True)]
    pages = spark.createDataFrame([(i, u, "clash") for i, u, _ in made], "page_id long, url string, template string").repartition(5)
    labels = spark.createDataFrame([(i, g) for i, _, g in made if g is not None], "page_id long, is_good boolean")
    rows = [(*split(u), g if i is not None else None) for i, u, g in made]
    templates = plain_templates(rows)
    want = {
        (i, h, p, t, round(purity, 9), "allow" if purity >= urls.PURE else "block")
        for (i, _, _), (h, p, _), t, purity in zip(made, rows, templates, verdicts(rows, templates))
    }
    got = urls.filter_urls(pages, labels).collect()
    assert len(got) == len(made) and all(r.rule is None for r in got)
    assert {(r.page_id, r.host, r.path, r.template, round(r.purity, 9), r.verdict) for r in got} == want
    large = [r for r in got if "example" in r.host]
    assert {r.verdict for r in large if "/offers/" in r.path} == {"block"}
    assert {r.verdict for r in large if "/news/" in r.path} == {"allow"}
    assert any(t == "/a/very/long/path/that/all/share/*" for t in templates)


def test_rules(spark):
    rules = [
        Rule("org", "/", True), Rule("example.org", "/es/", False), Rule("example.org", "/en/1", False), Rule("com", "/fr/", True),
    ]
    given = {
        "http://x.org": None, "http://x.org/": "org/", "http://org/a": "org/", "http://xorg/a": None, "HTTP://WWW.Example.ORG/es/1": "example.org/es/",
        "http://badexample.org/es/1": "org/", "http://example.org/en/17?x": "example.org/en/1", "http://example.org/en/2": "org/",
        "ftp://a.b.com/fr/://x": "com/fr/", "http://a.com/FR/": None, "http://K.org/": "org/", None: None, "": None, "a.org/": None,
    }
    pages = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    labels = spark.createDataFrame([], "page_id long, is_good boolean")
    got = {r.page_id: r for r in urls.filter_urls(pages, labels, rules).collect()}
    allows = {r.text: r.allow for r in rules}
    for i, (url, rule) in enumerate(given.items()):
        assert (got[i].host, got[i].path, got[i].rule) == (*split(url), rule)
        assert got[i].verdict == ("allow" if allows.get(rule, True) else "block") and got[i].purity == 0.5


def test_contradicting_labels_and_repeated_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.b/x"), (1, "http://a.b/x"), (None, "http://a.b/x")], "page_id long, url string")
    labels = spark.createDataFrame([(1, True), (1, False), (None, True), (7, True)], "page_id long, is_good boolean")
    got = urls.filter_urls(pages, labels).collect()
    assert len(got) == 3 and len({r.purity for r in got}) == 1 and got[0].purity < 0.5


def test_many_templates_are_shuffled(spark, monkeypatch):
    from loanloom.llm import common

    pages = spark.createDataFrame([(i, f"http://h{i % 3}.net/a/{i % 2}/{i}") for i in range(200)], "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2 == 0) for i in range(200)], "page_id long, is_good boolean")
    want = sorted(map(str, urls.filter_urls(pages, labels).collect()))
    monkeypatch.setattr(common, "BROADCAST_IDS", 1)
    assert sorted(map(str, urls.filter_urls(pages, labels).collect())) == want
    assert len({r.split("template=")[1] for r in want}) > 2


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    labels = spark.createDataFrame([], "page_id long, is_good boolean")
    assert urls.filter_urls(none, labels, [Rule("org", "/", True)]).collect() == []
