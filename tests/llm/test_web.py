import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from moraine.llm import urlfilter, warc

URLS = [
    ("https://A.b.org:8080/x?y=1#z", "org,b,A)/x?y=1".lower()), ("http://me@h.com", "com,h)/"), ("http://h.com?q", "com,h)/?q"), ("HTTPS://H.com/A%20b", "com,h)/A%20b"), ("no scheme", ")no scheme"),
    ("http://t.org/a\tb\nc", "org,t)/a\tb\nc"), ("", ")/"),
]


def test_keys(spark):
    rows = spark.createDataFrame([(u,) for u, _ in URLS], "url string")
    assert [r.k for r in rows.select(warc.url_key(F.col("url")).alias("k")).collect()] == [k for _, k in URLS]


def test_as_sql_has_it(spark, small, duck):
    got, want = warc.op5_warc_index(spark, small).toPandas(), duck.sql(warc.ORACLE["op5_warc_index"]).df()
    order = sorted(got.columns)
    assert got[order].sort_values("page_id").reset_index(drop=True).equals(want[order].sort_values("page_id").reset_index(drop=True))


def test_records_round_trip():
    for body in (b"", b"x" * 100_000, b"a\r\n\r\nb", "é".encode()):
        assert warc.payload(warc.record("1", "http://a/\r\n", body)) == body


@pytest.mark.parametrize("lines", [1, 2, 7])
def test_look_ups_in_small_blocks(spark, monkeypatch, lines):
    """Many blocks and shards, keys that go over the ends of blocks, odd keys and rows."""
    folder = [(i, f"http://h{i % 5}.org/p{i % 13}", f"body {i}") for i in range(150)] + [(200 + i, u, "") for i, (u, _) in enumerate(URLS)] + [(300, None, "x"), (None, "http://null.org/", None), (7, "http://h2.org/p7", "twice")]
    pages = spark.createDataFrame([(*r, "c") for r in folder], "page_id long, url string, html string, key string")
    monkeypatch.setattr(warc, "BLOCK_LINES", lines)
    got = warc.look_up(pages, warc.build(pages)).collect()
    keys = Counter(warc_key(u) for _, u, _ in folder if u is not None)
    assert len(got) == len(folder) - 1
    assert all(r.n_captures == keys[r.url_key] for r in got)
    assert all(r.html_bytes == len(f"body {r.page_id}") for r in got if r.page_id is not None and r.page_id < 150 and r.page_id != 7)
    other = spark.createDataFrame([(1, "http://nowhere.org/"), (1, "http://h1.org/p2")], "page_id long, url string")
    assert {(r.url, r.n_captures, r.html_md5 is None) for r in warc.look_up(other, warc.build(pages)).collect()} == {("http://nowhere.org/", 0, True), ("http://h1.org/p2", keys["org,h1)/p2"], True)}
    assert warc.look_up(other, warc.build(pages.where("false"))).where("n_captures > 0").isEmpty()


def warc_key(url):
    return dict(URLS).get(url) or f"{','.join(reversed(url.split('/')[2].split('.')))})/{url.split('/', 3)[3]}"


def test_templates(spark):
    rows, bad = [], []
    for i in range(200):
        rows.append((i, f"http://shop.org/item/{i}.html?b=1&a={i}"))
        rows.append((1000 + i, f"http://shop.org/user/name{chr(97 + i % 26)}{chr(97 + i // 26)}x/home"))
        rows.append((2000 + i, f"http://shop.org/spam/{i:08x}a1"))
        bad += [(i, 0), (2000 + i, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame(bad, "page_id long, bad int")
    out = {r.page_id: r for r in urlfilter.filter_urls(pages, labels).collect()}
    assert out[3].template == "/item/<n>.html/?a&b" and not out[3].rejected and out[3].n_labelled == 200
    assert out[1003].template == "/user/*/home" and out[2003].rejected and out[2003].template == "/spam/<hex>"
    share = (200 + urlfilter.SMOOTH * 0.5) / (200 + urlfilter.SMOOTH)
    assert out[2003].bad_share == pytest.approx(share)


def test_siblings_merge_unless_their_labels_differ(spark):
    rows, labels = [], []
    for k, section in enumerate(("news", "blog", "junk")):
        for i in range(60):
            rows.append((100 * k + i, f"http://h.org/{section}/{i}"))
            labels.append((100 * k + i, int(i % 10 == 0)))
    same = {r.template for r in urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int")).collect()}
    assert same == {"/*/<n>"}
    labels = [(i, 1 if i >= 200 else b) for i, b in labels]
    apart = {r.template: r.rejected for r in urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int")).collect()}
    assert apart == {"/{blog|news}/<n>": False, "/junk/<n>": True}


@pytest.mark.parametrize("unlabelled", [0, 7, 60])
def test_siblings_without_labels_merge_no_others(spark, unlabelled):
    rows, labels = [], []
    for k, (section, bad) in enumerate((("good", 0), ("junk", 1), ("fine", 0))):
        rows += [(100 * k + i, f"http://h.org/{section}/{i}") for i in range(40)]
        labels += [(100 * k + i, bad) for i in range(40)]
    rows += [(10_000 + 9 * k + i, f"http://h.org/s{chr(97 + k % 26)}{chr(97 + k // 26)}/{i}") for k in range(unlabelled) for i in range(1 if unlabelled > 9 else 9)]
    out = urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int")).collect()
    by = {r.page_id: r for r in out}
    assert by[100].template == "/junk/<n>" and by[100].rejected
    assert by[0].template == by[200].template == "/{fine|good}/<n>" and not by[0].rejected and by[0].n_labelled == 80


def brute_templates(rows, labels, smooth=10.0, reject=0.4):
    """(host, template, labels, bad, rejected) of each page, by the rules as written, one node after another."""
    known = defaultdict(list)
    for page, bad in labels:
        known[page].append(bad)

    def form(s):
        name, ending = re.fullmatch(r"(.*?)(\.[A-Za-z]{1,5})?", s).groups()
        for pattern, kind in ((r"[0-9]{4}-[0-9]{2}(-[0-9]{2})?", "<date>"), (r"[0-9]+", "<n>"), (r"[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}", "<uuid>")):
            if re.fullmatch(pattern, name):
                return kind + (ending or "")
        if re.fullmatch(r"[0-9a-fA-F]{8,}", name) and re.search("[0-9]", name):
            return "<hex>" + (ending or "")
        return re.sub("[0-9]+$", "", name) + "<n>" + (ending or "") if re.search("[0-9]{3,}$", name) else s

    pages = []
    for page, url in rows:
        host, _, rest = re.sub("^http://", "", url).partition("/")
        path, _, query = rest.partition("?")
        end = ["?" + "&".join(sorted({p.split("=")[0] for p in query.split("&")}))] if query else []
        pages.append([page, host, [form(s) for s in path.split("/") if s] + end])
    depth = max(len(t) for _, _, t in pages)
    for d in range(depth):
        nodes = defaultdict(Counter)
        for _, h, t in pages:
            if len(t) > d and not t[d].startswith("?"):
                nodes[h, *t[:d]][t[d]] += 1
        for _, h, t in pages:
            own = nodes.get((h, *t[:d]))
            if own and len(t) > d and len(own) >= urlfilter.MANY and not t[d].startswith("?") and own[t[d]] < sum(own.values()) * urlfilter.RARE and not re.search("<[a-z]+>|^[*]+$", t[d]):
                t[d] = "*"
    labelled = lambda some: (sum(len(known[p]) for p, _, _ in some), sum(sum(known[p]) for p, _, _ in some))
    for d in reversed(range(depth)):
        families = defaultdict(lambda: defaultdict(list))
        for row in pages:
            if len(row[2]) > d and not row[2][d].startswith("?"):
                families[row[1], *row[2][:d], None, *row[2][d + 1 :]][row[2][d]].append(row)
        for family in families.values():
            counts = {s: labelled(some) for s, some in family.items()}
            groups = []
            for _, s in sorted((b / n, s) for s, (n, b) in counts.items() if n):
                n, b = counts[s]
                if groups:
                    m, c = groups[-1][1:]
                    x = max(abs(c * (n - b) - (m - c) * b) - (m + n) / 2, 0) ** 2 * (m + n)
                    y = m * n * (b + c) * (m + n - b - c)
                    if not y or x / y <= urlfilter.CHI_SQUARED:
                        groups[-1] = [[*groups[-1][0], s], m + n, b + c]
                        continue
                groups.append([[s], n, b])
            if len(groups) < 2:
                groups = [[list(family), 0, 0]]
            for names, *_ in groups:
                if len(names) > 1:
                    for s in names:
                        for row in family[s]:
                            row[2][d] = "*" if len(groups) == 1 else "{" + "|".join(sorted(names)) + "}"
    of = defaultdict(list)
    for row in pages:
        of[row[1], "/" + "/".join(row[2])].append(row)
    base = (lambda n, b: b / n if n else 0.0)(*labelled(pages))
    out = {}
    for (h, t), some in of.items():
        n, b = labelled(some)
        for p, _, _ in some:
            out[p] = h, t, n, b, (b + smooth * base) / (n + smooth) > reject
    return out


@pytest.mark.parametrize("seed", range(6))
def test_templates_as_by_hand(spark, seed):
    rnd = random.Random(seed)
    sections = ["news", "blog", "junk", "shop", "wiki", "a|b"][: rnd.randint(3, 6)]
    rows, labels = [], []
    for i in range(400):
        s = rnd.choice(sections)
        middle = rnd.choice(["", f"{rnd.choice('xyz')}/", f"u{rnd.choice('abcdefghijklmnopqrstuv')}{rnd.choice('abc')}/"])
        leaf = rnd.choice([f"{i}", f"{i}.html", f"item{i:04d}", "2024-01-02", "index.php?b=1&a=2", f"{i:08x}a1", "end"])
        rows.append((i, f"http://h{rnd.randint(0, 1)}.org/{s}/{middle}{leaf}"))
        labels += [(i, int(rnd.random() < {"junk": 0.9, "shop": 0.5}.get(s, 0.1))) for _ in range(rnd.choice([0, 1, 1, 2]))]
    got = urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int")).collect()
    assert {r.page_id: (r.host, r.template, r.n_labelled, r.n_bad, r.rejected) for r in got} == brute_templates(rows, labels)


def test_paths_of_any_depth_stay_apart(spark):
    """Two pages that differ in their 31st segment only, one labelled bad."""
    head = "http://h.org/" + "/".join(f"d{chr(97 + i % 26)}x" for i in range(30))
    rows = [(k * 40 + i, f"{head}/{s}/{i}") for k, s in enumerate(("good", "bad")) for i in range(40)]
    labels = [(i, int(i >= 40)) for i in range(80)]
    out = {r.page_id: r for r in urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int")).collect()}
    assert out[0].template.endswith("/good/<n>") and not out[0].rejected and out[40].template.endswith("/bad/<n>") and out[40].rejected


def test_page_ids_of_any_type(spark):
    rows = [("a\tb", "http://h.org/x", "one"), ("7", "http://h.org/x", None), (None, "http://h.org/x", "three"), ("", "http://h.org/x", "four"), ("%09", "http://h.org/y", "five")]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = {r.page_id: (r.n_captures, r.html_bytes) for r in warc.look_up(pages, warc.build(pages)).collect()}
    assert got == {"a\tb": (4, 3), "7": (4, 0), None: (4, 5), "": (4, 4), "%09": (1, 4)}


def test_nulls_as_sql_has_them(spark):
    import duckdb

    rows = [(1, "http://h.org/x", None), (2, None, "y"), (3, "http://h.org/x", "é"), (4, "http://h.org/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    c = duckdb.connect()
    c.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    c.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    want = c.sql(f"SELECT page_id, url, url_key, n_captures, html_md5, html_bytes FROM ({warc.ORACLE['op5_warc_index']})").fetchall()
    assert sorted(tuple(r) for r in warc.look_up(pages, warc.build(pages)).collect()) == sorted(want)


def test_odd_pages(spark):
    deep = "http://h.org/" + "/".join(f"d{i}x" for i in range(40))
    rows = [(1, None), (2, ""), (3, "no scheme/x"), (4, deep), (4, deep), (None, "http://h.org/a"), (5, "http://h.org/?&=&a"), (6, "http://h.org")]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, template string, host int")
    labels = spark.createDataFrame([(4, 1), (4, None), (None, 1), (99, 1), (6, 0), (6, 1)], "page_id long, bad int")
    out = urlfilter.filter_urls(pages.drop("host").withColumn("path", F.lit("p")), labels).collect()
    assert Counter(r.page_id for r in out) == Counter([2, 3, 4, 4, None, 5, 6])
    assert next(r for r in out if r.page_id == 4).template.count("/") == 40
    assert urlfilter.filter_urls(pages.where("false"), labels).isEmpty()
    assert {r.bad_share for r in urlfilter.filter_urls(pages, labels.where("false")).collect()} == {0.0}


def test_test_pages(spark, small):
    out = urlfilter.op7_url_filter(spark, small).collect()
    assert len(out) == spark.read.parquet(f"{small}/pages.parquet").count()
    by = {}
    for r in out:
        by.setdefault((r.host, r.template), set()).add((r.n_labelled, r.n_bad, r.rejected))
    assert all(len(v) == 1 for v in by.values()) and all(r.rejected == (r.bad_share > urlfilter.REJECT) for r in out)
