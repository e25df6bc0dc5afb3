"""Main text, fixity and URL lists."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import html_extract, queries, url_filter, warc
from millrace.llm.oracles import ORACLES
from tests.conftest import SMALL
from tests.test_catalog import plain


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


CASES = [
    ("<nav><a>m</a></nav><article><h1>A</h1><p>b &amp; c<p>d</article><footer>f</footer>", "A\nb & c\nd"),
    ("<div class='ad'>x</div><main><p>a  b\n c</p><aside>s</aside><form>q</form></main>", "a b c"),
    ("<header>h</header><div id='content'><p>a</p><ul><li>x<li>y</ul></div><div class='comments'><p>no</p></div>", "a\nx\ny"),
    ("<article><p><b>One.<br><p>Two &am", "One.\nTwo &am"),
    ("<article><p>a<!-- c --></p><p>b</p", "a\nb"),
    ("<article>a <i>b</i>c <a href='x>y'>d</a></article>", "a bc d"),
    ("", ""),
]


@pytest.mark.parametrize(("body", "text"), CASES)
def test_main_text(body, text):
    items = html_extract.stream(page(body) if "</p" != body[-3:] and "&am" != body[-3:] else body)
    assert html_extract.main_text(items, html_extract.Wrapper(html_extract.form(items))) == text


def test_wrapper_resolves_mismatches():
    import json

    def bare(nodes):
        return [["#"] if x[0] == "#" else [x[0], bare(x[1])] for x in nodes]

    one = html_extract.form(html_extract.stream("<div><h1>a</h1><p>b</p></div>"))
    two = html_extract.form(html_extract.stream("<div><h1>c</h1><p>d</p><p>e</p><em>f</em></div>"))
    counts = [1, 1, 0, 0, 0, [7]]
    pages, got = json.loads(html_extract.union_of([html_extract.dumps([counts, one]), html_extract.dumps([counts, two])]))
    assert pages[:2] == [2, 2] and got[0][1][1][1][0][1][0][1][:3] == [2, 3, 3]
    assert bare(got) == [["div", [["h1", [["#"]]], ["+", [["p", [["#"]]]]], ["?", [["em", [["#"]]]]]]]]


def host_wrapper(pages):
    import json
    import zlib

    forms = [html_extract.dumps([[1, 1, 0, 0, 0, [zlib.crc32(p.encode())]], html_extract.form(html_extract.stream(p))]) for p in pages]
    made, nodes = json.loads(html_extract.union_of(forms))
    return html_extract.Wrapper(nodes, made)


def words(seed, n):
    import random

    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))


def test_pages_without_telling_names():
    """The wrapper tells what all pages share from what each says: no tag or class does. A page by itself would keep the
    longer text beside its own."""
    slogan, legal = words(1, 60), words(2, 40)

    def made(i):
        paragraphs = "".join(f"<p>{words(100 * i + k, 6)}</p>" for k in range(1 + i % 3))
        return page(f"<div class=c1><div>{slogan}</div></div><div class=c2><h2>{words(5000 + i, 3)}</h2>{paragraphs}</div><div class=c3><p>{legal}</p></div>")

    pages = [made(i) for i in range(12)]
    wrapper = host_wrapper(pages)
    for i, p in enumerate(pages):
        items = html_extract.stream(p)
        want = "\n".join([words(5000 + i, 3), *(words(100 * i + k, 6) for k in range(1 + i % 3))])
        assert html_extract.main_text(items, wrapper) == want
        alone = html_extract.main_text(items, html_extract.Wrapper([]))
        assert alone != want and slogan in alone
    # copies of one page share all their text and still have it
    assert words(5001, 3) in html_extract.main_text(html_extract.stream(pages[1]), host_wrapper([pages[1]] * 12))


def test_regions_by_the_wrapper():
    article = "<p>one two three four</p><p>five six seven eight nine</p>"
    cases = [
        (f"<main><div class='article-header'><h1>Title</h1></div>{article}</main>", "Title\none two three four\nfive six seven eight nine"),
        (f"<article>{article}<p class='form'>ten</p></article><article class='comment'>no no no</article>", "one two three four\nfive six seven eight nine\nten"),
        (f"<article><header><h1>Title</h1></header>{article}<section class='comments'><p>no</p></section></article>", "Title\none two three four\nfive six seven eight nine"),
        (f"<div><ul><li><a>a</a><li><a>b</a><li><a>c</a><li><a>d</a></ul></div><div><h1>Title</h1><div>{article}</div></div><div>foot</div>", "Title\none two three four\nfive six seven eight nine"),
        (f"<article><p>x</p></article><article>{article}</article>", "x\none two three four\nfive six seven eight nine"),
    ]
    for body, want in cases:
        assert html_extract.main_text(html_extract.stream(page(body)), html_extract.Wrapper([])) == want


def test_wrappers_do_not_depend_on_partitions(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    one, two = (sorted(map(tuple, html_extract.wrappers(df.repartition(k, "page_id")).collect())) for k in (1, 13))
    assert one == two


def test_deep_pages():
    deep = page("<div>" * 3000 + "<p>x y z</p>" + "</div>" * 3000)
    items = html_extract.stream(deep)
    assert html_extract.main_text(items, host_wrapper([deep, page("<div><p>a</p></div>")])) == "x y z"


def test_extraction_edges(spark):
    rows = [(1, "http://h/x", page("<article><p>a</p></article>"), "x"), (1, "http://h/x", page("<article><p>a</p></article>"), "x"), (2, None, None, "x"), (3, "http://h/y", "", "x"), (None, "http://h/z", page("<article>" + "<p>é</p>" * 20_000 + "</article>"), "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extracted(df)
    assert got.columns == ["page_id", "url", "html", "text", "n_chars"]
    assert sorted((r["text"], r["n_chars"]) for r in got.select("text", "n_chars").collect())[:4] == [("", 0), ("", 0), ("a", 1), ("a", 1)]
    assert got.filter("page_id IS NULL").first()["n_chars"] == 39_999
    assert html_extract.extracted(df.limit(0)).count() == 0


def test_html_query(spark):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in queries.QUERIES["op5_html_text"](spark, SMALL).collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", pages[r["page_id"]], re.S)[1]
        inner = re.sub(r"<(/?[a-z!][^>]*)?\Z", "", inner)
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", inner.replace("<br>", " "))]
        assert r["text"] == "\n".join(x for x in blocks if x) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.01").toPandas()
    con = duckdb.connect()
    for table in ("pages", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('/root/testdata/sf0.01/{table}.parquet')")
    assert plain(got) == plain(con.execute(ORACLES[name]).df()) and len(got)


def records(spark, *rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.select("page_id", warc.record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))


def test_damage_kinds(spark):
    left = [(i, f"http://h/{i}", f"<p>{i}</p>") for i in range(700)]
    right = [r if r[0] != 600 else (600, r[1], "<p>!</p>") for r in left[:-1]]
    got = {(r["page_id"], r["kind"], r["seq"]) for r in warc.damage(warc.leaves(records(spark, *left)), warc.leaves(records(spark, *right))).collect()}
    assert got == {(600, "changed", 88), (699, "missing", 187)}
    # a record lost or put in between moves no other
    less = [r for r in left if r[0] not in (50, 51)]
    more = [(-3, "u", "new"), *less[:300], (less[300][0], "u", "twin"), *less[300:], (900, "u", "new")]
    got = {(r["page_id"], r["kind"]) for r in warc.damage(warc.leaves(records(spark, *left)), warc.leaves(records(spark, *more))).collect()}
    assert got == {(50, "missing"), (51, "missing"), (-3, "extra"), (less[300][0], "extra"), (900, "extra")}
    same = records(spark, *left)
    assert warc.damage(warc.leaves(same), warc.leaves(same)).count() == 0


def test_roots_by_hand(spark):
    rows = [(i, "u", "x" * i) for i in range(20)]
    base = warc.leaves(records(spark, *rows))
    hashes = [r["hash"] for r in base.orderBy("seq").collect()]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    above = lambda nodes: sha(",".join(f"{k}:{x}" for k, x in nodes))
    places = [(i, above([(i, x)])) for i, x in enumerate(hashes)]
    want = above([(0, above(places[:16])), (1, above(places[16:]))])
    assert [r["hash"] for r in warc.tree(base, 2)[-1].collect()] == [want]


def test_warc_edges_and_round_trip(spark):
    rows = [(1, None, None), (1, "http://h/é", "é\r\n\r\nWARC/1.1"), (1, "http://h/é", "é\r\n\r\nWARC/1.1"), (None, "u", "x" * 50_000), (None, None, None)]
    made = records(spark, *rows)
    base = warc.leaves(made)
    assert base.count() == 5 and base.filter("file < 0").count() == 2 and warc.damage(base, base).count() == 0
    files = warc.packed(made.filter("page_id IS NOT NULL")).select(F.lit("f").alias("path"), "content")
    got = warc.read_files(files).collect()
    assert sorted(r["body"].decode() for r in got) == ["", "é\r\n\r\nWARC/1.1", "é\r\n\r\nWARC/1.1"]
    assert [r["start"] for r in got] == [r["start"] for r in base.filter("file = 0").orderBy("seq").collect()]
    assert warc.damage(base.limit(0), base.limit(0)).count() == 0 and list(warc.parsed(b"no warc")) == []


def test_list_intervals(spark):
    entries = spark.createDataFrame(
        [("l", "block", "EXAMPLE.com", "2024-01-10", True), ("l", "block", "EXAMPLE.com", "2024-02-10", False), ("l", "block", "EXAMPLE.com", "2024-02-10", True), ("a", "allow", "x.example.com", "2024-01-20", True), (None, "block", "h", "2024-01-01", True), ("l", "block", "other.com", None, True)],
        "list string, action string, key string, at string, added boolean",
    ).withColumn("at", F.col("at").cast("timestamp"))
    rows = [
        (1, "http://example.com/", "2024-01-09 23:59:59", False, 0),
        (2, "http://example.com/", "2024-01-10", True, 1),
        (2, "http://example.com/", "2024-01-10", True, 1),
        (3, "http://user@X.Example.com.:80/", "2024-01-19", True, 1),
        (4, "http://x.example.com/", "2024-01-20", False, 2),
        (5, "http://example.com/", "2024-02-10", False, 0),
        (6, "http://badexample.com/", "2024-01-15", False, 0),
        (7, None, "2024-01-15", False, 0),
        (8, "http://example.com/", None, False, 0),
        (9, "http://localhost/", "2024-01-15", False, 0),
    ]
    df = spark.createDataFrame(rows, "id long, url string, fetched_at string, host boolean, n long").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    got = url_filter.matched(df.withColumnsRenamed({"host": "want", "n": "want_n"}).withColumn("blocked", F.lit("x")), entries)
    assert got.count() == len(rows)
    for r in got.collect():
        assert (r["blocked"], r["n_active"]) == (r["want"], r["want_n"]), r
    # keys that differ in case or a final dot are one; very long hosts are cut to no more parents than names have labels
    pairs = spark.createDataFrame([("l", "block", "example.com", "2024-01-10", True), ("l", "block", "EXAMPLE.com.", "2024-01-10", False)], "list string, action string, key string, at string, added boolean").withColumn("at", F.col("at").cast("timestamp"))
    assert url_filter.matched(df, pairs).filter("blocked").count() == 0
    far = spark.createDataFrame([("http://" + "a." * 5000 + "example.com/",)], "url string").withColumn("fetched_at", F.lit("2024-01-15").cast("timestamp"))
    assert url_filter.matched(far, entries).first()["blocked"]
    assert url_filter.matched(df.limit(0), entries).count() == 0 and url_filter.matched(df, entries.limit(0)).filter("blocked").count() == 0
