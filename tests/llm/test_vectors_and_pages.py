"""Centroid clustering, hard negatives, page texts and encoding against brute force in whole numbers and over whole tables."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumengrade.llm import centroid_clusters, hard_negatives, integer_vectors, page_text, page_tree, sentencepiece_codec
from lumengrade.llm._common import stored

EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def vectors(n, dim, seed, spread=0.4, groups=6):
    rng = np.random.default_rng(seed)
    middles = rng.standard_normal((groups, dim))
    label = rng.integers(0, groups, n)
    return (middles[label] + spread * rng.standard_normal((n, dim))).astype(np.float32), label


def rows_of(values, labels, ids=None):
    ids = range(len(values)) if ids is None else ids
    return [(int(k), [float(x) for x in v], int(c)) for k, v, c in zip(ids, values, labels, strict=True)]


ODD = [(9001, None, 1), (9002, [], 1), (9003, [float("nan")] * 64, 1), (9004, [None] * 64, 1), (9005, [float("inf")] + [0.0] * 63, 1), (9006, [1e30] * 64, 1), (9007, [1.0] * 63, 1)]


# centroid clustering


def brute_clusters(rows, k, rounds, dim, seed=2):
    kept = [(i, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, _ in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) and abs(x) < 1e6 for x in v)]
    digest = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    centroids = [list(v) for *_, v in sorted((digest(i), np.array(v, np.int64).tobytes(), v) for i, v in kept if i is not None)[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (apart(v, centroids[c]), c))
    for _ in range(rounds):
        at = [nearest(v) for _, v in kept]
        for c in set(at):
            own = [v for (_, v), x in zip(kept, at, strict=True) if x == c]
            centroids[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    found = [(i, c, apart(v, centroids[c])) for i, v in kept for c in [nearest(v)]]
    own = {c: sum(d for _, x, d in found if x == c) for _, c, _ in found}
    shown = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    return sorted(((i, c, d, own[c], sum(own.values()), shown(c)) for i, c, d in found), key=repr)


def clustered(spark, rows, **more):
    got = centroid_clusters.cluster(spark.createDataFrame(rows, EMBEDDINGS).withColumn("cluster", F.lit("x")).repartition(3), **more)
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("dim, k, n", [(64, 40, 150), (64, 40, 12), (3, 7, 200)])
def test_clusters_brute_force(spark, dim, k, n):
    values, labels = vectors(n, dim, dim + n)
    rows = rows_of(values, labels) + (ODD if dim == 64 else []) + [(None, [0.25] * dim, 0), (5, [0.5] * dim, 0), (5, [0.5] * dim, 0)]
    assert clustered(spark, rows, k=k, dim=dim) == brute_clusters(rows, k, 5, dim)


def test_clusters_ties_and_empty_clusters(spark):
    rows = [(k, [float(k % 3), 0.0], 0) for k in range(30)] + [(100, [1.0, 0.0], 0)]  # three places, seven seeds: equal centroids, most empty
    got = clustered(spark, rows, k=7, dim=2)
    assert got == brute_clusters(rows, 7, 5, 2)
    assert len({r[1] for r in got}) <= 3


def test_clusters_hot_vector_and_empty_table(spark):
    values, labels = vectors(60, 64, 8)
    rows = rows_of(values, labels) + [(1000 + k, [0.125] * 64, 1) for k in range(40)]
    assert clustered(spark, rows) == brute_clusters(rows, 40, 5, 64)
    assert clustered(spark, []) == clustered(spark, ODD) == clustered(spark, [(None, [0.5] * 64, 1)]) == []


def test_tournament_is_nearest_with_smaller_number():
    rng = np.random.default_rng(1)
    centroids, v = rng.integers(-4, 5, (30, 5)), rng.integers(-4, 5, (4000, 5))
    d = ((v[:, None, :] - centroids[None]) ** 2).sum(2)
    assert (np.sort(d, 1)[:, 0] == np.sort(d, 1)[:, 1]).sum() > 100  # many ties
    assert (centroid_clusters.tournament(v, *centroid_clusters.bisectors(centroids)) == d.argmin(1)).all()


def test_largest_components_stay_exact():
    most = integer_vectors.LARGEST
    c = np.array([[most] * 64, [-most] * 64, [-most] * 63 + [1 - most]], np.int64)
    assert centroid_clusters.tournament(c, *centroid_clusters.bisectors(c)).tolist() == [0, 1, 2]
    assert hard_negatives.exact(c[:1], c[0])[0] == 64 * most**2


# hard negatives


def brute_negatives(rows, anchors, positives=5, negatives=3, low=50, high=95):
    kept = sorted({(i, c, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, c in rows if i is not None and c is not None and v and all(x is not None and math.isfinite(x) and abs(x) < 1e6 for x in v)})
    out = []
    for i, c, v in kept:
        if i % anchors:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j, d) for j, d, w in kept if j != i and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == c][:positives]:
            fits = [(j, -t) for t, j, d in scored if d != c and low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(i, p, n + 1, j, -s, t) for n, (j, t) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, anchors, **more):
    table = spark.createDataFrame(rows, EMBEDDINGS).where("vec_id is not null and label is not null").withColumn("score", F.lit(1))
    every = stored(integer_vectors.integer_vectors(table, {"vec_id": "long", "label": "int"}).dropDuplicates().repartition(3), "rows")
    got = hard_negatives.hard_negatives(every, stored(every.where(F.col("vec_id") % anchors == 0), "anchors"), **more)
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("block", [4096, 7])
@pytest.mark.parametrize("dim", [64, 2])
def test_negatives_brute_force(spark, dim, block):
    values, labels = vectors(400, dim, dim, spread=1.0)
    rows = rows_of(values, labels) + ODD + [(None, [1.0] * dim, 0), (7, None, None)] + [(500, [float(x) for x in values[3]], None)]
    rows += rows_of(values[:20], (labels[:20] + 1) % 6, range(600, 620)) + rows_of(values[:20], labels[:20])  # equal vectors of other labels, repeated rows
    rows += [(3, [0.5] * dim, 2), (20, [0.75] * dim, 1)]  # ids on two different rows
    want = brute_negatives(rows, 10)
    assert len(want) > 100
    assert mined(spark, rows, 10, block=block) == want


def test_negatives_ties_few_rows_and_empty(spark):
    hot = [(k, [1.0, 0.5], k % 3) for k in range(90)] + [(200 + k, [0.75, 0.25], k % 4) for k in range(20)]  # nothing but ties
    assert mined(spark, hot, 10) == brute_negatives(hot, 10) != []
    alone = [(0, [1.0, 0.0], 1), (1, [0.75, 0.0], 2), (2, [-1.0, 0.0], 1)]
    assert mined(spark, alone, 50) == brute_negatives(alone, 50) == []  # the only positive scores below zero
    assert mined(spark, [], 50) == mined(spark, [(0, [1.0], 1)], 50) == []


def test_query_shifts_labels_of_every_seventh_row(spark, tmp_path):
    values, labels = vectors(200, 64, 4, groups=10)
    rows = rows_of(values, labels)
    spark.createDataFrame(rows, EMBEDDINGS).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, hard_negatives.op12_hard_negatives(spark, str(tmp_path)).collect()))
    assert got == brute_negatives([(i, v, (c + 1) % 10 if i % 7 == 0 else c) for i, v, c in rows], 50)


def test_tree_bounds_hold_and_spare_rows():
    values, _ = vectors(600, 64, 9, spread=0.15)
    whole = np.floor(256 * values.astype(np.float64)).astype(np.int64)
    anchors, rows = whole[:60], whole[60:]
    tree = hard_negatives.Tree(anchors)
    assert sorted(v[0] for v in tree.visits) == list(range(60))
    true, asked = rows @ anchors.T, 0

    def wanted(x, low, high):
        nonlocal asked
        assert (low <= true[:, x]).all() and (true[:, x] <= high).all()
        some = high >= np.sort(true[:, x])[-3]
        asked += some.sum()
        return some

    for x, some, scores in hard_negatives.walk(tree, anchors, rows, wanted):
        assert (scores == true[some, x]).all()
    assert asked < 0.5 * true.size  # most pairs are settled by their bounds


def test_tree_is_minimal_and_few_bounds_wait():
    points = np.random.default_rng(3).integers(-50, 50, (40, 4))
    tree = hard_negatives.Tree(points)
    weight = sum(edge for _, _, edge, _ in tree.visits)
    parent = list(range(40))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    least = 0.0
    for d, a, b in sorted((math.dist(points[a], points[b]), a, b) for a in range(40) for b in range(a)):
        if top(a) != top(b):
            parent[top(a)] = top(b)
            least += d
    assert weight == pytest.approx(least)
    waiting, most = set(), 0
    for x, up, _, last in tree.visits:
        if last:
            waiting.discard(up)
        waiting.add(x)
        most = max(most, len(waiting))
    assert most <= 40


# page texts

MENU = '<div class="x1"><ul><li><a href="/a">Start</a></li><li><a href="/b">News</a></li></ul></div>'
PROMO = '<div class="x2">Join our readers today</div>'


def pages_of(rows, spark):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("gone", F.lit("x")).withColumn("site", F.lit(1)).repartition(3)


def extracted(spark, rows, **more):
    return {r.page_id: r for r in page_text.extract(pages_of(rows, spark), **more).collect()}


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_template_found_by_counting_alone(spark):
    """Divs without any telling name, on pages that mark no main text: only their recurrence on the site tells."""
    rng = random.Random(5)
    texts = {k: [words(rng, 30), words(rng, 12)] for k in range(12)}
    body = lambda k: "".join(f"<div>{t}</div>" for t in texts[k])
    rows = [(k, f"http://a.org/{k}", f"{MENU}{body(k)}{PROMO}") for k in range(8)]
    rows += [(k, f"http://b.org/{k}", f"{MENU}{body(k)}{PROMO}") for k in range(8, 11)]  # three pages: not many
    rows += [(11, None, f"{MENU}{body(11)}")] + [(k, "http://c.org/", f"<div>{k}</div>{PROMO}") for k in range(20, 23)]
    got = extracted(spark, rows)
    for k in range(8):
        assert got[k].text == "\n".join(texts[k]) and got[k].n_template == 2
    for k in range(8, 11):
        assert got[k].text == "\n".join(["Start", "News", *texts[k], "Join our readers today"]) and got[k].n_template == 0
    assert got[11].text == "\n".join(["Start", "News", *texts[11]])


def test_marked_articles_keep_quotes_and_lose_templates(spark):
    rng = random.Random(6)
    quote = words(rng, 60)
    rows = []
    for k in range(9):
        art = f"<h1>T{k}</h1><p>{words(rng, 20)} {k}</p><p>{quote}</p>{PROMO}<ul><li><a href=/x>Read {words(random.Random(1), 2)}</a></li></ul><p>end {k}</p>"
        rows.append((k, f"https://n.org/{k}", f"<div><article>{art}</article></div><footer>f</footer>"))
    got = extracted(spark, rows)
    for k in range(9):
        lines = got[k].text.split("\n")
        assert lines[0] == f"T{k}" and lines[2] == quote and lines[3] == f"end {k}" and len(lines) == 4
        assert got[k].n_template == 3  # promotion, links, footer


def test_copies_make_no_template(spark):
    rng = random.Random(7)
    copy = "".join(f"<div>{words(rng, 25)}</div>" for _ in range(4))
    rows = [(k, f"http://d.org/{k}", copy) for k in range(10)]  # one content at ten addresses
    near = "".join(f"<div>{words(rng, 25)}</div>" for _ in range(20))
    rows += [(100 + k, f"http://d.org/n{k}", f"{near}<div>note {k}</div>") for k in range(10)]  # near copies
    rows += [(200 + k, f"http://e.org/{k}", f"<article>{near}<div>note {k}</div></article>") for k in range(10)]
    rows += [(300 + k, f"http://f.org/{k}", f"<p>own {words(rng, 30)}</p>") for k in range(10)]
    got = extracted(spark, rows)
    for k, _, html in rows:
        assert got[k].text.count("\n") == html.count("<div>") - 1 + html.count("<p>") and got[k].n_template == 0, k


@pytest.mark.parametrize("html, want", [
    (None, ""), ("", ""), ("plain  \n text", "plain text"), ("<p>a<p>b", "a\nb"), ("a<b", "a"), ("1 < 2 &lt; 3", "1 < 2 < 3"), ("<p>a&amp b&eacute;&#x41;&#65;&nbsp;c", "a& béAA c"),
    ("<title>t</title><style>p{}</style><script>var t='</p>'</script><p>x", "x"), ("<p>a<br>b<br/>c</p>", "a b c"), ("<p>a <b>b</p> c", "a b\nc"),
    ("<nav>n</nav><header>h</header><main><p>m</p></main><aside>s</aside><footer>f</footer>", "m"), ("<form>f<input></form><p>x</p><button>b</button>", "x"),
    ("<div class='cookie-notice'>c</div><p>x</p><div id=comments><p>c</p></div>", "x"), ("<div class=sideBar>c</div><div class='has-sidebar'>x</div>", "x"),
    ("<article><p>x</p><article>comment</article><section class=comments>c</section></article>", "x"), ("<article><header><h1>T</h1>by</header><p>x</article>", "T\nx"),
    ("<article class='post no-comments'><p>x</p></article><article class='comment'>c</article>", "x"), ("<ul><li>a<li>b<ul><li>c</ul></ul>d", "a\nb\nc\nd"),
    ("<table><tr><td>1<td>2<tr><th>3</table>", "1\n2\n3"), ("<pre>a <span class=comment>b</span>\n c</pre>", "a b c"), ("<!-- <p>no</p> --><p>x<!-- y --></p>", "x"),
    ("<p title='a>b'>x</p><p title='open>y", "x\ny"), ("<p>cut <b", "cut"), ("</div></p>x</br>y", "x y"), ("<P>A</P><ARTICLE><P>b</ARTICLE>", "b"), ("<article></article><p>x", "x"),
    ("<p hidden>no<p style='display: none'>no<p>x", "x"), ("<h2>a<h3>b</h3>", "a\nb"), ("<dl><dt>a<dd>b<dt>c</dl>", "a\nb\nc"), ("<script>never closed <p>x", ""), ("<a href=x>l</a> t", "l t"),
    ("\U0001f600 é", "\U0001f600 é"), ("<p>" + "x " * 200_000, ("x " * 200_000).strip()),
])
def test_page_rules(html, want):
    assert page_tree.main_text(page_tree.parse(html or ""), frozenset())[0] == want


@pytest.mark.parametrize("html", ["<div>" * 50_000 + "x", "<ul><li>" * 30_000 + "x", "<" * 300_000, "<a " * 200_000, "<a '" * 100_000, "<!-- " * 100_000, "<b>" * 50_000 + "<p>" * 50_000, "<table><tr><td>" * 20_000])
def test_hostile_markup_ends(html):
    root = page_tree.parse(html)
    page_tree.subtrees(root)
    page_tree.main_text(root, frozenset({1}))


def test_pages_edges(spark):
    rows = [(1, "http://a.org/", None), (None, "http://a.org/", "<p>x"), (2, None, "<p>y"), (2, None, "<p>y"), (3, "no address", ""), (4, "http://A.org", "<p>\U0001f600")]
    got = sorted((tuple(r) for r in page_text.extract(pages_of(rows, spark)).collect()), key=repr)
    assert got == sorted([(1, "http://a.org/", "", 0, 0), (None, "http://a.org/", "x", 1, 0), (2, None, "y", 1, 0), (2, None, "y", 1, 0), (3, "no address", "", 0, 0), (4, "http://A.org", "\U0001f600", 1, 0)], key=repr)
    assert page_text.extract(pages_of([], spark)).collect() == []


def test_templates_against_counts_over_whole_tables(spark):
    """The Spark counts and cuts of the given pages against a plain count over all of them."""
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in table.collect()]
    site = lambda u: u.split("://")[1].split("/")[0].split("?")[0].split("#")[0].lower()
    trees, seen, sizes = {}, {}, {}
    for k, u, h in rows:
        trees[k] = page_tree.parse(h)
        sizes.setdefault(site(u), set()).add(h)
        for x in page_tree.subtrees(trees[k]):
            seen.setdefault((site(u), x), set()).add(h)
    for least in (2, 3):
        gone = {}
        for (s, x), on in seen.items():
            if len(on) >= max(least, 0.01 * len(sizes[s])):
                gone.setdefault(s, set()).add(x)
        want = {}
        for k, u, h in rows:
            mine = frozenset(x for x in gone.get(site(u), ()) if h in seen[site(u), x])
            want[k] = page_tree.main_text(trees[k], mine)
        got = {r.page_id: (r.text, r.n_template) for r in page_text.extract(table, least=least).collect()}
        assert got == want
        assert sum(n for _, n in want.values()) >= 9


# encoding: what the agendas give is the library's


def test_agendas_need_no_correction(spark):
    got = sentencepiece_codec.op5_sentencepiece_codec(spark, "/root/testdata/sf0.001").agg(F.sum("n_corrected").alias("c"), F.count("*").alias("n")).first()
    assert (got.c, got.n) == (0, 200)
