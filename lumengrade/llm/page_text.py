"""HTML extraction: site templates found by counting element subtrees per host, and cut from each page.

1. Each page's elements are hashed bottom up (tag, text, children). A row per page and subtree that a template may hold goes out once; rows of
   equal pages of a host fall together, so that copies of a page don't make a template of it.
2. Spark counts the pages of each (host, subtree), with partial sums before the shuffle. Subtrees on at least `least` pages and `share`
   of the host's pages are the host's template.
3. The template's subtrees are joined back to the rows of step 1 and gathered by page (no more than its elements), and the pages are joined with
   them once, by page; both sides are written tables, so Spark can split a page that very many rows repeat.
4. Each page is cut: the template's subtrees go, then elements that are never main text (menus, headers, footers, asides, forms,
   scripts, styles, by name or class: adverts, notices, comments). If the page marks its main text (article or main elements), only that is kept.

A template never takes paragraphs, headings, quotes or tables of a marked main text: articles of one site may quote the same passage, and
those stay. Nor does it take the main text of near copies (page_tree.main_text has the rule).

Defined results: null or empty html, or markup without text, gives an empty text; pages without a host have no site, and only the rules of
step 4 hold for them; equal rows are judged alike, each with a row of its own; markup may be cut off, unclosed or nested to any depth; texts of any length
are read whole; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import page_tree
from ._common import slices, stored, table
from .url_filter import host_of

LEAST, SHARE = 5, 0.01
PAGE = ["site", "p1", "p2"]


def keyed(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) with the numbers of site and content; null site where there is no host."""
    host = host_of(F.col("url"))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"),
        F.when(host != "", F.xxhash64(host)).alias("site"), F.xxhash64("html").alias("p1"), F.xxhash64(F.lit("page"), "html").alias("p2"),
    )


def subtrees(pages: DataFrame) -> DataFrame:
    """(site, p1, p2, h) for each subtree h of a page that a template may hold; h is null once for each page."""

    def run(batches):
        for part in slices(batches, "html"):
            at, h = [], []
            for k, text in enumerate(part.column("html")):
                found = [None, *page_tree.subtrees(page_tree.parse(text.as_py()))]
                at += [k] * len(found)
                h += found
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(at, pa.int64())) for c in PAGE), pa.array(h, pa.int64())], names=[*PAGE, "h"])

    named = pages.where("site is not null and html is not null").select(*PAGE, "html")
    return named.mapInArrow(run, "site long, p1 long, p2 long, h long")


def templates(marks: DataFrame, least: int, share: float) -> DataFrame:
    """(site, h) of the subtrees on at least `least` different pages and `share` of the different pages of their site."""
    counts = stored(marks.groupBy("site", "h").agg(F.count("*").alias("n")).where(f"h is null or n >= {least}"), "subtree-counts")
    sites = counts.where("h is null").select("site", F.col("n").alias("pages"))
    return counts.where("h is not null").join(sites, "site").where(F.col("n") >= F.lit(share) * F.col("pages")).select("site", "h")


def cut_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_template) of pages(page_id, url, html, gone)."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_template", pa.int64())])

    def run(batches):
        for part in slices(batches, "html"):
            texts, cuts = [], []
            for page, gone in zip(part.column("html"), part.column("gone"), strict=True):
                text, cut = ("", 0) if not page.is_valid else page_tree.main_text(page_tree.parse(page.as_py()), frozenset(gone.as_py() or ()))
                texts.append(text)
                cuts.append(cut)
            cols = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(cuts, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return pages.select("page_id", "url", "html", "gone").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_template long")


def extract(pages: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """(page_id, url, text, n_chars, n_template): the main text of each page and how many subtrees of its site's template were cut."""
    base = keyed(pages)
    marks = stored(subtrees(base).dropDuplicates(), "subtrees")
    shared = stored(templates(marks, least, share), "templates")
    gone = marks.where("h is not null").join(shared, ["site", "h"]).groupBy(*PAGE).agg(F.collect_list("h").alias("gone"))
    return cut_pages(base.join(stored(gone, "gone"), PAGE, "left"))


def op13_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars", "n_template")


#: For pages as the given table has them: one nav, one div of class ad and one footer around one article of p and h1, no element of ITEMS' kind to count.
ORACLE_SQL = r"""
WITH p AS MATERIALIZED (SELECT page_id, url, coalesce(html, '') AS html, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM pages),
part AS MATERIALIZED (SELECT DISTINCT host, html, unnest([regexp_extract(html, '(?s)<nav>.*?</nav>'), regexp_extract(html, '(?s)<div class="ad">.*?</div>'), regexp_extract(html, '(?s)<footer>.*?</footer>')]) AS h
    FROM p WHERE host <> ''),
site AS (SELECT host, count(DISTINCT html) AS pages FROM p GROUP BY host),
cut AS (SELECT host, h FROM part JOIN site USING (host) WHERE h <> '' GROUP BY host, h, pages HAVING count(*) >= 5 AND count(*) >= 0.01 * pages),
n AS (SELECT host, html, count(*) AS n FROM part JOIN cut USING (host, h) GROUP BY host, html),
block AS (SELECT page_id, url, html, host, list_transform(regexp_split_to_array(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)>'), lambda x: regexp_replace(x, '<[^>]*>', ' ', 'g')) AS b FROM p),
said AS (SELECT page_id, url, html, host, array_to_string(list_filter(list_transform(b, lambda x: trim(regexp_replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM block)
SELECT page_id, url, text, length(text) AS n_chars, coalesce(n.n, 0) AS n_template FROM said LEFT JOIN n USING (host, html)
"""
