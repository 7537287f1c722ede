"""Main text of web pages: element subtrees are hashed and counted per host, and those that recur over a site's pages go."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthstat.llm.html import BLOCK, Page

from hearthstat.llm.shared import save

SHARE = 0.5
LEAST = 3
LEAST_LONE = 16
BATCH_BYTES = 8 << 20
#: Elements that hold a passage rather than parts of a page.
_PASSAGE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre figcaption td th".split())
_HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_SECTION = r"^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]+)/"


def _by_bytes(batch: pa.RecordBatch, html_col: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold some ``BATCH_BYTES`` of html, or one page, each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(html_col))), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // BATCH_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for low, high in zip(cuts, cuts[1:]):
        if high > low:
            yield batch.slice(low, high - low)


def _subtrees(pages: DataFrame, html_col: str) -> DataFrame:
    """(site, subtree, context, lone): all block elements of each page, with a hash of its main content, and whether they are passages of an article or main;
    subtree 0 stands for the page.

    A page's sites are its host and, where the path has a first folder, that folder of the host (``section``).
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _by_bytes(whole, html_col)):
            found = set()
            for host, section, html in zip(*(batch.column(c).to_pylist() for c in ("host", "section", html_col))):
                page = Page(html or "")
                hashes = page.hashes()
                outer = [i for i in range(len(hashes)) if page.content[i] and not (i and page.content[page.parents[i]])]
                context = xxhash.xxh3_64_intdigest(" ".join(str(hashes[i]) for i in outer)) >> 1
                blocks = {0, *(hashes[i] for i in range(1, len(hashes)) if page.names[i] in BLOCK)}
                lone = {hashes[i] for i, own in enumerate(page.main()) if own and page.names[i] in _PASSAGE}
                found.update((site, block, context, block in lone) for site in {host, section} for block in blocks)
            rows = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.bool_()))], names=["site", "subtree", "context", "lone"])

    return pages.mapInArrow(run, "site string, subtree long, context long, lone boolean")


def site_templates(pages: DataFrame, html_col: str = "html", share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(section, templates): the subtrees that stand in at least ``share``, and ``least``, of the different main contents of the section or of its host.

    ``pages`` has ``host`` and ``section``. A subtree counts once per distinct content, so copies of a page do not make its article a template. Of near copies
    it may: ``Page.text`` tells by the share of a page's main content that is common, at every number of pages. A paragraph, heading or list item of an
    article or main that stands in a few contents is quoted as often as it is a template, so it has to stand in ``LEAST_LONE``, unless what holds it recurs. Counts are
    partial before they are shuffled. A site has at most 1 / share times the blocks of a page, whatever its number of pages.
    """
    counted = _subtrees(pages, html_col).groupBy("site", "subtree", "context").agg(F.max("lone").alias("lone"))
    counted = counted.groupBy("site", "subtree").agg(F.count(F.lit(1)).alias("n"), F.max("lone").alias("lone"))
    counted = save(counted.where(f"n >= if(lone, {max(least, LEAST_LONE)}, {least}) or subtree = 0").drop("lone"), "op2-counts")
    whole = counted.where("subtree = 0").select("site", F.col("n").alias("contents"))
    recurring = counted.where("subtree <> 0").join(whole, "site").where(F.col("n") >= share * F.col("contents"))
    of_site = save(recurring.groupBy("site").agg(F.collect_list("subtree").alias("own")), "op2-sites")
    sections = pages.select("host", "section").distinct()
    above = of_site.select(F.col("site").alias("host"), F.col("own").alias("above"))
    none = F.array().cast("array<bigint>")
    both = F.array_union(F.coalesce("own", none), F.coalesce("above", none))
    joined = sections.join(of_site.withColumnRenamed("site", "section"), "section", "left").join(above, "host", "left")
    return joined.select("section", both.alias("templates")).where("size(templates) > 0")


def extract_text(pages: DataFrame, carry: list[str], url_col: str = "url", html_col: str = "html", share: float = SHARE, least: int = LEAST) -> DataFrame:
    """``row`` (a struct of the columns in ``carry``) and ``text``: the main text of every page, its blocks joined by an empty line.

    First the block subtrees that recur over the contents of the page's host or of its first folder (``site_templates``) are deleted, wherever on the page they stand.
    In an article or main that consists mostly of such subtrees, a near copy, they stay.
    Of what is left, the main content is what articles hold, else ``main``, else the page; menus, page headers, footers, sidebars, notices, adverts, forms, scripts,
    styles and reader comments are left out by element name and by words in class, id and role;
    in articles and main, an id alone counts for adverts, and for elements that hold a form or replies. Character references are decoded and white space becomes one space.

    A null or empty html gives an empty text; a null url is a host of its own. Rows that repeat stand for themselves. Unclosed and misplaced tags
    are read as browsers do in the common cases. Empty tables give empty results.
    """
    host = F.coalesce(F.regexp_extract(F.lower(F.trim(F.col(url_col))), _HOST, 1), F.lit(""))
    folder = F.coalesce(F.regexp_extract(F.lower(F.trim(F.col(url_col))), _SECTION, 1), F.lit(""))
    section = F.when(folder == "", host).otherwise(F.concat(host, F.lit("/"), folder))
    hosted = pages.select(F.struct(*carry).alias("row"), host.alias("host"), section.alias("section"), F.col(html_col).alias("html"))
    templates = save(site_templates(hosted.select("host", "section", "html"), "html", share, least), "op2-templates")
    joined = hosted.join(templates, "section", "left").select("row", "html", "templates")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _by_bytes(whole, "html")):
            lists = batch.column("templates").to_pylist()
            texts = [Page(html or "").text(set(own or ())) for html, own in zip(batch.column("html").to_pylist(), lists)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    return joined.mapInArrow(run, T.StructType([T.StructField("row", hosted.schema["row"].dataType), T.StructField("text", T.StringType())]))


def op2_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id", "url"])
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))
