"""Line dedup by site-relative frequency.

A line is boilerplate of a site when it stands on more than ``ratio`` of the
site's pages and on ``min_pages`` pages at least. Pages are counted per
(site, line) with map-side partial sums; what is joined back is one short
array per site: the lines over the ratio are at most the mean number of
distinct lines of the site's pages divided by ``ratio``.

Copies of a document would make all its lines boilerplate. On request a group
of near copies is one page: pages of a site that share at least
``SIMILARITY`` of their lines are found by min-hashes of the line sets, their
sets compared exactly, and one page of each group is counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowspark.llm.common import Scratch, col, without
from flowspark.llm.components import components

_HOST, _KEY, _N, _BOILER, _LINES = "__ld_host", "__ld_key", "__ld_n", "__ld_boiler", "__ld_lines"
_PAGE, _KEYS = "__ld_page", "__ld_keys"
RATIO, MIN_PAGES = 0.02, 4
#: Pages alike in this share of their lines are copies; line sets of this likeness
#: agree in one of the bands with probability 0.997.
SIMILARITY, BANDS, ROWS = 0.8, 8, 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def _without_near_copies(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """One page of each group of near copies of a site, of ``pages`` (host,
    page, distinct line keys).

    A page is linked to the smallest page of each of its bands if their line
    sets are alike; groups are what the links connect. Only page names and
    hashes move until a link is known, whatever share of the pages a band holds.
    """
    least = lambda i: F.array_min(F.transform(_KEYS, lambda k: F.xxhash64(k, F.lit(i))))
    bands = F.array(*[F.xxhash64(_HOST, *[least(b * ROWS + r) for r in range(ROWS)]) for b in range(BANDS)])
    sketch = scratch.write(pages.where(F.size(_KEYS) > 0).select(_PAGE, F.posexplode(bands).alias("band", "sig")), "bands")
    first = sketch.groupBy("band", "sig").agg(F.min(_PAGE).alias("to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = sketch.join(first, ["band", "sig"]).where(F.col(_PAGE) != F.col("to")).select(F.col(_PAGE).alias("a"), F.col("to").alias("b")).distinct()
    one, other = (pages.select(F.col(_PAGE).alias(x), F.col(_HOST).alias(f"host_{x}"), F.col(_KEYS).alias(f"keys_{x}")) for x in "ab")
    common = F.size(F.array_intersect("keys_a", "keys_b"))
    alike = common >= F.lit(SIMILARITY) * (F.size("keys_a") + F.size("keys_b") - common)
    links = scratch.write(met.join(one, "a").join(other, "b").where(F.col("host_a").eqNullSafe(F.col("host_b")) & alike).select("a", "b"), "links")
    again = components(links, "lines").where("node <> component").select(F.col("node").alias(_PAGE))
    counted = scratch.write(pages.join(again, _PAGE, "left_anti"), "counted")
    scratch.drop(sketch, links)
    return counted


def boilerplate(docs: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, count_copies: bool = True) -> DataFrame:
    """One row per site with boilerplate: site and its line keys."""
    keys = F.array_distinct(F.transform(F.filter(_lines(col(text)), lambda x: F.trim(x) != ""), _key)).alias(_KEYS)
    pages = docs.select(col(host).alias(_HOST), keys, *([] if count_copies else [F.md5(col(text)).alias("__ld_t")]))
    if not count_copies:
        scratch = Scratch(docs.sparkSession, "lines")
        name = F.md5(F.concat(F.coalesce("__ld_t", F.lit("")), F.coalesce(F.concat(F.lit(":"), F.col(_HOST).cast("string")), F.lit("")))).alias(_PAGE)
        texts = scratch.write(pages.groupBy(_HOST, "__ld_t").agg(F.first(_KEYS).alias(_KEYS)).select(_HOST, _KEYS, name), "pages")
        pages = _without_near_copies(texts, scratch)
        scratch.drop(texts)
    counts = (
        pages.select(_HOST, F.explode(_KEYS).alias(_KEY))
        .groupBy(_HOST, _KEY).agg(F.count(F.lit(1)).alias(_N)).where(F.col(_N) >= min_pages))
    totals = pages.groupBy(_HOST).agg(F.count(F.lit(1)).alias("__ld_pages")).withColumnRenamed(_HOST, "__ld_h")
    return (
        counts.join(totals, F.col(_HOST).eqNullSafe(F.col("__ld_h"))).where(F.col(_N) > F.lit(float(ratio)) * F.col("__ld_pages"))
        .groupBy(_HOST).agg(F.sort_array(F.collect_set(_KEY)).alias(_BOILER)))


def line_dedup(docs: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, count_copies: bool = True) -> DataFrame:
    """``docs`` with boilerplate lines cut out of ``text``.

    Adds ``n_lines`` and ``n_dropped`` (replacing input columns of these
    names). Lines are cut at line feeds and compared without outer blanks;
    blank lines stay and count in ``n_lines`` only. A line repeated on a page
    counts once for it. Rows with a null site form one site. Null texts stay
    null with 0 lines; repeated rows count as pages of their own. Without
    ``count_copies`` equal texts of a site and near copies, alike in
    ``SIMILARITY`` of their distinct lines, are one page, in the lines' counts
    and in the site's total, so that copies of a document do not make its lines
    boilerplate; pages that are nothing but a menu and a line or two are such
    copies too. The order of the lines that stay is kept, empty tables give
    empty results.
    """
    spark = docs.sparkSession
    docs = without(docs, "n_lines", "n_dropped")
    boiler = Scratch(spark, "lines").write(boilerplate(docs, text, host, ratio, min_pages, count_copies), "boilerplate")
    lines = _lines(col(text))
    kept = F.filter(F.col(_LINES), lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(_BOILER), _key(x)))
    joined = docs.join(boiler, col(host).eqNullSafe(F.col(_HOST)), "left").withColumn(_LINES, lines)
    size = lambda c: F.greatest(F.size(c), F.lit(0))  # noqa: E731  size of null is -1
    return (
        joined.withColumn("__ld_kept", F.when(F.col(_BOILER).isNull(), F.col(_LINES)).otherwise(kept))
        .select(*[(F.when(F.col(_BOILER).isNull(), col(text)).otherwise(F.concat_ws("\n", "__ld_kept")) if c == text else col(c)).alias(c) for c in docs.columns],
                size(F.col(_LINES)).cast("long").alias("n_lines"), (size(F.col(_LINES)) - size(F.col("__ld_kept"))).cast("long").alias("n_dropped"))
    ).withColumn(text, F.when(F.col("n_lines") > 0, col(text)))


ORACLE = f"""
with l as (select doc_id, source, text, string_split(text, chr(10)) as ls from documents),
u as (select doc_id, source, unnest(list_distinct(list_transform(ls, lambda x: trim(x, ' ')))) as k from l),
c as (select source, k, count(*) as n from u where k <> '' group by source, k),
t as (select source, count(*) as pages from documents group by source),
b as (select c.source, list(k) as ks from c join t on c.source is not distinct from t.source
      where n >= {MIN_PAGES} and n > {RATIO}::double * pages group by c.source),
r as (select doc_id, text, ls, case when ks is null then ls else list_filter(ls, lambda x: trim(x, ' ') = '' or not list_contains(ks, trim(x, ' '))) end as kept
      from l left join b on l.source is not distinct from b.source)
select doc_id, coalesce(len(ls), 0)::bigint as n_lines, (coalesce(len(ls), 0) - coalesce(len(kept), 0))::bigint as n_dropped,
       case when text is null then null else md5(array_to_string(kept, chr(10))) end as text_md5 from r
"""


def query(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.md5(F.col("text")).alias("text_md5"))
