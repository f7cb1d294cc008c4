"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of shuffled document copies. A copy's virtual finish
time is the words of its queue up to its own end, divided by the source's
target; at time 1 each queue has been served its target, so the copy in
service there is cut to the words still owed. All copies are then range-sorted
by finish time and truncated at the total budget.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from flowspark.llm.common import Scratch, col, n_words, without
from flowspark.operators.ordering import row_numbers, running_sums

WEIGHTS, SHARE, MAX_REPEATS = (5, 2, 1), 1.5, 2


def targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = MAX_REPEATS) -> DataFrame:
    """Target words per source of ``totals`` (source, words).

    Sources take ``weights`` in code point order, null last, repeating. A
    target is ``level * weight`` but never above ``cap`` times the words of
    the source; the level that spends the whole budget is found by raising it
    while capped sources give their excess back (one small aggregate a round,
    the level only grows, so it ends).
    """
    spark = totals.sparkSession
    scratch = Scratch(spark, "mix")
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    table = scratch.write(row_numbers(totals, [F.col("source").asc_nulls_last()], "src").withColumn("weight", w), "sources")
    total = table.agg(F.sum("words")).first()[0] or 0
    budget, level = share * total, 0.0
    while True:
        at = F.col("weight") * F.lit(level) >= F.col("words") * F.lit(cap)
        capped, free = table.agg(F.sum(F.when(at, F.col("words") * cap).otherwise(0)), F.sum(F.when(at, 0).otherwise(F.col("weight")))).first()
        if not free:
            break
        raised = (budget - capped) / free
        if raised <= level:
            break
        level = raised
    target = F.least(F.col("weight") * F.lit(level), (F.col("words") * cap).cast("double"))
    return table.select("source", "src", F.col("words").alias("source_size"), target.alias("target"))


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS,
                share: float = SHARE, max_repeats: int = MAX_REPEATS, budget: int | None = None, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix of ``docs`` as two tables.

    The first has a row per input row: ``row`` (its number), doc_id, source,
    size, source_size, target and taken. The second has a row per copy that
    the mix takes: ``row``, ``copy`` (from 1), ``words`` taken of it, its
    ``finish`` and the ``served`` words of the mix up to its end, range-sorted
    in that order. ``budget`` truncates the mix earlier than the targets' sum.
    ``row`` names a column that numbers the rows of ``docs``, if it has one.

    Null and empty texts have size 0 and are never taken. Null sources form
    the last source. Ids may be null or repeated: each row is a document.
    Copies are shuffled by a hash of the id and the copy number, so reruns
    agree. Targets are served in whole words.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    base = scratch.write(docs.select(col(doc_id).alias("doc_id"), col(source).alias("source"), n_words(col(text)).alias("size"),
                                     (col(row) if row else F.monotonically_increasing_id()).alias("row")), "sizes")
    goals = scratch.write(targets(base.groupBy("source").agg(F.sum("size").alias("words")), weights, share, max_repeats), "targets")
    sized = base.join(goals.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    queued = (sized.where((F.col("size") > 0) & (F.col("target") > 0)).select("src", "row", "doc_id", "size", "target", F.explode(F.sequence(F.lit(1), F.lit(max_repeats))).alias("copy"))
              .withColumn("shuffle", F.md5(F.concat(name, F.lit(":"), F.col("copy").cast("string")).cast("binary"))))
    place = [F.col("copy"), F.col("shuffle"), F.col("doc_id"), F.col("size"), F.col("row")]
    ends = running_sums(queued, place, {"end": "size"}, keys=["src"])
    owed = F.floor("target").cast("long") - F.col("end") + F.col("size")
    cut = (ends.withColumn("words", F.least(F.col("size"), owed)).where("words > 0")
           .withColumn("finish", (F.col("end") - F.col("size") + F.col("words")) / F.col("target")))
    order = [F.col("finish"), F.col("src"), *place]
    mix = running_sums(cut, order, {"served": "words"})
    if budget is not None:
        mix = (mix.withColumn("words", F.least(F.col("words"), F.lit(int(budget)) - F.col("served") + F.col("words")))
               .where("words > 0").withColumn("served", F.least(F.col("served"), F.lit(int(budget)))))
    mix = scratch.write(mix.select("row", "copy", "words", "finish", "served"), "mix")
    taken = mix.groupBy("row").agg(F.sum("words").alias("taken"))
    rows = sized.join(taken, "row", "left").select("row", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return rows, mix


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, one row per copy in the columns of ``docs``.
    Texts stay whole: the one copy per source that is cut at the target is in
    when at least half of its words are served."""
    spark = docs.sparkSession
    docs = without(docs, "__row", "__copies")
    numbered = Scratch(spark, "mix").write(docs.withColumn("__row", F.monotonically_increasing_id()), "documents")
    rows, mix = mix_sources(numbered, row="__row", **options)
    copies = (mix.join(rows.select("row", "size"), "row").where("2 * words >= size")
              .groupBy(F.col("row").alias("__row")).agg(F.count(F.lit(1)).alias("__copies")))
    out = numbered.join(copies, "__row").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return out.select(*[col(c) for c in docs.columns])


_W = r"[^\x20\x09-\x0D]+"
ORACLE = f"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{_W}')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as words, row_number() over (order by source nulls last) - 1 as src from d group by source),
w as (select *, [5, 2, 1][(src % 3 + 1)::bigint]::bigint as weight, 2.0::double * words / [5, 2, 1][(src % 3 + 1)::bigint] as lim from s),
f as (select *, (1.5::double * (sum(words) over ())::double - coalesce(sum(2 * words) over (order by lim, src rows between unbounded preceding and 1 preceding), 0)::double)
        / (sum(weight) over (order by lim, src rows between current row and unbounded following))::double as level from w),
m as (select level from f where level <= lim order by lim, src limit 1),
t as (select source, src, words as source_size, case when (select level from m) is null then 2.0::double * words
        else least((select level from m) * weight, 2.0::double * words) end as target from w),
q as (select d.doc_id, t.src, d.size, t.target, c.copy, md5(concat(d.doc_id, ':', c.copy)) as h from d join t on d.source is not distinct from t.source, (values (1), (2)) c(copy) where d.size > 0),
e as (select *, sum(size) over (partition by src order by copy, h, doc_id rows unbounded preceding) as fin from q),
k as (select doc_id, sum(greatest(0, least(size, floor(target)::bigint - fin + size))) as taken from e group by doc_id)
select d.doc_id, d.size, t.source_size::bigint as source_size, t.target, coalesce(k.taken, 0)::bigint as taken
from d join t on d.source is not distinct from t.source left join k using (doc_id)
"""


def query(spark, sf_dir: str) -> DataFrame:
    rows, _ = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")
