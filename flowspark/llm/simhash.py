"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within 3 bits meet at a point within half that radius of
both, so every fingerprint emits its ball and equal points bring near ones
together. Half of 3 is 1 with one bit over:

- Pairs within 2 bits share a point of their balls of radius 1. All members of
  a point are within 2 bits of each other, at most 65 of them, so each is
  linked to the smallest and nothing is lost.
- For pairs of exactly 3 bits one bit is left out with its block: the 64 bits
  form ``blocks`` blocks, a fingerprint without one block emits its ball of
  radius 1, and a pair with a differing bit in that block meets. Only points
  that join different components of the first step are kept, their pairs
  verified bit by bit.

Equal fingerprints are one from the start, so copies cost nothing here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from flowspark.llm.common import Scratch, col, without, words_of
from flowspark.llm.components import components

SHINGLE, SEED, RADIUS, BLOCKS = 3, 42, 3, 3
_SLICE = 1 << 16  # shingles whose bits are unpacked at a time


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """Bit i is 1 if it is set in over half of the shingles' hashes."""
    n = len(words) - shingle + 1
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if n < 1:
        return digest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, (ends[shingle - 1:] - 1).tolist(), strict=True)), np.uint64, n)
    set_bits = np.zeros(64, np.int64)
    for i in range(0, n, _SLICE):
        set_bits += np.unpackbits(hashes[i : i + _SLICE].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > n).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): 64 bits as a long. Null and empty texts give 0."""
    kind = docs.schema[doc_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(words_of(t), shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("fp", T.LongType())])
    return docs.select(col(doc_id).alias("doc_id"), col(text).alias("text")).mapInArrow(run, schema)


def _mask(bits: range) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def _ball(fp, bits: list[int]):
    """The value and its neighbours that differ in one of ``bits``."""
    return F.array(fp, *[fp.bitwiseXOR(F.lit(_mask(range(b, b + 1)))) for b in bits])


def link_fingerprints(fps: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """(fp, root) of distinct fingerprints ``fps`` (fp) that have a neighbour
    within 3 bits; the root is one fingerprint of each component."""
    from pyspark.sql import Window as W

    scratch = Scratch(fps.sparkSession, "simhash")
    points = fps.select("fp", F.explode(_ball(F.col("fp"), list(range(64)))).alias("point"))
    near = points.withColumn("root", F.min("fp").over(W.partitionBy("point"))).where("fp <> root").select(F.col("fp").alias("a"), F.col("root").alias("b"))
    edges = scratch.write(near.distinct(), "near")
    first = components(edges, "simhash")
    named = scratch.write(fps.join(first, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("root")), "first")
    scratch.drop(edges)

    cuts = [64 * i // blocks for i in range(blocks + 1)]
    balls = []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        rest = [b for b in range(64) if not lo <= b < hi]
        balls.append(_ball(F.col("fp").bitwiseAND(F.lit(_mask(rest))), rest))
    points = named.select("fp", "root", F.explode(F.concat(*balls)).alias("point"))
    w = W.partitionBy("point")
    mixed = (points.withColumn("lo", F.min("root").over(w)).withColumn("hi", F.max("root").over(w)).where("lo <> hi").select("point", "fp", "root"))
    mixed = scratch.write(mixed, "mixed")
    other = mixed.select("point", F.col("fp").alias("fp2"), F.col("root").alias("root2"))
    far = (mixed.join(other, (mixed.point == other.point) & (F.col("root") < F.col("root2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= RADIUS))
           .select(F.col("root").alias("a"), F.col("root2").alias("b")).distinct())
    edges = scratch.write(far, "far")
    second = components(edges, "simhash")
    out = named.join(second, F.col("root") == F.col("node"), "left").select("fp", F.coalesce("component", "root").alias("root"))
    out = scratch.write(out, "roots")
    scratch.drop(mixed, edges, named)
    return out


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, fp, component_id) with a row per input row.

    ``component_id`` is the smallest id reachable over fingerprints that differ
    in 3 bits or fewer. Null, empty and blank texts have fingerprint 0 and link
    like any other. Null ids never name a component unless no member has an id.
    Repeated rows, ties and empty tables need no special case.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.write(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    groups = scratch.write(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = link_fingerprints(groups.select("fp"), blocks)
    named = groups.join(roots, "fp")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    table = scratch.write(named.join(ids, "root").select("fp", "component_id"), "components")
    scratch.drop(groups)
    return marked.join(table, "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group: that with the smallest id.

    Rows are told apart by a number of their own, so different texts under one
    id both stay if they are in different groups, and of equal rows one stays.
    Rows without an id all stay. Null, empty and blank texts are one group;
    long texts count as a whole; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    numbered = scratch.write(without(docs, "__row").withColumn("__row", F.monotonically_increasing_id()), "documents")
    rows = numbered.where(col(doc_id).isNotNull()).select(F.struct(col(doc_id).alias("id"), F.col("__row").alias("row")).alias("row"), col(text).alias("text"))
    kept = simhash_groups(rows, "row", "text").where("doc_id = component_id").select(F.col("doc_id.row").alias("__row"))
    kept = kept.union(numbered.where(col(doc_id).isNull()).select("__row"))
    return numbered.join(kept, "__row", "left_semi").select(*[col(c) for c in docs.columns if c != "__row"])


def query(spark, sf_dir: str) -> DataFrame:
    out = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
