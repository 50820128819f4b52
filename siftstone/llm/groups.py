"""Problem 1: pairwise matches into groups.

The pair graph is reduced before it is solved: vertices of degree two are compressed by list ranking (pointer doubling
along directed arcs, so a chain of n vertices takes log2(n) joins), vertices of degree one are stripped, both again
until the graph no longer shrinks much. The reduced core is solved by contraction, and the removed vertices take the
label of the vertex they hang on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.operators.components import contract, resolve_forest, symmetric
from siftstone.operators.hamming import hamming_pairs
from siftstone.operators.skew import heavy_keys, salted_lookup
from siftstone.schema import comparable, hex64, in_scope, unsigned_order
from siftstone.session import Scratch, table


def _degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.count(F.lit(1)).alias("d"), F.min("v").alias("n1"), F.max("v").alias("n2"))


def compress_chains(edges: DataFrame, deg: DataFrame, work: Scratch) -> tuple[DataFrame, DataFrame] | None:
    """Remove the vertices of degree two. Returns the new symmetric edges and pointers (v, parent), None without chains.

    An inner vertex points at the lower end of its chain, the ends are joined by an edge; a ring without any other
    vertex collapses onto its lowest vertex.
    """
    inner = deg.where("d = 2")
    if not inner.take(1):
        return None
    sides = inner.select(F.col("u").alias("c"), F.explode(F.array(F.struct(F.col("n1").alias("t"), F.col("n2").alias("o")), F.struct(F.col("n2").alias("t"), F.col("n1").alias("o")))).alias("s"))
    sides = sides.select("c", F.col("s.t").alias("t"), F.col("s.o").alias("o"))
    # arc c->t goes on as t->(the other neighbour of t) where t has degree two as well, else it ends in t
    ahead = inner.select(F.col("u").alias("t"), F.col("n1").alias("a1"), F.col("n2").alias("a2"))
    arcs = sides.join(ahead, "t", "left").select(
        "c", "t", F.col("t").alias("end"), F.least("c", "t").alias("low"),
        F.when(F.col("a1").isNotNull(), F.col("t")).alias("nc"),
        F.when(F.col("a1") == F.col("c"), F.col("a2")).otherwise(F.col("a1")).alias("nt"),
    )
    arcs, changed = work.save(arcs, "arcs"), True
    while changed:
        nxt = arcs.select(F.col("c").alias("nc"), F.col("t").alias("nt"), F.col("end").alias("e2"), F.col("low").alias("l2"), F.col("nc").alias("nc2"), F.col("nt").alias("nt2"), F.lit(True).alias("hit"))
        got = arcs.join(nxt, ["nc", "nt"], "left")
        step = got.select(
            "c", "t", F.coalesce("e2", "end").alias("end"), F.least("low", "l2").alias("low"),
            F.when(F.col("hit"), F.col("nc2")).alias("nc"), F.when(F.col("hit"), F.col("nt2")).alias("nt"),
            (F.col("hit") & (F.col("nc2").isNull() | (F.col("l2") < F.col("low")))).alias("moved"),
        )
        new = work.save(step, "arcs")
        changed = bool(new.where("moved").take(1))
        work.drop(arcs)
        arcs = new
    ranked = arcs.groupBy("c").agg(F.min("end").alias("e1"), F.max("end").alias("e2"), F.min("low").alias("low"), F.max(F.col("nc").isNotNull()).alias("ring"))
    ranked = work.save(ranked, "ranked")
    parents = ranked.select(F.col("c").alias("v"), F.when(F.col("ring"), F.col("low")).otherwise(F.col("e1")).alias("parent")).where("v <> parent")
    spans = ranked.where("not ring and e1 <> e2").select(F.col("e1").alias("u"), F.col("e2").alias("v")).distinct()
    rest = edges.join(inner.select("u"), "u", "left_anti").join(inner.select(F.col("u").alias("v")), "v", "left_anti").select("u", "v")
    return work.save(rest.union(spans).union(spans.select("v", "u")).distinct(), "edges"), parents


def strip_leaves(edges: DataFrame, deg: DataFrame, work: Scratch) -> tuple[DataFrame, DataFrame] | None:
    """Remove the vertices of degree one; of two that have only each other the lower stays. None if there are none."""
    leaf = deg.where("d = 1").select(F.col("u").alias("v"), F.col("n1").alias("parent"))
    if not leaf.take(1):
        return None
    mutual = leaf.select(F.col("parent").alias("v"), F.col("v").alias("parent"))
    keep = leaf.join(mutual, ["v", "parent"], "left_semi").where("v < parent")
    gone = work.save(leaf.join(keep, ["v", "parent"], "left_anti"), "leaves")
    rest = edges.join(gone.select(F.col("v").alias("u")), "u", "left_anti").join(gone.select("v"), "v", "left_anti").select("u", "v")
    return work.save(rest, "edges"), gone


def consolidate(pairs: DataFrame, a: str = "a", b: str = "b", least_gain: float = 0.05, work: Scratch | None = None) -> DataFrame:
    """``(v, root)``: for every id that has a pair with another id, one root per group of linked ids.

    ``pairs`` may repeat pairs, hold both directions and loops, and have other columns; pairs with a null end are
    ignored; an empty table gives no rows. The root is one of the group's ids. Reduction goes on while a round removes
    at least ``least_gain`` of the remaining vertices; what is left is solved whole.
    """
    work = work or Scratch(pairs.sparkSession, "groups")
    edges = first = work.save(symmetric(pairs, a, b), "edges")
    pointers: list[DataFrame] = []
    while True:
        deg = work.save(_degrees(edges), "degrees")
        n = deg.count()
        if not n:
            break
        if done := compress_chains(edges, deg, work):
            edges, removed = done
            pointers.append(removed)
            deg = work.save(_degrees(edges), "degrees")
        if done := strip_leaves(edges, deg, work):
            edges, removed = done
            pointers.append(removed)
        left = edges.select("u").distinct().count()
        if n - left < least_gain * n:
            break
    core = contract(edges, work).select("v", F.col("root").alias("parent"))
    forest = resolve_forest(reduce(DataFrame.union, pointers, core), work)
    everyone = first.select(F.col("u").alias("v")).distinct()
    return everyone.join(forest, "v", "left").select("v", F.coalesce("root", "v").alias("root"))


def picture_groups(files: DataFrame, threshold: int = 3, heavy_share: float = 0.01) -> DataFrame:
    """``(archive_id, file_id, group_phash)`` of the comparable pictures whose group of close fingerprints has two or more rows.

    Nulls in any column put a row out of the comparison, repeated rows of one key count once, equal fingerprints are
    one vertex, an empty table gives no rows, further columns are ignored.
    """
    work = Scratch(files.sparkSession, "pictures")
    pics = files.where(in_scope() & comparable()).select("archive_id", "file_id", F.col("phash").alias("h"))
    # whether a fingerprint has two different rows shows in the extremes of the two key columns
    spread = pics.groupBy("h").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{w}_{c}") for c in ("archive_id", "file_id") for w, f in (("lo", F.min), ("hi", F.max))])
    values = work.save(spread.select("h", "n", ((F.col("lo_archive_id") < F.col("hi_archive_id")) | (F.col("lo_file_id") < F.col("hi_file_id"))).alias("many")), "values")
    pairs = work.save(hamming_pairs(values, "h", threshold, work).select("a", "b"), "pairs")
    roots = work.save(consolidate(pairs, work=work), "roots")
    named = roots.groupBy("root").agg(F.min(unsigned_order(F.col("v"))).alias("low"))
    linked = roots.join(named, "root").select(F.col("v").alias("h"), unsigned_order(F.col("low")).alias("low"))
    labels = values.join(linked, "h", "left").where(F.col("low").isNotNull() | F.col("many")).select("h", hex64(F.coalesce("low", "h")).alias("group_phash"))
    heavy = [r.h for r in heavy_keys(values, "h", "n", heavy_share).select("h").collect()]  # at most 1 / heavy_share values
    once = pics.groupBy("archive_id", "file_id", "h").agg(F.lit(1).alias("_one")).drop("_one")
    return salted_lookup(once, labels, "h", heavy).select("archive_id", "file_id", "group_phash")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picture_groups(table(spark, sf_dir, "files"))


P1_SQL = """
WITH RECURSIVE rows AS (
  SELECT DISTINCT archive_id, file_id, phash AS h FROM files
  WHERE entry_type = 'file' AND content_hash IS NOT NULL AND kind = 'image' AND size >= 1 AND (flags & 24) = 0 AND bit_count(phash) BETWEEN 2 AND 62
), vals AS (SELECT h, count(*) AS n FROM rows GROUP BY 1
), bands AS (SELECT h, b, (h >> (48 - 16 * b)) & 65535 AS v FROM vals, range(4) t(b)
), links AS MATERIALIZED (SELECT DISTINCT x.h AS a, y.h AS b FROM bands x JOIN bands y ON x.b = y.b AND x.v = y.v AND x.h <> y.h AND bit_count(xor(x.h, y.h)) <= 3
), reach AS (SELECT h AS a, h AS b FROM vals UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), label AS (SELECT a AS h, min(printf('%016x', b)) AS group_phash FROM reach GROUP BY 1
), size AS (SELECT group_phash, sum(n) AS n FROM label JOIN vals USING (h) GROUP BY 1)
SELECT archive_id, file_id, group_phash FROM rows JOIN label USING (h) JOIN size USING (group_phash) WHERE size.n > 1
"""
