"""Connected components by randomised contraction: aggregates and joins only, written tables between the rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.operators.skew import shuffled
from siftstone.session import Scratch


def symmetric(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Both directions of every edge once; loops and edges with a null end are dropped."""
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    return e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def resolve_forest(parents: DataFrame, work: Scratch) -> DataFrame:
    """``(v, root)`` from pointers ``(v, parent)`` without cycles, by pointer jumping; self-pointers are roots."""
    f = work.save(parents.select("v", F.col("parent").alias("root")).where("v <> root"), "forest")
    while True:
        up = f.select(F.col("v").alias("root"), F.col("root").alias("above"))
        g = work.save(f.join(shuffled(up), "root", "left").select("v", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "jump")
        again = bool(g.where("moved").take(1))
        work.drop(f)
        f = g
        if not again:
            return f.select("v", "root")


def contract(edges: DataFrame, work: Scratch) -> DataFrame:
    """``(v, root)`` of every vertex of the symmetric edges ``(u, v)``; root is some vertex of its component.

    In each round every vertex points at the one of lowest random rank among itself and its neighbours (an aggregate
    with map-side combining), and the edges are relabelled with two equi-joins; the number of vertices with edges
    falls by a constant factor. The rounds' maps are then composed from the last, smallest one backwards.
    """
    maps, e, seed = [], edges, 0
    while e.take(1):
        seed += 1
        rank = lambda c: F.xxhash64(F.lit(seed), F.col(c))  # noqa: E731, B023
        best = e.groupBy("u").agg(F.min_by("v", rank("v")).alias("n"))
        m = work.save(best.select("u", F.when(rank("n") < rank("u"), F.col("n")).otherwise(F.col("u")).alias("p")), "map")
        maps.append(m)
        mu, mv = m.select("u", F.col("p").alias("pu")), m.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        e = work.save(e.join(shuffled(mu), "u").join(shuffled(mv), "v").select(F.col("pu").alias("u"), F.col("pv").alias("v")).where("u <> v").distinct(), "edges")
    if not maps:
        return edges.select("v", F.col("u").alias("root")).limit(0)
    out = None
    for m in reversed(maps):
        m = m.select(F.col("u").alias("v"), F.col("p").alias("root"))
        if out is not None:
            m = m.join(shuffled(out.select(F.col("v").alias("root"), F.col("root").alias("above"))), "root", "left").select("v", F.coalesce("above", "root").alias("root"))
        out = m
    return out


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", work: Scratch | None = None) -> DataFrame:
    """``(v, component)`` for every vertex with an edge to another; component is the lowest vertex reachable.

    Null ends and loops are ignored, repeated edges count once, an empty table gives no rows.
    """
    work = work or Scratch(edges.sparkSession, "components")
    e = work.save(symmetric(edges, a, b), "edges")
    roots = work.save(contract(e, work), "roots")
    low = roots.groupBy("root").agg(F.min("v").alias("component"))
    return roots.join(shuffled(low), "root").select("v", "component")
