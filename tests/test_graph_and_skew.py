import random

import pytest
from pyspark.sql import functions as F

from siftstone.operators import skew
from siftstone.operators.components import connected_components
from siftstone.operators.hamming import hamming_pairs
from siftstone.operators.heavy import heavy_values, value_counts


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def planted(n, seed=7):
    r = random.Random(seed)
    out = [r.getrandbits(64) for _ in range(n)]
    for _ in range(n // 4):
        x = r.choice(out)
        for b in r.sample(range(64), r.randint(1, 4)):
            x ^= 1 << b
        out.append(x)
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("t", [0, 1, 2, 3])
@pytest.mark.parametrize("hot", [512, 3])
def test_hamming_pairs_against_all_pairs(spark, t, hot):
    """A tiny bucket limit drives the refinement, which must find the same pairs."""
    r = random.Random(3)
    base = r.getrandbits(64)
    values = planted(300) + [base ^ (i << 20) for i in range(60)]
    values = list(dict.fromkeys(values))
    want = {tuple(sorted((signed(a), signed(b)))) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= t}
    df = spark.createDataFrame([(signed(v), i) for i, v in enumerate(values + values[:5])] + [(None, 0)], "h long, m int")
    got = hamming_pairs(df, "h", t, hot_bucket=hot).collect()
    assert len(got) == len(want) and {(x.a, x.b) for x in got} == want
    assert all(x.distance == ((x.a ^ x.b) & (2**64 - 1)).bit_count() for x in got)


def test_hamming_pairs_of_nothing(spark):
    assert hamming_pairs(spark.createDataFrame([], "h long"), "h").count() == 0


def test_exploded_fingerprints_are_never_broadcast(spark, tmp_path):
    """Under any threshold: the estimate of an exploded table is that of the table before, the driver would hold it whole."""
    from siftstone.operators import hamming

    r = random.Random(5)
    spark.createDataFrame([(signed(r.getrandbits(64)),) for _ in range(200)], "h long").write.parquet(f"{tmp_path}/prints")
    prints = spark.read.parquet(f"{tmp_path}/prints")
    masks = hamming.base_masks(3)
    k = hamming.keyed(prints.select(F.col("h").alias("lh")), "lh", masks)
    work = hamming.Scratch(spark, "plans")
    right, hot = k.withColumnRenamed("lh", "rh"), work.save(k.select("m", "v").limit(3), "hot")
    flips = hamming._by_flips(k, right, hot, [[0, 1]] * len(masks), 1, False, ())
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in (hamming_pairs(prints, "h"), hamming.close_keyed(k, right, 3, masks, work), flips.where("lh <> rh"))]
    for p in plans:  # what is broadcast, if anything, holds no exploded table
        assert "SortMergeJoin" in p and "Generate" not in "".join(broadcast_parts(p))


def broadcast_parts(plan):
    """The lines of a plan below its broadcasts."""
    deep = None
    for line in plan.splitlines():
        at = len(line) - len(line.lstrip(" :+-*"))
        if deep is not None and at <= deep:
            deep = None
        if deep is not None:
            yield line
        elif "BroadcastExchange" in line:
            deep = at


def union_find(edges):
    p = {}

    def find(x):
        p.setdefault(x, x)
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return {x: find(x) for x in p}


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    edges += [(r.randint(300, 400), r.randint(300, 400)) for _ in range(60)]
    df = spark.createDataFrame(edges + edges[:3] + [(None, 1), (5, None), (7, 7)], "a long, b long")
    got = {x.v: x.component for x in connected_components(df).collect()}
    assert got == union_find([(a, b) for a, b in edges if a != b])
    assert connected_components(df.limit(0)).count() == 0


def test_split_running(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", i, i * 10 if i % 5 else None) for i in range(400)] + [(None, 9000, 1), (None, 9001, None)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    got = {(x.k, x.o): (x.run, x.run_n) for x in skew.split_running(df, ["k"], ["o"], "v", "run", partitions=7).collect()}
    total, count = {}, {}
    for k, o, v in sorted(rows, key=lambda x: (x[0] or "", x[1])):
        count[k] = count.get(k, 0) + 1
        if v is not None:
            total[k] = total.get(k, 0) + v
        assert got[(k, o)] == (total.get(k), count[k])
    with pytest.raises(ValueError):
        skew.split_running(df.withColumn("run", F.lit(1)), ["k"], ["o"], "v", "run")


def test_split_counts_and_aggregates(spark):
    rows = [("hot", i % 50) for i in range(500)] + [(None, 1), (None, 1), ("x", None), ("x", None)]
    df = spark.createDataFrame(rows, "k string, o long")
    assert {(r.k, r.n) for r in skew.split_counts(df, ["k"], ["o"], 5).collect()} == {("hot", 50), (None, 1), ("x", 1)}
    got = skew.split_aggregate(df, ["k"], ["o"], {"top": F.max("o"), "c": F.count(F.lit(1))}, 5).collect()
    assert {(r.k, r.top, r.c) for r in got} == {("hot", 49, 500), (None, 1, 2), ("x", None, 2)}
    assert skew.split_counts(df.limit(0), ["k"], ["o"]).count() == 0


def test_salted_lookup_keeps_rows(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i}") for i in range(200)] + [(999, None)], "i long, k string")
    look = spark.createDataFrame([("hot", 1), ("k4", 2)], "k string, v int")
    plain = sorted(map(tuple, rows.join(look, "k", "left").select("i", "v").collect()), key=str)
    assert sorted(map(tuple, skew.salted_lookup(rows, look, "k", ["hot"], "left").select("i", "v").collect()), key=str) == plain


def test_heavy_values(make_files):
    """Ties and repeated rows count once, nulls are left out, extra columns with other operators' names are ignored."""
    rows = [dict(file_id=i, content_hash=b"\x01" * 32 if i % 2 else bytes([i % 250]) * 32, phash=-1 if i % 4 else i) for i in range(1, 201)]
    rows += rows[:30] + [dict(file_id=900, content_hash=None, phash=None)]
    f = make_files(rows).withColumn("n", F.lit(1)).withColumn("key", F.lit("x")).withColumn("total", F.lit(2))
    got = {tuple(r) for r in heavy_values(f, 0.02).collect()}
    assert got == {("content_hash", "01" * 32), ("phash", "f" * 16)}
    n = {(r.key_field, bytes(r.key).hex()): r.n for r in value_counts(f).collect()}
    assert n[("content_hash", "01" * 32)] == 100 and n[("phash", "f" * 16)] == 150
    assert heavy_values(f.limit(0)).count() == 0


def test_crowded_fingerprints(spark):
    """Values within three bits of one centre, which no band tells apart, against numpy."""
    import numpy as np

    from siftstone.operators import hamming

    r = np.random.default_rng(3)
    centre = 0x5A5A_1234_9876_F0F0
    low = np.arange(21)
    values = {centre ^ sum(1 << int(b) for b in r.choice(low, 3, replace=False)) for _ in range(900)} | {centre}
    values |= {centre ^ (1 << 60), centre ^ (1 << 60) ^ (1 << 40), 77}
    v = np.array(sorted(values), dtype=np.uint64)
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 3
    want = {(int(a), int(b)) for a, b in ((min(x, y), max(x, y)) for x, y in ((hamming.signed(int(v[i])), hamming.signed(int(v[j]))) for i, j in zip(*np.nonzero(np.triu(near, 1)))))}
    df = spark.createDataFrame([(hamming.signed(int(x)),) for x in v] * 2 + [(None,)], "h long")
    flips, hamming.comb = hamming.comb, lambda n, d: 1  # so that the last level takes the flips at this small size
    try:
        got = [(x.a, x.b) for x in hamming.hamming_pairs(df, "h", 3, hot_bucket=16).collect()]
    finally:
        hamming.comb = flips
    assert set(got) == want and len(got) == len(want)
    assert {(x.a, x.b) for x in hamming.hamming_pairs(df, "h", 3, hot_bucket=16).collect()} == want
