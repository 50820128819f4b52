"""Problem 6: filling containers of fixed capacity.

Texts are measured in tokens. A text longer than the capacity is cut into pieces of exactly the capacity and a rest;
nothing else is split. Items are then packed by cost: a sequence costs a part linear in its tokens and a part quadratic
in the tokens of each item (attention does not cross items), and items go, longest first, to the cheapest sequence that
still has room, so that sequences come out both full and alike in work.

At scale nothing is packed in one place: items are dealt, by size rank within a random order, to shards of a bounded
number of tokens, each shard is packed on its own, and what is left in each shard's last, poorly filled containers is
packed again in fewer, coarser shards until one bounded shard is left, or until a round seals less than a fifth of its
items.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.session import Scratch, table

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that the public byte-level vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHARD_ITEMS = 20_000  # items that one task packs
QUADRATIC = 1 / 4096  # an item of n tokens costs n + QUADRATIC * n * n
WELL_FILLED = 0.985  # containers filled less than this are opened again while there are several shards

_ENCODERS: dict[str, object] = {}


def encoder(vocabulary: str):
    """The tokenizer of a vocabulary file, once per process."""
    if vocabulary not in _ENCODERS:
        import base64

        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[vocabulary] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[vocabulary]


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, n_tokens)``: the whole text in tokens of the public tokenizer; null texts count 0, rows without a doc_id are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in b["text"]]})

    return documents.select("doc_id", "text").where("doc_id is not null").mapInPandas(run, "doc_id long, n_tokens long")


def pieces(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """``(target_id, capacity, gap, doc_id, piece, start_token, n)``: items of every target, longer ones cut.

    ``targets`` is a small table; texts of no tokens need no room and are left out.
    """
    t = targets.where("capacity_tokens > 0 and target_id is not null").select("target_id", F.col("capacity_tokens").cast("long").alias("capacity"), F.coalesce("gap_tokens", F.lit(0)).cast("long").alias("gap")).dropDuplicates(["target_id"])
    every = t.agg(F.collect_list(F.struct("target_id", "capacity", "gap")).alias("ts"))  # one row
    items = counts.where("n_tokens > 0 and doc_id is not null").select("doc_id", "n_tokens").join(F.broadcast(every)).select("doc_id", "n_tokens", F.explode("ts").alias("t"))
    items = items.select("doc_id", "n_tokens", "t.*")
    cut = items.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("n_tokens") - 1) / F.col("capacity")).cast("long"))))
    start = F.col("piece") * F.col("capacity")
    return cut.select("target_id", "capacity", "gap", "doc_id", "piece", start.alias("start_token"), F.least("capacity", F.col("n_tokens") - start).alias("n"))


def pack(sizes: list[int], capacity: int, gap: int) -> list[int]:
    """Container number of each item (all at most capacity): longest first into the cheapest container with room.

    Where that needs more containers than the total asks for, items too long to be levelled out later (over an eighth
    of the capacity, then all) go into the fullest container with room instead, and the packing with the fewest
    containers counts; among equals the one most alike in cost, which is the earlier.
    """
    if not sizes:
        return []
    best: list[int] = []
    least = -(-sum(s + gap for s in sizes) // (capacity + gap))
    for share in (None, 8, capacity):
        where = _pack_once(sizes, capacity, gap, capacity if share is None else capacity // share)
        if not best or max(where) < max(best):
            best = where
        if max(best) + 1 <= least:
            break
    return best


def _pack_once(sizes: list[int], capacity: int, gap: int, level: int) -> list[int]:
    """One pass in descending order: items up to ``level`` by cost, longer ones into the fullest container with room."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    k = max(1, -(-sum(s + gap for s in sizes) // (capacity + gap)))
    left = [capacity + gap] * k
    cost = [0.0] * k
    cheap = [(0.0, c) for c in range(k)]  # heap of (cost, container), with entries that are out of date
    full: list[tuple[int, int]] = []  # heap of (-room, container): what had no room, until items are short enough for it
    rooms = [(capacity + gap, c) for c in range(k)]  # sorted by room
    where = [0] * len(sizes)
    for i in order:
        need, c = sizes[i] + gap, -1
        while full and -full[0][0] >= need:  # needs only fall, so each container comes back once for each item it takes
            room, x = heapq.heappop(full)
            if left[x] == -room:
                heapq.heappush(cheap, (cost[x], x))
        while sizes[i] <= level and cheap and c < 0:
            price, x = heapq.heappop(cheap)
            if price != cost[x]:
                continue
            if left[x] >= need:
                c = x
            else:
                heapq.heappush(full, (-left[x], x))
        if c < 0 and (j := bisect_left(rooms, (need, -1))) < len(rooms):
            c = rooms[j][1]
        if c < 0:
            c = len(left)
            left.append(capacity + gap)
            cost.append(0.0)
            insort(rooms, (left[c], c))
        rooms.pop(bisect_left(rooms, (left[c], c)))
        left[c] -= need
        insort(rooms, (left[c], c))
        cost[c] += sizes[i] + QUADRATIC * sizes[i] * sizes[i]
        heapq.heappush(cheap, (cost[c], c))
        where[i] = c
    return where


def _pack_shards(items: DataFrame, shard: str, last: bool) -> DataFrame:
    """``(target_id, doc_id, piece, start_token, n, capacity, gap, shard, container, kept)`` of each shard's packing."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
        capacity, gap = int(pdf["capacity"].iloc[0]), int(pdf["gap"].iloc[0])
        pdf["container"] = pack(pdf["n"].tolist(), capacity, gap)
        used = (pdf["n"] + gap).groupby(pdf["container"]).transform("sum") - gap
        pdf["kept"] = True if last else used >= WELL_FILLED * capacity
        return pdf[["target_id", "capacity", "gap", "doc_id", "piece", "start_token", "n", "shard", "container", "kept"]]

    schema = "target_id int, capacity long, gap long, doc_id long, piece long, start_token long, n long, shard long, container long, kept boolean"
    return items.groupBy("target_id", shard).applyInPandas(run, schema)


def pack_documents(counts: DataFrame, targets: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``(target_id, container_id, doc_id, piece, start_token, n_tokens)``: the container of every text or piece.

    Repeated rows of one doc_id count once (with the largest count); rows without a doc_id and texts of no tokens are left
    out, and so are containers without a number or a positive capacity; further columns are ignored. Every item is in exactly one container of each target, no container holds
    more than its capacity, the gaps between neighbours included. Empty tables give no rows.
    """
    spark = counts.sparkSession
    work = Scratch(spark, "packing")
    items = work.save(pieces(counts.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens")), targets), "items")
    done: list[DataFrame] = []
    level, before = 0, None
    while True:
        sizes = {r["target_id"]: r["count"] for r in items.groupBy("target_id").count().collect()}  # a row per container kind
        largest, left = max(sizes.values(), default=0), sum(sizes.values())
        shards = max(1, -(-largest // shard_items))
        # shards are drawn at random and look alike: where a round could seal hardly any container, the next can't either
        last = shards == 1 or before is not None and left > 0.8 * before
        before = left
        spread = F.pmod(F.xxhash64("doc_id", "piece", F.lit(level)), F.lit(shards))
        packed = work.save(_pack_shards(items.withColumn("shard", spread.cast("long")), "shard", last), "packed")
        done.append(packed.where("kept").withColumn("level", F.lit(level)))
        if last:
            break
        items, level = packed.where("not kept").select("target_id", "capacity", "gap", "doc_id", "piece", "start_token", "n"), level + 1
    named = F.concat_ws("-", "level", "shard", "container")
    return reduce(DataFrame.union, done).select("target_id", named.alias("container_id"), "doc_id", "piece", "start_token", F.col("n").alias("n_tokens"))


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(token_counts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "pack_targets"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(target_id, containers, least_containers, unused_share)`` of the packing: what the containers leave unused."""
    packed = p6_pack(spark, sf_dir)
    targets = table(spark, sf_dir, "pack_targets").select("target_id", "capacity_tokens", "gap_tokens")
    filled = packed.groupBy("target_id", "container_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("k")).join(targets, "target_id")
    used = F.col("n") + (F.col("k") - 1) * F.col("gap_tokens")
    return filled.groupBy("target_id").agg(
        F.count(F.lit(1)).alias("containers"),
        F.ceil(F.sum(F.col("n") + F.col("k") * F.col("gap_tokens")) / F.max(F.col("capacity_tokens") + F.col("gap_tokens"))).alias("least_containers"),
        (1 - F.sum(used) / F.sum("capacity_tokens")).alias("unused_share"),
    )
