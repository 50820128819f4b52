"""Problem 3: new batches against all history.

``History`` keeps, in the shared folder, what a probe needs of everything accepted so far, in directories by hash bucket:
each content hash with the number of the first batch that held it, and the band keys of each fingerprint with the whole
fingerprint beside the key. A batch reads only the buckets that its own keys fall into, and of these only the rows that
share a key with it; a candidate counts once its whole fingerprint is verified. Then those of the batch's keys are
appended that are not yet stored, so a key is stored once however often it comes again.

The number of buckets follows the store: when buckets hold more than ``bucket_rows`` rows on average, the store is written
anew with twice as many, which costs a constant share for each stored row and merges the small files of many batches. So
what a small batch reads does not grow with the history.

A picture's fingerprint is itself the signature, so the band keys are cut from it (every pair of five bands, see
``operators.hamming``) instead of from minwise hashes of a shingle set; the same scheme, but without loss.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.operators.hamming import base_masks, close_keyed, keyed, signed
from siftstone.operators.skew import heavy_keys, salted_lookup
from siftstone.schema import comparable, in_scope
from siftstone.session import Scratch, table

LEDGER = -1  # batch number of what was accepted before the first batch
BUCKET_ROWS = 250_000  # stored rows of a bucket, about
SMALL = 200_000  # keys of a batch, of 16 to 40 bytes each, up to which they are broadcast to the store


class History:
    """A store of accepted contents. Its location must be a folder shared by all executors; one writer at a time."""

    EXACT, NEAR = "content_hash binary, seq long, bucket int", "rh long, seq long, m int, bucket int"

    def __init__(self, spark: SparkSession, location: str, threshold: int = 3, buckets: int | None = None, bucket_rows: int = BUCKET_ROWS):
        """``buckets`` is the number to begin with; left out, it follows from the first batch."""
        self.spark, self.at, self.threshold, self.first, self.bucket_rows = spark, location.rstrip("/"), threshold, buckets, bucket_rows
        self.masks = base_masks(threshold)
        self.state = self._load()

    # the state: which generation of the store is valid, its buckets and rows

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _load(self) -> dict:
        fs, path = self._fs("state.json")
        if not fs.exists(path):
            return {"generation": 0, "buckets": 0, "rows": 0}
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _store(self, **state) -> None:
        """The state changes at once: the new file takes the old one's place when it is complete."""
        fs, new = self._fs("state.json.new")
        stream = fs.create(new, True)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        _, path = self._fs("state.json")
        fs.delete(path, False)
        fs.rename(new, path)
        self.state = state

    @property
    def buckets(self) -> int:
        return self.state["buckets"]

    def _bucket(self, *cols: str, buckets: int | None = None):
        return F.pmod(F.xxhash64(*cols), F.lit(buckets or self.buckets)).cast("int")

    def _read(self, what: str) -> DataFrame:
        schema = self.EXACT if what == "exact" else self.NEAR
        at = f"{self.at}/g{self.state['generation']}/{what}"
        stored = self.spark.read.schema(schema).parquet(at) if self.buckets else self.spark.createDataFrame([], schema)
        return stored if what == "exact" else self._with_key(stored)

    def _with_key(self, stored: DataFrame) -> DataFrame:
        """The key's bits follow from the fingerprint and the mask's number, so they aren't stored."""
        return stored.withColumn("v", F.col("rh").bitwiseAND(F.element_at(F.array(*[F.lit(signed(k)).cast("long") for k in self.masks]), F.col("m") + 1)))

    def _write(self, exact: DataFrame, near: DataFrame, generation: int, buckets: int) -> None:
        """Rows of one bucket are written by several tasks where they are many."""
        spread = self.spark.conf.get("spark.sql.shuffle.partitions")
        for what, df, key in (("exact", exact, ("content_hash",)), ("near", near, ("m", "v"))):
            df = df.withColumn("bucket", self._bucket(*key, buckets=buckets))
            salt = F.pmod(F.hash(*key), F.lit(max(1, -(-int(spread) // buckets))))
            df.repartition("bucket", salt).drop("v").write.mode("append").partitionBy("bucket").parquet(f"{self.at}/g{generation}/{what}")

    def append(self, batch: DataFrame) -> None:
        """Store the keys of ``batch(seq, content_hash, phash)`` that are not stored yet; phash is null but for comparable pictures.

        Equal keys of one append are stored once, under their lowest seq. Rows without a content_hash store no exact
        key, rows without a seq none at all. An empty batch stores nothing. Batches must come in the order of their
        numbers: a key stays under the number that it came with first.
        """
        work = Scratch(self.spark, "append")
        batch = batch.where("seq is not null")
        exact = batch.where("content_hash is not null").groupBy("content_hash").agg(F.min("seq").alias("seq"))
        prints = batch.where("phash is not null").groupBy(F.col("phash").alias("rh")).agg(F.min("seq").alias("seq"))
        if self.buckets:
            exact = work.save(exact.withColumn("bucket", self._bucket("content_hash")), "exact")
            exact = exact.join(self._matching("exact", exact, ["content_hash"]).select("bucket", "content_hash"), ["bucket", "content_hash"], "left_anti").drop("bucket")
            # a stored fingerprint is found by any one of its keys, so the first one will do
            one = work.save(keyed(prints, "rh", self.masks[:1]).withColumn("bucket", self._bucket("m", "v")), "prints")
            prints = one.join(self._matching("near", one, ["m", "v"]).select("rh"), "rh", "left_anti").select("rh", "seq")
        exact, prints = work.save(exact, "new-exact"), work.save(prints, "new-prints")
        rows = exact.count() + prints.count() * len(self.masks)
        if not rows:
            return
        total, buckets = self.state["rows"] + rows, self.buckets or self.first or 1
        while total > 2 * self.bucket_rows * buckets:
            buckets *= 2
        generation = self.state["generation"]
        near = keyed(prints, "rh", self.masks)
        if self.buckets and buckets > self.buckets:
            generation += 1
            exact = self._read("exact").drop("bucket").unionByName(exact)
            near = self._read("near").drop("bucket").unionByName(near)
        self._write(exact, near, generation, buckets)
        outgrown = self.state["generation"] if generation > self.state["generation"] else None
        self._store(generation=generation, buckets=buckets, rows=total)
        if outgrown is not None:
            fs, path = self._fs(f"g{outgrown}")
            fs.delete(path, True)

    def _matching(self, what: str, probe: DataFrame, keys: list[str]) -> DataFrame:
        """The stored rows that share a key with the probe, read from the probe's buckets only.

        ``probe`` must be a written table. A small one is broadcast (its rows are counted first), so that nothing of the
        store is shuffled; of a large one all buckets are read and joined by shuffle.
        """
        stored = self._read(what)
        if not self.buckets:
            return stored
        n = probe.count()
        if n < 50 * self.buckets:  # else hardly a bucket is left out; the numbers that come to the driver are at most `buckets`
            stored = stored.where(F.col("bucket").isin([r.bucket for r in probe.select("bucket").distinct().collect()]))
        wanted = probe.select("bucket", *keys).distinct()
        return stored.join(F.broadcast(wanted) if n <= SMALL else wanted, ["bucket", *keys], "left_semi")

    def match(self, batch: DataFrame, work: Scratch | None = None, heavy_share: float = 0.01) -> DataFrame:
        """``batch(seq, content_hash, phash, ...)`` with ``match_kind`` exact, near or null.

        A row matches what is stored under a lower seq. So one call may hold one batch, or many whose keys are stored
        already. Repeated rows stay repeated. Further columns pass through under whatever names; a ``match_kind`` that the
        batch has already is replaced. Rows without a seq match nothing.
        """
        others = {c: f"_other{i}" for i, c in enumerate(batch.columns) if c not in ("seq", "content_hash", "phash", "match_kind")}
        batch = batch.select("seq", "content_hash", "phash", *[F.col(f"`{c}`").alias(x) for c, x in others.items()])
        work = work or Scratch(self.spark, "probe")
        rows = batch.count()
        if self.buckets and rows <= SMALL:
            mine = work.save(batch.where("content_hash is not null").select("content_hash").distinct().withColumn("bucket", self._bucket("content_hash")), "hashes")
            held = self._matching("exact", mine, ["content_hash"])
        else:
            held = self._read("exact")
        exact = held.select("content_hash", F.col("seq").alias("first_exact"))

        prints = work.save(batch.where("phash is not null").groupBy("phash").agg(F.count(F.lit(1)).alias("n")), "prints")
        probe = keyed(prints.select(F.col("phash").alias("lh")), "lh", self.masks)
        if self.buckets:
            probe = probe.withColumn("bucket", self._bucket("m", "v"))
        if self.buckets and prints.count() * len(self.masks) <= SMALL:
            probe = work.save(probe, "probe")
            stored = self._matching("near", probe, ["m", "v"])
        else:
            stored = self._read("near")
        links = close_keyed(probe.select("m", "v", "lh"), stored.select("m", "v", "rh", "seq"), self.threshold, self.masks, work, extra=("seq",))
        near = links.groupBy("lh").agg(F.min("seq").alias("first_near")).withColumnRenamed("lh", "phash")

        # which hashes are heavy only decides how rows are spread, so a sample tells
        some = batch.where("content_hash is not null").select("content_hash").sample(min(1.0, 100_000 / max(rows, 1)), seed=1)
        heavy_hash = [bytes(r.content_hash) for r in heavy_keys(some.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n")), "content_hash", "n", heavy_share).select("content_hash").collect()]
        heavy_print = [r.phash for r in heavy_keys(prints, "phash", "n", heavy_share).select("phash").collect()]
        # rows without a hash or a fingerprint are spread too: they match nothing, but would meet in one task
        out = batch.withColumn("_hash", F.coalesce("content_hash", F.hash("phash", "seq", F.rand(1)).cast("string").cast("binary")))
        exact = exact.select(F.col("content_hash").alias("_hash"), "first_exact")
        out = salted_lookup(out, exact, "_hash", heavy_hash, "left").drop("_hash")
        out = out.withColumn("_probe", F.coalesce("phash", F.xxhash64("content_hash", "seq")))
        near = near.select(F.col("phash").alias("_probe"), F.col("phash").alias("_held"), "first_near")
        out = salted_lookup(out, near, "_probe", heavy_print, "left")
        known = F.col("content_hash").isNotNull() & (F.col("first_exact") < F.col("seq"))
        kind = F.when(known, "exact").when(F.col("phash").eqNullSafe(F.col("_held")) & (F.col("first_near") < F.col("seq")), "near")
        return out.select("seq", "content_hash", "phash", *[F.col(x).alias(c) for c, x in others.items()], kind.alias("match_kind"))

    def accept(self, batch: DataFrame) -> DataFrame:
        """Probe a batch, then append its new keys: ``match`` and ``append`` in this order, the matches in a written table."""
        found = Scratch(self.spark, "accepted").save(self.match(batch), "matched")
        self.append(batch.select("seq", "content_hash", "phash"))
        return found


def batch_rows(files: DataFrame) -> DataFrame:
    """In-scope rows as batch rows: seq is the archive."""
    return files.where(in_scope()).select(F.col("archive_id").alias("seq"), "archive_id", "file_id", "content_hash", F.when(comparable(), F.col("phash")).alias("phash"))


def ledger_rows(accepted: DataFrame) -> DataFrame:
    return accepted.select(F.lit(LEDGER).cast("long").alias("seq"), "content_hash", F.when(comparable(), F.col("phash")).alias("phash"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All archives in one probe: each key is stored under the number of the first archive that has it, and a row matches lower numbers only.

    Hundreds of archives one after another would be hundreds of rounds of small jobs; a test shows that ``accept`` batch by batch gives the same.
    """
    work = Scratch(spark, "batches")
    history = History(spark, work.path("history"))
    batches = batch_rows(table(spark, sf_dir, "files"))
    history.append(ledger_rows(table(spark, sf_dir, "accepted")).unionByName(batches.select("seq", "content_hash", "phash")))
    found = history.match(batches, work)
    # repeated rows of one key count once; only what matched is shuffled for that
    return found.where("match_kind is not null").select("archive_id", "file_id", "match_kind").distinct()


P3_SQL = """
WITH rows AS (
  SELECT DISTINCT archive_id, file_id, content_hash,
    CASE WHEN kind = 'image' AND bit_count(phash) BETWEEN 2 AND 62 THEN phash END AS h
  FROM files
  WHERE entry_type = 'file' AND content_hash IS NOT NULL AND kind IS DISTINCT FROM 'empty' AND size >= 1 AND (flags & 24) = 0
), held AS (
  SELECT content_hash, h, archive_id AS seq FROM rows
  UNION ALL SELECT content_hash, CASE WHEN kind = 'image' AND bit_count(phash) BETWEEN 2 AND 62 THEN phash END, -1 FROM accepted
), ex AS (SELECT content_hash, min(seq) AS s FROM held GROUP BY 1
), prints AS (SELECT h, min(seq) AS s FROM held WHERE h IS NOT NULL GROUP BY 1
), bands AS (SELECT h, s, b, (h >> (48 - 16 * b)) & 65535 AS v FROM prints, range(4) t(b)
), near AS (SELECT x.h, min(y.s) AS s FROM bands x JOIN bands y ON x.b = y.b AND x.v = y.v AND bit_count(xor(x.h, y.h)) <= 3 GROUP BY 1)
SELECT archive_id, file_id, CASE WHEN ex.s < archive_id THEN 'exact' ELSE 'near' END AS match_kind
FROM rows JOIN ex USING (content_hash) LEFT JOIN near USING (h)
WHERE ex.s < archive_id OR near.s < archive_id
"""
