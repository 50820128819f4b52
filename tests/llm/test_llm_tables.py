"""Problems on file rows: groups, batches, survivors, paths. Brute force on small fixtures."""

import random

from pyspark.sql import functions as F

from siftstone.llm import encodings, groups, history, survivors
from siftstone.session import Scratch


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def roots(edges):
    p = {}

    def find(x):
        p.setdefault(x, x)
        while p[x] != x:
            x = p[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    out = {}
    for x in p:
        out.setdefault(find(x), set()).add(x)
    return {frozenset(v) for v in out.values()}


def test_consolidate_shapes(spark):
    """Paths, stars, rings, trees, a dense core with tails, repeated and reversed pairs, loops and null ends."""
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(20)] + [(50, 50 + i) for i in range(1, 9)] + [(70 + i, 70 + (i + 1) % 7) for i in range(7)]
    edges += [(r.randint(100, 115), r.randint(100, 115)) for _ in range(40)] + [(115, 116), (116, 117), (117, 118), (200, 201)]
    edges = [(a, b) for a, b in edges if a != b]
    df = spark.createDataFrame(edges + [(b, a) for a, b in edges[:9]] + [(None, 3), (4, None), (9, 9)], "a long, b long").withColumn("root", F.lit(1))
    out = {}
    for x in groups.consolidate(df).collect():
        out.setdefault(x.root, set()).add(x.v)
    assert {frozenset(v) for v in out.values()} == roots(edges) and all(k in v for k, v in out.items())


def test_picture_groups(make_files):
    a, b, c = 0xE94AE84A1FB2B932, 0xE94AE94A1FB29932, 0xE94AE94A1FB39912
    rows = [dict(file_id=1, phash=signed(a)), dict(file_id=2, phash=signed(b)), dict(archive_id=2, phash=signed(c)), dict(file_id=5, phash=77777), dict(file_id=6, phash=0), dict(file_id=7, phash=0)]
    rows += [dict(file_id=8, phash=99999), dict(file_id=8, phash=99999), dict(file_id=10, phash=123456789), dict(file_id=11, phash=123456789), dict(file_id=12, phash=None, kind=None)]
    got = {tuple(r) for r in groups.picture_groups(make_files(rows).withColumn("h", F.lit(1)).withColumn("low", F.lit(1))).collect()}
    low = f"{min(a, b, c):016x}"
    assert got == {(1, 1, low), (1, 2, low), (2, 1, low), (1, 10, f"{123456789:016x}"), (1, 11, f"{123456789:016x}")}
    assert groups.picture_groups(make_files(rows).limit(0)).count() == 0


def test_history_batch_by_batch_equals_all_at_once(spark):
    r = random.Random(4)
    prints = [r.getrandbits(64) for _ in range(12)]
    rows = [(r.randint(1, 4), bytes([r.randint(1, 25)]) * 32, signed(r.choice(prints) ^ (1 << r.randint(0, 63))) if r.random() < 0.6 else None, i) for i in range(90)]
    rows += [(2, None, None, 500), (3, b"z" * 32, signed(prints[0]), 501)]
    df = spark.createDataFrame(rows, "seq long, content_hash binary, phash long, bucket long").withColumn("first_exact", F.lit(1))
    work = Scratch(spark, "t")
    whole = history.History(spark, work.path("a"), buckets=2)
    whole.append(df.select("seq", "content_hash", "phash"))
    at_once = {x.bucket: x.match_kind for x in whole.match(df).collect()}
    step = history.History(spark, work.path("b"), buckets=2)
    step.append(df.limit(0).select("seq", "content_hash", "phash"))
    one = {}
    for s in range(1, 5):
        batch = df.where(F.col("seq") == s)
        if s > 1:
            one |= {x.bucket: x.match_kind for x in step.match(batch).collect()}
        else:
            one |= {x.bucket: None for x in batch.collect()}
        step.append(batch.select("seq", "content_hash", "phash"))
    want = {}
    for s, h, p, i in rows:
        before = [x for x in rows if x[0] < s]
        near = p is not None and any(x[2] is not None and ((x[2] ^ p) & (2**64 - 1)).bit_count() <= 3 for x in before)
        want[i] = "exact" if h is not None and any(x[1] == h for x in before) else "near" if near else None
    assert at_once == one == want


def test_survivors(make_files, make_archives):
    """Ties go to the shorter path, then the lower key; a field comes from the first row that has it; dates by trust."""
    rows = [
        dict(file_id=1, path="b.jpg", mtime_unix=5), dict(file_id=2, path="aa.jpg", mtime_unix=5, img_w=3, img_h=4), dict(file_id=3, path="x copy.jpg", mtime_unix=9, exif_unix=2, exif_src="DateTime"),
        dict(file_id=4, path="y.jpg", exif_unix=1, exif_src="DateTimeOriginal"), dict(file_id=9, content_hash=b"\x02" * 32), dict(file_id=9, content_hash=b"\x02" * 32),
        dict(file_id=20, content_hash=b"\x03" * 32, path=None), dict(file_id=21, content_hash=b"\x03" * 32, path=None), dict(file_id=30, content_hash=None),
    ]
    f = make_files(rows).withColumn("policy", F.lit(1)).withColumn("indexed_unix", F.lit(99))
    got = {(r.content_hash[:2], r.field): r.file_id for r in survivors.survivors(f, make_archives([(1, None)])).collect()}
    assert got == {("01", "record"): 1, ("01", "mtime_unix"): 1, ("01", "img_dims"): 2, ("01", "exif_unix"): 4, ("03", "record"): 20}
    assert survivors.survivors(f.limit(0), make_archives([(1, None)])).count() == 0


def test_paths_restored(make_files):
    clean = ["Prüfung bestätigt", "canción de cuna", "письмо сестре", "новый год на даче", "会议记录", "Straße am Fluß"]
    rows = [dict(file_id=k * 40 + i, path=f"d/{w} {i}.txt") for k, w in enumerate(clean) for i in range(40)]
    bad = {
        5001: ("Prüfung bestätigt".encode().decode("cp1252"), None, "Prüfung bestätigt"), 5002: ("canción de cuna".encode("cp1252").decode("cp437"), None, "canción de cuna"),
        5003: ("новый год на даче".encode("koi8-r").decode("cp1251"), None, "новый год на даче"), 5004: ("会议记录".encode("gbk").decode("latin-1"), None, "会议记录"),
        5005: ("Pr�fung", None, ""), 5006: ("канцi�", "Prüfung bestätigt".encode("cp850"), "Prüfung bestätigt"),
    }
    rows += [dict(file_id=i, path=f"d/{p}.txt" if r is None else f"d/{p}.txt", path_raw=None if r is None else b"d/" + r + b".txt") for i, (p, r, _) in bad.items()]
    rows += rows[:3] + [dict(file_id=6001, path=None), dict(file_id=6002, path=""), dict(file_id=6003, path="±5°C.txt"), dict(file_id=6004, path="d/дач�.txt", path_raw="d/дач".encode() + b"\xd0.txt")]
    rows += [dict(file_id=6005, path="x" * 100_000 + "é")]
    got = {r.file_id: r.path_fixed for r in encodings.restore_paths(make_files(rows)).collect()}
    assert got == {i: f"d/{want}.txt" if want else "" for i, (_, _, want) in bad.items()}
    assert encodings.restore_paths(make_files(rows).limit(0)).count() == 0


def test_skyline_layers_and_policies(make_files, make_archives):
    """Against brute force: layers by peeling, the policy's first among the undominated, fields from the layers."""
    r = random.Random(8)
    rows = []
    for g in range(40):
        for i in range(r.randint(2, 9)):
            exif = r.choice([None, r.randint(1, 9)])
            rows.append(dict(
                archive_id=r.randint(1, 3), file_id=g * 20 + i, path="p" * r.randint(1, 9) + ".jpg", mtime_unix=r.choice([None, r.randint(1, 9)]), exif_unix=exif,
                exif_src=r.choice([None, *survivors.TRUST]) if exif else None, img_w=r.choice([None, 5]), content_hash=bytes([g]) * 32,
            ))
    indexed = {1: None, 2: 4, 3: 7}
    trust = lambda x: (survivors.TRUST.index(x["exif_src"]) if x["exif_src"] else 3) if x["exif_unix"] else 4
    full = lambda x: (x["exif_unix"] is not None) + (x["mtime_unix"] is not None) + (x["img_w"] is not None)

    def order(x):
        ts = next((v for v in (x["exif_unix"], x["mtime_unix"], indexed[x["archive_id"]]) if v is not None), None)
        return (-(ts if ts is not None else -(1 << 62)), len(x["path"]), x["archive_id"], x["file_id"])

    def peel(group):
        """Layers over the first record of each cell."""
        cells = {}
        for x in sorted(group, key=order):
            cells.setdefault((x["exif_unix"] is None, x["mtime_unix"] is None, x["img_w"] is None, trust(x)), x)
        left, out = list(cells.values()), []
        beats = lambda s, x: s is not x and full(s) >= full(x) and trust(s) <= trust(x) and order(s) < order(x)
        while left:
            top = [x for x in left if not any(beats(s, x) for s in left)]
            out.append(top)
            left = [x for x in left if x not in top]
        return out

    criteria = {"order": order, "completeness": lambda x: -full(x), "trust": trust, "path_length": lambda x: len(x["path"])}
    changed = 0
    for policy, all_layers in ((("order",), False), (("path_length",), False), (("completeness", "order"), True), (("trust", "path_length"), True)):
        want = {}
        key = lambda x, policy=policy: (*[criteria[c](x) for c in policy], order(x))
        for g in range(40):
            group = [x for x in rows if x["content_hash"][0] == g]
            layers = peel(group)
            pick = min(layers[0], key=key)
            changed += key(pick) != min(map(key, group))
            want[f"{g:02x}", "record"] = pick["archive_id"], pick["file_id"]
            for field, column in (("mtime_unix", "mtime_unix"), ("img_dims", "img_w"), ("exif_unix", "exif_unix")):
                if offer := [x for x in group if x[column] is not None]:
                    of = next([x for x in layer if x[column] is not None] for layer in layers if any(x[column] is not None for x in layer)) if all_layers else peel(offer)[0]
                    best = min(of, key=key)
                    want[f"{g:02x}", field] = best["archive_id"], best["file_id"]
        got = survivors.survivors(make_files([dict(kind="image", **x) for x in rows]), make_archives(list(indexed.items())), policy, {}, all_layers)
        assert {(x.content_hash[:2], x.field): (x.archive_id, x.file_id) for x in got.collect()} == want
    assert changed  # the skyline does change who survives


def test_history_stores_first_seen_keys_and_grows(spark):
    """A key is stored once, buckets double with the store, and a small batch reads no more of a store four times as large."""
    work = Scratch(spark, "grow")
    store = history.History(spark, work.path("h"), bucket_rows=400)
    make = lambda seq, lo, hi: spark.range(lo, hi).selectExpr(f"{seq}L as seq", "cast(sha2(cast(id as string), 256) as binary) as content_hash", "xxhash64(id) as phash")
    read = []
    for seq in range(1, 5):
        found = store.accept(make(seq, 0, 150 * seq))
        assert {x.match_kind: x["count"] for x in found.groupBy("match_kind").count().collect()} == ({"exact": 150 * (seq - 1)} if seq > 1 else {}) | {None: 150}
        probe = work.save(make(9, 0, 3).select("content_hash").withColumn("bucket", store._bucket("content_hash")), "few")
        files = store._read("exact").where(F.col("bucket").isin([r.bucket for r in probe.collect()]))
        read.append(files.count())
        assert store._matching("exact", probe, ["content_hash"]).count() == 3
    assert store._read("exact").count() == 600 and store._read("near").count() == 6000
    assert history.History(spark, store.at).state == store.state and store.buckets >= 8
    assert read[-1] <= 3 * max(1, 2 * 600 // store.buckets) + 60
    # one fingerprint that comes with every batch is stored once
    again = history.History(spark, work.path("same"), buckets=2)
    for seq in range(6):
        again.append(make(seq, 0, 1).withColumn("content_hash", F.lit(bytes([seq]) * 32)))
    assert again._read("near").count() == 10 and again._read("exact").count() == 6
