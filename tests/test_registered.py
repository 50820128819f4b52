"""Registered queries on small tables of their own."""

import os
import re
from collections import Counter

import pytest

from siftstone.plans.queries import QUERIES
from siftstone.session import Scratch


def test_reports_render_every_group(spark, make_files, make_archives, tmp_path):
    n = 60
    rows = [dict(archive_id=a, file_id=i, path=f"{a}/{i}.txt", kind="text", content_hash=bytes([i]) * 32) for i in range(1, n + 1) for a in (1, 2)]
    make_files(rows).write.parquet(f"{tmp_path}/files.parquet")
    make_archives([(1, 5), (2, 6)]).write.parquet(f"{tmp_path}/archives.parquet")
    assert QUERIES["report_members_json"](spark, str(tmp_path)).count() == 2 * n
    assert {r.group_id for r in QUERIES["report_lines"](spark, str(tmp_path)).collect()} == set(range(1, n + 1))


def test_ranking_of_words_in_all_scripts(spark, tmp_path):
    texts = ["été été forêt est naïve", "архив архив Архив копия est", "αρχείο αρχείο forêt, été; est_est", "ab 2024 résumé-résumé " + "x" * 33, "أرشيف أرشيف est"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    count, docs = Counter(), Counter()
    for t in texts:
        words = [w.lower() for w in "".join(c if c.isalnum() else " " for c in t).split() if 3 <= len(w) <= 32]
        count.update(words)
        docs.update(set(words))
    want = [(i, w, count[w], docs[w]) for i, w in enumerate(sorted(count, key=lambda w: (-count[w], w))[:20], 1)]
    got = [(r.rank, r.word, r.total_count, r.doc_count) for r in QUERIES["top_words_all_20"](spark, str(tmp_path)).orderBy("rank").collect()]
    assert got == want and {"été", "архив", "αρχείο", "أرشيف"} <= {w for _, w, _, _ in got}


@pytest.mark.parametrize("name", ["near_keep_actionable", "report_lines", "report_members_json"])
def test_near_duplicates_broadcast_no_exploded_fingerprints(spark, make_files, make_archives, tmp_path, monkeypatch, name):
    """The driver would hold ten rows a fingerprint, which no estimate tells."""
    prints = [0xE94AE84A1FB2B932 ^ (0x9E3779B97F4A7C15 * i) % (1 << 63) for i in range(40)]
    rows = [dict(archive_id=a, file_id=i, path=f"{a}/{i}.jpg", phash=(h ^ a >> 1) - (1 << 64), content_hash=bytes([a, i]) * 16) for i, h in enumerate(prints) for a in (1, 2)]
    make_files(rows).write.parquet(f"{tmp_path}/files.parquet")
    make_archives([(1, 5), (2, 6)]).write.parquet(f"{tmp_path}/archives.parquet")
    plans, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, at: (plans.append(df._jdf.queryExecution().executedPlan().toString()), save(self, df, at))[1])
    out = QUERIES[name](spark, str(tmp_path))
    assert out.count() >= len(prints)
    exploded = [p for p in plans if "Generate explode(array(" in p]
    assert exploded and not [p for p in exploded if "BroadcastHashJoin [m#" in p]


# keys of tables that grow with the input; archives and the states of partitions may be broadcast
GROWING = re.compile(r"BroadcastHashJoin \[((?:gkey|match_kind|root|u|v|phash|_probe)#|archive_id#\d+L, file_id#)")


@pytest.mark.parametrize("name", ["near_keep_actionable", "report_lines", "report_members_json"])
def test_near_duplicates_broadcast_nothing_that_grows(spark, make_files, make_archives, tmp_path, monkeypatch, name):
    """Under any threshold: a packed table that is small by its estimate filled the driver. What was used up is gone."""
    prints = [0xE94AE84A1FB2B932 ^ (0x9E3779B97F4A7C15 * i) % (1 << 63) for i in range(40)]
    rows = [dict(archive_id=a, file_id=i, path=f"{a}/{i}.jpg", phash=(h ^ a >> 1) - (1 << 64), content_hash=bytes([a, i]) * 16) for i, h in enumerate(prints) for a in (1, 2)]
    rows += [dict(archive_id=a, file_id=100 + i, path=f"{a}/{i}.txt", kind="text", content_hash=bytes([i]) * 32) for i in range(20) for a in (1, 2)]
    make_files(rows).write.parquet(f"{tmp_path}/files.parquet")
    make_archives([(1, 5), (2, 6)]).write.parquet(f"{tmp_path}/archives.parquet")
    plans, roots, save = [], set(), Scratch.save
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(Scratch, "save", lambda self, df, at: (plans.append((at, plan(df))), roots.add(self.root), save(self, df, at))[2])
    out = QUERIES[name](spark, str(tmp_path))
    plans.append(("result", plan(out)))
    assert out.count() >= len(prints)
    assert [(at, GROWING.findall(p)) for at, p in plans if GROWING.search(p)] == []
    left = {at.split("-")[1] for r in roots if os.path.isdir(r.removeprefix("file:")) for at in os.listdir(r.removeprefix("file:"))}
    assert left == {"out", "groups", "ranged"}
