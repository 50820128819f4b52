import math
import random
import re

import pytest

from siftstone.operators import search as S
from siftstone.operators.words import top_words, word_freq


@pytest.fixture(scope="module")
def index(spark):
    r = random.Random(5)
    words = "alpha beta gamma delta Café naïve data base".split()
    rows = [(1, i, f"dir/{r.choice(words)}.txt", " ".join(r.choice(words) for _ in range(r.randint(0, 14)))) for i in range(80)]
    rows += [(2, 1, None, None), (2, 2, "", ""), (2, 3, "x", "alpha alpha beta alpha")]
    return rows, S.postings(spark.createDataFrame(rows, "a long, f long, path string, content string"), ["a", "f"])


def hit(row, p, col):
    t = S.tokens_py(row[2 if col == "path" else 3] or "")
    n = len(p.terms)
    return [i for i in range(len(t) - n + 1) if (not p.initial or i == 0) and all(t[i + k] == w or (p.prefix and k == n - 1 and t[i + k].startswith(w)) for k, w in enumerate(p.terms))]


def evaluate(row, node):
    if isinstance(node, S.Phrase):
        return bool(node.terms) and any(hit(row, node, c) for c in node.columns)
    if isinstance(node, S.Near):
        for c in S.COLUMNS:
            places = [hit(row, p, c) if c in p.columns else [] for p in node.phrases]
            if len(places) == 2 and any(max(b - a - len(node.phrases[0].terms), a - b - len(node.phrases[1].terms)) <= node.distance for a in places[0] for b in places[1]):
                return True
        return False
    got = [evaluate(row, x) for x in node.parts]
    return all(got) if node.kind == "AND" else any(got) if node.kind == "OR" else got[0] and not got[1]


QUERIES = [
    "alpha", "ALPHA beta", '"alpha beta"', "alp*", "alpha OR gamma", "alpha NOT beta", "(alpha OR gamma) AND delta", "path : alpha", "content:^alpha", "NEAR(alpha gamma, 1)",
    "cafe", "naive NOT (alpha beta)", '"data base"', "data_base", "alpha + beta", "{path content} : beta", "- path : beta", '"gamma al"*', "unknown",
]


@pytest.mark.parametrize("q", QUERIES)
def test_matches_against_brute_force(index, q):
    rows, df = index
    tree, _ = S.parse(q)
    want = {(r[0], r[1]) for r in rows if evaluate(r, tree)}
    found = S.search(df, q, ["a", "f"]).collect()
    assert {(x.a, x.f) for x in found} == want and len(found) == len(want)


def test_rank_and_counts(index):
    rows, df = index
    q = "alpha OR beta"
    marked = S.phrases_of(S.parse(q)[0])
    lens = {(r[0], r[1]): len(S.tokens_py(r[2] or "")) + len(S.tokens_py(r[3] or "")) for r in rows}
    dfs = [sum(any(hit(r, p, c) for c in S.COLUMNS) for r in rows) for p in marked]
    for x in S.search(df, q, ["a", "f"]).collect():
        r = next(r for r in rows if (r[0], r[1]) == (x.a, x.f))
        fs = [sum(len(hit(r, p, c)) for c in S.COLUMNS) for p in marked]
        pairs = [(f, d) for f, d in zip(fs, dfs) if f]
        want = S.bm25_py([f for f, _ in pairs], [d for _, d in pairs], len(rows), lens[(x.a, x.f)], sum(lens.values()) / len(rows))
        assert math.isclose(x.rank, want, rel_tol=1e-9)
        assert x.matches == sum(len(hit(r, p, "content")) for p in marked)


def test_overlapping_spans_count_once(index):
    got = {(x.a, x.f): x.matches for x in S.search(index[1], '"alpha alpha" OR "alpha beta"', ["a", "f"]).collect()}
    assert got[(2, 3)] == 1


@pytest.mark.parametrize("bad", ['"open', "AND", "a AND", "(a", "a)", "NEAR(", "nocol : x", "a:b:c)", "^", "*"])
def test_bad_queries_are_phrases(bad):
    tree, literal = S.parse(bad)
    assert literal and isinstance(tree, S.Phrase)


def test_empty_query_and_index(spark, index):
    assert S.search(index[1], "...", ["a", "f"]).count() == 0
    assert S.search(index[1].limit(0), "alpha", ["a", "f"]).count() == 0


def test_snippets():
    text = " ".join(f"w{i}" for i in range(40)) + " magic term end"
    marked = S.phrases_of(S.parse('"magic term"')[0])
    got = S.snippet_py(text, marked)
    assert "[magic term]" in got and got.startswith(" … ") and len(re.findall(r"\w+", got)) == 12
    assert S.snippet_py("short magic term", marked) == "short [magic term]" and S.snippet_py("", marked) == ""


def test_words(spark):
    df = spark.createDataFrame([("apple apple banana",), ("apple cherry",), (None,), ("",), ("ab " + "x" * 33,), ("Ärger ÄRGER",)], "text string")
    got = {r.word: (r.total_count, r.doc_count) for r in word_freq(df).collect()}
    assert got == {"apple": (3, 2), "banana": (1, 1), "cherry": (1, 1), "ärger": (2, 1)}
    top = top_words(word_freq(df), 2).orderBy("rank").collect()
    assert [(r.word, r["rank"]) for r in top] == [("apple", 1), ("ärger", 2)] and top[0].bar == "█" * 20 and top[0].pct == 60.0
    assert top_words(word_freq(df.limit(0)), 2).count() == 0


def test_inverted_index_finds_the_same(spark, index, tmp_path):
    rows, df = index
    at = str(tmp_path / "index")
    S.Inverted.of(df, ["a", "f"]).write(at, ["a", "f"])
    inverted = S.Inverted.read(spark, at)
    for q in ("alpha NOT beta", '"alpha beta" OR "gamma al"*', "content:^alpha", "NEAR(alpha gamma, 1)", "path : alp*", "unknown"):
        of = lambda i, q=q: sorted((x.a, x.f, round(x.rank, 9), x.matches) for x in S.search(i, q, ["a", "f"]).collect())
        assert of(inverted) == of(df), q
    plan = inverted.terms.where("term = 'beta'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,beta)" in plan.replace(" ", "")
