"""Full-text search: query language, matching by postings, ranking, match counts, snippets, federation.

The query language follows the public full-text syntax of the embedded SQL engine's FTS5 module: words, "phrases",
prefix*, AND, OR, NOT, implicit AND, parentheses, column : ..., NEAR(a b, n), ^first. A query that does not parse is
searched as one phrase.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftstone.session import Scratch

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6  # fixed values of the ranking function
COLUMNS = ("path", "content")
SNIPPET_TOKENS = 12


def _diacritics() -> tuple[str, str]:
    """Letters whose canonical decomposition is another letter with marks, and those letters."""
    a, b = [], []
    for c in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        d = unicodedata.normalize("NFD", chr(c))
        if len(d) > 1 and unicodedata.category(chr(c))[0] == "L" and all(unicodedata.category(x) == "Mn" for x in d[1:]):
            low = chr(c).lower()
            if len(low) == 1:
                a.append(low)
                b.append(d[0].lower())
    pairs = dict(zip(a, b))
    return "".join(pairs), "".join(pairs.values())


FROM, TO = _diacritics()
_FOLD = str.maketrans(FROM, TO)


def fold(text: str) -> str:
    return re.sub(r"[̀-ͯ]", "", text.lower()).translate(_FOLD)


def tokens_py(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", fold(text))


def tokens(text: Column) -> Column:
    """Case and diacritics folded, split at all but letters and numbers."""
    folded = F.translate(F.regexp_replace(F.lower(text), r"[̀-ͯ]+", ""), FROM, TO)
    return F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda t: t != "")


# -- the query


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]
    prefix: bool = False
    initial: bool = False
    columns: tuple[str, ...] = COLUMNS


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int = 10


@dataclass(frozen=True)
class Op:
    kind: str  # AND, OR, NOT
    parts: tuple = field(default_factory=tuple)


class QuerySyntaxError(ValueError):
    pass


_LEX = re.compile(r'\s+|"((?:[^"]|"")*)"|(AND|OR|NOT|NEAR)(?![\w\x80-\U0010ffff])|([\w\x80-\U0010ffff]+)|([()*:^+,{}-])', re.A)


class _Parser:
    def __init__(self, query: str):
        self.toks: list[tuple[str, str]] = []
        at = 0
        while at < len(query):
            m = _LEX.match(query, at)
            if not m:
                raise QuerySyntaxError(f"unexpected {query[at]!r}")
            at = m.end()
            if m.group(1) is not None:
                self.toks.append(("str", m.group(1).replace('""', '"')))
            elif m.group(2):
                self.toks.append(("op", m.group(2)))
            elif m.group(3):
                self.toks.append(("word", m.group(3)))
            elif m.group(4):
                self.toks.append((m.group(4), m.group(4)))
        self.i = 0

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.toks[self.i + k] if self.i + k < len(self.toks) else ("end", "")

    def take(self, kind: str | None = None) -> str:
        t = self.peek()
        if kind and t[0] != kind:
            raise QuerySyntaxError(f"expected {kind}, found {t[1] or 'the end'}")
        self.i += 1
        return t[1]

    def parse(self):
        out = self.or_(COLUMNS)
        if self.peek()[0] != "end":
            raise QuerySyntaxError(f"unexpected {self.peek()[1]}")
        return out

    def or_(self, cols):
        parts = [self.and_(cols)]
        while self.peek() == ("op", "OR"):
            self.take()
            parts.append(self.and_(cols))
        return parts[0] if len(parts) == 1 else Op("OR", tuple(parts))

    def and_(self, cols):
        parts = [self.not_(cols)]
        while self.peek() == ("op", "AND"):
            self.take()
            parts.append(self.not_(cols))
        return parts[0] if len(parts) == 1 else Op("AND", tuple(parts))

    def not_(self, cols):
        left = self.implicit(cols)
        while self.peek() == ("op", "NOT"):
            self.take()
            left = Op("NOT", (left, self.implicit(cols)))
        return left

    def implicit(self, cols):
        parts = [self.primary(cols)]
        while self.peek()[0] in ("str", "word", "(", "^", "{", "-") or self.peek() == ("op", "NEAR"):
            parts.append(self.primary(cols))
        return parts[0] if len(parts) == 1 else Op("AND", tuple(parts))

    def primary(self, cols):
        kind, text = self.peek()
        negate = False
        if kind == "-" and self.peek(1)[0] in ("word", "str", "{"):
            self.take()
            negate, (kind, text) = True, self.peek()
        chosen = None
        if kind == "{":
            self.take()
            names = []
            while self.peek()[0] in ("word", "str"):
                names.append(self.take().lower())
            self.take("}")
            self.take(":")
            chosen = tuple(names)
        elif kind in ("word", "str") and self.peek(1)[0] == ":":
            self.take()
            self.take()
            chosen = (text.lower(),)
        if chosen is not None:
            if bad := [n for n in chosen if n not in COLUMNS]:
                raise QuerySyntaxError(f"no such column: {bad[0]}")
            cols = tuple(c for c in COLUMNS if (c in chosen) != negate and c in cols)
            return self.primary(cols)
        if negate:
            raise QuerySyntaxError("unexpected -")
        if kind == "(":
            self.take()
            inner = self.or_(cols)
            self.take(")")
            return inner
        if (kind, text) == ("op", "NEAR"):
            self.take()
            self.take("(")
            phrases, dist = [], 10
            while self.peek()[0] in ("word", "str", "^"):
                phrases.append(self.phrase(cols))
            if self.peek()[0] == ",":
                self.take()
                n = self.take("word")
                if not n.isdigit():
                    raise QuerySyntaxError(f"expected a number, found {n}")
                dist = int(n)
            self.take(")")
            if not phrases:
                raise QuerySyntaxError("NEAR of nothing")
            return Near(tuple(phrases), dist)
        return self.phrase(cols)

    def phrase(self, cols):
        initial = self.peek()[0] == "^"
        if initial:
            self.take()
        if self.peek()[0] not in ("word", "str"):
            raise QuerySyntaxError(f"unexpected {self.peek()[1] or 'end'}")
        terms = tokens_py(self.take())
        while self.peek()[0] == "+":
            self.take()
            if self.peek()[0] not in ("word", "str"):
                raise QuerySyntaxError("expected a phrase after +")
            terms += tokens_py(self.take())
        prefix = self.peek()[0] == "*"
        if prefix:
            self.take()
        return Phrase(tuple(terms), prefix, initial, cols)


def parse(query: str) -> tuple[object, bool]:
    """(query tree, whether the text had to be read as one literal phrase)."""
    try:
        return _Parser(query).parse(), False
    except QuerySyntaxError:
        return Phrase(tuple(tokens_py(query))), True


def phrases_of(node) -> list[Phrase]:
    """Phrases that matches are marked and ranked by: all but those behind NOT."""
    if isinstance(node, Phrase):
        return [node]
    if isinstance(node, Near):
        return list(node.phrases)
    parts = node.parts[:1] if node.kind == "NOT" else node.parts
    return [p for x in parts for p in phrases_of(x)]


def _all_phrases(node) -> list[Phrase]:
    if isinstance(node, Phrase):
        return [node]
    if isinstance(node, Near):
        return list(node.phrases)
    return [p for x in node.parts for p in _all_phrases(x)]


# -- postings


def postings(docs: DataFrame, keys: list[str], path: str = "path", content: str | None = "content") -> DataFrame:
    """``(keys..., doc_len, path_tokens, content_tokens)``: the token arrays of each row; null columns have none."""
    p = F.coalesce(tokens(F.col(path)), F.array().cast("array<string>"))
    c = F.coalesce(tokens(F.col(content)), F.array().cast("array<string>")) if content else F.array().cast("array<string>")
    return docs.select(*keys, p.alias("path_tokens"), c.alias("content_tokens")).withColumn("doc_len", F.size("path_tokens") + F.size("content_tokens"))


@dataclass
class Inverted:
    """An inverted index: ``terms(term, keys..., col, at)`` with the places of a term in a column of a row, ``lengths(keys..., doc_len)``.

    Written with ``write``, terms lie in order, so that the files' statistics leave out all but those of a query's terms.
    """

    terms: DataFrame
    lengths: DataFrame

    @staticmethod
    def of(index: DataFrame, keys: list[str]) -> Inverted:
        """From the token arrays of ``postings``."""
        parts = [index.select(*keys, F.lit(c).alias("col"), F.posexplode(f"{c}_tokens").alias("_at", "term")) for c in COLUMNS]
        places = parts[0].union(parts[1]).groupBy("term", *keys, "col").agg(F.sort_array(F.collect_list("_at")).alias("at"))  # bounded by the text of one row
        return Inverted(places.select("term", *keys, "col", "at"), index.select(*keys, "doc_len"))

    def write(self, at: str, keys: list[str]) -> None:
        """Range partitioned by term and key: a term of very many rows fills several files."""
        self.terms.repartitionByRange("term", *keys).sortWithinPartitions("term", *keys).write.parquet(f"{at}/terms")
        self.lengths.write.parquet(f"{at}/lengths")

    @staticmethod
    def read(spark: SparkSession, at: str) -> Inverted:
        return Inverted(spark.read.parquet(f"{at}/terms"), spark.read.parquet(f"{at}/lengths"))

    def select(self, *cols: str) -> DataFrame:
        return self.lengths.select(*cols)

    def candidates(self, phrases: list[Phrase], keys: list[str]) -> DataFrame:
        """``(keys..., _places)``: of every row that has any term of the phrases, the places by column and slot.

        Only the postings of these terms are read (equality and prefix tests are pushed into the scan) and shuffled.
        """
        slots = _slots(phrases)
        tests = [F.startswith("term", F.lit(t)) if prefix else F.col("term") == t for t, prefix in slots]
        hit = self.terms.where(reduce(Column.__or__, tests))
        places = [F.flatten(F.collect_list(F.when(test & (F.col("col") == c), F.col("at")))).alias(f"_{c}_{i}") for c in COLUMNS for i, test in enumerate(tests)]
        return Scratch(hit.sparkSession, "search").save(hit.groupBy(*keys).agg(*places), "candidates")


def _slots(phrases: list[Phrase]) -> list[tuple[str, bool]]:
    """The different (term, whether as a prefix) of the phrases."""
    return list(dict.fromkeys((t, p.prefix and k == len(p.terms) - 1) for p in phrases for k, t in enumerate(p.terms)))


def _places(cands: DataFrame, keys: list[str], phrase: Phrase, no: int, slots: list[tuple[str, bool]]) -> DataFrame:
    """``_instances`` from the candidates of an inverted index: starts common to the shifted places of all terms."""
    out = None
    for col in phrase.columns:
        starts = [
            F.transform(F.col(f"_{col}_{slots.index((t, phrase.prefix and k == len(phrase.terms) - 1))}"), _less(k)) for k, t in enumerate(phrase.terms)
        ]
        at = F.array_distinct(reduce(F.array_intersect, starts))
        part = cands.select(*keys, F.lit(no).alias("_no"), F.lit(col).alias("_col"), F.explode(at).alias("_at"), F.lit(len(phrase.terms)).alias("_len"))
        if phrase.initial:
            part = part.where("_at = 0")
        out = part if out is None else out.union(part)
    return out


def _less(k: int) -> Callable[[Column], Column]:
    return lambda x: x - k


def _all_instances(index: DataFrame | Inverted, keys: list[str], wanted: list[Phrase]) -> dict[Phrase, DataFrame]:
    if isinstance(index, Inverted):
        cands, slots = index.candidates(wanted, keys), _slots(wanted)
        return {p: _places(cands, keys, p, n, slots) for n, p in enumerate(wanted)}
    return {p: _instances(index, keys, p, n) for n, p in enumerate(wanted)}


def _instances(cands: DataFrame, keys: list[str], phrase: Phrase, no: int) -> DataFrame:
    """``(keys..., _no, _col, _at, _len)``: every place at which the phrase occurs, by an array scan of its first token."""
    out = None
    for col in phrase.columns:
        arr = F.col(f"{col}_tokens")
        first, rest = phrase.terms[0], phrase.terms[1:]
        last = len(phrase.terms) - 1

        def hit(t: Column, k: int) -> Column:
            return F.startswith(t, F.lit(phrase.terms[k])) if phrase.prefix and k == last else t == phrase.terms[k]

        exists = F.exists(arr, lambda t: hit(t, 0)) if phrase.prefix and not rest else F.array_contains(arr, first)
        part = cands.where(exists).select(*keys, arr.alias("_arr"), F.posexplode(arr).alias("_at", "_t")).where(hit(F.col("_t"), 0))
        for k in range(1, len(phrase.terms)):
            part = part.where(F.coalesce(hit(F.get("_arr", F.col("_at") + k), k), F.lit(False)))
        if phrase.initial:
            part = part.where("_at = 0")
        part = part.select(*keys, F.lit(no).alias("_no"), F.lit(col).alias("_col"), "_at", F.lit(len(phrase.terms)).alias("_len"))
        out = part if out is None else out.union(part)
    return out


def _matching(node, inst: dict[Phrase, DataFrame], keys: list[str], every: DataFrame) -> DataFrame:
    """Keys of the rows that match a query tree."""
    if isinstance(node, Phrase):
        return inst[node].select(*keys).distinct() if node.terms else every.limit(0)
    if isinstance(node, Near):
        # windows: all phrases of one column with at most distance tokens between neighbours' ends and starts
        base = inst[node.phrases[0]].select(*keys, "_col", F.col("_at").alias("_lo"), (F.col("_at") + F.col("_len")).alias("_hi"))
        for p in node.phrases[1:]:
            other = inst[p].select(*keys, "_col", F.col("_at").alias("_a"), (F.col("_at") + F.col("_len")).alias("_e"))
            joined = base.join(other, [*keys, "_col"]).withColumn("_gap", F.greatest(F.col("_a") - F.col("_hi"), F.col("_lo") - F.col("_e")))
            base = joined.where(F.col("_gap") <= node.distance).select(*keys, "_col", F.least("_lo", "_a").alias("_lo"), F.greatest("_hi", "_e").alias("_hi"))
        return base.select(*keys).distinct()
    sides = [_matching(x, inst, keys, every) for x in node.parts]
    if node.kind == "AND":
        return reduce(lambda a, b: a.join(b, keys, "left_semi"), sides)
    if node.kind == "OR":
        return reduce(DataFrame.union, sides).distinct()
    return sides[0].join(sides[1], keys, "left_anti")


def search(index: DataFrame | Inverted, query: str, keys: list[str]) -> DataFrame:
    """``(keys..., rank, matches)`` of every row that matches: BM25 rank (lower is better) and marked spans in content.

    ``index`` comes from ``postings``, or is an ``Inverted``. Path matches count no spans; overlapping spans count as one. Ranks are computed
    over the whole index. A query without any token matches nothing.
    """
    tree, _ = parse(query)
    return match(index, tree, keys)


def _check_keys(keys: list[str], *made: str) -> None:
    if bad := [k for k in keys if k.startswith("_") or k.lower() in ("path_tokens", "content_tokens", "doc_len", *made)]:
        raise ValueError(f"key column {bad[0]!r} has a name that the search uses")


def match(index: DataFrame | Inverted, tree, keys: list[str]) -> DataFrame:
    _check_keys(keys, "rank", "matches")
    every = index.select(*keys)
    wanted = [p for p in dict.fromkeys(_all_phrases(tree)) if p.terms]
    if not wanted:
        return every.limit(0).select(*keys, F.lit(0.0).alias("rank"), F.lit(0).cast("long").alias("matches"))
    inst = _all_instances(index, keys, wanted)
    hits = _matching(tree, inst, keys, every)
    marked = [p for p in dict.fromkeys(phrases_of(tree)) if p.terms]
    size = index.select("doc_len").agg(F.count(F.lit(1)).cast("double").alias("_rows"), F.avg("doc_len").alias("_avg"))  # one row
    freq = reduce(DataFrame.union, [inst[p] for p in marked]).groupBy(*keys, "_no").agg(F.count(F.lit(1)).alias("_f"))
    df = freq.groupBy("_no").agg(F.count(F.lit(1)).alias("_df"))  # a row per phrase of the query
    lens = index.select(*keys, "doc_len")
    scored = freq.join(F.broadcast(df), "_no").join(lens, keys).join(F.broadcast(size))
    idf = F.greatest(F.lit(LEAST_IDF), F.ln((F.col("_rows") - F.col("_df") + 0.5) / (F.col("_df") + 0.5)))
    part = idf * F.col("_f") * (K1 + 1) / (F.col("_f") + K1 * (1 - B + B * F.col("doc_len") / F.col("_avg")))
    ranks = scored.groupBy(*keys).agg((-F.sum(part)).alias("rank"))
    # spans of one row lie in one row's text; overlapping ones are merged by running maxima
    content = reduce(DataFrame.union, [inst[p] for p in marked]).where("_col = 'content'")
    w = W.partitionBy(*keys).orderBy("_at", F.desc("_len")).rowsBetween(W.unboundedPreceding, -1)
    spans = content.withColumn("_end", F.max(F.col("_at") + F.col("_len")).over(w))
    spans = spans.groupBy(*keys).agg(F.count_if(F.col("_end").isNull() | (F.col("_at") >= F.col("_end"))).alias("matches"))
    return hits.join(ranks, keys, "left").join(spans, keys, "left").select(*keys, "rank", F.coalesce("matches", F.lit(0)).alias("matches"))


def top_hits(found: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame, Column]:
    """The best hits and whether there were more: one more is asked for than is shown."""
    return found.orderBy("rank", *keys).limit(limit + 1), F.count(F.lit(1)) > limit


def federated(found: DataFrame, keys: list[str], limit: int, archive: str = "archive_id") -> DataFrame:
    """The best ``limit`` hits of each archive, numbered, never ranked across archives."""
    w = W.partitionBy(archive).orderBy("rank", *keys)
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def federated_ranks(index: DataFrame | Inverted, query: str, keys: list[str], limit: int | None, archive: str = "archive_id") -> DataFrame:
    """Search every archive by itself: frequencies and lengths are those of the archive. Without a limit all hits come, and no places."""
    _check_keys(keys, "rank", "place")
    tree, _ = parse(query)
    marked = [p for p in dict.fromkeys(phrases_of(tree)) if p.terms]
    if not marked:
        return index.select(*keys).limit(0).select(*keys, F.lit(0.0).alias("rank"), F.lit(0).alias("place"))
    inst = _all_instances(index, keys, list(dict.fromkeys(x for x in _all_phrases(tree) if x.terms)))
    hits = _matching(tree, inst, keys, index.select(*keys))
    size = index.select(*keys, "doc_len").groupBy(archive).agg(F.count(F.lit(1)).cast("double").alias("_rows"), F.avg("doc_len").alias("_avg"))
    freq = reduce(DataFrame.union, [inst[p] for p in marked]).groupBy(*keys, "_no").agg(F.count(F.lit(1)).alias("_f"))
    df = freq.groupBy(archive, "_no").agg(F.count(F.lit(1)).alias("_df"))
    scored = freq.join(df, [archive, "_no"]).join(size, archive).join(index.select(*keys, "doc_len"), keys)
    idf = F.greatest(F.lit(LEAST_IDF), F.ln((F.col("_rows") - F.col("_df") + 0.5) / (F.col("_df") + 0.5)))
    part = idf * F.col("_f") * (K1 + 1) / (F.col("_f") + K1 * (1 - B + B * F.col("doc_len") / F.col("_avg")))
    ranks = scored.groupBy(*keys).agg((-F.sum(part)).alias("rank"))
    found = hits.join(ranks, keys)
    return found if limit is None else federated(found, keys, limit, archive)


# -- snippets


def _spans_py(text: str, marked: list[Phrase]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(character spans of all tokens, merged (first, end) token spans of the phrases)."""
    spans = [m.span() for m in re.finditer(r"[^\W_][^\W_̀-ͯ]*[̀-ͯ]*(?:[^\W_]|[̀-ͯ])*", text)]
    toks = [fold(text[a:b]) for a, b in spans]
    found = []
    for p in marked:
        if "content" not in p.columns or not p.terms:
            continue
        n = len(p.terms)
        for i in range(len(toks) - n + 1):
            if p.initial and i:
                break
            if all(toks[i + k] == t or (p.prefix and k == n - 1 and toks[i + k].startswith(t)) for k, t in enumerate(p.terms)):
                found.append((i, i + n))
    found.sort()
    merged: list[tuple[int, int]] = []
    for a, b in found:
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return spans, merged


def snippet_py(text: str, marked: list[Phrase], width: int = SNIPPET_TOKENS) -> str:
    """The window of ``width`` tokens with most marked tokens, matches in brackets, ellipses where text is left out."""
    spans, hits = _spans_py(text, marked)
    if not hits:
        end = spans[width - 1][1] if len(spans) > width else len(text)
        return text[:end] + (" … " if len(spans) > width else "")
    best = max(hits, key=lambda h: (sum(min(b, h[0] + width) - a for a, b in hits if h[0] <= a < h[0] + width), -h[0]))
    first = max(0, min(best[0], len(spans) - width))
    last = min(len(spans), first + width)
    out, at = [], 0 if first == 0 else spans[first][0]
    for a, b in hits:
        if a >= first and b <= last:
            out += [text[at : spans[a][0]], "[", text[spans[a][0] : spans[b - 1][1]], "]"]
            at = spans[b - 1][1]
    out.append(text[at : len(text) if last == len(spans) else spans[last - 1][1]])
    return (" … " if first else "") + "".join(out) + (" … " if last < len(spans) else "")


def snippets(hits: DataFrame, query: str, content: str = "content") -> DataFrame:
    """hits with a snippet of the content column; meant for the few rows of a result page, behind the limit."""
    marked = phrases_of(parse(query)[0])

    @F.pandas_udf("string")
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: None if t is None else snippet_py(t, marked))

    return hits.withColumn("snippet", cut(F.col(content)))


def bm25_py(freqs: list[int], dfs: list[int], rows: int, length: int, average: float) -> float:
    """The rank of one row, for tests."""
    out = 0.0
    for f, df in zip(freqs, dfs):
        idf = max(LEAST_IDF, math.log((rows - df + 0.5) / (df + 0.5)))
        out += idf * f * (K1 + 1) / (f + K1 * (1 - B + B * length / average))
    return -out
