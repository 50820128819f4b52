"""Problem 8: sentence units across languages and scripts.

One pass over the texts finds the segments of each document (stretches between blank lines, headings, marked lines), their
script and language, and in them every place at which a unit may end. Most of these are settled by layout and script
alone. A period is not: it is written down with its context, the language, the type that carries it, the word behind it
and that word's shape. The same pass counts tokens, words at undoubted starts and contexts, per language and over all
documents. No list of words comes into it.

From the counts, log-likelihood ratios tell which types are abbreviations, which words are sentence starters, and which
(type, follower) pairs are collocations; the followers of each type are summed up by kind. The contexts are joined with
these tables and decided in Spark, each distinct context once, and the decisions are joined to the places. Nothing that
grows with the vocabulary is collected or broadcast by order.

Languages are told by profiles of frequent words that are learned from a bounded sample of labelled documents; text that
has none of them goes by its label where that fits the script, else by the script.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftstone.session import Scratch, table

SAMPLE = 400  # documents of each label, about, from which its profile of words is learned
PROFILE = 150  # words of a profile
#: Scripts without spaces between words, by the first word of their letters' Unicode names.
DENSE = {"HIRAGANA", "CJK", "THAI", "LAO", "KHMER", "MYANMAR"}

BLANK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
MARKER = re.compile(r"[^\S\n]*(?:[-*•][^\S\n]|\d{1,9}[.)][^\S\n]|\d{4}-\d\d-\d\d[T ]\d\d:\d\d)")
HEADING = re.compile(r"[^\S\n]*#{1,6}[^\S\n]")
DIGITS = re.compile(r"\d+")
CLOSE = "\"”“»’')\\]」』）】"
#: Terminals and quotation marks, in the order in which they are met.
EVENT = re.compile(r"[!?؟।॥。！？][.!?。！？]*|\.+[!?]*(?=[\s\"”»’')\]」』）】]|\Z)|…+|;|[\"“”„«»「」『』（）()]|[฀-๿] +(?=[฀-๿])")
MATES = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "（": "）", "(": ")", '"': '"'}
MARKS = frozenset("\"“”„«»「」『』（）()")
CLOSERS = frozenset("\"”»’')]」』）】")
TERMINALS = frozenset(".!?؟।。！？…")
FULL = frozenset("。！？")
NOT_LATIN = re.compile("[Ͱ-῿⺀-퟿豈-﷿ﹰ-﻿ｦ-ﾝ]")
EDGES = "\"“”„«»‘’'()[]{}<>,;:!?…*_¿¡—–.-"
_QUOTES = "\"“„«‘'([¿¡"
#: What stands behind a period: opening marks, a dash with more of them, a word.
_NEXT = re.compile(r"\s*([\"“„«‘'(\[¿¡]*)(?:([—–]) [\"“„«‘'(\[¿¡]*)?(\S*)")
#: Plain spaces for ASCII white space, 0 for ASCII digits; bytes of other characters stay as they are.
_FLAT = bytes.maketrans(b"\t\n\v\f\r123456789", b" " * 5 + b"0" * 9)
_CLAUSE = re.compile(r"\s*[^。！？\n“”]*[。！？]")

LLR_ABBREVIATION = 0.3  # threshold on the scaled ratio of a type
LLR_SURE = 7.88  # a ratio that is significant at the 0.5 % level
HEAVY_SHARE = 0.01  # contexts with this share of all places are looked up apart

SCAN = pa.schema(
    [("what", pa.string()), ("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("shape", pa.string()), ("n", pa.int64()),
     ("ctx", pa.int64()), ("doc_id", pa.int64()), ("copy", pa.int64()), ("stop", pa.int64()), ("next", pa.int64())]
)
SCAN_DDL = "what string, lang string, a string, b string, shape string, n long, ctx long, doc_id long, copy long, stop long, next long"


class _Scripts(dict):
    """Script of each letter, '' of other characters."""

    def __missing__(self, ch: str) -> str:
        name = unicodedata.name(ch, "").split(" ")[0].split("-")[0] if ch.isalpha() or unicodedata.category(ch)[0] == "M" else ""
        name = {"FULLWIDTH": "LATIN", "HALFWIDTH": "HIRAGANA", "KATAKANA": "HIRAGANA", "COMBINING": "", "MODIFIER": "", "FEMININE": "LATIN", "MASCULINE": "LATIN"}.get(name, name)
        self[ch] = name
        return name


_SCRIPT = _Scripts()


def script_of(text: str) -> str:
    """The script of most letters; a script without spaces wins wherever it occurs, kana before Han."""
    if text.isascii() or not NOT_LATIN.search(text):
        return "LATIN"
    found = Counter(map(_SCRIPT.__getitem__, text))
    found.pop("", None)
    if dense := found.keys() & DENSE:
        return "HIRAGANA" if "HIRAGANA" in dense else max(dense, key=lambda s: (found[s], s))
    return max(found, key=lambda s: (found[s], s), default="LATIN")


def segments(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches between blank lines, headings and marked lines; never across one."""
    at = 0
    for m in [*BLANK.finditer(text), None]:
        end = m.start() if m else len(text)
        if at < end:
            start, line, closed = at, at, False
            while line < end:
                nl = text.find("\n", line, end)
                stop = end if nl < 0 else nl
                marked = MARKER.match(text, line, stop)
                heading = HEADING.match(text, line, stop)
                if (marked or heading or closed) and line > start:
                    yield start, line
                    start = line
                closed = bool(marked or heading)
                line = stop + 1
            yield start, end
        at = m.end() if m else end


# -- languages


class Languages:
    """Tells languages by profiles: ``words[label]`` is {word: share of the label's documents that hold it}."""

    def __init__(self, words: dict[str, dict[str, float]], least: float = 0.03):
        self.scripts: dict[str, str] = {}
        for label, of in words.items():
            seen: Counter = Counter()
            for w, p in of.items():
                seen[script_of(w)] += p
            self.scripts[label] = max(seen, key=lambda s: (seen[s], s)) if seen else "LATIN"
        #: the label that stands for a script when nothing else tells
        self.main: dict[str, str] = {}
        for label in words:
            s = self.scripts[label]
            if s not in DENSE and s not in self.main:
                self.main[s] = label
        every: Counter = Counter()
        for of in words.values():
            every.update(of)
        self.votes: dict[str, list[tuple[str, float]]] = defaultdict(list)
        others = max(1, len(words) - 1)
        for label, of in words.items():
            told = [(p * g, w, g) for w, p in of.items() if p >= least and (g := math.log((p + 0.001) / ((every[w] - p) / others + 0.001))) > 1]
            for _, w, g in sorted(told, reverse=True)[:PROFILE]:
                self.votes[w].append((label, g))
        self.votes = dict(self.votes)
        self.known = frozenset(self.votes)

    def of(self, part: str, words: list[str], label: str | None) -> tuple[str, str]:
        """(language, script) of a stretch of text; an empty part stands for one without letters of other scripts than Latin."""
        script = script_of(part) if part else "LATIN"
        if script in DENSE:
            return script, script
        votes: dict[str, float] = defaultdict(float)
        for w in self.known & set(words):
            for x, g in self.votes[w]:
                if self.scripts[x] == script:
                    votes[x] += g
        if label and self.scripts.get(label) == script:
            votes[label] += 1.0
        if votes:
            return max(votes, key=lambda x: (votes[x], x)), script
        return self.main.get(script, script), script


def label_code() -> Column:
    """The language code of a label, without region, in lower case; null for what is none and for 'und'."""
    code = F.lower(F.regexp_extract("lang", r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1))
    return F.when((code != "") & (code != "und"), code)


def learn_languages(docs: DataFrame, sample: int = SAMPLE) -> Languages:
    """Profiles from about ``sample`` documents of each label, drawn by a hash of their id; labels may be wrong now and then."""
    labelled = docs.select("doc_id", "text", label_code().alias("code")).where("code is not null")
    sizes = {r["code"]: r["count"] for r in labelled.groupBy("code").count().collect()}  # language codes: at most 26**2 + 26**3
    if not sizes:
        return Languages({})
    spark = docs.sparkSession
    shares = spark.createDataFrame([(c, min(1.0, sample / n)) for c, n in sizes.items()], "code string, share double")
    drawn = labelled.join(F.broadcast(shares), "code").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    drawn = drawn.select("code", "doc_id", F.array_distinct(F.split("text", r"\s+")).alias("words"))
    found = drawn.select("code", F.explode(F.filter(F.concat(F.array(F.lit("")), "words"), lambda w: (w == "") | w.rlike(r"^[\p{L}\p{M}]{1,12}$"))).alias("w"))
    # '' stands for the document itself; what comes back are words of at least a hundredth of a label's sample
    counts = found.groupBy("code", "w").agg(F.count(F.lit(1)).alias("n"))
    top = counts.withColumn("all", F.max(F.when(F.col("w") == "", F.col("n"))).over(W.partitionBy("code"))).where("n >= 0.01 * all and (n >= 3 or all < 300)")
    words: dict[str, dict[str, float]] = {c: {} for c, _ in sorted(sizes.items(), key=lambda x: (-x[1], x[0]))}
    for r in top.where("w <> ''").collect():
        words[r["code"]][r["w"]] = r["n"] / r["all"]
    return Languages(words)


# -- the pass over the texts


class Scanner:
    """Finds the places at which units may end and counts what tells about the doubtful ones."""

    def __init__(self, languages: Languages):
        self.languages = languages
        self.tokens: dict[str, Counter] = defaultdict(Counter)
        self.starts: Counter = Counter()
        self.ends: Counter = Counter()
        self.contexts: dict[tuple, list] = {}
        self.pairs: dict[str, dict[str, list]] = defaultdict(dict)
        self.seen_words: dict[str, tuple[str, str]] = {}
        self.seen_types: dict[str, str] = {}
        self.doc: list[int] = []
        self.copy: list[int] = []
        self.stop: list[int] = []
        self.next: list[int] = []
        self.ctx: list[int | None] = []

    # counts

    def held(self) -> int:
        """Counted entries that are held in memory."""
        return sum(map(len, self.tokens.values())) + sum(map(len, self.pairs.values())) + len(self.contexts) + len(self.starts)

    def counted(self) -> pa.RecordBatch:
        """The counts so far, which are then forgotten."""
        rows = [("t", lang, t, None, None, n, None) for lang, c in self.tokens.items() for t, n in c.items()]
        rows += [("s", lang, a, None, None, n, None) for (lang, a), n in self.starts.items()]
        rows += [("e", lang, a, None, None, n, None) for (lang, a), n in self.ends.items()]
        rows += [("c", *key, n, h) for key, (h, n) in self.contexts.items()]
        for c in (self.tokens, self.starts, self.ends, self.contexts, self.pairs, self.seen_words, self.seen_types):
            c.clear()
        cols = list(zip(*rows)) if rows else [()] * 7
        none = [None] * len(rows)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*cols, none, none, none, none], SCAN)], schema=SCAN)

    def places(self) -> pa.RecordBatch:
        """The places so far, which are then forgotten."""
        n = len(self.doc)
        out = [pa.array(["b"] * n, pa.string()), *[pa.nulls(n, f.type) for f in list(SCAN)[1:6]], *[pa.array(c, pa.int64()) for c in (self.ctx, self.doc, self.copy, self.stop, self.next)]]
        for c in (self.ctx, self.doc, self.copy, self.stop, self.next):
            c.clear()
        return pa.RecordBatch.from_arrays(out, schema=SCAN)

    def context(self, *key: str) -> list:
        """[number, count] of a context, which is counted; its number is a hash of it."""
        c = self.contexts.get(key)
        if c is None:
            c = self.contexts[key] = [xxhash.xxh64_intdigest("\x00".join(key)) - (1 << 63), 0]
        c[1] += 1
        return c

    def word(self, w: str) -> tuple[str, str]:
        """(form, shape) of a word: without the marks at its edges and with digits as 0; s small, d digit, o other."""
        known = self.seen_words.get(w)
        if known is None:
            c = w[:1]
            shape = "s" if c.islower() and not any(x.isupper() for x in w[1:]) else "d" if c.isdigit() else "o"
            known = self.seen_words[w] = (DIGITS.sub("0", w).strip(EDGES), shape)
        return known

    def type(self, before: str) -> str:
        known = self.seen_types.get(before)
        if known is None:
            known = before.lower().lstrip("\"“”„«»‘’'([¿¡")
            known = self.seen_types[before] = known if known.isalpha() else DIGITS.sub("0", known)
        return known

    # places

    def text(self, doc: int, text: str, label: str | None) -> None:
        """Write down the places of a document: (stop, next) of what ends there and where the next unit would begin."""
        first, n = len(self.doc), len(text)
        flat = text.encode().translate(_FLAT).decode()
        latin = text.isascii() or not NOT_LATIN.search(text)
        begun = False
        for s, e in segments(text):
            while s < e and text[s].isspace():
                s += 1
            if s == e:
                continue
            while text[e - 1].isspace():
                e -= 1
            if not begun:
                begun = True
                self.stop.append(-1)
                self.ctx.append(None)
            self.next.append(s)
            self.segment(text, flat, s, e, label, latin)
            self.stop.append(e)
            self.ctx.append(None)
        if begun:
            self.next.append(n)
            self.doc += [doc] * (len(self.stop) - first)
            self.copy += [xxhash.xxh64_intdigest(text) - (1 << 63)] * (len(self.stop) - first)

    def place(self, flat: str, at: int, n: int, ctx: int | None) -> None:
        """A unit may end here; the end of the segment is no such place, as it is written down anyway."""
        if at < n:
            self.stop.append(at)
            self.ctx.append(ctx)
            while flat[at].isspace():
                at += 1
            self.next.append(at)

    def segment(self, text: str, flat: str, begin: int, n: int, label: str | None, latin: bool) -> None:
        """The places between begin and n, the segment's end; flat is the text with plain spaces and all ASCII digits as 0."""
        words = flat[begin:n].split()
        lang, script = self.languages.of("" if latin else text[begin:n], words, label)
        dense = script in DENSE
        if not dense:
            self.tokens[lang].update(words)
            if len(words) > 3 and (form := self.word(words[0])[0]):
                self.starts[lang, form] += 1
        cache = self.pairs[lang]
        depth: list[tuple[str, int]] = []
        marker = MARKER.match(text, begin, n)
        skip = marker.end() if marker else begin
        straight = None
        last_of: dict[str, int] = {}
        stops, nexts, ctxs = self.stop, self.next, self.ctx
        find, rfind = flat.find, flat.rfind
        for m in EVENT.finditer(flat, skip, n):
            s, e = m.span()
            c = flat[s]
            if c == "." and e == s + 1:
                raw = ""
                if e < n and flat[e] == " ":  # most periods stand in a pair of words that has been met before
                    k = find(" ", e + 1, n)
                    raw = flat[max(begin, rfind(" ", begin, s) + 1) : n if k < 0 else k]
                    if (known := cache.get(raw)) is not None:
                        known[1] += 1
                        if not depth:
                            stops.append(e)
                            nexts.append(e + 1)
                            ctxs.append(known[0])
                        continue
                while e < n and flat[e] in CLOSERS:
                    if flat[e] == '"':
                        straight = flat.count('"', begin, n) % 2 == 0 if straight is None else straight
                        if straight:
                            break
                    e += 1
                if e < n and not flat[e].isspace():
                    continue
                marks, dash, nxt = _NEXT.match(flat, e, n).groups()
                if not nxt and not marks:
                    continue
                form, shape = self.word(nxt)
                if marks and marks[0] in "\"“„«" and shape != "d" or dash and shape == "o":
                    shape = "m"
                k = s
                while k > begin and flat[k - 1] == " ":
                    k -= 1
                before = flat[max(begin, rfind(" ", begin, k) + 1) : k]
                if not before.isalnum() and (of := before.split()):
                    before = of[-1]
                here = lang
                if (dense or not before.isascii()) and any(map(str.isalpha, before)) and (own := script_of(before)) != script:
                    here = own if own in DENSE else self.languages.main.get(own, own)
                known = self.context(here, self.type(before), form, shape)
                if raw and not dash and nxt and k == s and raw == f"{before}. {marks}{nxt}":
                    cache[raw] = known
                if not depth:
                    self.place(flat, e, n, known[0])
                continue
            if c in MARKS:
                closing = False
                if c == '"':
                    straight = flat.count('"', begin, n) % 2 == 0 if straight is None else straight
                    if not straight:
                        continue
                    closing = bool(depth) and depth[-1][0] == '"'
                elif c == "“":
                    closing = bool(depth) and depth[-1][0] == "„"
                elif c in "”»」』）)":
                    closing = True
                if not closing:
                    mate = MATES[c]
                    if mate not in last_of:
                        last_of[mate] = rfind(mate, begin, n)
                    if last_of[mate] >= e:  # an opening mark that nothing closes opens nothing
                        depth.append((c, s))
                    continue
                if not depth:
                    continue
                o, opened = depth.pop()
                if depth:
                    continue
                k = s - 1
                while k > opened and flat[k].isspace():
                    k -= 1
                if k > opened and flat[k] in TERMINALS and (end := self.quotation(flat, skip, n, opened, e, o, flat[k], lang)) is not None:
                    self.place(flat, e, n, end or None)
                continue
            if depth:
                continue
            if "฀" <= c <= "๿":
                self.place(flat, s + 1, n, None)
                continue
            if c == ";" and (script != "GREEK" or e < n and not flat[e].isspace() and flat[e] not in CLOSERS):
                continue
            while e < n and flat[e] in CLOSERS:
                if flat[e] == '"':
                    straight = flat.count('"', begin, n) % 2 == 0 if straight is None else straight
                    if straight:
                        break
                e += 1
            if c in FULL or c == "…" and dense:
                self.place(flat, e, n, None)
                if c in FULL:
                    if s > begin:
                        self.ends[lang, flat[s - 1]] += 1
                    k = e
                    while k < n and flat[k].isspace():
                        k += 1
                    if k < n:
                        self.starts[lang, flat[k]] += 1
                continue
            if e < n and not flat[e].isspace():
                continue
            if self.capital(flat, e, n):
                self.place(flat, e, n, None)
                if c in "!?؟।" and not dense and (form := self.word(_NEXT.match(flat, e, n).group(3))[0]):
                    self.starts[lang, form] += 1

    @staticmethod
    def capital(flat: str, at: int, n: int) -> bool:
        """Whether what stands at this place, before n, can begin a sentence; nothing can't."""
        while at < n and flat[at].isspace():
            at += 1
        if flat[at : at + 2] in ("— ", "– "):
            at += 2
        c = flat[at] if at < n else ""
        if not c or c in ",;:)»”":
            return False
        if c in "\"“„«「『(":
            return True
        while c and c in "¿¡‘'([":
            at += 1
            c = flat[at] if at < n else ""
        if not c.islower():
            return True
        at += 1
        while at < n and not flat[at].isspace():
            if flat[at].isupper():
                return True
            at += 1
        return False

    def quotation(self, flat: str, skip: int, n: int, opened: int, e: int, mark: str, last: str, lang: str) -> int | None:
        """None if the sentence goes on behind a quotation or bracket that ends with a terminal, 0 if it ends, else the context that tells."""
        k = e
        while k < n and flat[k].isspace():
            k += 1
        if k == n:
            return None
        c = flat[k]
        if mark == "（":
            return None
        if mark in "「『":
            return None if c in "、，,。．！？" else self.context(lang, "」", c, "q")[0]
        if mark == "“" and last in FULL:
            if c in "，、。！？；：":
                return None
            j = opened
            while j > skip and flat[j - 1].isspace():
                j -= 1
            if j > skip and flat[j - 1] not in "。！？…”」』":
                return 0
            m = _CLAUSE.match(flat, e, n)
            return self.context(lang, "”", flat[m.end() - 2], "a")[0] if m and m.end() - 2 >= k else 0
        if flat[e] in ".,;:!?" or c in ",;:":
            return None
        return 0 if self.capital(flat, k, n) else None


# -- statistics


def _strip(c: str) -> Column:
    """A token without surrounding punctuation, its final period included."""
    return F.regexp_replace(c, r"^[\"“”„«»‘’'()\[\]{}<>,;:!?…*_¿¡—–.-]+|[\"“”„«»‘’'()\[\]{}<>,;:!?…*_¿¡—–.-]+$", "")


def _ratio(k: Column, n: Column, p0: Column) -> Column:
    """Dunning's log-likelihood ratio of k successes in n trials against the rate p0; negative where they are the fewer."""
    q = k / n
    term = lambda x, y: F.when(x > 0, x * F.ln(x / y)).otherwise(0.0)
    return 2 * (term(k, n * p0) + term(n - k, n * (1 - p0))) * F.when(q < p0, -1).otherwise(1)


def decisions(counts: DataFrame, work: Scratch) -> DataFrame:
    """``(ctx, n, ends)`` of every distinct context of ``counts(what, lang, a, b, shape, ctx, n)``.

    All tables are joined by (language, word); their sizes follow the vocabulary. A table with a row per language is
    small: languages are labels or scripts.
    """
    dbl = lambda c: F.col(c).cast("double")
    # types: lower case, with and without the final period
    dotted = F.col("a").rlike(r"[^.]\.[\"“”»’')\]]*$")
    counts = counts.withColumn("a", F.when(F.col("what") == "t", F.regexp_replace("a", r"\p{Nd}+", "0")).otherwise(F.col("a")))
    forms = counts.where("what = 't'").select("lang", _strip("a").alias("form"), F.when(dotted, F.col("n")).otherwise(0).alias("with_dot"), "n").where("form <> ''")
    forms = work.save(forms.groupBy("lang", "form").agg(F.sum("n").alias("n"), F.sum("with_dot").alias("dots")), "forms")
    whole = forms.groupBy("lang").agg(F.sum("n").alias("all_n"), F.sum("dots").alias("all_dots"))
    types = forms.groupBy("lang", F.lower("form").alias("type")).agg(F.sum("n").alias("n"), F.sum("dots").alias("dots")).where("dots > 0").join(F.broadcast(whole), "lang")
    plain = F.char_length(F.regexp_replace("type", r"\.", ""))
    ratio = _ratio(dbl("dots"), dbl("n"), F.col("all_dots") / F.col("all_n"))
    scaled = F.col("ratio") * F.exp(-plain.cast("double")) * (F.char_length("type") - plain + 1) * F.pow(F.greatest(plain, F.lit(1)).cast("double"), -(F.col("n") - F.col("dots")).cast("double"))
    types = types.withColumn("ratio", ratio).select("lang", "type", (scaled >= LLR_ABBREVIATION).alias("abbr"), (F.col("dots") > 0.5 * F.col("n")).alias("often"), (F.col("ratio") > LLR_SURE).alias("sure"))
    types = types.where("sure and (abbr or often) or type = '0'").select("lang", "type", "abbr")

    # starters: words at undoubted starts against all their occurrences
    s = counts.where("what = 's'").select("lang", _strip("a").alias("form"), "n").where("form <> ''").groupBy("lang", "form").agg(F.sum("n").alias("starts"))
    all_s = s.groupBy("lang").agg(F.sum("starts").alias("all_starts"))
    words = s.join(forms, ["lang", "form"], "full").join(F.broadcast(whole), "lang").join(F.broadcast(all_s), "lang").where("n is not null")
    words = words.select("lang", "form", _ratio(F.least(F.coalesce("starts", F.lit(0)), F.col("n")).cast("double"), dbl("n"), F.col("all_starts") / F.col("all_n")).alias("llr"))

    # contexts of periods: what follows each type, by kind and as pairs
    c = counts.where("what = 'c' and shape not in ('q', 'a')").select("ctx", "lang", F.col("a").alias("type"), F.col("b").alias("form"), "shape", "n")
    c = work.save(c.join(words, ["lang", "form"], "left").withColumn("llr", F.coalesce("llr", F.lit(0.0))), "contexts")
    tally = lambda on: F.sum(F.when(on, F.col("n")).otherwise(0))
    other = F.col("shape") == "o"
    follow = c.groupBy("lang", "type").agg(
        tally((F.col("shape") == "m") | other & (F.col("llr") > LLR_SURE)).alias("start"), tally(other & (F.col("llr") < 0)).alias("mid"),
        tally(F.col("shape") == "s").alias("small"), tally(F.col("shape") == "d").alias("digit"),
    )
    second = c.groupBy("lang", "form").agg(F.sum("n").alias("as_follower"))
    all_c = c.groupBy("lang").agg(F.sum("n").alias("all_followers"))
    initial = F.col("type").rlike(r"^\p{L}$")
    kept = F.when(initial, ".").otherwise(F.col("type"))  # any initial may stand before any name, so they count as one
    pair = c.join(types.select("lang", "type", "abbr"), ["lang", "type"], "left").where(F.col("abbr") | initial | (F.col("type") == "0"))
    pair = pair.groupBy("lang", kept.alias("first"), "form").agg(F.sum("n").alias("together"))
    pair = pair.join(c.groupBy("lang", kept.alias("first")).agg(F.sum("n").alias("followers")), ["lang", "first"]).join(second, ["lang", "form"]).join(F.broadcast(all_c), "lang")
    pair = pair.where(_ratio(dbl("together"), dbl("followers"), F.col("as_follower") / F.col("all_followers")) > LLR_SURE).select("lang", "first", "form", F.lit(True).alias("bound"))
    known = types.join(follow, ["lang", "type"], "left").withColumn("known", F.lit(True))
    c = c.join(known, ["lang", "type"], "left").withColumn("first", kept).join(pair, ["lang", "first", "form"], "left")
    for x in ("start", "mid", "small", "digit"):
        c = c.withColumn(x, F.coalesce(x, F.lit(0)).cast("double"))
    for x in ("known", "abbr", "bound"):
        c = c.withColumn(x, F.coalesce(x, F.lit(False)))
    kind = F.col("type")
    size, alpha, number = F.char_length(kind), kind.rlike(r"^\p{L}+$"), kind == "0"
    start, mid, small, digit, known, abbr, llr = map(F.col, ("start", "mid", "small", "digit", "known", "abbr", "llr"))
    is_ = lambda x: F.col("shape") == x
    special = abbr | (alpha & (size == 1)) | number
    long_word = alpha & (size > 3)
    rate = (start + F.when(abbr | (alpha & (size == 1)), 0.1).otherwise(1.0)) / (start + mid + 1)
    even = (start + small + digit) / 2
    toss = F.when(start > 0, start * F.ln(start / even)).otherwise(0.0) + F.when(small + digit > 0, (small + digit) * F.ln((small + digit) / even)).otherwise(0.0)
    starts_here = (llr > LLR_SURE) | is_("m")
    ends = (
        # a small letter follows: only behind a word that is surely none that is abbreviated
        F.when(is_("s"), F.when(known, ~abbr & (start > 20 * small)).otherwise(long_word))
        .when(~known, ~(alpha & (size == 1)) & ~(size.between(2, 5) & kind.contains(".") & ~kind.rlike("^[0-9]")))
        # its periods tell no long word from others, however many they are
        .when(~abbr & long_word, ~is_("d") | (small + digit == 0) | ((start > 0) & ((start >= small + digit) | (2 * toss < LLR_SURE))))
        .when(~special & (small <= 0.2 * (start + mid + digit + 1)) & (start >= mid), True)
        .when(is_("d"), (~special & (rate > 0.5)) | ((rate > 0.6) & (digit <= start)))
        .when(F.col("bound") & is_("o") & ((llr <= LLR_SURE) | (rate <= 0.6)), False)
        .when(number & (rate < 0.9), starts_here)
        .when(rate < 0.05, False)
        .otherwise((rate > 0.6) | starts_here)
    )
    periods = c.select("ctx", "n", ends.alias("ends"))

    # behind quotations in scripts without spaces: characters that go on are commoner there than at starts, those that end
    # an attribution commoner at the end of a clause behind a quotation than of other sentences
    q = counts.where("what = 'c' and shape in ('q', 'a')").select("ctx", "lang", "shape", F.col("b").alias("form"), "n")
    base = counts.where("what in ('s', 'e')").select("lang", F.when(F.col("what") == "s", "q").otherwise("a").alias("shape"), F.col("a").alias("form"), F.col("n").alias("plain"))
    totals = q.groupBy("lang", "shape").agg(F.sum("n").alias("all_n")).join(base.groupBy("lang", "shape").agg(F.sum("plain").alias("all_plain")), ["lang", "shape"], "left")
    q = q.join(base, ["lang", "shape", "form"], "left").join(F.broadcast(totals), ["lang", "shape"])
    goes_on = F.col("n") / F.col("all_n") > F.coalesce("plain", F.lit(0)) / (F.coalesce("all_plain", F.lit(0)) + 1)
    return periods.union(q.select("ctx", "n", (~goes_on).alias("ends")))


def sentence_units(documents: DataFrame) -> DataFrame:
    """``(doc_id, start_pos, end_pos)`` of every sentence unit, in code points, ends exclusive.

    Rows without a doc_id, null texts and texts of white space only have no units; repeated rows of one doc_id count once,
    different texts under one doc_id have each their units; an empty table gives no rows; texts are read whole; columns
    other than doc_id, text and lang are ignored.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text", "lang").where("text is not null and doc_id is not null")
    work = Scratch(spark, "sentences")
    model = spark.sparkContext.broadcast(learn_languages(docs))  # at most PROFILE words of each language code

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(model.value)
        for b in batches:
            for doc, text, label in zip(*(b.column(i).to_pylist() for i in range(3))):
                scan.text(doc, text, label)
                if len(scan.doc) >= 50_000:
                    yield scan.places()
            if scan.held() > 500_000:
                yield scan.counted()
        yield scan.places()
        yield scan.counted()

    scanned = work.save(docs.select("doc_id", "text", label_code().alias("code")).mapInArrow(run, SCAN_DDL), "scan")
    counts = scanned.where("what <> 'b'").groupBy("what", "lang", "a", "b", "shape").agg(F.sum("n").alias("n"), F.first("ctx").alias("ctx"))
    decided = work.save(decisions(work.save(counts, "counts"), work), "decided")
    places = scanned.where("what = 'b'").select("doc_id", "copy", "stop", "next", "ctx")
    total = decided.agg((F.sum("n") * HEAVY_SHARE).alias("many"))  # one row
    heavy = decided.join(F.broadcast(total)).where("n >= many").select("ctx", "ends")  # at most 1 / HEAVY_SHARE rows
    doubtful = places.where("ctx is not null").join(F.broadcast(heavy.withColumnRenamed("ends", "soon")), "ctx", "left")
    kept = doubtful.where("soon").select("doc_id", "copy", "stop", "next")
    rest = doubtful.where("soon is null").drop("soon").join(decided.where("ends").select("ctx"), "ctx", "left_semi").select("doc_id", "copy", "stop", "next")
    stops = places.where("ctx is null").drop("ctx").union(kept).union(rest)
    begin = F.lag("next").over(W.partitionBy("doc_id", "copy").orderBy("stop"))
    # the second of two equal rows, of a repeated document, would begin behind its own end
    return stops.withColumn("start_pos", begin).where("start_pos < stop").select("doc_id", "start_pos", F.col("stop").alias("end_pos"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_units(table(spark, sf_dir, "documents"))
