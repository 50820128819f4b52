"""Problem 7: evaluation texts that leak into training text.

The word windows of the test items, normalised, form a hash set that every task gets by broadcast. Each document is
normalised in the same way; where words of the items stand side by side, its windows are looked up in that set, and a hit
names an item and a place in it. Documents with hits are verified: from the hits, matching runs are extended word by
word, chained in the item's order, and the share of the item's words that the chain covers decides.

Items of equal words are one item with several ids. Windows that several different items share (stock lines, set
phrases; counted over all items) start no match, unless an item would keep less than a third of its windows: then all of
them do. An item shorter than a window is found where all of it stands.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.session import Scratch, table

WINDOW, WINDOW_DENSE = 3, 6  # words; characters where the script has no spaces
SHARED = 3  # a window in so many items or more is stock
LEAST_SHARE = 1 / 3
BLOCK_CHARS = 4_000_000  # of item text in one broadcast; more items go through the corpus in several passes
NEAR = 6  # words between a run and its neighbour that it vouches for
FAR, NEAR_BY = 6.0, 20  # distance within a passage costs a word for each 20 words beyond the first 20, but 6 at most

# Letters of other scripts that look like a Latin one.
LOOKALIKES = str.maketrans("аеорсухіјѕһԁԛԝվοαενικρτυ", "aeopcyxijshdqwuoaevikptu")

_TOKEN = re.compile(r"[一-鿿㐀-䶿぀-ヿ฀-๿]|[^\W_一-鿿㐀-䶿぀-ヿ฀-๿]+")
_DENSE = re.compile(r"[一-鿿㐀-䶿぀-ヿ฀-๿]")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_BREAK = re.compile(r"(?<=[^\W\d_])[-‐]\r?\n[ \t]*(?=[^\W\d_])")
_MARKS = re.compile(
    "[­̀-ͯ҃-҉֑-ֽؐ-ًؚ-़ٰٟิ-ฺ็-๎​-‏‪-‮⁠-⁤゙゚︀-️﻿]+"
)
_PIECES = re.compile(r"&#?\w+;|" + _TAG.pattern + r"|[-‐]\r?\n[ \t]*|(?P<ascii>[^&<\-\x80-\U0010ffff]+)|.", re.S)
#: Small letters for large ones, spaces for all but letters and digits.
_ASCII = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else 32 for b in range(256))
_PLAIN_TOKEN = re.compile(r"[^\W_]+")
_FOREIGN = re.compile(r"[Ͱ-֏]")
_WORDS = re.compile(r"\w*[Ͱ-֏]\w*")


def _latin(m: re.Match) -> str:
    """A word of mixed scripts with its look-alikes made Latin."""
    w = m.group()
    return w.translate(LOOKALIKES) if re.search("[a-z]", w) else w


def normalise(text: str) -> str:
    """Layout, case, accents, invisible marks, mark-up and look-alike letters taken out."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", text)
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    text = text.lower()
    if _FOREIGN.search(text):
        text = _WORDS.sub(_latin, text)
    return _BREAK.sub("", text) if "\n" in text else text


def words(text: str) -> list[str]:
    """Normalised words; characters where the script has no spaces."""
    if text.isascii() and "&" not in text and "<" not in text and "-\n" not in text and "-\r" not in text:
        return text.encode().translate(_ASCII).decode().split()
    plain = normalise(text)
    return (_TOKEN if _DENSE.search(plain) else _PLAIN_TOKEN).findall(plain)


def is_dense(w: list[str]) -> bool:
    return 2 * sum(len(x) == 1 and bool(_DENSE.match(x)) for x in w) > len(w)


def window_size(w: list[str]) -> int:
    return min(len(w), WINDOW_DENSE if is_dense(w) else WINDOW)


_MIX = np.uint64(0x9E3779B97F4A7C15)


def anchors(own: list[bool], least: float = LEAST_SHARE) -> list[bool]:
    """Which windows of an item start a match: those of its own, or all where these are too few."""
    return own if sum(own) >= least * len(own) else [True] * len(own)


class Items:
    """Windows of the test items. ``rare`` maps a window to the (item, place)s at which it starts a match.

    ``items`` holds (item, text or words, which windows are its own); where the latter is left out, the windows are
    counted over the items at hand.
    """

    def __init__(self, items: list[tuple]):
        self.words = {x[0]: words(x[1]) if isinstance(x[1], str) else list(x[1]) for x in items}
        self.words = {i: w for i, w in self.words.items() if w}
        self.dense = {i: is_dense(w) for i, w in self.words.items()}
        size = self.size = {i: window_size(w) for i, w in self.words.items()}
        own = {x[0]: x[2] for x in items if len(x) > 2}
        if not own:
            many: dict[tuple, set[int]] = defaultdict(set)
            for i, w in self.words.items():
                for k in range(len(w) - size[i] + 1):
                    many[tuple(w[k : k + size[i]])].add(i)
            own = {i: [len(many[tuple(w[k : k + size[i]])]) < SHARED for k in range(len(w) - size[i] + 1)] for i, w in self.words.items()}
        self.rare: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        self.windows = {i: len(w) - size[i] + 1 for i, w in self.words.items()}
        for i, w in self.words.items():
            for k, start in enumerate(anchors(own[i])):
                if start:
                    self.rare[tuple(w[k : k + size[i]])].append((i, k))
        self.rare = dict(self.rare)
        self.vocabulary = {x: j for j, x in enumerate(dict.fromkeys(x for g in self.rare for x in g))}
        codes: dict[int, list[int]] = defaultdict(list)
        for g in self.rare:
            codes[len(g)].append(int(self._code(np.array([[self.vocabulary[x] for x in g]], np.uint64))[0]))
        self.codes = {n: np.unique(np.array(c, np.uint64)) for n, c in sorted(codes.items())}
        self.places = {i: self._places(w) for i, w in self.words.items()}

    @staticmethod
    def _code(ids: np.ndarray) -> np.ndarray:
        """One number for each row of word numbers; different windows may share one, so hits are looked up again."""
        out = np.zeros(len(ids), np.uint64)
        for j in range(ids.shape[1]):
            out = (out ^ ids[:, j]) * _MIX
            out ^= out >> np.uint64(29)
        return out

    @staticmethod
    def _places(w: list[str]) -> dict[str, list[int]]:
        at: dict[str, list[int]] = defaultdict(list)
        for k, x in enumerate(w):
            at[x].append(k)
        return dict(at)

    def hits(self, w: list[str]) -> dict[int, list[tuple[int, int]]]:
        """item -> (place in the document, place in the item) of its windows that start a match."""
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        ids = np.fromiter(map(self.vocabulary.get, w, repeat(-1)), np.int64, len(w))
        known = ids >= 0
        ids = ids.astype(np.uint64)
        for n, codes in self.codes.items():
            if len(w) < n:
                break
            at = known[: len(w) - n + 1].copy()
            for j in range(1, n):
                at &= known[j : len(w) - n + 1 + j]
            at = np.flatnonzero(at)
            if not at.size:
                continue
            code = self._code(ids[at[:, None] + np.arange(n)])
            found = codes[np.minimum(np.searchsorted(codes, code), len(codes) - 1)] == code
            for p in at[found].tolist():
                for i, k in self.rare.get(tuple(w[p : p + n]), ()):
                    out[i].append((p, k))
        return out

    def cover(self, item: int, w: list[str], hits: list[tuple[int, int]]) -> tuple[float, list[tuple[int, int]]]:
        """(share of the item's words, matched (start, end) in the document): the best passage, or the chain of all long
        runs of the document and what lies beside them, whatever is larger.

        Set phrases of a few words occur by chance all over a long text, so short runs on their own count within a passage
        only; a run of two windows or more counts wherever it stands.
        """
        size, best = len(self.words[item]), (0.0, [])
        far = 2 * size + 100
        hits = sorted(set(hits))
        runs: set[tuple[int, int, int]] = set()
        start = 0
        for j in range(1, len(hits) + 1):
            if j == len(hits) or hits[j][0] - hits[j - 1][0] > far:
                own = hits[start:j]
                lo = max(0, own[0][0] - 2 * own[0][1] - 20)
                hi = min(len(w), own[-1][0] + 2 * (size - own[-1][1]) + 20)
                if part := self._runs(item, w, lo, hi, own):
                    best = max(best, self._passage(part))
                    runs.update(part)
                start = j
        best = max(best, self._chain(self._firm(sorted(runs), 2 * (WINDOW_DENSE if self.dense[item] else WINDOW))))
        return min(1.0, best[0] / size), best[1]

    @staticmethod
    def _firm(runs: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
        """The runs of that length, and those that lie within 20 words of one in both texts, or of such a run."""
        firm = [r[2] >= least for r in runs]
        starts, longest = [r[0] for r in runs], max((r[2] for r in runs), default=0)
        todo = [j for j, ok in enumerate(firm) if ok]
        while todo:
            p, k, length = runs[todo.pop()]
            for j in range(bisect_left(starts, p - 20 - longest), bisect_right(starts, p + length + 20)):
                p2, k2, l2 = runs[j]
                if not firm[j] and ((0 <= p2 - p - length <= 20 and 0 <= k2 - k - length <= 20) or (0 <= p - p2 - l2 <= 20 and 0 <= k - k2 - l2 <= 20)):
                    firm[j] = True
                    todo.append(j)
        return [r for r, ok in zip(runs, firm) if ok]

    @staticmethod
    def _passage(runs: list[tuple[int, int, int]]) -> tuple[float, list[tuple[int, int]]]:
        """(weight, its (start, end) in the document) of the best passage: the heaviest chain in which distance costs.

        Runs near by are tried one by one; all others cost the same, so the best of them is looked up by item place.
        """
        top: list[tuple[float, int]] = []
        reach = int(FAR * NEAR_BY) + NEAR_BY
        longest = max(r[2] for r in runs)
        size = max(k + length for _, k, length in runs) + 1
        best: list[tuple[float, int]] = [(0.0, -1)] * (size + 1)  # prefix maxima by the item place at which a chain ends
        ended, todo = sorted(range(len(runs)), key=lambda q: runs[q][0] + runs[q][2]), 0
        for j, (p, k, length) in enumerate(runs):
            gain, before = float(length), -1
            while todo < j and runs[ended[todo]][0] + runs[ended[todo]][2] <= p - reach:
                q = ended[todo]
                todo += 1
                for d in range(runs[q][2]):  # its tail may be left out
                    at, value = runs[q][1] + runs[q][2] - d, (top[q][0] - d, q)
                    while at <= size and best[at] < value:
                        best[at] = value
                        at += at & -at
            at = k
            while at > 0:
                if best[at][1] >= 0 and best[at][0] + length - FAR > gain:
                    gain, before = best[at][0] + length - FAR, best[at][1]
                at -= at & -at
            for q in range(j - 1, -1, -1):
                p2, k2, l2 = runs[q]
                if p2 + longest <= p - reach:
                    break
                cut = max(0, p2 + l2 - p, k2 + l2 - k)
                if p2 < p and k2 < k and cut < length:
                    gap, inserted = k - k2 - l2, p - p2 - l2
                    edit = gap if 0 < gap <= 4 and inserted <= gap + 3 else 0
                    far = min(FAR, max(0, inserted - NEAR_BY) / NEAR_BY)  # what lies far apart is less likely one passage
                    if (g := top[q][0] + length - cut + edit - far) > gain:
                        gain, before = g, q
            top.append((gain, before))
        j = max(range(len(runs)), key=lambda j: top[j][0])
        weight, pieces = top[j][0], []
        while j >= 0:
            pieces.append((runs[j][0], runs[j][0] + runs[j][2]))
            j = top[j][1]
        return weight, pieces[::-1]

    def _runs(self, item: int, w: list[str], lo: int, hi: int, hits: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(place in the document, place in the item, length) of the runs of equal words that count.

        Those are the runs that hold a hit, those within NEAR words of one in both texts, and so on. So the document is
        read around the hits only, and further wherever such a run comes close to the edge of what has been read.
        """
        n = self.size[item]
        shortest = min(n, 4 if self.dense[item] else 2)
        pad = NEAR + shortest + 8
        parts = self._merged([(max(lo, p - pad), min(hi, p + n + pad)) for p, _ in hits])
        while True:
            runs = self._sure([r for s, e in parts for r in self._diagonals(item, w, s, e, shortest)], set(hits), n)
            starts, wider = [s for s, _ in parts], set()
            for p, _, length in runs:
                j = bisect_right(starts, p) - 1
                s, e = parts[j]
                if s > lo and p - NEAR - shortest < s:
                    wider.add((max(lo, s - 4 * pad), s))
                if e < hi and p + length + NEAR + shortest > e:
                    wider.add((e, min(hi, e + 4 * pad)))
            if not wider:
                return runs
            parts = self._merged([*parts, *wider])

    @staticmethod
    def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for s, e in sorted(spans):
            if out and s <= out[-1][1]:
                out[-1] = (out[-1][0], max(e, out[-1][1]))
            else:
                out.append((s, e))
        return out

    def _diagonals(self, item: int, w: list[str], lo: int, hi: int, shortest: int) -> list[tuple[int, int, int]]:
        """Maximal runs of equal words within a stretch of the document."""
        places = self.places[item]
        runs, open_ = [], {}
        for p in range(lo, hi):
            at = places.get(w[p])
            if at is None:
                if open_:
                    runs += [(s, k, p - s) for s, k in open_.values() if p - s >= shortest]
                    open_ = {}
                continue
            now = {}
            for k in at:
                s = open_.pop(k - 1, None)
                now[k] = s if s else (p, k)
            if open_:
                runs += [(s, k, p - s) for s, k in open_.values() if p - s >= shortest]
            open_ = now
        runs += [(s, k, hi - s) for s, k in open_.values() if hi - s >= shortest]
        return runs

    @staticmethod
    def _sure(runs: list[tuple[int, int, int]], anchors: set[tuple[int, int]], n: int) -> list[tuple[int, int, int]]:
        """The runs that hold a hit, and those next to one that counts, in order."""
        runs.sort()
        starts, longest = [r[0] for r in runs], max((r[2] for r in runs), default=0)
        sure = [any((p + d, k + d) in anchors for d in range(length - n + 1)) for p, k, length in runs]
        todo = [j for j, ok in enumerate(sure) if ok]
        while todo:
            p, k, length = runs[todo.pop()]
            for j in range(bisect_left(starts, p - NEAR - longest), bisect_right(starts, p + length + NEAR)):
                p2, k2, l2 = runs[j]
                if not sure[j] and ((0 <= p2 - p - length <= NEAR and 0 <= k2 - k - length <= NEAR) or (0 <= p - p2 - l2 <= NEAR and 0 <= k - k2 - l2 <= NEAR)):
                    sure[j] = True
                    todo.append(j)
        return [r for r, ok in zip(runs, sure) if ok]

    @staticmethod
    def _chain(runs: list[tuple[int, int, int]]) -> tuple[int, list[tuple[int, int]]]:
        """(weight, its (start, end) in the document) of the heaviest chain of runs, or heads of them, in the order of both texts.

        However far apart runs lie, they add up; small gaps on both sides are edits and count as reproduced. The document
        is swept once: ``low[v]`` is the lowest item place at which a chain of weight v + 1 or more ends.
        """
        low: list[int] = []
        who: list[tuple[int, int]] = []  # (run, words of it) that ends the chain of low
        base, back = [0] * len(runs), [(-1, 0)] * len(runs)
        ends: dict[tuple[int, int], int] = {}
        begin: dict[int, list[int]] = defaultdict(list)
        for j, r in enumerate(runs):
            begin[r[0]].append(j)
        live: list[int] = []
        p = -1
        for first in sorted(begin):
            if first < p:  # swept along with the runs before it
                continue
            p = first
            while live or p in begin:
                for j in begin.get(p, ()):
                    _, k, _ = runs[j]
                    v = bisect_left(low, k)
                    base[j], back[j] = v, who[v - 1] if v else (-1, 0)
                    for gap in range(1, 5):
                        for inserted in range(gap + 4):
                            q = ends.get((p - inserted, k - gap), -1)
                            if q >= 0 and base[q] + runs[q][2] + gap > base[j]:
                                base[j], back[j] = base[q] + runs[q][2] + gap, (q, runs[q][2])
                    for q in live:  # runs that reach over the start of this one lose their tails
                        gap = k - runs[q][1] - runs[q][2]
                        if 0 < gap <= 4 and base[q] + p - runs[q][0] + gap > base[j]:
                            base[j], back[j] = base[q] + p - runs[q][0] + gap, (q, p - runs[q][0])
                live += begin.get(p, ())
                for j in live:
                    d = p - runs[j][0]
                    k, v = runs[j][1] + d, base[j] + d
                    while len(low) <= v:
                        low.append(1 << 60)
                        who.append((-1, 0))
                    while v >= 0 and low[v] > k:
                        low[v], who[v] = k, (j, d + 1)
                        v -= 1
                p += 1
                for j in live:
                    if runs[j][0] + runs[j][2] == p:
                        q = ends.get((p, runs[j][1] + runs[j][2]), -1)
                        if q < 0 or base[q] + runs[q][2] < base[j] + runs[j][2]:
                            ends[p, runs[j][1] + runs[j][2]] = j
                live = [j for j in live if runs[j][0] + runs[j][2] > p]
        if not low:
            return 0, []
        pieces, at = [], who[-1]
        while at[0] >= 0:
            j, d = at
            pieces.append((runs[j][0], runs[j][0] + d))
            at = back[j]
        return len(low), pieces[::-1]

    def reproduced(self, w: list[str], least: float) -> list[tuple[int, float, list[tuple[int, int]]]]:
        """(item, share, (first word, end) of its pieces) of every item of which the words hold at least that share."""
        found = []
        for i, h in self.hits(w).items():
            # in a passage of that share, a tenth of its words at least begin a window that is left whole
            if len(h) > 1 or self.windows[i] == 1:
                starts = len({k for _, k in h})
                if starts >= min(2, self.windows[i]) and starts >= 0.1 * least * len(self.words[i]):
                    share, pieces = self.cover(i, w, h)
                    if share >= least:
                        found.append((i, share, pieces))
        return found

    @staticmethod
    def explained(found: list[tuple[int, float, list[tuple[int, int]]]]) -> list[int]:
        """Which of what was found stays: words that another item explains much better are no leak of an item made alike."""
        out: list[int] = []
        held: list[tuple[float, set[int]]] = []
        for j in sorted(range(len(found)), key=lambda j: (-found[j][1], found[j][0])):
            _, share, pieces = found[j]
            own = {p for s, e in pieces for p in range(s, e)}
            if not any(share < 0.7 * s and 2 * len(own & other) > len(own) for s, other in held):
                held.append((share, own))
                out.append(j)
        return out

    def leaked(self, text: str, least: float) -> list[tuple[int, float, list[tuple[int, int]]]]:
        """(item, share, (first word, end) of its passages) of every item that the text leaks, judged among these items."""
        found = self.reproduced(words(text), least)
        return [(found[j][0], found[j][1], self._passages(found[j][0], found[j][2])) for j in self.explained(found)]

    def _passages(self, item: int, pieces: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The pieces joined unless they lie far apart."""
        far, out = 2 * len(self.words[item]) + 100, [pieces[0]]
        for s, e in pieces[1:]:
            if s - out[-1][1] > far:
                out.append((s, e))
            else:
                out[-1] = (out[-1][0], e)
        return out


@lru_cache(65_536)
def _plain(piece: str) -> str:
    return _MARKS.sub("", unicodedata.normalize("NFKD", piece)).lower()


def word_offsets(text: str) -> list[tuple[int, int]]:
    """(start, end) in the original text of each word of ``words(text)``; only for texts that leak, as it is slow."""
    chars: list[str] = []
    at: list[tuple[int, int]] = []
    for m in _PIECES.finditer(text):
        raw, (s, e) = m.group(), m.span()
        if m.lastgroup:  # ASCII with nothing to take out
            chars.append(raw.lower())
            at += zip(range(s, e), range(s + 1, e + 1))
            continue
        if len(raw) > 1 and raw[0] == "<":
            continue
        if len(raw) > 1 and raw[0] in "-‐" and s and text[s - 1].isalpha() and text[e : e + 1].isalpha():
            continue
        out = _plain(html.unescape(raw) if raw[0] == "&" else raw)
        chars.append(out)
        at += [(s, e)] * len(out)
    joined = "".join(chars)
    if _FOREIGN.search(joined):
        joined = _WORDS.sub(_latin, joined)
    return [(at[m.start()][0], at[m.end() - 1][1]) for m in _TOKEN.finditer(joined)]


def prepared(items: DataFrame, work: Scratch) -> tuple[DataFrame, DataFrame]:
    """``(item_id, words, own)`` of every different item, under its lowest id, and ``(item_id, same)``: all ids of each.

    ``own`` tells for each window whether fewer than SHARED different items hold it, counted over all items.
    """

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.assign(words=[words(t) for t in b["text"]])
            yield b.assign(size=[window_size(w) for w in b["words"]])[["item_id", "words", "size"]]

    read = items.select("item_id", "text").where("item_id is not null and text is not null")
    read = work.save(read.mapInPandas(tokens, "item_id long, words array<string>, size int").where("size > 0"), "items")
    one = work.save(read.groupBy("words", "size").agg(F.min("item_id").alias("item_id")), "different")
    same = read.select("words", F.col("item_id").alias("same")).join(one.select("words", "item_id"), "words").select("item_id", "same").distinct()
    windows = one.select("item_id", "size", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1), lambda k: F.slice("words", k, F.col("size")))).alias("k", "w"))
    held = windows.groupBy("w").agg(F.count_distinct("item_id").alias("n"))
    own = windows.join(held, "w").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("k", (F.col("n") < SHARED).alias("own")))).alias("o"))
    return work.save(one.join(own.select("item_id", F.col("o.own").alias("own")), "item_id").select("item_id", "words", "own"), "prepared"), same


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int, list[str], list[bool]]]]:
    """The prepared items in blocks of bounded size, one partition of them at a time on the driver."""
    block, size = [], 0
    for r in items.toLocalIterator():
        block.append((r.item_id, r.words, r.own))
        size += sum(map(len, r.words))
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


LEAKS = "doc_id long, item_id long, share double, start_pos long, end_pos long"


def find_leaks(documents: DataFrame, items: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """``(doc_id, item_id, share, start_pos, end_pos)``: every item of which a document reproduces at least that share.

    The share is that of all the document's words in the item's order, wherever they stand. Passages of one item that lie
    far apart have a row each. The positions are code points of the passage in the document, null where the text's mark-up does not let them be told.
    Rows without an id, null and empty texts leak nothing, repeated rows of one doc_id count once, items of equal words
    leak together, empty tables give no rows, further columns are ignored; texts of any length are read whole.
    """
    spark = documents.sparkSession
    work = Scratch(spark, "leaks")
    docs = documents.select("doc_id", "text").where("text is not null and doc_id is not null")
    different, same = prepared(items, work)
    blocks = item_blocks(different)
    block, following = next(blocks, None), None
    out, several = None, False
    pairs = "array<struct<s:long,e:long>>"
    while block is not None:
        following = next(blocks, None)
        several = several or following is not None
        known = spark.sparkContext.broadcast(Items(block))  # of bounded size, see BLOCK_CHARS

        def run(batches: Iterator[pd.DataFrame], known=known, several=several) -> Iterator[pd.DataFrame]:
            items = known.value
            for b in batches:
                rows = []
                for doc, text in zip(b["doc_id"], b["text"]):
                    w = words(text)
                    if found := items.reproduced(w, least):
                        if not several:
                            found = [found[j] for j in Items.explained(found)]
                        at = word_offsets(text)
                        sure = len(at) == len(w)
                        for i, share, pieces in found:
                            spans = [(at[s][0], at[e - 1][1]) if sure else (None, None) for s, e in items._passages(i, pieces)]
                            rows.append((doc, i, share, [{"s": s, "e": e} for s, e in pieces] if several else None, [{"s": s, "e": e} for s, e in spans]))
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "share", "pieces", "spans"])

        part = docs.mapInPandas(run, f"doc_id long, item_id long, share double, pieces {pairs}, spans {pairs}")
        out, block = part if out is None else out.union(part), following
    if out is None:
        return spark.createDataFrame([], LEAKS)
    if several:
        out = _judged(work.save(out, "found"))
    flat = out.select("doc_id", "item_id", "share", F.explode("spans").alias("x")).select("doc_id", "item_id", "share", F.col("x.s").alias("start_pos"), F.col("x.e").alias("end_pos"))
    flat = flat.dropDuplicates(["doc_id", "item_id", "start_pos", "end_pos"])
    return flat.join(same, "item_id").select("doc_id", F.col("same").alias("item_id"), "share", "start_pos", "end_pos")


def _judged(found: DataFrame) -> DataFrame:
    """What was found by items of several blocks, without what another item explains; a document's leaks are bounded by its length."""

    def judge(of: pd.DataFrame) -> pd.DataFrame:
        of = of.drop_duplicates("item_id").reset_index(drop=True)
        stay = Items.explained([(i, share, [(x["s"], x["e"]) for x in pieces]) for i, share, pieces in zip(of["item_id"], of["share"], of["pieces"])])
        return of.iloc[stay][["doc_id", "item_id", "share", "spans"]]

    schema = "doc_id long, item_id long, share double, spans array<struct<s:long,e:long>>"
    many = found.groupBy("doc_id").agg((F.min("item_id") < F.max("item_id")).alias("many"))
    found = found.join(many, "doc_id")
    alone = found.where("not many").select("doc_id", "item_id", "share", "spans")
    return alone.unionByName(found.where("many").drop("many").groupBy("doc_id").applyInPandas(judge, schema))


def remove_leaks(documents: DataFrame, leaks: DataFrame, whole: bool = True) -> DataFrame:
    """The documents without those that leak, or (``whole=False``) without the leaking passages only.

    A passage whose place is not known leaves its document out whole.
    """
    unplaced = leaks.where("start_pos is null").select("doc_id").distinct()
    if whole:
        return documents.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")
    documents, leaks = documents.join(unplaced, "doc_id", "left_anti"), leaks.where("start_pos is not null")
    # spans of one document are few: each is at least a third of an item
    spans = leaks.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start_pos", "end_pos"))).alias("_spans"))
    done = F.aggregate(
        "_spans", F.struct(F.lit("").alias("t"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.struct(
            F.concat(a["t"], F.substr(F.col("text"), (a["at"] + 1).cast("int"), F.greatest(s["start_pos"] - a["at"], F.lit(0)).cast("int"))).alias("t"),
            F.greatest(a["at"], s["end_pos"]).alias("at"),
        ),
        lambda a: F.concat(a["t"], F.substr(F.col("text"), (a["at"] + 1).cast("int"), F.char_length("text"))),
    )
    joined = documents.join(spans, "doc_id", "left")
    return joined.select(*[F.when(F.col("_spans").isNull(), F.col("text")).otherwise(done).alias("text") if c == "text" else F.col(c) for c in documents.columns])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()
