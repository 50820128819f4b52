"""Problem 5: paths that were decoded with the wrong character encoding.

A path is taken apart into its segments. The characters of a segment are mapped back to the bytes that each legacy
encoding has for them; a byte-structure automaton (the DFA of well-formed UTF-8) finds the maximal well-formed multibyte
spans in those bytes, and only the spans are decoded. Where the bytes are no UTF-8, they are read in each of the other
legacy encodings. Which reading is right, if any but the given one, is decided by character pairs: how often the pairs
occur in the names of the whole table, most of which are sound. The counts are kept in a table of fixed size.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.session import table

# Encodings that names are met in, in the order of preference at equal scores.
SINGLE = ["cp1252", "latin-1", "cp1251", "koi8-r", "cp866", "cp437", "cp850", "mac_roman", "cp1253", "iso8859-7", "cp1250", "cp737"]
MULTI = ["cp932", "gbk", "euc_jp", "big5", "euc_kr"]
MISREAD_AS_MULTI = ["gbk", "cp932", "big5"]

SLOTS = 1 << 18
PAIR_FACTOR = 1_000_003
MARGIN = 1.2  # nats by which a reading's mean pair must be likelier than that of the given text
MARGIN_SOUND = 1.3  # the same where the given text shows no sign of damage of its own
LEAST_GAIN = 4.5  # nats that a change must gain in all, so that a lone character needs more evidence
WHOLE = 3.0  # nats a pair for a reading in which every character beyond ASCII came out of a well-formed span
FLOOR = -9.0  # a reading of raw bytes below this is no recovery

#: Well-formed multibyte UTF-8 (Unicode, table 3-7).
SPAN = re.compile(
    rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+"
)
#: A multibyte character that breaks off.
CUT = re.compile(rb"(?:[\xc2-\xdf]|[\xe0-\xef][\x80-\xbf]?|[\xf0-\xf4][\x80-\xbf]{0,2})(?=(?:\.[A-Za-z0-9]{1,5})?\Z)")
LETTERS = re.compile(r"[A-Za-z\x80-\U0010ffff]+")
#: The same for Spark's regular expressions.
LETTERS_JAVA = r"[A-Za-z\x{80}-\x{10ffff}]+"
BEYOND = re.compile(r"[\x80-\U0010ffff]")


def words_in(text: str) -> list[str]:
    """Words with a character beyond ASCII."""
    return [w for w in LETTERS.findall(text) if not w.isascii()]


def _byte_table(name: str) -> list[str]:
    """Character of each byte; bytes that the encoding leaves open stand for the control character of that number."""
    return [bytes([b]).decode(name, "ignore") or chr(b) for b in range(256)]


TO_CHAR = {e: _byte_table(e) for e in SINGLE}
TO_BYTE = {e: {c: b for b, c in reversed(list(enumerate(t)))} for e, t in TO_CHAR.items()}


def word_slot(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % SLOTS


def name_model(files: DataFrame) -> tuple[dict[int, float], dict[int, float], dict[int, float]]:
    """Counts of characters, of character pairs and of words, over all words with a character beyond ASCII.

    All three are bounded whatever the table holds: code points by Unicode, pairs and words by their slot among ``SLOTS``.
    """
    words = files.where(F.col("path").rlike(r"[^\x00-\x7f]")).select(F.explode(F.regexp_extract_all(F.lower("path"), F.lit(LETTERS_JAVA), F.lit(0))).alias("w"))
    words = words.where(F.col("w").rlike(r"[^\x00-\x7f]") & ~F.contains("w", F.lit("�"))).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    # taken apart into characters once: cutting a long word anew at every place would take quadratic time
    chars = words.select("n", F.split(F.concat(F.lit(" "), "w", F.lit(" ")), "").alias("c"))
    both_sides = F.arrays_zip(F.slice("c", 1, F.size("c") - 1).alias("a"), F.slice("c", 2, F.size("c") - 1).alias("b"))
    pairs = chars.select("n", F.explode(both_sides).alias("p")).select("n", F.ascii("p.a").cast("long").alias("a"), F.ascii("p.b").cast("long").alias("b"))
    pairs = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))
    slot = F.pmod(F.col("a") * PAIR_FACTOR + F.col("b"), F.lit(SLOTS))
    both = F.array(F.struct(F.lit(0).alias("t"), slot.alias("k")), F.struct(F.lit(1).alias("t"), F.col("b").alias("k")))
    coded = pairs.select("n", F.explode(both).alias("x")).select("n", "x.t", "x.k")
    named = words.select("n", F.lit(2).alias("t"), F.pmod(F.crc32(F.encode("w", "UTF-8")), F.lit(SLOTS)).alias("k"))
    rows = coded.unionByName(named).groupBy("t", "k").agg(F.sum("n").alias("n")).collect()
    return tuple({r.k: float(r.n) for r in rows if r.t == t} for t in (1, 0, 2))


class Reader:
    """Judges and repairs single paths; results are remembered by word."""

    def __init__(self, chars: dict[int, float], pairs: dict[int, float], words: dict[int, float]):
        self.chars, self.pairs, self.words = chars, pairs, words
        self.total = sum(chars.values()) or 1.0
        self._words: dict[str, list[tuple[tuple, str, float]]] = {}
        self._score: dict[str, tuple[float, int]] = {}
        self._segments: dict[str, str] = {}

    # -- the model

    def score(self, word: str) -> tuple[float, int]:
        """(sum of log probabilities, number) over the pairs with a character beyond ASCII."""
        if (s := self._score.get(word)) is None:
            t, total, n = f" {word.lower()} ", 0.0, 0
            seen = -1
            for m in BEYOND.finditer(t):
                for i in (m.start() - 1, m.start()):  # the pairs on both sides, each once
                    if i <= seen:
                        continue
                    seen, a, b = i, t[i], t[i + 1]
                    x, y = ord(a), ord(b)
                    base = (self.chars.get(y, 0.0) + 0.02) / (self.total + 1000)
                    total += math.log((self.pairs.get((x * PAIR_FACTOR + y) % SLOTS, 0.0) + 3 * base) / (self.chars.get(x, 0.0) + 3)) - self.oddity(a, b)
                    n += 1
            if len(self._score) > 500_000:
                self._score.clear()
            s = self._score[word] = (total, n)
        return s

    def known(self, word: str) -> float:
        """Log count of a word; words without a character beyond ASCII tell nothing."""
        return math.log1p(self.words.get(word_slot(word.lower()), 0.0))

    def text_score(self, text: str) -> tuple[float, int, float]:
        """Pair score, pairs and the mean log count of the words of a text."""
        total, n, seen, words = 0.0, 0, 0.0, words_in(text)
        for w in words:
            s, k = self.score(w)
            total, n, seen = total + s, n + k, seen + self.known(w)
        return total, n, seen / len(words) if words else 0.0

    @staticmethod
    def oddity(a: str, b: str) -> float:
        """What two neighbouring characters lose for what hardly stands in a name, whatever the table's names are like."""
        odd = 0.0
        for c in (a, b):
            if c > "\x7f":
                k = unicodedata.category(c)
                odd += 2.0 if k in ("Cc", "Co", "Cn", "Cs") else 1.0 if "─" <= c <= "▟" else 0.5 if k[0] in "SZ" or k in ("No", "Cf") else 0.0
        return odd

    @staticmethod
    def damaged(word: str) -> bool:
        """Whether a word bears signs of damage: symbols and controls among letters, mixed scripts, capitals inside."""
        scripts, last = set(), ""
        for c in word:
            k = unicodedata.category(c)
            if c > "\x7f" and (k in ("Cc", "Co", "Cn", "So", "Sm", "Sc", "Sk", "No", "Cf", "Zs", "Po", "Pi", "Pf", "Pd", "Ps") or "─" <= c <= "▟"):
                return True
            if k[0] == "L":
                s = unicodedata.name(c, "?").split(" ")[0]
                scripts.add("CJK" if s in ("CJK", "HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "FULLWIDTH", "HALFWIDTH") else s)
                if c.isupper() and last.islower():
                    return True
                last = c
        return len(scripts) > 1

    # -- readings of one word

    @staticmethod
    def bytes_in(word: str, enc: str) -> bytes | None:
        if enc in TO_BYTE:
            to = TO_BYTE[enc]
            try:
                return bytes([to[c] for c in word])
            except KeyError:
                return None
        try:
            return word.encode(enc)
        except UnicodeEncodeError:
            return None

    @staticmethod
    def decode_spans(raw: bytes, enc: str) -> str:
        """Well-formed multibyte spans as UTF-8, everything between them as before."""
        out, at = [], 0
        back = TO_CHAR.get(enc)
        rest = (lambda x: "".join([back[b] for b in x])) if back else (lambda x: x.decode(enc, "replace"))
        for m in SPAN.finditer(raw):
            out.append(rest(raw[at : m.start()]))
            out.append(m.group().decode("utf-8"))
            at = m.end()
        out.append(rest(raw[at:]))
        return "".join(out)

    def utf8_readings(self, word: str) -> Iterator[tuple[tuple, str]]:
        """The word with its multibyte spans decoded, once for each encoding that it may have been read in, then again."""
        for enc in (*SINGLE, *MISREAD_AS_MULTI):
            raw = self.bytes_in(word, enc)
            if raw is None and enc in TO_BYTE:  # characters that the encoding lacks part the word
                to = TO_BYTE[enc]
                runs = re.split("([" + re.escape("".join(sorted({c for c in word if c not in to}))) + "]+)", word)
                fixed = "".join(r if k % 2 else self.decode_spans(bytes([to[c] for c in r]), enc) for k, r in enumerate(runs))
            elif raw is None:
                continue
            else:
                fixed = self.decode_spans(raw, enc)
            if fixed != word and not any("\x80" <= c <= "\x9f" for c in fixed if c not in word):
                yield ("utf-8", enc), fixed
            if fixed != word:
                for enc2 in SINGLE[:2] if enc in SINGLE[:2] else [enc]:
                    again = self.bytes_in(fixed, enc2)
                    if again is not None and (twice := self.decode_spans(again, enc2)) != fixed:
                        yield ("utf-8", enc, enc2), twice

    def readings(self, word: str) -> list[tuple[tuple, str, float]]:
        """(how, reading, gain) for all readings of a word that differ from it; gain is summed over its pairs."""
        if (known := self._words.get(word)) is not None:
            return known
        found: dict[tuple, str] = dict(self.utf8_readings(word))
        for enc in SINGLE:
            raw = self.bytes_in(word, enc)
            for to in SINGLE if raw is not None else ():
                text = "".join([TO_CHAR[to][b] for b in raw])
                if text != word and not any("\x80" <= c <= "\x9f" for c in text):
                    found[(to, enc)] = text
        own, n = self.score(word)
        out = []
        for how, text in found.items():
            total, k = self.score(text)
            # readings of different length are compared by the mean pair, weighted with the given word's pairs
            gain = (total / k if k else -2.0) * n - own + self.known(text) - self.known(word)
            if how[0] == "utf-8" and all(c <= "\x7f" or c not in word for c in text):
                gain += WHOLE * n  # all of it was well-formed, which sound text hardly ever is by chance
            out.append((how, text, gain))
        if len(self._words) > 200_000:
            self._words.clear()
        self._words[word] = out
        return out

    # -- segments and paths

    def segment(self, seg: str) -> str:
        """The segment as it was meant; the same text if it is sound."""
        key = re.sub(r"\d+", "0", seg)
        if (known := self._segments.get(key)) is None:
            known = self._repair(key)
            if len(self._segments) > 200_000:
                self._segments.clear()
            if len(key) <= 300:  # long ones hardly come again
                self._segments[key] = known
        if known == key:
            return seg
        numbers = re.findall(r"\d+", seg)
        if len(re.findall("0", known)) != len(numbers):  # digits among the damaged bytes
            return self._repair(seg)
        it = iter(numbers)
        return re.sub("0", lambda _: next(it), known)

    def _repair(self, seg: str) -> str:
        words = words_in(seg)
        own, n, own_seen = self.text_score(seg)
        if not n:
            return seg
        by: dict[tuple, float] = {}
        for w in words:
            best: dict[tuple, float] = {}
            for how, _, gain in self.readings(w):
                best[how] = max(gain, best.get(how, -1e9))
            for how, gain in best.items():
                by[how] = by.get(how, 0.0) + gain
        margin = MARGIN if any(self.damaged(w) for w in words) else MARGIN_SOUND
        top, fixed = max(margin * n, LEAST_GAIN), seg
        for how, gain in by.items():
            if gain > top:
                top, fixed = gain, self._apply(seg, how)
        for text in self._multibyte(seg):
            total, k, seen = self.text_score(text)
            gain = (total / k if k else -20) * n - own + (seen - own_seen) * len(words)
            if gain > top:
                top, fixed = gain, text
        return fixed

    def _apply(self, seg: str, how: tuple) -> str:
        def one(m: re.Match) -> str:
            w = m.group()
            return w if w.isascii() else next((text for h, text, _ in self.readings(w) if h == how), w)

        return LETTERS.sub(one, seg)

    def _multibyte(self, seg: str) -> Iterator[str]:
        """Readings in encodings of several bytes a character, whose second bytes may be ASCII and part no words."""
        stem, dot, ext = seg.rpartition(".") if re.search(r"\.[A-Za-z0-9]{1,5}\Z", seg) else (seg, "", "")
        high = sum(c > "\x7f" for c in stem)
        if high < 2 or high < 0.5 * sum(c.isalpha() or c > "\x7f" for c in stem):
            return
        seen: set[bytes] = set()
        for enc in SINGLE:
            raw = self.bytes_in(stem, enc)
            if raw is None or raw in seen:
                continue
            seen.add(raw)
            for to in MULTI:
                try:
                    yield raw.decode(to) + dot + ext
                except UnicodeDecodeError:
                    pass

    def raw_segment(self, raw: bytes) -> tuple[str | None, bool]:
        """(text, garbled) of a segment's bytes; the text is None where no reading is likely."""
        try:
            text = raw.decode("utf-8")
            fixed = text if text.isascii() else self.segment(text)
            return fixed, fixed != text
        except UnicodeDecodeError:
            pass
        if (cut := CUT.search(raw)) and SPAN.search(raw, 0, cut.start()):
            try:
                (raw[: cut.start()] + raw[cut.end() :]).decode("utf-8")
                return raw.decode("utf-8", "replace"), False
            except UnicodeDecodeError:
                pass
        best, top = None, FLOOR
        for enc in (*SINGLE, *MULTI):
            texts = []
            if enc in TO_CHAR:
                texts = ["".join([TO_CHAR[enc][b] for b in raw]), self.decode_spans(raw, enc)]
            else:
                try:
                    texts = [raw.decode(enc)]
                except UnicodeDecodeError:
                    continue
            for text in texts:
                total, k, seen = self.text_score(text)
                if k and total / k + seen > top and not any("\x80" <= c <= "\x9f" for c in text):
                    best, top = text, total / k + seen
        return best, True

    def path(self, path: str | None, raw: bytes | None) -> str | None:
        """The intended path of a garbled one, empty if it can't be recovered; None if the path isn't garbled."""
        if path is None or path.isascii():
            return None
        if raw is not None:
            parts = [self.raw_segment(s) for s in raw.split(b"/")]
            if not any(g for _, g in parts):
                return None
            return "" if any(t is None for t, _ in parts) else "/".join(t for t, _ in parts)
        segs = path.split("/")
        if "�" in path:
            return "" if any("�" in s and not self._cut_off(s) for s in segs) else None
        fixed = [s if s.isascii() else self.segment(s) for s in segs]
        return "/".join(fixed) if fixed != segs else None

    def _cut_off(self, seg: str) -> bool:
        """Whether all that is missing is the end of the last character: sound text beyond ASCII right before it."""
        m = re.fullmatch(r"([^�]*[^\x00-\x7f�])�(\.[A-Za-z0-9]{1,5})?", seg)
        if not m:
            return False
        words = words_in(m.group(1))
        n = sum(self.score(w)[1] for w in words)
        return sum(self.score(w)[0] for w in words) / n > FLOOR and not any(self.damaged(w) for w in words)


_READERS: dict[str, Reader] = {}  # of this worker process, by the token of the query


def restore_paths(files: DataFrame) -> DataFrame:
    """``(archive_id, file_id, path_fixed)`` of the rows whose path is garbled; empty where nothing brings it back.

    Rows with a null path or key are left out, ASCII paths are sound, repeated rows of one key count once, an empty table
    gives no rows; further columns are ignored. Paths of any length are read whole.
    """
    spark = files.sparkSession
    model = spark.sparkContext.broadcast(name_model(files))  # of bounded size, see name_model
    token = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _READERS.get(token)
        if reader is None:
            reader = Reader(*model.value)
            _READERS.clear()
            _READERS[token] = reader
        for b in batches:
            fixed = [reader.path(p, None if r is None else bytes(r)) for p, r in zip(b["path"], b["path_raw"])]
            keep = [f is not None for f in fixed]
            yield pd.DataFrame({"archive_id": b["archive_id"][keep], "file_id": b["file_id"][keep], "path_fixed": pd.Series([f for f in fixed if f is not None], dtype=object, index=b.index[keep])})

    odd = files.where("archive_id is not null and file_id is not null").where(F.col("path").rlike(r"[^\x00-\x7f]")).select("archive_id", "file_id", "path", "path_raw")
    return odd.mapInPandas(run, "archive_id long, file_id long, path_fixed string").dropDuplicates(["archive_id", "file_id"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore_paths(table(spark, sf_dir, "files"))
