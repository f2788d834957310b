"""Garbled text from wrong character encodings: found, and restored where possible.

A best-first search runs over a passage's states. Operations are: encode the passage's non-ASCII runs in one encoding and
decode them in another, and unescape HTML entities. States are visited once (by hash); a character-plausibility cost
orders the queue, and the cheapest state reached is the restored text. A passage counts as garbled if a state reached by
at least one encode and decode is cheaper by ``margin`` bits, or if the cheapest text still shows replacement or C1 control
characters, which no writing has.

The cost of a text is the sum, over its pairs of neighbouring characters of which one isn't ASCII, of the bits that a
pair model needs. The model is counted over all distinct passages (hashed to 2^20 counters, a table of fixed size that is
broadcast), one that comes n times weighing 1 + log2(n), on top of small fixed prior counts for pairs that occur in
writing: they decide where the corpus says nothing.

Passages are lines, cut further after sentence ends. Every passage with a character that isn't ASCII, or an entity, is
searched; passages that are alike in these characters and their neighbours share one search.

Defined results: null and empty texts are never garbled. Texts of any length are handled whole, passage by passage.
Repeated texts give the same result each. A passage that can't be restored keeps its text and is reported as garbled.
"""

from __future__ import annotations

import heapq
import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import log2
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 20
#: Encodings that text is often read in by mistake, and those it may have been written in; those of several bytes apart.
READ_AS = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "koi8_r", "cp866", "cp1250", "iso8859_2", "cp1254")
READ_AS_WIDE = ("gbk", "big5", "shift_jis", "euc_kr")
WRITTEN_IN = ("cp1251", "koi8_r", "cp866", "cp1250", "iso8859_2", "cp1254", "cp1252", "mac_roman", "cp850")
WRITTEN_IN_WIDE = ("gbk", "big5", "shift_jis", "euc_jp", "euc_kr")
_RUN = re.compile(r"[^\x00-\x7f]+")
_RUNS = re.compile(r"([^\x00-\x7f]+)")
_NO_ASCII = re.compile(r"[^\x00-\x7f]+\Z")
_AS_ASCII = {"shift_jis": re.compile("[¥‾]")}
_BROKEN = re.compile("[�\x80-\x9f]")
_ENTITY = re.compile(r"&(?:[A-Za-z]{2,8}|#\d{2,6}|#x[0-9A-Fa-f]{2,5});")
_PASSAGE = re.compile(r"(?<=[.!?…。！？])(?=\s)|(?<=\n)|(?<=[。！？])")
# letters and signs common in writing, for the prior
_LOWER = set("äöüßéèêëàâîïôûùçœáíóúñãõąćęłńśźżığşа") | {chr(c) for c in range(0x430, 0x450)} | {"ё"}
_UPPER = {c.upper() for c in _LOWER if len(c.upper()) == 1} | {"İ"}
_SIGNS = set("“”„’‘–—…«»€£°§µ²³½№¿¡·•\xa0")
#: Bits that a state must save for the passage to count as garbled; bits an operation costs.
MARGIN, STEP = 10.0, 2.0
_CONTEXT = re.compile(r"[\x00-\x7f]?(?:[^\x00-\x7f]|&(?:[A-Za-z]{2,8}|#\d{2,6});)+[\x00-\x7f]?")
_WORDLIKE = re.compile(r"[a-z][^\x00-\x7f]|[^\x00-\x7f][a-z]|[^\W\d_a-z][^\x00-\x7f]|[^\x00-\x7f][^\W\d_a-z]")
_NARROW = frozenset(WRITTEN_IN)
_ALIKE = {c: 48 for c in range(48, 58)} | {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Limits:
    """What bounds a search: states that are expanded (None: all), operations in a row, and bits by which a state on the way
    may be dearer than the start."""

    states: int | None = 64
    depth: int = 4
    slack: float = 20.0


def _codes(text: str) -> np.ndarray:
    """Code points, ASCII letters in lower case, digits and blanks unified, with a blank at either end."""
    x = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    x = np.where((x >= 65) & (x <= 90), x + 32, x)
    x = np.where((x >= 48) & (x <= 57), 48, x)
    return np.where(x <= 32, 32, x)


def _slots(x: np.ndarray) -> np.ndarray:
    """Slots of the pairs of which one character isn't ASCII."""
    a, b = x[:-1], x[1:]
    use = (a > 127) | (b > 127)
    return ((a[use] * 1_000_003 + b[use] * 7919) ^ (a[use] >> 3)) % SLOTS


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        texts = [t for t in rb.column(0).to_pylist() if t and not t.isascii()]
        yield pa.record_batch([pa.array([p for t in texts for p in _PASSAGE.split(t) if not p.isascii()], pa.string())], names=["passage"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(SLOTS)
    for rb in batches:
        texts = rb.column(0).to_pylist()
        weight = 1 + np.log2(rb.column(1).to_numpy(zero_copy_only=False))
        x = _codes(" ".join(texts))  # a blank stands between two passages, as at either end
        of = np.repeat(weight, [len(t) + 1 for t in texts])  # of the pairs that begin at a passage's first blank and characters
        use = (x[:-1] > 127) | (x[1:] > 127)
        n += np.bincount(_slots(x), of[: len(use)][use], SLOTS)
    at = np.flatnonzero(n)
    yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["slot", "n"])


def _slot(pair: str) -> int:
    """The slot of one pair."""
    a, b = (o + 32 if 65 <= o <= 90 else 48 if 48 <= o <= 57 else max(o, 32) for o in map(ord, pair))
    return ((a * 1_000_003 + b * 7919) ^ (a >> 3)) % SLOTS


def _kind(c: str) -> str:
    o = ord(c)
    if o < 128:
        return "a" if c.isalpha() else " "
    if c in _LOWER:
        return "y" if 0x400 <= o < 0x500 else "l"
    if c in _UPPER:
        return "Y" if 0x400 <= o < 0x500 else "L"
    if c in _SIGNS:
        return "s"
    if 0x4E00 <= o <= 0x9FFF:
        try:  # the common ideographs are the first level of this set
            return "h" if 0xB0 <= c.encode("gb2312")[0] <= 0xD7 else "?"
        except UnicodeEncodeError:
            return "?"
    if 0x3000 <= o <= 0x30FF or 0xFF00 <= o <= 0xFF5E:
        return "h"
    return "?"


_PRIOR = {"al": 0.5, "la": 0.5, " l": 0.3, "l ": 0.3, " L": 0.3, "La": 0.3, "yy": 0.5, " y": 0.2, "y ": 0.2, " Y": 0.2, "Yy": 0.3, "YY": 0.1, "as": 0.2, "sa": 0.2, " s": 0.3, "s ": 0.3, "hh": 0.05, "ls": 0.1, "sl": 0.1, "sL": 0.1, "ss": 0.05, "ys": 0.2, "sy": 0.2, "sY": 0.2, "hs": 0.05, "sh": 0.05}
_RARE = 0.015
#: Pairs whose bits are remembered.
_REMEMBERED = 500_000


class _Pairs(dict):
    """Bits of pairs of characters, found when first asked for; pairs of ASCII have none."""

    def __init__(self, bits: Callable[[str], float]):
        super().__init__()
        self.bits = bits

    def __missing__(self, pair: str) -> float:
        if len(self) > _REMEMBERED:
            self.clear()
        self[pair] = x = 0.0 if pair.isascii() else self.bits(pair)
        return x

    def of(self, text: str) -> list[float]:
        """Bits of every pair of a text of which one character isn't ASCII."""
        return [x for x in map(self.__getitem__, map(add, " " + text, text + " ")) if x]

    def sum(self, text: str) -> float:
        return sum(map(self.__getitem__, map(add, " " + text, text + " ")))


def prior(pair: str, weights: dict[str, float] = _PRIOR) -> float:
    return weights.get(_kind(pair[0]) + _kind(pair[1]), _RARE)


class Restorer:
    """Finds and restores garbled passages; ``weights`` are the prior counts of pairs by kind."""

    def __init__(self, counts: np.ndarray, margin: float = MARGIN, limits: Limits = Limits(), weights: dict[str, float] = _PRIOR):
        self.counts, self.total, self.margin, self.limits = counts, float(counts.sum()) + 2000.0, margin, limits
        self.memo: dict = {}
        self.expanded = 0  # states, in all searches

        def bits(pair: str) -> float:
            return log2(self.total / (float(self.counts[_slot(pair)]) + prior(pair, weights)))

        self.pairs = _Pairs(bits)

    def cost(self, text: str) -> float:
        entities = len(_ENTITY.findall(text)) if "&" in text else 0
        return self.pairs.sum(text) + 20.0 * len(_BROKEN.findall(text)) + 12.0 * entities

    def _neighbours(self, text: str, path: list):
        """(state, operation) for each operation that changes the text, which ``path`` led to."""
        narrow, swallows = not path, _swallows(path)
        if "&" in text and _ENTITY.search(text):
            t = html.unescape(text)
            if t != text:
                yield t, None
        parts = _RUNS.split(text)  # every second part is a run
        if len(parts) == 1:
            return
        runs = dict.fromkeys(parts[1::2])
        wide = max(map(len, runs)) >= 4
        by_op: dict[tuple, dict[str, str]] = {}
        for r in runs:
            for op, kind, v in _readings(r, swallows):
                if kind == 0 or (narrow if kind == 1 else wide):
                    by_op.setdefault(op, {})[r] = v
        for op in sorted(by_op, key=_ORDER.__getitem__):
            new, t = by_op[op], parts.copy()
            t[1::2] = [new.get(r, r) for r in parts[1::2]]
            yield "".join(t), op

    def search(self, text: str) -> list:
        """The operations that lead to the cheapest reachable text; none if it isn't cheap enough.

        Bytes of one encoding always have a meaning in another encoding of single bytes, so such a change is only made
        once, to the text as it stands, and is weighed where it makes words: letters next to letters.
        """
        own, lim = self.cost(text), self.limits
        in_words = " ".join(m for m in text.split("\x1f") if _WORDLIKE.search(m))
        own_bits = self.pairs.of(in_words)
        own_words, n_pairs = sum(own_bits), len(own_bits)
        best, best_cost, queue, seen, n = [], own, [(own, 0, text, [])], {text}, 0
        while queue and (lim.states is None or n < lim.states):
            cost, _, t, path = heapq.heappop(queue)
            n += 1
            if len(path) == lim.depth or cost > own + lim.slack:
                continue
            for u, op in self._neighbours(t, path):
                if u in seen:
                    continue
                seen.add(u)
                c, way = self.cost(u) + STEP * (len(path) + 1), [*path, op]
                if op and op[1] in _NARROW:
                    if c < best_cost - 1e-9 and own_words - self.pairs.sum(apply(way, in_words)) >= max(self.margin, 2 * n_pairs):
                        best, best_cost = way, c
                    continue
                if c < best_cost - 1e-9:
                    best, best_cost = way, c
                heapq.heappush(queue, (c, len(seen), u, way))
        self.expanded += n
        return best if any(best) and own - best_cost >= self.margin else []

    def passage(self, passage: str) -> tuple[str, bool]:
        """The restored passage and whether it is garbled."""
        entity = "&" in passage and bool(_ENTITY.search(passage))
        if passage.isascii() and not entity:
            return passage, False
        # what matters are the runs with their neighbours; passages alike in these have one result
        key = "\x1f".join(_CONTEXT.findall(passage))
        if not entity:
            key = key.translate(_ALIKE)
        way = self.memo.get(key)
        if way is None:
            way = self.search(key)
            if len(self.memo) > 100_000:
                self.memo.clear()
            self.memo[key] = way
        out = apply(way, passage)
        return out, bool(way) or bool(_BROKEN.search(out))

    def text(self, text: str | None) -> tuple[str | None, int]:
        """The restored text and the number of garbled passages."""
        if not text or text.isascii() and not ("&" in text and _ENTITY.search(text)):
            return text, 0
        out, n = [], 0
        for p in _PASSAGE.split(text):
            if p.isascii() and "&" not in p:
                out.append(p)
                continue
            q, bad = self.passage(p)
            out.append(q)
            n += bad
        return "".join(out), n


@lru_cache(maxsize=100_000)
def _encode(run: str, enc: str) -> bytes:
    """Bytes of a run, none if it has no such form; C1 controls stand for themselves where a Windows code page has gaps."""
    if enc in _AS_ASCII and _AS_ASCII[enc].search(run):  # signs that would become ASCII by themselves
        return b""
    try:
        return run.encode(enc)
    except UnicodeEncodeError:
        pass
    if enc.startswith("cp125"):
        try:
            return b"".join(bytes([ord(c)]) if 0x80 <= ord(c) <= 0x9F else c.encode(enc) for c in run)
        except UnicodeEncodeError:
            pass
    return b""


#: Every operation: an encoding a text was read in, one it was written in.
_ORDER = {(enc, dec): i for i, (enc, dec) in enumerate((enc, dec) for enc in READ_AS + READ_AS_WIDE for dec in ("utf-8", *(WRITTEN_IN_WIDE + WRITTEN_IN if enc in READ_AS else ())) if enc != dec)}


@lru_cache(maxsize=50_000)
def _readings(run: str, swallows: bool) -> tuple[tuple[tuple[str, str], int, str], ...]:
    """(operation, kind, text) of every operation that has another meaning for a run; kind 1 is narrow, 2 wide, 0 UTF-8."""
    out = []
    for enc, dec in _ORDER:
        raw = _encode(run, enc)
        if raw and (v := _decode(raw, dec, swallows and enc in READ_AS_WIDE)) is not None and v != run:
            out.append(((enc, dec), 0 if dec == "utf-8" else 1 if dec in _NARROW else 2, v))
    return tuple(out)


@lru_cache(maxsize=100_000)
def _decode(raw: bytes, dec: str, wide: bool) -> str | None:
    """The text of some bytes; none if there is none, or if it has ASCII, which a wrong encoding of single bytes leaves alone.

    A wrong encoding of several bytes (``wide``) takes an ASCII byte as the second one of a character, so only a text of
    nothing but ASCII is refused there.
    """
    try:
        out = raw.decode(dec)
    except UnicodeDecodeError:
        return None
    return None if out.isascii() or not wide and not _NO_ASCII.match(out) else out


def _swallows(path: list) -> bool:
    """Whether ASCII may come back in the next operation: only UTF-8 was undone before, not one of many meanings of the bytes."""
    return all(op is None or op[1] == "utf-8" for op in path)


def apply(way: list, text: str) -> str:
    """The text after the operations: None unescapes, (encoding, encoding) encodes and decodes every run that allows it."""
    for i, op in enumerate(way):
        wide = op is not None and op[0] in READ_AS_WIDE and _swallows(way[:i])
        if op is None:
            text = html.unescape(text)
        else:
            text = _RUN.sub(lambda m: (b := _encode(m[0], op[0])) and _decode(b, op[1], wide) or m[0], text)
    return text


def pair_counts(docs: DataFrame, text: str) -> np.ndarray:
    """Counts of neighbouring characters over all distinct passages, copies damped, in SLOTS hashed counters."""
    copies = docs.select(text).mapInArrow(_passages, "passage string").groupBy("passage").agg(F.count(F.lit(1)).alias("copies"))
    rows = copies.mapInArrow(_count, "slot int, n double").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # at most SLOTS rows
    counts = np.zeros(SLOTS, np.float32)
    counts[rows["slot"].to_numpy(int)] = rows["n"].to_numpy()
    return counts


def restore(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", margin: float = MARGIN, only_garbled: bool = True, limits: Limits = Limits()) -> DataFrame:
    """``doc_id``, ``restored`` text and ``n_passages``, the number of garbled passages."""
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shared = spark.sparkContext.broadcast(pair_counts(slim, "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Restorer(shared.value, margin, limits)
        for rb in batches:
            got = [r.text(t) for t in rb.column("text").to_pylist()]
            keep = [i for i, (_, n) in enumerate(got) if n or not only_garbled]
            yield pa.record_batch([rb.column("doc_id").take(pa.array(keep, pa.int64())), pa.array([got[i][0] for i in keep], pa.string()), pa.array([got[i][1] for i in keep], pa.int32())], names=["doc_id", "restored", "n_passages"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, restored string, n_passages int").withColumnRenamed("doc_id", doc_id)
