"""Splitting oversized texts at natural boundaries, by balanced targets.

A text over the limit is laid out as the least number of pieces that could hold it; equal-length
targets are placed, each is snapped to the strongest boundary near it, and where any piece then
breaks a limit, pieces are added: to the whole, or where that doesn't do, to that piece's span. Only units (sentences or lines)
that are themselves over a limit are cut inside.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import n_pairs, n_words

MAX_WORDS, MAX_PAIRS, OVERLAP = 491, 1843, 40
FORCED, SENTENCE, LINE, PARAGRAPH = 0, 1, 2, 3
NAMES = np.array(["forced", "sentence", "line", "paragraph"])
_WORD = re.compile(r"[A-Za-z0-9]+")
_BREAK = re.compile(r"[.!?](?=[ \t\n\r]|\Z)|[\n\r]")
_PARA = re.compile(r"\n[ \t]*\r?\n|\r[ \t]*\r")
_OUT = "seq long, memory_id long, piece int, pieces int, begins int, ends int, fresh_from int, words int, pairs int, boundary string, unit_over boolean, text string"


def over_limit(text: Column, max_words: int = MAX_WORDS, max_pairs: int = MAX_PAIRS) -> Column:
    """Whether a text has more words or more adjacent character pairs than a piece may have. Short texts are told by their length."""
    short = F.octet_length(F.coalesce(text, F.lit(""))) <= min(2 * max_words, max_pairs)
    return ~short & ((n_words(text) > max_words) | (n_pairs(text) > max_pairs))


class Layout:
    """Atoms (words, longer ones in parts) of a text, and the strength of the gap after each."""

    def __init__(self, text: str, max_words: int, max_pairs: int) -> None:
        begin, end = [], []
        for m in _WORD.finditer(text):
            a, b = m.span()
            parts = -(-(b - a) // max_pairs)  # a part of at most max_pairs characters has fewer pairs
            cuts = [a + (b - a) * i // parts for i in range(parts + 1)]
            begin += cuts[:-1]
            end += cuts[1:]
        self.begin, self.end = np.array(begin, np.int64), np.array(end, np.int64)
        n = len(begin)
        self.words = np.arange(n + 1)
        self.pairs = np.concatenate([[0], np.cumsum(self.end - self.begin - 1)])
        strength, cut_at = np.full(n + 1, -1), np.append(self.begin, len(text))  # of the gap before atom i; where a cut falls
        para = {m.end() for m in _PARA.finditer(text)}
        for m in _BREAK.finditer(text):
            i = int(np.searchsorted(self.begin, m.end()))
            kind = LINE if text[m.start()] in "\r\n" else SENTENCE
            strength[i] = max(strength[i], PARAGRAPH if m.end() in para else kind)
        strength[n] = PARAGRAPH
        self.strength, self.cut_at, self.n = strength, cut_at, n


def lay_out(text: str, max_words: int = MAX_WORDS, max_pairs: int = MAX_PAIRS, overlap: int = OVERLAP) -> tuple[Layout, list[tuple[int, int, int]], bool]:
    """The layout, its pieces as (first atom, first fresh atom, end atom), and whether a unit is over a limit."""
    lay = Layout(text, max_words, max_pairs)
    words, pairs = lay.words, lay.pairs
    fits = lambda a, b: words[b] - words[a] <= max_words and pairs[b] - pairs[a] <= max_pairs

    # segment ends: unit ends, and inside units over a limit the fewest equal parts with room for the overlap
    core_words, core_pairs = max(1, max_words - overlap), max(1, max_pairs - max_pairs // 4)
    ends, unit_over, at = [], False, 0
    for e in np.nonzero(lay.strength[1:] >= SENTENCE)[0] + 1:
        if not fits(at, e):
            unit_over = True
            todo = at
            while not fits(todo, e):
                k = max(2, -(-int(words[e] - words[todo]) // core_words), -(-int(pairs[e] - pairs[todo]) // core_pairs))
                w = int(np.searchsorted(words, words[todo] + (words[e] - words[todo]) / k, "right")) - 1
                p = int(np.searchsorted(pairs, pairs[todo] + (pairs[e] - pairs[todo]) / k, "right")) - 1
                nxt = max(todo + 1, min(w, p))
                while nxt > todo + 1 and not fits(todo, nxt):
                    nxt -= 1
                todo = nxt
                lay.strength[todo] = max(lay.strength[todo], FORCED)
                ends.append(todo)
        ends.append(int(e))
        at = int(e)
    ends = np.array(sorted(set(ends)))

    strength = lay.strength[ends]
    by_pairs = pairs[lay.n] / max_pairs > words[lay.n] / max_words
    load = (pairs if by_pairs else words).astype(float)
    room = max(1.0, max_pairs - max_pairs * overlap / max_words if by_pairs else core_words)
    at_end = load[ends]

    def holds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces fresh from `a` to `b` keep the limits, overlap included. A single segment may crowd out its overlap."""
        begin = np.maximum(0, a - overlap)
        whole = (words[b] - words[begin] <= max_words) & (pairs[b] - pairs[begin] <= max_pairs)
        i = np.searchsorted(ends, a, "right")
        return whole | (ends[np.minimum(i, len(ends) - 1)] == b)

    def placed(a: int, b: int, k: int) -> list[int]:
        """Cuts inside (a, b) for `k` pieces: equal-length targets, each snapped to the strongest boundary within a quarter of a piece, else to the nearest."""
        step = (load[b] - load[a]) / k
        target = load[a] + step * np.arange(1, k)
        pick = np.full(k - 1, -1)
        inside = (ends > a) & (ends < b)
        for level in (PARAGRAPH, LINE, SENTENCE, FORCED):
            own = np.nonzero(inside & (strength == level))[0]
            open_ = np.nonzero(pick < 0)[0]
            if len(own) and len(open_):
                j = np.searchsorted(at_end[own], target[open_])
                left, right = own[np.maximum(j - 1, 0)], own[np.minimum(j, len(own) - 1)]
                near = np.where(np.abs(at_end[left] - target[open_]) <= np.abs(at_end[right] - target[open_]), left, right)
                good = np.abs(at_end[near] - target[open_]) <= step / 4
                pick[open_[good]] = near[good]
        every, open_ = np.nonzero(inside)[0], np.nonzero(pick < 0)[0]
        if len(every) and len(open_):
            j = np.searchsorted(at_end[every], target[open_])
            left, right = every[np.maximum(j - 1, 0)], every[np.minimum(j, len(every) - 1)]
            pick[open_] = np.where(np.abs(at_end[left] - target[open_]) <= np.abs(at_end[right] - target[open_]), left, right)
        return np.unique(ends[pick[pick >= 0]]).tolist()

    # the least count whose layout holds: steps of growing width up to one that does, then halved back
    tried: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def bad(k: int) -> int:
        own = np.array([0, *placed(0, lay.n, k), lay.n])
        tried[k] = own, holds(own[:-1], own[1:])
        return int((~tried[k][1]).sum())

    low, step = max(2, int(np.ceil(load[-1] / room))) - 1, 1
    high, most = low + 1, 2 * low + 8
    while (n := bad(high)) and high < most:
        low, high, step = high, min(high + step, most), 2 * step
    while not n and high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if bad(middle) else (low, middle)
    k = min(tried, key=lambda k: ((~tried[k][1]).sum(), k))
    own, good = tried[k]
    # where no even layout holds, a piece is added to the span of each that breaks a limit, till it does
    cuts = own[1:][good].tolist()
    todo = [(int(x), int(y), 2) for x, y in zip(own[:-1][~good], own[1:][~good])]
    while todo:
        a, b, k = todo.pop()
        own = np.array([a, *placed(a, b, k), b])
        good = holds(own[:-1], own[1:])
        if len(own) == 2 and not good[0]:  # no target came near a boundary: more of them do
            todo.append((a, b, k + 1))
            continue
        cuts += own[1:][good].tolist()
        todo += [(int(x), int(y), 2) for x, y in zip(own[:-1][~good], own[1:][~good])]
    cuts = [0, *sorted(cuts)]

    def start_of(cut: int, end: int) -> int:
        """Where a piece that is fresh from `cut` begins: `overlap` words earlier, or as many as the limits leave room for."""
        a = max(0, cut - overlap)
        while a < cut and not fits(a, end):
            a += 1
        return a

    return lay, [(start_of(a, b) if a else 0, a, b) for a, b in zip(cuts, cuts[1:])], unit_over


def _splitter(max_words: int, max_pairs: int, overlap: int, with_text: bool):
    names = [c.split()[0] for c in _OUT.split(", ")]

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for seq, memory, text in zip(pdf["seq"], pdf["memory_id"], pdf["text"]):
                lay, pieces, unit_over = lay_out(text, max_words, max_pairs, overlap)
                for i, (a, fresh, b) in enumerate(pieces):
                    begins, ends = (0 if a == 0 else int(lay.cut_at[a])), int(lay.cut_at[b])
                    kind = "end" if b == lay.n else NAMES[max(lay.strength[b], 0)]
                    rows.append((seq, memory, i, len(pieces), begins, ends, 0 if fresh == 0 else int(lay.cut_at[fresh]), int(b - a), int(lay.pairs[b] - lay.pairs[a]), kind, unit_over, text[begins:ends] if with_text else None))
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"memory_id": "Int64"})

    return split


def pieces(records: DataFrame, max_words: int = MAX_WORDS, max_pairs: int = MAX_PAIRS, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """The pieces of every record over the limit, in order.

    Each piece has at most `max_words` words and `max_pairs` pairs, its overlap with the piece before
    included. `begins`, `ends` are character offsets; `fresh_from` is where the text not in the piece
    before begins, so the fresh parts joined in order give the text back. The overlap is `overlap` words, or
    as many as a limit leaves room for. `boundary` is how the piece ends; `unit_over` tells that
    some unit of the record is over a limit, the only reason for a `forced` end.

    Repeated rows (same seq and text) count once. Null, empty and short texts have no pieces; extra columns
    are ignored. A word longer than a piece may be is cut into equal parts.
    """
    long = records.select("seq", "memory_id", "text").where(over_limit(F.col("text"), max_words, max_pairs)).dropDuplicates(["seq", "text"])
    return long.mapInPandas(_splitter(max_words, max_pairs, overlap, with_text), _OUT)


def over_limit_records(records: DataFrame) -> DataFrame:
    """(seq, kind) of the records that were split: `forced` where a unit had to be cut, else `boundary`."""
    p = pieces(records, with_text=False)
    return p.groupBy("seq").agg(F.when(F.max("unit_over"), "forced").otherwise("boundary").alias("kind"))


def covers(records: DataFrame) -> DataFrame:
    """(seq, fresh_chars, last_end, over, unfounded, gaps) per record that was split: what its pieces add up to.

    The fresh parts' characters and where the last piece ends, both the text's length; pieces over a limit, forced
    ends without a unit over a limit, and pieces that don't begin where or before the one before ends: all none.
    """
    p = pieces(records, with_text=False)
    before = p.select("seq", (F.col("piece") + 1).alias("piece"), F.col("ends").alias("before"))
    p = p.join(before, ["seq", "piece"], "left")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return p.groupBy("seq").agg(
        F.sum(F.col("ends") - F.col("fresh_from")).alias("fresh_chars"), F.max("ends").cast("long").alias("last_end"), n((F.col("words") > MAX_WORDS) | (F.col("pairs") > MAX_PAIRS)).alias("over"),
        n((F.col("boundary") == "forced") & ~F.col("unit_over")).alias("unfounded"), n((F.col("fresh_from") != F.col("before")) | (F.col("begins") > F.col("before"))).alias("gaps"),
    )
