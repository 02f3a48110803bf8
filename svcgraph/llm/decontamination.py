"""Operator 6: benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as lower-case words with a space before, between and after them, so an item's borders are
characters like its others: `art` is not in `party`, whatever its length. An item of
m characters may differ by e = floor(error_rate * m) edits; it is split into e + 1 pieces, one of which at
least must stand unchanged in any text within that distance. All pieces of a block of items
form one Aho-Corasick automaton; each whole text runs through it once, and every hit is verified by
Myers' bit-parallel edit distance on the window that the piece's place implies.

The benchmark is a small stated set, but its size is checked: it is read in blocks of at most
`block_chars` characters (a longer item is a block of its own), each block is broadcast alone and
all documents run against each. Only texts with a hit carry further cost.

Defined results: null or empty texts hold nothing; null or wordless items match nothing; a document gets one row for each item
that it holds, with the smallest distance (ties: the first place); repeated rows give repeated rows, and
null ids are kept; an empty benchmark gives no row; columns beyond the named ones are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import append_columns, fresh_names, map_rows, process_table, text_of

WORDS = r"\w+"
HITS = "doc_id long, item_id long, distance long, start long, end long"


def normal(text: str | None) -> str:
    return " ".join(re.findall(WORDS, text_of(text).lower()))


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best place of pattern in text with at most `most` edits, the first on ties."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    plus, minus, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & full
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full  # no carry into row 0: a match may start anywhere
        plus = mh | ~(xv | ph) & full
        minus = ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
            if not score:
                break
    return best


class ItemMatcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float) -> None:
        import ahocorasick

        self.items, self.errors = [], []
        self.automaton = ahocorasick.Automaton()
        pieces: dict[str, list[tuple[int, int]]] = {}
        for key, text in items:
            if not text:
                continue
            e, text = int(error_rate * len(text)), f" {text} "
            k, m = len(self.items), len(text)
            self.items.append((key, text))
            self.errors.append(e)
            cuts = [m * i // (e + 1) for i in range(e + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(text[a:b], []).append((k, a))
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def find(self, text: str) -> dict[int, tuple[int, int, int]]:
        """item number -> (distance, start, end) in the normal text, the best place each."""
        best: dict[int, tuple[int, int, int]] = {}
        if self.empty or not text:
            return best
        inside = lambda low, high: (max(0, low - (text[low] != " ")), min(len(text) - 2, high - 1 - (text[high - 1] == " ")))
        text = f" {text} "
        seen: set[tuple[int, int]] = set()
        for stop, (size, owners) in self.automaton.iter(text):
            at = stop + 1 - size
            for k, a in owners:
                if k in best and best[k][0] == 0:
                    continue
                pattern, e = self.items[k][1], self.errors[k]
                start, m = at - a, len(pattern)
                if (k, start) in seen:
                    continue
                seen.add((k, start))
                if start >= 0 and text.startswith(pattern, start):
                    best[k] = (0, *inside(start, start + m))
                    continue
                if not e:
                    continue
                low = max(0, start - e)
                window = text[low : start + m + e]
                got = myers(pattern, window, e)
                if got and (k not in best or got[0] < best[k][0]):
                    distance, end = got
                    back = myers(pattern[::-1], window[:end][::-1], distance)
                    begin = low + end - (back[1] if back else m)
                    best[k] = (distance, *inside(begin, low + end))
        return best


def _places(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of the normal text as spans of the text itself (code points)."""
    low = text.lower()
    found, at = [], 0
    for m in re.finditer(WORDS, low):
        found.append((at, at + len(m[0]), m.start(), m.end()))
        at += len(m[0]) + 1
    if len(low) != len(text):  # rare: lower case changes the length; map by prefix
        lengths, n = [0], 0
        for c in text:
            n += len(c.lower())
            lengths.append(n)
        import bisect

        back = lambda i: max(0, bisect.bisect_right(lengths, i) - 1)
    else:
        back = lambda i: i
    out = []
    for a, b in spans:
        first = next((x for x in found if x[1] > a), None)
        last = next((x for x in reversed(found) if x[0] < b), None)
        out.append((back(first[2]), back(last[3])) if first and last else (0, 0))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    block, n = [], 0
    for key, text in benchmark.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).toLocalIterator():
        plain = normal(text)
        if block and n + len(plain) > block_chars:
            yield block
            block, n = [], 0
        block.append((key, plain))
        n += len(plain)
    yield block


def _matcher(items: list, error_rate: float) -> ItemMatcher:
    return process_table(("items", tuple(items), error_rate), lambda: ItemMatcher(items, error_rate))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", error_rate: float = 0.05, block_chars: int = 4_000_000) -> DataFrame:
    """HITS for every document and item it holds; start and end are code points of the text."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))

    def one(block: list[tuple[int, str]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def make():
            matcher = _matcher(sent.value, error_rate)

            def fn(keys, rows):
                out = ([], [], [], [], [])
                for key, text in zip(keys, rows, strict=True):
                    found = matcher.find(normal(text))
                    if not found:
                        continue
                    order = sorted(found)
                    for k, (a, b) in zip(order, _places(text, [found[k][1:] for k in order]), strict=True):
                        for column, value in zip(out, (key, matcher.items[k][0], found[k][0], a, b), strict=True):
                            column.append(value)
                return out

            return fn

        return map_rows(texts, make, HITS)

    return reduce(DataFrame.unionAll, [one(block) for block in _blocks(benchmark, item_col, item_text_col, block_chars)])


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", error_rate: float = 0.05, block_chars: int = 4_000_000) -> DataFrame:
    """docs without the rows whose text holds an item; rows are judged where they lie, one pass a block."""
    for block in _blocks(benchmark, item_col, item_text_col, block_chars):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def make(sent=sent):
            matcher = _matcher(sent.value, error_rate)
            return lambda texts: ([bool(matcher.find(normal(t))) for t in texts],)

        docs, leaks = fresh_names(docs, "leaks")
        docs = append_columns(docs, text_col, make, f"{leaks} boolean").where(~F.col(leaks)).drop(leaks)
    return docs


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
