"""Operator 11: runs (maximal repetitions) of words by Kolpakov and Kucherov's algorithm, and texts without what they repeat.

1. A suffix automaton of the words gives their Lempel-Ziv factors: from each factor's start, the longest prefix of what is left that
   occurs earlier, and where it occurred first.
2. Main's algorithm finds, at every border of factors, all runs that cross or touch it and end in the factor behind it: for each
   period, how far the words on both sides agree with those a period away (four Z functions). Such a run starts less than
   2 |previous factor| + |factor| words before the border, so all windows together are linear in the text.
3. Every other run lies inside a factor, and is copied from the factor's earlier occurrence.

A run here is at least `MIN_LENGTH` words and `MIN_EXPONENT` periods long. So the words where one can lie are known before: a run of period q
repeats at least max(3, 3q - 2) successive 3-grams at a distance of q, so in a stretch of c successive 3-grams that have occurred before only those
count that did so at most (c + 2) / 3 words before. Steps 1 to 3 work on the segments that are left, each with a word more on
both sides, so that a run which touches a segment's end is none of the text; a text without such a segment has no run. No text is too long:
time and memory are linear in a segment.

Defined results: a null, empty or blank text has no words and no runs, and an empty text without its repeats; a null id is an id without
a number, whose words the query leaves as they are; repeated rows give a row each; an empty table gives no row; columns beyond the
named two are ignored. Of runs of equal length the one with the smallest start, then period, is the longest one.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, utf8

MIN_LENGTH, MIN_EXPONENT = 6, 4


class SuffixAutomaton:
    """Of a list of integers >= 0; first_end is where a state's strings end first.

    Nearly all states have one transition: it lies in two lists, further ones in a dictionary.
    """

    def __init__(self, line: list[int]) -> None:
        self.letter, self.target, self.more = [-1], [0], {}
        self.first_end = [-1]
        letter, target, more, first_end = self.letter, self.target, self.more, self.first_end
        link, length, last = [-1], [0], 0
        for i, c in enumerate(line):
            new = len(length)
            length.append(length[last] + 1)
            link.append(0)
            letter.append(-1)
            target.append(0)
            first_end.append(i)
            p, known = last, -1
            while p >= 0:
                if letter[p] < 0:
                    letter[p], target[p] = c, new
                elif letter[p] == c:
                    known = target[p]
                    break
                else:
                    others = more.get(p)
                    if others is None:
                        more[p] = {c: new}
                    elif c in others:
                        known = others[c]
                        break
                    else:
                        others[c] = new
                p = link[p]
            last = new
            if known < 0:
                continue
            if length[known] == length[p] + 1:
                link[new] = known
                continue
            copy = len(length)
            length.append(length[p] + 1)
            link.append(link[known])
            letter.append(letter[known])
            target.append(target[known])
            first_end.append(first_end[known])
            if known in more:
                more[copy] = dict(more[known])
            while p >= 0:
                if letter[p] == c:
                    if target[p] != known:
                        break
                    target[p] = copy
                else:
                    others = more.get(p)
                    if others is None or others.get(c) != known:
                        break
                    others[c] = copy
                p = link[p]
            link[known] = link[new] = copy


def lz_factors(line: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, start of the first occurrence; -1 for a new letter) of the factors, which cover the line."""
    automaton = SuffixAutomaton(line)
    letter, target, more, first_end = automaton.letter, automaton.target, automaton.more, automaton.first_end
    out, at, n = [], 0, len(line)
    while at < n:
        state, to = 0, at
        while to < n:
            c = line[to]
            following = target[state] if letter[state] == c else more[state][c]
            if first_end[following] >= to:
                break
            state, to = following, to + 1
        if to == at:
            out.append((at, 1, -1))
            at += 1
        else:
            out.append((at, to - at, first_end[state] - (to - at) + 1))
            at = to
    return out


def z_function(line: list[int]) -> list[int]:
    """For each place, how many words from there agree with the line's first ones."""
    n = len(line)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and line[k] == line[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def crossing_runs(line: list[int], border: int, stop: int, window: int, min_length: int, min_exponent: int):
    """(start, end, period) of the runs with start <= border <= end <= stop whose start lies in the window before the border; a period can be a multiple."""
    low, n = max(0, border - window), len(line)
    u, v = line[low:border], line[border:stop]
    a, b = len(u), len(v)
    back, both = u[::-1], u + v
    # agreement of v with itself, of u's end with the end of u + v[:p], of u's end with that of u[:-p], of v with u[-p:] + v
    ahead, behind = z_function(v), z_function([*back, -1, *both[::-1]])
    before, beyond = z_function(back), z_function([*v, -1, *both])
    for p in range(1, (a + b) // min_exponent + 1):
        found = []
        if p <= b:
            found.append((border - behind[a + 1 + b - p], border + p + (ahead[p] if p < b else 0)))
        if p <= a:
            found.append((border - p - (before[p] if p < a else 0), border + min(b, beyond[b + 1 + a - p])))
        for start, end in found:
            if end - start < min_length or end - start < min_exponent * p:
                continue
            if (start == 0 or line[start - 1] != line[start - 1 + p]) and (end == n or line[end] != line[end - p]):
                yield start, end, p


def runs_of(line: list[int], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of all runs of the line of integers >= 0, by start and period; min_exponent is 2 at least."""
    ends: dict[int, dict[int, int]] = {}  # start -> end -> period

    def add(start: int, end: int, period: int) -> None:
        own = ends.setdefault(start, {})
        if period < own.get(end, period + 1):
            own[end] = period

    before = 0
    for start, length, source in [*lz_factors(line), (len(line), 0, -1)]:
        for run in crossing_runs(line, start, start + length, 2 * before + length, min_length, min_exponent):
            add(*run)
        if length > 1:
            shift = start - source
            for at in range(start + 1, start + length - min_length):
                for end, period in list(ends.get(at - shift, {}).items()):
                    if end + shift < start + length:
                        add(at, end + shift, period)
        before = length
    return sorted(((start, end, period) for start, own in ends.items() for end, period in own.items()), key=lambda r: (r[0], r[2]))


def segments(codes: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int]]:
    """Where runs can lie: disjoint [from, to) that hold every run with a word more on both sides (where there is one)."""
    n = len(codes)
    if n < min_length:
        return []
    if min_length < 6 or min_exponent < 4:
        return [(0, n)]
    with np.errstate(over="ignore"):
        c = codes.astype("u8")
        grams = c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] * np.uint64(0x165667B19E3779F9)
    order = np.argsort(grams, kind="stable")
    again = np.flatnonzero(grams[order[1:]] == grams[order[:-1]])
    if len(again) < 3:
        return []
    at = order[again + 1]
    distance = at - order[again]
    place = np.argsort(at)
    at, distance = at[place], distance[place]
    while len(at) >= 3:
        first = np.flatnonzero(np.concatenate(([True], np.diff(at) != 1)))
        counts = np.diff(first, append=len(at))
        c = np.repeat(counts, counts)
        good = (c >= 3) & (3 * distance <= c + 2)
        if good.all():
            out: list[tuple[int, int]] = []
            for a, c in zip(at[first].tolist(), counts.tolist(), strict=True):
                low, high = max(0, a - (c + 2) // 3 - 1), min(n, a + c + 3)
                while out and low < out[-1][1]:
                    low = min(low, out.pop()[0])
                out.append((low, high))
            return out
        at, distance = at[good], distance[good]
    return []


def runs_of_words(words: list, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of the words, by start and period."""
    known: dict = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), "i8", len(words))
    found = []
    for low, high in segments(codes, min_length, min_exponent):
        for start, end, period in runs_of(codes[low:high].tolist(), min_length, min_exponent):
            # at a cut end the run goes on outside, so another segment has it whole
            if (start > 0 or low == 0) and (end < high - low or high == len(words)):
                found.append((low + start, low + end, period))
    return found


def without_repeats(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words less those that any run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, end, period in runs:
        keep[start + period : end] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


RESULT = "doc_id long, n_words long, n_runs long, start long, length long, period long, runs string, collapsed string"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, alter: Callable[[object, list], list] | None = None) -> DataFrame:
    """RESULT for each row: the longest run, all runs as lines start,length,period, and the words without repeats, joined by spaces.

    alter, if given, makes the words to look at from a row's id and words.
    """

    def make():
        def fn(keys, texts):
            out = ([], [], [], [], [], [], [], [])
            for key, text in zip(keys, texts, strict=True):
                words = utf8(text).split()
                if alter is not None:
                    words = alter(key, words)
                runs = runs_of_words(words, min_length, min_exponent)
                best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
                row = (
                    key, len(words), len(runs), *((best[0], best[1] - best[0], best[2]) if best else (None, None, None)),
                    "".join([f"{s},{e - s},{p}\n" for s, e, p in runs]), b" ".join(without_repeats(words, runs)).decode("utf-8", "replace"),
                )
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out

        return fn

    return map_rows(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), make, RESULT)


def planted(key: int | None, words: list) -> list:
    """The query's words: every tenth id's, by a hash, go on periodically from some word."""
    n = len(words)
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), alter=planted)
    exponent = F.expr("1000 * length DIV period").alias("exponent_milli")
    return found.select("doc_id", "n_runs", "start", "length", "period", exponent, F.sha2(F.col("runs").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
