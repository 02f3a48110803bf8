"""Operators 11 to 13 against brute force: small fixtures with nulls, empty and long texts, ties, repeated rows, clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from svcgraph.llm import fingerprints, periodic_runs, resampling

DOCS = "doc_id long, text string, lang string, words string, row long, part int, weight double"


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, "s", None, 1, 0.5) for i, t in zip(ids, texts, strict=True)], DOCS)


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


# --- runs ------------------------------------------------------------------------------------


def all_runs(line, min_length, min_exponent):
    """By definition: for each period, the longest stretches in which words that far apart are identical."""
    found = {}
    for q in range(1, len(line) // 2 + 1):
        i = 0
        while i + q < len(line):
            j = i
            while j + q < len(line) and line[j] == line[j + q]:
                j += 1
            if j - i + q >= max(min_length, min_exponent * q):
                found.setdefault((i, j + q), q)
            i = max(i, j) + 1
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=6), st.integers(1, 9)), max_size=5), st.sampled_from([(6, 4), (2, 2), (4, 3)]))
def test_runs_by_definition(blocks, least):
    line = [x for block, times in blocks for x in block * times]
    assert periodic_runs.runs_of(line, *least) == all_runs(line, *least)
    assert periodic_runs.runs_of_words(line, *least) == all_runs(line, *least)


def test_factors_have_their_sources():
    line = [random.Random(3).randrange(3) for _ in range(400)]
    factors = periodic_runs.lz_factors(line)
    assert [s for s, _, _ in factors] == [sum(n for _, n, _ in factors[:i]) for i in range(len(factors))]
    for start, length, source in factors:
        if source < 0:
            assert length == 1 and line[start] not in line[:start]
        else:
            assert source < start and line[source : source + length] == line[start : start + length]
            longer = line[start : start + length + 1]
            assert start + length == len(line) or all(line[i : i + length + 1] != longer for i in range(start))


def digests(key, text):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = all_runs(w, 6, 4)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    best = max(runs, key=lambda r: (r[1] - r[0], -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (key, len(runs), *((best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4), hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_of_documents(spark, tmp_path):
    tenth = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    texts = [None, "", " \n\t ", "a a a a a a b", "x y " * 4, "A a A a A a A a", "no-break space " * 6, "é 　 " * 7, words(1, 3000), "r s t " * 900, *[words(i, 60, 4) for i in tenth], "a a a a a a b", "b b b b b b c c c c c c"]
    ids = [1, 2, 3, 4, 5, 6, None, 7, 8, 9, *tenth, 4, 10]
    docs(spark, texts, ids).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, periodic_runs.op11_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((digests(k, t) for k, t in zip(ids, texts, strict=True)), key=repr)
    assert periodic_runs.periodic_runs(docs(spark, [])).count() == 0
    one = periodic_runs.periodic_runs(docs(spark, ["b b b b b b c c c c c c d"])).first()
    assert (one.n_runs, one.start, one.collapsed) == (2, 0, "b c d")  # equally long: the first one


def test_a_very_long_periodic_text_is_linear(spark):
    block = words(5, 500).split()
    text = " ".join(block * 400)
    one = periodic_runs.periodic_runs(docs(spark, [text])).first()
    assert (one.start, one.length, one.collapsed.split()) == (0, 200_000, block[: one.period])


# --- importance resampling -----------------------------------------------------------------------


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def buckets(text):
    w = plain(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def resampled(rows, target):
    s, t = Counter(b for _, x in rows for b in buckets(x)), Counter(b for x in target for b in buckets(x))
    all_s, all_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    out = []
    for key, text in rows:
        weight = sum(map(gain, buckets(text)))
        h = None if key is None else int(hashlib.sha256(f"42:{key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(buckets(text)), weight, None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    may = sorted((r for r, (_, x) in zip(out, rows, strict=True) if len(plain(x)) >= 20 and r[3] is not None), key=lambda r: (-r[3], r[0]))
    for place, r in enumerate(may[: 5 * len(may) // 100], 1):
        r[4] = place
    return sorted(map(tuple, out), key=repr)


def test_resampling(spark, tmp_path):
    texts = [None, "", "...", "Ünï É K ſtraße naïve", "a", "B c", "x-y_Z 12", words(2, 5000), words(9, 20), words(9, 19), *[words(i, 30, 50) for i in range(200)], words(9, 20), words(2, 5000)]
    ids = [1, None, 2, 3, 4, 5, 6, 7, 8, None, *range(1000, 1200), 8, None]
    target = [None, "", words(77, 40, 50), "w1 w2 w3", "É"]
    docs(spark, texts, ids).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, resampling.op12_importance_resampling(spark, str(tmp_path)).collect()), key=repr)
    assert got == resampled(list(zip(ids, texts, strict=True)), target)
    assert sum(r[4] is not None for r in got) == 10
    empty = docs(spark, [])
    assert resampling.resample(empty, empty).count() == 0


def test_resampling_ranks_over_many_partitions(spark):
    scored = spark.range(5000).select(F.col("id").alias("row"), (F.col("id") % 1000).alias("doc_id"), F.lit(20).cast("long").alias("n_words"), F.pmod(F.xxhash64("id"), F.lit(7)).alias("score"))
    got = resampling.ranked(scored.repartition(7), percent=50).collect()
    want = sorted((-r.score, r.doc_id, r.row) for r in got)[:2500]
    drawn = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, 2501)) and [(-r.score, r.doc_id, r.row) for r in drawn] == want


# --- fingerprints ----------------------------------------------------------------------------------


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_with_neighbours(spark):
    base = words(4, 2000).split()
    texts = [None, "", "  ", "a b", "A  B", "é　x 😀 y z w v", *[" ".join(base[: 100 * i]) for i in range(1, 20)], words(6, 20000), words(6, 20000), words(8, 9)]
    ids = [9, None, -5, *range(100, 100 + len(texts) - 6), 50, 50, 50]
    df = docs(spark, texts, ids).repartition(3)
    got = fingerprints.with_neighbours(df, part_bytes=3000).collect()
    assert len(got) == len(texts)
    order = sorted(zip(ids, [t or "" for t in texts], strict=True), key=lambda x: (x[0] is not None, x[0] or 0))
    by_text = {}
    pairs = list(zip(order, order[1:] + order[:1], strict=True))
    for (key, text), (_, following) in pairs:
        if key == 50 or following in (texts[-1], texts[-2]):
            continue  # equal ids lie in the order of their hashes
        changed = fingerprints.edited(text, following)
        row = next(r for r in got if r.doc_id == key)
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert abs(row.near_edited - similarity(text, changed)) < 0.12 and abs(row.near_next - similarity(text, following)) < 0.12
        by_text.setdefault(frozenset(shingles(text)), set()).add(row.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    plain_rows = fingerprints.fingerprints(df).collect()
    assert sorted((r.doc_id or 0, r.fingerprint) for r in plain_rows) == sorted((r.doc_id or 0, r.fingerprint) for r in got)
    alone = fingerprints.with_neighbours(docs(spark, ["a b c d e f g h"])).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"a b c d e f a b").hexdigest()
    assert fingerprints.with_neighbours(docs(spark, [])).count() == 0


def test_equal_rows_over_many_parts(spark):
    got = fingerprints.with_neighbours(docs(spark, ["one two three four five six"] * 300, [7] * 300), part_bytes=100).collect()
    assert len(got) == 300 and all(r.near_next == 1.0 for r in got)


def test_likeness_is_unbiased():
    made, r = fingerprints.Fingerprinter(), random.Random(2)
    for share in (0.0, 0.3, 0.75, 0.95):
        errors = []
        for _ in range(60):
            common, own = int(600 * share), 600 - int(600 * share)
            a, b = ({r.getrandbits(64) for _ in range(own)} for _ in range(2))
            both = {r.getrandbits(64) for _ in range(common)}
            prints = [made.packed(np.array(sorted(x | both), "u8")) for x in (a, b)]
            errors.append(fingerprints.likeness(*prints) - len(both) / (len(a) + len(b) + len(both)))
        assert abs(sum(errors) / 60) < 0.015 and max(map(abs, errors)) < 0.12


def test_densification_fills_every_bin_alike():
    made = fingerprints.Fingerprinter()
    few = np.array(sorted(random.Random(1).getrandbits(64) for _ in range(3)), "u8")
    minima = made.minima(few)
    assert len(minima) == fingerprints.BINS and set(minima.tolist()) == set(few.tolist())
    filled = {int(x) >> 55 for x in few}
    for i in range(fingerprints.BINS):  # the first filled bin in the bin's own order
        source = i if i in filled else next(int(j) for j in made.asked[:, i] if int(j) in filled)
        assert int(minima[i]) >> 55 == source
