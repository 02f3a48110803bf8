"""Operator 8: exact n-gram Jaccard join by PartEnum signatures, and its connected groups.

A document's features are its distinct 5-word shingles (64-bit hashes). Sizes fall into bands
[x, 4x/3]; sets within 3:4 of each other share a scheme, as each takes part in its own band's scheme and in
that of the band below. A scheme splits the feature domain into n1 partitions of `PARTS` parts each and
enumerates the subsets of PARTS - 1 parts of every partition: the hash of what a set has in such a
subset is a signature. Sets of a and b features with a Jaccard similarity of 3/4 or more differ in k = (a + b) / 7
features at most, so some partition has one difference or none and they agree in one of its subsets.
How many signatures a set shares with any such partner at least (its need) follows from its own filled parts (`need_of`). Where
hashing leaves that below one, each feature is a partition of its own, which always suffices. Sets of
fewer than `SMALL` features have a scheme for each pair of sizes, where the need is the exact overlap.

Steps, all shuffled by Spark:
1. one pass over the texts gives each document's size and set hash; equal sets are one vertex, the smallest id;
2. a second pass, over one document of each set, emits signatures, packed in binary columns for ranges of
   signatures; a range's task keeps those that two sets have, with the number of sets. A signature that is
   frequent already within one task's batch goes to salted ranges and leaves a mark in its own;
3. a set with fewer surviving signatures than it needs goes. Of the `got` signatures left it keeps the got - need + 1 rarest:
   two similar sets share one of these, as they share need of them (exact; frequent passages drop out of the buckets);
4. every bucket links its members to one pivot as candidates (as many as members, never all pairs), verified on whole
   feature sets that stream past the pivot; hot pivots are salted;
5. buckets whose members are still in different groups are compared exactly: small ones many to a task. Members of larger ones are dealt
   anew into buckets by pair of size bands and rare feature (`_refined`), which what a family has in common is not; those that are still
   large are compared in blocks of bounded rows and features. Buckets of the same members are compared once. A task gives only links that join groups.

Signatures are cut to 24 bits within their range and told apart by scheme; a false agreement within a scheme keeps a set or puts it into a
bucket where it needn't be, which only costs verifications.

Defined results: null, empty and wordless texts have no features, are linked with nothing and are
their own group; under five words the whole sequence is one feature; rows with a null id have
a size but a null group and link nothing; a repeated id is one vertex with all its sets;
an empty table gives no row; columns beyond the named two are ignored; texts of any length are hashed whole,
in slices of bounded size.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _pieces, arrow_schema, fresh_names, give_back, map_rows, materialize, may_hold, process_table, utf8

WORDS = 5
#: First-level partitions for each unit of a band's lower end, and parts of each; more cost space and prune candidates better.
SPREAD, PARTS = 0.28, 3
#: Sets with fewer features have a scheme for each pair of sizes.
SMALL = 19
#: Signatures that one task of step 2 gets, about, and sets that one salt of a hot signature gets.
RANGE, HOT_SETS = 400_000, 500_000
#: Stands for the hot signature's sets in its own range; no document's id there.
MARK = -(1 << 63)
HOT = (1 << 31) - 1
#: Stands for the number of sets in the rows that say how many signatures a set needs in a scheme.
NEEDS = -2

U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (two rounds of multiply and shift)."""
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(29))) * U(0xA0761D6478BD642F)
    return h ^ (h >> U(32))


def band_starts(upto: int) -> list[int]:
    starts = [SMALL]
    while starts[-1] <= upto:
        starts.append(4 * starts[-1] // 3 + 1)
    return starts


_STARTS = band_starts(1 << 40)


class Shingler:
    """Sorted distinct feature hashes of whole texts, hashed many texts at once.

    A word's hash is the sum of a random 64-bit value for each byte times a power of an odd base, modulo 2^64.
    """

    BASE = 0x9E3779B97F4A7C15
    FACTORS = [pow(0xC2B2AE3D27D4EB4F, k, 1 << 64) for k in range(1, WORDS + 1)]
    #: Bytes hashed at once; a longer word makes its slice longer.
    SLICE = 1 << 18
    #: Bytes of texts (one text at least) whose shingles are hashed at once.
    AT_ONCE = 1 << 21

    def __init__(self) -> None:
        self.bytes = np.random.Generator(np.random.PCG64(8)).integers(1, 1 << 63, 256, "u8") * U(2) + U(1)
        self.bytes[[32, *range(9, 14)]] = 0  # white space adds nothing
        self.space = self.bytes == 0
        self.up = self.down = np.ones(1, U)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = (np.multiply.accumulate(np.concatenate((np.ones(1, U), np.full(n - 1, base, U)))) for base in (self.BASE, pow(self.BASE, -1, 1 << 64)))

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where the words of the (lower-case) bytes start, and their hashes."""
        every = np.frombuffer(data, "u1")
        starts, hashes, low = [], [], 0
        while low < len(every):
            high = low + self.SLICE
            while high < len(every) and not self.space[every[high]]:
                gap = np.flatnonzero(self.space[every[high : high + self.SLICE]])
                high += int(gap[0]) if len(gap) else self.SLICE
            part = every[low:high]
            self._powers(len(part))
            blank = self.space[part]
            first = ~blank
            first[1:] &= blank[:-1]
            at = np.flatnonzero(first)
            if len(at):
                sums = np.add.reduceat(self.bytes[part] * self.up[: len(part)], at)
                hashes.append(_mix(sums * self.down[at]))
                starts.append(at + low)
            low = high
        return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.zeros(0, "i8"), np.zeros(0, U))

    def features(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text its features, in ascending order."""
        raw = [utf8(t) for t in texts]
        if len(raw) > 1 and sum(map(len, raw)) > self.AT_ONCE:
            half = len(texts) // 2
            return self.features(texts[:half]) + self.features(texts[half:])
        with np.errstate(over="ignore"):
            starts, h = self.words(b" ".join(raw).lower())
            ends = np.cumsum([len(x) + 1 for x in raw])
            after = np.searchsorted(starts, ends).tolist()
            grams = np.zeros(0, U)
            if len(h) >= WORDS:
                grams = h[: len(h) - WORDS + 1] * U(self.FACTORS[0])
                for k in range(1, WORDS):
                    grams += h[k : len(h) - WORDS + 1 + k] * U(self.FACTORS[k])
                grams = _mix(grams)
            out = []
            for a, b in zip([0, *after], after, strict=False):
                if b - a >= WORDS:
                    out.append(np.unique(grams[a : b - WORDS + 1]))
                elif b > a:
                    out.append(_mix(np.array([sum(int(x) * f for x, f in zip(h[a:b], self.FACTORS, strict=False)) * 0x2545F4914F6CDD1D + b - a & (1 << 64) - 1], U)))
                else:
                    out.append(grams[:0])
        return out


# --- schemes: an even number for the smaller side (or the lower band), the next odd one for the other -----

_BANDS = 4096  # numbers below belong to pairs of small sizes


def need_of(filled: np.ndarray, most: int) -> int:
    """The least number of common signatures with a set that differs in at most `most` features.

    filled: for each partition the number of its parts that hold something. A partition with one filled part has
    PARTS - 1 signatures with content, all of which one difference can spoil; others have PARTS, of which
    the first difference spoils PARTS - 1 and a second one the last.
    """
    any_, two = int(np.count_nonzero(filled)), int(np.count_nonzero(filled > 1))
    total = (PARTS - 1) * any_ + two
    first = min(most, any_)
    return total - (PARTS - 1) * first - min(most - first, two)


def _atoms(features: np.ndarray, scheme: int) -> np.ndarray:
    return _mix(features + U((scheme | 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1))


def signatures(features: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(scheme, needed common signatures, signatures) of a set."""
    out, n = [], len(features)
    with np.errstate(over="ignore"):
        for small in range(-(-3 * n // 4), min(4 * n // 3, SMALL - 1) + 1):
            # pairs of the sizes (n, larger) and (small, n)
            for a, b, side in ((n, small, 0),) if small >= n else ((small, n, 1),):
                need = -(-3 * (a + b) // 7)
                if need <= a and not (a == b and need == a):
                    out.append((2 * (64 * a + b) + side, need, _atoms(features, 2 * (64 * a + b))))
        if n < SMALL:
            for b in range(SMALL, 4 * n // 3 + 1):
                out.append((2 * (64 * n + b), -(-3 * (n + b) // 7), _atoms(features, 2 * (64 * n + b))))
            return out
        j = bisect.bisect_right(_STARTS, n) - 1
        for band, side, most in ((j, 0, (n + 4 * n // 3) // 7), (j - 1, 1, (n + _STARTS[j] - 1) // 7)):
            if band < 0:
                continue
            n1 = max(2, round(SPREAD * _STARTS[band]))
            scheme = _BANDS + 4 * band + side
            part = ((features >> U(32)) * U(PARTS * n1) >> U(32)).astype("i8")  # in order, as the features are
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            content = np.zeros(PARTS * n1, U)
            content[part[first]] = np.add.reduceat(_mix(features ^ U(0x5851F42D4C957F2D)), first) * np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], U)[part[first] % PARTS]
            full = np.zeros(PARTS * n1, "i8")
            full[part[first]] = 1
            content, full = content.reshape(n1, PARTS), full.reshape(n1, PARTS)
            filled = full.sum(1)
            # the subset without part s holds the partition's sum less what s has
            held = (filled[:, None] > full).ravel()
            subsets = (content.sum(1, dtype=U)[:, None] - content).ravel()
            ids = np.flatnonzero(held).astype(U)
            need = need_of(filled, most)
            out.append((scheme, max(1, need), _mix(subsets[held] + ids * U(0x9E3779B97F4A7C15) + U((_BANDS + 4 * band) * 0x632BE59BD9B4E019 & (1 << 64) - 1))))
            if need < 1:
                out.append((scheme + 2, -(-3 * n // 4), _atoms(features, _BANDS + 4 * band + 2)))
    return out


def _sets(docs: DataFrame) -> DataFrame:
    """Step 1: doc_id, n, and a 128-bit hash of the set."""

    def make():
        shingler = process_table("shingler", Shingler)

        def fn(keys, texts):
            sets = shingler.features(texts)
            signed = lambda x: x - (x >> 63 << 64)
            with np.errstate(over="ignore"):
                return keys, [len(f) for f in sets], [signed(int(np.sum(f, dtype=U))) for f in sets], [signed(int(np.sum(f * f, dtype=U))) for f in sets]

        return fn

    return map_rows(docs, make, "doc_id long, n long, h1 long, h2 long")


#: An entry of a plain block: 4 bytes of signature, 8 of id, 2 of need, 2 of scheme. One of a needs' block: 8 of id, 2 of need, 2 of scheme.
ENTRY, NEEDS_ENTRY = 16, 12
#: Bits of a signature that are kept within its range, which has about `RANGE` of them however large the input is.
KEPT_BITS = 24


def _planes(*columns: np.ndarray) -> bytes:
    """The columns as planes of single bytes: the high bytes of small or ascending numbers cost next to nothing once compressed."""
    return b"".join(x.view("u1").reshape(len(x), -1).T.tobytes() for x in columns)


def _column(raw: np.ndarray, n: int, low: int, size: int, kind: str) -> np.ndarray:
    """The column of `size` bytes that begins with plane `low`, of n entries."""
    return np.ascontiguousarray(raw[low * n : (low + size) * n].reshape(size, n).T).view(kind)[:, 0]


def _packed(sig: np.ndarray, doc: np.ndarray, scheme: np.ndarray, bits: int) -> bytes:
    """A block: how many bytes a signature has, the signatures' low bits, and planes of the ids' gaps and the schemes."""
    width = -(-bits // 8)
    low = (sig & U((1 << bits) - 1)).astype("<u4").view("u1").reshape(-1, 4)[:, :width]
    return bytes([width]) + low.tobytes() + _planes(np.diff(doc, prepend=0), scheme)


def _unpacked(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width, raw = int(raw[0]), raw[1:]
    n = len(raw) // (width + 10)
    low = np.zeros((n, 4), "u1")
    low[:, :width] = raw[: width * n].reshape(n, width)
    return low.view("<u4")[:, 0], np.cumsum(_column(raw, n, width, 8, "<i8")), _column(raw, n, width + 8, 2, "<u2")


def _signature_blocks(docs: DataFrame, ranges: int, salts: int, bits: int = KEPT_BITS) -> DataFrame:
    """Step 2, map side: r and packed blocks of the signatures in that range, several thousand sets a block.

    r >= ranges are salted ranges: ranges * (1 + salt) + r holds a salt's share of signatures that are hot in r.
    Of a signature its range and its low `bits` (32 at most) bits are kept. What sets need goes once a set and scheme, in
    blocks of their own with r < 0, and not with each signature.
    """
    import pyarrow as pa

    schema = "r long, packed binary"

    def run(batches):
        out, shingler = arrow_schema(schema), process_table("shingler", Shingler)
        gathered: list[tuple[np.ndarray, ...]] = []
        size = sets = 0

        def flush():
            sig = np.concatenate([g[0] for g in gathered])
            doc, scheme = (np.repeat(np.array([g[k] for g in gathered], t), [len(g[0]) for g in gathered]) for k, t in ((1, "i8"), (3, "u2")))
            r = ((sig >> U(32)) * U(ranges) >> U(32)).astype("i8")
            line = np.sort(sig)
            run_ends = np.flatnonzero(np.concatenate((line[1:] != line[:-1], [True])))
            often = np.diff(run_ends, prepend=-1) >= max(8, sets // 64)
            if often.any():
                hot = line[run_ends[often]]
                at = np.minimum(np.searchsorted(hot, sig), len(hot) - 1)
                is_hot = hot[at] == sig
                one = np.full((2, len(hot)), -1)  # an entry of either side for each hot signature, for its marks
                one[(scheme & 1)[is_hot], at[is_hot]] = np.flatnonzero(is_hot)
                one = one[one >= 0]
                mark = [x[one] for x in (sig, doc, scheme, r)]
                mark[1] = np.full(len(one), MARK, "i8")
                r = np.where(is_hot, r + ranges * (1 + (_mix(doc.view(U)) % U(salts)).astype("i8")), r)
                sig, doc, scheme, r = (np.concatenate(x) for x in zip((sig, doc, scheme, r), mark, strict=True))
            order = np.argsort(r.astype("u2") if r.max() < 1 << 16 else r, kind="stable")
            sig, doc, scheme, r = sig[order], doc[order], scheme[order], r[order]
            first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            blocks = [_packed(sig[a:b], doc[a:b], scheme[a:b], bits) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(r)], strict=True)]
            needs = [np.array([g[k] for g in gathered], t) for k, t in ((1, "i8"), (2, "u2"), (3, "u2"))]
            own = -1 - int(_mix(needs[0][:1].view(U))[0] % U(ranges))
            return pa.RecordBatch.from_arrays([pa.array([*r[first].tolist(), own], pa.int64()), pa.array([*blocks, _planes(*needs)], pa.binary())], schema=out)

        for whole in batches:
            for b in _pieces(whole):
                for key, f in zip(b.column(0).to_pylist(), shingler.features(b.column(1).to_pylist()), strict=True):
                    if key is None or not len(f):
                        continue
                    for scheme, need, sig in signatures(f):
                        gathered.append((sig, key, min(need, 65535), scheme))
                        size += len(sig)
                    sets += 1
                    if size > 500_000:
                        yield flush()
                        gathered, size, sets = [], 0, 0
                        give_back()
        if size:
            yield flush()
        gathered.clear()
        give_back()

    return docs.mapInArrow(run, schema)


def _survivors(blocks: DataFrame, ranges: int) -> DataFrame:
    """Step 2, reduce side: signatures that several sets have, and in how many (HOT for hot ones). Blocks are packed, or plain ones.

    A signature counts within its scheme (both sides of one): what agrees in the kept bits but belongs to another scheme is another signature.
    Two sets of the upper band meet in the scheme of their own, and two of equal size in that of their size, so a
    signature needs the other side too. Only a hot one's own range sees both sides: it names (freq -1) those without.
    What a set needs in a scheme is passed on in rows of its own (freq NEEDS, no document's id in doc but in sig).
    """
    import pyarrow as pa

    schema = "sig long, scheme int, doc long, need int, freq int"

    def fn(table: pa.Table) -> pa.Table:
        out = arrow_schema(schema)
        r = table.column("r")[0].as_py()
        plain = "block" in table.column_names
        raws = [np.frombuffer(x.as_buffer(), "u1") for x in table.column("block" if plain else "packed")]
        if r < 0:
            doc, need, scheme = (np.concatenate([_column(raw, len(raw) // NEEDS_ENTRY, *place) for raw in raws]) for place in ((0, 8, "<i8"), (8, 2, "<u2"), (10, 2, "<u2")))
            cols = (doc, scheme.astype("i4"), np.full(len(doc), MARK), need.astype("i4"), np.full(len(doc), NEEDS, "i4"))
            return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(cols, out.types, strict=True)], schema=out)
        if plain:
            parts = [(raw[: len(raw) // 4].view("<u4"), *(_column(raw, len(raw) // ENTRY, *place) for place in ((4, 8, "<i8"), (14, 2, "<u2")))) for raw in raws]
        else:
            parts = [_unpacked(raw) for raw in raws]
        sig, doc, scheme = (np.concatenate(x) for x in zip(*parts, strict=True))
        sig = sig.astype(U)
        sig = sig << U(16) | (scheme >> 1)  # a scheme's two sides are one scheme
        order = np.argsort(sig, kind="stable")
        sig = sig[order]
        same = sig[1:] == sig[:-1]
        if r >= ranges:
            count = np.full(len(sig), HOT)
            keep = np.ones(len(sig), bool)
            doc, scheme = doc[order], scheme[order]
        else:
            shared = np.concatenate((same, [False])) | np.concatenate(([False], same)) | (doc[order] == MARK)
            order, sig = order[shared], sig[shared]
            doc, scheme = doc[order], scheme[order]
            first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))) if len(sig) else np.zeros(0, "i8")
            size = np.diff(np.append(first, len(sig)))
            if len(sig):
                odd = scheme & 1
                one, two = np.minimum.reduceat(odd, first) == 0, np.maximum.reduceat(odd, first) == 1
                pair = scheme[first] >> 1
                unlike = (scheme[first] < _BANDS) & (pair // 64 != pair % 64)
                hot = np.maximum.reduceat((doc == MARK).astype("u1"), first) == 1
                ok = (hot | (size > 1)) & one & (two | ~unlike)
                count = np.repeat(np.where(~hot, np.minimum(size, HOT - 1), np.where(ok, HOT, -1)), size)
                last = np.zeros(len(sig), bool)
                last[first + size - 1] = True
                keep = np.where(count < 0, last, np.repeat(ok, size) & (doc != MARK))
            else:
                count, keep = np.zeros(0, "i8"), np.zeros(0, bool)
        full = (sig >> U(16) | U(r % ranges) << U(32)).view("i8")
        cols = (full[keep], scheme[keep].astype("i4"), doc[keep], np.full(int(keep.sum()), 65535), count[keep].astype("i4"))
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(cols, out.types, strict=True)], schema=out)

    return blocks.groupBy("r").applyInArrow(fn, schema)


def _rarest(found: DataFrame) -> DataFrame:
    """Step 3: sig, doc, with the got - need + 1 rarest signatures of each set that has its need."""
    pair = F.shiftright("scheme", 1).alias("pair")
    dead = found.where("freq = -1").select("sig", pair).distinct()
    hot = found.where(F.col("freq") == HOT).select("*", pair).join(dead, ["sig", "pair"], "left_anti").select(*found.columns)
    needs = found.where(F.col("freq") == NEEDS).withColumn("doc", F.col("sig"))
    found = found.where(F.col("freq").between(0, HOT - 1)).unionAll(hot).unionAll(needs)
    # rows of needs come first in the order and don't count
    own, is_sig = Window.partitionBy("doc", "scheme"), (F.col("freq") >= 0).cast("int")
    line = own.orderBy("freq", "sig").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = found.withColumn("got", F.sum(is_sig).over(own)).withColumn("need", F.min("need").over(own)).withColumn("k", F.sum(is_sig).over(line))
    return counted.where("freq >= 0 AND got >= need AND k <= got - need + 1").select("sig", "doc")


def _features(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, f: whole feature sets of the documents with an _id in ids, written once."""

    def make():
        shingler = process_table("shingler", Shingler)
        return lambda keys, texts: (keys, [f.tobytes() for f in shingler.features(texts)])

    # Most documents are in no bucket: a bitmap lets them go before the rest is shuffled to the ids.
    some = may_hold(docs, "doc_id", ids.select("_id")).where("may").drop("may").join(ids.select("_id").distinct(), F.col("doc_id") == F.col("_id"), "left_semi")
    return materialize(map_rows(some, make, "doc_id long, f binary"), "features")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """100 * intersection >= 75 * union, of ascending arrays of distinct hashes."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 4 * len(x) < 3 * len(y):
        return False
    common = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
    return 100 * common >= 75 * (len(x) + len(y) - common)


def _verified(features: DataFrame, pairs: DataFrame, share: int = 2000) -> DataFrame:
    """Those of the distinct pairs (a, b) that are similar. A pivot a meets its partners in turns of about `share`."""
    import pyarrow as pa

    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / share).cast("int").alias("salts"))
    sets = features.select(F.col("doc_id").alias("d"), "f")
    pivots = salts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).join(sets, F.col("a") == F.col("d")).select("a", "salt", F.lit(None).cast("long").alias("b"), "f")
    members = pairs.join(salts, "a").join(sets, F.col("b") == F.col("d")).select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b", "f")
    dealt = pivots.unionAll(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    schema = "a long, b long"

    def run(batches):
        out, now, held = arrow_schema(schema), None, []
        for whole in batches:
            for batch in _pieces(whole):
                links = ([], [])
                for a, salt, b, f in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                    if (a, salt) != now:
                        now, held = (a, salt), []
                    f = np.frombuffer(f.as_buffer(), U)
                    if b is None:
                        held.append(f.copy())
                    elif any(similar(x, f) for x in held):
                        links[0].append(a)
                        links[1].append(b)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(links, out.types, strict=True)], schema=out)

    return materialize(dealt.mapInArrow(run, schema), "links")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all sets of left with all of right, over columns for features on both sides."""
    every = [np.concatenate(x) if x else np.zeros(0, U) for x in (left, right)]
    shared = np.intersect1d(np.unique(every[0]), np.unique(every[1]), assume_unique=True)
    counts = np.zeros((len(left), len(right)), "f4")
    rows = [np.repeat(np.arange(len(x)), [len(f) for f in x]) for x in (left, right)]
    at = [np.searchsorted(shared, e) for e in every]
    ok = [(a < len(shared)) & (shared[np.minimum(a, len(shared) - 1)] == e) if len(shared) else np.zeros(len(e), bool) for a, e in zip(at, every, strict=True)]
    at, rows = [a[k] for a, k in zip(at, ok, strict=True)], [r[k] for r, k in zip(rows, ok, strict=True)]
    step = 2048
    for low in range(0, len(shared), step):
        sides = []
        for a, r, n in zip(at, rows, counts.shape, strict=True):
            inside = (a >= low) & (a < low + step)
            m = np.zeros((n, step), "f4")
            m[r[inside], a[inside] - low] = 1
            sides.append(m)
        counts += sides[0] @ sides[1].T
    return counts


def links_between(docs: tuple[list[int], list[int]], groups: tuple[np.ndarray, np.ndarray], sets: tuple[list[np.ndarray], list[np.ndarray]], rows: int = 256) -> list[tuple[int, int]]:
    """Of the similar pairs of a left and a right document those that join groups; so many rows of the left at a time."""
    links, root = [], {}
    sizes = [np.array([len(x) for x in s], "i8") for s in sets]

    def top(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    for low in range(0, len(sets[0]), rows):
        part = slice(low, low + rows)
        common = common_counts(sets[0][part], sets[1]).astype("i8")
        union = sizes[0][part, None] + sizes[1][None, :] - common
        found = np.argwhere((100 * common >= 75 * union) & (groups[0][part, None] != groups[1][None, :]))
        for x, y in found.tolist():
            p, q = top(int(groups[0][low + x])), top(int(groups[1][y]))
            if p != q:  # a link that joins two groups; others add nothing to components
                root[q] = p
                links.append((docs[0][low + x], docs[1][y]))
    return links


def size_bands(upto: int) -> list[int]:
    """Where bands of sizes start: single sizes first, then bands a sixteenth wide."""
    starts = [1]
    while starts[-1] <= upto:
        starts.append(starts[-1] + max(1, starts[-1] // 16))
    return starts


_SIZES = size_bands(1 << 40)


def prefixes(n: int) -> list[tuple[int, int, int, int]]:
    """(lower band, upper band, prefix, side) for every band of sizes that a similar partner of n features can have; side: 1 lower, 2 upper, 3 both.

    Sets of n and b features share 3 (n + b) / 7 of them at least to be similar. So of the features of both, in one order for all, the
    first n - that + 1 of the one and b - that + 1 of the other have one in common; b is at least its band's start.
    """
    own = bisect.bisect_right(_SIZES, n) - 1
    out = []
    for other in range(bisect.bisect_right(_SIZES, -(-3 * n // 4)) - 1, bisect.bisect_right(_SIZES, 4 * n // 3)):
        length = n - max(-(-3 * (n + _SIZES[other]) // 7), -(-3 * n // 4)) + 1
        if length > 0:
            out.append((min(own, other), max(own, other), length, 3 if own == other else 1 if own < other else 2))
    return out


def _refined(features: DataFrame, ids: DataFrame) -> DataFrame:
    """sig, doc: buckets by rare features of the sets with a doc in ids; two similar sets of theirs share one.

    A set's features are ordered by the number of sets that have them, so what a family has in common comes last and
    is in no prefix, however many its members are.
    """
    import pyarrow as pa

    some = features.join(ids.distinct(), F.col("doc_id") == F.col("doc"), "left_semi")
    schema = "doc long, s long, n long, x long"

    def explode(batches):
        out = arrow_schema(schema)
        for whole in batches:
            for b in _pieces(whole):
                sets = [np.frombuffer(f.as_buffer(), "i8") for f in b.column(2)]
                sizes = np.array([len(f) for f in sets], "i8")
                many = [np.repeat(np.array(b.column(k).to_pylist(), "i8"), sizes) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((*many, np.repeat(sizes, sizes), np.concatenate([*sets, np.zeros(0, "i8")])), out.types, strict=True)], schema=out)

    every = some.select("doc_id", F.xxhash64("f").alias("s"), "f").mapInArrow(explode, schema)
    shared = materialize(every.groupBy("x").agg(F.count("*").alias("sets")).where("sets > 1"), "shared")
    own = Window.partitionBy("doc", "s")
    # features of one set alone come first in the order; they count, but meet nobody
    ranked = every.join(shared, "x").withColumn("k", F.row_number().over(own.orderBy("sets", "x")) + F.col("n") - F.count("*").over(own))

    def make():
        known: dict[int, list[tuple[int, int, int, int]]] = {}

        def fn(docs, sizes, xs, ks):
            sigs, ids, sides = [], [], []
            for doc, n, x, k in zip(docs, sizes, xs, ks, strict=True):
                if n not in known:
                    known[n] = prefixes(n)
                for low, high, length, side in known[n]:
                    if k <= length:
                        sigs.append(hash((x, low, high)))
                        ids.append(doc)
                        sides.append(side)
            return sigs, ids, sides

        return fn

    met = materialize(map_rows(ranked.select("doc", "n", "x", "k"), make, "sig long, doc long, side long").distinct(), "met")
    # a bucket needs both sides of its pair of bands
    whole = materialize(met.groupBy("sig").agg(F.bit_or("side").alias("sides"), F.count("*").alias("sets")).where("sides = 3 AND sets > 1").select("sig"), "whole")
    return met.join(whole, "sig").select("sig", "doc").distinct()


def _blocks(members: DataFrame, features: DataFrame, block_features: int = 300_000, block_rows: int = 2000) -> DataFrame:
    """members (doc, family, c: group so far, n: features) with f, their block, and how many blocks a family's main group and the others have."""
    rows = members.join(features.select(F.col("doc_id").alias("doc"), "f"), "doc")
    groups = members.groupBy("family", "c").agg(F.count("*").alias("many"), F.sum("n").alias("n"))
    largest = groups.groupBy("family").agg(
        F.max_by("c", F.struct("many", "c")).alias("main"), F.max_by("n", F.struct("many", "c")).alias("main_n"), F.sum("n").alias("all_n"), F.max("many").alias("main_many"), F.sum("many").alias("all_many")
    )
    blocks = lambda n, many: F.greatest(F.ceil(n / block_features), F.ceil(many / block_rows), F.lit(1)).cast("int")
    col = F.col
    plan = largest.select("family", "main", blocks(col("all_n") - col("main_n"), col("all_many") - col("main_many")).alias("others"), blocks(col("main_n"), col("main_many")).alias("mains"))
    placed = rows.join(plan, "family").withColumn("is_main", F.col("c") == F.col("main"))
    at = F.xxhash64("doc")
    block = F.when(F.col("is_main"), F.col("others") + F.pmod(at, F.col("mains"))).otherwise(F.pmod(at, F.col("others"))).cast("int")
    return placed.withColumn("block", block).select("family", "doc", "c", "f", "block", "others", "mains", "is_main")


def _family_links(members: DataFrame, features: DataFrame, block_features: int = 300_000, block_rows: int = 2000) -> DataFrame:
    """members (doc, family, c: group so far, n: features) -> links (a, b) between different groups of a family."""
    import pyarrow as pa

    placed = _blocks(members, features, block_features, block_rows)
    # Columns under new names of their own: both sides come from one table.
    fresh = lambda i, j: [F.col(x).alias(y) for x, y in (("family", "family"), (i, "i"), (j, "j"), ("doc", "doc"), ("c", "c"), ("f", "f"))]
    left = placed.where("NOT is_main").withColumn("other", F.explode(F.sequence(F.col("block"), F.col("others") + F.col("mains") - 1))).select(*fresh("block", "other"))
    right = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.least(F.col("block"), F.col("others") - 1)))).select(*fresh("other", "block"))
    schema = "a long, b long"

    def compare(one: pa.Table, two: pa.Table) -> pa.Table:
        links = []
        if one.num_rows and two.num_rows:
            docs, groups, sets = [], [], []
            for t in (one, two):
                docs.append(t.column("doc").to_pylist())
                groups.append(np.array(t.column("c").to_pylist(), "i8"))
                sets.append([np.frombuffer(x.as_buffer(), U) for x in t.column("f")])
            links = links_between(docs, groups, sets)
        out = arrow_schema(schema)
        return pa.Table.from_arrays([pa.array([v[k] for v in links], t) for k, t in enumerate(out.types)], schema=out)

    keys = ("family", "i", "j")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, schema)


def _bucket_links(members: DataFrame, features: DataFrame, pack_features: int = 1_000_000) -> DataFrame:
    """members (doc, family, c, n) of small buckets -> links (a, b) between groups; many buckets to a task, each set once."""
    import pyarrow as pa

    sized = features.select(F.col("doc_id").alias("doc"), "f")
    # Buckets with the same first member hold much the same sets, so they go together; too many of them are dealt to several packs.
    firsts = members.join(members.groupBy("family").agg(F.min("doc").alias("first")), "family")
    loads = firsts.select("first", "doc", "n").distinct().groupBy("first").agg(F.sum("n").alias("n"), F.ceil(F.sum("n") / pack_features).cast("int").alias("salts"))
    packs = 2 * int(loads.agg(F.sum("n")).first()[0] or 0) // pack_features + 1
    packed = firsts.join(loads.drop("n"), "first").withColumn("pack", F.pmod(F.xxhash64("first", F.pmod(F.xxhash64("family"), F.col("salts"))), F.lit(packs)))
    sets = packed.select("pack", "doc").distinct().join(sized, "doc").select(F.col("pack").alias("p"), F.col("doc").alias("d"), "f")
    schema = "a long, b long"

    def compare(one: pa.Table, two: pa.Table) -> pa.Table:
        held: dict[int, list[np.ndarray]] = {}
        for doc, f in zip(two.column("d").to_pylist(), two.column("f"), strict=True):
            held.setdefault(doc, []).append(np.frombuffer(f.as_buffer(), U))
        buckets: dict[int, dict[int, int]] = {}
        for family, doc, c in zip(*(one.column(k).to_pylist() for k in ("family", "doc", "c")), strict=True):
            buckets.setdefault(family, {})[doc] = c
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        links, done = [], set()
        for rows in buckets.values():
            docs = sorted(rows)
            for i, x in enumerate(docs):
                for y in docs[i + 1 :]:
                    p, q = top(rows[x]), top(rows[y])
                    if p == q or (x, y) in done:
                        continue
                    done.add((x, y))
                    if any(similar(f, g) for f in held.get(x, ()) for g in held.get(y, ())):
                        root[q] = p  # further links between the two groups add nothing
                        links.append((x, y))
        out = arrow_schema(schema)
        return pa.Table.from_arrays([pa.array([v[k] for v in links], t) for k, t in enumerate(out.types)], schema=out)

    return packed.select("pack", "family", "doc", "c").groupBy("pack").cogroup(sets.groupBy("p")).applyInArrow(compare, schema)


def components(edges: DataFrame) -> DataFrame:
    """id, component (smallest reachable id) for every end of an edge (a, b).

    Each round points every vertex at its smallest neighbour, follows the pointers to their ends, and contracts the
    edges to those: vertices at least halve, and edges within a group go.
    """
    ends = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    left = materialize(edges.select(*ends("a", "b")).where("a < b").distinct(), "edges")
    steps: list[DataFrame] = []
    while left.limit(1).count():
        both = left.select("a", "b").unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("to")).select("id", F.least("id", "to").alias("to")), "pointers")
        while True:
            on = to.select(F.col("id").alias("to"), F.col("to").alias("on"))
            further = materialize(to.join(on, "to").select("id", F.col("on").alias("to"), (F.col("on") < F.col("to")).alias("moved")), "pointers")
            moved = further.where("moved").limit(1).count()
            to = further.select("id", "to")
            if not moved:
                break
        steps.append(to)
        x, y = (to.select(F.col("id").alias(k), F.col("to").alias(v)) for k, v in (("a", "x"), ("b", "y")))
        left = materialize(left.join(x, "a").join(y, "b").where("x <> y").select(*ends("x", "y")).distinct(), "edges")
    if not steps:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    labels = steps[-1].select("id", F.col("to").alias("component"))
    for to in reversed(steps[:-1]):
        roots = labels.select(F.col("id").alias("to"), "component")
        labels = to.join(roots, "to", "left").select("id", F.coalesce("component", "to").alias("component"))
    return materialize(labels, "labels")


def _mixed(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """sig, doc, c, m (members) of the buckets whose members are in several groups; of buckets with the same members only one."""
    placed = materialize(kept.join(groups, kept["doc"] == groups["id"], "left").select("sig", "doc", F.coalesce("component", "doc").alias("c")), "placed")
    buckets = placed.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.sum(F.xxhash64("doc", F.lit(1)).bitwiseAND(F.lit((1 << 31) - 1))).alias("y"))
    chosen = materialize(buckets.where("lo < hi").groupBy("m", "x", "y").agg(F.min("sig").alias("sig")).select("sig", "m"), "chosen")
    return placed.join(chosen, "sig")


def link_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small_bucket: int = 32, bits: int = KEPT_BITS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, component_id) for every row, and the verified links between representatives of equal sets."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sets = materialize(_sets(texts), "sets")
    total, many = sets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ranges = max(48, int(total * 1.2) // RANGE + 1)

    # Equal sets are one vertex; an id with several sets is one too, and stays if any of them is the first of its kind.
    named = sets.where("n > 0 AND doc_id IS NOT NULL")
    several = materialize(named.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("many")).where("many > 1").drop("many"), "copies")
    same = materialize(named.join(several, ["n", "h1", "h2"]).where("doc_id > rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct(), "same")
    repeated = materialize(named.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id"), "repeated")
    spare = materialize(same.select(F.col("b").alias("doc_id")).distinct().join(repeated, "doc_id", "left_anti"), "spare")
    # Only documents that may be copies are shuffled to find out.
    marked = may_hold(texts, "doc_id", spare)
    singles = marked.where("NOT may").unionAll(marked.where("may").join(spare, "doc_id", "left_anti").select(marked.columns)).drop("may")

    found = materialize(_survivors(_signature_blocks(singles, ranges, 4 + many // HOT_SETS, bits), ranges), "survivors")
    kept = materialize(_rarest(found), "kept")

    # Step 4. Pivots are the smallest ids, so that buckets share them.
    # One row a signature, written: the joins below deal both sides by signature anew, so that a hot one's rows can be split over tasks.
    smallest = materialize(kept.groupBy("sig").agg(F.min("doc").alias("a"), F.max("doc").alias("z")).where("a < z").select("sig", "a"), "pivots")
    features = _features(texts, kept.join(smallest, "sig", "left_semi").select(F.col("doc").alias("_id")))
    stars = kept.join(smallest, "sig").where("doc > a").select("a", F.col("doc").alias("b")).distinct()
    links = _verified(features, materialize(stars, "stars"))
    # Step 5. A bucket is done once all its members are in one group.
    sizes = features.groupBy(F.col("doc_id").alias("doc")).agg(F.max(F.octet_length("f") / 8).cast("long").alias("n"))
    rest = materialize(_mixed(kept, components(links)).join(sizes, "doc"), "apart")
    large = rest.where(F.col("m") > small_bucket)
    small = rest.where(F.col("m") <= small_bucket).select("doc", F.col("sig").alias("family"), "c", "n")
    if large.limit(1).count():
        # Members of large buckets meet again by their rare features; only what is still together in large numbers is compared in blocks.
        refined = materialize(_mixed(materialize(_refined(features, large.select("doc")), "refined"), components(links)).join(sizes, "doc"), "apart")
        large = refined.where(F.col("m") > small_bucket)
        small = small.unionAll(refined.where(F.col("m") <= small_bucket).select("doc", F.col("sig").alias("family"), "c", "n"))
        firsts = large.groupBy("sig").agg(F.min("doc").alias("first"))
        families = components(large.join(firsts, "sig").where("doc > first").select(F.col("first").alias("a"), F.col("doc").alias("b")).distinct())
        members = large.select("doc", "c", "n").distinct().join(families.select(F.col("id").alias("doc"), F.col("component").alias("family")), "doc")
        links = links.unionAll(materialize(_family_links(materialize(members, "families"), features), "links"))
    links = links.unionAll(materialize(_bucket_links(small, features), "links"))

    final = components(links.unionAll(same.join(repeated.select(F.col("doc_id").alias("b")), "b", "left_semi").select("a", "b")))
    to = same.groupBy(F.col("b").alias("doc_id")).agg(F.min("a").alias("rep"))
    placed = sets.select("doc_id", "n").join(to, "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    rows = placed.join(final, placed["rep"] == final["id"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    return rows, links


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the smallest id of each group, one row an id (that with the first text); rows with a null id stay."""
    named, key, turn, may = fresh_names(docs, "id", "t", "may_be")
    groups = materialize(link_groups(docs, id_col, text_col)[0].where("doc_id IS NOT NULL"), "groups")
    gone = materialize(groups.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct(), "gone")
    several = materialize(groups.groupBy(F.col("doc_id").alias(key)).agg(F.count("*").alias("k")).where("k > 1").select(key), "several")
    # Only rows that may have to go are shuffled to find out.
    marked = may_hold(named.withColumn(key, F.col(id_col).cast("long")), key, gone.unionAll(several), name=may)
    sure, unsure = marked.where(~F.col(may)), marked.where(F.col(may)).join(gone, key, "left_anti").select(marked.columns)
    if several.limit(1).count():
        alone = unsure.join(several, key, "left_anti").select(marked.columns)
        first = F.row_number().over(Window.partitionBy(key).orderBy(text_col))
        unsure = alone.unionAll(unsure.join(several, key, "left_semi").select(marked.columns).withColumn(turn, first).where(F.col(turn) == 1).drop(turn))
    return sure.unionAll(unsure).drop(key, may)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]


#: Brute force over all pairs that share a shingle; for small tables only.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id
FROM sets s LEFT JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, len(s.s)
"""
