"""Operator 12 [native]: importance resampling towards a target distribution, in DataFrame expressions alone.

Each text's words are exploded, and so are, at every word, the 1- to `orders`-grams that start there; a gram's bucket is the
crc32 of its UTF-8 modulo `buckets`. Grouped counts give one row a bucket for the corpus and for the target, a table of
`buckets` rows at most however large both are, so the gains are broadcast and joined to the exploded grams of a second pass,
and summed a document. Grams never leave their task: what is shuffled is a row a bucket and task, and a row a document.

Documents are drawn by weight plus Gumbel noise from a hash of the id (the same in every run). Ranks come from a
range sort: each partition numbers its rows, and the partitions' counts (one small row each) become offsets.

Defined results: a null, empty or wordless text has no feature and weight 0; a row with a null id has a weight, and a null
score and rank, and doesn't count among those to draw from; repeated rows are documents of their own (rows of equal score and id
get successive ranks in either order); with no target every gain comes from the corpus alone; an empty table gives no row; columns beyond the
named two are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

BUCKETS, ORDERS, SEED, PERCENT, MIN_WORDS = 10_000, 3, 42, 5, 20
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text, with A-Z (and nothing else) in lower case."""
    ascii_only = F.length(text) == F.octet_length(text)  # there lower() changes A-Z alone, and is much faster
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), SEPARATORS, -1), "")


def features(rows: DataFrame, buckets: int = BUCKETS, orders: int = ORDERS) -> DataFrame:
    """rows (with an array column words) with a row for each n-gram and its bucket; a row without words stays once, with null."""
    at = rows.select("*", F.posexplode_outer("words").alias("at", "word"))
    gram, grams = F.col("word"), [F.col("word")]
    for k in range(1, orders):
        gram = F.concat(gram, F.lit(" "), F.get("words", F.col("at") + k))  # null beyond the last word
        grams.append(gram)
    return at.withColumn("bucket", F.explode(F.array(*[F.crc32(g.cast("binary")) % buckets for g in grams]))).drop("words", "at", "word")


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, orders: int = ORDERS) -> DataFrame:
    """bucket, n: how many features of all texts fall into each bucket that has any."""
    rows = texts.select(words_of(F.col(text_col).cast("string")).alias("words"))
    return features(rows, buckets, orders).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"))


def gain_table(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, orders: int = ORDERS) -> DataFrame:
    """bucket, gain: thousandths of the log of the smoothed target share over the smoothed corpus share, for every bucket."""
    both = bucket_counts(docs, text_col, buckets, orders).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(
        bucket_counts(target, target_col, buckets, orders).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    )
    every = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    sums = both.unionByName(every).groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    whole = Window.partitionBy()  # over `buckets` rows, however large the corpus is
    totals = sums.select("bucket", "s", "t", F.sum("s").over(whole).alias("all_s"), F.sum("t").over(whole).alias("all_t"))
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return totals.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weights(docs: DataFrame, gains: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, orders: int = ORDERS) -> DataFrame:
    """row (a number of the input row), doc_id, n_words, n_features, weight: the sum of the gains of a document's features."""
    # A row's number is its place in its input partition: a task that runs again gives the same one.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), words_of(F.col(text_col).cast("string")).alias("words"))
    counted = rows.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), "words")
    joined = features(counted, buckets, orders).join(F.broadcast(gains), "bucket", "left")
    summed = joined.groupBy("row", "doc_id", "n_words").agg(F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight"))
    n_features = sum((F.greatest(F.col("n_words") - k, F.lit(0)) for k in range(1, orders)), F.col("n_words"))
    return summed.select("row", "doc_id", "n_words", n_features.cast("long").alias("n_features"), "weight")


def noise(key: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variate from the first 32 bits of sha256 of "seed:key"."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """scored (row, doc_id, n_words, score, ...) with rank: 1, 2, ... for the drawn documents by (score descending, doc_id), else null."""
    may = (F.col("n_words") >= min_words) & F.col("score").isNotNull()
    order = [F.col("may").desc(), F.col("score").desc(), F.col("doc_id").asc(), F.col("row").asc()]
    dealt = scored.withColumn("may", may).repartitionByRange(*order).sortWithinPartitions(*order)
    # monotonically_increasing_id is (partition, place in the partition); written, so that both stay what they are
    placed = materialize(dealt.withColumn("line", F.monotonically_increasing_id()), "ranks").withColumn("part", F.shiftright("line", 33))
    counts = placed.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.col("may").cast("long")).alias("n_may"))
    # one row a partition, however many documents they hold
    before, whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    bases = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.floor(F.sum("n_may").over(whole) * percent / 100).alias("draw"))
    rank = F.col("base") + F.col("line").bitwiseAND((1 << 33) - 1) + 1
    return placed.join(F.broadcast(bases), "part").withColumn("rank", F.when(F.col("may") & (rank <= F.col("draw")), rank).cast("long")).drop("may", "line", "part", "base", "draw")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, orders: int = ORDERS, seed: int = SEED, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs."""
    gains = gain_table(docs, target, text_col, target_col, buckets, orders)
    scored = weights(docs, gains, id_col, text_col, buckets, orders).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return ranked(scored, percent, min_words).select("doc_id", "n_features", "weight", "score", "rank")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


# crc32 byte by byte over a table of 256 remainders, itself made by eight shifts; a gram is counted once and looked up again.
SQL = r"""
WITH RECURSIVE bits(i, step, c) AS (
    SELECT i, 0, i::BIGINT FROM range(256) t(i)
    UNION ALL SELECT i, step + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM bits WHERE step < 8),
remainders AS (SELECT list(c ORDER BY i) AS of FROM bits WHERE step = 8),
texts AS (
    SELECT 'd' AS side, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents
    UNION ALL
    SELECT 'b', NULL, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') FROM benchmark),
numbered AS (SELECT row_number() OVER () AS r, side, doc_id, words, len(words) AS n FROM texts),
places AS (SELECT r, side, words, unnest(range(1, n + 1)) AS i, n FROM numbered),
grams AS (
    SELECT r, side, words[i] AS gram FROM places
    UNION ALL SELECT r, side, words[i] || ' ' || words[i + 1] FROM places WHERE i < n
    UNION ALL SELECT r, side, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] FROM places WHERE i + 1 < n),
known AS (SELECT gram, row_number() OVER () AS g FROM (SELECT DISTINCT gram FROM grams)),
bytes(g, digits, pos, crc) AS (
    SELECT g, hex(encode(gram)), 1, 4294967295::BIGINT FROM known
    UNION ALL
    SELECT g, digits, pos + 2, xor(crc >> 8, remainders.of[1 + xor(crc & 255, ('0x' || substr(digits, pos, 2))::BIGINT)])
    FROM bytes, remainders WHERE pos < length(digits)),
buckets AS (SELECT gram, xor(crc, 4294967295::BIGINT) % 10000 AS bucket FROM bytes JOIN known USING (g) WHERE pos > length(digits)),
counted AS (SELECT r, side, bucket, count(*) AS n FROM grams JOIN buckets USING (gram) GROUP BY ALL),
sums AS (SELECT b.bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS t FROM range(10000) b(bucket) LEFT JOIN counted USING (bucket) GROUP BY 1),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM sums),
weights AS (SELECT r, sum(n * gain)::BIGINT AS weight FROM counted JOIN gains USING (bucket) WHERE side = 'd' GROUP BY 1),
scored AS (
    SELECT doc_id, n, n + greatest(n - 1, 0) + greatest(n - 2, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM numbered LEFT JOIN weights USING (r) WHERE side = 'd'),
drawn AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n >= 20) OVER () AS eligible FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN n >= 20 AND place <= floor(5 * eligible / 100) THEN place END AS rank FROM drawn
"""
