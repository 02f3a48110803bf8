"""Which strings contain which others, by an inverted index of q-grams instead of a nested comparison (JN04, JN05, JN22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a gram.
Q = 3


def grams(text: Column, q: int) -> Column:
    """The distinct q-grams of a string, in time linear in its length; none of a shorter one."""
    signs = F.split(text, "")
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) - q, F.lit(0))), lambda i: F.concat(*[F.get(signs, i + k) for k in range(q)]))
    return F.when(F.length(text) >= q, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def containing(needles: DataFrame, hays: DataFrame, keys: list[str]) -> DataFrame:
    """keys, needle, hay: the distinct pairs with the same keys where hay contains needle (needles: keys, needle; hays: keys, hay).

    A needle is looked up by its rarest gram only, as an equi-join on (keys, gram), and each candidate is verified. A needle with a gram that no
    hay has goes before. Needles under Q characters are grams themselves; the empty one is in every hay. Postings carry a hash of the
    hay, not the hay. A frequent gram's postings are split by the adaptive skew join, as both of its sides are dealt for it alone.
    """
    wanted = needles.select(*keys, "needle").where("needle IS NOT NULL").distinct()
    texts = hays.select(*keys, "hay").where("hay IS NOT NULL").distinct().withColumn("h", F.xxhash64(*keys, "hay"))
    postings = lambda *sizes: texts.select(*keys, F.explode(F.concat(*[grams(F.col("hay"), q) for q in sizes])).alias("gram"), "h")
    frequency = postings(Q).groupBy(*keys, "gram").agg(F.count("*").alias("n"))
    long = wanted.where(F.length("needle") >= Q).select(*keys, "needle", F.explode(grams(F.col("needle"), Q)).alias("gram"))
    rated = long.join(frequency, [*keys, "gram"], "left").groupBy(*keys, "needle").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.bool_or(F.col("n").isNull()).alias("nowhere"))
    rarest = rated.where("NOT nowhere").select(*keys, "needle", "gram")
    short = wanted.where((F.length("needle") > 0) & (F.length("needle") < Q)).withColumn("gram", F.col("needle"))
    found = rarest.join(postings(Q), [*keys, "gram"]).select(*keys, "needle", "h")
    found = found.unionByName(short.join(postings(*range(1, Q)), [*keys, "gram"]).select(*keys, "needle", "h"))
    found = found.unionByName(wanted.where("needle = ''").join(texts.select(*keys, "h"), keys).select(*keys, "needle", "h"))
    return found.join(texts, [*keys, "h"]).where(F.contains("hay", "needle")).select(*keys, "needle", "hay")
