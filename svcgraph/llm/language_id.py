"""Operator 7: language identification by cross-parsing entropy.

For each language a suffix automaton is built over running labelled text. A text is cross-parsed
against each: read on while the automaton knows the string so far, then cut a phrase and start the next one there.
Both are normalised alike: lower case, runs of letters with a space between them, so phrases run
across words. The language that needs the fewest phrases for each character wins.

The labelled sample is bounded by characters alone: texts are cut into pieces of `piece_chars` characters, and of a language's distinct pieces
those with the smallest hashes are taken while their total stays within `model_chars`. So texts of any length are learned from, long ones by
some of their pieces, and copies count once and can't crowd out others. All languages together take `total_chars`: where there are
more than 20 labels, each gets an equal share (an automaton takes about 300 bytes a character in each Python worker, 180 MB in all).

Defined results: `und` with score 0 for texts that are null, empty or without a letter, and
for all when nothing is learned; ties go to the language first in order; repeated rows and
null ids give a row each (a null id is neither held out nor learned from); columns beyond those
named are ignored. Very long texts are parsed whole, in time linear in their length.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import append_columns, fresh_names, map_rows, materialize, process_table, text_of

_WORDS = re.compile(r"[^\W\d_]+")


def running(text: str | None) -> str:
    """The text's runs of letters in lower case, a space between two."""
    words = _WORDS.findall(text_of(text).lower())
    if "".join(words).isalpha():
        return " ".join(words)
    return " ".join("".join([c if c.isalpha() else " " for c in " ".join(words)]).split())  # signs such as superscripts


class SuffixAutomaton:
    """All substrings of a string, by Blumer's online construction; a state is the dict of its following states."""

    def __init__(self, text: str) -> None:
        nxt: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            current = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = current
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[current] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[current] = clone
            last = current
        for state in nxt:
            for c, to in state.items():
                state[c] = nxt[to]
        self.root = nxt[0]

    def phrases(self, text: str) -> int:
        """Into how many longest known strings (or single unknown characters) the text falls."""
        root = state = self.root
        count = 0
        for c in text:
            to = state.get(c)
            if to is None:
                count += 1
                if state is root:
                    continue  # an unknown character is a phrase
                to = root.get(c)
                if to is None:
                    state = root
                    count += 1
                    continue
            state = to
        return count + (state is not root)


class CrossParser:
    """Phrase counts of texts under each language's automaton."""

    def __init__(self, models: dict[str, str]) -> None:
        self.languages = sorted(models)
        self.automata = [SuffixAutomaton(models[k]) for k in self.languages]

    def predict(self, text: str | None) -> tuple[str, float, float, int]:
        """Language, score (how far the next best falls behind, 0 to 1), phrases a character of the best, characters."""
        line = running(text)
        n = len(line)
        if not n or not self.automata:
            return "und", 0.0, 0.0, n
        phrases = [a.phrases(line) for a in self.automata]
        order = sorted(range(len(phrases)), key=lambda i: (phrases[i], self.languages[i]))
        best = phrases[order[0]]
        second = phrases[order[1]] if len(order) > 1 else n
        return self.languages[order[0]], max(0.0, min(1.0, (second - best) / second)), best / n, n


def _parser(models: dict[str, str]) -> CrossParser:
    """Built once in each Python worker."""
    return process_table(("cross-parser", tuple(sorted(models.items()))), lambda: CrossParser(models))


def learn(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", model_chars: int = 30_000, total_chars: int = 600_000, piece_chars: int = 1000) -> dict[str, str]:
    """For each label the running text of its automaton."""
    rows = labelled.select(F.col(label_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang IS NOT NULL AND length(text) > 0")
    labels = rows.select("lang").distinct().count()
    if not labels:
        return {}
    model_chars = max(1, min(model_chars, total_chars // labels))
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{min(piece_chars, model_chars)}}}"), F.lit(0))
    hashed = rows.select("lang", F.explode(cut).alias("text")).withColumn("h", F.xxhash64("text"))
    keys = materialize(hashed.groupBy("lang", "h").agg(F.max(F.length("text")).cast("long").alias("n")), "hashes")
    sizes = keys.groupBy("lang").agg(F.sum("n").alias("chars")).collect()  # one row a label

    # Below a bound on the hash lies some multiple of the sample, however large a language is; where it doesn't, all are looked at.
    def below(full: set[str]) -> DataFrame:
        bounds = [(r["lang"], -(1 << 63) + ((8 * model_chars << 64) // r["chars"])) for r in sizes if 8 * model_chars < r["chars"] and r["lang"] not in full]
        if not bounds:
            return keys
        held = labelled.sparkSession.createDataFrame(bounds, "lang string, bound long")  # a row a label
        return keys.join(F.broadcast(held), "lang", "left").where("bound IS NULL OR h < bound").drop("bound")

    drawn = {r["lang"]: r["n"] for r in below(set()).groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # one row a language
    few = {r["lang"] for r in sizes if drawn.get(r["lang"], 0) < min(2 * model_chars, r["chars"])}
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    chosen = below(few).withColumn("upto", before).where(F.col("upto") <= model_chars).select("lang", "h")
    # At most model_chars characters a language, so it may be broadcast and come to the driver.
    texts = hashed.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    found: dict[str, list[tuple[int, str]]] = {}
    for r in texts.collect():
        found.setdefault(r["lang"], []).append((r["h"], r["text"]))
    models = {lang: " ".join([line for _, text in sorted(some) if (line := running(text))]) for lang, some in found.items()}
    return {lang: line for lang, line in models.items() if line}


def identify(docs: DataFrame, models: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rate (phrases a character under the winner), and those characters' number."""

    def make():
        parser = _parser(models)

        def fn(keys, texts):
            got = [parser.predict(t) for t in texts]
            return keys, *map(list, zip(*got, strict=True))

        return fn

    return map_rows(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), make, "doc_id long, lang_pred string, score double, rate double, characters long")


def keep_languages(docs: DataFrame, models: dict[str, str], text_col: str = "text", lang_col: str = "lang", max_rate: float = 0.6, slack: float = 8.0) -> DataFrame:
    """docs without those in no learned language: without a letter, or hardly parsed by any automaton.

    A text of n characters may need max_rate * n + slack phrases under the best automaton; a language's own
    texts need 0.1 to 0.3 a character, other languages of the same script 0.3 to 0.5. Where the language is null it becomes the predicted one.
    """
    named, lang, kept = fresh_names(docs, "lang", "keep")

    def make():
        parser = _parser(models)

        def fn(texts):
            got = [parser.predict(t) for t in texts]
            return [g[0] for g in got], [g[0] != "und" and g[2] * g[3] <= max_rate * g[3] + slack for g in got]

        return fn

    judged = append_columns(named, text_col, make, f"{lang} string, {kept} boolean").where(F.col(kept))
    return judged.withColumn(lang_col, F.coalesce(lang_col, lang)).drop(lang, kept)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    models = learn(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    return identify(docs, models).withColumn("held_out", held_out())
