"""Small fixtures with nulls, empty and long texts, ties, repeated rows and clashing columns; brute force beside each operator."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from svcgraph.llm import binary_records, chat_format, decontamination, language_id, license_scan, ngram_join, packing, pii, topk_search, warc
from svcgraph.llm.common import WordTokenizer, scratch_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, "s", None) for i, t in zip(ids, texts, strict=True)], DOCS)


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def plain_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


TEXTS = [None, "", "  \n ", "Hello, World's <|endoftext|> 12ab", "Ünïcödé İstanbul ΣΑΣ naïve´ é 　x", "a b", words(1, 3000), "a b", "x" * 3000, "don't we'll\tI'm"]


def ids_of(text):
    return plain_tokenizer().encode(text or "", add_special_tokens=False).ids


def test_tokenizer_equals_the_library():
    assert [np.frombuffer(x, "<u2").tolist() for x in WordTokenizer().encode(TEXTS)] == [ids_of(t) for t in TEXTS]
    small = WordTokenizer()
    small.KEEP = 3  # tables emptied all the time
    assert [np.frombuffer(x, "<u2").tolist() for t in TEXTS for x in small.encode([t])] == [ids_of(t) for t in TEXTS]


def test_packing_round_trip(spark):
    df = docs(spark, TEXTS, [5, None, 2, 3, 4, 7, 6, 7, 8, 9]).withColumn("n", F.lit(1)).withColumn("part", F.lit("clash"))
    got = packing.pack(df, length=64).collect()
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    assert sorted(sequences) == list(range(len(sequences)))
    for s, pieces in sequences.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 64 or s == len(sequences) - 1
    total = sorted([*ids_of(t), packing.END_ID] for t in TEXTS if t and len(t) > 100)
    long_ids = {6: 0, 8: 1}
    for key in long_ids:
        pieces = sorted((r for r in got if r.doc_id == key), key=lambda r: r.start)
        whole = np.concatenate([np.frombuffer(bytes(r.ids), "<u2") for r in pieces]).tolist()
        assert whole in total and all(r.ids_crc32 == zlib.crc32(np.frombuffer(bytes(r.ids), "<u2").astype("<u4").tobytes()) for r in pieces)
    assert sum(r.length for r in got) == sum(len(ids_of(t)) + 1 for t in TEXTS)
    assert packing.pack(df.limit(0)).count() == 0


def test_records_round_trip(spark):
    keys = [5, None, 2, 3, 4, 7, 6, 7, 8, -9]
    df, folder = docs(spark, TEXTS, keys), scratch_path(spark, "t")
    manifest = binary_records.write_tokens(df, folder)
    got = sorted(binary_records.read_tokens(manifest, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, -9, 2, 3, 4, 5, 6, 7, 7, 8]
    at = 0
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u2")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
        at += len(ids)
        if r.doc_id not in (None, 7):
            assert ids.tolist() == [*ids_of(TEXTS[keys.index(r.doc_id)]), 1]
    empty = scratch_path(spark, "t")
    assert binary_records.read_tokens(binary_records.write_tokens(df.limit(0), empty), empty).count() == 0


def test_record_damage_is_seen():
    framed = bytearray(binary_records.frame(b"abc") + binary_records.frame(b""))
    payload, at = binary_records.unframe(bytes(framed))
    assert payload == b"abc" and binary_records.unframe(bytes(framed), at) == (b"", len(framed))
    for i in (0, 9, 13, 16):
        bad = bytearray(framed)
        bad[i] ^= 1
        with pytest.raises(ValueError):
            binary_records.unframe(bytes(bad))


def test_topk_against_brute_force(spark):
    r = np.random.default_rng(3)
    base = r.normal(0, 0.2, (260, 8))
    base[40:90] = base[40]  # ties
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(base)]
    rows += [(300, None, 1), (301, [1.0, None], 1), (302, [float("nan")] * 8, 1), (303, [float("inf")] * 8, 1), (None, [1.0] * 8, 1), (5, [0.5] * 8, 1), (304, [], 1), (400, [9e5] + [0.0] * 7, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("key", F.lit(1)).repartition(3)
    for bits, block in ((5, 64), (2, 1000)):
        v = topk_search.quantised(df)
        got = sorted(tuple(x) for x in topk_search.search(topk_search.build_index(v, block, bits), v.where("key % 100 = 0"), 10, bits).collect())
        ints = [(i, np.floor(1024 * np.array(x)).astype("i8")) for i, x, _ in rows if i is not None and x is not None and all(y is not None and np.isfinite(y) for y in x)]
        want = []
        for q, a in ints:
            if q % 100 == 0:
                best = sorted(((-int(np.dot(a[: len(b)], b[: len(a)])), i) for i, b in ints if i != q))[:10]
                want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
        assert got == sorted(want)
    assert topk_search.search(topk_search.build_index(topk_search.quantised(df.limit(0))), topk_search.quantised(df.limit(0))).count() == 0


LICENSED = ["CC BY cc by CC BY-NC", "All rights reserved. The GNU General Public License, version 3.", None, "", "Released under the MIT License.", "plain words", "Licensed under the Apache License, Version 2.0.", "mit license of fish", "é cc BY é"]


def test_license_scan(spark):
    got = {r.doc_id: r for r in license_scan.scan(docs(spark, LICENSED)).collect()}
    for i, text in enumerate(LICENSED):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        starts = [(k, label) for p, label in license_scan.BASE.items() for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in starts]
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word) == (len(ws), len(at), min(at, default=None), max(at, default=None))
        assert got[i].base_labels == ",".join(sorted({label for _, label in starts}))
        assert set(filter(None, got[i].base_labels.split(","))) <= set(got[i].labels.split(","))
    assert [got[i].labels for i in (4, 6, 5, 7)] == ["mit", "apache-2.0", "", ""]
    assert license_scan.scan(docs(spark, [])).count() == 0


PAGES = [(1, "http://a.example.com/x?q=1#f", "<p>one</p>"), (2, "https://b.example.com/", "<p>one</p>"), (3, None, None), (4, "x\r\ny", ""), (5, "http://a.example.com/x?q=1", "é" * 500), (None, "http://n/", "<p>one</p>"), (5, "http://a.example.com/x?q=1", "é" * 500), (7, "http://q/", "dé퟿")]


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, least):
    df, folder = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("salt", F.lit(9)).repartition(3), scratch_path(spark, "w")
    manifest = warc.archive(df, folder, least_bytes=least)
    keys = df.select(warc.surt_key(F.col("url")).alias("surt"), "page_id")
    got = sorted((tuple(r) for r in warc.lookup(keys, manifest, folder).collect()), key=repr)
    want = []
    import base64

    for page, url, html in PAGES:
        data = (html or "").encode()
        ids = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        first = max(ids, default=None)
        revisit = len(data) >= least and first is not None and page != first
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((page, url, len(data), digest, "revisit" if revisit else "response", first if revisit else None, None if revisit else bytearray(data)))
    assert got == sorted(want, key=repr)
    assert warc.lookup(keys.where("surt = 'none'"), manifest, folder).count() == 0


def test_warc_keys_and_empty(spark):
    got = spark.range(1).select(*[warc.surt_key(F.lit(u)) for u in ("HTTP://u@Www.Example.com:80/a?b#c", "no url#x", "http://h")]).first()
    assert tuple(got) == ("com,example,www)/a?b", "no url", "h)")
    folder = scratch_path(spark, "w")
    empty = warc.archive(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.lookup(spark.createDataFrame([("a", 1)], "surt string, page_id long"), empty, folder).count() == 0


def edit_distance_inside(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        new = [i + 1]
        for j, c in enumerate(text):
            new.append(min(row[j] + (p != c), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_myers_equals_dynamic_programming():
    r = random.Random(2)
    for _ in range(150):
        p, t = ("".join(r.choice("abc") for _ in range(n)) for n in (r.randint(1, 80), r.randint(0, 90)))
        want, most = edit_distance_inside(p, t), r.randint(0, 30)
        got = decontamination.myers(p, t, most)
        assert (got[0] if got else None) == (want if want <= most and t else None) or (not t and want <= most)


def test_decontamination_against_brute_force(spark):
    r = random.Random(4)
    items = [(i, words(100 + i, 30, 60)) for i in range(6)] + [(90, None), (91, ""), (92, "w1 w2")]
    texts = [None, "", words(7, 300)]
    for i, item in items[:6]:
        for errors in (0, 3, 9, 30):
            chars = list(item)
            for _ in range(errors):
                chars[r.randrange(len(chars))] = r.choice("xyz")
            texts.append(f"{words(i, 40)}\n{''.join(chars).upper()} {words(i + 1, 50)}")
    texts += ["xw1 w2", "so w1, W2!", "x" + items[3][1], items[3][1], items[4][1] + "x and so on", "what" + items[5][1] + "ever"]
    items += [(93, "one two three four"), (94, "one two three four five six")]
    texts += ["stone two three four", "stone two three four five six", "bone two three fourteen", words(5, 9000, 60) + " " + items[0][1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (10_000, 200):
        got = {(x.doc_id, x.item_id): x for x in decontamination.contaminated(docs(spark, texts), bench, block_chars=block).collect()}
        want = {}
        for d, t in enumerate(texts):
            for i, item in items:
                a, b = decontamination.normal(item), decontamination.normal(t)
                if a and b and (n := edit_distance_inside(f" {a} ", f" {b} ")) <= int(0.05 * len(a)):
                    want[d, i] = n
        assert {k: v.distance for k, v in got.items()} == want
        assert all(decontamination.normal(texts[d][v.start : v.end]) == decontamination.normal(dict(items)[i]) for (d, i), v in got.items() if not v.distance)
    kept = decontamination.remove_contaminated(docs(spark, texts), bench)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(range(len(texts))) - {d for d, _ in want}) and kept.columns == docs(spark, []).columns
    assert decontamination.contaminated(docs(spark, texts), bench.limit(0)).count() == 0


def test_suffix_automaton_phrases():
    r = random.Random(1)
    for _ in range(60):
        train, text = ("".join(r.choice("abcd"[:k]) for _ in range(n)) for k, n in ((3, r.randint(1, 40)), (4, r.randint(0, 40))))
        at = count = 0
        while at < len(text):
            size = max((n for n in range(1, len(text) - at + 1) if text[at : at + n] in train), default=1)
            at, count = at + size, count + 1
        assert language_id.SuffixAutomaton(train).phrases(text) == count


def test_language_id(spark):
    en, de = "the house of the small river and this is where they were going", "das haus an dem kleinen fluss und hier ist wo sie alle gingen"
    rows = [(i, (en if i % 2 else de) + f" {i}", "en" if i % 2 else "de", "s", None) for i in range(40)] + [(50, None, "en", "s", None), (51, "12 34 !!", "de", "s", None), (None, en, None, "s", None), (52, "", None, "s", None)]
    df = spark.createDataFrame(rows, DOCS)
    models = language_id.learn(df)
    got = {r.doc_id: r for r in language_id.identify(df, models).collect()}
    assert sorted(models) == ["de", "en"] and got[50].lang_pred == got[51].lang_pred == got[52].lang_pred == "und" and got[None].lang_pred == "en"
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") and 0 <= got[i].score <= 1 for i in range(40))
    kept = language_id.keep_languages(df, models)
    assert kept.columns == df.columns and kept.count() == 41
    assert language_id.learn(df.limit(0)) == {} and language_id.identify(df, {}).where("lang_pred <> 'und'").count() == 0


def test_language_sample_is_of_distinct_texts(spark):
    # two labels of 4000 rows, one of them a single text, in many draws
    for k in range(6):
        rows = spark.createDataFrame([(words(k, 8), "aa"), (words(k + 50, 8), "aa"), (words(k + 90, 8), "bb")], "text string, lang string").crossJoin(spark.range(2000)).drop("id")
        models = language_id.learn(rows, model_chars=200)
        assert set(models) == {"aa", "bb"}
        assert set(models["aa"].split()) == {w for i in (k, k + 50) for w in language_id.running(words(i, 8)).split()}
    # one text in many copies leaves the others their places
    early = spark.createDataFrame([(f"q{chr(97 + k % 26)}{chr(97 + k // 26)}", "bb") for k in range(300)], "text string, lang string")
    first = early.orderBy(F.xxhash64("text")).limit(1).crossJoin(spark.range(5000)).drop("id")
    assert len(language_id.learn(early.union(first))["bb"].split()) == 300
    # none of the texts lies below the bound on the hash: the smallest hash all the same
    high = [f"z{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    high = [r.text for r in spark.createDataFrame([(x,) for x in high], "text string").orderBy(F.xxhash64("text")).where(F.xxhash64("text") > 0).limit(40).collect()]
    got = language_id.learn(spark.createDataFrame([(x, "cc") for x in reversed(high)], "text string, lang string"), model_chars=3)
    assert got == {"cc": high[0]}
    # all texts too long: a piece of one
    long = spark.createDataFrame([("ab cd ef gh", "dd"), ("ab cd ef", "dd")], "text string, lang string")
    model = language_id.learn(long, model_chars=5)["dd"]
    assert model and len(model) <= 5 and set(model.split()) <= {"ab", "cd", "ef", "g", "h"}
    # a language of books and one stub is learned from the books
    books = spark.createDataFrame([(words(k, 9000, 3000).translate(str.maketrans("0123456789", "abcdefghij")), "ee") for k in range(3)] + [("court", "ee")], "text string, lang string")
    model = language_id.learn(books)["ee"]
    assert 28_000 <= len(model) <= 30_000 and max(len(t) for t in [r.text for r in books.collect()]) > 36_000
    # hundreds of labels share what all models may take
    many = spark.createDataFrame([(words(k, 300).translate(str.maketrans("0123456789", "abcdefghij")), f"l{k}") for k in range(501)], "text string, lang string")
    models = language_id.learn(many, total_chars=50_100)
    assert len(models) == 501 and 50 <= max(map(len, models.values())) <= 100


def test_language_scores_against_brute_force(spark):
    """Greedy longest-match phrases by plain substring search, over whole running texts."""

    def phrases(sample, line):
        n = at = 0
        while at < len(line):
            size = 1
            while at + size < len(line) and line[at : at + size + 1] in sample:
                size += 1
            at, n = at + size, n + 1
        return n

    r = random.Random(4)
    make = lambda letters, n: " ".join(["".join([r.choice(letters) for _ in range(r.randint(1, 7))]) for _ in range(n)])
    kinds = {"aa": "abcdeit", "bb": "klmnoit", "cc": "rstuvit"}
    rows = [(i, make(kinds[k], r.randint(1, 30)) + r.choice(["", " 12!", "\nX\u00b2Y", "\u4e2d\u6587"]), k, "s", None) for i, k in enumerate(list(kinds) * 30)]
    rows += [(900, None, "aa", "s", None), (901, "", None, "s", None), (902, "\u00b2 \u00bd 7", None, "s", None), (903, make(kinds["bb"], 20_000), None, "s", None), (7, rows[7][1], "aa", "s", None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("h", F.lit(1)).withColumn("n", F.lit(1))
    models = language_id.learn(df.where("doc_id < 60"), model_chars=400)
    assert sorted(models) == sorted(kinds) and all(len(m) <= 500 for m in models.values())
    got = sorted(language_id.identify(df, models).collect(), key=lambda x: (x.doc_id, x.rate))
    assert len(got) == len(rows)
    texts = {row[0]: row[1] for row in rows}
    for x in got:
        line = " ".join("".join([c if c.isalpha() else " " for c in (texts[x.doc_id] or "").lower()]).split())
        if not line:
            assert (x.lang_pred, x.score) == ("und", 0.0)
            continue
        counts = sorted((phrases(models[k], line), k) for k in models)
        assert (x.lang_pred, x.characters) == (counts[0][1], len(line))
        assert abs(x.score - (counts[1][0] - counts[0][0]) / counts[1][0]) < 1e-12 and abs(x.rate - counts[0][0] / len(line)) < 1e-12
    clash = df.withColumn("_lang", F.lit("x")).withColumn("_keep", F.lit(True)).withColumn("_keep_", F.lit(2))
    kept = language_id.keep_languages(clash, models)
    assert kept.columns == clash.columns and kept.count() == len(rows) - 3
    script = "".join([chr(0x4E00 + r.randrange(9000)) for _ in range(150)])
    assert language_id.keep_languages(docs(spark, [script, script[:5]]), models).count() == 1


def held_out_accuracy(spark, sf_dir):
    df = language_id.op7_language_id(spark, sf_dir)
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    return df.join(truth, "doc_id").where("held_out AND lang IS NOT NULL").agg(F.avg(F.expr("CAST(lang = lang_pred AS INT)"))).first()[0]


def test_language_id_held_out(spark):
    assert held_out_accuracy(spark, "/root/testdata/sf0.01") > 0.97


def brute_groups(texts, ids):
    sets = []
    for t in texts:
        ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set())
    root = {i: i for i in ids if i is not None}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(zip(ids, sets, strict=True), 2):
        if i is not None and j is not None and a and 100 * len(a & b) >= 75 * len(a | b):
            x, y = sorted((top(i), top(j)))
            root[y] = x
    return sorted(((i, len(s), None if i is None else top(i)) for i, s in zip(ids, sets, strict=True)), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_against_brute_force(spark, seed):
    r = random.Random(seed)
    texts = [None, "", "A b", "a  B", "a b c d", "a b c d e", "a b c d e", "A B C D E"]
    for family in range(5):
        n = r.choice([6, 9, 20, 60, 160])
        base = words(1000 * seed + family, n, 5000).split()
        for _ in range(24):
            copy = list(base)
            for _ in range(r.randrange(0, max(2, n // 12))):
                copy[r.randrange(n)] = f"z{r.randrange(10**6)}"
            texts.append(" ".join(copy[: n - r.randrange(0, max(1, n // 8))]))
    passage = words(77, 60, 5000)
    texts += [f"{words(seed * 50 + k, 60, 5000)} {passage} {words(seed * 70 + k, 50, 5000)}" for k in range(15)]
    texts += [f"dear customer your order has been shipped to k{k}" for k in range(30)] + [f"alpha beta gamma delta eps zeta {k}" for k in range(30)]
    form = words(seed + 5, 40, 5000).split()
    texts += [" ".join([*form[:9], f"n{k}", *form[10:25], f"c{k % 7}", *form[26:]]) for k in range(60)]
    ids = [int(x) for x in r.sample(range(10**6), len(texts))]
    texts += [texts[9], None, texts[12]]
    ids += [ids[9], None, None]  # a repeated row, null ids
    for small, bits in ((64, 32), (4, 32), (4, 3)):  # with three bits signatures of all schemes collide
        got, _ = ngram_join.link_groups(docs(spark, texts, ids).repartition(3), small_bucket=small, bits=bits)
        assert sorted((tuple(x) for x in got.collect()), key=repr) == brute_groups(texts, ids)


def test_signatures_of_other_schemes_take_nothing_away(spark):
    """Entries of one range that agree in the kept bits: each scheme's own pair survives, single ones and lone sides don't."""

    def block(entries):
        sig, doc, need, scheme = (np.array(x, t) for x, t in zip(zip(*entries, strict=True), ("<u4", "<i8", "<u2", "<u2"), strict=True))
        planes = [x.view("u1").reshape(len(entries), -1).T.tobytes() for x in (doc, need, scheme)]
        return bytearray(b"".join((sig.tobytes(), *planes)))

    pair = lambda a, b, side: 2 * (64 * a + b) + side
    band = lambda j, side: 4096 + 4 * j + side
    mark = ngram_join.MARK
    entries = [
        (7, 1, 3, pair(10, 10, 0)), (7, 2, 3, pair(10, 10, 0)), (7, 3, 3, pair(9, 10, 0)),  # a pair, and a lone one of another scheme before it
        (8, 4, 3, pair(9, 10, 0)), (8, 5, 3, pair(9, 10, 1)), (8, 6, 3, pair(10, 10, 0)),
        (9, 7, 3, band(2, 0)), (9, 8, 3, band(2, 1)), (9, 9, 3, band(3, 1)), (9, 10, 3, band(3, 1)),  # two of an upper side meet elsewhere
        (5, 11, 3, pair(9, 10, 1)), (5, mark, 3, pair(9, 10, 1)), (5, 12, 3, band(2, 0)), (5, mark, 3, band(2, 0)),  # hot in two schemes, one of them lacks a side
    ]
    blocks = spark.createDataFrame([(1, block(entries[::2])), (1, block(entries[1::2])), (49, block([(5, 13, 3, pair(9, 10, 1)), (5, 14, 3, band(2, 0))]))], "r long, block binary")
    found = ngram_join._survivors(blocks, 48)
    kept = {(r.doc, r.freq) for r in found.where("freq >= 0").collect()}
    assert kept == {(1, 2), (2, 2), (4, 2), (5, 2), (7, 2), (8, 2), (12, ngram_join.HOT), (13, ngram_join.HOT), (14, ngram_join.HOT)}
    ready = found.withColumn("need", F.lit(1))
    assert {r.doc for r in ngram_join._rarest(ready).collect()} == {1, 2, 4, 5, 7, 8, 12, 14}  # 13's scheme has one side only


def test_large_families_meet_by_rare_features_only(spark):
    """Templated texts of about 30 shingles, 24 of them common: no two are similar, and none meet again."""
    form = words(5, 29, 5000).split()
    texts = [" ".join([*form, *(f"k{k}x{i}" for i in range(6))]) for k in range(4000)]
    r = random.Random(3)
    texts += [" ".join([*t.split()[:-1], "end"]) for t in r.sample(texts, 5)]
    df = docs(spark, texts).repartition(4)
    sets = ngram_join.Shingler().features(texts)
    features = spark.createDataFrame([(i, bytearray(f.tobytes())) for i, f in enumerate(sets)], "doc_id long, f binary")
    met = ngram_join._refined(features, features.select(F.col("doc_id").alias("doc"))).groupBy("sig").agg(F.count("*").alias("m")).where("m > 1")
    assert met.agg(F.max("m")).first()[0] in (2, 3)  # a text, its copy, and another copy with the same end
    got = ngram_join.link_groups(df)[0].where("doc_id <> component_id").count()
    assert got == 5


@pytest.mark.parametrize("n", [1, 2, 5, 30, 31, 200, 1000])
def test_prefixes_of_similar_sets_meet(n):
    r = random.Random(n)
    for _ in range(200):
        b = r.randint(-(-3 * n // 4), 4 * n // 3)
        common = min(n, b, -(-3 * (n + b) // 7))
        if 4 * common < 3 * (n + b - common):
            continue
        universe = r.sample(range(10 * (n + b)), n + b - common)
        x, y = sorted(universe[:n]), sorted(universe[:common] + universe[n:])
        meet = [{(f, low, high): side for low, high, length, side in ngram_join.prefixes(len(z)) for f in z[:length]} for z in (x, y)]
        assert any(meet[0][k] | meet[1][k] == 3 for k in meet[0].keys() & meet[1].keys())


def test_family_blocks_are_bounded_by_rows(spark):
    import tracemalloc

    # nine words, the last one differs: 4 of 6 shingles shared, so all stay single in one family
    shingler = ngram_join.Shingler()
    sets = shingler.features([f"dear customer your order has been shipped to k{k}" for k in range(4000)])
    sets.append(sets[-1])
    features = spark.createDataFrame([(i, bytearray(f.tobytes())) for i, f in enumerate(sets)], "doc_id long, f binary")
    members = spark.range(len(sets)).select(F.col("id").alias("doc"), F.lit(0).alias("family"), F.col("id").alias("c"), F.lit(5).alias("n"))
    placed = ngram_join._blocks(members, features, block_rows=500).groupBy("block").count().collect()
    assert len(placed) >= 9 and max(r["count"] for r in placed) < 700 and sum(r["count"] for r in placed) == len(sets)
    assert [sorted(x) for x in ngram_join._family_links(members, features, block_rows=500).collect()] == [[3999, 4000]]
    at = np.arange(len(sets))
    tracemalloc.start()
    assert ngram_join.links_between((at.tolist(), at.tolist()), (at, at), (sets, sets)) == [(3999, 4000)]
    assert tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.stop()


def test_similar_sets_share_what_they_need():
    """For random pairs at the threshold: a common scheme in which they share each one's need of signatures."""
    r = random.Random(3)
    draw = lambda n: [r.randrange(1 << 64) for _ in range(n)]
    for n in [*range(2, 40), 57, 90, 160, 400, 1500] * 4:
        most = n // 7
        for gone, new in ((most, 0), (0, n // 3), (most, most), (most // 2, most // 3), (r.randint(0, most), r.randint(0, n // 3))):
            x = draw(n)
            y = x[gone:] + draw(new)
            common = n - gone
            if 100 * common < 75 * (n + len(y) - common) or x == y:
                continue
            found = [{s >> 1: (s & 1, need, set(sig.tolist())) for s, need, sig in ngram_join.signatures(np.array(sorted(z), "u8"))} for z in (x, y)]
            shared = [(k, len(found[0][k][2] & found[1][k][2])) for k in found[0].keys() & found[1].keys() if not found[0][k][0] & found[1][k][0]]
            assert any(c >= max(1, *(f[k][1] for f in found)) for k, c in shared), (n, gone, new)


def test_feature_hashes_agree_with_words(monkeypatch):
    """Equal shingles have equal features, others differ, however texts are cut into slices."""
    texts = [None, "", " \n\x0b", "a b c d e", "A\tB c d\x0ce f", "x a b c d e", "a b", "ab", "b a", "é ü a b c d", "k" * 5000 + " a b c d e", words(5, 900, 30), "a\u00a0b c d e f g"]
    whole = ngram_join.Shingler().features(texts)
    monkeypatch.setattr(ngram_join.Shingler, "SLICE", 64)
    assert all(np.array_equal(x, y) for x, y in zip(whole, ngram_join.Shingler().features(texts), strict=True))
    assert all(np.array_equal(x, y) for x, y in zip(whole, [ngram_join.Shingler().features([t])[0] for t in texts], strict=True))
    seen = {}
    for text, f in zip(texts, whole, strict=True):
        ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        grams = {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()
        assert len(f) == len(grams) and sorted(f.tolist()) == f.tolist()
        seen.setdefault(frozenset(grams), set()).add(tuple(f.tolist()))
    assert all(len(v) == 1 for v in seen.values()) and len({tuple(f.tolist()) for f in whole}) == len(seen)


def test_templated_texts_leave_no_candidates(spark):
    """Short texts that differ in one word are all dropped before any bucket; a hot signature stays whole through its salts."""
    for text in ("alpha beta gamma delta eps zeta ", "dear customer your order has been shipped to "):
        df = spark.range(0, 20_000, 1, 3).select("id", F.concat(F.lit(text), F.col("id")).alias("text"))
        ranges = 48
        found = ngram_join._survivors(ngram_join._signature_blocks(df, ranges, 4), ranges)
        assert ngram_join._rarest(found).count() == 0
    df = spark.range(0, 3000, 1, 3).select("id", F.concat(F.lit(words(1, 60) + " "), F.col("id")).alias("text"))
    found = ngram_join._survivors(ngram_join._signature_blocks(df, 48, 4), 48)
    sets = ngram_join.Shingler().features([r.text for r in df.collect()])
    counts = Counter(x for f in sets for _, _, sig in ngram_join.signatures(f) for x in sig.tolist())
    got = found.where(F.col("doc") != ngram_join.MARK).groupBy("sig").agg(F.countDistinct("doc").alias("n"), F.count("*").alias("rows"), F.max("freq").alias("freq")).collect()
    assert sorted(r.n for r in got) == sorted(n for n in counts.values() if n > 1) and all(r.n == r.rows for r in got)
    assert max(r.n for r in got if r.freq == ngram_join.HOT) > 2500
    assert ngram_join.link_groups(df, "id")[0].select("component_id").distinct().count() == 1


def test_may_hold_never_misses(spark):
    from svcgraph.llm.common import may_hold

    df, ids = spark.range(-5000, 5000).select(F.col("id").alias("x")).unionAll(spark.sql("SELECT CAST(NULL AS BIGINT)")), spark.range(-3000, 3000, 7)
    for bits, most in ((22, 60), (15, 3000)):
        told = may_hold(df, "x", ids, bits)
        assert told.where("may").join(ids, F.col("x") == F.col("id")).count() == ids.count() and told.count() == 10_001
        assert told.where("may").count() < ids.count() + most and told.where("x IS NULL AND may").count() == 0
    assert may_hold(df, "x", ids.limit(0)).where("may").count() == 0


def test_components_against_brute_force(spark):
    r = random.Random(2)
    line = list(range(200))
    for edges in ([], [(1, 1)], [(a, a + 1) for a in line], [(r.choice(line), r.choice(line)) for _ in range(150)], [(9, a) for a in line] + [(a + 300, 9 if a % 50 == 0 else a + 299) for a in line]):
        root = {v: v for e in edges for v in e}
        for _ in root:
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        got = {x.id: x.component for x in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {v: c for v, c in root.items() if any(v in e and e[0] != e[1] for e in edges)}


def test_one_of_each_group_and_empty(spark):
    df = docs(spark, ["a b c d e f", "a b c d e f", None, "q", "a b c d e f"], [3, 1, 2, None, 1])
    kept = ngram_join.one_of_each_group(df)
    assert kept.columns == df.columns and sorted((r.doc_id, r.text) for r in kept.where("doc_id IS NOT NULL").collect()) == [(1, "a b c d e f"), (2, None)] and kept.count() == 3
    assert ngram_join.link_groups(df.limit(0))[0].count() == 0
    clash = df.withColumn("_id", F.lit("x")).withColumn("_k", F.lit(1)).withColumn("_t", F.lit(2))
    kept = ngram_join.one_of_each_group(clash)
    assert kept.columns == clash.columns and kept.count() == 3 and {r._id for r in kept.collect()} == {"x"}


PERSONAL = ["mail a.b+c@x-y.co.uk, d@e", "@x.y a@b.c@d.e", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.004", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (017) 555-7713 +12 +1 2", "x" * 200_000 + "@", "9" * 30_000, None, "", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "ü é 1.1.1.1@z.de", "4111 1111 1111 1111 4111"]


def reference_base(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def test_personal_data(spark):
    got = {r.doc_id: r for r in pii.find(docs(spark, PERSONAL)).collect()}
    for i, text in enumerate(PERSONAL):
        if text is not None and len(text) > 10_000:
            continue  # the plain patterns take quadratic time there
        base = reference_base(text or "")
        listed = ",".join(f"{pii.BASE_KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert got[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
        assert set(filter(None, listed.split(","))) <= set(got[i].spans.split(","))
    assert got[9].spans == "secret:9:49" and got[5].spans == got[6].spans == ""


def test_base_spans_on_random_text():
    r = random.Random(9)
    for _ in range(400):
        text = "".join(r.choice("ab1234567890@.+-() é") for _ in range(r.randint(0, 60)))
        assert pii.base_spans(text) == reference_base(text)


def test_crf_on_held_out_examples_and_redaction(spark):
    crf, fresh = pii.model(), pii.examples(200, 99)
    assert sum(set(crf.decode(t, 0, len(t))) == truth for t, truth in fresh) >= 190
    assert pii.redact("a b@c.de f", [(2, 0, 8)]) == "a <EMAIL> f"
    df = docs(spark, PERSONAL)
    out = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert out[7] is None and "@x-y" not in out[0] and pii.redacted(df).columns == df.columns


def test_secrets_of_every_declared_length_are_found():
    r, crf = random.Random(3), pii.model()
    for n in (24, 32, 40, 48, 64):
        for _ in range(100):
            secret = "".join(r.choice("0123456789abcdef") for _ in range(n))
            text = f'the config has token = "{secret}" in it'
            assert (24, 4, 24 + n) in crf.decode(text, 0, len(text)), secret
            base, spans = pii.spans_of(text, crf)
            assert base or (24, 4, 24 + n) in spans  # it gives way to base spans only
    # digits and letters in turn: as many units as characters
    assert pii.spans_of(f'token = "{"a1" * 32}"', crf)[1] == [(9, 4, 73)]


def test_windows_give_the_spans_of_the_whole_text():
    r, crf = random.Random(2), pii.model()
    secret, dotted = "04dbebab91ab85687d33eeaaf9ac699e1188f962", "4111.1111.1111.1111"
    filler = ",".join(f'"{words(k, 1)}":"x"' for k in range(40))  # longer than any field with blanks
    for text, want in (
        (f'{{{filler},"token":"{secret}",{filler}}}', secret), (f'{filler};card="{dotted}";{filler}', dotted),
        (f'{"这是一个没有空格的句子，" * 30}token="{secret}"{"。后面还有更多的文字" * 30}', secret), (f"password for the database is {secret} now", secret),
    ):
        at = text.index(want)
        assert (at, 4 if want == secret else 2, at + len(want)) in pii.spans_of(text, crf)[1]
    parts = ["token", "ip", "monkey", "1", "20", dotted, "@", "a.b@c.de", '"', " ", " ", "  ", "\n", "密码", "éa", ",", ":", "-", "_", "x" * 70, "9" * 30, secret, "(017) 555-7713", "1.2.3.4", "٣", "²", "is"]
    for _ in range(1500):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 60)))
        assert [s for low, high in pii.windows(text) for s in crf.decode(text, low, high)] == crf.decode(text, 0, len(text))


def test_crf_decoding_is_the_best_segmentation():
    crf = pii.model()
    for text in ("tel (017) 555-7713 ab", 'key: "04dbebab91ab85687d33eeaaf9ac699e1188f962"'):
        units = crf.units(text, 0, len(text))
        ends = crf.candidates(text, units)

        def best(j):
            if not j:
                return 0.0
            return max([best(j - 1)] + [best(i) + crf.score(names, k) for i, names in ends[j] for k in range(len(pii.KINDS))])

        got = {(a, b): k for a, k, b in crf.decode(text, 0, len(text))}
        total = sum(crf.score(names, got[units[i][0], units[j - 1][1]]) for j in range(1, len(units) + 1) for i, names in ends[j] if (units[i][0], units[j - 1][1]) in got)
        assert abs(total - best(len(units))) < 1e-9


def test_chat_blocks_equal_one_viterbi(spark, monkeypatch):
    r = random.Random(6)
    rows = []
    for conv in (1, 2, None):
        for turn in range(60 if conv == 1 else 7):
            role = ["user", "assistant"][turn % 2]
            text = words(turn, r.randint(1, 5)) + ("?" if role == "user" else ".")
            if r.random() < 0.2:
                text = f"{role.title()}: {text}\nand more\nAssistant: sure"
            rows.append((conv, turn, role if r.random() < 0.7 else r.choice([None, "narrator"]), text))
    rows += [(3, 0, None, None), (3, None, "user", ""), (3, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("uid", F.lit(0))
    whole = sorted((tuple(x) for x in chat_format.format_turns(df).collect()), key=repr)
    model = chat_format.TurnModel(*chat_format.learn(df))
    for conv in {x[0] for x in rows}:
        mine = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0))
        lines = [f for x in mine for f in chat_format.line_features(x[3], x[2])[0]]
        path = [int(s) for s in model.trace(lines, chat_format.START, int(np.argmax(model.matrix(tuple(lines))[chat_format.START])))]
        firsts = [chat_format.ROLES[s % 3] for s in path if s < 3]
        at, want = 0, []
        for x in mine:
            n = len(chat_format.line_features(x[3], x[2])[0])
            own = path[at : at + n]
            want += [chat_format.ROLES[s % 3] for k, s in enumerate(own) if s < 3 or not k]
            at += n
        assert [t[3] for t in sorted((t for t in whole if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2]))] == want and firsts
    assert chat_format.format_turns(df.limit(0)).count() == 0


def test_chat_block_borders():
    model = chat_format.TurnModel({("user", "assistant"): 9, ("assistant", "user"): 9}, {"user": 9}, {})
    r = random.Random(3)
    seen = [(r.choice([None, "user", "assistant"]), r.random() < 0.7, False, r.random() < 0.3, False) for _ in range(40)]
    parts = [model.matrix(tuple(seen[a : a + 7])) for a in range(0, 40, 7)]
    borders = chat_format.best_borders(parts)
    path = [s for (before, last), a in zip(borders, range(0, 40, 7), strict=True) for s in model.trace(seen[a : a + 7], before, last)]
    score = lambda p: sum(model.step(x)[b, s] for x, b, s in zip(seen, [chat_format.START, *p[:-1]], p, strict=True))
    whole = model.trace(seen, chat_format.START, int(np.argmax(model.matrix(tuple(seen))[chat_format.START])))
    assert abs(score(path) - score(whole)) < 1e-9


def test_chat_paths_against_enumeration():
    """The traced path has the greatest sum of step scores over all paths of states."""
    r = random.Random(8)
    following, first, shapes = {("user", "assistant"): 9, ("assistant", "user"): 7, ("system", "user"): 2}, {"user": 3, "system": 2}, {("user", True, False): 8, ("assistant", False, True): 4}
    model = chat_format.TurnModel(following, first, shapes)
    for _ in range(12):
        lines = [(r.choice([None, *chat_format.ROLES]), r.random() < 0.5, r.random() < 0.2, r.random() < 0.4, r.random() < 0.2) for _ in range(4)]
        steps = [model.step(x) for x in lines]
        worth = lambda path: steps[0][chat_format.START][path[0]] + sum(s[a][b] for s, a, b in zip(steps[1:], path, path[1:], strict=False))  # noqa: B023, E731
        best = max(worth(p) for p in itertools.product(range(chat_format.STATES), repeat=4))
        total = model.matrix(tuple(lines))[chat_format.START]
        got = model.trace(lines, chat_format.START, int(total.argmax()))
        assert abs(worth(got) - best) < 1e-9 and abs(total.max() - best) < 1e-9


def test_chat_counts_against_brute_force(spark):
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", " Human", "GPT", "system", None, "x"]), r.choice([None, "", "why?", "so? ", "no", "y" * 401])) for c in range(20) for t in range(r.randint(1, 6))]
    rows += [(None, 0, "user", "a?"), (3, None, "bot", "b"), rows[0]]
    following, first, shapes = chat_format.learn(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    role = {}
    known = [(c, t, chat_format.marker_role(m), x) for c, t, m, x in rows if chat_format.marker_role(m)]
    for c, t, m, _ in known:
        if c is not None and t is not None:
            role[c, t] = min(m, role.get((c, t), m))
    assert shapes == Counter((m, (x or "").rstrip(" ").endswith("?"), len(x or "") > 400) for _, _, m, x in known)
    assert first == Counter(m for (c, t), m in role.items() if t == 0)
    assert following == Counter((m, role[c, t + 1]) for (c, t), m in role.items() if (c, t + 1) in role)


def test_license_labels_against_brute_force(spark):
    """Added labels and scores: every template at every place, by the definition."""
    r = random.Random(12)
    texts = [None, "", "public license"]
    for k in range(150):
        parts = [words(k, r.randint(0, 6))]
        for _ in range(r.randint(1, 4)):
            line = r.choice(license_scan.TEMPLATES)[1].split()
            if r.random() < 0.5:
                line[r.randrange(len(line))] = r.choice(["license", "mit", "zz", "gnu"])
            if r.random() < 0.3:
                line = line[: r.randint(1, len(line))]
            parts += [r.choice([" ", ". ", "\n", "-"]).join(line).title(), words(k + 1, r.randint(0, 4))]
        texts.append(" ".join(parts))
    texts.append(words(3, 30_000) + " " + license_scan.TEMPLATES[0][1])
    ids = [None, *range(1, len(texts))]
    df = docs(spark, [*texts, texts[5]], [*ids, 5]).withColumn("word", F.lit(1)).withColumn("df", F.lit(1))
    got = sorted(license_scan.scan(df).collect(), key=lambda x: (x.doc_id is not None, x.doc_id))
    assert len(got) == len(texts) + 1
    for x in got:
        ws = re.findall("[0-9a-z\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (texts[x.doc_id or 0] or "")))
        labels, best = {v for k, v in license_scan.BASE.items() if f" {k} " in f" {' '.join(ws)} "}, 0.0
        best = float(bool(labels))
        for label, template, phrases in license_scan.TEMPLATES:
            t = template.split()
            for start in range(-len(t), len(ws)):
                inside = lambda i: 0 <= start + i < len(ws) and ws[start + i] == t[i]  # noqa: B023, E731
                score = sum(inside(i) for i in range(len(t))) / len(t)
                if score < 0.75:
                    continue
                where = [next(i for i in range(len(t)) if t[i : i + len(p.split())] == p.split()) for p in phrases]
                if all(inside(i + k) for i, p in zip(where, phrases, strict=True) for k in range(len(p.split()))):
                    labels.add(label)
                    best = max(best, score)
        assert x.labels == ",".join(sorted(labels)) and abs(x.score - best) < 1e-12 and x.n_words == len(ws)


def test_shards_are_read_in_a_task_each(spark):
    folder = scratch_path(spark, "records")
    df = docs(spark, [words(k, 30) for k in range(60)]).repartition(4)
    with_shards = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    manifest = binary_records.write_tokens(df, folder)
    spark.conf.set("spark.sql.adaptive.enabled", with_shards)
    assert manifest.count() == 4 and binary_records.read_shards(manifest, folder).select(F.spark_partition_id()).distinct().count() == 4


def test_archives_of_two_attempts(spark):
    """A partition that runs twice, in another order, leaves two files; each run's captures read back from its own."""
    pages = spark.createDataFrame([(i, f"http://a.b/{i}", f"<p>{i}" * (i + 1)) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    folder = scratch_path(spark, "warc")
    runs = [warc.write_archives(warc.typed(pages).coalesce(1).sortWithinPartitions(order), folder, "2024-01-01T00:00:00Z").collect() for order in (F.asc("page_id"), F.desc("page_id"))]
    assert len({r.file for run in runs for r in run}) == 2
    index = warc.CaptureIndex(folder, [])
    for run in runs:
        for r in run:
            assert index.record(r.file, r.at, r.size)[0] == r.page_id
    manifest = warc.archive(pages.repartition(3), scratch_path(spark, "warc2"))
    assert manifest.count() >= 1


def test_hot_payloads_are_salted_by_their_rows(spark):
    pages = spark.range(1000).select(F.col("id").alias("page_id"), F.lit("http://a.b/").alias("url"), F.when(F.col("id") < 900, "hot").when(F.col("id") < 990, "warm").otherwise(F.col("id").cast("string")).alias("html"))
    for share in (50, 10**6):
        got = {r.page_id: r.refers_to for r in warc.typed(pages, share=share).collect()}
        assert got == {i: 899 if i < 899 else 989 if 900 <= i < 989 else None for i in range(1000)}


def test_personal_data_recall_by_kind():
    """Planted spans of each kind, found exactly; look-alikes; and the time of unbroken runs."""
    import time

    crf, r = pii.model(), random.Random(99)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    any_, hexa = upper + upper.lower() + "0123456789", "0123456789abcdef"
    some = lambda of, n: "".join([r.choice(of) for _ in range(n)])
    number = lambda: f"{r.randint(200, 999)}-{some(hexa[:10], 3)}-{some(hexa[:10], 4)}"
    prose = lambda: " ".join(r.choices("the quick house river small table deploy notes about yesterday were good".split(), k=4))
    kinds = {
        "hex with cue": lambda: ('token = "', some(hexa, r.choice([40, 64])), '"', 4), "letters and digits": lambda: ("", some(any_, 40), "", 4), "prefixed": lambda: ("", "ghp_" + some(any_, 36), "", 4),
        "base64 with cue": lambda: ("key=", f"{some(any_ + '+/', 20)}/{some(any_, 22)}=", "", 4), "base64": lambda: ("", f"A{some(any_ + '+/', 20)}+{some(any_, 21)}==", "", 4),
        "number": lambda: ("", number(), "", 3), "number after Chinese": lambda: ("\u6211\u4eec\u7684\u7535\u8bdd\u662f", number(), "\u8054\u7cfb", 3),
    }
    for name, make in kinds.items():
        hits = 0
        for _ in range(100):
            cue, span, after, kind = make()
            before = f"{prose()} {cue}"
            hits += (len(before), kind, len(before) + len(span)) in pii.spans_of(f"{before}{span}{after} {prose()}", crf)[1]
        assert hits >= 87, name
    clean = [lambda: some(hexa, 40), lambda: "-".join(some(hexa, k) for k in (8, 4, 4, 4, 12)), lambda: f"get{prose().title().replace(' ', '')}{some(hexa[:10], 2)}", lambda: f"{prose().replace(' ', '-')}-2021", lambda: f"{prose().replace(' ', '/')}7", lambda: f"IMG_{some(hexa[:10], 8)}_{some(hexa[:10], 6)}"]
    for make in clean:
        assert sum(bool(pii.spans_of(f"{prose()} {make()} {prose()}", crf)[1]) for _ in range(100)) <= 3
    began = time.process_time()
    for block in ("a1", "1,", "a1 "):
        pii.spans_of(block * 20_000, crf)
    assert time.process_time() - began < 20


def test_signature_blocks_stay_small(spark):
    """An entry takes about six bytes once compressed, also where many ranges leave few entries to a block; needs go once a set and scheme."""
    import pyarrow as pa

    df = spark.range(0, 3000, 1, 1).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(150)), lambda k: F.xxhash64("id", k).cast("string")), " ").alias("text"))
    sets = ngram_join.Shingler().features([r.text for r in df.collect()])
    entries = sum(len(sig) for f in sets for _, _, sig in ngram_join.signatures(f))
    rows = ngram_join._signature_blocks(df, 1000, 1).collect()
    assert len(pa.compress(b"".join(bytes(r[1]) for r in rows), "lz4", asbytes=True)) < 6.3 * entries
    assert sum(len(r[1]) for r in rows if r.r < 0) == ngram_join.NEEDS_ENTRY * sum(len(ngram_join.signatures(f)) for f in sets)
    r = np.random.default_rng(1)
    sig, doc, scheme = r.integers(0, 1 << 62, 500, "u8"), np.append(np.sort(r.integers(-(1 << 62), 1 << 62, 499)), ngram_join.MARK), r.integers(0, 5000, 500).astype("u2")
    for bits in (3, 24, 32):
        got = ngram_join._unpacked(np.frombuffer(ngram_join._packed(sig, doc, scheme, bits), "u1"))
        assert all(np.array_equal(x, y) for x, y in zip(got, (sig & np.uint64((1 << bits) - 1), doc, scheme), strict=True))
