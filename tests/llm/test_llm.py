"""Operators against brute force, on small tables with nulls, ties, repeats and long texts."""

import hashlib
import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter
from contextlib import ExitStack
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cloakframe.llm import counts, dac, language, lines, minhash, packing, pieces, tokens, topk, vectors, warc
from cloakframe.llm.components import components
from cloakframe.llm.tokens import default_path

BPE, SP = default_path("byte_bpe_50k.json"), default_path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n", "a", "  dos  espacios ", "línea\n\notra\tmás ², ½ x²", "<|endoftext|> fin", "▁a ▁▁ b", "漢字 ﬁ 😀 x", "it's 'stand' 123abc", "<s> <0x0A>", "x" * 5000, "\x00\x85"]
DOCS = "doc_id long, text string"


def documents(spark, extra=()):
    return spark.createDataFrame([*enumerate(ODD), (3, "otra fila con el mismo id"), (None, "sin id"), *extra], DOCS).withColumn("d", F.lit(1)).withColumn("key", F.lit(2))


def test_word_encoder_is_the_library():
    e = tokens.encoder(BPE)
    for t in filter(None, ODD):
        assert e.encode(t).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_pieces_are_the_librarys(spark):
    t = pieces.table(SP)
    rng, parts = random.Random(3), [" ", "  ", "a", "the", "ing", "\n", "é", "▁", "😀", "1", "in", "執"]
    for text in [*filter(None, ODD), *["".join(rng.choices(parts, k=15)) for _ in range(2000)]]:
        ids = t.library.encode(text)
        assert t.encode(text).tolist() == ids and t.decode(np.array(ids)) == t.library.decode(ids)
    rows = pieces.encode_decode(documents(spark), SP, with_ids=True).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        assert r.ids[0] == 1 and r.ids[-1] == 2 and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() and r.decoded == t.library.decode(r.ids)
    assert pieces.encode_decode(documents(spark).limit(0), SP).count() == 0
    bad = [t.bytes[0xC3], t.id["a"]]
    assert t.decode(np.array(bad)) == t.library.decode(bad)


def test_counts_are_the_librarys(spark):
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram

    v = counts.vocabulary(SP)
    for fallback in (True, False):
        lib, own = Tokenizer(Unigram(v, 0, fallback)), counts.UnigramCounter(v, fallback)
        for text in filter(None, ODD):
            assert own.text(text) == len(lib.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids), text
    got = {r.doc_id: r.n_tokens for r in counts.token_counts(documents(spark), SP).filter("doc_id <> 3").collect()}
    assert got[0] == 0 and got[1] == 0 and got[4] == 1


def test_dac_files(spark):
    rng = np.random.default_rng(1)
    for ids in (np.array([], np.uint32), rng.integers(0, 70000, 3000).astype(np.uint32), np.array([0, 255, 256, 65536, 2**31], np.uint32)):
        for bits in (8, 16):
            f = dac.DacFile(dac.to_bytes(np.array([5]), np.array([len(ids)]), ids, bits))
            assert f.tokens(0, len(ids)).tolist() == ids.tolist() and [f.token(i) for i in range(len(ids))] == ids.tolist()
            assert f.tokens(700, 1500).tolist() == ids[700:1500].tolist()
            assert [x.tolist() for _, _, x in f.documents(0, 1)] == [ids.tolist()]
    read = []
    data = dac.to_bytes(np.arange(1000), np.full(1000, 100), rng.integers(0, 50_000, 100_000).astype(np.uint32))
    f = dac.DacFile(lambda at, n: read.append(n) or memoryview(data)[at : at + n])
    f.token(77_777)
    assert len(list(f.documents(500, 510))) == 10 and sum(read) < 6000
    docs = documents(spark)
    e, at = tokens.encoder(BPE), 0
    want = []
    for d, t in sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = [*e.encode(t).tolist(), 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4"))))
        at += len(ids)
    for size in (10, 4_000_000):
        back = dac.read_ids(dac.write_ids(docs.repartition(3), BPE, file_ids=size), task_ids=50)
        rows = back.collect()
        assert size == 10 or back.rdd.getNumPartitions() > 5
        assert sorted(map(tuple, rows), key=lambda r: r[1]) == want
    assert dac.read_ids(dac.write_ids(docs.limit(0), BPE)).count() == 0


def test_packing_documents(spark):
    docs = documents(spark, [(100 + i, "palabra " * i) for i in range(0, 3000, 97)])
    rows = packing.pack_documents(docs, BPE, with_ids=True).collect()
    e = tokens.encoder(BPE)
    want = sorted([*e.encode(r.text).tolist(), 1] for r in docs.collect())
    by, seqs = {}, {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4")) and len(r.ids) == r.length
        by.setdefault(r.doc_id, []).append(r)
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    lengths = [sum(n for _, n in s) for s in seqs.values()]
    assert all(n == 2048 or n & (n - 1) == 0 for n in lengths)
    single = {d: rs for d, rs in by.items() if d not in (3, None)}
    for d, rs in single.items():
        ids = [i for r in sorted(rs, key=lambda r: r.start) for i in r.ids]
        assert ids in want and len(ids) == rs[0].doc_tokens


def test_packing_limits(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(1, 900), None) for i in range(400)] + [(999, None, None), (998, 0, 0)]
    rows = [(i, n, None if n is None else rng.randrange(0, n + 1)) for i, n, _ in rows]
    limits = packing.Limits(1000, 4, 600)
    rows = [(i, n, min(loss, 600) if loss is not None else None) for i, n, loss in rows]
    out = packing.pack_examples(spark.createDataFrame(rows, "example_id int, n_tokens int, n_loss int"), limits).collect()
    size = {i: (n, loss) for i, n, loss in rows}
    assert sorted(r.example_id for r in out) == sorted(i for i, n, _ in rows if n)
    for s in {r.sequence_id for r in out}:
        own = [r.example_id for r in out if r.sequence_id == s]
        assert len(own) <= 4 and sum(size[i][0] for i in own) <= 1000 and sum(size[i][1] for i in own) <= 600


def test_warc(spark):
    html = ["<p>" + "ab" * 60, None, "", "corto", "<p>" + "ab" * 60, "ñ" * 80, "corto", "ñ" * 80]
    rows = [(9 - i, f"http://x/{i}?a=%20 b\r\n", h) for i, h in enumerate(html)] + [(9, None, html[0]), (None, "u", html[0])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    index = warc.write_archives(pages, file_bytes=500)
    got = warc.read_records(index, with_payload=True).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.payload is None or hashlib.sha256(r.payload).hexdigest() == r.payload_digest
    kinds = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got}
    assert (9, "revisit", 5, 123) in kinds and (5, "response", None, 123) in kinds and (6, "response", None, 5) in kinds and (4, "revisit", 2, 160) in kinds
    assert {r.url for r in got} == {r[1] for r in rows}
    many = warc.read_records(index, task_bytes=300)
    assert many.rdd.getNumPartitions() > 3 and sorted(map(str, many.collect())) == sorted(map(str, warc.read_records(index).collect()))
    clashing = pages.select("*", *[F.lit(1).alias(c) for c in ("digest", "path", "offset", "refers_to", "first", "n")])
    assert warc.read_records(warc.write_archives(clashing)).count() == len(rows) and warc.read_records(warc.write_archives(pages.limit(0))).count() == 0
    one = warc.read_records(index.filter("page_id = 4")).collect()
    assert [r.refers_to for r in one] == [2]
    assert list(warc.ranges(iter([("a", 0, 5), ("a", 5, 5), ("a", 99, 1), ("b", 0, 1)]), 50, 10)) == [("a", 0, 10, [(0, 5), (5, 5)]), ("a", 99, 100, [(99, 1)]), ("b", 0, 1, [(0, 1)])]


def test_language(spark):
    words = {"en": "the house and of with".split(), "es": "la casa que del con".split()}
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(words[lang], k=12)), lang) for i, lang in enumerate(["en", "es"] * 60)]
    docs = spark.createDataFrame([*rows, (None, "la casa", None), (500, None, "es"), (501, "123 ² !", "es")], "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("x"))
    model = language.train(docs)
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert len(got) == 123 and all(got[i].lang_pred == lang for i, _, lang in rows) and got[None].lang_pred == "es"
    assert got[500].lang_pred == got[501].lang_pred == "und" and got[501].lang_score == 0
    assert model.score("casas") != [0.0, 0.0] and language.train(docs.limit(0)).languages == []
    held = {r.doc_id for r in docs.filter(language.held_out()).collect()}
    assert held == {i for i in [*range(120), 500, 501] if zlib.crc32(str(i).encode()) % 4 == 2}


def test_language_against_brute_force(spark):
    rng = random.Random(12)
    vocab = {lang: ["".join(rng.choices(letters, k=rng.randrange(1, 7))) for _ in range(30)] for lang, letters in {"aa": "abcde", "bb": "cdefg", "cc": "efghi"}.items()}
    rows = [(i, " ".join(rng.choices(vocab[lang], k=rng.randrange(1, 9))) + rng.choice(["", " 12 ", "\n!", " zzz ", " abé"]), lang if i % 9 else None) for i in range(150) for lang in [rng.choice(["aa", "bb", "cc"])]]
    rows += [(200, "ab " * 20_000, "aa"), (201, "ab " * 20_000, "aa"), (202, None, "aa"), (203, "", None), (204, " 1 ", "bb"), (205, "q x", None), (None, "abc", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("found", F.lit(1)).withColumn("_found", F.lit(2))
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    grams = lambda w, n: [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)] if n > 1 else list(w)
    learned = [(t, lang) for i, t, lang in rows if i is not None and lang and words(t) and zlib.crc32(str(i).encode()) % 4 != 2]
    langs = sorted({lang for _, lang in learned})
    seen = [{lang: Counter() for lang in langs} for _ in range(2)]
    for t, lang in learned:
        for w in words(t):
            seen[0][lang][w] += 1
            seen[1][lang].update(g for n in range(1, 5) for g in grams(w, n))
    known = [set().union(*by.values()) for by in seen]
    logs = lambda kind, item: [math.log(by[item] + 0.2) - math.log(sum(by.values()) + 0.2 * len(known[kind])) for by in seen[kind].values()]

    def score(w):
        if w in known[0]:
            return logs(0, w)
        for n in range(4, 0, -1):
            if found := [logs(1, g) for g in grams(w, n) if g in known[1]]:
                return [sum(x) / n for x in zip(*found, strict=True)]
        return [0.0] * len(langs)

    got = language.predict(docs, language.train(docs, language.Settings(sample=100_000)))
    assert got.columns == [*docs.columns, "lang_pred", "lang_score"] and got.filter("found = 1 AND _found = 2").count() == len(rows)
    by_text = {r.text: r for r in got.collect()}
    for _, t, _ in rows:
        if not words(t):
            assert by_text[t].lang_pred == "und" and by_text[t].lang_score == 0
            continue
        total = [math.log(sum(x == lang for _, x in learned) / len(learned)) for lang in langs]
        for w in words(t):
            total = [a + b for a, b in zip(total, score(w), strict=True)]
        odds = [math.exp(x - max(total)) for x in total]
        assert by_text[t].lang_pred == langs[total.index(max(total))] and abs(by_text[t].lang_score - 1 / sum(odds)) < 1e-6
    # a tie goes to the first language by name
    even = spark.createDataFrame([(4 * k + j, "uno dos", lang) for k in range(8) for j, lang in enumerate(["yy", "xx", "yy", "xx"])], "doc_id long, text string, lang string").filter(~language.held_out())
    both = even.groupBy("lang").count().collect()
    n = min(r["count"] for r in both)
    even = even.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).filter(f"k <= {n}")
    assert {r.lang_pred for r in language.predict(even, language.train(even)).collect()} == {"xx"}
    assert language.predict(docs.limit(0), language.train(docs)).count() == 0 and "ArrowEvalPython" in (plan := got.filter("lang_pred <> 'und'")._jdf.queryExecution().executedPlan().toString()) and plan.count("ArrowEvalPython") == 1


def test_language_sample_has_every_label(spark):
    words = {"en": "the house and of with".split(), "es": "la casa que del con".split(), "fr": "une maison et dans avec".split(), "xx": ["12", "3"]}
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices(words[lang], k=12)), lang) for i, lang in enumerate(["en", "es"] * 400 + ["fr"] * 9 + ["xx"] * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for settings in (language.Settings(sample=8, least=1), language.Settings(sample=8)):
        model = language.train(docs, settings)
        got = {r.doc_id: r.lang_pred for r in language.predict(docs, model).collect()}
        assert model.languages == ["en", "es", "fr"]
        assert got == {i: lang if lang != "xx" else "und" for i, _, lang in rows}


def test_language_learns_every_label(spark, monkeypatch):
    rows = [(i, " ".join(f"{a}{b}" for a in ["uno", "dos", "tres"] for b in [chr(97 + k // 16) + chr(97 + k % 16)] * 2), f"l{k:03}") for i in range(250 * 12) for k in [i % 250]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    assert model.languages == [f"l{k:03}" for k in range(250)]
    assert {r.doc_id: r.lang_pred for r in language.predict(docs, model).collect()} == {i: lang for i, _, lang in rows}
    whole = [language._Worker(model).predict(t) for _, t, _ in rows[:9]]
    monkeypatch.setattr(language, "CELLS", 500)
    few = language._Worker(model)
    assert [x[0] for x in whole] == [few.predict(t)[0] for _, t, _ in rows[:9]] and len(few.words) <= 4


def links(rows, near):
    """Components by all pairs."""
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    n = dict.fromkeys(root, 0)
    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if near(a, b):
                n[i], n[j] = n[i] + 1, n[j] + 1
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in root}, n


@pytest.mark.parametrize("small", [2, 32])
def test_minhash_against_all_pairs(spark, small):
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.choice([3, 20, 120]))) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate([None, "", "uno dos", "UNO  dos", "tres"])]
    for t in base:
        for _ in range(12):
            w = t.split()
            for _ in range(rng.randrange(0, 1 + len(w) // 18)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(9999)}"
            rows.append((len(rows) + 10, " ".join(w)))
    s = minhash.Settings(small=small, tile=16)

    def shingles(t):
        w = t.encode().lower().split() if t else []
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set())

    comp, _ = links([(i, shingles(t)) for i, t in rows], lambda a, b: bool(a | b) and 100 * len(a & b) >= 80 * len(a | b))
    docs = spark.createDataFrame([*rows, (None, base[0])], DOCS).withColumn("key", F.lit(1))
    got = minhash.near_duplicates(docs, s).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(shingles(dict(rows)[r.doc_id])), comp[r.doc_id], comp[r.doc_id] == r.doc_id)
        else:
            assert r.kept and r.component_id is None
    assert minhash.near_duplicates(docs.limit(0), s).count() == 0
    kept = {r.doc_id for r in minhash.keep_one(docs, s).collect()}
    assert kept == {i for i in comp if comp[i] == i} | {None}


def test_minhash_with_repeated_ids_and_long_texts(spark):
    rng = random.Random(15)
    one, two, three = (" ".join(f"{c}{rng.randrange(9999)}" for _ in range(60)) for c in "abc")
    long = " ".join(f"w{rng.randrange(99_999)}" for _ in range(60_000))
    rows = [(5, one), (5, two), (5, two), (7, one + " x"), (9, two + " y"), (11, three), (13, long), (14, long + " z"), (15, "")]
    docs = spark.createDataFrame(rows, DOCS).select("*", *[F.lit(1).alias(c) for c in ("h1", "set", "kept", "component_id", "rid")])
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == {(5, 5, True), (7, 5, False), (9, 5, False), (11, 11, True), (13, 13, True), (14, 13, False), (15, 15, True)}
    assert minhash.keep_one(docs).columns == docs.columns


def test_lines_against_all_pairs(spark):
    rng = random.Random(6)
    vocab = [f"p{i}" for i in range(40)]
    texts = ["\n".join(" ".join(rng.choices(vocab, k=rng.choice([1, 2, 6, 9]))) for _ in range(6)) for _ in range(25)]
    texts += [texts[0], texts[1].upper(), "", "\n\n", " \t\n" + texts[2], " ".join(vocab * 3), " ".join([*vocab[:38], "zz"])]
    rows = [*enumerate(texts), (90, None)]
    docs = spark.createDataFrame([*rows, (None, texts[0])], DOCS).withColumn("n_lines", F.lit(-1))
    got = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    seen, words = [], lambda x: {w for w in re.split("[\x20\x09-\x0d]+", x.lower()) if w}
    for i, t in rows:
        if t is None:
            assert got[i].text is None and got[i].n_lines == 0
            continue
        keep = []
        for x in t.split("\n"):
            s = words(x)
            if not (s and any(100 * len(s & y) >= 80 * len(s | y) for y in seen)):
                keep.append(x)
            if s:
                seen.append(s)
        assert got[i].text == "\n".join(keep) and got[i].n_removed == len(t.split("\n")) - len(keep)
    assert got[None].text == texts[0] and got[None].n_removed == 0
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_lines_with_clashing_columns_and_repeated_ids(spark):
    names = ["kept", "_lines", "_stay", "_d", "own", "_own", "d", "at", "gone", "n", "k", "open"]
    one, two = "uno dos tres cuatro cinco", "seis siete ocho nueve diez"
    rows = [(1, f"{one}\n{two}"), (2, two), (2, f"aparte\n{one} "), (2, two), (3, "x " * 50_000 + "\n" + " ".join(f"w{i}" for i in range(20_000))), (4, " ".join(f"w{i}" for i in range(19_999)) + "\n\n \t\r\n"), (5, "")]
    docs = spark.createDataFrame(rows, DOCS).select("*", *[F.lit(c).alias(c) for c in names])
    got = lines.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", *names, "n_lines", "n_removed"]
    found = sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect())
    want = [(1, rows[0][1], 2, 0), (2, "", 1, 1), (2, "", 1, 1), (2, "aparte", 2, 1), (3, rows[4][1], 2, 0), (4, "\n \t\r\n", 4, 1), (5, "", 1, 0)]
    assert found == want and got.filter(F.col("kept") != "kept").count() == 0
    with_columns = lines.dedup_lines(docs.limit(0)).columns
    assert with_columns == got.columns


def test_line_join_in_passes(spark, monkeypatch):
    rng = random.Random(12)
    vocab = [f"p{i}" for i in range(60)]
    texts = ["\n".join(" ".join(rng.choices(vocab, k=rng.choice([6, 9, 14]))) for _ in range(6)) for _ in range(40)]
    docs = spark.createDataFrame([*enumerate(texts), *enumerate(texts[:5], 50)], DOCS)
    seen, real = [], lines.prefix_rows

    def rows(classes, turn):
        found = real(classes, turn)
        seen.append({(r.k, r.d, r.at) for r in found.collect()})
        return found

    monkeypatch.setattr(lines, "prefix_rows", rows)
    got = sorted(map(tuple, lines.dedup_lines(docs).collect()))
    # no pass holds more than about its share of the rows, and all of them are in one pass each
    total = set().union(*seen)
    assert sum(map(len, seen)) == len(total) > 500
    assert len(seen) > 1 and max(map(len, seen)) < 0.75 * len(total)
    monkeypatch.setattr(lines, "PASSES", 1)
    assert sorted(map(tuple, lines.dedup_lines(docs).collect())) == got and set().union(*seen[2:]) == total


def test_long_lines_and_any_order_of_tokens(spark, monkeypatch):
    rng = random.Random(21)
    base = [[f"w{rng.randrange(400)}" for _ in range(k)] for k in (50, 60, 64, 65, 66, 72, 90)]
    texts = ["\n".join(" ".join(w if rng.random() > rng.choice([0, 0.05, 0.1]) else f"x{rng.randrange(400)}" for w in x[: len(x) - rng.randrange(12)]) for x in rng.choices(base, k=4)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    seen, want = [], []
    for i, t in enumerate(texts):
        keep = []
        for x in t.split("\n"):
            s = set(x.split(" "))
            if not any(100 * len(s & y) >= 80 * len(s | y) for y in seen):
                keep.append(x)
            seen.append(s)
        want.append((i, "\n".join(keep) if len(keep) < 4 else t, 4, 4 - len(keep)))
    assert 0 < sum(x[3] for x in want) < 160
    # rarity counted on a sample, on all documents and on none: the same lines
    counted = []
    for sample in (lines.SAMPLE, 1, 1 << 30):
        monkeypatch.setattr(lines, "SAMPLE", sample)
        counted.append(lines.counted(docs).count())
        assert sorted(map(tuple, lines.dedup_lines(docs).collect())) == want
    assert counted[0] < 20 and counted[1:] == [40, 0]


def test_rarity_counts_every_document(spark):
    docs = spark.createDataFrame([(i, "uno") for i in range(40)], DOCS)
    rank = spark.range(1).select(lines.rarity(docs)[lines.counter(F.xxhash64(F.lit("uno")))].cast("int")).first()[0]
    assert rank == 10  # two for each doubling of 40


def test_line_plans_are_small_and_texts_are_split_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"uno dos tres cuatro cinco seis\nsiete ocho nueve p{i}") for i in range(20)], DOCS)
    plans, real = [], lines.written

    def written(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, name)

    monkeypatch.setattr(lines, "written", written)
    assert lines.dedup_lines(docs).agg(F.sum("n_removed")).first()[0] == 19
    # the driver describes a plan anew for each of its stages: the table of ranks is in one plan without shuffles
    large = [(name, plan) for name, plan in plans if len(plan) > lines.COUNTERS]
    assert [name for name, _ in large] == ["lines"] and "Exchange" not in large[0][1]
    assert "split(line" not in large[0][1] and sum(name == "line-words" for name, _ in plans) == 1


def test_line_hashes_are_made_once_and_without_dictionaries(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"uno dos tres cuatro cinco seis\nsiete ocho nueve diez once p{i}") for i in range(20)], DOCS)
    kinds, real = {}, lines.written

    def written(df, name):
        table = real(df, name)
        files = [pq.ParquetFile(f).metadata for f in Path(table.written_at.removeprefix("file://")).glob("*.parquet")]
        kinds.setdefault(name, set()).update(e for m in files for g in range(m.num_row_groups) for c in range(m.num_columns) for e in m.row_group(g).column(c).encodings)
        return table

    monkeypatch.setattr(lines, "written", written)
    assert lines.dedup_lines(docs).agg(F.sum("n_removed")).first()[0] == 19
    for name in ("line-words", "lines", "line-classes"):
        assert kinds[name] and not any("DICTIONARY" in e for e in kinds[name])
    # a line that is on several sides of pairs is split and hashed before it is sent to them
    pairs = spark.createDataFrame([(2, 0, 1, 0)], "d long, at long, y_d long, y_at long")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    with ExitStack() as stack:
        before = {k: spark.conf.get(k) for k in settings}
        for k, v in settings.items():
            spark.conf.set(k, v)
            stack.callback(spark.conf.set, k, before[k])
        for marks in (False, True):
            found = lines.verified(pairs, docs, lines.Settings(), marks)
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert plan.count("array_distinct(") == 1 and "ReusedExchange" in plan
        assert [tuple(r) for r in lines.verified(pairs, docs, lines.Settings(), False).collect()] == [(2, 0)]


def test_line_join_work_is_not_done_twice(spark):
    docs = spark.createDataFrame([(1, "uno dos tres"), (2, "uno dos tres cuatro")], DOCS)
    ranks = lines.rarity(docs)
    found = lines.measured(docs, ranks, lines.Settings(), False).withColumn("open", F.col("d") > 1)
    assert not lines.with_sets(lines.lines_of(docs, False), ranks).schema["t"].dataType.containsNull  # sorted as plain numbers
    table = lines.written(found, "line-classes")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(before, ("false", "-1")):
            spark.conf.set(k, v)
        plan = lines.prefix_pairs(lines.prefix_rows(table, 0), lines.Settings())._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "SortMergeJoin" in plan and "ReusedExchange" in plan  # both sides of the join


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((12, 16))
    rows = []
    for i in range(150):
        v = base[i % 12] + rng.standard_normal(16) * rng.choice([0, 0.02, 0.1, 0.2])
        rows.append((i, (v * rng.choice([1, 7])).astype(np.float32).tolist(), i % 2))
    odd = [(200, None, 0), (201, [0.0] * 16, 0), (202, [None] + [1.0] * 15, 0), (203, [float("nan")] * 16, 0), (204, rows[0][1], None), (205, [1.0], 0), (206, [2.0], 0), (207, [], 1)]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>, label int").withColumn("block", F.lit(1))

    def near(a, b):
        x, y = np.array(a[0]), np.array(b[0])
        return a[1] == b[1] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93

    want, n = links([(i, (v, k)) for i, v, k in [*rows, *odd[5:7]]], near)
    got = {r.vec_id: r for r in vectors.near_duplicates(df).collect()}
    assert len(got) == len(rows) + len(odd)
    for i in want:
        assert (got[i].component_id, got[i].n_links) == (want[i], n[i])
    assert all(got[i].n_links == 0 and got[i].kept for i in (200, 201, 202, 203, 204, 207))
    assert vectors.near_duplicates(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.01], 0), (1, [1.0, 0.01], 0), (2, [1.0, 0.02], 0), (3, [0.0, 1.0], 0), (3, None, 0), (4, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    twice = twice.select("*", *[F.lit(1).alias(c) for c in ("rid", "weight", "cell", "able", "kept")])
    found = sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.near_duplicates(twice).collect())
    assert found == [(1, 1, 1)] * 3 + [(2, 1, 1), (3, 0, 3), (3, 0, 3), (4, 0, 4)]


def test_top_k_against_all_pairs(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (np.round(rng.standard_normal(8) * 4) / 4).tolist()) for i in range(130)] + [(200 + i, [1e30] * 8) for i in range(2)]
    odd = [(50_000, None), (50_050, [float("inf")] * 8), (300, [1.0]), (350, [2.0])]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>").withColumn("dim", F.lit(1))
    got = {}
    for r in topk.search(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    cap = lambda x: max(-(2**63), min(2**63 - 1, x))
    ints = {i: [int(np.floor(x * 256)) if abs(x) < 1e15 else int(x) * 256 for x in v] for i, v in [*rows, *odd[2:]]}
    for q in (i for i in ints if i % 50 == 0):
        scores = sorted(((-cap(sum(a * b for a, b in zip(ints[q], v, strict=True))), i) for i, v in ints.items() if i != q and len(v) == len(ints[q])))
        assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])]
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 2.0]), (0, [1.0, 0.0]), *((i, [i / 9, 1.0]) for i in range(1, 9))], "vec_id long, embedding array<double>")
    twice = twice.select("*", *[F.lit(1).alias(c) for c in ("qb", "vb", "cutoff", "query_id", "rank")])
    assert [(r.vec_id, r.score) for r in topk.search(twice, F.col("vec_id") == 0).orderBy("rank").collect()] == [(i, sum(int(256 * x) * y for x, y in zip((i / 9, 1.0), (256, 0), strict=True))) for i in range(8, 3, -1)]


@pytest.mark.parametrize("rows", [7, 8192])
def test_top_k_over_blocks(spark, monkeypatch, rows):
    monkeypatch.setattr(topk, "ROWS", rows)
    monkeypatch.setattr(topk, "QUERIES", rows)
    rng = np.random.default_rng(10)
    x = rng.integers(-3, 4, (200, 6)) / 2
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.search(df, F.col("vec_id") % 10 == 0).collect()}
    ints = np.floor(x * 256).astype(int)
    for q in range(0, 200, 10):
        best = sorted((-int(ints[q] @ ints[i]), i) for i in range(200) if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="reads the memory from Linux")
def test_a_turn_gives_freed_memory_back():
    """Blocks below the allocator's limit for single mappings, with small ones between them that stay."""
    code = """
import re
from cloakframe.llm import shared
import pyarrow

def own():
    return sum(map(int, re.findall("Anonymous: +([0-9]+)", open("/proc/self/smaps_rollup").read()))) / 1024

shared.take_turn("one", lambda: held.clear())
before, held, stay = own(), [], []
for i in range(60_000):
    held.append(bytearray(2000))
    if i % 100 == 0:
        stay.append(bytearray(600))
assert own() - before > 100
shared.take_turn("two", None)
assert own() - before < 30, own() - before
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=60)
    assert done.returncode == 0, done.stderr


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}
