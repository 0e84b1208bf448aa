import os
import random
import re

import pytest

from cloakframe.llm import shared

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the driver's tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared.written(stage(spark, docs, SF), name)
        assert docs.columns == corpus_pipeline.COLUMNS
        now = {r.doc_id: r.text for r in docs.collect()}
        if name == "language_id":
            assert now == {i: t for i, t in texts.items() if any(c.isalpha() for c in t or "")}
        else:
            assert set(now) <= set(texts)
        texts = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(texts)


def words_of(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", (text or "").lower()) if w]


def alike(a, b):
    return bool(a | b) and 100 * len(a & b) >= 80 * len(a | b)


def small_documents():
    rng = random.Random(11)
    line = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    texts = ["\n".join(line(rng.choice([1, 2, 7, 12])) for _ in range(8)) for _ in range(20)]
    texts += [texts[0], texts[1].upper() + "\n" + line(9), "\n".join([line(10), *texts[2].split("\n")[:4], "", line(6)]), texts[3].split("\n")[0], "w1 w2", "W1  w2", "solo"]
    for n in (6, 40, 120):
        base = line(n)
        texts.append(base)
        for changed in (0, 1, 2, 5):
            w = base.split()
            for _ in range(changed):
                w[rng.randrange(n)] = f"z{rng.randrange(9999)}"
            texts.append(" ".join(w))
    # at 80 words: alike by shingles of four words, not by those of five
    w = line(80).split()
    texts += [" ".join(w), " ".join(["z0" if k in (20, 50) else x for k, x in enumerate(w)])]
    return list(enumerate(texts))


def stage(spark, name, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return {r.doc_id: r for r in dict(corpus_pipeline.STAGES)[name](spark, docs, "").collect()}


def test_line_stage_against_all_pairs(spark):
    rows, seen = small_documents(), []
    got = stage(spark, "line_dedup", rows)
    assert set(got) == {i for i, _ in rows}
    removed = 0
    for i, t in rows:
        keep = []
        for x in t.split("\n"):
            s = set(words_of(x))
            if any(alike(s, y) for y in seen):
                removed += 1
            else:
                keep.append(x)
            seen.append(s)
        assert got[i].text == "\n".join(keep) and got[i].n_chars == len(got[i].text)
    assert removed > 10


def test_document_stage_against_all_pairs(spark):
    rows = small_documents()

    def kept(n):
        sets = {i: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or {tuple(w)} for i, t in rows for w in [words_of(t)]}
        root = {i: i for i in sets}
        for _ in sets:
            for a in sets:
                for b in sets:
                    if alike(sets[a], sets[b]):
                        root[a] = root[b] = min(root[a], root[b])
        return {i for i in root if root[i] == i}

    got = stage(spark, "minhash_dedup", rows)
    assert kept(5) != kept(4) and len(kept(5)) < len(rows)
    assert set(got) == kept(5) and all(got[i].text == t for i, t in rows if i in got)


@pytest.mark.parametrize("name", ["language_id", "minhash_dedup", "packing"])
def test_stages_hand_few_rows_at_once_to_python(spark, name):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows]})

    try:
        stage(spark, name, [(0, "uno dos tres")])
        most = max(r.rows for r in spark.range(0, 5000, 1, 1).mapInArrow(sizes, "rows long").collect())
        assert most <= shared.BATCH
        spark.conf.set(key, "7")
        stage(spark, name, [(0, "uno dos tres")])
        assert spark.conf.get(key) == "7"
    finally:
        spark.conf.set(key, was)
