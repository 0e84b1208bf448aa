from cloakframe.operators import rewrite, structured
from cloakframe.plans.engine import Engine
from cloakframe.sources import shared


def test_few_tasks_are_dealt_to_all(spark):
    docs = spark.createDataFrame([(i, '{"agent": {"name": "H%d"}}' % i) for i in range(40)], "id int, text string").coalesce(1)
    cores = spark.sparkContext.defaultParallelism
    assert shared.dealt(docs).rdd.getNumPartitions() == 3 * cores and shared.dealt(shared.dealt(docs)).count() == 40
    assert "Exchange" in structured.json_leaves(docs, "id")._jdf.queryExecution().executedPlan().toString()


def test_announced_entries_are_read_from_a_table(spark):
    docs = spark.createDataFrame([(1, '{"agent": {"name": "H1"}, "manager": {"name": "H2"}}')], "id int, text string")
    entries = Engine().registry(docs, "id", contextual=True)
    assert "MapInPandas" not in entries._jdf.queryExecution().executedPlan().toString()
    assert {r.original for r in entries.collect()} >= {"H1", "H2"}


def test_parts_share_a_matcher(monkeypatch):
    made = []

    class Counted(rewrite.Replacer):
        def __init__(self, pairs, strict):
            made.append(len(pairs))
            super().__init__(pairs, strict)

    monkeypatch.setattr(rewrite, "Replacer", Counted)
    monkeypatch.setattr(rewrite, "_pairs", lambda source: source)
    parts = [(str(i), {f"w{i}": f"x{i}", f"w{i}.b": "y"}) for i in range(20)]
    text = " ".join(f"w{i}" for i in range(20)) + " w3.b"
    want = " ".join(f"x{i}" for i in range(20)) + " y"
    assert rewrite.replaced(parts, True, [text]) == {text: (want, 21)}
    assert len(made) == 1
    made.clear()
    monkeypatch.setattr(rewrite, "GATHERED", 7)
    assert rewrite.replaced(parts, True, [text]) == {text: (want, 21)}
    assert max(made) <= 7 and len(made) > 2


def test_one_worker_at_a_time_and_results_in_pieces(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"ana{i}@acme.org", "a") for i in range(30)], "id int, text string, report string")
    entries = Engine().registry(docs.select("id", "text"), "id")
    back = Engine().restore(Engine().protect(docs, entries), entries)
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # each such step of a stage has its own worker and matcher in every task
    assert sorted((r.id, r.text) for r in back.collect()) == [(i, f"ana{i}@acme.org") for i in range(30)]
    monkeypatch.setattr(rewrite, "PIECE", 40)
    source = [("one", type("B", (), {"value": {"uno": "dos"}}))]
    rows = list(rewrite.rewritten_all(["uno " * 5] * 7 + [None], ["plaintext"] * 8, source, Engine().config, False))
    assert [len(x) for x in rows] == [2, 2, 2, 2] and [r[1] for x in rows for r in x] == [5] * 7 + [0]
