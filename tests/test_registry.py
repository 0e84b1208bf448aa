import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cloakframe.config import CollisionError, Config, CryptoError, Rule
from cloakframe.functions.replacing import Replacer
from cloakframe.operators import registry as R
from cloakframe.operators import rewrite
from cloakframe.plans.engine import Engine
from cloakframe.sources import vault


def table(spark, rows):
    return spark.createDataFrame(rows, R.SCHEMA)


def test_build_is_one_to_one_and_keeps_known(spark):
    kinds = [("10.0.0.%d" % i, "IPv4") for i in range(9)] + [("a%d@x.es" % i, "Email") for i in range(50)] + [("12345678Z", "DNI/NIE"), ("4539578763621486", "Credit Card"), ("microsoft.com", "Domain/FQDN"), ("640052795", "Telephone")]
    known = table(spark, [("a1@x.es", "user_known@example.com", "Email", False)])
    out = {r.original: r for r in R.build(spark.createDataFrame(kinds, "original string, detector_type string"), Config(), known).collect()}
    assert len(out) == len(kinds) and out["a1@x.es"].pseudonym == "user_known@example.com"
    assert out["microsoft.com"].omitted
    nets = {r.pseudonym.rsplit(".", 1)[0] for k, r in out.items() if k.startswith("10.0.0.")}
    assert len(nets) == 1 and out["10.0.0.7"].pseudonym.endswith(".7")
    live = [r.pseudonym for r in out.values() if not r.omitted]
    assert len(set(live)) == len(live)


def test_add_rules(spark):
    base = table(spark, [("a", "X", "Email", False), ("b", "=", "Email", True)])
    new = spark.createDataFrame([("a", "Y", "Email"), ("b", "Z", "Email"), ("c", "c", "Email"), ("d", "=", "Email")], "original string, pseudonym string, detector_type string")
    got = {r.original: (r.pseudonym, r.omitted) for r in R.add(base, new).collect()}
    assert got == {"a": ("Y", False), "b": ("=", True), "d": ("=", True)}
    with pytest.raises(CollisionError):
        R.add(base, spark.createDataFrame([("q", "X", "Email")], "original string, pseudonym string, detector_type string"))


def test_mask_is_not_restored(spark):
    config = Config(rules=(Rule("M", r"\bTOK-\d+\b", None, "mask"),))
    docs = spark.createDataFrame([(1, "TOK-1 y TOK-2")], "id int, text string")
    e = Engine(config)
    entries = e.registry(docs, "id")
    out = e.protect(docs, entries).first().text
    assert out.count("***REDACTED***") == 2
    assert R.mapping(entries, True, config).count() == 0


def test_round_trip_over_several_matchers(spark):
    texts = ["correo a%d@x.es desde 84.1.2.%d, host srv-prod%d" % (i, i, i) for i in range(30)] + [None, "", "nada"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for entries_each in (7, 100_000):
        e = Engine(Config(matcher_entries=entries_each))
        entries = e.registry(docs, "id")
        hidden = e.protect(docs, entries)
        assert not hidden.filter(F.col("text").contains("@x.es")).count()
        assert sorted((r.id, r.text) for r in e.restore(hidden, entries).select("id", "text").collect()) == sorted(enumerate(texts), key=lambda x: x[0])


def test_vaults(spark, tmp_path):
    v = vault.Vaults(spark, f"file://{tmp_path}/v")
    v.create("uno")
    v.save("uno", table(spark, [("a", "X", "Custom(Custom(Email))", False)]))
    assert v.load("uno").first().detector_type == "Email"
    v.rename("uno", "dos")
    assert [r.name for r in v.list().collect()] == ["dos"]
    v.restore("dos")
    assert v.load("dos").count() == 0
    v.delete("dos")
    assert v.list().count() == 0


def test_encrypted_file(spark, tmp_path):
    at = str(tmp_path / "r.vault")
    vault.save_file(table(spark, [("a", "X", "Email", False)]), at, "clave")
    assert vault.load_file(spark, at, "clave").count() == 1
    with pytest.raises(CryptoError):
        vault.load_file(spark, at, "otra")
    raw = bytearray(open(at, "rb").read())
    raw[-1] ^= 1
    with pytest.raises(CryptoError):
        vault.decrypt(spark, bytes(raw), "clave")
    with pytest.raises(CryptoError):
        vault.encrypt(spark, b"x", "")


def naive(pairs, text, strict):
    word = lambda c: c.isalnum() or c == "_"
    out, at, n = [], 0, 0
    while at < len(text):
        for k in sorted(pairs, key=len, reverse=True):
            if text.startswith(k, at):
                end = at + len(k)
                if strict and all(map(word, k)) and (at and word(text[at - 1]) or end < len(text) and word(text[end])):
                    continue
                out.append(pairs[k])
                at, n = end, n + 1
                break
        else:
            out.append(text[at])
            at += 1
    return "".join(out), n


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text("ab.é_", min_size=1, max_size=4), st.text("xyz", max_size=3), max_size=6), st.text("ab.é_ ", max_size=30), st.booleans())
def test_replacer_is_the_naive_one(pairs, text, strict):
    assert Replacer(pairs, strict).replace(text) == naive(pairs, text, strict)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab.é_ ", min_size=1, max_size=6), max_size=8), st.lists(st.text("ab.é_ ", max_size=20), max_size=3), st.booleans())
def test_needles_that_are_left_out_never_occur(needles, strings, strict):
    pairs = {k: "x" for k in needles}
    few = rewrite.possible(pairs, strings, strict)
    for x in strings:
        assert Replacer(few, strict).replace(x) == Replacer(pairs, strict).replace(x)


def test_no_cascade():
    assert Replacer({"A": "B", "B": "C"}).replace("A B") == ("B C", 2)
    assert Replacer({"cat": "DOG"}).replace("application certificate cat") == ("application certificate DOG", 1)


def test_no_matcher_without_its_library(monkeypatch):
    import importlib
    import sys

    from cloakframe.functions import replacing

    # a stand-in that finds less would look like a result
    with monkeypatch.context() as m:
        m.setitem(sys.modules, "ahocorasick", None)
        with pytest.raises(ImportError):
            importlib.reload(replacing)
    importlib.reload(replacing)
    assert {k for _, _, k in replacing.Replacer({"ab": "x", "abc": "y", "bc": "z"}, False).hits("abc")} == {"ab", "abc", "bc"}
