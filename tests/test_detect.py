import re

from pyspark.sql import functions as F

from cloakframe.config import Config, Rule
from cloakframe.operators import detect


def found(spark, text, key):
    df = spark.createDataFrame([(text,)], "text string")
    return [r.original for r in df.select(F.inline(detect.matches(key, F.col("text")))).collect()]


def test_dni_needs_its_letter(spark):
    assert found(spark, "DNI 12345678Z, NIE X1234567L, malo 12345678A, 12345678-z", "dni_nie") == ["12345678Z", "X1234567L", "12345678-z"]


def test_card_context(spark):
    card = "4539578763621486"
    text = f"archivo 4532015112830366.png sha256: 4916338506082832 y luego, bastante lejos de todo eso, va la tarjeta {card} y 1690000000000"
    assert found(spark, text, "card") == [card]


def test_card_at_a_line_start(spark):
    # a line's end before the number is no part of its token
    assert found(spark, "Nicht der.\n4881297747170635 Die", "card") == ["4881297747170635"]
    assert found(spark, "der\n4881297747170635 Die", "card") == ["4881297747170635"]


def test_ipv4_and_object_ids(spark):
    assert found(spark, r"iso.3.6.1.2.1 .1.3.6.1.4 192.168.1.10 10\.0\.0\.5 999.1.1.1 01.2.3.4", "ipv4") == ["192.168.1.10", r"10\.0\.0\.5"]


def test_phone_styles_and_context(spark):
    assert found(spark, "+34640052795 y 640-052-795", "phone") == ["+34640052795", "640-052-795"]
    assert found(spark, '"id": 640052795', "phone") == [] and found(spark, "x0.944430319", "phone") == []


def test_protected_sid(spark):
    assert found(spark, "S-1-5-18 S-1-5-21-1-2-3-1001", "sid") == ["S-1-5-21-1-2-3-1001"]


def test_o365_groups(spark):
    assert found(spark, '{"Subject": "Hola mundo", "OriginatingServer" : "EX1.acme.net"}', "subject") == ["Hola mundo"]
    df = spark.createDataFrame([('é {"Subject": "Hola"}',)], "text string").select(F.inline(detect.matches("subject", F.col("text")))).first()
    assert (df.start_pos, df.end_pos, df.original) == (15, 19, "Hola")


def test_priority_rules_and_nulls(spark):
    docs = spark.createDataFrame([(1, "op@acme.es EMP-1234"), (2, None), (3, "")], "id int, text string")
    got = {(r.id, r.original, r.detector_type) for r in detect.findings(docs, Config(rules=(Rule("E", r"\bEMP-\d+\b"), Rule("mala", "(")))).collect()}
    assert got == {(1, "op@acme.es", "Email"), (1, "EMP-1234", "Custom (E)")}


def test_positions_rebuild_the_text(spark):
    text = "ñandú 192.168.1.1 😀 a@b.es fin"
    docs = spark.createDataFrame([(1, text)], "id int, text string")
    for r in detect.findings(docs).collect():
        assert text[r.start_pos : r.end_pos] == r.original


def test_types_lose_every_wrapping(spark):
    from cloakframe.functions.checks import normalize_type

    def plain(name):
        name = name.strip(" ")
        while (m := re.fullmatch(r"[Cc]ustom ?\((.*)\)", name, re.S)) is not None:
            name = m[1].strip(" ")
        return {"Mail": "Custom (Mail)", "Email": "Email", "SID": "Windows SID"}.get(name, f"Custom ({name})")

    names = [head * n + name + ")" * m for head in ("Custom (", "custom(", "Custom( ") for name in ("Email", " SID ", "a (b)", "", "Custom (x") for n in (0, 1, 8, 9, 40) for m in (0, 1, 8, 9, 41)]
    names += ["Custom (custom( Email ) )", "custom  (Email)", "Custom (a) b)", "CUSTOM (Email)", "Custom (" * 3000 + "Email" + ")" * 3000]
    rows = spark.createDataFrame([(n,) for n in [*names, None]], "name string").select("name", normalize_type(F.col("name")).alias("out")).collect()
    assert {r.name: r.out for r in rows} == {n: plain(n) for n in names} | {None: None}


def test_size_labels_beyond_a_long(spark, tmp_path):
    from cloakframe.plans.queries import size_labels

    spark.createDataFrame([(1,), (6,), (300_007,), (1_200_000,)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    got = dict(map(tuple, size_labels(spark, str(tmp_path)).collect()))
    assert got == {1: "7 B", 6: "1.5 KB", 300_007: f"{7 * 300_007**3 / 2**30:.2f} GB", 1_200_000: f"{7 * 1_200_000**3 / 2**30:.2f} GB"}
