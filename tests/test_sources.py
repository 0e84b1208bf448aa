from pyspark.sql import functions as F

from cloakframe.config import Config
from cloakframe.plans.engine import Engine
from cloakframe.sources import files
from cloakframe.sources.vault import Vaults
from cloakframe.streaming import watch


def test_directory_and_cache(spark, tmp_path):
    for name, data in {"a.txt": b"hola a@x.es", "b.PNG": b"x", "node_modules/c.txt": b"x", ".h/d.txt": b"x", "e.log": b"\x00\x01", "f.md": b"ok", "z.dat": b"\x1f\x8bxx"}.items():
        p = tmp_path / "src" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    found = files.directory(spark, f"file://{tmp_path}/src", Config(), ignore=["*.md", "# no"])
    got = {r.path.rsplit("/", 1)[-1]: r.binary for r in found.collect()}
    assert got == {"a.txt": False, "e.log": True, "z.dat": True}
    assert [r.text for r in files.texts(found).collect()] == ["hola a@x.es"]
    prints = files.fingerprint(found, "r1")
    cache = spark.createDataFrame(prints.collect(), prints.schema)
    assert files.changed(prints, cache).count() == 0
    assert files.changed(prints.withColumn("rules_hash", F.lit("r2")), cache).count() == 3
    assert files.updated(cache, prints.limit(1)).count() == 3


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("1", "soy a@x.es"), ("2", None)], "id string, text string").write.parquet(str(src))
    vaults = Vaults(spark, f"file://{tmp_path}/v")
    vaults.create("s")
    stream = spark.readStream.schema("id string, text string").parquet(str(src))
    out = []
    watch.protect_stream(stream, Engine(), vaults, "s", "id", lambda df, n: out.extend(df.select("id", "text").collect()), f"{tmp_path}/c").awaitTermination()
    texts = {r.id: r.text for r in out}
    assert texts["2"] is None and "@x.es" not in texts["1"] and vaults.load("s").count() == 1
