"""A query for each operator over the driver's tables, and DuckDB SQL with the same result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe import catalog as C
from cloakframe.config import Config, Rule
from cloakframe.functions import checks as V
from cloakframe.functions import formats
from cloakframe.operators import detect, office, registry, report, rewrite, structured
from cloakframe.plans.engine import Engine
from cloakframe.plans.fixtures import fixture
from cloakframe.sources import files, shared
from cloakframe.sources.vault import Vaults
from cloakframe.streaming import watch

RULES = (
    Rule("Empleado", r"\bEMP-\d{4}\b", "EMP-", "prefix_seq"),
    Rule("Proyecto", r"\bPRJ-X\d+\b", None, "random_alphanumeric"),
    Rule("Publico", r"\bPUBLIC_TOKEN_\d+\b", None, "random_digits", True),
)
RULED = Config(rules=RULES)
Query = Callable[[SparkSession, str], DataFrame]
#: Detectors and the fixtures that hold their values.
WHERE = {"guid": "guid", "sid": "windows", "logon_id": "windows", "hex_id": "windows", "dni_nie": "identity", "card": "card", "email": "net", "ipv4": "net", "ipv6": "net", "domain": "net", "subject": "o365", "server": "o365", "attachment": "o365", "hostname": "net", "phone": "phone"}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")


def found_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.findings(documents(spark, sf_dir))


def document_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine().registry(documents(spark, sf_dir), "doc_id")


def detector_query(key: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fixture(spark, sf_dir, WHERE[key]).select("id", F.inline(detect.matches(key, F.col("text"))))

    return query


def documents_query(key: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = documents(spark, sf_dir).select("doc_id", F.inline(detect.matches(key, F.col("text"))))
        return found.groupBy("doc_id", "original").agg(F.count(F.lit(1)).alias("n"))

    return query


def detect_custom_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.findings(fixture(spark, sf_dir, "ruled"), RULED)
    return found.filter(F.col("detector_type").startswith("Custom")).select("id", "start_pos", "end_pos", "original", "detector_type")


def card_iin_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = V.digits_of(F.col("text"))
    return fixture(spark, sf_dir, "card").select("id", V.card_brand(digits).alias("brand"), V.is_luhn(digits).alias("luhn"))


def dni_control_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), V.control_letter(F.col("c_custkey") * 7919).alias("letter"))


def vendor_domain_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", r"://([^/?#]+)", 1)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", host.alias("host"), V.is_vendor_domain(host).alias("vendor"), V.is_private_domain(host).alias("private"))


def protected_sid_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    sid = F.regexp_extract("text", C.BY_KEY["sid"].pattern, 0)
    return fixture(spark, sf_dir, "windows").groupBy(V.is_protected_sid(sid).alias("protected")).agg(F.count(F.lit(1)).alias("n"))


def protected_word_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.findings(fixture(spark, sf_dir, "o365"), Config(priority=("subject",))).select("id", "original")


def hex_literal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.explode(F.split("text", " "))
    return fixture(spark, sf_dir, "windows").select("id", word.alias("w")).groupBy("id").agg(F.count_if(V.is_hex_literal(F.col("w"))).alias("n"))


def findings_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_in_documents(spark, sf_dir).select("doc_id", "start_pos", "end_pos", "original", "detector_type")


def findings_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.first_wins(found_in_documents(spark, sf_dir), "doc_id")


def findings_stored_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = documents(spark, sf_dir).select("doc_id", F.inline(detect.raw_findings(F.col("text"))))
    return detect.claims(raw, "doc_id").select("doc_id", "start_pos", "end_pos", "original", "detector_type")


def summary_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_type(found_in_documents(spark, sf_dir))


def category_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_category(found_in_documents(spark, sf_dir))


def profile_query(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return report.profile(found_in_documents(spark, sf_dir), name).select("doc_id", "start_pos", "original", "detector_type")

    return query


def rollup_source_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.rollup(found_in_documents(spark, sf_dir), "source")


def audit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.audit(detect.scan(documents(spark, sf_dir)))


def highlight_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.highlights(detect.scan(documents(spark, sf_dir)), "doc_id").select("doc_id", F.inline("highlights"))


def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.text_stats(documents(spark, sf_dir), "doc_id")


def format_badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [fixture(spark, sf_dir, n).select(F.lit(n).alias("kind"), "id", "text") for n in ("siem", "xml", "log", "ruled")]
    every = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return every.groupBy("kind", report.format_badge(F.col("text")).alias("badge")).agg(F.count(F.lit(1)).alias("n"))


def size_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("decimal(12,0)")  # a long overflows, a double isn't exact
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", report.size_label(key * key * key * F.lit(7).cast("decimal(1,0)")).alias("label"))


def registry_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_registry(spark, sf_dir)


def registry_bijection_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.check_bijection(document_registry(spark, sf_dir))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "registry")


def new_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of every tenth stored original with other pseudonyms, and as many new ones."""
    old = stored(spark, sf_dir).filter(F.col("original").endswith("0"))
    other = old.select("original", F.concat(F.lit("NUEVO_"), "original").alias("pseudonym"), "detector_type", F.lit(False).alias("omitted"))
    return other.union(old.select(F.concat(F.lit("x"), "original").alias("original"), F.concat(F.lit("OTRO_"), "original"), "detector_type", F.lit(False)))


def registry_merge_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.merge_first(stored(spark, sf_dir), new_pairs(spark, sf_dir))


def registry_merge_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.merge_last(stored(spark, sf_dir), new_pairs(spark, sf_dir))


def registry_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.add(stored(spark, sf_dir), new_pairs(spark, sf_dir))


def registry_omit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.omit(stored(spark, sf_dir), stored(spark, sf_dir).filter(F.col("original").endswith("7")))


def registry_remove_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.remove(stored(spark, sf_dir), stored(spark, sf_dir).filter(F.col("original").endswith("7")))


def registry_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.search(stored(spark, sf_dir), "VALOR12", "Hostname")


def registry_active_omitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.active_and_omitted(stored(spark, sf_dir))


def registry_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.page(stored(spark, sf_dir), ["original"], 3)


def registry_vault_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    vaults = Vaults(spark, f"{shared.folder(spark)}/vaults-{uuid.uuid4().hex}")
    vaults.create("uno")
    vaults.save("uno", stored(spark, sf_dir))
    return vaults.load("uno")


def protect_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Engine().protect(documents(spark, sf_dir), document_registry(spark, sf_dir), kind="plaintext")
    return out.select("doc_id", "text", (F.col("report.replacements_applied") > 0).alias("changed"))


def restore_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, e = documents(spark, sf_dir), Engine()
    entries = document_registry(spark, sf_dir)
    return e.restore(e.protect(docs, entries), entries).select("doc_id", "text")


def tokens_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.tokens_present(documents(spark, sf_dir), document_registry(spark, sf_dir), "doc_id")


def format_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.lit("pages").alias("kind"), F.col("html").alias("text"))
    parts = [fixture(spark, sf_dir, n).select(F.lit(n).alias("kind"), "text") for n in ("siem", "xml", "log")]
    every = pages.union(parts[0]).union(parts[1]).union(parts[2])
    return rewrite.formats_of(every).groupBy("kind", "format").agg(F.count(F.lit(1)).alias("n"))


def siem_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structured.json_leaves(fixture(spark, sf_dir, "siem"), "id")


def json_leaf_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return siem_leaves(spark, sf_dir).select(F.concat_ws(".", "path").alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def json_protected_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return siem_leaves(spark, sf_dir).filter(V.is_protected_path(F.col("path"), F.trim("value"))).select("id", F.concat_ws(".", "path").alias("path"), "value")


def json_contextual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structured.contextual_registry(structured.contextual(siem_leaves(spark, sf_dir), "id"), "id")


def siem_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine().registry(fixture(spark, sf_dir, "siem"), "id", contextual=True)


def json_protect_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, e, entries = fixture(spark, sf_dir, "siem"), Engine(), siem_registry(spark, sf_dir)
    return e.restore(e.protect(docs, entries, kind="json"), entries, kind="json").select("id", "text")


def json_key_schema_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Engine().protect(fixture(spark, sf_dir, "siem"), siem_registry(spark, sf_dir), kind="json")
    return out.groupBy("report.schema_intact", "report.syntax_valid").agg(F.count(F.lit(1)).alias("n"))


def log_kvp_protect(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fixture(spark, sf_dir, "log")
    entries = Engine().registry(docs, "id")
    out = Engine().protect(docs, entries, kind="log")
    return out.select("id", "text", F.col("report.replacements_applied").alias("replacements"))


def xml_text_protect(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, e = fixture(spark, sf_dir, "xml"), Engine()
    entries = e.registry(docs, "id")
    out = e.protect(docs, entries, kind="xml")
    return e.restore(out.select("id", "text"), entries, kind="xml").select("id", "text")


def custom_rule_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = Engine(RULED).registry(fixture(spark, sf_dir, "ruled"), "id")
    return entries.groupBy("detector_type", "omitted").agg(F.countDistinct("original").alias("originals"), F.countDistinct(F.when(F.col("omitted"), F.col("original")).otherwise(F.col("pseudonym"))).alias("pseudonyms"))


def scan_cache_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.changed(fixture(spark, sf_dir, "cache_new"), fixture(spark, sf_dir, "cache")).select("path")


def directory_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "paths").filter(files.wanted(F.col("path"), Config())).select("id", "path")


def detector_type_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "types").select("id", V.normalize_type(F.col("name")).alias("name"))


def stream_protect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a stream, protected batch by batch into a table."""
    root = f"{shared.folder(spark)}/stream-{uuid.uuid4().hex}"
    vaults = Vaults(spark, f"{root}/vaults")
    vaults.create("flujo")
    source = f"{sf_dir}/conversations.parquet"
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(f"{source}*")
    stream = stream.withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    watch.protect_stream(stream, Engine(), vaults, "flujo", "id", lambda df, n: df.select("id", "role", "text").write.mode("append").parquet(f"{root}/out"), f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out")


def pseudonym_generators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudonyms of values of each type that the registry of documents lacks."""
    return registry.build(fixture(spark, sf_dir, "typed").select("original", "detector_type")).select("original", "pseudonym", "detector_type")


def pairs_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return fixture(spark, sf_dir, name).select("original", "pseudonym", F.lit("Generic Token").alias("detector_type"), F.lit(False).alias("omitted"))


def rewrite_query(kind: str, name: str, parts: bool = False) -> Query:
    """The texts of a format rewritten with a registry that also names keys and tags; with `parts`, by a registry in several parts."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        config = Config(matcher_entries=50) if parts else Config()
        out = Engine(config).protect(fixture(spark, sf_dir, name), pairs_of(spark, sf_dir, f"{name}_pairs"), kind=kind)
        return out.select("id", "text", F.col("report.replacements_applied").alias("replacements"), F.col("report.schema_intact").alias("schema_intact"))

    return query


def schema_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparison of each text with a broken copy of it: one lacks a key, one a tag, one is cut."""
    texts = fixture(spark, sf_dir, "siem").select("id", F.lit(formats.JSON).alias("kind"), "text", F.when(F.col("id") % 3 == 0, F.replace("text", F.lit('"ip"'), F.lit('"host"'))).when(F.col("id") % 3 == 1, F.substring("text", 1, 9)).otherwise(F.col("text")).alias("other"))
    texts = texts.union(fixture(spark, sf_dir, "xml").select("id", F.lit(formats.XML), "text", F.when(F.col("id") % 3 == 0, F.replace("text", F.lit("admin>"), F.lit("amo>"))).when(F.col("id") % 3 == 1, F.substring("text", 1, 30)).otherwise(F.col("text"))))

    @F.pandas_udf("schema_intact boolean, syntax_valid boolean")
    def each(before, after, kind):
        import pandas as pd

        return pd.DataFrame([(r["schema_intact"], r["syntax_valid"]) for r in (formats.compare(*x) for x in zip(before, after, kind, strict=True))], columns=["schema_intact", "syntax_valid"])

    return texts.withColumn("report", each.asNondeterministic()("text", "other", "kind")).select("kind", "id", "report.schema_intact", "report.syntax_valid")


def office_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Word, Excel or PowerPoint file for each supplier, by turns."""

    def run(batches):
        import io
        import zipfile

        import pandas as pd

        def made(i: int) -> bytes:
            mail = f"jefe{i}@acme.org"
            name, xml = [
                ("word/document.xml", f"<w:document><w:p><w:r><w:t>Informe de {mail[:3]}</w:t></w:r><w:r><w:t>{mail[3:]}</w:t></w:r></w:p><w:p><w:r><w:t>a &amp; b</w:t></w:r></w:p></w:document>"),
                ("xl/sharedStrings.xml", f"<sst><si><t>{mail}</t></si><si><t>192.168.7.{i % 250}</t></si></sst>"),
                ("ppt/slides/slide1.xml", f'<p:sld name="srv-{i}"><a:p><a:r><a:t>ver {mail}</a:t></a:r></a:p></p:sld>'),
            ][i % 3]
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                z.writestr("[Content_Types].xml", "<Types/>")
                z.writestr(name, xml)
            return out.getvalue()

        for b in batches:
            yield pd.DataFrame({"path": b.id.map(lambda i: f"f{i}"), "content": b.id.map(made)})

    return fixture(spark, sf_dir, "xml").select("id").mapInPandas(run, "path string, content binary")


def office_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return office.office_texts(office_files(spark, sf_dir))


def office_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = shared.written(office.rewrite_office(office_files(spark, sf_dir), pairs_of(spark, sf_dir, "xml_pairs")), "office")
    return office.office_texts(new).join(new.select("path", "replacements"), "path")


PLAIN = [
    pseudonym_generators, schema_of, office_text, office_rewrite,
    detect_custom_rule, card_iin_brand, dni_control_letter, vendor_domain_filter, protected_sid_filter, protected_word_filter, hex_literal_filter, findings_resolved, findings_first_wins, findings_stored_claims,
    summary_by_type, category_distribution, rollup_source_type, audit_metrics, highlight_spans, text_stats, format_badge, size_labels, registry_build, registry_bijection_check, registry_merge_first_wins,
    registry_merge_last_wins, registry_add, registry_omit, registry_remove_batch, registry_search, registry_active_omitted, registry_page, registry_vault_roundtrip, protect_text, restore_roundtrip, tokens_present,
    format_detect, json_leaf_paths, json_protected_paths, json_contextual, json_protect_roundtrip, json_key_schema_check, log_kvp_protect, xml_text_protect, custom_rule_registry, scan_cache_skip, directory_filter,
    detector_type_normalize, stream_protect,
]
REWRITES = (("json", formats.JSON, "siem"), ("xml", formats.XML, "xml"), ("log", formats.LOG, "log"))
IN_DOCUMENTS = ("email", "ipv4", "card", "domain")


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {f"detect_{k}": detector_query(k) for k in WHERE}
    out |= {f"documents_{k}": documents_query(k) for k in IN_DOCUMENTS}
    out |= {f"profile_{n}": profile_query(n) for n in ("devops", "gdpr")}
    out |= {f"{k}_rewrite": rewrite_query(kind, n) for k, kind, n in REWRITES} | {f"{k}_rewrite_parts": rewrite_query(kind, n, True) for k, kind, n in REWRITES}
    return out | {f.__name__: f for f in PLAIN}
