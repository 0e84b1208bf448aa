"""JSON documents as tables: their leaves, and the entities that their keys announce."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe import catalog as C
from cloakframe.config import Config
from cloakframe.functions import checks as V
from cloakframe.functions import formats
from cloakframe.functions import pseudonyms as P
from cloakframe.sources import shared


def json_leaves(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """String leaves of JSON texts in order of sorted keys: key, position, path (array of keys), value. Other texts have none."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b[key], b[text], strict=True):
                i = 0
                for v in formats.json_stream(t) if isinstance(t, str) else []:
                    for path, value in formats.leaves(v):
                        rows.append((k, i, list(path), value))
                        i += 1
            yield pd.DataFrame(rows, columns=[key, "position", "path", "value"])

    return shared.dealt(docs.select(key, text)).mapInPandas(run, f"{key} {kind}, position int, path array<string>, value string")


def is_siem(index: Column, keys: Column, data_keys: Column) -> Column:
    """Whether a JSON object looks like a security alert: by its index name, by agent and manager, or by its data."""
    return F.coalesce(index.rlike("^wazuh-(?:alerts|archives)"), F.lit(False)) | (F.array_contains(keys, "agent") & F.array_contains(keys, "manager")) | F.coalesce(F.arrays_overlap(data_keys, F.array(F.lit("win"), F.lit("vulnerability"))), F.lit(False))


def contextual(leaves: DataFrame, key: str, config: Config = Config()) -> DataFrame:
    """Entities that JSON keys announce: key, position, original, pseudonym, detector_type.

    Protected values and system names are `=`. A host with a domain gives the
    host, the domain and both together.
    """
    value, k = F.trim("value"), F.lower(F.try_element_at("path", F.lit(-1)))
    full, secure = F.lower(F.concat_ws(".", "path")), V.in_security_path(F.col("path"))
    h = lambda kind, v: P.keyed_hash(config.key, kind, v, F.lit(0))
    host = lambda v: P.hostname(v, h("Hostname", v))
    domain = lambda v: P.domain(v, h("Domain/FQDN", v))
    entry = lambda o, p, t: F.struct(o.alias("original"), p.alias("pseudonym"), F.lit(t).alias("detector_type"))
    named = full.rlike(r"(?:agent|manager)\.name$") | (k == "workstationname") | ((k == "computer") & secure)
    left, right = F.substring_index(value, ".", 1), F.substr(value, F.instr(value, ".") + 1, F.length(value))
    vendor = V.is_vendor_domain(right)
    whole = F.concat(host(left), F.lit("."), F.when(vendor, right).otherwise(domain(right)))
    parts = F.when(
        value.contains("."),
        F.concat(F.array(entry(left, host(left), "Hostname")), F.filter(F.array(entry(right, domain(right), "Domain/FQDN")), lambda _: ~vendor), F.array(entry(value, whole, "Hostname"))),
    ).otherwise(F.array(entry(value, host(value), "Hostname")))
    one = lambda p, t: F.array(entry(value, p, t))
    same = F.lit("=")
    found = (
        F.when(V.is_protected_path(F.col("path"), value), one(same, C.GENERIC))
        .when(k == "internetmessageid", one(P.message_id(value, h("Custom (InternetMessageId)", value)), "Custom (InternetMessageId)"))
        .when(named, parts)
        .when((k == "targetdomainname") | ((k == "domain") & secure), one(F.when(F.upper(value).isin(C.SYSTEM_DOMAINS) | V.is_vendor_domain(value), same).otherwise(F.concat(F.lit("DOMAIN_"), F.upper(F.substring(h("Domain/FQDN", value), 1, 8)))), "Domain/FQDN"))
        .when(k.isin("targetusername", "subjectusername"), one(F.concat(F.lit("user_"), F.substring(h(C.GENERIC, value), 1, 8)), C.GENERIC))
        .when(k.isin("targetusersid", "subjectusersid"), one(F.when(V.is_protected_sid(value), same).otherwise(P.sid(value, h("Windows SID", value))), "Windows SID"))
    )
    return leaves.filter(value != "").select(key, "position", F.explode(found).alias("f")).select(key, "position", "f.*")


def contextual_registry(found: DataFrame, key: str) -> DataFrame:
    """Registry entries of contextual findings: the first in order of documents and places wins, a protected one before all."""
    first = F.min(F.struct((F.col("pseudonym") != "=").alias("rank"), key, "position", "pseudonym", "detector_type"))
    return found.groupBy("original").agg(first.alias("f")).select("original", "f.pseudonym", "f.detector_type", (F.col("f.pseudonym") == "=").alias("omitted"))
