"""Where registries live: versioned tables, plain or encrypted JSON, and backups."""

from __future__ import annotations

import hashlib
import io
import json
import os
import re
import tarfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.config import ConfigError, CryptoError
from cloakframe.functions.checks import normalize_type
from cloakframe.operators.registry import COLUMNS, SCHEMA

MAGIC = b"CFRV\x01"


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


class Vaults:
    """Named registries below a root of any file system that Spark reads.

    Each save writes a new version folder and then its marker; a reader takes
    the newest marked version, so a save that fails leaves the last one. One
    writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        if not re.fullmatch(r"[\w.-]+", name) or name.startswith("."):
            raise ConfigError(f"not a vault name: {name!r}")
        return f"{self.root}/{name}"

    def _versions(self, name: str) -> list[str]:
        fs, at = _fs(self.spark, self._path(name))
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(n for n in names if n.startswith("v") and _fs(self.spark, f"{self._path(name)}/{n}/_SUCCESS")[0].exists(_fs(self.spark, f"{self._path(name)}/{n}/_SUCCESS")[1]))

    def list(self) -> DataFrame:
        """Vaults by name with their newest version and the number of versions."""
        fs, at = _fs(self.spark, self.root)
        names = sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
        rows = [(n, v[-1], len(v)) for n in names if (v := self._versions(n))]
        return self.spark.createDataFrame(rows, "name string, version string, versions int")

    def create(self, name: str) -> None:
        if self._versions(name):
            raise ConfigError(f"vault {name!r} exists")
        self.save(name, self.spark.createDataFrame([], SCHEMA))

    def load(self, name: str, back: int = 0) -> DataFrame:
        """The newest version, or an older one."""
        versions = self._versions(name)
        if len(versions) <= back:
            raise ConfigError(f"no vault {name!r}" + f" with {back} older versions" * bool(back))
        return self.spark.read.schema(SCHEMA).parquet(f"{self._path(name)}/{versions[-1 - back]}")

    def save(self, name: str, registry: DataFrame) -> None:
        out = registry.select("original", "pseudonym", normalize_type(F.col("detector_type")).alias("detector_type"), "omitted")
        out.write.parquet(f"{self._path(name)}/v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}")

    def restore(self, name: str) -> None:
        """Makes the version before the newest the newest."""
        self.save(name, self.load(name, 1))

    def rename(self, name: str, new: str) -> None:
        if self._versions(new):
            raise ConfigError(f"vault {new!r} exists")
        fs, at = _fs(self.spark, self._path(name))
        fs.rename(at, _fs(self.spark, self._path(new))[1])

    def delete(self, name: str) -> None:
        fs, at = _fs(self.spark, self._path(name))
        fs.delete(at, True)


def to_json(registry: DataFrame) -> str:
    """A registry as a JSON array, for exchange: read to the driver, as one document is."""
    return json.dumps([r.asDict() for r in registry.select(COLUMNS).orderBy("original").collect()], ensure_ascii=False)


def from_json(spark: SparkSession, text: str) -> DataFrame:
    """A registry from a JSON array; types may be names or `{"Custom": name}`."""
    rows = []
    for r in json.loads(text):
        kind = r["detector_type"]
        kind = f"Custom({kind['Custom']})" if isinstance(kind, dict) else kind
        rows.append((r["original"], r["pseudonym"], kind, bool(r.get("omitted")) or "=" in (r["original"], r["pseudonym"])))
    return spark.createDataFrame(rows, SCHEMA).withColumn("detector_type", normalize_type(F.col("detector_type"))).select(COLUMNS)


def _derived(password: str, salt: bytes) -> bytes:
    if not password:
        raise CryptoError("the password is empty")
    return hashlib.scrypt(password.encode(), salt=salt, n=1 << 14, r=8, p=1, dklen=32)


def encrypt(spark: SparkSession, data: bytes, password: str) -> bytes:
    """A container of magic, salt and AES-256-GCM ciphertext under a key derived by scrypt."""
    salt = os.urandom(16)
    row = spark.createDataFrame([(bytearray(data), bytearray(_derived(password, salt)))], "d binary, k binary").select(F.aes_encrypt("d", "k", F.lit("GCM"))).first()
    return MAGIC + salt + bytes(row[0])


def decrypt(spark: SparkSession, data: bytes, password: str) -> bytes:
    """The content of a container; a CryptoError for a wrong password or a changed byte."""
    if not data.startswith(MAGIC):
        raise CryptoError("not a vault container")
    key = _derived(password, data[5:21])
    out = spark.createDataFrame([(bytearray(data[21:]), bytearray(key))], "d binary, k binary").select(F.try_aes_decrypt("d", "k", F.lit("GCM"))).first()[0]
    if out is None:
        raise CryptoError("wrong password, or the container was changed")
    return bytes(out)


def save_file(registry: DataFrame, path: str, password: str | None = None) -> None:
    """Writes a registry to a file of this machine, encrypted if there is a password; replaces it at once and keeps the last one as .bak."""
    data = to_json(registry).encode()
    data = data if password is None else encrypt(registry.sparkSession, data, password)
    with open(f"{path}.tmp", "wb") as f:
        f.write(data)
    if os.path.exists(path):
        os.replace(path, f"{path}.bak")
    os.replace(f"{path}.tmp", path)


def load_file(spark: SparkSession, path: str, password: str | None = None) -> DataFrame:
    with open(path, "rb") as f:
        data = f.read()
    if data.startswith(MAGIC):
        if password is None:
            raise CryptoError("a password is needed")
        data = decrypt(spark, data, password)
    return from_json(spark, data.decode())


def rekey_file(spark: SparkSession, path: str, old: str | None, new: str | None) -> None:
    save_file(load_file(spark, path, old), path, new)


def backup(spark: SparkSession, paths: list[str], target: str, password: str) -> None:
    """Files of this machine in an encrypted archive, by their base names."""
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w:bz2") as tar:
        for p in paths:
            tar.add(p, os.path.basename(p))
    with open(target, "wb") as f:
        f.write(encrypt(spark, raw.getvalue(), password))


def restore_backup(spark: SparkSession, source: str, folder: str, password: str) -> list[str]:
    """Unpacks an archive into a folder; only plain files, by their base names."""
    with open(source, "rb") as f:
        raw = io.BytesIO(decrypt(spark, f.read(), password))
    out = []
    with tarfile.open(fileobj=raw, mode="r:bz2") as tar:
        for m in tar.getmembers():
            name = os.path.basename(m.name)
            if m.isfile() and name not in ("", ".", ".."):
                with open(os.path.join(folder, name), "wb") as f:
                    f.write(tar.extractfile(m).read())
                out.append(name)
    return out
