"""Inputs derived from the driver's tables, in SQL that Spark and DuckDB both read.

Values are computed from keys and are ASCII, so either engine builds the same
texts. `{t}` stands for the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def luhn_sum(s: str, size: int, doubled: int) -> str:
    """SQL for the checksum of a string of digits; places with this parity (from 1) count twice."""
    terms = []
    for i in range(1, size + 1):
        d = f"CAST(substr({s}, {i}, 1) AS INT)"
        terms.append(f"(CASE WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END)" if i % 2 == doubled else d)
    return "(" + " + ".join(terms) + ")"


def _hex(k: str, start: int, size: int, salt: str = "") -> str:
    return f"substr(md5(concat('{salt}', CAST({k} AS STRING))), {start}, {size})"


IDENTITY = f"""SELECT id, concat('Titular ', CASE WHEN id % 7 = 0 THEN concat('X', lpad(CAST(z AS STRING), 7, '0'), '-', substr('{LETTERS}', CAST(z % 23 AS INT) + 1, 1))
  WHEN id % 5 = 0 THEN concat(CAST(n AS STRING), substr('{LETTERS}', CAST((n + 1) % 23 AS INT) + 1, 1))
  WHEN id % 3 = 0 THEN concat(CAST(n AS STRING), '-', lower(substr('{LETTERS}', CAST(n % 23 AS INT) + 1, 1)))
  ELSE concat(CAST(n AS STRING), substr('{LETTERS}', CAST(n % 23 AS INT) + 1, 1)) END, ' alta') AS text
FROM (SELECT c_custkey AS id, 10000000 + (c_custkey * 7919) % 89999999 AS n, (c_custkey * 7919) % 9999999 AS z FROM {{t}}) AS q"""

PHONE = """SELECT id, concat(CASE WHEN id % 6 = 0 THEN 'user_id=' WHEN id % 11 = 0 THEN 'ratio 0.' ELSE 'Llame al ' END,
  CASE id % 4 WHEN 0 THEN concat('6', d) WHEN 1 THEN concat('6', substr(d, 1, 2), ' ', substr(d, 3, 3), ' ', substr(d, 6, 3))
  WHEN 2 THEN concat('9', substr(d, 1, 2), '-', substr(d, 3, 3), '-', substr(d, 6, 3)) ELSE concat('+346', d) END, ' hoy') AS text
FROM (SELECT c_custkey AS id, lpad(CAST((c_custkey * 104729) % 100000000 AS STRING), 8, '0') AS d FROM {t}) AS q"""

CARD = f"""SELECT id, concat(CASE id % 6 WHEN 1 THEN 'hash: ' WHEN 2 THEN 'ref x' ELSE 'pago ' END,
  CASE id % 6 WHEN 3 THEN concat(substr(c, 1, 4), '-', substr(c, 5, 4), '-', substr(c, 9, 4), '-', substr(c, 13, 4))
  WHEN 4 THEN concat(substr(c, 1, 4), ' ', substr(c, 5, 4), ' ', substr(c, 9, 4), ' ', substr(c, 13, 4)) ELSE c END, ' fin') AS text
FROM (SELECT id, concat(d, CAST((10 - ({luhn_sum("d", 15, 1)} + (CASE WHEN id % 6 = 5 THEN 1 ELSE 0 END)) % 10) % 10 AS STRING)) AS c
  FROM (SELECT c_custkey AS id, concat(CASE c_custkey % 8 WHEN 0 THEN '4000' WHEN 1 THEN '5100' WHEN 2 THEN '6011' WHEN 3 THEN '3528' WHEN 4 THEN '6200' WHEN 5 THEN '3600' WHEN 6 THEN '3010' ELSE '7777' END,
    lpad(CAST((c_custkey * 7919) % 100000000000 AS STRING), 11, '0')) AS d FROM {{t}}) AS q) AS r"""

WINDOWS = f"""SELECT o_orderkey AS id, concat('Account ', CASE WHEN o_orderkey % 10 = 0 THEN 'S-1-5-18' ELSE concat('S-1-5-21-', CAST(o_orderkey * 31 + 1000 AS STRING), '-', CAST(o_orderkey * 17 + 5 AS STRING), '-', CAST(o_custkey AS STRING), '-1001') END,
  ' logon 0x', {_hex("o_orderkey", 1, 5)}, ' mask 0x', {_hex("o_orderkey", 7, 12)}, ' end') AS text FROM {{t}}"""

GUID = f"""SELECT p_partkey AS id, concat('item ', {_hex("p_partkey", 1, 8)}, '-', {_hex("p_partkey", 9, 4)}, '-', CASE WHEN p_partkey % 4 = 0 THEN '7' ELSE '4' END, {_hex("p_partkey", 14, 3)}, '-a', {_hex("p_partkey", 18, 3)}, '-', {_hex("p_partkey", 21, 12)}, ' ok') AS text FROM {{t}}"""

NET = f"""SELECT s_suppkey AS id, concat('from ', CASE s_suppkey % 6 WHEN 0 THEN concat('192.168.', CAST(s_suppkey % 250 AS STRING), '.', CAST(s_suppkey % 199 + 1 AS STRING))
  WHEN 1 THEN concat('84.12.', CAST(s_suppkey % 250 AS STRING), '.7') WHEN 2 THEN concat('10\\.0\\.', CAST(s_suppkey % 250 AS STRING), '\\.9')
  WHEN 3 THEN concat('1.3.6.1.4.', CAST(s_suppkey AS STRING), '.1') WHEN 4 THEN '10.1.999.4' ELSE concat('172.16.3.', CAST(s_suppkey % 250 AS STRING)) END,
  ' via 2001:db8:', {_hex("s_suppkey", 1, 4)}, ':', {_hex("s_suppkey", 5, 4)}, ':', {_hex("s_suppkey", 9, 4)}, ':', {_hex("s_suppkey", 13, 4)}, ':1:2 to ',
  CASE s_suppkey % 3 WHEN 0 THEN concat('mail', CAST(s_suppkey AS STRING), '.acme.corp') WHEN 1 THEN 'login.microsoftonline.com' ELSE concat('www.tienda', CAST(s_suppkey AS STRING), '.es') END,
  ' on srv-prod', CAST(s_suppkey % 90 + 10 AS STRING), ' by ops', CAST(s_suppkey AS STRING), '@acme.org') AS text FROM {{t}}"""

O365 = """SELECT o_orderkey AS id, concat('{"Subject": "', CASE WHEN o_orderkey % 9 = 0 THEN 'status' ELSE concat('Pedido ', CAST(o_orderkey AS STRING), ' urgente') END,
  '", "OriginatingServer": "EX', CAST(o_custkey AS STRING), '.acme.net", "file": "report_', CAST(o_orderkey AS STRING), '.pdf"}') AS text FROM {t}"""

LOG = f"""SELECT o_orderkey AS id, CASE o_orderkey % 3
  WHEN 0 THEN concat('2024-01-01T00:00:00Z [INFO] Host srv-prod', CAST(o_orderkey % 90 + 10 AS STRING), ' IP 192.168.1.', CAST(o_orderkey % 254 + 1 AS STRING), ' User admin', CAST(o_custkey AS STRING), '@corp.es Session 0x', upper({_hex("o_orderkey", 1, 8)}), ' DNI 12345678Z')
  WHEN 1 THEN concat('src_ip=10.0.', CAST(o_custkey % 250 AS STRING), '.5 user="op', CAST(o_custkey AS STRING), '@corp.es" action=login')
  ELSE concat('login ok for op', CAST(o_custkey AS STRING), '@corp.es from=10.9.8.', CAST(o_custkey % 250 AS STRING)) END AS text FROM {{t}}"""

SIEM = """SELECT event_id AS id, CASE WHEN event_id % 8 = 0 THEN concat('{"article": {"title": "Nota ', CAST(event_id AS STRING), '", "keywords": "servidor 192.168.1.', CAST(event_id % 254 AS STRING), '"}}')
  ELSE concat('{"agent": {"ip": "10.1.2.', CAST(user_id % 250 AS STRING), '", "name": "HOST', CAST(user_id AS STRING), '.acme.local"}, "data": {"win": {"eventdata": {"keywords": "0x8020000000000000", "targetUserName": "usuario', CAST(user_id AS STRING),
  '", "targetDomainName": "', CASE WHEN event_id % 5 = 0 THEN 'NT AUTHORITY' ELSE 'ACME' END, '", "targetUserSid": "', CASE WHEN event_id % 3 = 0 THEN 'S-1-5-18' ELSE concat('S-1-5-21-1-2-3-', CAST(user_id AS STRING)) END,
  '"}, "system": {"computer": "WS', CAST(user_id % 50 AS STRING), '", "eventID": "4624"}}}}') END AS text FROM {t}"""

XML = """SELECT s_suppkey AS id, concat('<configuration><server name="srv-', CAST(s_suppkey AS STRING), '"><ip>192.168.7.', CAST(s_suppkey % 250 AS STRING), '</ip><admin>jefe', CAST(s_suppkey AS STRING),
  '@acme.org</admin><note><![CDATA[ver 10.4.4.', CAST(s_suppkey % 250 AS STRING), ']]></note><and>a &amp; b</and></server></configuration>') AS text FROM {t}"""

RULED = """SELECT p_partkey AS id, concat('Ficha EMP-', CAST(1000 + p_partkey % 9000 AS STRING), ' proyecto PRJ-X', CAST(p_partkey % 90 + 10 AS STRING), ' token PUBLIC_TOKEN_', CAST(p_partkey AS STRING)) AS text FROM {t}"""

TYPES = """SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN 'Custom(Custom(Email))' WHEN 1 THEN 'IPv4' WHEN 2 THEN 'custom (GuidUuid)' WHEN 3 THEN 'Phone' WHEN 4 THEN concat('Custom (regla ', CAST(p_partkey % 5 AS STRING), ')') WHEN 5 THEN 'NIE' ELSE 'Domain' END AS name FROM {t}"""

REGISTRY = """SELECT concat('valor', CAST(c_custkey AS STRING)) AS original, CASE WHEN c_custkey % 6 = 0 THEN '=' ELSE concat('ANON_', CAST(c_custkey + 1000000 AS STRING)) END AS pseudonym,
  CASE c_custkey % 3 WHEN 0 THEN 'Email' WHEN 1 THEN 'Hostname' ELSE 'DNI/NIE' END AS detector_type, c_custkey % 6 = 0 AS omitted FROM {t}"""

CACHE = """SELECT concat('/datos/f', CAST(o_orderkey AS STRING), '.txt') AS path, o_custkey AS length, o_orderkey % 97 AS mtime, o_orderkey % 1009 AS partial_hash, 'r1' AS rules_hash FROM {t}"""
CACHE_NEW = """SELECT concat('/datos/f', CAST(o_orderkey AS STRING), '.txt') AS path, o_custkey AS length, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 97 + 1 ELSE o_orderkey % 97 END AS mtime,
  CASE WHEN o_orderkey % 6 = 0 THEN 7777 ELSE o_orderkey % 1009 END AS partial_hash, CASE WHEN o_orderkey % 50 = 1 THEN 'r2' ELSE 'r1' END AS rules_hash FROM {t}"""

PATHS = """SELECT p_partkey AS id, concat(CASE p_partkey % 6 WHEN 0 THEN '/src/.git/x' WHEN 1 THEN '/src/node_modules/a/b' WHEN 2 THEN '/src/main' WHEN 3 THEN '/src/.oculto' WHEN 4 THEN '/doc/Build/y' ELSE '/doc/texto' END,
  '/f', CAST(p_partkey AS STRING), CASE p_partkey % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.PNG' WHEN 2 THEN '.log' ELSE '' END) AS path FROM {t}"""

#: Values of the types whose pseudonyms no other query looks at.
TYPED = f"""SELECT k AS id, CASE k % 14 WHEN 0 THEN concat({_hex("k", 1, 8)}, '-', {_hex("k", 9, 4)}, '-4', {_hex("k", 14, 3)}, '-a', {_hex("k", 18, 3)}, '-', {_hex("k", 21, 12)}) WHEN 1 THEN concat('0x', {_hex("k", 1, 5)}) WHEN 2 THEN concat('0x', {_hex("k", 1, 12)})
  WHEN 3 THEN concat(lpad(CAST(k AS STRING), 8, '1'), '-z') WHEN 4 THEN concat('+346', lpad(CAST(k AS STRING), 8, '0')) WHEN 5 THEN concat('9', lpad(CAST(k % 100 AS STRING), 2, '1'), ' 345 ', lpad(CAST(k % 1000 AS STRING), 3, '2'))
  WHEN 6 THEN concat('2001:db8::', {_hex("k", 1, 4)}) WHEN 7 THEN concat('Pedido ', CAST(k AS STRING)) WHEN 8 THEN concat('EX', CAST(k AS STRING), '.acme.net') WHEN 9 THEN concat('informe_', CAST(k AS STRING), '.tar.pdf')
  WHEN 10 THEN concat('ficha', CAST(k AS STRING)) WHEN 11 THEN concat('otro', CAST(k AS STRING)) WHEN 12 THEN concat('<m', CAST(k AS STRING), '@mail.acme.org>') ELSE concat('srv-', CAST(k AS STRING)) END AS original,
  CASE k % 14 WHEN 0 THEN 'GUID/UUID' WHEN 1 THEN 'Windows Logon ID' WHEN 2 THEN 'Windows Hex ID' WHEN 3 THEN 'DNI/NIE' WHEN 4 THEN 'Telephone' WHEN 5 THEN 'Telephone' WHEN 6 THEN 'IPv6' WHEN 7 THEN 'O365 Subject' WHEN 8 THEN 'O365 Server Hostname'
  WHEN 9 THEN 'Attachment File Name' WHEN 10 THEN 'Generic Token' WHEN 11 THEN 'Custom (otra)' WHEN 12 THEN 'Custom (InternetMessageId)' ELSE 'Hostname' END AS detector_type FROM (SELECT c_custkey AS k FROM {{t}}) AS q"""

#: Registries for the rewriting of formats: values that the formats' texts hold, and names of keys, tags and attributes, which must stay.
LOG_PAIRS = """SELECT DISTINCT concat('op', CAST(o_custkey AS STRING), '@corp.es') AS original, concat('u', CAST(o_custkey AS STRING), '@anon.es') AS pseudonym FROM {t}
  UNION SELECT concat('admin', CAST(o_custkey AS STRING), '@corp.es'), concat('a', CAST(o_custkey AS STRING), '@anon.es') FROM {t} UNION SELECT concat('10.0.', CAST(o_custkey % 250 AS STRING), '.5'), concat('10.99.', CAST(o_custkey % 250 AS STRING), '.5') FROM {t}
  UNION SELECT '12345678Z', '87654321X' UNION SELECT 'user', 'CLAVE' UNION SELECT 'src_ip', 'ORIGEN' UNION SELECT 'login', 'ENTRADA'"""
SIEM_PAIRS = """SELECT DISTINCT concat('usuario', CAST(user_id AS STRING)) AS original, concat('anon', CAST(user_id AS STRING)) AS pseudonym FROM {t} UNION SELECT concat('10.1.2.', CAST(user_id % 250 AS STRING)), concat('10.77.2.', CAST(user_id % 250 AS STRING)) FROM {t}
  UNION SELECT '4624', '9999' UNION SELECT '0x8020000000000000', '0xDEAD' UNION SELECT 'agent', 'AGENTE' UNION SELECT 'Nota', 'Aviso' UNION SELECT 'servidor', 'equipo "uno"'"""
XML_PAIRS = """SELECT DISTINCT concat('jefe', CAST(s_suppkey AS STRING), '@acme.org') AS original, concat('x', CAST(s_suppkey AS STRING), '@anon.org') AS pseudonym FROM {t} UNION SELECT concat('192.168.7.', CAST(s_suppkey % 250 AS STRING)), concat('192.168.99.', CAST(s_suppkey % 250 AS STRING)) FROM {t}
  UNION SELECT concat('10.4.4.', CAST(s_suppkey % 250 AS STRING)), concat('10.5.5.', CAST(s_suppkey % 250 AS STRING)) FROM {t} UNION SELECT concat('srv-', CAST(s_suppkey AS STRING)), 'SERVIDOR' FROM {t} UNION SELECT 'a & b', 'c < d' UNION SELECT 'note', 'NOTA' UNION SELECT 'ver', 'see'"""

FIXTURES = {
    "identity": (IDENTITY, "customer"), "phone": (PHONE, "customer"), "card": (CARD, "customer"), "windows": (WINDOWS, "orders"), "guid": (GUID, "part"), "net": (NET, "supplier"),
    "o365": (O365, "orders"), "log": (LOG, "orders"), "siem": (SIEM, "events"), "xml": (XML, "supplier"), "ruled": (RULED, "part"), "types": (TYPES, "part"), "registry": (REGISTRY, "customer"),
    "typed": (TYPED, "customer"), "log_pairs": (LOG_PAIRS, "orders"), "siem_pairs": (SIEM_PAIRS, "events"), "xml_pairs": (XML_PAIRS, "supplier"), "cache": (CACHE, "orders"), "cache_new": (CACHE_NEW, "orders"), "paths": (PATHS, "part"),
}


def _sql(name: str, table: str) -> str:
    text, _ = FIXTURES[name]
    return text.replace("{t}", table)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The fixture as a DataFrame."""
    return spark.sql(_sql(name, f"parquet.`{sf_dir}/{FIXTURES[name][1]}.parquet`").replace("\\", "\\\\"))


def duckdb_sql(name: str) -> str:
    """The fixture's SQL over DuckDB's views."""
    return _sql(name, FIXTURES[name][1])
