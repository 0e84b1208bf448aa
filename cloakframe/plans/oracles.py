"""DuckDB SQL with the results of `cloakframe.plans.queries`, written apart from them."""

from __future__ import annotations

from cloakframe import catalog as C
from cloakframe.plans.fixtures import LETTERS, duckdb_sql, luhn_sum
from cloakframe.plans.queries import IN_DOCUMENTS, WHERE


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def placed(source: str, pattern: str, key: str = "id", group: int = 0) -> str:
    """Matches with their places: key, text, original, start_pos, end_pos."""
    p = quoted(pattern)
    own = f"regexp_extract_all(text, {p}, {group})"
    to = "e - 1" if group else "e"
    return f"""(SELECT {key}, text, o AS original, CAST({to} - length(o) AS INTEGER) AS start_pos, CAST({to} AS INTEGER) AS end_pos FROM (
  SELECT {key}, text, own[i] AS o, CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0) AS BIGINT) AS e FROM (
    SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT {key}, text, regexp_extract_all(text, {p}, 0) AS m, {own} AS own, string_split_regex(text, {p}) AS g FROM {source}))))"""


DIGITS = "regexp_replace(original, '[^0-9]', '', 'g')"
ALNUM = "upper(regexp_replace(original, '[^A-Za-z0-9]', '', 'g'))"
LEFT = "substr(text, 1, start_pos)"
RIGHT = "substr(text, end_pos + 1)"
STOP = r"\s\"''<>(){}\[\],;"


def luhn(d: str) -> str:
    return f"list_sum(list_transform(range(0, length({d})), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(reverse({d}), i + 1, 1) AS INT) ELSE list_extract([0,2,4,6,8,1,3,5,7,9], CAST(substr(reverse({d}), i + 1, 1) AS INT) + 1) END)) % 10 = 0"


def brand(d: str) -> str:
    first, n = (lambda k: f"CAST(substr({d}, 1, {k}) AS BIGINT)"), f"length({d})"
    return f"""CASE WHEN {n} NOT BETWEEN 13 AND 19 THEN NULL WHEN {d} LIKE '4%' AND {n} IN (13, 16, 19) THEN 'Visa'
  WHEN {n} = 16 AND ({first(2)} BETWEEN 51 AND 55 OR {first(4)} BETWEEN 2221 AND 2720) THEN 'Mastercard' WHEN {first(2)} IN (34, 37) AND {n} = 15 THEN 'American Express'
  WHEN {n} IN (16, 19) AND ({first(4)} = 6011 OR {first(4)} BETWEEN 644 AND 649 OR {first(2)} = 65 OR {first(6)} BETWEEN 622126 AND 622925) THEN 'Discover'
  WHEN {first(4)} BETWEEN 300 AND 305 OR {first(2)} IN (36, 38) THEN 'Diners Club' WHEN {first(4)} BETWEEN 3528 AND 3589 AND {n} >= 16 THEN 'JCB'
  WHEN {first(2)} IN (50, 56, 57, 58) THEN 'Maestro' WHEN {first(2)} = 62 AND {n} >= 16 THEN 'UnionPay' WHEN {first(4)} BETWEEN 2200 AND 2204 AND {n} = 16 THEN 'Mir' END"""


VALID = {
    "sid": "original NOT IN (" + ", ".join(map(quoted, C.PROTECTED_SIDS)) + ")",
    "dni_nie": f"length({ALNUM}) = 9 AND substr('{LETTERS}', CAST(CAST(translate(substr({ALNUM}, 1, 8), 'XYZ', '012') AS BIGINT) % 23 AS INT) + 1, 1) = right({ALNUM}, 1)",
    "card": f"""length({DIGITS}) BETWEEN 13 AND 19 AND replace({DIGITS}, left({DIGITS}, 1), '') <> '' AND ({brand(DIGITS)}) IS NOT NULL AND {luhn(DIGITS)}
  AND NOT regexp_matches({LEFT}, '[A-Za-z0-9_]$|[A-Za-z0-9][-.:/\\\\]$') AND NOT regexp_matches({RIGHT}, '^[A-Za-z0-9_]|^[-.:/\\\\][A-Za-z0-9]')
  AND NOT regexp_matches({LEFT}, '[A-Za-z][^{STOP}]*$') AND NOT regexp_matches({RIGHT}, '^[^{STOP}]*[A-Za-z]')
  AND NOT regexp_matches(lower(right({LEFT}, 40)), 'sha|md5|hash|checksum|digest|etag|commit')""".replace("\\\\\\\\", "\\\\"),
    "ipv4": rf"""len(list_filter(string_split(replace(original, '\', ''), '.'), lambda o: CAST(o AS INT) > 255 OR (length(o) > 1 AND o LIKE '0%'))) = 0
  AND NOT {LEFT} LIKE '%.' AND NOT regexp_matches({RIGHT}, '^\\?\.[A-Za-z0-9.]')""",
    "phone": f"""NOT regexp_matches(lower(right({LEFT}, 10)), 's-1-|sid') AND NOT {RIGHT} LIKE '-%' AND NOT {LEFT} LIKE '%.' AND NOT regexp_matches({LEFT}, '[\\p{{L}}\\p{{N}}]$')
  AND NOT regexp_matches(lower(right({LEFT}, 30)), 'id"|id''|id:|id=|timestamp|date|time|created|updated|size|length|count')""",
}


def matches(key: str, source: str, name: str = "id") -> str:
    d = C.BY_KEY[key]
    return f"(SELECT * FROM {placed(source, d.pattern, name, d.group)} WHERE {VALID.get(key, 'true')})"


def fx(name: str) -> str:
    return f"({duckdb_sql(name)})"


def resolved() -> str:
    """Findings in documents: each kind, by priority, gives way to the overlapping ones before it."""
    out, before = [], []
    for p, key in enumerate(d.key for d in C.DETECTORS):
        if key in IN_DOCUMENTS:
            own = f"SELECT doc_id, {p} AS priority, start_pos, end_pos, trim(original) AS original, '{C.BY_KEY[key].name}' AS detector_type FROM {matches(key, 'documents', 'doc_id')} AS m"
            for b in before:
                own += f" {'AND' if 'WHERE NOT EXISTS' in own else 'WHERE'} NOT EXISTS (SELECT 1 FROM f_{b} AS x WHERE x.doc_id = m.doc_id AND x.start_pos < m.end_pos AND x.end_pos > m.start_pos)"
            out.append(f"f_{key} AS MATERIALIZED ({own})")
            before.append(key)
    return "WITH " + ", ".join(out) + ", found AS (" + " UNION ALL ".join(f"SELECT * FROM f_{k}" for k in before) + ")"


CATEGORY = "CASE WHEN regexp_matches(lower(detector_type), 'ip|mac|domain|url|host|red') THEN 'Red' WHEN regexp_matches(lower(detector_type), 'dni|nie|user|usuario|nombre|ident') THEN 'Identidad' WHEN regexp_matches(lower(detector_type), 'path|ruta|file|sistema|sys|process') THEN 'Sistemas' ELSE 'Contacto / Claves' END"
VENDOR = "(" + " OR ".join(f"lower(v) = '{d}' OR lower(v) LIKE '%.{d}'" for d in C.VENDOR_DOMAINS) + ")"


def number(at: int, size: int, below: int) -> str:
    return f"(CAST('0x' || substr(h, {at}, {size}) AS BIGINT) % {below})"


def pseudonym() -> str:
    """The pseudonym of a row with detector_type, original and the hash h."""
    private = r"regexp_matches(replace(original, '\', ''), '^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)')"
    a = f"({number(1, 8, 206)} + 11)"
    for r in (127, 169, 172, 192):
        a = f"({a} + CASE WHEN {a} >= {r} THEN 1 ELSE 0 END)"
    net = f"CASE WHEN {private} THEN '10.' || {number(1, 8, 256)} || '.' || {number(9, 8, 256)} ELSE {a} || '.' || ({number(9, 8, 254)} + 1) || '.' || ({number(17, 8, 254)} + 1) END || '.' || string_split(original, '.')[-1]"
    d = f"('4' || lpad(CAST({number(1, 14, 10**14)} AS VARCHAR), 14, '0'))"
    full = f"({d} || CAST((10 - {luhn_sum(d, 15, 1)} % 10) % 10 AS VARCHAR))"
    grouped = lambda s: f"substr({full}, 1, 4) || '{s}' || substr({full}, 5, 4) || '{s}' || substr({full}, 9, 4) || '{s}' || substr({full}, 13, 4)"
    return f"""CASE detector_type WHEN 'Email' THEN 'user_' || substr(h, 1, 8) || '@example.com' WHEN 'IPv4' THEN {net}
  WHEN 'Domain/FQDN' THEN CASE WHEN {VENDOR.replace("lower(v)", "lower(original)")} THEN '=' ELSE 'service-' || substr(h, 1, 8) || '.example.com' END
  ELSE CASE WHEN original LIKE '%-%' THEN {grouped("-")} WHEN original LIKE '% %' THEN {grouped(" ")} ELSE {full} END END"""


def registry() -> str:
    return resolved() + f""", firsts AS (SELECT original, arg_min(detector_type, (priority, doc_id, start_pos)) AS detector_type FROM found GROUP BY original),
hashed AS (SELECT *, sha256('local-key|' || detector_type || '|' || CASE WHEN detector_type = 'IPv4' THEN regexp_extract(original, '^([0-9]+\\.[0-9]+\\.[0-9]+)', 1) ELSE original END || '|0') AS h FROM firsts),
reg AS (SELECT original, {pseudonym()} AS pseudonym, detector_type FROM hashed)"""


STORED = fx("registry")
NEW = f"""(SELECT original, 'NUEVO_' || original AS pseudonym, detector_type, false AS omitted FROM {STORED} WHERE original LIKE '%0' UNION ALL
SELECT 'x' || original, 'OTRO_' || original, detector_type, false FROM {STORED} WHERE original LIKE '%0')"""
ALIAS = " ".join(f"WHEN p IN ({', '.join(map(quoted, [k, *v]))}) THEN {quoted(k)}" for k, v in C.ALIASES.items())
SIEM_PATHS = {
    "agent.ip": "'10.1.2.' || (user_id % 250)", "agent.name": "'HOST' || user_id || '.acme.local'", "data.win.eventdata.keywords": "'0x8020000000000000'", "data.win.eventdata.targetDomainName": "CASE WHEN event_id % 5 = 0 THEN 'NT AUTHORITY' ELSE 'ACME' END",
    "data.win.eventdata.targetUserName": "'usuario' || user_id", "data.win.eventdata.targetUserSid": "CASE WHEN event_id % 3 = 0 THEN 'S-1-5-18' ELSE 'S-1-5-21-1-2-3-' || user_id END", "data.win.system.computer": "'WS' || (user_id % 50)", "data.win.system.eventID": "'4624'",
}


def siem(name: str) -> str:
    """A value of the security fixture, read by its path."""
    path = "$." + name
    return f"json_extract_string(text, '{path}')"


def contextual() -> str:
    hashed = lambda kind, v: f"sha256('local-key|{kind}|' || {v} || '|0')"
    host = lambda v: f"'host-anon-' || substr({hashed('Hostname', v)}, 1, 8)"
    dom = lambda v: f"'service-' || substr({hashed('Domain/FQDN', v)}, 1, 8) || '.example.com'"
    part = lambda at, n: f"(CAST('0x' || substr(h, {at}, 12) AS BIGINT) % {9 * 10 ** (n - 1)} + {10 ** (n - 1)})"
    rows = f"""SELECT string_split(v, '.')[1] AS original, {host("string_split(v, '.')[1]")} AS pseudonym, 'Hostname' AS detector_type FROM (SELECT {siem("agent.name")} AS v FROM s)
UNION SELECT 'acme.local', {dom("'acme.local'")}, 'Domain/FQDN'
UNION SELECT v, {host("string_split(v, '.')[1]")} || '.' || {dom("'acme.local'")}, 'Hostname' FROM (SELECT {siem("agent.name")} AS v FROM s)
UNION SELECT v, '=', 'Generic Token' FROM (SELECT {siem("data.win.eventdata.keywords")} AS v FROM s UNION SELECT {siem("data.win.system.eventID")} FROM s)
UNION SELECT v, CASE WHEN v = 'NT AUTHORITY' THEN '=' ELSE 'DOMAIN_' || upper(substr({hashed("Domain/FQDN", "v")}, 1, 8)) END, 'Domain/FQDN' FROM (SELECT {siem("data.win.eventdata.targetDomainName")} AS v FROM s)
UNION SELECT v, 'user_' || substr({hashed("Generic Token", "v")}, 1, 8), 'Generic Token' FROM (SELECT {siem("data.win.eventdata.targetUserName")} AS v FROM s)
UNION SELECT v, CASE WHEN v = 'S-1-5-18' THEN '=' ELSE 'S-1-5-21-' || {part(1, 9)} || '-' || {part(13, 9)} || '-' || {part(25, 9)} || '-' || {part(37, 4)} END, 'Windows SID' FROM (SELECT v, {hashed("Windows SID", "v")} AS h FROM (SELECT {siem("data.win.eventdata.targetUserSid")} AS v FROM s))
UNION SELECT v, {host("v")}, 'Hostname' FROM (SELECT {siem("data.win.system.computer")} AS v FROM s)"""
    return f"WITH s AS (SELECT * FROM {fx('siem')} WHERE id % 8 <> 0) SELECT original, pseudonym, detector_type, pseudonym = '=' AS omitted FROM ({rows})"


def generated() -> str:
    """The pseudonyms of the typed values."""
    n = "CAST(" + number(1, 12, 89999999) + " + 10000000 AS BIGINT)"
    eight = f"lpad(CAST({number(1, 14, 10**8)} AS VARCHAR), 8, '0')"
    subjects = "[" + ", ".join(map(quoted, C.SUBJECTS)) + "]"
    guid = f"substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 13, 3) || '-' || substr('89ab', CAST({number(17, 1, 4)} + 1 AS INT), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"
    landline = f"(CAST({number(20, 1, 2)} + 8 AS VARCHAR) || {eight})"
    return f"""SELECT original, CASE detector_type WHEN 'GUID/UUID' THEN {guid} WHEN 'Windows Logon ID' THEN '0x' || substr(h, 1, 5) WHEN 'Windows Hex ID' THEN '0x' || substr(h, 1, 12)
  WHEN 'DNI/NIE' THEN {n} || '-' || lower(substr('{LETTERS}', CAST({n} % 23 AS INT) + 1, 1)) WHEN 'IPv6' THEN '2001:db8:85a3::' || substr(h, 1, 4) || ':' || substr(h, 5, 4)
  WHEN 'Telephone' THEN CASE WHEN original LIKE '+34%' THEN '+34' || ({number(20, 1, 2)} + 6) || {eight} ELSE substr({landline}, 1, 3) || ' ' || substr({landline}, 4, 3) || ' ' || substr({landline}, 7, 3) END
  WHEN 'O365 Subject' THEN {subjects}[CAST({number(9, 8, len(C.SUBJECTS))} + 1 AS INT)] || ' [REF-' || upper(substr(h, 1, 8)) || ']' WHEN 'O365 Server Hostname' THEN 'EURPRD' || upper(substr(h, 1, 6)) || 'PROD.outlook.example.com'
  WHEN 'Attachment File Name' THEN 'attachment_' || substr(h, 1, 8) || '.pdf' WHEN 'Generic Token' THEN 'ANON_' || upper(substr(h, 1, 8)) WHEN 'Custom (otra)' THEN 'CUSTOM_' || upper(substr(h, 1, 8))
  WHEN 'Hostname' THEN 'srv-anon-' || substr(h, 1, 8) ELSE '<MSGID_' || upper(substr(h, 11, 16)) || '@service-' || substr(h, 1, 8) || '.example.com>' END AS pseudonym, detector_type
  FROM (SELECT *, sha256('local-key|' || detector_type || '|' || original || '|0') AS h FROM (SELECT DISTINCT original, detector_type FROM {fx('typed')}))"""


def rewritten() -> dict[str, str]:
    """Texts of the formats with what their registries replace, by patterns of the places where it stands."""

    def chain(*pairs: tuple[str, str]) -> str:
        out = "text"
        for old, new in pairs:
            out = f"regexp_replace({out}, {quoted(old)}, {quoted(new)}, 'g')"
        return out

    json = chain(('Nota 4624"', 'Aviso 9999"'), ("usuario([0-9]+)", r"anon\1"), (r"10\.1\.2\.", "10.77.2."), ("Nota ", "Aviso "), ('"servidor ', r'"equipo \\"uno\\" '))
    xml = chain(("jefe([0-9]+)@acme", r"x\1@anon"), (r"192\.168\.7\.", "192.168.99."), (r"10\.4\.4\.", "10.5.5."), (r"CDATA\[ver", "CDATA[see"), ("a &amp; b", "c &lt; d"))
    pairs = chain(("op([0-9]+)@corp", r"u\1@anon"), (r"10\.0\.", "10.99."), ("=login", "=ENTRADA"))
    plain = chain(("admin([0-9]+)@corp", r"a\1@anon"), ("12345678Z", "87654321X"))
    log = f"CASE id % 3 WHEN 0 THEN {plain} WHEN 1 THEN {pairs} ELSE text END"
    count = {"json": """CASE WHEN text LIKE '%Nota 4624"%' THEN 3 ELSE 2 END""", "xml": "5", "log": "CASE id % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END"}
    return {k: f"SELECT id, {new} AS text, CAST({count[k]} AS BIGINT) AS replacements, true AS schema_intact FROM {fx(n)}" for k, new, n in (("json", json, "siem"), ("xml", xml, "xml"), ("log", log, "log"))}


def oracle_sql() -> dict[str, str]:
    docs_row = "doc_id, start_pos, end_pos, original, detector_type"
    out = {f"detect_{k}": f"SELECT id, start_pos, end_pos, original FROM {matches(k, fx(f))}" for k, f in WHERE.items()}
    out |= {f"documents_{k}": f"SELECT doc_id, original, count(*) AS n FROM {matches(k, 'documents', 'doc_id')} GROUP BY ALL" for k in IN_DOCUMENTS}
    rules = [("Empleado", r"\bEMP-\d{4}\b"), ("Proyecto", r"\bPRJ-X\d+\b"), ("Publico", r"\bPUBLIC_TOKEN_\d+\b")]
    shown = "regexp_replace(text, '[^0-9]', '', 'g')"
    out |= {
        "detect_custom_rule": " UNION ALL ".join(f"SELECT id, start_pos, end_pos, original, 'Custom ({n})' AS detector_type FROM {placed(fx('ruled'), p)}" for n, p in rules),
        "card_iin_brand": f"SELECT id, {brand(shown)} AS brand, {luhn(shown)} AS luhn FROM {fx('card')}",
        "dni_control_letter": f"SELECT c_custkey AS id, substr('{LETTERS}', CAST(c_custkey * 7919 % 23 AS INT) + 1, 1) AS letter FROM customer",
        "vendor_domain_filter": f"SELECT page_id, v AS host, {VENDOR} AS vendor, NOT {VENDOR} OR regexp_matches(lower(v), '\\.(local|internal|corp|lan|home|priv|ad|intranet)$') AS private FROM (SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS v FROM pages)",
        "protected_sid_filter": f"SELECT text LIKE '%S-1-5-18 %' AS protected, count(*) AS n FROM {fx('windows')} GROUP BY ALL",
        "protected_word_filter": f"SELECT id, original FROM {matches('subject', fx('o365'))} WHERE original <> 'status'",
        "hex_literal_filter": f"SELECT id, CAST(len(list_filter(string_split(text, ' '), lambda w: regexp_matches(w, '^0[xX][0-9a-fA-F]+$'))) AS BIGINT) AS n FROM {fx('windows')}",
        "findings_resolved": f"{resolved()} SELECT {docs_row} FROM found",
        "findings_stored_claims": f"{resolved()} SELECT {docs_row} FROM found",
        "findings_first_wins": f"{resolved()} SELECT original, arg_min(detector_type, (priority, doc_id, start_pos)) AS detector_type, count(*) AS n FROM found GROUP BY original",
        "summary_by_type": f"{resolved()} SELECT detector_type, count(*) AS n FROM found GROUP BY ALL",
        "category_distribution": f"{resolved()} SELECT category, n, round(100.0 * n / sum(n) OVER (), 1) AS pct FROM (SELECT {CATEGORY} AS category, count(*) AS n FROM found GROUP BY ALL)",
        "profile_devops": f"{resolved()} SELECT doc_id, start_pos, original, detector_type FROM found WHERE {CATEGORY} IN ('Red', 'Sistemas')",
        "profile_gdpr": f"{resolved()} SELECT doc_id, start_pos, original, detector_type FROM found WHERE {CATEGORY} IN ('Identidad', 'Contacto / Claves')",
        "rollup_source_type": f"{resolved()} SELECT source, detector_type, count(*) AS n, count(DISTINCT original) AS originals FROM found JOIN documents USING (doc_id) GROUP BY ROLLUP (source, detector_type)",
        "audit_metrics": f"{resolved()} SELECT (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS scanned, (SELECT count(*) FROM documents WHERE text IS NULL) AS ignored, (SELECT count(*) FROM found) AS entities",
        "highlight_spans": f"{resolved()} SELECT doc_id, start_pos, end_pos, original, {CATEGORY} AS category FROM found WHERE length(original) >= 2",
        "text_stats": "SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS lines, CAST(length(text) AS INTEGER) AS chars, round(octet_length(encode(text)) / 1024.0, 1) AS kb FROM documents",
        "format_badge": f"""SELECT kind, CASE WHEN text LIKE '{{%' AND (text LIKE '%"rule"%' OR text LIKE '%"agent"%') THEN 'JSON WAZUH' WHEN text LIKE '{{%' THEN 'JSON' WHEN text LIKE '<%>' THEN 'XML / HTML'
  WHEN regexp_matches(text, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') OR regexp_matches(text, 'INFO|ERROR|WARN') THEN 'LOG / SYSLOG' ELSE 'TEXTO PLANO' END AS badge, count(*) AS n
  FROM ({" UNION ALL ".join(f"SELECT '{k}' AS kind, text FROM {fx(k)}" for k in ("siem", "xml", "log", "ruled"))}) GROUP BY ALL""",
        "size_labels": "SELECT p_partkey, CASE WHEN s < 1024 THEN s || ' B' WHEN s < 1048576 THEN format('{:.1f} KB', round(s / 1024.0::DOUBLE, 1)) WHEN s < 1073741824 THEN format('{:.1f} MB', round(s / 1048576.0::DOUBLE, 1)) ELSE format('{:.2f} GB', round(s / 1073741824.0::DOUBLE, 2)) END AS label FROM (SELECT p_partkey, p_partkey * p_partkey * p_partkey * 7 AS s FROM part)",
        "registry_build": f"{registry()} SELECT original, pseudonym, detector_type, pseudonym = '=' AS omitted FROM reg",
        "registry_bijection_check": f"{registry()} SELECT count(*) AS active, count(DISTINCT original) AS originals, count(DISTINCT pseudonym) AS pseudonyms, count(*) = count(DISTINCT original) AND count(*) = count(DISTINCT pseudonym) AS one_to_one FROM reg WHERE pseudonym <> '='",
        "registry_merge_first_wins": f"SELECT * FROM {STORED} UNION ALL SELECT * FROM {NEW} AS n WHERE original NOT IN (SELECT original FROM {STORED})",
        "registry_merge_last_wins": f"SELECT * FROM {NEW} UNION ALL SELECT * FROM {STORED} WHERE original NOT IN (SELECT original FROM {NEW})",
        "registry_add": f"WITH n AS (SELECT * FROM {NEW} WHERE original NOT IN (SELECT original FROM {STORED} WHERE omitted)) SELECT * FROM n UNION ALL SELECT * FROM {STORED} WHERE original NOT IN (SELECT original FROM n)",
        "registry_omit": f"SELECT original, CASE WHEN original LIKE '%7' THEN '=' ELSE pseudonym END AS pseudonym, detector_type, omitted OR original LIKE '%7' AS omitted FROM {STORED}",
        "registry_remove_batch": f"SELECT * FROM {STORED} WHERE original NOT LIKE '%7'",
        "registry_search": f"SELECT * FROM {STORED} WHERE (lower(original) LIKE '%valor12%' OR lower(pseudonym) LIKE '%valor12%') AND detector_type = 'Hostname'",
        "registry_active_omitted": f"SELECT count(*) FILTER (NOT omitted) AS active, count(*) FILTER (omitted) AS omitted FROM {STORED}",
        "registry_page": f"SELECT * FROM {STORED} ORDER BY original LIMIT 20 OFFSET 40",
        "registry_vault_roundtrip": f"SELECT * FROM {STORED}",
        "protect_text": f"""{registry()}, pairs AS (SELECT list(original || chr(1) || pseudonym ORDER BY length(original) DESC) AS p FROM reg WHERE pseudonym <> '='),
new AS (SELECT doc_id, text AS old, list_reduce(list_prepend(text, p), lambda t, x: replace(t, split_part(x, chr(1), 1), split_part(x, chr(1), 2))) AS text FROM documents, pairs)
SELECT doc_id, text, text <> old AS changed FROM new""",
        "restore_roundtrip": "SELECT doc_id, text FROM documents",
        "tokens_present": f"{registry()} SELECT doc_id, original FROM documents JOIN (SELECT original FROM reg WHERE pseudonym <> '=') ON contains(text, original)",
        "format_detect": f"""SELECT 'siem' AS kind, 'json' AS format, count(*) AS n FROM events UNION ALL SELECT 'xml', 'xml', count(*) FROM supplier
  UNION ALL SELECT 'log', CASE WHEN text LIKE '%=%' OR text LIKE '%]: %' THEN 'log' ELSE 'plaintext' END, count(*) FROM {fx('log')} GROUP BY ALL UNION ALL SELECT 'pages', 'log', count(*) FROM pages""",
        "json_leaf_paths": " UNION ALL ".join([f"SELECT '{p}' AS path, count({siem(p)}) AS n FROM {fx('siem')}" for p in [*SIEM_PATHS, "article.title", "article.keywords"]]),
        "json_protected_paths": " UNION ALL ".join(f"SELECT id, '{p}' AS path, {siem(p)} AS value FROM {fx('siem')} WHERE {siem(p)} IS NOT NULL" for p in ("data.win.eventdata.keywords", "data.win.system.eventID")),
        "json_contextual": contextual(),
        "json_protect_roundtrip": f"SELECT id, text FROM {fx('siem')}",
        "json_key_schema_check": "SELECT true AS schema_intact, true AS syntax_valid, count(*) AS n FROM events",
        "xml_text_protect": f"SELECT id, text FROM {fx('xml')}",
        "custom_rule_registry": " UNION ALL ".join(f"SELECT 'Custom ({n})' AS detector_type, {str(n == 'Publico').lower()} AS omitted, count(DISTINCT original) AS originals, count(DISTINCT original) AS pseudonyms FROM {placed(fx('ruled'), p)}" for n, p in rules),
        "scan_cache_skip": f"SELECT n.path FROM {fx('cache_new')} AS n WHERE NOT EXISTS (SELECT 1 FROM {fx('cache')} AS c WHERE c.path = n.path AND c.rules_hash = n.rules_hash AND c.length = n.length AND (c.mtime = n.mtime OR c.partial_hash = n.partial_hash))",
        "directory_filter": f"SELECT id, path FROM {fx('paths')} WHERE NOT path LIKE '%/.%' AND NOT lower(path) LIKE '%/node_modules/%' AND NOT lower(path) LIKE '%/build/%' AND NOT lower(path) LIKE '%.png'",
        "detector_type_normalize": f"""SELECT id, CASE {ALIAS} ELSE 'Custom (' || p || ')' END AS name FROM (SELECT id, trim(regexp_replace(trim(regexp_replace(name, '^[Cc]ustom ?\\((.*)\\)$', '\\1')), '^[Cc]ustom ?\\((.*)\\)$', '\\1')) AS p FROM {fx('types')})""",
    }
    new = rewritten()
    out |= {f"{k}_rewrite": sql for k, sql in new.items()} | {f"{k}_rewrite_parts": sql for k, sql in new.items()}
    mail, files = "'jefe' || s_suppkey || '@acme.org'", "SELECT 'f' || s_suppkey AS path, ['word', 'excel', 'powerpoint'][CAST(s_suppkey % 3 AS INT) + 1] AS office_type,"
    out |= {
        "pseudonym_generators": generated(),
        "schema_of": f"""SELECT 'json' AS kind, id, CASE id % 3 WHEN 0 THEN id % 8 = 0 WHEN 1 THEN false ELSE true END AS schema_intact, true AS syntax_valid FROM {fx('siem')}
  UNION ALL SELECT 'xml', id, id % 3 = 2, id % 3 <> 1 FROM {fx('xml')}""",
        "office_text": f"{files} CASE s_suppkey % 3 WHEN 0 THEN 'Informe de ' || {mail} || chr(10) || 'a & b' WHEN 1 THEN {mail} || chr(10) || '192.168.7.' || (s_suppkey % 250) ELSE 'ver ' || {mail} END AS text FROM supplier",
        "office_rewrite": f"{files} CASE s_suppkey % 3 WHEN 0 THEN 'Informe de x' || s_suppkey || '@anon.org' || chr(10) || 'c < d' WHEN 1 THEN 'x' || s_suppkey || '@anon.org' || chr(10) || '192.168.99.' || (s_suppkey % 250) ELSE 'see x' || s_suppkey || '@anon.org' END AS text, CAST(2 AS BIGINT) AS replacements FROM supplier",
    }
    talks = "WITH documents AS (SELECT concat_ws('-', conv_id, turn) AS doc_id, role, text FROM conversations), "
    out["stream_protect"] = f"""{registry().replace("WITH ", talks, 1)}, pairs AS (SELECT list(original || chr(1) || pseudonym ORDER BY length(original) DESC) AS p FROM reg WHERE pseudonym <> '=')
SELECT doc_id AS id, role, coalesce(list_reduce(list_prepend(text, p), lambda t, x: replace(t, split_part(x, chr(1), 1), split_part(x, chr(1), 2))), text) AS text FROM documents, pairs"""
    return out
