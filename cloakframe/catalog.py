"""What is detected, in which order, and the word lists that decide it."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Detector:
    """A kind of sensitive value: its display name, pattern, and a cheap test that texts without it fail."""

    key: str
    name: str
    pattern: str
    hint: str | None = None
    group: int = 0


# The patterns are the meaning of the detectors. In order of priority.
DETECTORS = [
    Detector("guid", "GUID/UUID", r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b", "-"),
    Detector("sid", "Windows SID", r"\bS-1-(?:[0-59]|16)(?:-\d+)+\b", "S-1-"),
    Detector("logon_id", "Windows Logon ID", r"(?i)\b0x[0-9a-f]{4,8}\b", "0x"),
    Detector("hex_id", "Windows Hex ID", r"(?i)\b0x[0-9a-f]{9,}\b", "0x"),
    Detector("dni_nie", "DNI/NIE", r"(?i)\b(?:([XYZxyz])[\s-]*(\d{7})|(\d{8}))[\s-]*([A-Za-z])\b"),
    Detector("card", "Credit Card", r"\b(?:\d{4}[-\s]?){3}\d{4}\b|\b\d{13,19}\b"),
    Detector("email", "Email", r"(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b", "@"),
    Detector("ipv4", "IPv4", r"\b(?:[0-9]{1,3}\\?\.){3}[0-9]{1,3}\b", "."),
    Detector("ipv6", "IPv6", r"(?i)\b(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}\b|\b(?:[0-9a-f]{1,4}:){1,7}:[0-9a-f]{1,4}\b", ":"),
    Detector("domain", "Domain/FQDN", r"(?i)\b(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+(?:com|org|net|edu|gov|io|es|eu|local|internal|corp|lan|home|priv|intranet)\b", "."),
    Detector("subject", "O365 Subject", r'(?i)"Subject"\s*:\s*"([^"]+)"', '"', 1),
    Detector("server", "O365 Server Hostname", r'(?i)"OriginatingServer"\s*:\s*"([a-zA-Z0-9.-]+)"', '"', 1),
    Detector("attachment", "Attachment File Name", r"(?i)\b([a-zA-Z0-9_\-\s]{3,}\.(?:docx?|xlsx?|pdf|pptx?|jpg|png|zip|rar|7z|txt|csv|md|markdown))\b", "."),
    Detector("hostname", "Hostname", r"(?i)\b(?:host|srv|server|dc|ws|node|app)-?[a-z0-9]{2,10}\b"),
    Detector("phone", "Telephone", r"(?:(?:\+|00)34[\s.-]?|\b)(?:[89]\d[\s.-]?\d{3}[\s.-]?\d{2}[\s.-]?\d{2}|[6789]\d{2}[\s.-]?(?:\d{3}[\s.-]?\d{3}|\d{2}[\s.-]?\d{2}[\s.-]?\d{2})|[6789]\d{8})\b"),
]
GENERIC = "Generic Token"
BY_KEY = {d.key: d for d in DETECTORS}

# Other spellings of the display names.
ALIASES = {
    "GUID/UUID": ["GuidUuid", "GUID", "UUID"],
    "Windows SID": ["WindowsSid", "SID"],
    "Windows Logon ID": ["WindowsLogonId"],
    "Windows Hex ID": ["WindowsHexId"],
    "IPv4": [],
    "IPv6": [],
    "Domain/FQDN": ["DomainFqdn", "Domain", "FQDN"],
    "Email": [],
    "Hostname": [],
    "DNI/NIE": ["SpanishDniNie", "DNI", "NIE"],
    "Credit Card": ["CreditCard"],
    "Telephone": ["Phone"],
    "O365 Subject": ["O365Subject"],
    "O365 Server Hostname": ["O365OriginatingServer"],
    "Attachment File Name": ["AttachmentFileName"],
    "Generic Token": ["GenericToken"],
}

# Fixed value: control letters of Spanish identity numbers, by number modulo 23.
CONTROL_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"

# Security identifiers that every Windows machine has.
PROTECTED_SIDS = ["S-1-0-0", "S-1-1-0", "S-1-2-0", "S-1-3-0", "S-1-3-1", "S-1-5-18", "S-1-5-19", "S-1-5-20"]

# Words of code, SQL and HTTP that are never taken for sensitive.
# Stop words of natural languages come from the configuration (`protected_words`).
PROTECTED_WORDS = (
    "fn let mut pub struct enum impl trait match loop while for if else return break continue true false null nil "
    "def class import from as try except finally raise with async await lambda yield pass "
    "select insert update delete drop table create alter where group order having join inner outer left right union distinct "
    "count sum avg max min primary foreign key references default check index "
    "http https get post put delete patch head options trace connect host user-agent accept content-type content-length "
    "authorization cookie set-cookie referer origin status headers body"
).split()

# Domains of software vendors and public infrastructure, which hold nothing confidential.
VENDOR_DOMAINS = (
    "microsoft.com microsoftonline.com windows.com windows.net office.com office365.com outlook.com live.com azure.com msft.net "
    "trafficmanager.net msn.com visualstudio.com azureedge.net sharepoint.com onedrive.com skype.com bing.com microsoftstream.com lync.com yammer.com "
    "google.com googleapis.com gstatic.com googleusercontent.com gmail.com gvt1.com android.com chromium.org "
    "amazon.com amazonaws.com cloudfront.net cloudflare.com cloudflare-dns.com fastly.net akamai.net akamaiedge.net "
    "github.com githubusercontent.com gitlab.com "
    "wazuh.com elastic.co splunk.com crowdstrike.com sentinelone.com virustotal.com debian.org ubuntu.com redhat.com centos.org kernel.org gnu.org apache.org "
    "apple.com icloud.com apple-dns.net digicert.com letsencrypt.org verisign.com sectigo.com entrust.net pool.ntp.org "
    "example.com"
).split()

# Endings of private domains.
PRIVATE_ENDINGS = [".local", ".internal", ".corp", ".lan", ".home", ".priv", ".ad", ".intranet"]

# Path segments of security events, and keys that are protected in them.
SECURITY_SEGMENTS = ["eventdata", "event_data", "win", "system", "security", "audit", "wazuh", "agent", "manager", "sysmon", "winlog", "data"]
PROTECTED_KEYS = ["keywords", "targetlogonid", "subjectlogonid", "logonid"]
TECHNICAL_KEYS = ["eventid", "processid", "threadid", "opcode", "level", "task", "version"]
IGNORED_KEYS = [*PROTECTED_KEYS, *TECHNICAL_KEYS, "id"]
SYSTEM_DOMAINS = ["NT AUTHORITY", "BUILTIN", "WORKGROUP", "-", "."]

# Words before a number that make it a hash, or an identifier or time.
HASH_WORDS = ["sha", "md5", "hash", "checksum", "digest", "etag", "commit"]
NUMBER_WORDS = ['id"', "id'", "id:", "id=", "timestamp", "date", "time", "created", "updated", "size", "length", "count"]

# What a directory scan leaves out.
IGNORED_DIRECTORIES = [".git", "node_modules", "target", ".vagrant", ".vagrant.d", ".vscode", ".idea", "vendor", "dist", "build"]
IGNORED_EXTENSIONS = "png jpg jpeg gif ico svg webp pdf zip tar gz tgz bz2 7z rar xz zst iso 7zip exe bin dll so dylib lock woff woff2 ttf eot mp4 mp3 avi mkv".split()
BINARY_EXTENSIONS = (
    "zip gz tar tgz bz2 tbz2 xz txz 7z rar zst iso cab deb rpm apk jar war ear exe dll so dylib bin o a obj pyc class wasm "
    "png jpg jpeg gif bmp ico webp tiff psd mp3 mp4 mkv avi mov wav flac ogg webm pdf db sqlite sqlite3 mdb woff woff2 ttf eot otf vault"
).split()
# First bytes of compressed files (gzip, zip, 7z, bzip2, xz, zstd, rar), in hexadecimal.
MAGIC = ["1F8B", "504B0304", "377ABCAF271C", "425A68", "FD377A585A00", "28B52FFD", "52617221"]

# Topics of synthetic subjects.
SUBJECTS = ["Reunión de seguimiento", "Informe mensual", "Actualización de proyecto", "Revisión de documentación", "Planificación semanal", "Consulta general"]
