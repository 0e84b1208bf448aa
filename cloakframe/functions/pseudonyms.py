"""Synthetic values that keep an original's form, as Column expressions.

Every value is cut from a keyed hash of the original, so the same key gives
the same value in every task, retry and run. `attempt` gives the next candidate
where two originals would get one value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe import catalog as C
from cloakframe.functions.checks import control_letter, is_vendor_domain

DEFAULT_KEY = "local-key"


def keyed_hash(key: str, kind: Column | str, slot: Column, attempt: Column) -> Column:
    """64 hexadecimal digits."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind) if isinstance(kind, str) else kind, slot, attempt.cast("string")), 256)


def number(h: Column, at: int, size: int, below: int) -> Column:
    """A number from some digits of the hash (at most 15)."""
    return F.conv(F.substring(h, at, size), 16, 10).cast("long") % below


def digits(h: Column, at: int, n: int) -> Column:
    """n decimal digits, at most 15."""
    return F.lpad(number(h, at, 14, 10**n).cast("string"), n, "0")


def slot(kind: Column, original: Column) -> Column:
    """What is hashed: the /24 network of an IPv4 address, so that neighbours stay neighbours, else the original."""
    return F.when(kind == "IPv4", F.regexp_extract(F.regexp_replace(original, r"\\", ""), r"^(\d+\.\d+\.\d+)", 1)).otherwise(original)


def upper_if(original: Column, value: Column) -> Column:
    """Upper case if the original has capitals among its letters and no small ones."""
    return F.when(original.rlike("[A-Z]") & ~original.rlike("[a-z]"), F.upper(value)).otherwise(value)


def guid(original: Column, h: Column) -> Column:
    variant = F.substr(F.lit("89ab"), (number(h, 17, 1, 4) + 1).cast("int"), F.lit(1))
    made = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 13, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return upper_if(original, made)


def sid(original: Column, h: Column) -> Column:
    part = lambda at, n: (number(h, at, 12, 9 * 10 ** (n - 1)) + 10 ** (n - 1)).cast("string")
    return F.concat_ws("-", F.lit("S-1-5-21"), part(1, 9), part(13, 9), part(25, 9), part(37, 4))


def logon_id(original: Column, h: Column) -> Column:
    width = F.greatest(F.length(original) - 2, F.lit(4))
    made = F.concat(F.lit("0x"), F.substr(h, F.lit(1), width))
    return F.when(F.substring(original, 3, 99).rlike("[A-F]"), F.concat(F.lit("0x"), F.upper(F.substr(h, F.lit(1), width)))).otherwise(made)


def hex_id(original: Column, h: Column) -> Column:
    """As many hexadecimal digits as the original has, each in the case of the one it replaces."""
    chars = F.transform(F.split(F.substr(original, F.lit(3), F.length(original)), ""), lambda c, i: F.when(c.rlike("[A-F]"), F.upper(F.substr(h, i % 64 + 1, F.lit(1)))).otherwise(F.substr(h, i % 64 + 1, F.lit(1))))
    return F.concat(F.substring(original, 1, 2), F.array_join(chars, ""))


def dni(original: Column, h: Column) -> Column:
    n = number(h, 1, 12, 89_999_999) + 10_000_000
    letter = F.when(F.right(original, F.lit(1)).rlike("[a-z]"), F.lower(control_letter(n))).otherwise(control_letter(n))
    return F.concat(n.cast("string"), F.when(original.contains("-"), "-").otherwise(""), letter)


def card(original: Column, h: Column) -> Column:
    d = F.concat(F.lit("4"), digits(h, 1, 14))
    each = F.transform(F.sequence(F.lit(1), F.lit(15)), lambda i: F.substr(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    total = F.aggregate(each, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0))
    full = F.concat(d, ((10 - total % 10) % 10).cast("string"))
    grouped = lambda sep: F.concat_ws(sep, *[F.substring(full, i, 4) for i in (1, 5, 9, 13)])
    return F.when(original.contains("-"), grouped("-")).when(original.contains(" "), grouped(" ")).otherwise(full)


def phone(original: Column, h: Column) -> Column:
    """Nine new digits in the places of the old ones; the country prefix and the kind of number stay."""
    prefix = F.regexp_extract(original, r"^(\+34|0034|)", 1)
    body = F.substr(original, F.length(prefix) + 1, F.length(original))
    landline = F.regexp_extract(body, r"(\d)", 1).isin("8", "9")
    first = (number(h, 20, 1, 2) + F.when(landline, 8).otherwise(6)).cast("string")
    new = F.concat(first, digits(h, 1, 8))
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))
    put = lambda a, c: F.when(c.rlike("^[0-9]$") & (a["at"] <= 9), F.struct((a["at"] + 1).alias("at"), F.concat(a["out"], F.substr(new, a["at"], F.lit(1))).alias("out"))).otherwise(F.struct(a["at"].alias("at"), F.concat(a["out"], c).alias("out")))
    return F.concat(prefix, F.aggregate(F.split(body, ""), start, put, lambda a: a["out"]))


def ipv4(original: Column, h: Column) -> Column:
    """Private networks go to 10.b.c, public ones to unreserved networks; the last number and escapes stay."""
    clean = F.regexp_replace(original, r"\\", "")
    private = clean.rlike(r"^(?:10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)")
    a = number(h, 1, 8, 206) + 11
    for reserved in (127, 169, 172, 192):
        a = a + F.when(a >= reserved, 1).otherwise(0)
    wide = lambda at: (number(h, at, 8, 254) + 1).cast("string")
    net = F.when(private, F.concat_ws(".", F.lit("10"), number(h, 1, 8, 256).cast("string"), number(h, 9, 8, 256).cast("string"))).otherwise(F.concat_ws(".", a.cast("string"), wide(9), wide(17)))
    made = F.concat_ws(".", net, F.substring_index(clean, ".", -1))
    return F.when(original.contains("\\"), F.replace(made, F.lit("."), F.lit("\\."))).otherwise(made)


def ipv6(original: Column, h: Column) -> Column:
    return F.concat(F.lit("2001:db8:85a3::"), F.substring(h, 1, 4), F.lit(":"), F.substring(h, 5, 4))


def email(original: Column, h: Column) -> Column:
    return F.concat(F.lit("user_"), F.substring(h, 1, 8), F.lit("@example.com"))


def domain(original: Column, h: Column) -> Column:
    again = F.regexp_extract(original, r"(\.?service-[0-9a-f]+\.example\.com)$", 1)
    below = original.rlike(r"\.service-[0-9a-f]+\.example\.com$")
    return F.when(below, F.concat(F.lit("sub-"), F.substring(h, 1, 4), again)).otherwise(F.concat(F.lit("service-"), F.substring(h, 1, 8), F.lit(".example.com")))


def hostname(original: Column, h: Column) -> Column:
    return F.concat(F.when(F.lower(original).startswith("srv"), "srv-anon-").otherwise("host-anon-"), F.substring(h, 1, 8))


def subject(original: Column, h: Column) -> Column:
    topic = F.element_at(F.array(*map(F.lit, C.SUBJECTS)), (number(h, 9, 8, len(C.SUBJECTS)) + 1).cast("int"))
    return F.concat(topic, F.lit(" [REF-"), F.upper(F.substring(h, 1, 8)), F.lit("]"))


def server(original: Column, h: Column) -> Column:
    return F.concat(F.lit("EURPRD"), F.upper(F.substring(h, 1, 6)), F.lit("PROD.outlook.example.com"))


def attachment(original: Column, h: Column) -> Column:
    return F.concat(F.lit("attachment_"), F.substring(h, 1, 8), F.lit("."), F.substring_index(original, ".", -1))


def generic(original: Column, h: Column) -> Column:
    return F.concat(F.lit("ANON_"), F.upper(F.substring(h, 1, 8)))


def unknown(original: Column, h: Column) -> Column:
    return F.concat(F.lit("CUSTOM_"), F.upper(F.substring(h, 1, 8)))


def message_id(original: Column, h: Column) -> Column:
    """MSGID_ and sixteen digits for the local part; a vendor's domain keeps its base, any other is replaced."""
    t = F.trim(original)
    bare = F.regexp_replace(F.regexp_replace(t, "^<+", ""), ">+$", "")
    angles = t.startswith("<") & t.endswith(">")
    host = F.substr(bare, F.instr(bare, "@") + 1, F.length(bare))
    parts = F.split(host, r"\.")
    base = F.when(host.contains(".example.com"), 3).otherwise(2)
    inner = F.size(parts) - base
    kept = F.concat_ws(".", F.transform(F.when(inner > 0, F.sequence(F.lit(0), inner - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit("sub"), i.cast("string"))), F.slice(parts, F.greatest(inner + 1, F.lit(1)), base))
    new = F.when(is_vendor_domain(host), F.when(F.size(parts) >= 3, kept).otherwise(host)).otherwise(domain(host, h))
    local = F.concat(F.lit("MSGID_"), F.upper(F.substring(h, 11, 16)))
    full = F.concat(local, F.lit("@"), new)
    return F.when(~bare.contains("@"), F.concat(F.lit("<"), local, F.lit(">"))).when(angles, F.concat(F.lit("<"), full, F.lit(">"))).otherwise(full)


GENERATORS = {
    "GUID/UUID": guid, "Windows SID": sid, "Windows Logon ID": logon_id, "Windows Hex ID": hex_id, "DNI/NIE": dni, "Credit Card": card, "Email": email, "IPv4": ipv4, "IPv6": ipv6,
    "Domain/FQDN": domain, "O365 Subject": subject, "O365 Server Hostname": server, "Attachment File Name": attachment, "Hostname": hostname, "Telephone": phone, "Generic Token": generic,
    "Custom (InternetMessageId)": message_id,
}


def custom(strategy: str, prefix: str | None, original: Column, h: Column) -> Column:
    """The value of a user's rule: new digits, hexadecimal or alphanumeric characters in their places, a numbered prefix, or a mask (which can't be restored)."""
    if strategy == "mask":
        return F.lit("***REDACTED***" if prefix is None else f"{prefix}***")
    if strategy == "prefix_seq":
        return F.concat(F.lit("CUSTOM_" if prefix is None else prefix), (number(h, 1, 12, 899_999) + 100_000).cast("string"))
    alphabet, wanted = {
        "random_digits": ("0123456789", "[0-9]"),
        "random_hex": ("0123456789ABCDEF", "[0-9A-Fa-f]"),
        "random_alphanumeric": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", r"[\p{L}\p{N}]"),
    }[strategy]
    long_hash = F.concat(h, F.sha2(F.concat(h, F.lit("1")), 256), F.sha2(F.concat(h, F.lit("2")), 256), F.sha2(F.concat(h, F.lit("3")), 256))
    new = lambda i: F.substr(F.lit(alphabet), (F.conv(F.substr(long_hash, i % 126 * 2 + 1, F.lit(3)), 16, 10).cast("int") % len(alphabet) + 1), F.lit(1))
    lower = lambda c: ~c.rlike(r"\p{Lu}") if strategy == "random_hex" else c.rlike(r"\p{Ll}")
    chars = F.transform(F.split(original, ""), lambda c, i: F.when(c.rlike(f"^{wanted}$"), F.when(lower(c), F.lower(new(i))).otherwise(new(i))).otherwise(c))
    return F.array_join(chars, "")
