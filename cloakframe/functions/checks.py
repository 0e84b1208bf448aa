"""Validators and context tests, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe import catalog as C
from cloakframe.functions.spans import after, before, last_bytes


def control_letter(number: Column) -> Column:
    """The control letter of an identity number."""
    return F.substr(F.lit(C.CONTROL_LETTERS), (number % 23 + 1).cast("int"), F.lit(1))


def is_dni_nie(value: Column) -> Column:
    """Nine ASCII letters and digits, of which the last is the control letter of the rest; X, Y, Z in front stand for 0, 1, 2."""
    s = F.upper(F.regexp_replace(value, "[^A-Za-z0-9]", ""))
    number = F.translate(F.substring(s, 1, 8), "XYZ", "012")
    valid = (F.length(s) == 9) & s.rlike("^[XYZ0-9][0-9]{7}")
    return F.when(valid, control_letter(number.cast("long")) == F.right(s, F.lit(1))).otherwise(False)


def card_brand(digits: Column, strict: bool = False) -> Column:
    """The network of a card number by its first digits and length, null if none.

    `strict` compares three-digit ranges (Diners 300-305, Discover 644-649) with
    three digits; by default with four, so that only 0300 and 0644 on match.
    """
    n = F.length(digits)
    first = lambda k: F.substring(digits, 1, k).cast("int")
    three = first(3 if strict else 4)
    brand = (
        F.when((F.substring(digits, 1, 1) == "4") & n.isin(13, 16, 19), "Visa")
        .when((n == 16) & (first(2).between(51, 55) | first(4).between(2221, 2720)), "Mastercard")
        .when(first(2).isin(34, 37) & (n == 15), "American Express")
        .when(n.isin(16, 19) & ((first(4) == 6011) | three.between(644, 649) | (first(2) == 65) | first(6).between(622126, 622925)), "Discover")
        .when(three.between(300, 305) | first(2).isin(36, 38), "Diners Club")
        .when(first(4).between(3528, 3589) & (n >= 16), "JCB")
        .when(first(2).isin(50, 56, 57, 58), "Maestro")
        .when((first(2) == 62) & (n >= 16), "UnionPay")
        .when(first(4).between(2200, 2204) & (n == 16), "Mir")
    )
    return F.when(n.between(13, 19), brand)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def is_luhn(digits: Column) -> Column:
    """The checksum alone."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(places, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def is_card(value: Column, strict: bool = False) -> Column:
    """13 to 19 digits, not all equal, of a known network, with a right checksum."""
    d = digits_of(value)
    ok = F.length(d).between(13, 19) & (F.replace(d, F.substring(d, 1, 1), F.lit("")) != "") & card_brand(d, strict).isNotNull()
    return F.when(ok, is_luhn(d)).otherwise(False)


_STOP = r"\s\"'<>(){}\[\],;"


def card_stands_alone(text: Column, start: Column, end: Column) -> Column:
    """Not part of a longer token, a path, or a hash by its surroundings."""
    left, right = before(text, start), after(text, end)
    # \z, as $ also stands before a line's end
    joined = left.rlike(r"[A-Za-z0-9_]\z|[A-Za-z0-9][-.:/\\]\z") | right.rlike(r"^[A-Za-z0-9_]|^[-.:/\\][A-Za-z0-9]")
    lettered = left.rlike(rf"(?U)[A-Za-z][^{_STOP}]*\z") | right.rlike(f"(?U)^[^{_STOP}]*[A-Za-z]")
    hashed = F.lower(last_bytes(text, start, 40)).rlike("|".join(C.HASH_WORDS))
    return ~(joined | lettered | hashed)


def phone_in_context(text: Column, start: Column, end: Column) -> Column:
    """Not part of a SID, nor an identifier, time, size or fraction by its surroundings."""
    wide = F.lower(last_bytes(text, start, 30))
    wrong = (
        F.lower(last_bytes(text, start, 10)).rlike("s-1-|sid")
        | after(text, end, 1).eqNullSafe("-")
        | wide.rlike("|".join(map(re.escape, C.NUMBER_WORDS)))
        | wide.endswith(".")
        | before(text, start, 1).rlike(r"^[\p{L}\p{N}]$")
    )
    return ~wrong


_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"


def is_ipv4(value: Column) -> Column:
    """Four numbers up to 255 without leading zeros; the dots may be escaped."""
    return F.regexp_replace(value, r"\\", "").rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")


def ipv4_in_context(text: Column, start: Column, end: Column) -> Column:
    """Not part of a longer dotted number."""
    return ~(before(text, start, 1).eqNullSafe(".") | after(text, end, 3).rlike(r"^\\?\.[A-Za-z0-9.]"))


def is_vendor_domain(domain: Column) -> Column:
    """A vendor's domain or one below it."""
    known = "|".join(map(re.escape, C.VENDOR_DOMAINS))
    return F.lower(F.regexp_replace(F.trim(domain), r"\.+$", "")).rlike(rf"(?:^|\.)(?:{known})\z")


def is_private_domain(domain: Column) -> Column:
    """A private ending, or no vendor's domain."""
    low = F.lower(F.regexp_replace(F.trim(domain), r"\.+$", ""))
    return low.rlike("(?:" + "|".join(map(re.escape, C.PRIVATE_ENDINGS)) + r")\z") | ~is_vendor_domain(domain)


def is_protected_word(value: Column, more: tuple[str, ...] = ()) -> Column:
    return F.lower(value).isin([*C.PROTECTED_WORDS, *more])


def is_protected_sid(value: Column) -> Column:
    return value.isin(C.PROTECTED_SIDS)


def is_hex_literal(value: Column) -> Column:
    return F.trim(value).rlike(r"^0[xX][0-9a-fA-F]+$")


def in_security_path(path: Column) -> Column:
    """Whether any segment of a path (array of keys) belongs to security events."""
    return F.arrays_overlap(F.transform(path, F.lower), F.array(*map(F.lit, C.SECURITY_SEGMENTS)))


def is_protected_path(path: Column, value: Column) -> Column:
    """Whether a JSON value must stay: technical keys in security events, or with technical values."""
    key = F.lower(F.try_element_at(path, F.lit(-1)))
    inside = in_security_path(path) | is_hex_literal(value)
    return F.coalesce(F.when(key.isin(C.PROTECTED_KEYS), inside).when(key.isin(C.TECHNICAL_KEYS), inside | value.rlike(r"^[0-9]*\z")), F.lit(False))


def is_ignored_key(key: Column) -> Column:
    return F.lower(key).isin(C.IGNORED_KEYS)


def normalize_type(name: Column) -> Column:
    """The display name of a type: wrappings `Custom(...)` are taken off, other spellings replaced; an unknown name is `Custom (name)`.

    A name without any wrapping is read like a wrapped one. Wrappings are taken off until none is left: as many
    as there are both openings before the name and closing brackets after it.
    """
    plain, head, tail = F.trim(name), r"(?:[Cc]ustom ?\( *)", r"(?:\) *)"
    opened = F.regexp_count(F.regexp_extract(plain, f"^{head}*+", 0), F.lit(r"\("))
    closed = F.regexp_count(F.regexp_extract(plain, rf"{tail}*+\z", 0), F.lit(r"\)"))
    times = F.concat(F.lit("{"), F.least(opened, closed).cast("string"), F.lit("}+"))
    plain = F.regexp_replace(plain, F.concat(F.lit(f"^{head}"), times), F.lit(""))
    plain = F.trim(F.regexp_replace(plain, F.concat(F.lit(tail), times, F.lit(r"\z")), F.lit("")))
    out = F.lit(None).cast("string")
    for shown, others in C.ALIASES.items():
        out = F.when(plain.isin([shown, *others]), shown).otherwise(out)
    return F.when(name.isNotNull(), F.coalesce(out, F.concat(F.lit("Custom ("), plain, F.lit(")"))))
