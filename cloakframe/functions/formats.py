"""Formats of documents: recognition, rewriting of their values, and comparison of their structure.

Everything here works on one text; `cloakframe.operators.rewrite` applies it to columns.
"""

from __future__ import annotations

import json
import re
import xml.parsers.expat
from collections.abc import Callable, Iterator
from html import unescape

from cloakframe.config import FormatError

Replace = Callable[[str], tuple[str, int]]
JSON, XML, LOG, TEXT = "json", "xml", "log", "plaintext"
#: `key=value` pairs of log lines (a fixed value).
PAIR = re.compile(r'([a-zA-Z0-9_\-\.]+)=("?[^"\s]+"?[^"\s]*)')


def json_stream(text: str) -> list:
    """The values of a text of JSON values between white space; none if any part is wrong."""
    decoder, out, at = json.JSONDecoder(parse_constant=_no_constant), [], 0
    text = text.strip(" \t\r\n")
    try:
        while at < len(text):
            value, at = decoder.raw_decode(text, at)
            out.append(value)
            if isinstance(value, (int, float, str, bool)) or value is None:
                if at < len(text) and text[at] not in " \t\r\n{[\"":
                    return []
            while at < len(text) and text[at] in " \t\r\n":
                at += 1
    except (ValueError, RecursionError):
        return []
    return out


def _no_constant(name: str):
    raise ValueError(name)


def xml_tags(text: str) -> list[str] | None:
    """Opening tags in order, if the text is XML: it begins with `<` and ends with `>`, or begins with a declaration, and is well formed."""
    t = text.strip()
    if not (t.startswith("<") and t.endswith(">") or t.startswith("<?xml")):
        return None
    tags: list[str] = []
    parser = xml.parsers.expat.ParserCreate()
    parser.StartElementHandler = lambda name, _: tags.append(name)
    try:
        parser.Parse(t, True)
    except (xml.parsers.expat.ExpatError, ValueError):
        return None
    return tags


def is_log(text: str) -> bool:
    return any(PAIR.search(line) or " - - [" in line or "]: " in line for line in text.splitlines()[:10])


def format_of(text: str) -> str:
    """The first format that fits: JSON, XML, log, plain text."""
    if json_stream(text):
        return JSON
    if xml_tags(text) is not None:
        return XML
    return LOG if is_log(text) else TEXT


def leaves(value, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], str]]:
    """String leaves with their keys; places in arrays have no key. Keys in sorted order."""
    if isinstance(value, dict):
        for k in sorted(value):
            yield from leaves(value[k], (*path, k))
    elif isinstance(value, list):
        for v in value:
            yield from leaves(v, path)
    elif isinstance(value, str):
        yield path, value


def protected(path: tuple[str, ...], value: str) -> bool:
    """Whether a JSON value must stay (the scalar form of `checks.is_protected_path`)."""
    from cloakframe import catalog as C

    if not path:
        return False
    key, s = path[-1].lower(), value.strip()
    inside = any(p.lower() in C.SECURITY_SEGMENTS for p in path) or re.fullmatch(r"0[xX][0-9a-fA-F]+", s) is not None
    return key in C.PROTECTED_KEYS and inside or key in C.TECHNICAL_KEYS and (inside or re.fullmatch("[0-9]*", value) is not None)


def rewrite_json(text: str, replace: Replace, canonical: bool = False, scalars: bool = False) -> tuple[str, int]:
    """Replaces in string values; keys, numbers and protected paths stay.

    By default nothing but the strings changes. `canonical` writes the values
    anew with sorted keys: several on a line each, one spread over lines if it
    was. Bare scalars are left alone unless `scalars`.
    """
    values, count = json_stream(text), 0
    if not values:
        raise FormatError("not JSON")

    def walk(v, path: tuple[str, ...]):
        nonlocal count
        if isinstance(v, dict):
            return {k: walk(v[k], (*path, k)) for k in sorted(v)}
        if isinstance(v, list):
            return [walk(x, path) for x in v]
        if isinstance(v, str) and (path or scalars or depth) and not protected(path, v):
            new, n = replace(v)
            count += n
            return new
        return v

    if canonical:
        out = []
        for v in values:
            depth = isinstance(v, (dict, list))
            out.append(walk(v, ()))
        one = len(out) == 1 and "\n" in text
        dump = [json.dumps(v, ensure_ascii=False, indent=2 if one else None, separators=None if one else (",", ":")) for v in out]
        return "\n".join(dump), count
    return _in_place(text, replace, scalars)


def _in_place(text: str, replace: Replace, scalars: bool) -> tuple[str, int]:
    """Walks the tokens of valid JSON and replaces string values where they stand."""
    out, at, count = [], 0, 0
    stack: list[list] = []  # [is object, key, expects key]
    token = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]', re.S)
    for m in token.finditer(text):
        t = m[0]
        if t in "{[":
            stack.append([t == "{", None, t == "{"])
        elif t in "}]":
            stack.pop()
        elif t == ",":
            if stack and stack[-1][0]:
                stack[-1][2] = True
        elif t == ":":
            stack[-1][2] = False
        elif stack and stack[-1][0] and stack[-1][2]:
            stack[-1][1] = json.loads(t)
        elif stack or scalars:
            value, path = json.loads(t), tuple(s[1] for s in stack if s[0])
            if not protected(path, value):
                new, n = replace(value)
                if n:
                    out += [text[at : m.start()], json.dumps(new, ensure_ascii=False)]
                    at, count = m.end(), count + n
    return "".join(out) + text[at:], count


_MARKUP = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![^>]*>|<[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*>", re.S)


def rewrite_xml(text: str, replace: Replace) -> tuple[str, int]:
    """Replaces in text and CDATA; tags, attributes, comments and instructions stay."""
    out, at, count = [], 0, 0

    def put(plain: str) -> None:
        nonlocal count
        new, n = replace(unescape(plain))
        count += n
        out.append(new.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") if n else plain)

    for m in _MARKUP.finditer(text):
        put(text[at : m.start()])
        if m[0].startswith("<![CDATA["):
            new, n = replace(m[0][9:-3])
            count += n
            out.append(f"<![CDATA[{new}]]>" if n else m[0])
        else:
            out.append(m[0])
        at = m.end()
    put(text[at:])
    return "".join(out), count


def rewrite_log(text: str, replace: Replace, parity: bool = True) -> tuple[str, int]:
    """Replaces line by line. With `parity`, a line with pairs changes in their values only, and blank lines and line ends are made uniform; without, every line changes as a whole."""
    if not parity:
        return replace(text)
    count, out = 0, []

    def pair(m: re.Match) -> str:
        nonlocal count
        key, value = m[1], m[2]
        quoted = len(value) >= 2 and value.startswith('"') and value.endswith('"')
        new, n = replace(value[1:-1] if quoted else value)
        count += n
        return f'{key}="{new}"' if quoted else f"{key}={new}"

    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    for line in (x.removesuffix("\r") for x in lines):
        if not line.strip():
            out.append("")
        elif PAIR.search(line):
            out.append(PAIR.sub(pair, line))
        else:
            new, n = replace(line)
            count += n
            out.append(new)
    return "\n".join(out), count


def rewrite(text: str, kind: str, replace: Replace, parity: bool = True, canonical: bool = False) -> tuple[str, int]:
    """Rewrites a text by its format; one that isn't in it after all is a FormatError."""
    if kind == JSON:
        return rewrite_json(text, replace, canonical, scalars=not parity)
    if kind == XML:
        if xml_tags(text) is None:
            raise FormatError("not XML")
        return rewrite_xml(text, replace)
    return rewrite_log(text, replace, parity) if kind == LOG else replace(text)


def json_keys(text: str) -> set[str] | None:
    """All key paths with places, such as `a.b[0]`; None if the text isn't JSON."""
    values = json_stream(text)
    return _keys(values) if values else None


def _keys(values: list) -> set[str]:
    out: set[str] = set()

    def walk(v, prefix: str) -> None:
        if isinstance(v, dict):
            for k, x in v.items():
                full = f"{prefix}.{k}" if prefix else k
                out.add(full)
                walk(x, full)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, f"{prefix}[{i}]")

    for i, v in enumerate(values):
        walk(v, f"[{i}]" if len(values) > 1 else "")
    return out


def compare(before: str, after: str, kind: str) -> dict:
    """Whether a rewritten text kept its structure: syntax_valid, schema_intact, keys before and after, issues."""
    report = {"syntax_valid": True, "schema_intact": True, "original_keys": 0, "result_keys": 0, "issues": []}
    if kind == JSON:
        old, new = json_stream(before), json_stream(after)
        if not old:
            return report
        if len(old) != len(new):
            return report | {"schema_intact": False, "issues": [f"{len(new)} JSON values instead of {len(old)}"]}
        a, b = _keys(old), _keys(new)
        report |= {"original_keys": len(a), "result_keys": len(b), "schema_intact": a == b}
        report["issues"] = [f"{what}: {sorted(keys)}" for what, keys in (("lost keys", a - b), ("new keys", b - a)) if keys]
    elif kind == XML:
        a, b = xml_tags(before), xml_tags(after)
        report |= {"syntax_valid": b is not None, "original_keys": len(a or []), "result_keys": len(b or []), "schema_intact": a == b}
        report["issues"] = [] if a == b else ["the tags differ"]
    return report
