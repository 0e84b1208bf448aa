"""Office documents (docx, xlsx, pptx): recognition, text, and rewriting of their XML parts."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.config import Config
from cloakframe.functions import formats
from cloakframe.operators.rewrite import matchers, with_sources

#: First folders of the parts of each kind, and words in the names of parts with text (fixed values).
KINDS = {"word": "word/", "excel": "xl/", "powerpoint": "ppt/"}
PARTS = {"word": ["document", "header", "footer", "footnote", "endnote", "comment"], "excel": ["sharedstrings", "sheet", "comment", "drawing"], "powerpoint": ["slide", "notesslide", "comment"]}
_PROOF = re.compile(r"<w:proofErr[^>]*/>")
_JOIN = re.compile(r"</w:t></w:r><w:r><w:t(?: xml:space=\"preserve\")?>")
_BREAK = re.compile(r"</(?:\w+:)?(?:p|tc|si|row)>")


def kind_of(data: bytes) -> str | None:
    """word, excel or powerpoint; None for anything else."""
    if not data.startswith(b"PK\x03\x04"):
        return None
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = z.namelist()
    except (zipfile.BadZipFile, OSError):
        return None
    return next((k for k, folder in KINDS.items() if any(n.startswith(folder) for n in names)), None)


def has_text(name: str, kind: str) -> bool:
    low = name.lower()
    return low.endswith(".xml") and low.startswith(KINDS[kind]) and any(p in low.rsplit("/", 1)[-1] or f"/{p}" in low for p in PARTS[kind])


def joined_runs(xml: str) -> str:
    """Word splits words over runs; runs without attributes that follow one another become one."""
    xml = _PROOF.sub("", xml)
    while (new := _JOIN.sub("", xml)) != xml:
        xml = new
    return xml


def text_of(data: bytes) -> str:
    """The text, a line for each paragraph, cell or row that has any."""
    kind, out = kind_of(data), []
    if kind is None:
        return ""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in z.namelist():
            if has_text(name, kind):
                xml = joined_runs(z.read(name).decode("utf-8", "replace"))
                for part in _BREAK.split(xml):
                    if line := formats.unescape(re.sub(r"<[^>]*>", "", part)).strip():
                        out.append(line)
    return "\n".join(out)


def rewritten(data: bytes, replace) -> tuple[bytes, int]:
    """The document with its text replaced; its other parts are copied."""
    kind, count, out = kind_of(data), 0, io.BytesIO()
    if kind is None:
        return data, 0
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for item in z.infolist():
            part = z.read(item)
            if has_text(item.filename, kind):
                xml = part.decode("utf-8", "replace")
                text, n = formats.rewrite_xml(joined_runs(xml) if kind == "word" else xml, replace)
                count += n
                part = text.encode() if n else part
            new.writestr(item, part)
    return out.getvalue(), count


def office_texts(files: DataFrame) -> DataFrame:
    """Files (path, content) as documents: path, office_type (null: none), text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b.path, "office_type": [kind_of(bytes(c)) for c in b.content], "text": [text_of(bytes(c)) for c in b.content]})

    return files.select("path", "content").mapInPandas(run, "path string, office_type string, text string")


def rewrite_office(files: DataFrame, registry: DataFrame, config: Config = Config(), reverse: bool = False) -> DataFrame:
    """Files (path, content) rewritten: path, office_type, content, replacements. Other files come back as they were."""
    sources, strict = matchers(registry, config, reverse), config.strict_word_boundaries

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            new = with_sources(sources, strict, lambda replace, files=b.content: [rewritten(bytes(c), replace) for c in files])
            yield pd.DataFrame({"path": b.path, "office_type": [kind_of(bytes(c)) for c in b.content], "content": [x for x, _ in new], "replacements": [n for _, n in new]})

    return files.select("path", "content").mapInPandas(run, "path string, office_type string, content binary, replacements long")


def is_zip(content: str = "content"):
    return F.substring(F.col(content), 1, 4) == F.unhex(F.lit("504B0304"))
