import io
import json
import zipfile

import pytest

from cloakframe.config import FormatError, load_config, parse_selection
from cloakframe.functions import formats as X
from cloakframe.functions.replacing import Replacer
from cloakframe.operators import office

SWAP = Replacer({"192.168.1.1": "10.0.0.1", "ana": "USER"}).replace


def test_json_keeps_all_but_strings():
    text = '{ "ana": "ana dice",\n "n": 1.0, "l": ["192.168.1.1", true], "eventdata": {"keywords": "ana"} }'
    new, n = X.rewrite_json(text, SWAP)
    assert n == 2 and new == text.replace('"ana dice"', '"USER dice"').replace("192.168.1.1", "10.0.0.1")
    canon, _ = X.rewrite_json('{"b":"ana","a":1}\n{"c":"x"}', SWAP, canonical=True)
    assert canon == '{"a":1,"b":"USER"}\n{"c":"x"}'
    with pytest.raises(FormatError):
        X.rewrite_json("{", SWAP)


def test_json_streams():
    assert X.json_stream('{"a":1} [2]\n"x"') == [{"a": 1}, [2], "x"] and X.json_stream("12x") == [] and X.json_stream("") == []
    assert X.compare('{"a":{"b":[1]}}', '{"a":{"c":[1]}}', "json")["schema_intact"] is False


def test_xml():
    text = '<?xml version="1.0"?><a x="ana"><!-- ana --><b>ana &amp; co</b><![CDATA[ana]]></a>'
    new, n = X.rewrite_xml(text, SWAP)
    assert n == 2 and new == text.replace(">ana &", ">USER &").replace("[ana]", "[USER]")
    assert X.xml_tags(new) == X.xml_tags(text) == ["a", "b"] and X.xml_tags("<a>") is None


def test_log_parity_and_safe():
    line = 'ana entra ip=192.168.1.1 user="ana"\n\nlibre ana\n'
    assert X.rewrite_log(line, SWAP)[0] == 'ana entra ip=10.0.0.1 user="USER"\n\nlibre USER'
    assert X.rewrite_log(line, SWAP, parity=False)[0] == line.replace("ana", "USER").replace("192.168.1.1", "10.0.0.1")


def test_format_of():
    assert [X.format_of(t) for t in ('{"a":1}', "<a></a>", "a=b", "hola")] == ["json", "xml", "log", "plaintext"]


def docx(xml: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
        z.writestr("word/media/x.bin", b"\x00\x01")
    return out.getvalue()


def test_office():
    data = docx("<w:document><w:p><w:r><w:t>an</w:t></w:r><w:proofErr w:type='x'/><w:r><w:t>a va</w:t></w:r></w:p></w:document>")
    assert office.kind_of(data) == "word" and office.text_of(data) == "ana va" and office.kind_of(b"PK\x03\x04no") is None
    new, n = office.rewritten(data, SWAP)
    assert n == 1 and office.text_of(new) == "USER va"


def test_config_and_selection():
    c = load_config('[general]\nkey = "k"\n[[custom_rules]]\nname = "E"\npattern = "x"\nstrategy = "mask"\n')
    assert c.key == "k" and c.rules[0].strategy == "mask"
    assert parse_selection("1, 3-5, x, 99", 10) == [1, 3, 4, 5]
    assert json.loads("1") == 1
