"""The first JSON of a text equals a decoder that is tried at every bracket, in linear time."""

import json
import random
import re
import time

import pytest

from sourcewell.functions.jsons import first_json


def tried(text):
    for m in re.finditer(r"[\[{]", text):
        try:
            return json.dumps(json.JSONDecoder().raw_decode(text, m.start())[0], ensure_ascii=False)
        except json.JSONDecodeError:
            continue
    return None


def test_equals_a_decoder_at_every_bracket():
    rng = random.Random(3)
    parts = ["[", "]", "{", "}", '"', ",", ":", "1", "-", "0", "1.5", "e3", " ", "\n", "\\", "\\n", "\\u00e9", "a", "true", "null", "NaN", "-Infinity", '"a"', '"a":', "[1]", "{}", '{"k": [', "é", "01", "1.", ",]"]
    found = 0
    for _ in range(60_000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 14)))
        want = tried(text)
        found += want is not None
        assert first_json(text) == want, text
    assert found > 5_000


@pytest.mark.parametrize("unit", ["[", "{", '["[",', '{"a":[', '["', '[{"a":"[', "[1,", '["x\\"[', "[[1],", '["\n[', '{"a":1,', '"[,'])
def test_linear(unit):
    def took(n):
        text = unit * (n // len(unit))
        began = time.process_time()
        first_json(text)
        return time.process_time() - began

    assert took(1_000_000) < 8


def test_what_python_cannot_hold():
    deep = "[" * 100_000 + "]" * 100_000
    assert first_json("x " + deep + " y") == deep
    assert first_json("[" + "1" * 5000 + "]") == "[" + "1" * 5000 + "]"
    assert first_json('["\\ud800"]') == '["\\ud800"]'
    assert first_json(None) is None and first_json("") is None and first_json("none") is None
