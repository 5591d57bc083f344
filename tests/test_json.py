"""First complete objects against json's own decoder; payloads of many shapes."""

import json
import random

from pyspark.sql import functions as F

from tidemark.functions import jsontext
from tidemark.operators import payloads


def first(text):
    at = (text or "").find("{")
    if at < 0:
        return None
    try:
        _, end = json.JSONDecoder().raw_decode(text[at:])
    except ValueError:
        return None
    return text[at : at + end]


def test_first_object_equals_a_decoder(spark):
    rng = random.Random(7)

    def value(depth):
        kind = rng.randrange(7 if depth < 4 else 4)
        if kind < 4:
            return rng.choice([1, -2.5, True, None, "plain", "}", "{\"", "\\", "\\\"}", "[]{", "é😀 \n"])
        if kind == 4:
            return [value(depth + 1) for _ in range(rng.randrange(4))]
        return {rng.choice(["a", "b{", "c\"}", "ä"]): value(depth + 1) for _ in range(rng.randrange(4))}

    texts = [None, "", "no", "{", "}", "{}", "}{}", '{"a": ', '{"a": "}', '{"a": "\\"}', "{bad}", '{"a":[1}', '{"a":1}}', "{{}}", '{"a" 1} {"b": 2}', 'say \\" {"a": 1}']
    for _ in range(400):
        body = json.dumps({"x": value(0), "y": value(0)}, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        cut = body if rng.random() < 0.6 else body[: rng.randrange(len(body))]
        texts.append(rng.choice(["", "noise ", "} ", '" '] ) + cut + rng.choice(["", " tail", ' {"z": 1}', "}}", ' "']))
    texts.append("{" + ",".join(f'"k{i}": "{chr(92)}{chr(34)}{{"' for i in range(20000)) + "} and more")
    own = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = own.select("i", jsontext.first_object("t").alias("o"), jsontext.object_end("t").alias("end"))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    for r in got.collect():
        want = first(texts[r.i])
        assert r.o == want, (texts[r.i], r.o, want)
        if want is not None:
            assert r.end == texts[r.i].index("{") + len(want)


def test_payloads_of_any_shape(spark):
    rows = [
        (1, '{"items":[{"track":{"id":"a","name":"n","artists":[{"name":"x"},{"name":"y"}]}},{"item":{"id":"b","artists":["y"]}},{"id":7,"artist":"z"},{"track":null},{"track":{"id":null}},{"track":{"id":"a","name":"again"}}]}'),
        (2, '[{"id":"q"}, 5, "text"]'), (3, '{"tracks":{"items":[{"track":{"id":"r","artist":{"name":"k"}}}]}}'), (4, '{"bad'), (5, None), (6, "5"), (7, '{"tracks":[]}'), (8, '{"items":{"id":"no list"}}'), (9, ""),
    ]
    good, bad = payloads.parsed(spark.createDataFrame(rows, "k long, body string"), "body")
    assert sorted(r.k for r in bad.collect()) == [4, 5, 9]
    got = [tuple(r) for r in payloads.tracks(good, "k").orderBy("k", "place").collect()]
    assert got == [(1, 0, "a", "n", "x"), (1, 1, "b", None, "y"), (1, 2, "7", None, "z"), (2, 0, "q", None, None), (3, 0, "r", None, "k")]
    assert {tuple(r) for r in payloads.fields(good).collect()} == {("items", "ARRAY", 1), ("items", "OBJECT", 1), ("tracks", "OBJECT", 1), ("tracks", "ARRAY", 1)}
    assert payloads.tracks(good.where(F.col("k") < 0), "k").collect() == []
