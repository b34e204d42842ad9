import json
import random
import time

import numpy as np
import pyarrow as pa
import pytest

from gneiss.operators.json_arrow import flatten
from gneiss.operators.nested import LIST_FIELDS, child_table, nested_objects


def brute(text):
    """Row-at-a-time restatement with the standard parser."""
    out = []

    def walk(value, path, role):
        if isinstance(value, str):
            if "{" in value:
                try:
                    walk(json.loads(value.lstrip("\ufeff")), path, role)
                except ValueError:
                    pass
        elif isinstance(value, dict):
            if role == 2:
                path += "[0]"
            if role:
                out.append(path)
            for k, x in value.items():
                walk(x, f"{path}.{k}" if path else k, 2 if k in LIST_FIELDS else 0)
        elif isinstance(value, list):
            for i, x in enumerate(value):
                walk(x, f"{path}[{i}]", 1)

    try:
        walk(json.loads(text.lstrip("\ufeff")), "", 0)
    except ValueError:
        pass
    return out


ODD = [
    "", " ", "[]", "[{}]", '{"claims":{"a":1}}', '[[{"a":[{}]}]]', '{"a":[1,{"b":2},"x",{"c":[{}]}],"a":[{}]}',
    '{"a":[{}],}', '{"a" [{}]}', '{"a":[{}]} x', "{}{}", '"[{\\"x\\":[{}]}]"', '[{"s":"\x01"}]', '[{"s":"\\q"}]',
    '[{"s":"\\u00e9"}]', '[{"s":"\\u00g9"}]', '[{"a":01}]', '[{"a":NaN}]', '[{"a":tru}]', '{"\\u0063laims":{"x":1}}',
    '{"claims":"{\\"hints\\":{\\"z\\":1}}"}', '{"claims":["{\\"sources\\":[{}]}","x",null,"[{}]"]}', "\\", '"\\',
    '[{"x":"a\\\\"},{"y":"\\\\\\""}]', '[{"é":[{"日本":[{}]}]}]', '[{"a":"}"},{"b":"]["}]', "]", "[}", "{1:2}", '{"a"}',
    '{"a":}', "{,}", "[,]", "[{} {}]", '{"a":1 "b":2}', '\ufeff{"claims":[{}]}', '[{"a":1e5},{"b":-0.5E+3}]',
]


def pairs(texts):
    found = flatten(pa.array(texts, pa.string()), np.arange(len(texts)), LIST_FIELDS)
    return sorted(zip(found["row"].to_pylist(), found["path"].to_pylist()))


def expected(texts):
    return sorted((i, p) for i, t in enumerate(texts) if t is not None for p in brute(t))


def test_odd_forms():
    assert pairs(ODD) == expected(ODD)


def test_nulls_and_empty():
    assert pairs([None, None]) == []
    assert pairs([]) == []


def test_damaged_texts_agree_with_parser():
    rng = random.Random(5)
    base = [json.dumps({"claims": [{"sources": [{"spans": [{"a": 1}]}, 3]}, None], "x": '[{"q":"\\""}]', "n": [1.5, True, [{"é": {}}]]})] + ODD
    texts = []
    for _ in range(3000):
        t = list(rng.choice(base))
        for _ in range(rng.randint(1, 3)):
            k = rng.randrange(len(t) + 1)
            t[k : k + rng.randint(0, 1)] = rng.choice('{}[]",:\\ 1a\n')
        texts.append("".join(t))
    assert pairs(texts) == expected(texts)


def test_long_text_and_deep_nesting():
    deep = "[" * 60 + "{}" + "]" * 60
    wide = json.dumps({"claims": [{"i": i, "s": "x" * 50} for i in range(20_000)]})
    assert pairs([deep, wide]) == expected([deep, wide])


def test_operator_keeps_ids_and_parents(spark):
    rows = [(7, '{"claims":[{"type":"product","sources":{"url":"u"}}]}', "a"), (7, '{"claims":[{"type":"product","sources":{"url":"u"}}]}', "a"), (None, "[{}]", "b"), (9, None, "c")]
    df = spark.createDataFrame(rows, "record_id bigint, record_json string, path string")
    got = nested_objects(df, "record_id", "record_json", with_json=True)
    assert sorted((r.parent_id or -1, r.path, r.parent_path) for r in got.collect()) == [
        (-1, "[0]", ""), (7, "claims[0]", ""), (7, "claims[0]", ""), (7, "claims[0].sources[0]", "claims[0]"), (7, "claims[0].sources[0]", "claims[0]"),
    ]
    claims = child_table(df, "record_id", "record_json", "claims", "type string, note string").collect()
    assert [(r.parent_id, r.position, r.type, r.note) for r in claims] == [(7, 0, "product", None)] * 2


def test_depth_takes_linear_time():
    took = []
    for depth in (500, 2000):
        texts = ['{"a":[' * depth + "1" + "]}" * depth] + ['{"claims":[{"x":1}]}'] * 2000
        began = time.process_time()
        assert len(pairs(texts)) == depth - 1 + 2000
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0]  # four times the depth; sixty times it if each level met all tokens


def test_child_fields_come_from_the_buffers(spark):
    text = '{"claims":[{"type":"a\\n\\u00e9","n":5,"o":{"x":[1]},"m":{"k":"v"},"b":true},{"type":"q","type":"r","n":"7","b":"true"},3,{"type":null,"n":1.5}],"x":{"claims":{"type":12,"n":99999999999}},"t":"{\\"claims\\":[[{\\"type\\":\\"in\\"}]]}","claims2":[{"type":"no"}]}'
    df = spark.createDataFrame([(1, text), (2, None), (3, "{bad"), (4, '{"claims":[]}')], "type bigint, n string")
    got = child_table(df, "type", "n", "claims", "type string, n int, o string, m map<string,string>, b boolean, none string").collect()
    assert [(r.path, r.position, r.type, r.n, r.o, r.m, r.b, r.none) for r in got] == [
        ("claims[0]", 0, "a\né", 5, '{"x":[1]}', {"k": "v"}, True, None), ("claims[1]", 1, "r", None, None, None, None, None), ("claims[3]", 3, None, None, None, None, None, None),
        ("x.claims[0]", 0, "12", None, None, None, None, None), ("t.claims[0][0]", 0, "in", None, None, None, None, None),
    ]
    assert child_table(df.limit(0), "type", "n", "claims", "a string").count() == 0


@pytest.mark.parametrize("rows", [[]])
def test_empty_table(spark, rows):
    df = spark.createDataFrame(rows, "record_id bigint, record_json string")
    assert nested_objects(df, "record_id", "record_json").count() == 0
