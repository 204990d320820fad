"""Functions over Arrow batches: what they give for odd values, and how much work a batch is."""

import json

import pyarrow as pa
from pyspark.sql import functions as F

from basalt.functions import fts, jsons


def test_json_document_is_parsed_once_a_batch(monkeypatch):
    parsed = []
    monkeypatch.setattr(jsons, "loads", lambda s: parsed.append(s) or json.loads(s))
    out = jsons._distinct(pa.array(['{"k": 7}', None, "[1, 2]", '{"k": 7}'] * 50), lambda v: jsons._GONE if (x := jsons.walk(v, ["k"])) is jsons._GONE else jsons.dumps(x), "string")
    assert out.to_pylist() == ["7", None, None, "7"] * 50
    assert sorted(parsed) == ["[1, 2]", '{"k": 7}']


def test_json_path_that_is_not_there(spark):
    """Workers get a missing key as NULL; object keys are sorted, and the last of equal names wins, also of names from a column."""
    rows = [(1, '{"k": 1.50}'), (2, '{"z": "a"}'), (3, None), (4, '{"k": 1, "k": [2]}')]
    df = spark.createDataFrame(rows, "i int, j string").coalesce(1)
    j, i = F.col("j"), F.col("i")
    out = df.select(
        jsons.json_extract_path_text(j, "k"),
        jsons.json_extract_path(j, "k", "0"),
        jsons.json_build_object("bb", i, "a", F.lit('é"'), "bb", i * 2),
        jsons.json_build_object(F.concat(F.lit("n"), i % 2), i, F.lit("n1"), i * 2),
        jsons.json_build_array(i, F.lit(None).cast("int"), F.lit("x")),
    ).collect()
    assert [r[0] for r in out] == ["1.50", None, None, "[2]"]
    assert [r[1] for r in out] == [None, None, None, "2"]
    assert [r[2] for r in out] == [f'{{"a": "é\\"", "bb": {2 * k}}}' for k in (1, 2, 3, 4)]
    assert [r[3] for r in out] == ['{"n1": 2}', '{"n0": 2, "n1": 4}', '{"n1": 6}', '{"n0": 4, "n1": 8}']
    assert [r[4] for r in out] == [f'[{k}, null, "x"]' for k in (1, 2, 3, 4)]


def test_word_is_stemmed_once_a_worker(monkeypatch):
    stemmed, stem = [], fts.stem
    monkeypatch.setattr(fts, "stem", lambda w: stemmed.append(w) or stem(w))
    assert [fts.make_vector("The Qarnishes_qarnishes, qarnishes 7ths") for _ in range(20)] == ["'7ths':5 'qarnish':2,3,4"] * 20
    assert stemmed == ["qarnishes"] * 2  # two tokens, by their case


def test_vector_of_long_texts_and_many_words(monkeypatch):
    """Positions end at 16,383 and at 256 a word, also while the kept words are few."""
    assert fts.make_vector("the " * 16_381 + "cat dog cat dog owl owl") == "'cat':16382,16383 'dog':16383 'owl':16383"
    assert fts.make_vector("cat " * 300 + "the " * 17_000 + "cat owl") == "'cat':" + ",".join(map(str, range(1, 257))) + " 'owl':16383"
    text = "zebras lions owls zebras é É bears lions owls " * 3
    want = fts.make_vector(text)
    monkeypatch.setattr(fts, "MAX_WORDS", 2)
    assert fts.make_vector(text) == want == "'bear':7,16,25 'lion':2,8,11,17,20,26 'owl':3,9,12,18,21,27 'zebra':1,4,10,13,19,22 'é':5,6,14,15,23,24"
