import json

import pytest

from lurus.operators import variants as V

E1, E2 = {"token_salah": "x", "token_benar": "y", "category": "EJA"}, {"token_salah": None, "token_benar": " b "}
S = {"sentence_id": "1", "errors": [E1, None, E2, {"token_salah": " ", "token_benar": ""}, 5]}
R = {"filename": "f", "sentences": [None, S]}
FOUND = {(1, 0), (1, 2)}


def found(spark, *payloads):
    raw = spark.createDataFrame([(i, p, "clash") for i, p in enumerate(payloads)], "ann_id bigint, payload string, shape string")
    typed = spark.createDataFrame([], "ann_id bigint, " + __import__("lurus.sources.readers", fromlist=["x"]).ANNOTATION + ", annotator string")
    return {(r.ann_id, r.sentence_pos, r.error_pos) for r in V.found_errors(typed, raw).collect()}


@pytest.mark.parametrize(
    "payload",
    [R, [R], {"data": [R], "versi": 2}, {"meta": {"n": 1}, "record": R}, {"filename": "f", "sentences": json.dumps([None, S])}, {"sentences": [None, S | {"errors": json.dumps(S["errors"])}]}, {"a": {"b": {"c": [R]}}}, {"sentences": [None, json.dumps(S)]},
     {"data": [[R]]}, {"data": [json.dumps(R)]}, [[[json.dumps([R])]]], {"x": json.dumps({"y": [1, None, R]})}, {"sentences": {"items": [None, S]}}, {"sentences": [None, {"sentence": S}]}, {"sentences": [[None], [S]]},
     {"sentences": [5, S | {"errors": [{"error": E1}, None, json.dumps(E2), {"x": 1}]}]}, {"sentences": json.dumps({"isi": json.dumps([None, S | {"errors": {"daftar": [E1, 7, [E2]]}}])})}],
)
def test_every_shape_gives_the_same_errors(spark, payload):
    assert found(spark, json.dumps(payload), json.dumps(payload, indent=1)) == {(i, s, e) for i in (0, 1) for s, e in FOUND}


def test_single_objects(spark):
    assert found(spark, json.dumps({"sentences": S | {"errors": E1}}), json.dumps({"sentences": {"errors": E2}})) == {(0, 0, 0), (1, 0, 0)}


def test_broken_payloads_hold_nothing(spark):
    assert found(spark, None, "", "{", json.dumps(R)[:-1], json.dumps(R) + "x", '{"sentences": NaN}', "3", "null", '"text"', "[]", "[" * 100_000, "[" * 5000 + "]" * 5000) == set()


def test_deep_numbers_and_repeated_keys(spark):
    big = '{"sentences": [{"errors": [{"token_salah": ' + "9" * 5000 + "}]}]}"
    assert found(spark, big, '{"sentences": 1, "sentences": [{"errors": [{"token_benar": true}]}]}') == {(0, 0, 0), (1, 0, 0)}


def test_states():
    assert V.state(E1) == "error" and V.state(S) == "sentence" and V.state(R) == "record"
    assert V.state({"x": [R]}) == "envelope of record" and V.state({"x": [[json.dumps(S)]]}) == "envelope of sentence"
    assert V.state([1, "a"]) == "list" and V.state('[{"filename": "f"}]') == "list of record" and V.state({}) == "other" and V.state({"x": [1]}) == "other"
    assert [V.state(x) for x in (None, True, 1, 1.5, "a", "[")] == ["null", "bool", "number", "number", "text", "text"]


def test_levels_and_subtypes(spark):
    raw = spark.createDataFrame([(1, json.dumps({"filename": "f", "sentences": [S | {"bbox_normalized": [0.1, 1, None], "catatan": {"oleh": "a"}}, S]})), (1, json.dumps(R))], "ann_id bigint, payload string")
    nodes = V.raw_nodes(raw)
    assert V.level(nodes, "record").count() == 1
    tables = V.subtypes(nodes, "sentence")
    assert set(tables) == {"list+box+note", "list"} and "bbox_normalized" not in tables["list"].columns
    row = tables["list+box+note"].first()
    assert row.bbox_normalized == [0.1, 1.0, None] and json.loads(row.note) == {"oleh": "a"}
    parents = V.level(nodes, "sentence").select("ann_id", "record_pos", "sentence_pos")
    assert V.level(nodes, "error").join(parents, ["ann_id", "record_pos", "sentence_pos"], "left_anti").count() == 0


def test_shapes_are_made_of_fixed_words(spark):
    payloads = [json.dumps({f"kunci{i}": {f"lain{i}": [R | {f"sisa{i}": i}]}}) for i in range(300)]
    nodes = V.raw_nodes(spark.createDataFrame(list(enumerate(payloads)), "ann_id bigint, payload string"))
    assert {r["shape"] for r in nodes.where("level = 'record'").select("shape").distinct().collect()} == {"envelope+list:list"}
    assert V.subtypes(nodes, "record")["envelope+list:list"].count() == 300


def test_written_subtypes(spark, tmp_path):
    raw = spark.createDataFrame([(1, json.dumps(R)), (1, json.dumps(R)), (2, json.dumps(R | {"sentences": S | {"bbox_normalized": [1]}}))], "ann_id bigint, payload string")
    nodes = V.raw_nodes(raw)
    V.write_subtypes(nodes, str(tmp_path / "t"))
    got = V.read_subtype(spark, str(tmp_path / "t"), "sentence", "list+box")
    assert got.columns == ["ann_id", "record_pos", *V.columns_of("sentence", "list+box")] and [tuple(r)[:3] for r in got.collect()] == [(2, 0, 0)]
    assert V.read_subtype(spark, str(tmp_path / "t"), "error", "token_salah+token_benar+category").count() == 2


def test_empty(spark):
    assert found(spark) == set()
