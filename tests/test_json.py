import pytest

from conftest import bag, by_key
from userprism.functions import jsonprops

ROWS = [
    (1, '{"a": 1, "t": "x"}'),
    (2, '{"a": 2, "b": {"c": "deep", "d": [1, 2], "e": {"f": 0.5}}}'),
    (3, '{"l": [7, 8], "empty": []}'),
    (4, "{}"),
    (5, '{"a": '),
    (6, "[1, 2]"),
    (7, None),
    (8, '{"t": "{looks nested", "x.y": true, "it\'s": null, "q\'\\"": 3}'),
    (9, '{"a": "text", "b_c": "flat"}'),
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "id int, j string")


def test_nested_flag(df):
    found = dict(bag(jsonprops.nested_flag(df, "j"), "id", "is_nested"))
    assert found == {1: False, 2: True, 3: False, 4: False, 5: None, 6: None, 7: None, 8: False, 9: False}


def test_status(df):
    assert dict(bag(jsonprops.json_status(df, "j"))) == {"object": 6, "bad": 1, "other": 1, "missing": 1}


def test_unpack(df):
    out = jsonprops.unpack_properties(df, "j")
    assert sorted(out.columns) == sorted(
        ["id", "j", "a", "t", "b_c", "b_d", "b_e_f", "l", "empty", "x.y", "it's", "q'\""]
    )
    found = by_key(out, "id")
    assert [found[i]["a"] for i in (1, 2, 9)] == ["1", "2", "text"]
    assert (found[2]["b_c"], found[2]["b_d"], found[2]["b_e_f"]) == ("deep", 1, 0.5)
    assert found[9]["b_c"] == "flat"
    assert found[3]["l"] == 7 and found[3]["empty"] is None
    assert found[8]["x.y"] is True and found[8]["t"] == "{looks nested" and found[8]["it's"] is None
    assert found[8]["q'\""] == 3
    for i in (4, 5, 6, 7):
        assert {v for n, v in found[i].items() if n not in ("id", "j")} == {None}


def test_unpack_with_a_kept_schema(df):
    schema = jsonprops.property_schema(df.filter("id = 3"), "j")
    out = jsonprops.unpack_properties(df, "j", schema, prefix="p_")
    assert out.columns == ["id", "j", "p_empty", "p_l"]
    with pytest.raises(ValueError, match="already"):
        jsonprops.unpack_properties(out, "j", schema, prefix="p_")


def test_nothing_to_unpack(df):
    assert jsonprops.unpack_properties(df.filter("id in (5, 7)"), "j").columns == ["id", "j"]


def test_extract_keys_does_not_depend_on_key_order(spark):
    df = spark.createDataFrame(
        [
            (1, '{"balance_type": 4, "other": 1, "position_id": 12}'),
            (2, '{"other": 1, "position_id": 12, "balance_type": 4}'),
            (3, '{"balance_type": 4, "o": {"x": 1}}'),
            (4, "bad"), (5, None), (6, "{}"),
        ],
        "id int, j string",
    )
    out = jsonprops.extract_keys(df, "j")
    assert bag(out.drop("j")) == [
        (1, "4", "12", None), (2, "4", "12", None), (3, None, None, None), (4, None, None, None),
        (5, None, None, None), (6, None, None, None),
    ]
