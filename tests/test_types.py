"""Type checks on single values: the case tables of the model language."""

import json
import random

import pytest
from pyspark.sql import functions as F

from contentloom.functions import payload as P
from contentloom.functions.model import Model, ddl_for, from_struct, model, spark_type, struct_for
from contentloom.functions.typespec import check, parse_type
from contentloom.operators import validation as V

LEAVES = ["str", "int", "float", "bool", "None", "Any"]
SAMPLES = ["", "draft", "Ünïcode", 0, -7, 10**15, 2.5, -0.25, True, False, None, [], ["draft", "final"], [3, None], [[1], [2]], {}, {"en": 4}, {"en": "four", "fr": 4}, {"a": {"b": 9}}, {"a": {"b": "nine"}}]


def fits(kind, value):
    """Plainly, whether a JSON value has a type; nested types are (name, arguments)."""
    name, args = kind if isinstance(kind, tuple) else (kind, ())
    if name == "List":
        return isinstance(value, list) and all(fits(args[0], x) for x in value)
    if name == "Dict":
        return isinstance(value, dict) and all(fits(args[0], k) and fits(args[1], x) for k, x in value.items())
    if name == "Union":
        return any(fits(a, value) for a in args)
    if name == "Optional":
        return value is None or fits(args[0], value)
    number = not isinstance(value, bool)
    return {"str": isinstance(value, str), "int": isinstance(value, int) and number, "float": isinstance(value, (int, float)) and number, "bool": isinstance(value, bool), "None": value is None, "Any": True}[name]


def spelled(kind):
    return kind if isinstance(kind, str) else f"{kind[0]}[{', '.join(spelled(a) for a in kind[1])}]"


def made_up(rnd, depth):
    name = rnd.choice(["List", "Dict", "Union", "Optional"]) if depth else None
    if name is None:
        return rnd.choice(LEAVES)
    if name == "Dict":
        return name, (rnd.choice(["str", "str", "int", "Any"]), made_up(rnd, depth - 1))
    return name, tuple(made_up(rnd, rnd.randrange(depth)) for _ in range(rnd.randint(2, 3) if name == "Union" else 1))


def errors_of(spark, kind, values):
    df = spark.createDataFrame([(i, json.dumps({"v": v})) for i, v in enumerate(values)], "i int, j string")
    found = df.select("i", check(P.get(P.safe_json(F.col("j")), "v"), parse_type(kind)).alias("e")).collect()
    return [r["e"] for r in sorted(found)]


def test_random_types_agree_with_a_plain_check(spark):
    rnd = random.Random(12)
    for kind in LEAVES + [made_up(rnd, rnd.randint(1, 2)) for _ in range(24)]:
        errors = errors_of(spark, spelled(kind), SAMPLES)
        assert [e is None for e in errors] == [fits(kind, v) for v in SAMPLES], spelled(kind)


@pytest.mark.parametrize("kind, value, message", [
    ("str", 8, "expected string, got int"), ("str", ["x"], "expected string, got list"), ("int", "eight", "expected integer, got str"), ("int", False, "expected integer, got bool"), ("int", 8.5, "expected integer, got float"),
    ("float", "8.5", "expected number"), ("bool", "yes", "expected boolean"), ("None", "", "expected None, got str"),
    ("List[int]", {"a": 1}, "expected list, got dict"), ("List[int]", [5, 6, "7", "8"], "invalid item at index 2"),
    ("Dict[str, bool]", [True], "expected dictionary"), ("Dict[str, bool]", {"live": True, "old": "no"}, "invalid value for key 'old'"), ("Dict[int, str]", {"one": "1"}, "invalid key: expected integer, got str"),
    ("Dict[str, List[str]]", {"tags": ["a", 5]}, "invalid value for key 'tags': invalid item at index 1"),
    ("Union[int, List[int]]", "none of them", "value did not match any of the expected types"), ("Optional[int]", "x", "expected integer"),
    ("Decimal", 1, "unsupported type: Decimal"), ("Dict[str, int", {}, "unsupported type"),
])
def test_messages(spark, kind, value, message):
    assert message in errors_of(spark, kind, [value])[0]


def test_dates(spark):
    good = ["1999-12-31", "2000-02-29", "2031-07-04T23:59:59", "2031-07-04T05:06:07.089"]
    bad = ["yesterday", "1999-02-29", "2031-13-01", "2031", "23:59", "20310704"]
    assert errors_of(spark, "datetime", good) == [None] * len(good)
    assert all("invalid datetime format" in e for e in errors_of(spark, "datetime", bad))
    assert "expected datetime" in errors_of(spark, "datetime", [20310704])[0]


def test_whole_numbers_of_any_size(spark):
    df = spark.createDataFrame([('{"v":98765432109876543210}',), ('{"v":2.0}',)], "j string")
    errors = [r["e"] for r in df.select(check(P.get(P.safe_json(F.col("j")), "v"), parse_type("int")).alias("e")).collect()]
    assert errors[0] is None and "got float" in errors[1]


def test_parse_type_is_balanced():
    spec = parse_type(" Dict[str, Union[List[int], Dict[str, Any]]] ")
    assert spec.kind == "dict" and [a.kind for a in spec.args] == ["str", "union"]
    assert parse_type("Dict[str]").kind == "unsupported"
    assert parse_type("list").kind == "list" and parse_type("Dict").args[1].kind == "any"


PAGE = Model.read({
    "model_name": "Page",
    "fields": {
        "slug": {"type": "str", "required": True}, "words": {"type": "int", "required": True},
        "teaser": {"type": "str", "required": False, "args": {"default": None}},
    },
})


@pytest.mark.parametrize("record, partial, errors", [
    ('{"slug":"home","words":410,"teaser":"welcome"}', False, []),
    ('{"slug":"home"}', False, ["Missing required field: words"]),
    ('{"slug":"home","words":"many"}', False, ["Invalid type for words: expected integer, got str"]),
    ('{"slug":"home"}', True, []),
    ('{"slug":"home","words":null}', False, ["Invalid type for words: expected integer, got NoneType"]),
    ('{"slug":"home","words":9,"unknown":{"x":[]}}', False, []),
    ('["home"]', False, ["payload is not an object"]), ("{slug", False, ["payload is not valid JSON"]), (None, False, ["payload is not valid JSON"]),
])
def test_model_validation(spark, record, partial, errors):
    row = V.validate(spark.createDataFrame([(record,)], "j string"), "j", PAGE, partial).first()
    assert [e["message"] for e in row["errors"]] == errors
    assert row["is_valid"] is (not errors) and row["validated_data"] == (record if not errors else None)


def test_stored_rules_are_data_not_code(spark):
    m = Model.read({"name": "Post", "fields": {"title": {"type": "str"}}, "validators": [
        {"name": "bad", "fields": ["title"], "code": "raise SystemExit"}, {"rule": "length_between", "with": {"field": "title", "low": 5, "high": 100}},
    ]})
    rows = V.validate(spark.createDataFrame([('{"title":"abc"}',), ('{"title":"abcdef"}',)], "j string"), "j", m).collect()
    assert [r["is_valid"] for r in rows] == [False, True]


def test_field_names_with_dots_and_blanks_are_quoted():
    assert P.json_path("a b", "it's") == "$['a b'][\"it's\"]"
    with pytest.raises(ValueError):
        P.json_path("'\"")


def test_struct_round_trip(spark):
    schema = struct_for(model("M", a="str", b="List[int]", c="Dict[str, float]?", d="datetime?", e="Any?"))
    assert schema.simpleString() == "struct<a:string,b:array<bigint>,c:map<string,double>,d:timestamp_ntz,e:string>"
    back = from_struct(schema, "M")
    assert [(f.name, f.type, f.required) for f in back.fields][:2] == [("a", "str", True), ("b", "List[int]", True)]
    assert ddl_for(model("M", a="str", n="int?")) == "`a` string NOT NULL, `n` bigint"
    assert spark_type("json") == "string" and spark_type("Optional[int]") == "bigint"


def test_strict_reference_exempts_null_defaults(spark):
    m = Model.read({"name": "M", "fields": {"x": {"type": "str", "args": {"default": None}}}})
    df = spark.createDataFrame([("{}",)], "j string")
    assert not V.validate(df, "j", m).first()["is_valid"]
    assert V.validate(df, "j", m, strict_reference=True).first()["is_valid"]


def test_one_parse_per_row_below_filters(spark):
    df = spark.createDataFrame([("{}",)], "j string")
    plan = V.validate(df, "j", PAGE).where("is_valid")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") == 1
