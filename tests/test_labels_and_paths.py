from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from catalumen.functions import jsontext, labels, paths
from catalumen.operators import jsonleaves, taxonomy

STRICT = [
    ('[{"value": " X "}]', "X", "list_dict_value"),
    ('[{"value": " X\\t"}]', "X", "list_dict_value"),
    ("[]", None, "list_length_not_one"),
    ('[{"value":"A"},{"value":"B"}]', None, "list_length_not_one"),
    ('["A"]', None, "list_item_not_dict"),
    ("[null]", None, "list_item_not_dict"),
    ('[{"value":"A","x":1}]', None, "unexpected_dict_keys"),
    ('[{"other":"A"}]', None, "unexpected_dict_keys"),
    ("[{}]", None, "unexpected_dict_keys"),
    ('[{"value":5}]', None, "value_not_string"),
    ('[{"value":null}]', None, "value_not_string"),
    ('[{"value":"  "}]', None, "empty_value"),
    ('{"value":"A"}', None, "not_list"),
    ('"A"', None, "not_list"),
    ("null", None, "not_list"),
    (None, None, "not_list"),
]
LENIENT = [
    ('[{"value": " X "}]', "X"), ('[{"value":"A","x":1}]', "A"), ('{"value":" A"}', "A"), ('{"value":7}', None),
    ('"A"', "A"), ('" A "', "A"), ('""', None), ("plain text", "plain text"), ("null", None), (None, None),
    (json.dumps('[{"value": "Q"}]'), "Q"), (json.dumps('{"value": "Q"}'), "Q"), (json.dumps("[broken"), "[broken"),
    (json.dumps("[broken]"), "[broken]"), ('[{"value":"A"},{"value":"B"}]', None), (json.dumps('[{"value":"A"},{"value":"B"}]'), None),
    ("12", None), ("[]", None), ('[{"value":""}]', None),
]


@pytest.fixture(scope="module")
def judged(spark):
    raws = [r for r, _, _ in STRICT]
    df = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    return {r["i"]: r["s"] for r in df.select("i", labels.strict_label(F.col("raw")).alias("s")).collect()}


@pytest.mark.parametrize("i", range(len(STRICT)))
def test_strict_label(judged, i):
    assert (judged[i]["value"], judged[i]["method"]) == STRICT[i][1:]


def test_lenient_label(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(LENIENT)], "i int, raw string")
    got = {r["i"]: r["l"] for r in df.select("i", labels.lenient_label(F.col("raw")).alias("l")).collect()}
    assert [got[i] for i in range(len(LENIENT))] == [want for _, want in LENIENT]


def test_absent_null_and_broken_are_told_apart(spark):
    rows = ['{"a":1}', '{"t":null}', '{"t":[]}', '{"t":', "[1]"]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, raw string")
    got = [r["k"] for r in df.select("i", labels.presence_kind(F.col("raw"), "t").alias("k")).orderBy("i").collect()]
    assert got == ["absent", "null", "present", "unparseable", "unparseable"]


def test_support_buckets(spark):
    sizes = [0, 1, 5, 6, 10, 11, 25, 26, 50, 51, 100, 101, 500, 501, 10**9]
    df = spark.createDataFrame([(n,) for n in sizes], "n long")
    got = [r["b"] for r in df.select(labels.support_bucket(F.col("n")).alias("b")).collect()]
    assert got == ["0", "1-5", "1-5", "6-10", "6-10", "11-25", "11-25", "26-50", "26-50", "51-100", "51-100",
                   "101-500", "101-500", "501+", "501+"]


@pytest.mark.parametrize("path, nodes", [
    ("1>22>3", ["1", "22", "3"]), ("7", ["7"]), ("1>>2", None), ("1>x", None), ("", None), (">1", None), ("1>", None), ("1> 2", None)])
def test_parse_path(spark, path, nodes):
    row = spark.createDataFrame([(path,)], "p string").select(paths.parse_path(F.col("p")).alias("n")).first()
    assert row["n"] == nodes


def test_path_errors(spark):
    cases = [
        ("1>2", ["1", "2"], 2, "1", "2", []),
        (None, ["1"], 1, "1", "1", ["category_id_path_not_string"]),
        ("1>2", None, 2, "1", "2", ["category_path_not_list"]),
        ("1>2", ["1", "2"], None, "1", "2", ["depth_not_integer"]),
        ("1>2", ["1", "2", "3"], 3, "1", "3", ["category_id_path_depth_mismatch", "leaf_category_id_mismatch"]),
        ("1>2", ["1", "2"], 2, None, "2", ["root_category_id_mismatch", "root_category_id_path_mismatch"]),
        ("1>2", [], 0, "1", "2", ["category_id_path_depth_mismatch"]),
    ]
    df = spark.createDataFrame(
        [(i, *c[:5]) for i, c in enumerate(cases)], "i int, p string, n array<string>, d int, r string, l string")
    errors = paths.path_errors(*[F.col(c) for c in "pndrl"])
    got = {r["i"]: r["e"] for r in df.select("i", errors.alias("e")).collect()}
    for i, case in enumerate(cases):
        assert got[i] == case[5], case


def test_taxonomy_from_prefixes(spark):
    df = spark.createDataFrame([("1>2>3",), ("1>2",), ("4",), ("1>x",)], "p string")
    nodes = taxonomy.taxonomy_nodes(df, "p")
    assert {tuple(r) for r in nodes.collect()} == {("1", None, 1), ("1>2", "1", 2), ("1>2>3", "1>2", 3), ("4", None, 1)}
    assert {r["node_id"] for r in taxonomy.terminal_nodes(nodes).collect()} == {"1>2>3", "4"}
    problems = taxonomy.node_problems(nodes).first()
    assert problems["parent_depth_mismatch"] == problems["wrong_depth"] == 0 and problems["roots"] == 2


def test_unseen_children_needs_a_known_parent(spark):
    train = spark.createDataFrame([("1>2",), ("1>3",)], "p string")
    test = spark.createDataFrame([("1>4",), ("9>5",), ("1>2",)], "p string")
    assert [tuple(r) for r in taxonomy.unseen_children(train, test, "p").collect()] == [("1", "4")]
    assert {r["p"] for r in taxonomy.unseen_paths(train, test, "p").collect()} == {"1>4", "9>5"}


def test_level_accuracy_counts_only_true_levels(spark):
    df = spark.createDataFrame([("1>2>3", "1>2"), ("1>2", "1>5>3"), ("4", "4")], "t string, p string")
    got = {r["level"]: (r["correct"], r["total"]) for r in taxonomy.level_accuracy(df, "t", "p").collect()}
    assert got == {1: (3, 3), 2: (1, 2), 3: (0, 1)}


@pytest.mark.parametrize("raw, safe, image", [
    ("8c/a.jpg", "8c/a.jpg", True), ("8c\\a.PNG", "8c/a.PNG", True), ("../x.jpg", None, None), ("a/../../x.jpg", None, None),
    ("", None, None), ("  ", None, None), (" a.gif ", "a.gif", False), ("..a/b.jpeg", "..a/b.jpeg", True), ("/etc/x.jpg", None, None)])
def test_relative_paths(spark, raw, safe, image):
    df = spark.createDataFrame([(raw,)], "p string").select(paths.relative_path(F.col("p")).alias("p"))
    row = df.select("p", paths.has_image_extension(F.col("p")).alias("x")).first()
    assert (row["p"], row["x"]) == (safe, image)


DOC = {"item_name": [{"language_tag": "en", "value": " a  b "}, {"language_tag": "de", "value": "c"}],
       "n": {"source": "s", "deep": [["d"], {"e": {"f": "g"}}]}, "num": 3, "none": None}


def test_json_text_rules(spark):
    df = spark.createDataFrame([(json.dumps(DOC),), ("{bad",), (None,)], "raw string")
    listing = [r["x"] for r in df.select(jsontext.text_leaves(F.col("raw")).alias("x")).collect()]
    attribute = [r["x"] for r in df.select(
        jsontext.text_leaves(F.col("raw"), jsontext.ATTRIBUTE_SKIPPED_KEYS, False).alias("x")).collect()]
    assert listing == [[" a  b ", "c", "s", "d", "g"], None, None]
    assert attribute[0] == [" a  b ", "c", "d", "g"]


def test_json_squeeze_keeps_structure(spark):
    df = spark.createDataFrame([(json.dumps(DOC),)], "raw string")
    out = json.loads(df.select(jsontext.squeeze_json(F.col("raw"), keep=("language_tag",)).alias("x")).first()["x"])
    assert out["item_name"][0] == {"language_tag": "en", "value": "a b"} and out["num"] == 3 and out["none"] is None


def test_json_leaves_as_lateral_join(spark):
    jsontext.register(spark)
    spark.createDataFrame([(1, json.dumps(DOC)), (2, "{}")], "id int, doc string").createOrReplaceTempView("docs")
    rows = spark.sql("SELECT id, path, value FROM docs, LATERAL json_leaves(doc)").collect()
    got = {r["path"]: r["value"] for r in rows}
    assert {r["id"] for r in rows} == {1}
    assert got["n.deep[1].e.f"] == "g" and got["n.deep[0][0]"] == "d" and got["num"] == "3" and got["none"] is None
    assert got["item_name[1].value"] == "c"


def test_json_leaves_level_by_level(spark):
    docs = [json.dumps(DOC), '{"a":{"b.c":[1,2.5,{"d":null}],"it\'s":true},"f":{},"g":[],"":"x"}', "{broken", '{"a":1} more', "[[],[0]]", '"s"', None]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, raw string").repartition(2)
    got = {}
    for r in jsonleaves.json_leaves(df, "raw", ["id"]).collect():
        got.setdefault(r["id"], {})[r["path"]] = r["value"]
    assert got[1] == {"a['b.c'][0]": "1", "a['b.c'][1]": "2.5", "a['b.c'][2].d": None, "a['it\\'s']": "true", "['']": "x"}
    assert got[2] == {None: "{broken"} and got[3] == {None: '{"a":1} more'} and got[4] == {"[1][0]": "0"} and got[5] == {"": "s"} and 6 not in got
    # The table function for SQL agrees, also on a broken line.
    jsontext.register(spark)
    df.filter("id <> 3").createOrReplaceTempView("leafy")
    rows = spark.sql("SELECT id, path, value FROM leafy, LATERAL json_leaves(raw)").collect()
    want = {i: v for i, v in got.items() if i != 3}
    assert {i: {r["path"]: r["value"] for r in rows if r["id"] == i} for i in want} == want
    assert jsonleaves.json_leaves(df.limit(0), "raw", ["id"]).count() == 0


def test_presence_rules_differ_on_empty_values(spark):
    doc = '{"a":"","b":[],"c":{},"d":null,"e":[1],"f":" x","g":false,"h":0}'
    df = spark.createDataFrame([(doc,)], "raw string").select(F.parse_json("raw").alias("d"))

    def look(name):
        return F.try_variant_get(F.col("d"), f"$.{name}", "variant")

    names = "abcdefghi"
    row = df.select(*[x for n in names for x in (
        jsontext.is_present(look(n), True).alias(f"{n}1"), jsontext.is_present(look(n), False).alias(f"{n}0"),
        jsontext.value_kind(look(n)).alias(f"{n}k"))]).first()
    assert [row[f"{n}1"] for n in names] == [True, False, True, False, True, True, True, True, False]
    assert [row[f"{n}0"] for n in names] == [False, False, False, False, True, True, True, True, False]
    assert [row[f"{n}k"] for n in names] == [
        "string", "list", "dict", "missing", "list", "string", "bool", "number", "missing"]


def test_content_at_any_depth(spark):
    cases = [('"x"', True), ('" "', False), ("[]", False), ('[[],{"a":null}]', False), ('{"a":{"b":0}}', True), ("false", True),
             ("null", False), (None, None), ("{bad", None)]
    df = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(cases)], "i int, raw string")
    got = {r["i"]: r["x"] for r in df.select("i", jsontext.has_content(F.col("raw")).alias("x")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def test_listing_kind_names(spark):
    df = spark.createDataFrame([('{"a":"x","b":1,"c":1.5,"d":true,"e":[],"f":{}}',)], "raw string").select(F.parse_json("raw").alias("d"))
    row = df.select(*[jsontext.listing_value_kind(F.try_variant_get(F.col("d"), f"$.{n}", "variant")).alias(n) for n in "abcdefg"]).first()
    assert list(row) == ["str", "int", "float", "bool", "list", "dict", "missing"]
