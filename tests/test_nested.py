import json

from conftest import rows

from lodestrata.operators.nested import inside, label_nodes, node_table, parse_json
from lodestrata.queries.records import SNAPSHOT_TYPES


def test_deep_bodies_parse_without_recursion():
    deep = '{"snapshots":[{"snapshot":' * 40_000 + '{"path":"end"}' + "}]}" * 40_000
    nodes = list(label_nodes(parse_json(deep), "snapshot", SNAPSHOT_TYPES))
    assert len(nodes) == 80_001 and max(n[3] for n in nodes) == 80_000


def test_own_parser_agrees_with_the_library():
    from lodestrata.operators.nested import _parse_deep

    for text in ('{"a": [1, -2.5e3, "x\\u00e9\\n", true, null, {}], "b": []}', "[]", "3", ' {"k" : "v"} '):
        assert _parse_deep(text) == json.loads(text)
    for bad in ("", "{", "[1,]", '{"a"}', "1 2", '{"a":1,}', "nul", "[1"):
        try:
            _parse_deep(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_labels_nest_and_link(spark):
    body = json.dumps({"path": "root", "fragments": {"path": "lone"}, "snapshots": [{"path_to_snapshot": "p1", "snapshot": {"fragments": [{"path": None}, {"seq_no": 1}, None], "snapshots": None}}, {"path_to_snapshot": "p2"}]})
    df = spark.createDataFrame([(1, body, "x"), (1, body, "y"), (2, "{broken", "x"), (3, None, "x"), (4, "", "x"), (5, "[1]", "x"), (None, '{"fragments": [{"path": "n"}]}', "x")], "doc int, b string, pre string")
    nodes = node_table(df.drop("pre"), "doc", "b", "snapshot", SNAPSHOT_TYPES)
    got = [r for r in nodes.collect() if r["doc"] == 1]
    assert len(got) == 8 and len({x for r in got for x in (r["pre"], r["post"])}) == 16
    for r in got:
        holders = [p for p in got if p["pre"] < r["pre"] and r["post"] < p["post"]]
        assert len(holders) == r["level"]
    for kind, above in (("fragment", "snapshot"), ("pointer", "snapshot"), ("snapshot", "pointer")):
        above_rows = nodes.filter(f"node_type = '{above}'").select("doc", "_doc_hash", "pre", "post", "level", nodes.pre.alias("up"))
        for r in inside(nodes.filter(f"node_type = '{kind}'"), above_rows, "doc", "left").filter("doc = 1").collect():
            assert r["up"] == max((p["pre"] for p in got if p["pre"] < r["pre"] and r["post"] < p["post"]), default=None)
    parents = nodes.filter("node_type = 'snapshot'").select("doc", "_doc_hash", "pre", "post", "level", nodes.attrs.alias("holder"))
    linked = inside(nodes.filter("node_type = 'fragment'"), parents, "doc")
    assert [(r[0], r[1]) for r in sorted(rows(linked.filter("doc = 1").select("field", "pos")))] == [("fragments", 0), ("fragments", 0), ("fragments", 1), ("fragments", 2)]
    assert linked.filter("doc is null").count() == 1


def test_a_node_of_another_type_one_level_up_does_not_hold(spark):
    cols = "doc int, _doc_hash long, pre long, post long, level int"
    nodes = spark.createDataFrame([(1, 0, 0, 9, 0), (1, 0, 1, 2, 1), (1, 0, 3, 6, 1), (1, 0, 4, 5, 2)], cols)
    first = nodes.filter("pre = 1").withColumn("name", nodes.pre)
    assert inside(nodes.filter("pre = 4"), first, "doc").count() == 0
    assert inside(nodes.filter("pre = 4"), first, "doc", "left").first()["name"] is None
    assert inside(nodes.filter("pre in (1, 3)"), nodes.filter("pre = 0").withColumn("name", nodes.post), "doc").count() == 2


def test_empty(spark):
    assert node_table(spark.createDataFrame([], "doc int, b string"), "doc", "b", "snapshot", SNAPSHOT_TYPES).count() == 0


def test_lone_surrogates_are_replaced(spark):
    df = spark.createDataFrame([(1, '{"path": "a\\ud800b", "fragments": []}')], "doc int, b string")
    assert "�" in node_table(df, "doc", "b", "snapshot", SNAPSHOT_TYPES).first()["attrs"]


def test_a_deep_field_leaves_the_others_readable(spark):
    from pyspark.sql import functions as F

    for depth in (5, 1_500, 50_000):
        field = '{"a": [' * depth + "1" + "]}" * depth
        df = spark.createDataFrame([(1, f'{{"x": {field}, "path": "p", "snapshots": [{{"path_to_snapshot": "q"}}]}}')], "doc int, b string")
        got = node_table(df, "doc", "b", "snapshot", SNAPSHOT_TYPES).select("level", F.get_json_object("attrs", "$.path").alias("p"), F.get_json_object("attrs", "$.path_to_snapshot").alias("q"), F.get_json_object("attrs", "$.x").alias("x")).collect()
        assert {r["p"] for r in got if r["level"] == 0} == {"p"} and "q" in {r["q"] for r in got}
        assert {r["x"].replace(" ", "") for r in got if r["level"] == 0} == {field.replace(" ", "")}
