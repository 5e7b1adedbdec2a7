from quernstone.operators import checklist, trees


def test_dotted_keys_of_every_depth(spark):
    rows = [(1, '{"a": {"b": "x", "c": {"d": 2, "e": {}, "f": null}}, "g": [1, {"h": 2}], "i": true}'), (2, None), (3, "no json"), (4, "[1]"), (5, "{}"), (6, '{"a": {"b": {"c": {"d": {"e": "deep"}}}}}')]
    got = {(r.id, r.key_path): r.value for r in trees.flat_keys(spark.createDataFrame(rows, "id int, json string"), ["id"], "json").collect()}
    assert got == {(1, "a.b"): "x", (1, "a.c.d"): "2", (1, "a.c.f"): None, (1, "g"): '[1,{"h":2}]', (1, "i"): "true", (6, "a.b.c.d.e"): "deep"}
    assert trees.flat_keys(spark.createDataFrame([], "id int, json string"), ["id"], "json").count() == 0


def test_completeness_of_nested_catalogues(spark):
    rows = [("en", '{"a": {"b": "{{x}} one", "c": "two"}}'), ("fr", '{"a": {"b": "{{y}} un"}, "d": "plus"}')]
    flat = trees.flat_keys(spark.createDataFrame(rows, "lang string, json string"), ["lang"], "json")
    assert sorted(map(tuple, checklist.key_parity(flat).collect())) == [("fr", "a.b", "placeholders"), ("fr", "a.c", "missing"), ("fr", "d", "extra")]
