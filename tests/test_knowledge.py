"""Slots, lineage, graph rules and graph files by hand."""

import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidemark.operators import graph, lineage, slots
from tidemark.plans import knowledge


def test_texts_come_back_in_slot_order(spark):
    events = spark.createDataFrame([(1, 7, None, 9, 7), (2, None, 8, 99, None), (3, None, None, None, None), (4, 98, None, None, None), (5, 10, None, None, None)], "event long, a long, b long, c long, d long")
    texts = spark.createDataFrame([(7, " seven\n", "A"), (8, "eight", None), (9, "nine", "C"), (9, "nine!", "B"), (10, "  ", ""), (None, "lost", "X")], "id long, text string, who string")
    watch = Observation("links")
    out = slots.linked_texts(events, "event", ["a", "b", "c", "d"], texts, "id", {"full": ("text", "\n\n"), "who": ("who", " | ")}, watch)
    got = {r.event: (r.n_named, r.n_found, r.full, r.who) for r in out.collect()}
    assert got == {1: (3, 3, "seven\n\nnine!\n\nseven", "A | B | A"), 2: (2, 1, "eight", None), 3: (0, 0, None, None), 4: (1, 0, None, None), 5: (1, 1, None, None)}
    assert watch.get == {"named": 7, "missing": 2}


def test_reactions_to_unknown_events_are_counted(spark):
    events = spark.createDataFrame([(1, "x")], "id long, title string")
    reactions = spark.createDataFrame([(1, 0.5), (1, 0.1), (2, 0.2), (None, 0.3)], "id long, r double")
    watch = Observation()
    assert slots.with_reactions(reactions, events, "id", watch).count() == 2
    assert watch.get == {"reactions": 4, "unknown": 2}


DATASETS = [("a", "1", []), ("b", "2", []), ("c", "3", ["b", "a"]), ("d", "4", ["c"]), ("e", "5", ["a"]), ("f", None, ["d", "e", "d"])]


def datasets(spark, rows):
    return spark.createDataFrame(rows, "name string, config string, parents array<string>")


def test_a_changed_parent_marks_its_descendants(spark):
    before = lineage.lineage_ids(datasets(spark, DATASETS))
    assert {r.name: r.depth for r in before.collect()} == {"a": 0, "b": 0, "c": 1, "d": 2, "e": 1, "f": 3}
    same = lineage.staleness(datasets(spark, [(n, c, p[::-1]) for n, c, p in DATASETS[::-1]]), before)
    assert same.where("stale or changed").count() == 0
    for name, stale in (("b", {"b", "c", "d", "f"}), ("e", {"e", "f"}), ("f", {"f"}), ("a", {"a", "c", "d", "e", "f"})):
        now = lineage.staleness(datasets(spark, [(n, (c or "") + "!" * (n == name), p) for n, c, p in DATASETS]), before).collect()
        assert {r.name for r in now if r.stale} == stale and {r.name for r in now if r.changed} == {name}
    added = lineage.staleness(datasets(spark, [*DATASETS, ("g", "7", ["a"])]), before).where("stale").collect()
    assert [(r.name, r.recorded_id, r.changed) for r in added] == [("g", None, True)]


@pytest.mark.parametrize("extra", [("x", "1", ["nowhere"]), ("x", "1", ["x"]), ("x", "1", ["a", None])])
def test_datasets_without_a_turn_are_an_error(spark, extra):
    with pytest.raises(ValueError, match="unknown parents"):
        lineage.lineage_ids(datasets(spark, [*DATASETS, extra]))


def test_rules_find_nothing_in_a_sound_graph_and_each_fault(spark):
    nodes = spark.createDataFrame([("a", "market", "l", 0, "ready"), ("b", "market", "l", 1, "planned")], "id string, type string, layer string, order int, data_status string")
    edges = spark.createDataFrame([("e", "a", "b", "flow", "plus", 0.0, 2.0, "day", "open", None)], "id string, source string, target string, type string, sign string, lag_min double, lag_max double, horizon_unit string, evidence_status string, conditioning_on array<string>")
    chains = spark.createDataFrame([("c", ["a", "b"], ["e"])], "id string, node_ids array<string>, edge_ids array<string>")
    find = lambda **t: {(r.kind, r.id, r.problem, r.field) for r in graph.rule_problems({"nodes": nodes, "edges": edges, "chains": chains} | t, graph.RULES, graph.CHECKS).collect()}
    assert find() == set()
    assert find(edges=edges.withColumn("conditioning_on", F.array(F.lit("a"), F.lit("q")))) == {("edges", "e", "unknown_reference", "conditioning_on")}
    assert find(edges=edges.withColumn("target", F.col("source"))) == {("edges", "e", "self_edge", "")}
    assert find(edges=edges.withColumn("lag_min", F.lit(3.0))) == {("edges", "e", "bad_lag", "")}
    assert find(edges=edges.union(edges)) == {("edges", "e", "repeated_id", "id")}
    assert find(nodes=nodes.withColumn("order", F.lit(-1))) == {("nodes", x, "bad_order", "") for x in "ab"}
    assert find(chains=chains.withColumn("edge_ids", F.array().cast("array<string>"))) == {("chains", "c", "missing_field", "edge_ids")}
    assert find(chains=chains.withColumn("id", F.lit(None).cast("string"))) == {("chains", "", "missing_id", "id")}
    rules = {**graph.RULES, "nodes": {**graph.RULES["nodes"], "enums": {"type": ["policy"]}}}
    assert {(r.id, r.problem) for r in graph.rule_problems({"nodes": nodes}, rules).collect()} == {("a", "unknown_value"), ("b", "unknown_value")}


def test_graph_files_hold_every_field(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "x<y", 1, "ready"), ("b", None, 2, "planned")], "id string, label string, order int, data_status string")
    edges = spark.createDataFrame([("e", "a", "b", 0.5, True, ["a", "b"])], "id string, source string, target string, lag double, firm boolean, conditioning_on array<string>")
    chains = spark.createDataFrame([("c", ["a", "b"], ["e"]), ("d", ["a"], ["e"])], "id string, node_ids array<string>, edge_ids array<string>")
    graph.write_graphml(nodes, edges, f"{tmp_path}/g.xml")
    space = "{http://graphml.graphdrawing.org/xmlns}"
    root = ET.parse(f"{tmp_path}/g.xml").getroot()
    keys = {k.get("id"): (k.get("for"), k.get("attr.name"), k.get("attr.type")) for k in root.iter(f"{space}key")}
    assert set(keys.values()) == {("node", "label", "string"), ("node", "order", "long"), ("node", "data_status", "string"), ("edge", "lag", "double"), ("edge", "firm", "boolean"), ("edge", "conditioning_on", "string")}
    found = {e.get("id"): {keys[d.get("key")][1]: d.text for d in e} for e in [*root.iter(f"{space}node"), *root.iter(f"{space}edge")]}
    assert found == {"a": {"label": "x<y", "order": "1", "data_status": "ready"}, "b": {"order": "2", "data_status": "planned"}, "e": {"lag": "0.5", "firm": "true", "conditioning_on": '["a", "b"]'}}
    written = graph.write_graph_json(nodes, edges, chains, f"{tmp_path}/g.json", {"title": "t"})
    assert json.loads((tmp_path / "g.json").read_text()) == written
    assert [(c["id"], c["status"], c["blocked_node_ids"]) for c in written["chains"]] == [("c", "blocked", ["b"]), ("d", "ready", [])] and written["title"] == "t" and written["links"][0]["firm"] is True
    with pytest.raises(ValueError, match="too large"):
        graph.write_graphml(nodes, edges, f"{tmp_path}/h.xml", most=1)


def test_page_text_values(spark):
    pages = [
        ("<html><head><style>p {a: b}</style><title>T</title></head><body><p>One&nbsp;<b>two</b></p>\n<script>var x = '<p>';</script>three &lt;4&gt; &amp;amp; &quot;five&quot; &#39;six&#39;</body></html>", "T One two three <4> &amp; \"five\" 'six'"),
        ("", ""), ("plain", "plain"), ("<p\nclass='x'>a</p><br/>b", "a b"), ("<SCRIPT>no</SCRIPT>yes", "yes"), (None, None),
    ]
    from tidemark.functions.columns import strip_tags

    out = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(pages)], "i int, h string").select("i", strip_tags(F.col("h")).alias("t")).orderBy("i").collect()
    assert [r.t for r in out] == [t for _, t in pages]
    own = knowledge.page_text(spark, "/root/testdata/sf0.001").collect()
    assert own and all("</p>" not in r.text and "  " not in r.text for r in own)
