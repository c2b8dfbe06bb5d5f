"""Directed graphs as node, edge and chain tables: validation, cycles, readiness, ranking."""

from __future__ import annotations

import json
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.raw import write_json, write_text


def edge_problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, problem) of edges: unknown ends, self-edges, lag intervals the wrong way round, repeated ids."""
    known = nodes.select("id").distinct()
    ends = []
    for side in ("source", "target"):
        ends.append(edges.join(known.select(F.col("id").alias(side)), side, "left_anti").select("id", F.lit(f"unknown_{side}").alias("problem")))
    own = edges.where("source = target").select("id", F.lit("self_edge").alias("problem"))
    lag = edges.where("lag_min > lag_max or lag_min < 0").select("id", F.lit("bad_lag").alias("problem"))
    twice = edges.groupBy("id").count().where("count > 1").select("id", F.lit("repeated_id").alias("problem"))
    return ends[0].unionByName(ends[1]).unionByName(own).unionByName(lag).unionByName(twice)


#: Rules of a graph's tables. ``required``: fields that must not be null or empty; ``enums``: fields and their values; ``references``: fields (single or arrays) whose values must be ids of nodes or edges.
Rules = dict[str, dict]
RULES: dict[str, Rules] = {
    "nodes": {"required": {"type", "layer", "order", "data_status"}, "enums": {}, "references": {}},
    "edges": {"required": {"type", "sign", "lag_min", "lag_max", "horizon_unit", "evidence_status"}, "enums": {}, "references": {"source": "nodes", "target": "nodes", "conditioning_on": "nodes"}},
    "chains": {"required": {"node_ids", "edge_ids"}, "enums": {}, "references": {"node_ids": "nodes", "edge_ids": "edges"}},
}


def rule_problems(tables: dict[str, DataFrame], rules: dict[str, Rules], checks: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """(kind, id, problem, field) of every broken rule: missing_id, repeated_id, missing_field, unknown_value, unknown_reference, and the named ``checks`` (SQL conditions that hold for a sound row).

    The row rules of a table are compiled into one pass; references of all tables meet the known ids in one join. Each problem stands once for a row and field. A row without an id has the id ''.
    """
    own, wanted, known = None, None, None
    for kind, df in tables.items():
        spec = rules.get(kind, {})
        rule = lambda bad, problem, field: F.when(F.coalesce(bad, F.lit(True)), F.struct(F.lit(problem).alias("problem"), F.lit(field).alias("field")))
        empty = lambda c: F.col(c).isNull() | (F.size(c) == 0 if df.schema[c].dataType.typeName() == "array" else F.trim(F.col(c).cast("string")) == "")
        found = [rule(empty("id"), "missing_id", "id")]
        found += [rule(empty(c), "missing_field", c) for c in sorted(spec.get("required", ()))]
        found += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*values), F.struct(F.lit("unknown_value").alias("problem"), F.lit(c).alias("field"))) for c, values in sorted(spec.get("enums", {}).items())]
        found += [F.when(~F.coalesce(F.expr(condition), F.lit(True)), F.struct(F.lit(name).alias("problem"), F.lit("").alias("field"))) for name, condition in sorted((checks or {}).get(kind, {}).items())]
        name = F.coalesce(F.col("id"), F.lit("")).alias("id")
        problems = df.select(F.lit(kind).alias("kind"), name, F.explode(F.array_compact(F.array(*found))).alias("p")).select("kind", "id", "p.*")
        twice = df.where("id is not null").groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select(F.lit(kind).alias("kind"), "id", F.lit("repeated_id").alias("problem"), F.lit("id").alias("field"))
        own = problems.unionByName(twice) if own is None else own.unionByName(problems).unionByName(twice)
        ids = df.where("id is not null").select(F.lit(kind).alias("of"), F.col("id").alias("ref")).distinct()
        known = ids if known is None else known.unionByName(ids)
        links = spec.get("references", {})
        if links:
            values = F.array(*(F.struct(F.lit(c).alias("field"), F.lit(of).alias("of"), (F.col(c) if df.schema[c].dataType.typeName() == "array" else F.array(F.col(c))).alias("refs")) for c, of in sorted(links.items())))
            each = df.select(F.lit(kind).alias("kind"), name, F.explode(values).alias("v")).select("kind", "id", "v.field", "v.of", F.explode("v.refs").alias("ref"))
            wanted = each if wanted is None else wanted.unionByName(each)
    if wanted is not None:
        lost = wanted.join(known, ["of", "ref"], "left_anti").select("kind", "id", F.lit("unknown_reference").alias("problem"), "field")
        own = own.unionByName(lost)
    return own.distinct()


#: Conditions that a sound row meets. A null lag is a missing field, no bad interval.
CHECKS = {"nodes": {"bad_order": "order >= 0"}, "edges": {"self_edge": "source <> target", "bad_lag": "lag_min >= 0 AND lag_max >= lag_min"}}


def cyclic_nodes(edges: DataFrame, cut) -> DataFrame:
    """Nodes on or between cycles: peel off nodes without an incoming or an outgoing edge until none is left to peel. ``cut`` cuts the lineage each round."""
    left = cut(edges.select("source", "target").distinct())
    size = left.count()
    while size:
        kept = left.join(left.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(left.select(F.col("source").alias("target")).distinct(), "target", "left_semi")
        left = cut(kept)
        now = left.count()
        if now == size:
            break
        size = now
    return left.select(F.col("source").alias("node")).union(left.select("target")).distinct()


def reachable(edges: DataFrame, start: DataFrame, rounds: int, cut) -> DataFrame:
    """(node, depth): the nodes that a walk from ``start`` reaches within ``rounds`` edges, with the least number of edges."""
    seen = cut(start.select("node", F.lit(0).alias("depth")))
    front = seen
    for depth in range(1, rounds + 1):
        step = front.join(edges, front["node"] == edges["source"]).select(F.col("target").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        front = cut(step.select("node", F.lit(depth).alias("depth")))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


def open_chains(chains: DataFrame, edges: DataFrame) -> DataFrame:
    """(chain, edge) where an edge of a chain has an end outside the chain's nodes or is unknown. ``chains``: id, node_ids, edge_ids."""
    each = chains.select(F.col("id").alias("chain"), "node_ids", F.explode("edge_ids").alias("edge"))
    joined = each.join(edges.select(F.col("id").alias("edge"), "source", "target"), "edge", "left")
    inside = F.array_contains("node_ids", F.col("source")) & F.array_contains("node_ids", F.col("target"))
    return joined.where(~F.coalesce(inside, F.lit(False))).select("chain", "edge")


def chain_readiness(chains: DataFrame, nodes: DataFrame, ready: str = "ready") -> DataFrame:
    """Which nodes of each chain have no data yet."""
    each = chains.select(F.col("id").alias("chain"), F.explode("node_ids").alias("node")).join(nodes.select(F.col("id").alias("node"), "status"), "node", "left")
    blocked = F.array_sort(F.collect_set(F.when(F.coalesce(F.col("status"), F.lit("")) != ready, F.col("node"))))
    return each.groupBy("chain").agg(F.concat_ws(",", blocked).alias("blocked")).withColumn("ready", F.col("blocked") == "")


def ranked(candidates: DataFrame, nodes: DataFrame, chains: DataFrame) -> DataFrame:
    """Candidates (id, node_ids, replications, interactions) by known nodes + touched chains + 3 replications + 2 interactions."""
    own = candidates.select("id", F.explode("node_ids").alias("node"))
    n = own.join(nodes.select(F.col("id").alias("node")).distinct(), "node", "left_semi").groupBy("id").agg(F.countDistinct("node").alias("n_nodes"))
    touched = own.join(chains.select(F.col("id").alias("chain"), F.explode("node_ids").alias("node")), "node").groupBy("id").agg(F.countDistinct("chain").alias("n_chains"))
    out = candidates.join(n, "id", "left").join(touched, "id", "left").fillna(0, ["n_nodes", "n_chains"])
    return out.withColumn("score", F.col("n_nodes") + F.col("n_chains") + 3 * F.col("replications") + 2 * F.col("interactions")).select("id", "n_nodes", "n_chains", "score")


def _fitting(tables: dict[str, DataFrame], most: int) -> dict[str, list[dict]]:
    """The rows of small tables in order of their ids, empty fields left out; more than ``most`` rows of one are an error, as the file is written by the driver."""
    out = {}
    for name, df in tables.items():
        rows = df.orderBy("id").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError("the graph is too large for one file")
        out[name] = [{k: v for k, v in r.asDict(recursive=True).items() if v is not None} for r in rows]
    return out


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str, most: int = 100_000) -> None:
    """A small graph as GraphML with all its fields; arrays and structures stand there as JSON."""
    held = _fitting({"node": nodes, "edge": edges}, most)
    ends = {"node": {"id"}, "edge": {"id", "source", "target"}}
    kinds = {bool: "boolean", int: "long", float: "double"}
    names = {(kind, k): kinds.get(type(v), "string") for kind, rows in held.items() for r in reversed(rows) for k, v in r.items() if k not in ends[kind]}
    keys = {name: f"d{i}" for i, name in enumerate(sorted(names))}

    def data(kind: str, r: dict) -> str:
        said = lambda v: str(v).lower() if isinstance(v, bool) else json.dumps(v, ensure_ascii=False, sort_keys=True, default=str) if isinstance(v, list | dict) else str(v)
        return "".join(f'<data key="{keys[kind, k]}">{escape(said(v))}</data>' for k, v in sorted(r.items()) if (kind, k) in keys)

    lines = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    lines += [f'<key id="{keys[kind, k]}" for="{kind}" attr.name={quoteattr(k)} attr.type="{names[kind, k]}"/>' for kind, k in sorted(names)]
    lines += ['<graph edgedefault="directed">', *(f"<node id={quoteattr(str(r['id']))}>{data('node', r)}</node>" for r in held["node"])]
    lines += [f"<edge id={quoteattr(str(r['id']))} source={quoteattr(str(r['source']))} target={quoteattr(str(r['target']))}>{data('edge', r)}</edge>" for r in held["edge"]]
    write_text(nodes.sparkSession, path, "\n".join([*lines, "</graph></graphml>", ""]))


def write_graph_json(nodes: DataFrame, edges: DataFrame, chains: DataFrame, path: str, details: dict | None = None, ready: str = "ready", most: int = 100_000) -> dict:
    """A small graph as JSON: nodes, links and chains with all their fields; a chain also has its status and the nodes that block it. Returns what was written."""
    blocked = chain_readiness(chains, nodes.select("id", F.col("data_status").alias("status")), ready).select(F.col("chain").alias("id"), F.filter(F.split("blocked", ","), lambda x: x != "").alias("blocked_node_ids"))
    whole = chains.join(blocked, "id", "left").withColumn("status", F.when(F.size("blocked_node_ids") > 0, "blocked").otherwise(ready))
    held = _fitting({"nodes": nodes, "links": edges, "chains": whole}, most)
    value = {**(details or {}), **held}
    write_json(nodes.sparkSession, path, value)
    return value
