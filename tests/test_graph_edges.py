"""The graph of suppliers: lines and pairs are dealt to tasks by their number, and none are broadcast."""

from collections import Counter

from binloom.operators import diffusion
from binloom.plans import catalog_tables
from binloom.sources.genome import Genome

from .test_engine import SF


def test_pairs_are_dealt(spark, monkeypatch):
    g = Genome(spark, SF)
    lines = g.read("lineitem").select("l_orderkey", "l_suppkey").collect()
    monkeypatch.setattr(catalog_tables, "LINES", -(-len(lines) // 13))
    rows = catalog_tables._graph_rows(g)
    orders, want = {}, Counter()
    for order, supplier in lines:
        orders.setdefault(order, []).append(supplier)
    for suppliers in orders.values():
        want.update((a, b) for k, a in enumerate(suppliers) for j, b in enumerate(suppliers) if j != k and a != b)
    assert {(r.row, c): v for r in rows.collect() for c, v in zip(r.columns, r["values"])} == dict(want)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    for keys in ("l_orderkey", "source", "source, target"):
        assert any("hashpartitioning(" in x and "13), REPARTITION_BY_NUM" in x and all(k in x for k in keys.split(", ")) for x in plan.splitlines()), keys


def test_a_pair_of_lines_comes_one_way(spark, monkeypatch):
    g = Genome(spark, SF)
    seen = {}
    monkeypatch.setattr(diffusion, "diffusion_component", lambda edges, tasks: seen.update(edges=edges, tasks=tasks) or edges)
    catalog_tables.x7(g)
    once = {(r.source, r.target): r.w for r in diffusion.averaged(seen["edges"], 3).collect()}
    assert once == {(r.source, r.target): r.weight for r in catalog_tables.shared_orders(g).collect()} and len(once) == 90
    assert once == {(r.source, r.target): r.w for r in diffusion.averaged(catalog_tables.shared_orders(g)).collect()}
    assert seen["edges"].where("source >= target").isEmpty() and seen["tasks"] == 1
