"""Structure scores on hand-written node sequences, gates and clusters."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.operators.components import clusters, components
from lexigrid.operators.structure import gate, score_pairs, shapes, shapes_of_arrays, similar_gated, similar_scored
from lexigrid.operators.vectors import similar_pairs
from lexigrid.plans import catalogue, report

HEAD = "function_definition primitive_type function_declarator identifier parameter_list ("
PARAMS = "parameter_declaration primitive_type identifier , parameter_declaration primitive_type identifier )"
RETURN = "return_statement return"
GUARD = "compound_statement {{ if_statement if parenthesized_expression ( binary_expression identifier {} number_literal )"
BODY = f"compound_statement {{ {RETURN} number_literal ; }} {RETURN} number_literal ; }}"
ADD = f"{HEAD} {PARAMS} compound_statement {{ {RETURN} binary_expression identifier + identifier ; }}"
SUM = f"{HEAD} {PARAMS} compound_statement {{ declaration primitive_type init_declarator identifier = binary_expression identifier + identifier ; {RETURN} identifier ; }}"
POSITIVE = f"{HEAD} parameter_declaration primitive_type identifier ) {GUARD.format('>')} {BODY}"
VALID = f"{HEAD} parameter_declaration primitive_type identifier ) {GUARD.format('<')} {BODY}"
ORDER = (
    f"{HEAD} {PARAMS} compound_statement {{ declaration primitive_type init_declarator identifier = binary_expression identifier * identifier ; "
    "if_statement if parenthesized_expression ( unary_expression ! call_expression identifier argument_list ( identifier ) ) "
    f"compound_statement {{ {RETURN} number_literal ; }} {RETURN} identifier ; }}"
)
UNITS = {1: ("add", ADD), 2: ("disguised_add", ADD), 3: ("compute_sum", SUM), 4: ("is_positive", POSITIVE), 5: ("validate_total", VALID), 6: ("process_order", ORDER)}
EXPECTED = {(1, 2): 23 / 23, (4, 5): 30 / 34, (1, 3): 21 / 32, (3, 6): 27 / 53, (5, 6): 25 / 57}


@pytest.fixture(scope="module")
def units(spark):
    rows = [(k, f"f{k}.c", 1, 9, n, s.split(), ["validate_total"] if n == "process_order" else [n], "function") for k, (n, s) in UNITS.items()]
    return spark.createDataFrame(rows, "unit_id long, path string, start int, end int, name string, types array<string>, idents array<string>, kind string")


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(i, j, 0.8) for i, j in EXPECTED], "i long, j long, similarity double")


def test_published_scores(units, pairs):
    scored = score_pairs(pairs, shapes_of_arrays(units)).collect()
    for r in scored:
        assert r["structural"] == pytest.approx(EXPECTED[r["i"], r["j"]])
        assert r["distinct"] is None  # too few units
    assert len(scored) == len(EXPECTED)


def test_rows_and_arrays_agree(spark, units):
    nodes = units.select("unit_id", F.posexplode("types").alias("pos", "type"))
    assert sorted(map(tuple, shapes(nodes).collect())) == sorted(map(tuple, shapes_of_arrays(units).collect()))


def test_gates(spark, units, pairs):
    kept = {(r["i"], r["j"]) for r in gate(pairs, units, shapes_of_arrays(units)).collect()}
    assert kept == {(1, 2), (4, 5), (1, 3), (3, 6)}  # (5, 6) is a call
    loose = gate(pairs, units, shapes_of_arrays(units), min_structure=0.4, filter_callers=False)
    assert loose.count() == 5
    same_lines = units.withColumn("path", F.lit("one.c"))
    assert gate(pairs, same_lines, shapes_of_arrays(units)).count() == 0


def test_no_shape_is_no_signal(spark, units, pairs):
    bare = shapes_of_arrays(units.where("unit_id > 2"))
    got = {(r["i"], r["j"]): r["structural"] for r in score_pairs(pairs, bare).collect()}
    assert got[1, 2] is None and got[1, 3] is None and got[4, 5] is not None


def test_weights_against_loops(spark):
    rng, rows = random.Random(1), []
    for k in range(40):
        rows.append((k, [rng.choice("abcde") for _ in range(rng.randint(0, 12))]))
    units = spark.createDataFrame(rows, "unit_id long, types array<string>")
    pairs = spark.createDataFrame([(i, j, 1.0) for i in range(40) for j in range(i + 1, 40, 3)], "i long, j long, similarity double")
    import math
    from collections import Counter

    bags = {k: Counter(zip(t, t[1:])) for k, t in rows}
    shaped = [b for b in bags.values() if b]
    df = Counter(g for b in shaped for g in b)
    w = {g: math.log((len(shaped) + 1) / (c + 0.5)) for g, c in df.items()}
    for r in score_pairs(pairs, shapes_of_arrays(units)).collect():
        a, b = bags[r["i"]], bags[r["j"]]
        if not a or not b:
            assert r["structural"] is None and r["distinct"] is None
            continue
        inter, union = sum(min(a[g], b[g]) * w[g] for g in a | b), sum(max(a[g], b[g]) * w[g] for g in a | b)
        assert r["structural"] == pytest.approx(inter / union)
        both = sum((a & b).values())
        assert r["distinct"] == pytest.approx(inter / both / math.log((len(shaped) + 1) / 0.5) if both else 0.0)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    sizes = clusters(df).groupBy("cluster_id").count().collect()
    assert all(r["count"] > 1 for r in sizes)
    assert components(df.where("false")).count() == 0


def test_report_rounding(spark, units, pairs):
    scored = report.with_refs(score_pairs(pairs, shapes_of_arrays(units)), units.withColumn("name", F.when(F.col("unit_id") == 1, "").otherwise(F.col("name"))))
    rows = {(r["i"], r["j"]): r for r in scored.select("i", "j", report.pair_json().alias("json"), report.pair_line("text").alias("text"), report.pair_line("markdown").alias("md")).collect()}
    assert '"structural":0.6562' in rows[1, 3]["json"] and '"distinctiveness":null' in rows[1, 3]["json"]
    assert rows[4, 5]["text"] == "0.800  struct 0.882  distinct n/a  f4.c:1-9 is_positive  <->  f5.c:1-9 validate_total"
    assert rows[1, 3]["md"] == "| 0.800 | 0.656 | n/a | `f1.c:1-9` | `f3.c:1-9 compute_sum` |"


def test_report_path():
    assert report.report_path("a/r.json", "markdown") == "a/r.md"
    assert report.report_path("r.markdown", "markdown") == "r.markdown"
    assert report.report_path("r.out", "json") == "r.out"
    assert report.report_path("r", "text") == "r"


@pytest.mark.parametrize("many,weighted,located,callers", [(150, True, True, True), (150, False, False, True), (20, True, True, False)])
def test_pairs_are_judged_where_vectors_meet(spark, many, weighted, located, callers):
    """The same as joins of pairs with shapes and units, which may be missing or null."""
    rng, draw = random.Random(many), np.random.default_rng(many)
    names = ["f", "g", "h", "", None]
    rows = [
        (k, rng.choice(["p", "q", None]), rng.choice([1, 4, None]), rng.choice([3, 9]), rng.choice(names), rng.choice([None, [], rng.choices(names, k=3)]), rng.choices("abcde", k=rng.choice([0, 1, 9, 30])))
        for k in range(many) if k % 10
    ]
    units = spark.createDataFrame(rows, "unit_id long, path string, start int, end int, name string, idents array<string>, types array<string>")
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(draw.normal(size=(many, 4)))], "vec_id long, embedding array<double>")
    shape, pairs = shapes_of_arrays(units), similar_pairs(vectors, 0.5)

    def held(df):
        return {(r["i"], r["j"]): [r[c] if r[c] is None else pytest.approx(r[c]) for c in ("similarity", "structural", "structural_plain", "distinct")] for r in df.collect()}

    options = {"block": 30, "cell_rows": 20, "tile_rows": 70}
    want = held(score_pairs(pairs, shape, weighted))
    assert held(similar_scored(vectors, 0.5, shape, weighted)) == held(similar_scored(vectors, 0.5, shape, weighted, **options)) == want
    args = (units, shape, 0.3, 0.02, callers, weighted, located)
    want = held(gate(pairs, *args))
    assert 0 < len(want) < pairs.count()
    assert held(similar_gated(vectors, 0.5, *args)) == held(similar_gated(vectors, 0.5, *args, **options)) == want


@pytest.mark.parametrize("name", ["gated_pairs", "structural_scores"])
def test_pairs_are_not_shuffled(spark, sf, name):
    """Their number may grow as the square of the vectors'."""
    plan = catalogue.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GroupsInArrow" in plan and "Exchange" not in plan.split("GroupsInArrow")[0]
