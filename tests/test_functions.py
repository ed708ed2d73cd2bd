"""Boundaries of the binners, scores, text keys and molecule functions."""

from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumiquery.functions import bins, scalars, smiles
from lumiquery.operators import chemistry


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("binner", "value", "label"),
    [
        (bins.EXPERIMENT, 399.9, "UV"), (bins.EXPERIMENT, 550.0, "yellow/orange"), (bins.EXPERIMENT, None, "red/NIR"),
        (bins.ERROR, 480.0, "green"), (bins.ERROR, 620.0, "yellow/orange"), (bins.ERROR, None, "missing"),
        (bins.MANUSCRIPT, 400.0, "blue"), (bins.MANUSCRIPT, 560.0, "yellow/orange"), (bins.MANUSCRIPT, 620.0, "red/NIR"),
        (bins.SIMILARITY, 1.0, "0.85-1.00"), (bins.SIMILARITY, 0.3, "0.30-0.50"), (bins.SIMILARITY, None, None),
        (bins.CONFIDENCE, 0.75, "high"), (bins.CONFIDENCE, 0.55, "medium"), (bins.CONFIDENCE, 0.45, "low-medium"), (bins.CONFIDENCE, 0.2, "low"), (bins.CONFIDENCE, None, "unknown"),
    ],
)
def test_bins(spark, binner, value, label):
    assert one(spark, binner.label(F.lit(value).cast("double"))) == label


def test_numbers(spark):
    assert one(spark, scalars.safe_double(F.lit("nan"))) is None
    assert one(spark, scalars.safe_double(F.lit("x"))) is None
    assert one(spark, scalars.safe_double(F.lit("1.5"))) == 1.5
    assert one(spark, scalars.first_number(F.lit("~450 nm"))) == 450
    assert one(spark, scalars.first_number(F.lit("none"))) is None
    assert one(spark, scalars.nm_to_ev(F.lit(620.0))) == 2.0
    assert one(spark, scalars.threshold_score(F.lit(None).cast("double"), 10, 60)) == 0.5
    assert one(spark, scalars.significant(F.lit(123456.7))) == one(spark, scalars.significant(F.lit(123456.9)))
    assert one(spark, scalars.tanimoto(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)))) == pytest.approx(1 / 3)
    assert one(spark, scalars.alnum_key(F.lit("Quantum Yield (é)"))) == "quantumyieldé"
    assert one(spark, scalars.job_id(F.lit("nothing"))) is None


@pytest.mark.parametrize(
    ("a", "b"),
    [("C(C)O", "OCC"), ("[OH2]", "O"), ("Cc1ccccc1", "c1ccc(C)cc1"), ("O=C1N(C)C(=O)c2ccccc21", "CN1C(=O)c2ccccc2C1=O"), ("CC(=O)[O-].[Na+]", "[Na+].CC([O-])=O"), ("[H]c1ccccc1", "c1ccccc1")],
)
def test_canonical_is_one_text(a, b):
    assert smiles.canonical(a) == smiles.canonical(b) is not None


@pytest.mark.parametrize("text", [None, "", "  ", "gas", "Film", "C(", "C1CC", "CX", "C(C)(C)(C)(C)C", "not_a_smiles"])
def test_not_a_molecule(text):
    assert smiles.canonical(text) is None
    assert smiles.morgan_bits(text) is None
    assert smiles.graph(text) is None


@given(st.sampled_from(sorted(chemistry.SOLVENT_ALIASES.values()) + [x[2] for x in chemistry.enumerate_library()]))
@settings(max_examples=60, deadline=None)
def test_canonical_is_stable(text):
    c = smiles.canonical(text)
    assert smiles.canonical(c) == c
    assert smiles.morgan_bits(text) == smiles.morgan_bits(c)


def test_scaffold_and_graph():
    assert smiles.scaffold("CCO") == ""
    assert smiles.scaffold("CCO", "<ACYCLIC>") == "<ACYCLIC>"
    assert smiles.scaffold("Cc1ccccc1") == smiles.canonical("c1ccccc1")
    g = smiles.graph("c1ccccc1")
    assert g["num_nodes"] == 6 and all(len(x) == 45 for x in g["x"]) and all(len(e) == 12 for e in g["edge_attr"]) and len(g["src"]) == 12
    assert smiles.graph("CCO")["num_nodes"] == 3
    d = smiles.descriptors("CCO")
    assert d["heavy_atom_count"] == 3 and d["num_hbond_donors"] == 1 and math.isclose(d["molecular_weight"], 46.069, abs_tol=0.01)


def test_graph_tables(spark):
    df = spark.createDataFrame([(1, "CCO"), (2, "gas"), (3, "c1ccccc1")], "id int, s string")
    nodes, edges = chemistry.graph_tables(df, "s", "id")
    assert {(r["id"], r["count"]) for r in nodes.groupBy("id").count().collect()} == {(1, 3), (3, 6)}
    assert edges.filter("id = 3").count() == 12


def test_required_canonical(spark):
    df = spark.createDataFrame([("OCC",), (None,)], "s string")
    assert {r["c"] for r in chemistry.canonicalize(df, "s", "c").collect()} == {"CCO", None}
    with pytest.raises(Exception, match="invalid molecule"):
        chemistry.canonicalize(df, "s", "c", required=True).collect()
