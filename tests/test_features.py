"""Descriptors, feature matrices and solvent tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lumiquery.functions import descriptors
from lumiquery.operators import features, solvents


@pytest.mark.parametrize(
    ("text", "area", "rings", "aromatic", "nhoh", "no"),
    [("CCO", 20.23, 0, 0, 1, 1), ("c1ccccc1", 0.0, 1, 1, 0, 0), ("CC(=O)N", 43.09, 0, 0, 2, 2), ("c1ccncc1", 12.89, 1, 1, 0, 1), ("O=c1oc2ccc(N)cc2cc1", 56.23, 2, 2, 2, 3), ("C1CCC2CCCCC2C1", 0.0, 2, 0, 0, 0), ("C1CO1", 12.53, 1, 0, 0, 1)],
)
def test_descriptors(text, area, rings, aromatic, nhoh, no):
    d = descriptors.molecule_descriptors(text)
    assert tuple(d) == descriptors.MOLECULE
    assert d["TPSA"] == pytest.approx(area, abs=0.01)
    assert (d["RingCount"], d["NumAromaticRings"], d["NumAliphaticRings"], d["NHOHCount"], d["NOCount"]) == (rings, aromatic, rings - aromatic, nhoh, no)
    assert d["MolLogP"] is None and d["MolMR"] is None


def test_indices():
    # chains of three and four carbons, and a ring of six, by hand from the definitions
    assert descriptors.molecule_descriptors("CCC")["BalabanJ"] == pytest.approx(2 * 2 / 6**0.5, abs=1e-5)
    assert descriptors.molecule_descriptors("C1CCCCC1")["BalabanJ"] == pytest.approx(6 / 2 * 6 / 9, abs=1e-5)
    assert descriptors.molecule_descriptors("CC(C)(C)C")["BertzCT"] < descriptors.molecule_descriptors("CC(O)C(N)CF")["BertzCT"]
    assert descriptors.molecule_descriptors("OCC(C)N") == descriptors.molecule_descriptors("NC(C)CO")


def test_solvents_and_legacy():
    water, acid = descriptors.solvent_descriptors("O"), descriptors.solvent_descriptors("CC(=O)[O-]")
    assert water["exact_molecular_weight"] == pytest.approx(18.010565, abs=1e-5) and water["num_valence_electrons"] == 8
    assert acid["formal_charge"] == -1 and acid["num_valence_electrons"] == 24 and acid["tpsa"] == pytest.approx(40.13)
    assert descriptors.solvent_descriptors("film") is None and descriptors.legacy_properties("nonsense(") == [0.0] * 6
    assert descriptors.legacy_properties("CCO")[0] == pytest.approx(46.069, abs=1e-3)


def test_matrix_is_aligned_with_training(spark):
    train = spark.createDataFrame([("CCO", "water", 1.0, None), ("CCN", "thf ", 3.0, None), ("c1ccccc1", "water", None, float("inf"))], "smiles string, solvent string, a double, b double")
    spec = features.fit(train, ["a", "b"], ["solvent"], n_bits=64)
    assert spec.medians == {"a": 2.0, "b": 0.0} and spec.vocabularies == {"solvent": ["thf", "water"]}
    assert features.FeatureSpec.from_json(spec.to_json()) == spec
    new = spark.createDataFrame([("CCO", "dmso", 7.0, 1), ("not a molecule", "water", 1.0, 1)], "smiles string, solvent string, a double, other int")
    rows = features.matrix(new, spec, "smiles").collect()
    assert len(rows) == 1
    v = rows[0]["features"].toArray()
    assert len(v) == len(spec.names) == 64 + 2 + 2
    assert list(v[64:]) == [7.0, 0.0, 0.0, 0.0] and v[:64].sum() > 0
    same = features.matrix(train, spec, "smiles").filter("smiles = 'CCO'").first()["features"].toArray()
    assert (same[:64] == v[:64]).all() and list(same[64:]) == [1.0, 0.0, 0.0, 1.0]
    aligned, added, dropped = features.align(new, ["a", "b"])
    assert aligned.columns == ["a", "b"] and (added, dropped) == (1, 3)


def test_missing_specification_is_inferred(spark):
    dim = spark.createDataFrame([("water", 80.1, "x", None), ("thf", 7.5, "y", None)], "solvent string, dielectric double, note string, empty double")
    assert features.numeric_columns(dim) == ["dielectric"]
    spec = features.infer_spec(129, dim)
    assert (spec.n_bits, spec.descriptor_columns, spec.medians) == (128, ["dielectric"], {"dielectric": 43.8})
    assert features.infer_spec(0, dim).descriptor_columns == []


def test_solvent_table(spark, tmp_path):
    m = spark.createDataFrame([("CCO",), ("CCO",), (" OCC",), ("gas",), ("  ",), (None,), ("O",), ("nope(",)], "s string")
    existing = spark.createDataFrame([("Gas", 1.0), ("C(O)C", 24.6), ("cco", None)], "solvent string, dielectric_constant double")
    rows = {r["solvent_original"]: r for r in solvents.build_table(m, "s", existing).collect()}
    assert list(rows)[0] == "CCO" and set(rows) == {"CCO", "OCC", "gas", "O", "nope("}
    assert rows["gas"]["is_environment_label"] and not rows["gas"]["is_valid"] and rows["gas"]["existing_match"] == "label"
    assert (rows["CCO"]["existing_match"], rows["CCO"]["dielectric_constant"]) == ("label", None)
    assert (rows["OCC"]["existing_match"], rows["OCC"]["dielectric_constant"]) == ("canonical", 24.6)
    assert rows["O"]["existing_match"] == "none" and rows["O"]["tpsa"] is not None and rows["nope("]["tpsa"] is None
    solvents.write_template(spark, m, "s", str(tmp_path / "t"))
    t = spark.read.option("header", True).csv(str(tmp_path / "t"))
    assert t.columns == ["solvent", *solvents.PHYSICAL] and t.count() == 5


def test_solvent_joins(spark):
    dim = spark.createDataFrame([("water ", 80.1, 1), ("water", 1.0, 2), ("thf", None, 3)], "solvent string, e double, k int")
    rows = spark.createDataFrame([("water",), ("thf",), ("x",), ("x",)], "solvent string")
    joined, lacks = solvents.train_join(rows, dim, "solvent", ["e"], [F.col("k")])
    assert sorted((r["solvent"], r["e"]) for r in joined.filter("e IS NOT NULL").collect()) == [("water", 80.1)]
    assert {(r["solvent"], r["n_rows"]) for r in lacks.collect()} == {("thf", 1), ("x", 2)}
    got = {(r["solvent"], r["solvent_known"], r["values_imputed"], r["e"]) for r in solvents.inference_join(rows, dim, "solvent", ["e"], {"e": 5.0}, [F.col("k")]).collect()}
    assert got == {("water", True, 0, 80.1), ("thf", True, 1, 5.0), ("x", False, 1, 5.0)}
