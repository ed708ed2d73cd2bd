"""Molecule functions over tables: each distinct text is read once, in Arrow batches, and joined back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import smiles

#: Scaffold templates and substituent fragments of the candidate library.
TEMPLATES = {
    "coumarin_7_substituted": "O=c1oc2ccc({sub})cc2cc1",
    "coumarin_6_substituted": "O=c1oc2cc({sub})ccc2cc1",
    "coumarin_4_methyl_7_substituted": "Cc1cc(=O)oc2ccc({sub})cc12",
    "naphthalimide_4_substituted": "O=C1N(C)C(=O)c2ccc({sub})cc21",
    "naphthalimide_4_substituted_n_butyl": "CCCCN1C(=O)c2ccc({sub})cc2C1=O",
}
SUBSTITUENTS = {
    "H": "[H]", "methyl": "C", "ethyl": "CC", "methoxy": "OC", "ethoxy": "OCC", "dimethylamino": "N(C)C", "diethylamino": "N(CC)CC",
    "cyano": "C#N", "fluoro": "F", "chloro": "Cl", "trifluoromethyl": "C(F)(F)F", "phenyl": "c1ccccc1",
}
#: Solvent names and their molecules.
SOLVENT_ALIASES = {
    "1,2-propanediol": "CC(O)CO", "1-butanol": "CCCCO", "1-decanol": "CCCCCCCCCCO", "1-hexanol": "CCCCCCO", "1-methyl-2-pyrrolidinone": "CN1CCCC1=O", "1-octanol": "CCCCCCCCO",
    "1-propanol": "CCCO", "2-methyl-2-propanol": "CC(C)(C)O", "2-methylbutane": "CCC(C)C", "2-pentanone": "CCCC(C)=O", "2-propanol": "CC(C)O", "acetone": "CC(C)=O",
    "benzene": "c1ccccc1", "bromobenzene": "Brc1ccccc1", "butyl acetate": "CCCCOC(C)=O", "ccl4": "ClC(Cl)(Cl)Cl", "ch2cl2": "ClCCl", "chcl3": "ClC(Cl)Cl",
    "chlorobenzene": "Clc1ccccc1", "cyclohexane": "C1CCCCC1", "di-n-butyl ether": "CCCCOCCCC", "diethyl ether": "CCOCC", "diisopropyl ether": "CC(C)OC(C)C", "dioxane": "C1COCCO1",
    "dma": "CN(C)C(C)=O", "dmf": "CN(C)C=O", "dmso": "CS(C)=O", "ethyl acetate": "CCOC(C)=O", "ethylene glycol": "OCCO", "etoh": "CCO", "formamide": "NC=O", "glycerol": "OCC(O)CO",
    "h2o": "O", "heptane": "CCCCCCC", "hexane": "CCCCCC", "me-thf": "CC1CCCO1", "mecn": "CC#N", "meoh": "CO", "methyl acetate": "COC(C)=O", "methyl formate": "COC=O",
    "methylcyclohexane": "CC1CCCCC1", "n-methylformamide": "CNC=O", "o-dimethoxybenzene": "COc1ccccc1OC", "pyridine": "c1ccncc1", "tert-pentanol": "CCC(C)(C)O", "tfe": "OCC(F)(F)F",
    "thf": "C1CCOC1", "toluene": "Cc1ccccc1", "triethylamine": "CCN(CC)CC",
}


def text_udf(f: Callable[[str | None], object], returns: str):  # noqa: ANN201
    """An Arrow function of one text column that reads equal texts of a batch once."""

    @F.pandas_udf(returns)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            known = {x: f(x) for x in s.dropna().unique()}
            yield s.map(lambda x: known.get(x) if x is not None else None).astype(object)

    return run


canonical_udf = lambda: text_udf(smiles.canonical, "string")
bits_udf = lambda: text_udf(smiles.morgan_bits, "array<int>")


def on_distinct(df: DataFrame, column: str, udf: Callable[[Column], Column], out: str) -> DataFrame:
    """Apply an expensive function once a distinct value, and join the results back (Spark doesn't do so for Python functions)."""
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    found = values.select(F.col(column).alias("_in"), udf(F.col(column)).alias(out))
    return df.join(found, df[column] == F.col("_in"), "left").drop("_in")


def canonicalize(df: DataFrame, column: str, out: str, required: bool = False) -> DataFrame:
    """Add the canonical form; with ``required`` an invalid text is an error."""
    done = on_distinct(df, column, canonical_udf(), out)
    if required:
        done = done.withColumn(out, F.when(F.col(out).isNotNull(), F.col(out)).otherwise(F.raise_error(F.concat(F.lit("invalid molecule: "), F.coalesce(column, F.lit("null")))).cast("string")))
    return done


def enumerate_library(templates: dict[str, str] = TEMPLATES, substituents: dict[str, str] = SUBSTITUENTS) -> list[tuple[str, str, str]]:
    """All templates with all substituents, the invalid dropped and equal molecules once."""
    seen: dict[str, tuple[str, str, str]] = {}
    for name, template in templates.items():
        for sub, fragment in substituents.items():
            if c := smiles.canonical(template.replace("{sub}", fragment)):
                seen.setdefault(c, (name, sub, c))
    return sorted(seen.values())


def describe(df: DataFrame, column: str) -> DataFrame:
    """Add canonical form, number of fingerprint bits, scaffold and descriptors."""
    d = text_udf(lambda s: {k: float(v) for k, v in (smiles.descriptors(s) or {}).items()} or None, "map<string,double>")
    out = canonicalize(df, column, "canonical")
    out = on_distinct(out, "canonical", bits_udf(), "bits")
    out = on_distinct(out, "canonical", text_udf(smiles.scaffold, "string"), "murcko")
    out = on_distinct(out, "canonical", d, "d")
    keys = ("molecular_weight", "heavy_atom_count", "ring_count", "num_hbond_donors", "num_hbond_acceptors", "num_rotatable_bonds", "fraction_csp3", "formal_charge")
    return out.select(*df.columns, "canonical", F.size("bits").alias("n_bits"), "murcko", *[F.element_at("d", k).alias(k) for k in keys])


def graph_tables(df: DataFrame, column: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of molecules, keyed by molecule and place; invalid ones have no rows."""
    @F.pandas_udf("struct<num_nodes:int,x:array<array<float>>,src:array<int>,dst:array<int>,edge_attr:array<array<float>>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = [smiles.graph(x) or {"num_nodes": 0, "x": [], "src": [], "dst": [], "edge_attr": []} for x in s]
            yield pd.DataFrame(rows, columns=["num_nodes", "x", "src", "dst", "edge_attr"])

    done = df.select(key, run(F.col(column)).alias("g"))
    nodes = done.select(key, F.posexplode("g.x").alias("node", "x"))
    edges = done.select(key, F.inline(F.arrays_zip("g.src", "g.dst", "g.edge_attr"))).toDF(key, "src", "dst", "edge_attr")
    return nodes, edges
