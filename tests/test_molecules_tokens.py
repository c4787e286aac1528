"""Line notation of molecules, texts cut to a model's tokens, statistics of steps, copies of rejected pictures."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import molecules, tokens
from millrace.operators import evaluate
from millrace.sources import io

KNOWN = {
    "C": (1, 0), "CCO": (3, 0), "c1ccccc1": (6, 1), "c1ccc2ccccc2c1": (10, 2), "C1CC1C1CC1": (6, 2), "[Na+].[Cl-]": (2, 0), "CC(=O)Oc1ccccc1C(=O)O": (13, 1),
    "CN1C=NC2=C1C(=O)N(C(=O)N2C)C": (14, 2), "C%10CC%10": (3, 1), "C%(100)CC%(100)": (3, 1), "C12CC1C2": (4, 2), "N[C@@H](C)C(=O)O": (6, 0), "[13CH4]": (1, 0), "F/C=C/F": (4, 0),
    "C1.C1": (2, 0), "[H]O[H]": (1, 0), "[H][H]": (2, 0), "ClCBr": (3, 0), " CO ": (2, 0), "*C": (2, 0), "[Cu+2]": (1, 0), "C12C3C4C1C5C2C3C45": (8, 5), "C=1CC=1": (3, 1),
}
BAD = [None, "", "C(", "C)", "C1CC", "(C)", "C=", "=C", "1CC1", "[C", "C()", "CX", "C11", "C1C1", "C..C", ".C", "C.", "C((C))", "C==C", "c1ccccc1 x"]


def test_known_molecules(spark):
    rows = [(k,) for k in [*KNOWN, *BAD]]
    got = spark.createDataFrame(rows, "s string").select("s", molecules.molecule("s").alias("m")).select("s", "m.*").collect()
    assert {r["s"]: (r["atoms"], r["rings"]) for r in got if r["s"] in KNOWN} == KNOWN
    assert all(r["atoms"] is None and r["rings"] is None and r["elements"] is None for r in got if r["s"] not in KNOWN)
    assert next(r for r in got if r["s"] == "ClCBr")["elements"] == {"Br": 1, "C": 1, "Cl": 1}
    assert next(r for r in got if r["s"] == "c1ccccc1")["elements"] == {"C": 6}


def test_statistics_of_molecules(spark):
    rows = spark.createDataFrame([("smiles", "c1ccccc1O", "{}"), ("smiles", "C(", "{}"), ("fasta", "CC", '{"a":1}'), (None, "CC", None)], "lang string, code string, statistics string")
    got = [r["statistics"] for r in evaluate.with_molecules(rows, F.col("lang")).collect()]
    assert json.loads(got[0]) == {"node_types": {"C atoms": 6, "O atoms": 1, "rings": 1}} and got[1:] == ["{}", '{"a":1}', None]


def test_first_model_tokens_equal_the_whole_text_cut(spark):
    public = pytest.importorskip("public_tokenizers")
    path = str(public.path("byte_bpe_50k.json"))
    tokenizer = tokens._tokenizer(path)
    texts = ["", "one", "  blanks   between  words \n\n and lines " * 400, "x" * 5000, "don't we'll  é 漢字 " * 300, "a" + " " * 3000 + "b", "1234567 " * 900, " \t\n" * 700, None, "🙂🙃" * 600]
    got = [r["t"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(tokens.first_model_tokens(F.col("t"), 40, path).alias("t")).collect()]
    for text, cut in zip(texts, got, strict=True):
        want = None if text is None else tokenizer.decode(tokenizer.encode(text, add_special_tokens=False).ids[:40], skip_special_tokens=False)
        assert cut == want


def test_pictures_are_copied_once_by_group(spark, tmp_path):
    folder, out = tmp_path / "img", tmp_path / "rejected"
    for name, data in (("x/a.png", b"1"), ("y/a.png", b"22" * 1_000_000), ("b.png", b"333"), ("empty.png", b"")):
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(data)
    rows = spark.createDataFrame([("x/a.png", "ratio"), ("x/a.png", "ratio"), ("y/a.png", "colour"), ("x/a.png", "colour"), (f"{folder}/b.png", "ratio"), ("empty.png", "ratio"), ("none.png", "ratio"), (None, "ratio")], "p string, reason string")
    for _ in range(2):
        done = io.copy_pictures(rows, "p", "reason", str(folder), str(out))
        assert done.count() == 4
    found = {str(f.relative_to(out)): f.read_bytes() for f in out.rglob("*") if f.is_file() and not f.name.startswith(".")}
    assert found == {"ratio/x/a.png": b"1", "colour/y/a.png": b"22" * 1_000_000, "colour/x/a.png": b"1", "ratio/b.png": b"333"}
