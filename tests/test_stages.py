"""The stages over small files, with a stub for the model; images by their functions."""

import json
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.__main__ import main
from millrace.functions import image
from millrace.plans import stages
from millrace.sources import io


def lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def read(spark, path):
    return spark.read.json(str(path)).collect()


def sample(i, **more):
    base = {"input": {"id": str(i), "id_compl": str(i // 3), "category_key": "tree", "lang_key": "newick", "lang_name": "Newick", "category_name": "trees", "complexity": ["low", "medium", "high"][i % 3]}, "code": f"(a,b{i});", "problem": "p", "description": "two words", "answer": "x", "path_img_1": f"{i}.png", "size": {"width": 10, "height": 10}, "statistics": '{"node_types": {"nodes": 5}}'}
    return base | more


def test_generate_then_filter_personas(spark, tmp_path):
    src = lines(tmp_path / "t.jsonl", [{"id": "1", "text": "a b c"}, {"id": "2", "text": " "}, {"id": "3", "text": None}])
    stages.run("personas generate", spark, {"input": src, "output": str(tmp_path / "o")}, {"complete": lambda ps: ["hm</think> a writer" for _ in ps]})
    assert [(r["id"], r["persona"]) for r in read(spark, tmp_path / "o")] == [("1", "a writer")]
    with pytest.raises(ValueError):
        stages.run("personas generate", spark, {"input": src, "output": str(tmp_path / "p")})
    with pytest.raises(KeyError):
        stages.run("nothing", spark, {})


def test_quality_filter(spark, tmp_path):
    rows = [sample(i, code="(a, b);") for i in range(5)] + [sample(9, code=" "), sample(10, size={"width": 1, "height": 0}), sample(11, statistics="{}")]
    rows.append(sample(12) | {"input": sample(12)["input"] | {"lang_key": "other"}})
    limits = lines(tmp_path / "l.jsonl", [{"category_key": "tree", "lang_key": "newick", "max_node": "sum", "max_thresh": 9.0}])
    paths = {"input": lines(tmp_path / "i.jsonl", rows), "limits": limits, **{k: str(tmp_path / k) for k in ("output", "removed", "statistics", "steps")}}
    stages.run("dataset filter", spark, paths)
    left = {r["step"]: r["n"] for r in read(spark, tmp_path / "steps") if r["key"] == "total"}
    assert left == {"input": 9, "allow": 8, "blank": 7, "stats": 6, "ratio": 5, "copy": 3, "image": 3, "colour": 3, "copy_image": 3}
    assert {(r["value"], r["n"]) for r in read(spark, tmp_path / "steps") if r["key"] == "cat_lang" and r["step"] == "input"} == {("tree_newick", 8), ("tree_other", 1)}
    assert sorted(r["input"]["id"] for r in read(spark, tmp_path / "output")) == ["0", "1", "2"]
    assert sorted((r["input"]["id"], r["reason"]) for r in read(spark, tmp_path / "removed")) == [("10", "ratio"), ("11", "stats"), ("12", "allow"), ("3", "copy"), ("4", "copy"), ("9", "blank")]


def test_score_routes(spark, tmp_path):
    src = lines(tmp_path / "i.jsonl", [sample(i) for i in range(3)])
    stages.run("dataset score", spark, {"input": src, "output": str(tmp_path / "o")}, {"complete": lambda ps: [f"correct: {'True' if 'b0' in p else 'null'} explanation: e" for p in ps]})
    assert sorted((r["input"]["id"], r["route"]) for r in read(spark, tmp_path / "o")) == [("0", "true"), ("1", "null"), ("2", "null")]


def test_split_assemble_and_format(spark, tmp_path):
    src = lines(tmp_path / "i.jsonl", [sample(i) for i in range(7)])
    stages.run("dataset split", spark, {"qa": src, "output": str(tmp_path / "s")}, {"qa_sizes": (3, 2, 1)})
    assert sorted(r["bucket"] for r in read(spark, tmp_path / "s" / "qa")) == [1, 1, 1, 2, 2, 3, 4]
    train = lines(tmp_path / "t.jsonl", [{"id": str(i), "type": "qa" if i < 3 else "code", "user": "u", "assistant": "a", "code": "c"} for i in range(8)])
    stages.run("dataset assemble", spark, {"input": [train], "output": str(tmp_path / "a")})
    halves = [[r["type"] for r in read(spark, tmp_path / "a" / f"half_{n}")] for n in (1, 2)]
    assert [sorted(h) for h in halves] == [["code", "code", "qa"], ["code", "code", "code", "qa", "qa"]]
    stages.run("train format", spark, {"input": train, "output": str(tmp_path / "f")})
    assert all([m["role"] for m in r["messages"]] == ["system", "user", "assistant"] for r in read(spark, tmp_path / "f"))


def png(path, pixels):
    raw = b"".join(b"\0" + bytes(row) for row in pixels)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(pixels[0]), len(pixels), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_quality_filter_reads_images(spark, tmp_path):
    (tmp_path / "img").mkdir()
    rng = np.random.default_rng(1)
    same = np.kron(rng.integers(0, 256, (8, 8)), np.ones((8, 8), int)).tolist()
    for i in range(6):
        png(tmp_path / "img" / f"{i}.png", same if i < 4 else [[255] * 64] * 64 if i == 4 else np.kron(rng.integers(0, 256, (8, 8)), np.ones((8, 8), int)).tolist())
    (tmp_path / "img" / "6.png").write_bytes(b"no picture")
    rows = [sample(i, code=f"(a{i}, b);") for i in range(8)]  # there is no file for the last one
    limits = lines(tmp_path / "l.jsonl", [{"category_key": "tree", "lang_key": "newick"}])
    paths = {"input": lines(tmp_path / "i.jsonl", rows), "limits": limits, "images": str(tmp_path / "img"), **{k: str(tmp_path / k) for k in ("output", "removed", "statistics", "rejected")}}
    stages.run("dataset filter", spark, paths)
    assert sorted(str(f.relative_to(tmp_path / "rejected")) for f in (tmp_path / "rejected").rglob("*.png")) == ["colour/4.png", "copy_image/3.png", "image/6.png"]
    assert sorted(r["input"]["id"] for r in read(spark, tmp_path / "output")) == ["0", "1", "2", "5"]
    assert sorted((r["input"]["id"], r["reason"]) for r in read(spark, tmp_path / "removed")) == [("3", "copy_image"), ("4", "colour"), ("6", "image"), ("7", "image")]
    seen = {r["path"].rpartition("/")[2]: r for r in image.examined(io.read_pictures(spark, str(tmp_path / "img"))).collect()}
    assert (seen["0.png"]["width"], seen["0.png"]["height"], seen["4.png"]["colour"], seen["6.png"]["image_hash"]) == (64, 64, "white", None)
    assert seen["0.png"]["image_hash"] == seen["3.png"]["image_hash"] != seen["5.png"]["image_hash"]


def test_assemble_builds_questions(spark, tmp_path):
    keys = ["tree", "circuit", "music"]
    langs = {"tree": "newick", "circuit": "spice", "music": "abc"}

    def row(i):
        k = keys[i % 3]
        base = sample(i)["input"] | {"category_key": k, "lang_key": langs[k], "category_name": k + "s", "persona": {"id": str(i), "persona": f"person {i}"}, "domain": "art" if i % 5 == 0 else None}
        return sample(i, problem=f"p{i}", description=f"d{i}" if i % 4 else None, caption=f"c{i}", llm_user="u", llm_assistant="a") | {"id": str(i), "input": base, "statistics": '{"node_types": {"nodes": 5, "start_events": 2}}' if i % 6 else "{}"}

    rows = [row(i) for i in range(60)]
    benchmark = {"contrary_personas": keys, "contrary_categories": keys, "exclude_domains": []}
    cats = {k: {"name": k, "benchmark": benchmark | {"contrary_personas": [x for x in keys + ["chess", "kg"] if x != k], "contrary_categories": [x for x in keys if x != k]}} for k in keys}
    (tmp_path / "cats.json").write_text(json.dumps(cats))
    src = lines(tmp_path / "i.jsonl", rows)
    roles = ["qa_problem", "ps_description", "ps_caption", "llm_qa", "structural", "code_translate", "consistency"]
    stages.run("dataset assemble", spark, {"categories": str(tmp_path / "cats.json"), "output": str(tmp_path / "a"), **dict.fromkeys(roles, src)})
    out = read(spark, tmp_path / "a" / "all")
    count = Counter(r["type"] for r in out)
    assert count == {"qa_problem": 60, "description": 60, "captioning": 60, "qa_detail": 60, "structural": 50, "code": 30, "consistency": count["consistency"]}
    assert 40 < count["consistency"] <= 60 and len(read(spark, tmp_path / "a" / "no_structural")) == 10
    halves = [Counter(r["type"] for r in read(spark, tmp_path / "a" / f"half_{n}")) for n in (1, 2)]
    assert halves[0] + halves[1] == count and halves[0]["code"] == 15
    yes = [r for r in out if r["type"] == "consistency" and r["assistant"].startswith("Yes")]
    assert yes and all(r["difficulty"] == "low" and (f"p{r['id']}\n" in r["user"] or f"d{r['id']}\n" in r["user"]) for r in yes)
    assert {r["difficulty"] for r in out if r["type"] == "consistency"} == {"low", "high"}
    assert all("nodes" in r["user"] and r["assistant"].startswith("5") for r in out if r["type"] == "structural")
    assert all(r["assistant"].endswith(f"\n```\n(a,b{r['id']});\n```") for r in out if r["type"] == "code")


def test_assemble_builds_associations(spark, tmp_path):
    langs = ["newick", "spice", "abc", "fen", "dbml", "qasm"]
    rows = [{"id": str(i), "input": {"category_key": f"k{i % 6}", "category_name": f"k{i % 6}s", "lang_key": langs[i % 6], "complexity": "low", "persona": {"persona": f"person {i}"}, "domain": "art" if i % 2 else None}, "caption": f"caption {i}"} for i in range(120)]
    cats = {f"k{i}": {"name": "n", "benchmark": {c: [f"k{j}" for j in range(6) if j != i] for c in ("contrary_personas", "contrary_categories")} | {"exclude_domains": ["art"] if i < 2 else []}} for i in range(6)}
    (tmp_path / "cats.json").write_text(json.dumps(cats))
    src = lines(tmp_path / "i.jsonl", rows)
    stages.run("dataset assemble", spark, {"categories": str(tmp_path / "cats.json"), "output": str(tmp_path / "a"), "association_persona": src, "association_caption": src})
    out = [r for r in read(spark, tmp_path / "a" / "all")]
    captions, personas = ([r for r in out if word in r["user"]] for word in ("caption ", "person "))
    assert {r["difficulty"] for r in captions} == {"low", "medium", "high"} and {r["difficulty"] for r in personas} == {"low"}
    home = lambda line: int(line.split()[-1]) % 6
    for r in out:
        shown = [x for x in r["user"].splitlines() if x[:1] == "("]
        kinds = [home(x) for x in shown]
        own = int(r["id"]) % 6
        right = [x[1] for x in shown if int(x.split()[-1]) == int(r["id"])]
        assert len(set(kinds)) == 4 - (r["difficulty"] == "medium") and r["assistant"].split("\n")[0] == (right[0] if right else "None")
        assert (own in kinds) == (bool(right) or r["difficulty"] == "high")
        if "person " in r["user"] and int(r["id"]) % 2:
            assert not {0, 1} & {k for k, x in zip(kinds, shown) if x[1] not in right}


def test_documents_files_and_options(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, None)], "a int, b string")
    io.write_document(df, str(tmp_path / "d.json"))
    text = (tmp_path / "d.json").read_text(encoding="utf-8")
    assert json.loads(text) == [{"a": 1, "b": "é"}, {"a": 2, "b": None}] and '\n        "b": "é"' in text
    assert sorted(map(tuple, io.read_document(spark, str(tmp_path / "d.json"), "a int, b string").collect())) == [(1, "é"), (2, None)]
    io.write_bytes(spark, b"\x00\xff", str(tmp_path / "x.bin"))
    assert (tmp_path / "x.bin").read_bytes() == b"\x00\xff"
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.py").write_text("x\n\n  \ny = 1\n")
    asked = spark.createDataFrame([("/else/a.py",), ("b.py",), (None,)], "path string")
    assert sorted((r["path"] or "", r["lines"], r["characters"]) for r in io.measure_files(spark, asked, str(tmp_path / "f")).collect()) == [("", 0, 0), ("/else/a.py", 2, 11), ("b.py", 0, 0)]
    for place, body in (("x", "1\n2\n3"), ("y", "1")):
        (tmp_path / "f" / place).mkdir()
        (tmp_path / "f" / place / "code.txt").write_text(body)
    asked = spark.createDataFrame([("x/code.txt",), (str(tmp_path / "f" / "y" / "code.txt"),), ("file://" + str(tmp_path / "f" / "x" / "code.txt"),), ("/else/code.txt",)], "path string")
    got = {r["path"]: r["lines"] for r in io.measure_files(spark, asked, str(tmp_path / "f")).collect()}
    assert sorted((p.replace(str(tmp_path), ""), n) for p, n in got.items()) == [("/else/code.txt", 0), ("/f/y/code.txt", 1), ("file:///f/x/code.txt", 3), ("x/code.txt", 3)]
    (tmp_path / "o.json").write_text('{"cut": 3}')
    assert io.read_config(spark, str(tmp_path / "o.json")) == {"cut": 3}
    (tmp_path / "o.yaml").write_text("cut: 3\n")
    try:
        import yaml  # noqa: F401
    except ImportError:
        with pytest.raises(ValueError):
            io.read_config(spark, str(tmp_path / "o.yaml"))
    else:
        assert io.read_config(spark, str(tmp_path / "o.yaml")) == {"cut": 3}


def test_repeated_ids_go_through_the_model_once_each(spark, tmp_path):
    src = lines(tmp_path / "t.jsonl", [{"id": "1", "text": "a"}, {"id": "1", "text": "b"}, {"id": None, "text": "c"}])
    stages.run("personas generate", spark, {"input": src, "output": str(tmp_path / "o")}, {"complete": lambda ps: [p[-1] for p in ps]})
    assert sorted(r["persona"] for r in read(spark, tmp_path / "o")) == ["a", "b", "c"]


def test_evaluation(spark, tmp_path):
    stages.run("eval codegen", spark, {"input": lines(tmp_path / "i.jsonl", [sample(i) for i in range(6)]), "output": str(tmp_path / "o")})
    assert spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "o" / "overall")).first()["n"] == "6"
    answers = [{"type": "qa", "category_key": "c", "difficulty": "low", "answer": "A", "generation": "Answer: A) x", "stop": "stop"}, {"type": "qa", "category_key": "c", "difficulty": "low", "answer": "B", "generation": "Answer: A", "stop": "length"}]
    stages.run("eval testset", spark, {"input": lines(tmp_path / "a.jsonl", answers), "output": str(tmp_path / "e")})
    total = next(r for r in read(spark, tmp_path / "e") if r["key"] == "total")
    assert (total["n"], total["right"], total["share"], total["not_stop"]) == (2, 1, 0.5, 1)


def test_personas_dedup_and_assignment(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(40))
    src = lines(tmp_path / "p.jsonl", [{"id": "a", "persona": text}, {"id": "b", "persona": text}, {"id": "c", "persona": "other"}, {"id": "d", "persona": None}])
    stages.run("personas dedup", spark, {"input": src, "output": str(tmp_path / "k"), "removed": str(tmp_path / "r")})
    assert len(read(spark, tmp_path / "k")) == 3 and len(read(spark, tmp_path / "r")) == 1
    emb = lines(tmp_path / "e.jsonl", [{"id": str(i), "persona": f"p{i}", "embedding": [1.0, i / 10]} for i in range(6)])
    q = lines(tmp_path / "q.jsonl", [{"topic": "t", "query": "x", "pos": 0, "embedding": [1.0, 0.0]}])
    stages.run("personas filter", spark, {"input": emb, "queries": q, "output": str(tmp_path / "f"), "minor": str(tmp_path / "m")}, {"cut": 2})
    assert sorted((r["idx"], r["id"]) for r in read(spark, tmp_path / "f")) == [(1, "0"), (2, "1")]
    assert len(read(spark, tmp_path / "m")) == 4


def test_personas_with_repeated_ids(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(40))
    src = lines(tmp_path / "p.jsonl", [{"id": i, "persona": p} for i, p in (("z", text), ("a", "one"), ("a", "two"), ("b", text), ("a", "two"))])
    stages.run("personas dedup", spark, {"input": src, "output": str(tmp_path / "k"), "removed": str(tmp_path / "r")})
    assert sorted((r["id"], r["persona"][:3]) for r in read(spark, tmp_path / "k")) == [("a", "one"), ("a", "two"), ("z", "w0 ")]
    assert sorted((r["id"], r["persona"][:3]) for r in read(spark, tmp_path / "r")) == [("a", "two"), ("b", "w0 ")]
    emb = lines(tmp_path / "e.jsonl", [{"id": i, "persona": i, "embedding": [1.0, n / 10, 0.5]} for n, i in enumerate("aabcde")])
    stages.run("personas cluster", spark, {"input": emb, "output": str(tmp_path / "c")})
    assert sorted(r["id"] for r in read(spark, tmp_path / "c")) == list("aabcde")


def test_command_line_help(capsys):
    assert main([]) == 0
    assert "dataset filter" in capsys.readouterr().out
    assert main(["dataset", "filter"]) == 0
    assert main(["no", "such", "x=y"]) == 2


def test_images(spark):
    rng = np.random.default_rng(0)
    a = np.kron(rng.integers(0, 255, (8, 8)), np.ones((8, 8), int))
    b = np.clip(a + rng.integers(-2, 3, a.shape), 0, 255)
    rows = [(a.ravel().tolist(), 64, b.ravel().tolist(), 64), (None, 64, [1], 1), ([], 0, [], 0)]
    df = spark.createDataFrame(rows, "a array<int>, aw int, b array<int>, bw int")
    out = df.select(image.perceptual_hash("a", "aw").alias("x"), image.perceptual_hash("b", "bw").alias("y"), image.similar("a", "aw", "b", "bw").alias("s")).collect()
    assert (int(out[0]["x"], 16) ^ int(out[0]["y"], 16)).bit_count() <= 4 and out[0]["s"]
    assert out[1]["x"] is None and out[2]["x"] is None and out[1]["s"] is None
    assert df.select(F.lit(1)).count() == 3
