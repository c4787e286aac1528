"""Merkle manifest of a table: one hash tree for each language, one over their roots, and a proof for each row.

A leaf is the SHA-256 of a row's fields, each preceded by its length. Leaves are numbered within their language
by ranges (no task sorts a language), and every aligned block of 2 ** LEVELS consecutive leaves is one group: a postorder
traversal returns each subtree's digest and, while it unwinds, appends the sibling to every leaf below. The digests
of aligned blocks are the leaves of the next distributed traversal, 2 ** LEVELS times fewer, until each tree has one; the
roots of the trees, in the order of their languages, are a last tree of the same kind. A leaf's proof is the path in
its block, then its block's path, and so on to the root. Proofs are folded again by built-in functions.

Defined results: a null field is hashed as ``-``; rows with null ids come first, and rows with one id are ordered by
their digests (equal rows are equal leaves, and get their places in any order); a null language is a tree of its
own, the first; a tree with one leaf has that leaf as its root; texts of any length are hashed whole; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.position import numbered, same
from millrace.llm.common import cut, ready, scratch

LEVELS = 10
BROADCAST_TREES = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def row_digest(fields: list[Column]) -> Column:
    """SHA-256 of fields, each as its length in bytes, a colon and its text, or ``-`` where it is null."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def climb(leaves: list[str], levels: int) -> tuple[str, list[list[str]]]:
    """(digest, paths) of a block: ``levels`` levels above its leaves, of which at most 2 ** levels are there. A path has an entry for each level: L or R and the sibling on that side, or nothing."""
    paths: list[list[str]] = [[] for _ in leaves]

    def visit(at: int, level: int) -> str:
        if not level:
            return leaves[at]
        half = 1 << (level - 1)
        left = visit(at, level - 1)
        if at + half >= len(leaves):
            for path in paths[at:]:
                path.append("")
            return digest(left)
        right = visit(at + half, level - 1)
        for path in paths[at : at + half]:
            path.append("R" + right)
        for path in paths[at + half : at + 2 * half]:
            path.append("L" + left)
        return digest(left, right)

    return visit(0, levels), paths


def forest(nodes: DataFrame, most: int, levels: int = LEVELS) -> DataFrame:
    """Rows (tree, pos, digest, path, root) of leaves (tree, pos, n, digest): ``pos`` counts from 0 to n - 1 in each tree, and no tree has more than ``most`` leaves."""

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos", kind="stable")
        top, paths = climb(rows["digest"].tolist(), min(levels, (int(rows["n"].iloc[0]) - 1).bit_length()))
        return rows[["tree", "pos", "n", "digest"]].assign(path=paths, top=top)

    size, stages = 1 << levels, []
    number = F.shiftright("pos", levels)
    while True:
        blocks = nodes.groupBy("tree", number.alias("block")).applyInPandas(block, "tree long, pos long, n long, digest string, path array<string>, top string")
        stages.append(cut(blocks, "blocks", result=True))
        if most <= size:
            break
        most = -(-most // size)
        heads = stages[-1].where(F.col("pos").bitwiseAND(size - 1) == 0)
        nodes = heads.select("tree", number.alias("pos"), F.shiftright(F.col("n") + (size - 1), levels).alias("n"), F.col("top").alias("digest"))
    above = stages[-1].select("tree", "pos", "digest", "path", F.col("top").alias("root"))
    for stage in reversed(stages[:-1]):
        up = above.select(F.col("tree").alias("_tree"), F.col("pos").alias("_block"), F.col("path").alias("_path"), "root")
        met = stage.join(up, (F.col("tree") == F.col("_tree")) & (number == F.col("_block")))
        above = met.select("tree", "pos", "digest", F.concat("path", "_path").alias("path"), "root")
    return above


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""

    def joined(at: Column, step: Column) -> Column:
        other = F.substring(step, 2, 64)
        return F.sha2(F.when(F.startswith(step, F.lit("L")), F.concat(other, at)).otherwise(F.concat(at, other)), 256)

    return F.aggregate(path, leaf, joined)


def manifest(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Rows (the leaves' columns, subroot, root, path) of leaves (doc_id, lang, leaf, ...): ``path`` leads from the leaf to the root, sibling by sibling."""
    ready(leaves.sparkSession)
    with scratch():
        rows = cut(numbered(leaves, ["lang"], ["doc_id", "leaf"], "pos", "n"), "leaves", result=True)
        langs = cut(numbered(rows.where("pos = 0").select("lang", "n"), [], ["lang"], "tree", "trees"), "trees", result=True)
        trees, most = langs.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(1))).first()
        small = F.broadcast if trees <= BROADCAST_TREES else (lambda df: df)
        known = small(langs.select("lang", "tree"))
        nodes = rows.join(known, same(rows, known, ["lang"])).select("tree", "pos", "n", F.col("leaf").alias("digest"), *(rows[c].alias(f"_{c}") for c in leaves.columns))
        nodes = cut(nodes, "nodes", result=True)
        paths = forest(nodes.select("tree", "pos", "n", "digest"), most, levels)
        roots = paths.where("pos = 0").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(trees).cast("long").alias("n"), F.col("root").alias("digest"))
        tops = cut(forest(roots, trees, levels), "tops", result=True).select(F.col("pos").alias("tree"), F.col("digest").alias("subroot"), F.col("path").alias("upper"), F.col("root").alias("top"))
    whole = nodes.drop("n", "digest").join(paths, ["tree", "pos"]).join(small(tops), "tree")
    return whole.select(*(F.col(f"_{c}").alias(c) for c in leaves.columns), "subroot", F.col("top").alias("root"), F.concat("path", "upper").alias("path"))


def is_tampered(doc_id: Column) -> Column:
    """Every seventh row by a hash of its id, never one without an id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 0, F.lit(False))


def proof_digest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Rows (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): every row's proof, folded from its leaf, or from that of a row whose n_chars has been raised by 1 where ``is_tampered``."""
    fields = [F.col(c) for c in FIELDS]
    leaf = row_digest(fields)
    raised = [f.cast("decimal(20,0)") + 1 if c == "n_chars" else f for c, f in zip(FIELDS, fields, strict=True)]
    shown = F.when(is_tampered(F.col("doc_id")), row_digest(raised)).otherwise(leaf)
    found = manifest(docs.select("doc_id", F.col("lang").cast("string").alias("lang"), leaf.alias("leaf"), shown.alias("shown")), levels)
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.substring(s, 2, 64)), ""), 256)
    rows = found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), fold(F.col("shown"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
