"""Molecules in line notation: atoms by element and rings, as a pandas UDF over whole columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

BRACKET = re.compile(r"\[\d*([A-Z][a-z]?|[a-z][a-z]?|\*)(@{0,2}|@[A-Z]{2}\d+)(H\d*)?(\++|-+|[+-]\d+)?(:\d+)?\]")
PLAIN = re.compile(r"Cl|Br|[BCNOPSFIbcnops*]")
RING = re.compile(r"%\((\d{1,5})\)|%(\d\d)|(\d)")
BONDS = "-=#$:/\\~"


def parse(notation: str | None) -> tuple[list[str], list[tuple[int, int]]] | None:
    """(elements of the atoms, bonds as pairs of their numbers), or None for null, empty or malformed notation: a bond, branch or ring mark without an atom, an open branch, ring or bracket, an unknown character."""
    text = (notation or "").strip()
    atoms: list[str] = []
    bonds: set[tuple[int, int]] = set()
    branches: list[int] = []
    rings: dict[int, int] = {}
    last, waiting, at = -1, False, 0  # the atom that the next one is bound to; whether a bond mark waits for it
    while at < len(text):
        c = text[at]
        found = BRACKET.match(text, at) if c == "[" else PLAIN.match(text, at)
        mark = RING.match(text, at) if not found else None
        if found:
            atoms.append((found[1] if c == "[" else found[0]).capitalize())
            if last >= 0:
                bonds.add((last, len(atoms) - 1))
            last, waiting, at = len(atoms) - 1, False, found.end()
        elif mark and last >= 0:
            number = int(mark[1] or mark[2] or mark[3])
            if number in rings:
                pair = (min(rings[number], last), max(rings[number], last))
                if pair[0] == pair[1] or pair in bonds:
                    return None
                bonds.add(pair)
                del rings[number]
            else:
                rings[number] = last
            waiting, at = False, mark.end()
        elif c in BONDS and last >= 0 and not waiting:
            waiting, at = True, at + 1
        elif c == "(" and last >= 0 and not waiting and at + 1 < len(text) and text[at + 1] not in "()":
            branches.append(last)
            at += 1
        elif c == ")" and branches and not waiting:
            last, at = branches.pop(), at + 1
        elif c == "." and last >= 0 and not waiting and at + 1 < len(text):
            last, at = -1, at + 1
        else:
            return None
    if not atoms or waiting or branches or rings:
        return None
    return atoms, sorted(bonds)


def parts(atoms: int, bonds: list[tuple[int, int]]) -> int:
    """How many pieces the bonds leave."""
    root = list(range(atoms))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in bonds:
        root[top(a)] = top(b)
    return sum(root[i] == i for i in range(atoms))


def heavy(atoms: list[str], bonds: list[tuple[int, int]]) -> tuple[list[str], list[tuple[int, int]]]:
    """Without the hydrogens that are bound to one other atom only, which is no hydrogen: they belong to that atom."""
    ends: dict[int, list[int]] = {}
    for a, b in bonds:
        ends.setdefault(a, []).append(b)
        ends.setdefault(b, []).append(a)
    gone = {i for i, e in enumerate(atoms) if e == "H" and len(ends.get(i, [])) == 1 and atoms[ends[i][0]] != "H"}
    number = {old: new for new, old in enumerate(i for i in range(len(atoms)) if i not in gone)}
    return [atoms[i] for i in number], [(number[a], number[b]) for a, b in bonds if a in number and b in number]


@pandas_udf(T.StructType([T.StructField("atoms", T.IntegerType()), T.StructField("elements", T.MapType(T.StringType(), T.IntegerType())), T.StructField("rings", T.IntegerType())]))
def molecule(notation: pd.Series) -> pd.DataFrame:
    """Atoms, atoms by element (hydrogens that are bound to one heavy atom aren't counted) and independent rings: bonds - atoms + pieces; nulls for malformed notation."""
    out = []
    for text in notation:
        found = parse(text)
        if found is None:
            out.append((None, None, None))
            continue
        atoms, bonds = heavy(*found)
        out.append((len(atoms), {e: atoms.count(e) for e in sorted(set(atoms))}, len(bonds) - len(atoms) + parts(len(atoms), bonds)))
    return pd.DataFrame(out, columns=["atoms", "elements", "rings"]).astype({"atoms": "Int32", "rings": "Int32"})
