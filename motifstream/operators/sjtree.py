"""Materialised left-deep joins over query edges: partial matches of each tree node are kept and reused."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifstream.operators.match import edge_side, overlap
from motifstream.operators.storage import cut
from motifstream.plans.query import QueryGraph


def _extend(q: QueryGraph, left: DataFrame, leaf: DataFrame, homo: bool) -> DataFrame:
    """Partial matches joined to a leaf on the vertices they share."""
    have, ends = ([x for x in df.columns if x.startswith("u")] for df in (left, leaf))
    out = overlap(left, leaf, [k for k in ends if k in have])
    for new in (int(k[1:]) for k in ends if k not in have):
        tests = [F.col(f"u{new}") != F.col(k) for k in have if q.may_be_equal(new, int(k[1:]))]
        if tests and not homo:
            out = out.filter(reduce(lambda a, b: a & b, tests))
    return out


def partial_matches(q: QueryGraph, adj: DataFrame, order: list[tuple[int, int, int]], *, homo: bool = False, store: bool = True) -> list[DataFrame]:
    """Node i holds the matches of the first i + 1 query edges of ``order``, keyed by one or two shared vertices.

    ``store`` writes each inner node, for later appends; without it the nodes are one plan.
    """
    nodes: list[DataFrame] = []
    for u, v, c in order:
        leaf = edge_side(adj, q, u, v, c, "new")
        if nodes:
            out = _extend(q, nodes[-1], leaf, homo)
            nodes.append(cut(out, "partial") if store else out)
        else:
            nodes.append(leaf.withColumnsRenamed({"s_new": "st", "e_new": "en"}))
    return nodes


def joined_leaves(q: QueryGraph, adj: DataFrame, leaves: list[list[tuple[int, int, int]]], *, homo: bool = False) -> DataFrame:
    """(u0 .., st, en): binary joins of leaves, one after the other. A leaf's own edges meet in one vertex and are joined there."""
    out = None
    for edges in leaves:
        sides = [edge_side(adj, q, u, v, c, "new").withColumnsRenamed({"s_new": "st", "e_new": "en"}) for u, v, c in edges]
        leaf = reduce(lambda a, b: overlap(a, b.withColumnsRenamed({"st": "s_new", "en": "e_new"}), [k for k in b.columns if k in a.columns and k.startswith("u")]), sides)
        out = leaf if out is None else _extend(q, out, leaf.withColumnsRenamed({"st": "s_new", "en": "e_new"}), homo)
    return out.select(*(f"u{i}" for i in range(q.size)), "st", "en")


def append(q: QueryGraph, nodes: list[DataFrame], adj: DataFrame, added: DataFrame, order: list[tuple[int, int, int]], *, homo: bool = False) -> list[DataFrame]:
    """What edge lives ``added`` (both directions) add to each node; ``adj`` holds all lives, those of ``added`` too.

    New matches of a node are its old left side with new edges, and new left sides with any edge: nothing is built again.
    """
    new: list[DataFrame] = []
    for i, (u, v, c) in enumerate(order):
        leaf = edge_side(added, q, u, v, c, "new")
        if new:
            grown = _extend(q, nodes[i - 1], leaf, homo).unionByName(_extend(q, new[-1], edge_side(adj, q, u, v, c, "new"), homo))
            new.append(cut(grown, "partial"))
        else:
            new.append(leaf.withColumnsRenamed({"s_new": "st", "e_new": "en"}))
    return new
