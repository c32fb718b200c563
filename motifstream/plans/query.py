"""Query graphs: small, connected, vertex- and edge-labelled; they live on the driver."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass


@dataclass(frozen=True)
class QueryGraph:
    """``labels[u]`` is the label of query vertex u, several labels as a tuple, or None for any.

    ``edges`` are (u, v, edge label); they have no direction, and there is at most one for each pair.
    """

    labels: tuple
    edges: tuple[tuple[int, int, int], ...]

    def __post_init__(self):
        seen = set()
        for u, v, _ in self.edges:
            if u == v or not {u, v} <= set(range(len(self.labels))):
                raise ValueError(f"edge {u}-{v} is a loop or leaves the graph")
            if frozenset((u, v)) in seen:
                raise ValueError(f"edge {u}-{v} is given twice")
            seen.add(frozenset((u, v)))
        if len(self.labels) < 2 or not self.connected():
            raise ValueError("a query graph has two vertices or more and is connected")

    @classmethod
    def of(cls, labels: Iterable, edges: Iterable) -> QueryGraph:
        return cls(tuple(labels), tuple((u, v, *rest, *([] if rest else [0])) for u, v, *rest in edges))

    @classmethod
    def parse(cls, text: str, edge_labels: bool = True) -> QueryGraph:
        """Read ``v id label`` and ``e a b label`` lines; other lines are skipped, and a label of -1 means 0."""
        vertices, edges = {}, []
        for line in text.splitlines():
            x = line.split()
            if x[:1] == ["v"]:
                vertices[int(x[1])] = max(0, int(x[2]))
            elif x[:1] == ["e"]:
                edges.append((int(x[1]), int(x[2]), int(x[3]) if edge_labels and len(x) > 3 else 0))
        names = {v: i for i, v in enumerate(sorted(vertices))}
        return cls.of([vertices[v] for v in sorted(vertices)], [(names[a], names[b], c) for a, b, c in edges])

    def to_text(self) -> str:
        return "".join(f"v {i} {x}\n" for i, x in enumerate(self.labels)) + "".join(f"e {a} {b} {c}\n" for a, b, c in self.edges)

    @property
    def size(self) -> int:
        return len(self.labels)

    def neighbours(self, u: int) -> dict[int, int]:
        """Neighbour -> edge label, by id."""
        return dict(sorted([(b, c) for a, b, c in self.edges if a == u] + [(a, c) for a, b, c in self.edges if b == u]))

    def degree(self, u: int) -> int:
        return len(self.neighbours(u))

    def label_set(self, u: int) -> frozenset | None:
        x = self.labels[u]
        return None if x is None else frozenset(x) if isinstance(x, (tuple, frozenset)) else frozenset([x])

    def may_be_equal(self, u: int, v: int) -> bool:
        """Whether u and v could be mapped to one data vertex: their labels meet, and no edge joins them."""
        a, b = self.label_set(u), self.label_set(v)
        return v not in self.neighbours(u) and (a is None or b is None or bool(a & b))

    def connected(self) -> bool:
        reach, todo = {0}, [0]
        while todo:
            for v in self.neighbours(todo.pop()):
                if v not in reach:
                    reach.add(v)
                    todo.append(v)
        return len(reach) == len(self.labels)

    def is_tree(self) -> bool:
        return len(self.edges) == self.size - 1

    def triples(self) -> set[tuple[int, int, int]]:
        """Label triples (smaller label, larger label, edge label); needs given labels."""
        out = set()
        for u, v, c in self.edges:
            if self.label_set(u) is None or self.label_set(v) is None:
                raise ValueError("label triples need labelled vertices")
            out |= {(min(a, b), max(a, b), c) for a in self.label_set(u) for b in self.label_set(v)}
        return out

    def kind(self) -> str:
        """tree, sparse (average degree under 3) or dense."""
        return "tree" if self.is_tree() else "sparse" if 2 * len(self.edges) < 3 * self.size else "dense"

    def diameter(self) -> int:
        far = 0
        for start in range(self.size):
            depth, todo = {start: 0}, [start]
            for u in todo:
                for v in self.neighbours(u):
                    if v not in depth:
                        depth[v] = depth[u] + 1
                        todo.append(v)
            far = max(far, *depth.values())
        return far


@dataclass(frozen=True)
class InducedGraph:
    """Vertex and edge sets of a part of a query graph."""

    vertices: frozenset
    edges: frozenset

    @classmethod
    def of_edge(cls, u: int, v: int) -> InducedGraph:
        return cls(frozenset((u, v)), frozenset([frozenset((u, v))]))

    def union(self, other: InducedGraph) -> InducedGraph:
        return InducedGraph(self.vertices | other.vertices, self.edges | other.edges)

    def intersection(self, other: InducedGraph) -> InducedGraph:
        return InducedGraph(self.vertices & other.vertices, self.edges & other.edges)

    def degree(self, u: int) -> int:
        return sum(u in e for e in self.edges)
