"""Brute-force counterparts: a graph as dicts, matched by trying all assignments, recounted after each update."""

from itertools import product


class Graph:
    def __init__(self):
        self.labels, self.edges = {}, {}

    def apply(self, op):
        _, kind, add, a, b, label = op
        if kind == "v":
            if add:
                self.labels.setdefault(a, label)
            else:
                self.labels.pop(a, None)
                for e in [e for e in self.edges if a in e]:
                    del self.edges[e]
        elif add:
            if a != b:
                self.edges.setdefault(frozenset((a, b)), label)
        else:
            self.edges.pop(frozenset((a, b)), None)


def embeddings(q, g, homo=False):
    options = [[v for v, x in g.labels.items() if q.label_set(u) is None or x in q.label_set(u)] for u in range(q.size)]
    out = set()
    for m in product(*options):
        if (homo or len(set(m)) == q.size) and all(g.edges.get(frozenset((m[u], m[v]))) == c and m[u] != m[v] for u, v, c in q.edges):
            out.add(m)
    return out


def run(q, vertices, edges, ops, homo=False):
    """(initial embeddings, {seq: (appeared, disappeared)})"""
    g = Graph()
    for v, x in vertices:
        g.labels[v] = x
    for a, b, c in edges:
        g.edges.setdefault(frozenset((a, b)), c)
    now = first = embeddings(q, g, homo)
    changes = {}
    for op in ops:
        g.apply(op)
        then = embeddings(q, g, homo)
        if then != now:
            changes[op[0]] = (then - now, now - then)
        now = then
    return first, changes
