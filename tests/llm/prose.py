"""Random prose."""

SYLLABLES = "an ba co du el fi go hu in jo ka lu me no or pi qua re sa to ul ve wo xi yo zu".split()


def words(r, n):
    return ["".join(r.choice(SYLLABLES) for _ in range(r.randrange(1, 5))) for _ in range(n)]


def prose(r, n):
    out = words(r, n)
    for i in range(9, n, 10):
        out[i] += ".\n" if r.random() < 0.3 else "."
    return " ".join(out).replace("\n ", "\n")
