import random

import pytest
from prose import prose

#: Columns whose names clash with those that operators use inside.
EXTRA = "class string, rep long, tag long, bucket int, key string, row long, line long, host string, th long, _id int, _text string, _null int, _gone string, a int, b int"

@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): prose, exact and near copies, repeated passages, short, empty, null, long and odd texts."""
    r = random.Random(7)
    out = [prose(r, r.randrange(30, 200)) for _ in range(60)]
    out += out[:8]
    for i in range(8, 20):
        w = out[i].split(" ")
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
    passage = prose(r, 40)
    out += [f"{prose(r, 20)} {passage} {prose(r, 20)}" for _ in range(12)]
    out += ["", None, "one", "one", "two words", "two  words", " \n ", "ab" * 400, "é" * 150, "x " * 300, prose(r, 5000), "#$% && <>|", "<|endoftext|> it's  done \n\n", "a\x00b \x0b c\x1c d e f"]
    ids = list(range(len(out)))
    r.shuffle(ids)
    return list(zip(ids, out))


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, name="doc_id", kind="long"):
        data = [(i, t, "en", f"s{(i or 0) % 3}", None if t is None else len(t), *([None] * 15)) for i, t in rows]
        return spark.createDataFrame(data, f"{name} {kind}, text string, lang string, source string, n_chars long, {EXTRA}").repartition(3)

    return make


@pytest.fixture(scope="session")
def docs(frame, texts):
    return frame(texts)
