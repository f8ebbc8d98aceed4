"""Codebooks against plain integers, over odd vectors."""

import hashlib
import math

import numpy as np

from loanloom.llm import codebooks


def plain(rows, entries, rounds, parts=codebooks.PARTS):
    """vec_id, label and vector rows of one length, in order of their ids."""
    ints = [[math.floor(256 * float(x)) for x in v] for _, _, v in rows]
    length = len(ints[0])
    cuts = [i * length // parts for i in range(parts + 1)]
    books = [[v[a:b] for v in ints[:entries]] for a, b in zip(cuts, cuts[1:])]

    def nearest(part, book):
        return min((sum((x - y) ** 2 for x, y in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            held = [nearest(v[a:b], books[p])[1] for v in ints]
            for i in range(len(books[p])):
                own = [v[a:b] for v, h in zip(ints, held) if h == i]
                if own:
                    books[p][i] = [sum(c) // len(own) for c in zip(*own)]
    found = [[nearest(v[a:b], books[p]) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))] for v in ints]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in found]
    of_label = {}
    for (_, label, _), e in zip(rows, errors):
        of_label[label] = of_label.get(label, 0) + e
    return sorted(
        (r[0], "".join(f"{i:02x}" for _, i in f), e, of_label[r[1]], digest) for r, f, e in zip(rows, found, errors)
    )


def compressed(df, **settings):
    return sorted(tuple(r) for r in codebooks.compress_vectors(df, **settings).collect())


def test_codes_and_errors(spark, monkeypatch):
    monkeypatch.setattr(codebooks, "BLOCK_VALUES", 1000)  # several blocks a task
    rng = np.random.default_rng(5)
    rows = [(i, [None, 1, 2][i % 3], (rng.standard_normal(32) * 0.2).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, 1, rows[i][2]) for i in range(50)]
    df = spark.createDataFrame([(i, v, la, "x") for i, la, v in rows], "vec_id long, embedding array<float>, label int, code string")
    for entries, rounds in ((64, 2), (5, 3), (256, 0)):
        assert compressed(df.repartition(5), entries=entries, rounds=rounds) == plain(rows, entries, rounds)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 0), (2, [1.0, None], 0), (3, [nan, 1.0], 0), (4, [inf, 1.0], 0), (5, [1.0, -inf], 0),
        (6, [0.5, -0.001], 0), (7, [0.25, 0.75], None), (7, [0.25, 0.75], None), (8, [], 4), (9, [1.0, 2.0, 3.0], 4),
        (10, [3e5, -3e5], 9), (11, [1e300, -1e300], 9), (12, [-1e300, 1e300], 9),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got = {}
    for r in codebooks.compress_vectors(df, entries=2).collect():
        got.setdefault(r.vec_id, []).append(r)
    assert set(got) == {6, 7, 8, 9, 10, 11, 12} and len(got[7]) == 2
    assert got[8][0].code == "00" * 16 and got[8][0].error == 0 and got[8][0].label_error == 0
    assert len({got[i][0].codebooks_sha256 for i in (7, 8, 9)}) == 3
    assert all(r.error <= 2**63 - 1 for own in got.values() for r in own) and got[9][0].error == 0
    # Differences of 2^62 and more still pick the nearest entry, and what no long can hold is its largest.
    two = [(i, v, 9) for i, v in ((10, [3e5, -3e5]), (11, [1e300, -1e300]), (12, [-1e300, 1e300]), (13, [3.1e5, -2.9e5]))]
    far = codebooks.compress_vectors(spark.createDataFrame(two, "vec_id long, embedding array<double>, label int"), entries=2, rounds=0)
    codes = {r.vec_id: (r.code[14:16] + r.code[30:32], r.error) for r in far.collect()}
    assert codes[10] == ("0000", 0) and codes[11] == ("0101", 0) and codes[12] == ("0000", 2**63 - 1)
    assert codes[13][0] == "0000" and codes[13][1] == 2 * (256 * 10_000) ** 2


def test_missing_ids_and_no_vectors(spark):
    rows = [(None, [0.1] * 16, 1), (3, [0.2] * 16, 1), (2, [0.9] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.code for r in codebooks.compress_vectors(df, entries=2, rounds=0).collect()}
    assert got == {2: "00" * 16, 3: "01" * 16, None: "01" * 16}
    assert codebooks.compress_vectors(df.limit(0)).collect() == []
