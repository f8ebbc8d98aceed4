"""Near-duplicate texts and vectors, benchmark passages: against brute force."""

import itertools
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from loanloom.llm import contamination, near_duplicates, vectors
from loanloom.llm.common import table

SF = "/root/testdata/sf0.01"


def shingles(text, size):
    words = (text or "").encode().lower().split()
    width = min(size, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def brute(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_groups_of_documents(spark, size, percent):
    rows = pq.read_table(f"{SF}/documents.parquet").select(["doc_id", "text"]).to_pylist()
    want = brute([(r["doc_id"], r["text"]) for r in rows], size, percent)
    got = near_duplicates.near_duplicates(table(spark, SF, "documents"), size, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_a_crowded_region(spark):
    """Most rows are copies with small edits, sharing prefixes in every tree; short texts besides."""
    draw = random.Random(6)
    base = [f"w{draw.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(260):
        words = list(base)
        for _ in range(draw.randrange(5)):
            words[draw.randrange(len(words))] = f"x{draw.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, t) for i, t in enumerate(["a", "A", "a b", "a b", "b a", "", " ", "a b c", "A B C d"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = near_duplicates.near_duplicates(df, 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 3, 85)


def test_a_crowd_below_the_threshold(spark):
    """A long shared passage makes all texts resemble each other; only a few pairs share enough of their own parts."""
    draw = random.Random(9)
    own = lambda n: [f"x{draw.randrange(10**9)}" for _ in range(n)]
    passage, rows = own(300), []
    for i in range(600):
        rows.append((i, " ".join(passage + own(45))))
    for i in range(0, 120, 2):
        both = own(14)
        rows[i], rows[i + 1] = (i, " ".join(passage + both + own(31))), (i + 1, " ".join(passage + both + own(31)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = near_duplicates.near_duplicates(df, 3, 80).collect()
    want = brute(rows, 3, 80)
    assert len({c for _, c in want.values()}) == 540
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_odd_documents(odd_docs, no_docs):
    got = near_duplicates.near_duplicates(odd_docs, 3, 85).collect()
    assert len(got) == 8
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {
        (1, 0, 1, True), (2, 0, 2, True), (3, 5, 3, True), (None, 3, None, True), (4, 1, 4, True), (5, 1, 5, True), (6, 0, 6, True),
    }
    assert near_duplicates.near_duplicates(no_docs).collect() == []


# --- vectors ----------------------------------------------------------------------------------


def vector_links(rows, cosine):
    """Links and components by comparing all pairs."""
    n = len(rows)
    linked = np.zeros((n, n), dtype=bool)
    for i, j in itertools.combinations(range(n), 2):
        (_, u, lu), (_, v, lv) = rows[i], rows[j]
        if lu is None or lu != lv or u is None or v is None or len(u) != len(v):
            continue
        if any(x is None or not np.isfinite(x) for x in (*u, *v)) or not any(u) or not any(v):
            continue
        a, b = np.array(u), np.array(v)
        linked[i, j] = linked[j, i] = a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine
    label = vectors._components_within(linked)
    return {rows[i][0]: (int(linked[i].sum()), rows[label[i]][0]) for i in range(n)}


def test_vectors_with_crowds_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)  # so that the crowd spreads over pairs of blocks
    rng = np.random.default_rng(8)
    rows, centre = [], rng.standard_normal(64)
    for i in range(120):
        rows.append((i, (centre + 0.12 * rng.standard_normal(64)).tolist(), 1))
    for i in range(120, 200):
        v = rng.standard_normal(64)
        rows += [(i, v.tolist(), i % 3), (i + 1000, (v + 0.1 * rng.standard_normal(64)).tolist(), (i + i % 2) % 3)]
    rows += [(500 + i, rows[0][1], 1) for i in range(5)]
    rows += [
        (600, None, 1), (601, [0.0] * 64, 1), (602, [1.0, None], 1), (603, [float("nan")] * 64, 1), (604, rows[0][1], None),
        (605, [], 1), (606, [1.0, 2.0, 3.0], 1), (607, [1.0, 2.0, 3.1], 1), (608, [float("inf")] * 3, 1), (609, [1e200, -1e200, 0.0], 1),
        (610, [2e200, -2e200, 0.0], 1), (611, [-0.0, 1.0], 2), (612, [0.0, 1.0], 2),
    ]
    rows = sorted(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df).collect()}
    want = vector_links([r for r in rows if r[0] not in (609, 610)], 0.93) | {609: (1, 609), 610: (1, 609)}
    found, all_links = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert got.keys() == want.keys() and all(got[i][0] <= want[i][0] for i in want)
    assert found >= 0.99 * all_links
    assert sum(got[i] != want[i] for i in want) <= 0.02 * len(want)


def test_recall_on_embeddings(spark):
    sf = "/root/testdata/sf0.1"
    rows = pq.read_table(f"{sf}/embeddings.parquet").to_pylist()
    x = vectors.unit(np.array([r["embedding"] for r in rows], dtype=np.float64))
    label = np.array([r["label"] for r in rows])
    linked = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    got = {r.vec_id: r for r in vectors.near_vectors(table(spark, sf, "embeddings")).collect()}
    links = np.array([got[r["vec_id"]].n_links for r in rows])
    assert (links <= linked.sum(1)).all() and links.sum() >= 0.9 * linked.sum()


@pytest.mark.parametrize("shared", [0, 1, 3, 5])
@pytest.mark.parametrize("length", [64, 768])
def test_recall_where_vectors_share_a_direction(spark, shared, length):
    """Links at the threshold and above, around one common direction and in a crowd, whatever the mean."""
    rng = np.random.default_rng(shared + length)
    way = vectors.unit(rng.standard_normal((1, length)))
    x = vectors.unit(rng.standard_normal((150, length)))
    # Partners at a cosine of just over the threshold once the shared direction is added.
    near = vectors.unit(x + np.sqrt(0.11 * (1 + shared**2)) * vectors.unit(rng.standard_normal((150, length))))
    crowd = vectors.unit(x[:1] + 0.2 * vectors.unit(rng.standard_normal((60, length))))
    rows = np.concatenate([x, near, crowd]) + shared * way
    whole = vectors.unit(rows)
    linked = whole @ whole.T >= 0.93
    np.fill_diagonal(linked, False)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in vectors.near_vectors(df.repartition(4)).collect()}
    links = np.array([got[i].n_links for i in range(len(rows))])
    assert linked.sum() > 3000 and (links <= linked.sum(1)).all() and links.sum() >= 0.99 * linked.sum()
    label = vectors._components_within(linked)
    assert sum(got[i].component_id != label[i] for i in range(len(rows))) <= 0.02 * len(rows)


def test_labels_that_are_no_whole_numbers(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [1.0, 0.01], "a"), (3, [1.0, 0.0], "b"), (4, [1.0, 0.0], None)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert {r.vec_id: r.n_links for r in got} == {1: 1, 2: 1, 3: 0, 4: 0}
    rows = [(i, [1.0, 0.0], la) for i, la in ((1, 1.2), (2, 1.7), (3, 1.7))]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label double")).collect()
    assert {r.vec_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 2}


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectors.near_vectors(none).collect() == []


def test_window_recall_estimate():
    assert vectors.expected_recall(0.93, 8) > 0.97 and vectors.window_width(1) == 8 and vectors.window_width(10**9) == 20


def test_recall_at_every_width(spark, monkeypatch):
    """One level of recall from the narrowest to the widest window, as expected and as measured."""
    assert all(vectors.expected_recall(0.93, width) >= 0.99 for width in range(8, 21))
    monkeypatch.setattr(vectors, "window_width", lambda largest_group: 20)
    rng = np.random.default_rng(4)
    x = vectors.unit(rng.standard_normal((400, 64)))
    own = rng.standard_normal((400, 64))
    own = vectors.unit(own - (own * x).sum(1, keepdims=True) * x)
    y = 0.935 * x + np.sqrt(1 - 0.935**2) * own
    rows = [(i + 1000 * k, v.tolist(), 1) for k, side in enumerate((x, y)) for i, v in enumerate(side)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    assert all(r.n_links <= 1 for r in got.values())
    assert sum(got[i].n_links for i in range(400)) >= 0.97 * 400


# --- benchmark passages -----------------------------------------------------------------------


def least_distance(pattern, text):
    before = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        row = [i]
        for j, b in enumerate(text, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (a != b)))
        before = row
    return min(before)


def test_bit_parallel_distance():
    draw = random.Random(2)
    for _ in range(300):
        pattern = "".join(draw.choice("abc") for _ in range(draw.randint(1, 90)))
        text = "".join(draw.choice("abc") for _ in range(draw.randint(1, 120)))
        want = least_distance(pattern, text)
        assert contamination.best_occurrence(pattern, text, 10**6)[0] == want
        assert (contamination.best_occurrence(pattern, text, want - 1) is None) or want == 0


def test_planted_passages(spark, odd_docs, no_docs, monkeypatch):
    draw = random.Random(12)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(draw.randint(5, 40)))) for i in range(30)] + [(30, ""), (31, "ab"), (32, None)]
    docs, want = [], set()
    for i in range(300):
        prose = " ".join(word() for _ in range(draw.randint(0, 60)))
        item_id, item = items[i % 30]
        text = list(contamination.normalised(item))
        for _ in range(int(contamination.BUDGET * len(text)) if i % 3 else 0):
            text[draw.randrange(len(text))] = draw.choice("abcdefghz")
        text = "".join(text).upper().replace(" ", ",\n") if i % 2 else "".join(text)
        docs.append((i, f"{prose} {text} {prose}" if i % 5 else prose))
    docs += [(900, "Ab!"), (901, None)]
    limit = {i: int(contamination.BUDGET * len(contamination.normalised(t or ""))) for i, t in items}
    for doc_id, text in docs:
        doc = contamination.normalised(text or "")
        for item_id, item in items[:30]:
            distance = least_distance(contamination.normalised(item), doc) if doc else 10**6
            if distance <= limit[item_id]:
                want.add((doc_id, item_id, distance))
    want |= {(i, 31, 0) for i, t in docs if " ab " in f" {contamination.normalised(t or '')} "}
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = contamination.contaminated(frame, benchmark).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in got} == want and len(got) == len(want)
    blocks = list(contamination.item_blocks(benchmark, chars=500))
    assert len(blocks) > 3 and sum(map(len, blocks)) == len(items)
    assert contamination.contaminated(odd_docs, benchmark).collect() == []
    short = spark.createDataFrame([(1, "Was it the third?"), (2, "one"), (3, "third")], "item_id long, text string")
    quoted = spark.createDataFrame([(7, "He asked: was it (the) third? one-two"), (8, "was it thethird bone")], "doc_id long, text string")
    hits = {(r.doc_id, r.item_id, r.distance) for r in contamination.contaminated(quoted, short).collect()}
    assert hits == {(7, 1, 0), (7, 2, 0), (7, 3, 0)}
    assert [r.doc_id for r in contamination.uncontaminated(quoted, short).collect()] == [8]
    monkeypatch.setattr(contamination, "item_blocks", lambda b, blocks=contamination.item_blocks: blocks(b, chars=500))
    assert {(r.doc_id, r.item_id, r.distance) for r in contamination.contaminated(frame, benchmark).collect()} == want
    left = contamination.uncontaminated(frame, benchmark).collect()
    assert {r.doc_id for r in left} == {i for i, _ in docs} - {i for i, _, _ in want}
    assert contamination.contaminated(no_docs, benchmark).collect() == []
    assert contamination.contaminated(frame, benchmark.limit(0)).collect() == []
