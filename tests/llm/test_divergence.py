"""The audit against plain counting."""

import random
import re
from collections import Counter

import pandas as pd
import pytest

from loanloom.llm import divergence


def plain(docs, least, top):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [tuple(x or "" for x in d) for d in docs]
    found = []
    for lang in sorted({d[0] for d in docs}):
        own = [(s, term.findall(t.translate(lower))) for la, s, t in docs if la == lang]
        held = Counter(w for _, words in own for w in set(words))
        kept = sorted(w for w, n in held.items() if n >= least)
        counts = {None: Counter()} | {s: Counter() for s, _ in own}
        for s, words in own:
            counts[s].update(words)
            counts[None].update(words)

        def p(s):
            total = sum(counts[s][w] for w in kept)  # noqa: B023
            return {w: 1 + 10**9 * (counts[s][w] + 2) // (total + 2 * len(kept)) for w in kept}  # noqa: B023

        of = {s: p(s) for s in counts}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            if s is None:
                continue
            pairs = [(sum(f(of[s][w], of[o][w]) for w in kept), o) for o in counts if o not in (s, None)]
            terms = [(f(of[s][w], of[None][w]), w) for w in kept if counts[s][w] and of[s][w] > of[None][w]]
            for part, ranked, limit in (("pair", pairs, None), ("term", terms, top)):
                for r, (value, item) in enumerate(sorted(ranked, key=lambda x: (-x[0], x[1].encode()))[:limit], 1):
                    found.append((lang, s, part, item, value, r))
    return sorted(found)


def made_docs(seed, n=400):
    draw = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("é", "x", "\U0001f600", "Y", "zz", "ﬁ")]
    rows = []
    for _ in range(n):
        lang, source = draw.choice(["en", "en", "de", None]), draw.choice(["s1", "s1", "s2", "s3", "", None])
        some = draw.sample(words, 12) if source != "s2" else words[:20]
        text = draw.choice([" ", "-", "0"]).join(draw.choice(some) for _ in range(draw.randrange(40)))
        rows.append((lang, source, draw.choice([text, text.upper(), text]) if draw.random() < 0.95 else None))
    return rows + [("fr", "s1", "one"), ("fr", "s9", ""), ("fr", "s1", None), ("it", "alone", "word " * 50)] + [("pt", "p", "olá olá")] * 12


@pytest.mark.parametrize("least,top", [(10, 10), (3, 2)])
def test_audit(spark, least, top, monkeypatch):
    monkeypatch.setattr(divergence, "_HELD", 50)  # so that tasks pass their counts on many times
    rows = made_docs(least)
    df = spark.createDataFrame([(la, s, t, "x", 1) for la, s, t in rows], "lang string, source string, text string, term string, n long")
    got = sorted(tuple(r) for r in divergence.divergence_audit(df.repartition(4), least, top).collect())
    assert got == plain(rows, least, top)


def test_skyband_is_exact():
    draw = random.Random(9)
    rows = [("l", s, f"t{i:05d}", draw.randrange(1, 30), 0) for s in "ab" for i in draw.sample(range(10**5), 1500)]
    rows = [(la, s, t, n, n + draw.randrange(40)) for la, s, t, n, _ in rows]
    frame = pd.DataFrame(rows, columns=["lang", "source", "term", "n", "lang_n"])
    frame = frame.sort_values(["lang", "source", "n", "lang_n", "term"], ascending=[True, True, False, True, True])
    for k in (1, 3, 10):
        batches = [frame.iloc[i : i + 333] for i in range(0, len(frame), 333)]
        kept = pd.concat(divergence._skyband(iter(batches), k))
        want = set()
        for s in "ab":
            own = [r for r in rows if r[1] == s]
            for r in own:
                above = sum(o[3] >= r[3] and o[4] <= r[4] and o[2] < r[2] for o in own)
                if above < k:
                    want.add((s, r[2]))
        assert set(zip(kept["source"], kept["term"])) == want and len(kept) == len(want)


def test_odd_and_no_docs(spark, odd_docs, no_docs):
    got = divergence.divergence_audit(odd_docs, least_docs=2).collect()
    want = plain([(r.lang, r.source, r.text) for r in odd_docs.collect()], 2, 10)
    assert sorted(tuple(r) for r in got) == want
    assert divergence.divergence_audit(no_docs).collect() == []
