"""Crowded regions of near duplicates against what their texts say."""

import numpy as np

from graphloom.llm.minhash_dedup import near_duplicate_documents


def test_star_of_variants(spark):
    """3,000 variants alike to one base, not to each other: one group; a text just below the threshold stays out."""
    r = np.random.default_rng(5)
    base = [f"b{i}" for i in range(604)]
    texts = [" ".join(base)]
    for n in range(3_000):
        words = list(base)
        for j, at in enumerate(r.permutation(100)[:15] * 6 + r.integers(0, 5, 15)):
            words[at] = f"v{n}x{j}"
        texts.append(" ".join(words))
    far = list(base)
    for j in range(20):
        far[j * 30 + 4] = f"far{j}"
    texts.append(" ".join(far))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in (texts[0], *texts[1:50], texts[-1]))]
    like = [len(sets[0] & s) / len(sets[0] | s) for s in sets]
    assert min(like[:-1]) >= 0.75 > like[-1] and len(sets[1] & sets[2]) / len(sets[1] | sets[2]) < 0.75
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {row["doc_id"]: row["component_id"] for row in near_duplicate_documents(df).collect()}
    assert {i: c for i, c in got.items() if c != 0} == {3_001: 3_001}


def brute(texts):
    import re

    sets = {}
    for i, t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    ids = sorted(sets)
    low = {i: i for i in ids}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                low[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_families_against_brute_force(spark):
    """Families of every size whose members differ by a little or a lot, over many partitions."""
    r = np.random.default_rng(9)
    texts = []
    for family in range(40):
        base = [f"f{family}w{x}" for x in r.integers(0, 400, int(r.integers(8, 160)))]
        for _ in range(int(r.integers(1, 45))):
            words = list(base)
            for at in r.integers(0, len(words), int(len(words) * r.choice([0.0, 0.01, 0.02, 0.04, 0.06]))):
                words[at] = f"e{r.integers(0, 10**6)}"
            texts.append((len(texts) * 7 + 1, " ".join(words)))
    want, sizes = brute(texts)
    got = near_duplicate_documents(spark.createDataFrame(texts, "doc_id long, text string").repartition(9)).collect()
    assert {row["doc_id"]: row["component_id"] for row in got} == want and {row["doc_id"]: row["n_shingles"] for row in got} == sizes


def test_repeated_ids_with_other_texts(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = spark.createDataFrame([(1, a), (1, b), (2, b), (3, a), (None, a), (4, None), (4, a)], "doc_id long, text string")
    got = near_duplicate_documents(rows).collect()
    groups = {(row["doc_id"], row["n_shingles"]): row["component_id"] for row in got}
    assert len(got) == 7 and len({c for (i, _), c in groups.items() if i == 1}) == 1
    # id 1 is one document, by one of its texts: exactly one of 2 and 3 is linked to it
    assert sorted([groups[2, 2], groups[3, 2]])[0] == 1 and {groups[2, 2], groups[3, 2]} != {1}
    assert groups[4, 2] == groups[4, 0] == groups[3, 2]


def test_codes_of_long_texts():
    from graphloom.llm.minhash_dedup import TREES, DEPTH, _coefficients, signature

    r = np.random.default_rng(3)
    codes = np.stack([signature(r.integers(0, 1 << 63, 200_000, dtype=np.uint64), *_coefficients(TREES * DEPTH)) for _ in range(4)])
    assert (codes[0] == codes[1]).sum() <= 2 and len(np.unique(codes)) > 0.95 * codes.size
