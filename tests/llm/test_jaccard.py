import random

import pytest

from marketloom.llm import jaccard

DOCS = "doc_id long, text string, n string, node string, token string"


def brute(rows, k, percent):
    """rows: (doc_id, text) -> the smallest id reachable, for every row."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))} if words else set())
    comp = list(range(len(rows)))

    def top(i):
        while comp[i] != i:
            comp[i] = comp[comp[i]]
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                comp[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    return sorted((str(rows[i][0]), len(sets[i]), str(least.get(top(i)) if sets[i] else rows[i][0])) for i in range(len(rows)))


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvw") + rng.choice("aeiou") + rng.choice("klmnprst")
    passage = [word() for _ in range(25)]
    rows, texts = [], []
    for i in range(n):
        if texts and rng.random() < 0.55:
            words = list(rng.choice(texts[-12:]))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 7])):
                at = rng.randrange(len(words) + 1)
                words[at : at + rng.choice([0, 1])] = [word()]
        else:
            words = [word() for _ in range(rng.choice([3, 12, 40, 90, 200]))]
            if rng.random() < 0.5:
                words += passage
        texts.append(words)
        rows.append((i * 3, " ".join(w.upper() if rng.random() < 0.1 else w for w in words)))
    return rows


def run(spark, rows, k, percent):
    frame = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], DOCS).repartition(3)
    got = jaccard.near_duplicates(frame, k, percent).collect()
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got)


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 3, 90), (2, 5, 80), (3, 3, 90)])
def test_components_against_brute_force(spark, seed, k, percent):
    rows = corpus(seed, 220)
    assert run(spark, rows, k, percent) == brute(rows, k, percent)


def test_edges(spark):
    rows = [(7, None), (8, ""), (9, " \n\t"), (3, "one"), (4, "ONE"), (5, "one two"), (None, "one two"), (None, "x y z w"), (20, "long word " * 30_000), (19, "long word " * 30_000), (30, "a b c d e"), (30, "p q r s t"), (29, "p q r s t"), (30, "a b c d e"), (2, "ßé\x1cA b")]
    assert run(spark, rows, 3, 90) == brute(rows, 3, 90)
    assert run(spark, [], 3, 90) == []


def test_links_inside_a_group_whose_prefix_no_other_group_holds(spark):
    body = [f"w{i}" for i in range(61)]
    other = " ".join([f"v{i}" for i in range(70)] + body[-2:] + ["day"] + body[-2:] + ["year"])
    rows = [(1, " ".join([*body, "day"])), (2, " ".join([*body, "year"])), (3, other), (4, other + " x"), (5, other + " y")]
    want = brute(rows, 3, 90)
    assert [c for _, _, c in want] == ["1", "1", "3", "3", "3"]
    assert run(spark, rows, 3, 90) == want
