"""op5 where rows repeat an id with other words: the same result in any order of the rows."""

import random

import pytest

from quillon.llm import jaccard_join


def plain(rows):
    """(id, set size, component) of each row, over all pairs; rows of one id reach each other."""
    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            i, j = rows[a][0], rows[b][0]
            if i is not None and j is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets, strict=True)), key=repr)


@pytest.mark.parametrize("turn", [1, -1])
def test_ids_with_several_texts(spark, turn):
    rng = random.Random(4)
    word = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    v, w, u = word(40), word(40), word(60)
    rows = [(1, v), (1, w), (2, w + " more"), (3, v + " less"), (-9, u), (8, u + " x"), (8, "other words here"), (8, ""), (8, None), (5, "other words here"), (7, word(30)), (7, word(30)), (None, v), (1, v), (6, "")]
    rows = rows[::turn]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), spark).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows)
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1} and {r.component_id for r in got if r.doc_id in (5, 8, -9)} == {-9}
    kept = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), spark).collect()
    assert {r.doc_id for r in kept} == {1, -9, 7, None, 6} and sum(r.doc_id == 1 for r in kept) == 3
