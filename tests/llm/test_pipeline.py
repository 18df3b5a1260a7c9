import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from quillon.llm import exact_dedup, jaccard_join, mixing, quality
from quillon.llm.common import materialize, table

SF = "/root/testdata/sf0.001"
W = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(t):
    w = W.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_mix(rows):
    """Copies of each of ``rows(doc_id, text, source)``, sources one after the other, each in the order of ranks."""
    size = [len(W.findall(r.text or "")) for r in rows]
    names = sorted({r.source for r in rows}, key=lambda s: (s is None, s))
    total = {s: sum(n for r, n in zip(rows, size, strict=True) if r.source == s) for s in names}
    want, free = {}, {s: i % 3 + 1 for i, s in enumerate(names)}
    while free:
        level = (sum(total.values()) - sum(want.values())) / sum(free.values())
        over = [s for s in free if level * free[s] > 3 * total[s]]
        want |= {s: 3.0 * total[s] for s in over} if over else {s: level * w for s, w in free.items()}
        free = {s: w for s, w in free.items() if s not in want}
    copies = [0] * len(rows)
    for s in names:
        at = [i for i, r in enumerate(rows) if r.source == s]
        whole = math.floor(want[s] / total[s]) if total[s] else 0
        rest = max(0.0, want[s] - whole * total[s])
        fits = sorted((i for i in at if 0 < size[i] <= rest), key=lambda i: -size[i])
        c = next((x for k, i in enumerate(fits) if (x := (rest - sum(size[j] for j in fits[:k])) / sum(size[j] ** 2 for j in fits[k:])) * size[i] < 1), math.inf)

        def unit(i):
            name = str(rows[i].doc_id) if rows[i].doc_id is not None else "text:" + hashlib.md5((rows[i].text or "").encode()).hexdigest()
            return (int(hashlib.md5(f"mix:{name}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52

        rank = {i: u / (1 - u) * (1 - p) / p if (p := min(1.0, c * size[i])) < 1 and (u := unit(i)) else 0.0 for i in fits}
        taken, left = [], rest
        for _ in range(2):
            room = left
            for i in sorted((i for i in fits if i not in taken and size[i] <= room), key=lambda i: (rank[i], rows[i].doc_id, size[i])):
                if size[i] > left:
                    break
                taken.append(i)
                left -= size[i]
        taken += sorted((i for i in at if i not in taken and size[i] and abs(size[i] - left) < left), key=lambda i: (abs(size[i] - left), unit(i)))[:1]
        for i in at:
            copies[i] = min(3, whole + (i in taken))
    return copies


def test_stages_against_brute_force(spark):
    """Each stage's rows, worked out in plain Python from what the stage before kept."""
    docs = table(spark, SF, "documents")
    first = {r.doc_id: r for r in docs.collect()}
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "jaccard_join", "mixing", "packing"]

    def after(name, docs):
        out = materialize(stages[name](spark, docs, SF), spark)
        rows = out.collect()
        assert out.columns == names and all(first[r.doc_id] == r for r in rows)
        return out, sorted(rows, key=lambda r: r.doc_id)

    ids = lambda rows: [r.doc_id for r in rows]
    model = quality.train(docs, table(spark, SF, "labels"))
    good, rows = after("quality", docs)
    assert ids(rows) == sorted(i for i, r in first.items() if quality.score_rows(np.array([quality.features(r.text or "")]), model)[0] >= 0.7)
    once, got = after("exact_dedup", good)
    least = {}
    for r in rows:
        least.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    assert ids(got) == sorted(least.values())
    apart, rows = after("jaccard_join", once)
    sets, up = {r.doc_id: shingle_set(r.text) for r in got}, {r.doc_id: r.doc_id for r in got}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    assert ids(rows) == sorted({find(i) for i in sets}) and len(rows) < len(sets)
    mixed, got = after("mixing", apart)
    assert Counter(ids(got)) == Counter({r.doc_id: k for r, k in zip(rows, brute_mix(rows), strict=True) if k})
    pieces = stages["packing"](spark, mixed, SF).toPandas()
    tokens = pieces.groupby("doc_id").agg(length=("length", "sum"), each=("doc_tokens", "first"))
    assert dict(tokens["length"] // tokens["each"]) == dict(Counter(ids(got))) and not (tokens["length"] % tokens["each"]).any()


NAMES = ["doc_id", "text", "source", "_copy", "_near", "_n", "_id", "_k", "_source", "row", "rows", "id", "norm", "digest", "size", "u", "copies", "take", "keep_id", "group_size"]


@pytest.fixture(scope="module")
def clashing(spark):
    """Nulls, empty texts, repeated rows, ties and a long text, beside columns with the names that the stages use themselves."""
    texts = [(1, "one two three four five six"), (1, "one two three four five six"), (None, "one  two three four five six"), (2, "seven eight nine ten"), (3, "seven eight nine ten"),
             (None, "alone without an id"), (None, "alone without an id"), (4, None), (5, ""), (None, None), (6, " ".join(f"w{i}" for i in range(20_000))), (7, " ".join(f"w{i}" for i in range(20_001))), (8, "ONE two three four five six")]
    rows = [(i, t, "s" if k % 3 else None, *([k] * (len(NAMES) - 3))) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` long" for n in NAMES[3:])).cache()


def test_stages_with_odd_rows(spark, clashing):
    rows = {r._copy: r for r in clashing.collect()}
    kept = lambda df: sorted(r._copy for r in df.collect())
    assert kept(exact_dedup.keep_first(clashing)) == [0, 1, 3, 5, 6, 7, 10, 11, 12]  # a copy without an id goes, an empty text is one with null
    assert kept(jaccard_join.one_of_each(clashing, spark)) == [0, 1, 2, 3, 5, 6, 7, 8, 9, 10]
    mixed = mixing.mixed_rows(clashing, spark)
    want = defaultdict(int)
    for r in mixing.mixed(clashing, spark).collect():
        want[r.doc_id, r.source, r.size] += r.copies
    got = Counter((r.doc_id, r.source, len((r.text or "").split())) for r in mixed.collect())
    assert got == Counter({k: n for k, n in want.items() if n})
    assert quality.keep_good(clashing, {"w": None, "prior": 1.0}, spark).count() == len(rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, clashing.limit(0), SF).count() == 0
    for out in (exact_dedup.keep_first(clashing), jaccard_join.one_of_each(clashing, spark), mixed):
        assert out.columns == NAMES and all(rows[r._copy] == r for r in out.collect())


def test_empty_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_registered():
    assert {f"op{n}_" for n in range(1, 11)} | {"pipeline"} <= {q.split("_")[0] + "_" if q[0] == "o" and q[2].isdigit() else q for q in entry.queries()}
