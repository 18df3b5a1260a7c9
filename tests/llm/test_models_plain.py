"""op1 and op2 against the same models written out in plain Python, every row of a table."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq

from quillon.llm import langid, quality

SF = "/root/testdata/sf0.001"


def rows_of(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def trigrams(text):
    data = [c if c >= 128 or 97 <= c <= 122 else 32 for c in f" {text.lower()} ".encode()]
    found = Counter()
    for a, b, c in zip(data, data[1:], data[2:], strict=False):
        if (a, b, c) != (32, 32, 32):
            found[(((a << 16 | b << 8 | c) * 2654435761) & 0xFFFFFFFF) >> 16] += 1
    return found


def em(like, n):
    """Shares and log likelihood; ``like`` has a row of likelihoods for each trigram."""
    k, total = len(like[0]), sum(n)
    share = [1 / k] * k
    for _ in range(30):
        new = [0.0] * k
        for row, c in zip(like, n, strict=True):
            joint = [a * b for a, b in zip(row, share, strict=True)]
            whole = sum(joint)
            for i in range(k):
                new[i] += c * joint[i] / whole / total
        moved = max(abs(a - b) for a, b in zip(new, share, strict=True))
        share = new
        if moved < 1e-4:
            break
    return share, sum(c * math.log(sum(a * b for a, b in zip(row, share, strict=True))) for row, c in zip(like, n, strict=True))


def test_every_language_prediction(spark):
    docs = rows_of("documents")
    counts = defaultdict(Counter)
    for d in docs:
        if not is_held_out(d["doc_id"]) and d["lang"] is not None and d["text"] is not None:
            counts[d["lang"]] += trigrams(d["text"])
    langs = sorted(counts)
    sums = [sum(counts[x].values()) + 0.05 * 65536 for x in langs]
    wanted = {}
    for d in docs:
        if not any(c.isalpha() for c in d["text"] or ""):
            wanted[d["doc_id"]] = ("und", 0.0)
            continue
        grams = trigrams(d["text"])
        n, like = [c / 3 for c in grams.values()], []
        for g in grams:
            logs = [math.log((counts[x][g] + 0.05) / s) for x, s in zip(langs, sums, strict=True)]
            like.append([math.exp(v - max(logs)) + 1e-12 for v in logs])
        share, _ = em(like, n)
        order = sorted(range(len(langs)), key=lambda i, share=share: -share[i])
        best, kept, penalty = -math.inf, [], 0.5 * math.log(sum(n) + 1) + 1
        for k in range(1, len(order) + 1):
            share, gained = em([[row[i] for i in order[:k]] for row in like], n)
            if gained - penalty * (k - 1) <= best:
                break
            best, kept = gained - penalty * (k - 1), list(zip(share, order[:k], strict=True))
        top = max(kept, key=lambda x: (x[0], -x[1]))
        wanted[d["doc_id"]] = (langs[top[1]], top[0])
    got = langid.op1_langid(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(wanted)
    for r in got:
        assert r.held_out == is_held_out(r.doc_id) and r.lang_pred == wanted[r.doc_id][0]
        assert abs(r.score - wanted[r.doc_id][1]) < 2e-4  # EM stops when shares move by less than half of that


def kind(c):
    for name, members in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("space", (9, 11, 12, 32)), ("end", (10, 13)), ("far", range(128, 256)), ("mark", b".,;:?'\"()-")):
        if c in members:
            return name
    return "other"


KINDS = [kind(c) for c in range(256)]


def measures(text):
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * 17
    part = {k: v / len(raw) for k, v in Counter(KINDS[c] for c in raw).items()}
    share = lambda k: part.get(k, 0.0)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n = len(words)
    return [
        math.log(1 + n), sum(len(w) for w in words) / n, math.log(1 + n / len(lines)), share("other"), share("upper"), share("digit"), share("end"), share("mark"), share("far"), share("space"),
        len(set(words)) / n, len({(a, b) for a, b in zip(words, words[1:], strict=False)}) / max(1, n - 1), max(Counter(words).values()) / n, sum(KINDS[w[-1]] == "other" for w in words) / n,
        1 - len(set(lines)) / len(lines), sum(len(w) <= 3 for w in words) / n, 1.0 if share("other") > 0.02 else 0.0,
    ]


def solved(a, b):
    """Gaussian elimination with pivots."""
    m = [[*row, v] for row, v in zip(a, b, strict=True)]
    for i in range(len(m)):
        p = max(range(i, len(m)), key=lambda r: abs(m[r][i]))
        m[i], m[p] = m[p], m[i]
        for r in range(len(m)):
            if r != i:
                f = m[r][i] / m[i][i]
                m[r] = [x - f * y for x, y in zip(m[r], m[i], strict=True)]
    return [m[i][-1] / m[i][i] for i in range(len(m))]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def test_every_quality_score(spark):
    docs = rows_of("documents")
    label = {r["doc_id"]: r["quality"] for r in rows_of("labels") if r["quality"] in (0, 1) and not is_held_out(r["doc_id"])}
    x = {d["doc_id"]: measures(d["text"]) for d in docs}
    ids = [d["doc_id"] for d in docs if d["doc_id"] in label]
    columns = list(zip(*(x[i] for i in ids), strict=True))
    mean = [sum(c) / len(c) for c in columns]
    scale = [math.sqrt(sum((v - m) ** 2 for v in c) / len(c)) for c, m in zip(columns, mean, strict=True)]
    scale = [s if s > 1e-9 else 1.0 for s in scale]
    z = {i: [(v - m) / s for v, m, s in zip(x[i], mean, scale, strict=True)] for i in x}
    # the pairs are those that the seed draws; the loss and its steps are written out
    rng = np.random.default_rng(7)
    good, bad = ([k for k, i in enumerate(ids) if label[i] == want] for want in (1, 0))
    drawn = Counter(zip(rng.choice(good, quality.PAIRS).tolist(), rng.choice(bad, quality.PAIRS).tolist(), strict=True))
    pairs = [([a - b for a, b in zip(z[ids[g]], z[ids[b]], strict=True)], c / quality.PAIRS) for (g, b), c in drawn.items()]
    w = [0.0] * 17
    for _ in range(60):
        grad, curve = [1e-3 * v for v in w], [[1e-3 * (i == j) for j in range(17)] for i in range(17)]
        for d, c in pairs:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, dot(d, w)))))
            for i in range(17):
                grad[i] += c * (p - 1) * d[i]
                f = c * p * (1 - p) * d[i]
                row = curve[i]
                for j in range(17):
                    row[j] += f * d[j]
        step = solved(curve, grad)
        w = [a - b for a, b in zip(w, step, strict=True)]
        if max(map(abs, step)) < 1e-6:
            break
    scores = [dot(z[i], w) for i in ids]
    ranked, levels = sorted(scores), []
    for k in range(401):
        at = k / 400 * (len(ranked) - 1)
        low = min(int(at), len(ranked) - 2)
        levels.append(ranked[low] + (ranked[low + 1] - ranked[low]) * (at - low))
    right = [sum((s >= t) == (label[i] == 1) for s, i in zip(scores, ids, strict=True)) for t in levels]
    best = [t for t, r in zip(levels, right, strict=True) if r == max(right)]
    cut = sum(best) / len(best)
    got = quality.op2_quality(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(x)
    for r in got:
        want = 1 / (1 + math.exp(-(dot(z[r.doc_id], w) - cut + math.log(0.7 / 0.3))))
        assert r.held_out == is_held_out(r.doc_id) and abs(r.score - want) < 1e-6
        assert r.predicted == (r.score >= 0.7)
