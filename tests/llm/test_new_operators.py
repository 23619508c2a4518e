"""The classifier, the audit of filters and the clustering against brute force."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from oracle import same
from pyspark.sql import functions as F

from marlstone.llm import centroids, factorisation, interaction
from marlstone.llm.registry import ORACLES, QUERIES
from marlstone.llm.tries import Trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, mask string, part string, t string, y string, leaf string, label_id string"
LABELS = "doc_id long, quality int, toxic int, good string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), *("x",) * 6) for i, t, s in rows], DOCS)


def prose(seed, n, vocabulary=300):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


# -- clustering ---------------------------------------------------------------


def lloyd(rows, clusters=16, rounds=3):
    """Plain rounds in Python's integers over (vec_id, components)."""
    import hashlib

    h = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest())
    c = [v for _, v in sorted(rows, key=lambda r: (h(r[0]), r[1]))[:clusters]]
    d = lambda v, k: sum((a - b) ** 2 for a, b in zip(v, c[k], strict=True))
    for r in range(rounds + 1):
        own = [min(range(len(c)), key=lambda k: (d(v, k), k)) for _, v in rows]
        if r < rounds:
            for k in range(len(c)):
                mine = [v for (_, v), o in zip(rows, own, strict=True) if o == k]
                if mine:
                    c[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return Counter((i, o, sum((a - b) ** 2 for a, b in zip(v, c[o], strict=True))) for (i, v), o in zip(rows, own, strict=True))


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, label int, cluster string")


def test_clusters_equal_plain_rounds(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(0, 1, (6, 64))
    rows = [(i, [float(np.float32(x)) for x in middle[i % 6] + rng.normal(0, 0.4, 64)]) for i in range(400)]
    rows += [(7, rows[0][1]), (None, rows[1][1]), (500, [0.0] * 64), (501, [0.0] * 64), (502, [1e5] + [0.0] * 63)]
    bad = [(900, None), (901, []), (902, [0.1] * 63), (903, [0.1] * 65), (904, [None] + [0.1] * 63), (905, [math.nan] + [0.1] * 63), (906, [math.inf] + [0.1] * 63)]
    for kind in ("float", "double"):
        state, _, states = centroids.clustered(centroids.whole_vectors(vectors(spark, rows + bad, kind)))
        got = Counter((r.vec_id, r.cluster, r.distance) for r in state.collect())
        assert got == lloyd([(i, [math.floor(64 * x) for x in v]) for i, v in rows])
    scans = [s.where("scanned").count() for s in states]
    assert scans[0] == len(rows) and scans[-1] < len(rows) * 0.9
    with pytest.raises(Exception, match="too large"):
        centroids.whole_vectors(vectors(spark, [(1, [1e30] * 64)], "double")).collect()


def test_few_equal_and_no_vectors(spark, tmp_path):
    for name, rows in (("few", [(i, [0.1 * i] * 64) for i in range(5)]), ("one", [(1, [0.5] * 64)]), ("ties", [(i, [0.25] * 64) for i in range(40)]), ("none", []), ("bad", [(1, [0.5])])):
        p = tmp_path / name
        vectors(spark, rows).write.parquet(str(p / "embeddings.parquet"))
        same(QUERIES["op13_geometric_drift"](spark, str(p)), str(p), ORACLES["op13_geometric_drift"])


def test_loosening_bounds_every_point_and_is_tighter_than_drift():
    rng = np.random.default_rng(5)
    tighter = 0
    for dims in (2, 3, 10):
        for _ in range(60):
            old = rng.normal(0, 5, (4, dims))
            new = old + rng.normal(0, 1, (4, dims)) * rng.choice([0, 0.1, 3])
            radius = rng.uniform(0, 4, 4)
            out = centroids.loosening(old, new, radius)
            drift = np.sqrt(((new - old) ** 2).sum(1))
            tighter += (out < drift[None] - 1e-6).sum()
            for i in range(4):
                x = rng.normal(0, 1, (300, dims))
                x = old[i] + x / np.sqrt((x**2).sum(1))[:, None] * radius[i] * rng.uniform(0, 1, (300, 1)) ** 0.2
                for j in range(4):
                    closer = np.sqrt(((x - old[j]) ** 2).sum(1)) - np.sqrt(((x - new[j]) ** 2).sum(1))
                    assert closer.max() <= out[i, j] + 1e-9
    assert tighter > 300


# -- audit --------------------------------------------------------------------


def brute_audit(rows, labels):
    good, toxic = {d for d, q, _ in labels if d is not None and q == 1}, {d for d, _, t in labels if d is not None and t == 1}
    least: dict[str, int] = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = []
    for i, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        f = "".join(c for c, x in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search("[#$%&*|]", t) is not None, i is not None and i > least[t])) if x)
        fails.append((s or "", f, i in good, i in toxic))
    out = {}
    for part in {p for p, *_ in fails}:
        mine, shapley = [x[1:] for x in fails if x[0] == part], Counter()
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                there = [x for x in mine if not before & set(x[0])]
                gone = [x for x in there if f in x[0]]
                shapley[f] += len(gone)
                out[part, "".join(order), k + 1] = [len(there) - len(gone), len(gone), sum(f in x[0] for x in mine) - len(gone), sum(x[0] == f for x in mine), sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(shapley[order[k - 1]])
    return out


def audit_rows():
    r = random.Random(9)
    texts = [prose(k, r.choice([3, 150, 250, 400]), r.choice([60, 5000])) + r.choice(["", "", " A#B", " SHOUT" * 30]) for k in range(60)]
    texts += ["", None, " \t\n", "é" * 30, "same start " * 400 + "one", "same start " * 400 + "two", "same start " * 400]
    rows = [(i, r.choice(texts), r.choice(["a", "a", "b", None, ""])) for i in range(400)]
    hot = prose("hot", 260, 5000)
    rows += [(1000 + i, hot, "a" if i % 3 else "b") for i in range(200)] + [(1000, hot, "a"), (None, hot, "a"), (None, None, None), (None, "alone", "b"), (5, texts[0], "a")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 1100, 2)] + [(0, 1, 0), (None, 1, 1), (2, 0, 1)]
    return rows, labels


def test_audit_equals_brute_force(spark, tmp_path):
    rows, labels = audit_rows()
    want = brute_audit(rows, labels)
    d, marks = docs(spark, rows), spark.createDataFrame([(*x, "x") for x in labels], LABELS)
    d.repartition(7).write.parquet(str(tmp_path / "documents.parquet"))
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    df = QUERIES["op12_radix_tries"](spark, str(tmp_path))
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in df.collect()} == want
    same(df, str(tmp_path), ORACLES["op12_radix_tries"])
    # little room: prefixes get longer, copies of the hot text go in pieces, tasks send tries on
    masks = interaction.failed_masks(spark.read.parquet(str(tmp_path / "documents.parquet")), marks, limit=4_000)
    assert {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in interaction.audited(masks).collect()} == want


def test_prefixes_adapt(spark):
    shared_ = [(i, "passage " * 500 + str(i), "a") for i in range(60)]
    terminals = interaction.rows_with_labels(docs(spark, shared_ + [(100 + i, prose(i, 5), "a") for i in range(60)]), spark.createDataFrame([], LABELS)).mapInArrow(interaction._inserted(10**9), interaction.TERMINAL)
    x, _, cut = interaction.dealt(terminals, 20_000)
    depths = {r.depth: r["count"] for r in x.groupBy("depth").count().collect()}
    assert not cut and depths[4096] == 60 and sum(depths.values()) == 120
    heaviest = x.groupBy("leaf").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.max("w")).first()[0]
    assert heaviest is None or heaviest <= 20_000


def test_audit_of_nothing(spark):
    assert interaction.audited(interaction.failed_masks(docs(spark, []), spark.createDataFrame([], LABELS))).count() == 0


def test_trie_holds_every_text():
    r = random.Random(1)
    texts = [b"", b"a", b"ab", b"abc", b"abd", b"b" * 5000, b"b" * 5000 + b"c", bytes(range(256))] + [bytes(r.choices(b"ab", k=r.randrange(12))) for _ in range(500)]
    trie = Trie()
    for t in texts:
        node = trie.terminal(t)
        node.value = (node.value or 0) + 1
    assert dict(trie.terminals()) == Counter(texts) and sum(trie.values()) == len(texts)


# -- classifier ---------------------------------------------------------------


def test_margins_equal_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    model = rng.normal(0, 0.3, (factorisation.COLUMNS + 1, factorisation.RANK + 1))
    texts = ["", "one", "Two two #three", prose(1, 60)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    columns, weights, first = x = factorisation.features(data, offsets, [np.array([1, 2, 3, 31])])
    got, _ = factorisation.margins(model, x)
    for r in range(len(texts)):
        c, w = columns[first[r] : first[r + 1]], weights[first[r] : first[r + 1]]
        v = model[c, 1:]
        pairs = sum(float(v[i] @ v[j]) * w[i] * w[j] for i in range(len(c)) for j in range(i))
        assert got[r] == pytest.approx(model[-1, 0] + float(model[c, 0] @ w) + pairs)


def quality_rows():
    good = [(i, prose(i, 80 + i % 50), "a") for i in range(0, 900, 3)]
    junk = [(i, " ".join(w + "###" for w in prose(i, 60 + i % 50).split()), "a") for i in range(1, 900, 3)]
    loops = [(i, " ".join([f"w{i}"] * 90), "b") for i in range(2, 900, 3)]
    return good, junk, loops


def test_classifier_on_held_out_rows(spark, tmp_path):
    good, junk, loops = quality_rows()
    rows = good + junk + loops
    labels = [(i, 1, 0) for i, *_ in good] + [(i, 0, 0) for i, *_ in junk + loops]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(*x, "x") for x in labels], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id: r for r in QUERIES["op11_factorisation_machine"](spark, str(tmp_path)).collect()}
    want = {i: q for i, q, _ in labels}
    out = [i for i in want if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(got) == len(rows) and {i for i, r in got.items() if r.held_out} == set(out)
    assert np.mean([got[i].predicted == want[i] for i in out]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    # labels of held-out rows are not read, and runs agree
    flipped = [(i, 1 - q if i in set(out) else q, 0, "x") for i, q, _ in labels]
    spark.createDataFrame(flipped, LABELS).write.parquet(str(tmp_path / "other" / "labels.parquet"))
    docs(spark, rows).write.parquet(str(tmp_path / "other" / "documents.parquet"))
    again = {r.doc_id: r.score for r in QUERIES["op11_factorisation_machine"](spark, str(tmp_path / "other")).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_classifier_on_odd_tables(spark):
    long = prose(5, 30_000)
    rows = [(None, "null id", None), (1, None, "a"), (2, "", "a"), (3, " \t\n", "a"), (4, "x", None), (4, "x", None), (5, long, "a"), (6, "é▁😀\u0000" * 30, "b")]
    d = docs(spark, rows)
    y = lambda *p: spark.createDataFrame(list(p), "doc_id long, y int")
    for labels, share in ((y(), 0.5), (y((1, 1), (None, 0), (2, None), (3, 7)), 2 / 3)):
        got = factorisation.scored(d, factorisation.trained(d, labels)).collect()
        assert len(got) == len(rows) and all(r.score == pytest.approx(share) for r in got)
    got = factorisation.scored(d, factorisation.trained(d, y((1, 0), (4, 1), (4, 1), (4, 0), (5, 1)))).collect()
    assert len(got) == len(rows) and len({r.score for r in got if r.doc_id == 4}) == 1
    assert factorisation.scored(docs(spark, []), factorisation.trained(docs(spark, []), y())).collect() == []
    none = d.withColumn("n_chars", F.lit(None).cast("long"))
    assert len(factorisation.scored(none, factorisation.trained(none, y((1, 0), (5, 1)))).collect()) == len(rows)
