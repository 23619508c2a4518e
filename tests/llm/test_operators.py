"""Each operator against brute force, the library it must agree with, or DuckDB."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from oracle import same
from pyspark.sql import functions as F

from marlstone.llm import exact, licenses, lines, lm, mixing, near, pieces, pii, quality, sharding
from marlstone.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASH = ", row string, size string, sha string, k1 string, comp string, ord string, w string, kept string, h string, p string, fp string, rid string"


def docs(spark, rows, clash=False):
    extra = ("x",) * 12 if clash else ()
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), *extra) for i, t, lang, s in rows], COLUMNS + (CLASH if clash else ""))


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


LONG = words(0, 30_000)
ODD = [
    (None, "null id " + words(1, 60), "en", "a"), (1, None, "en", "a"), (2, "", None, None), (3, " \t\n\x0b\x0c\r ", "en", None), (4, "one", "xx", "b"), (5, "one two", "en", "b"),
    (6, LONG, "en", "a"), (7, LONG + " tail", "en", "a"), (8, words(2, 80), "en", "a"), (8, words(2, 80), "en", "a"), (9, words(2, 80), None, "c"), (10, "é▁\u0000😀\u0085 x" * 20, "fr", "c"),
    (11, "A@b.example.org 10.0.0.1 4111 1111 1111 1111 +1 (555) 123-4567", "en", "a"), (12, "Licensed under the MIT License.", "en", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD, clash=True)


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [], clash=True)


def test_every_query_against_duckdb(spark):
    for name, f in QUERIES.items():
        df = f(spark, SF)
        if name in ORACLES:
            same(df, SF, ORACLES[name])
        else:
            assert df.count() == 200, name


@pytest.mark.parametrize("f", [
    quality.judged, quality.good_documents, sharding.sharded, mixing.mixed, exact.labelled, exact.distinct_documents, near.labelled, near.one_of_each,
    lines.labelled, lines.cleaned, pii.personal_data, licenses.licensed, pieces.segmented, lambda d: lm.scored(d, lm.trained(d)),
])
def test_odd_and_empty_tables(f, odd, empty):
    got = f(odd).collect()
    assert 0 < len(got) <= 3 * len(ODD)
    assert f(empty).collect() == []
    if f in (quality.good_documents, mixing.mixed, exact.distinct_documents, near.one_of_each, lines.cleaned):
        assert f(odd).columns == odd.columns


def test_quality_counts_and_outliers(spark):
    base = [(i, words(i, 200), "en", "s") for i in range(300)]
    junk = [(1000 + i, " ".join(f"w{k}###" for k in range(100)), "en", "s") for i in range(5)]
    got = {r.doc_id: r for r in quality.judged(docs(spark, base + junk + [(2000, "a b c " * 40, "en", "s")]), carry=("doc_id",)).select("row.doc_id", "*").collect()}
    assert all(got[i].kept for i, *_ in base) and not any(got[i].kept for i, *_ in junk)
    assert got[2000].n_repeat_words == 120 and got[2000].base_failed and not got[2000].kept
    for i, t, *_ in base[:20]:
        w = WORD.findall(t)
        c = Counter(zip(w, w[1:], w[2:]))
        assert got[i].n_repeat_words == len({p + k for p in range(len(w) - 2) if c[tuple(w[p : p + 3])] > 1 for k in range(3)})


def test_quality_thresholds_are_each_groups_own(spark, tmp_path):
    """Long words are usual in one source and reject a document elsewhere; a
    group of a few rows is judged by its language's fences."""
    plain = lambda i: " ".join(f"w{random.Random(i * 997 + k).randrange(400)}" for k in range(80))
    long = lambda i: " ".join(f"compound{random.Random(i * 997 + k).randrange(400)}word" for k in range(80))
    rows = [(i, plain(i), "en", "news") for i in range(600)] + [(1000 + i, long(i), "en", "chem") for i in range(400)]
    rows += [(2000, long(1), "en", "news"), (2001, plain(2), "en", "few"), (2002, long(3), "de", None), (2003, plain(5), "en", "chem")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    df = QUERIES["op2_quality_rules"](spark, str(tmp_path))
    kept = {r.doc_id: r.kept for r in df.collect()}
    assert all(kept[i] for i in range(600)) and all(kept[1000 + i] for i in range(400))
    assert not kept[2000] and not kept[2003] and kept[2001]
    same(df, str(tmp_path), ORACLES["op2_quality_rules"])


def test_quality_fences_follow_their_groups(spark):
    """A share of capitals that is usual in one source is an outlier in another,
    and a source without outliers has no fence."""
    shout = lambda i, every: " ".join(w.upper() if k % every == i % every else w for k, w in enumerate(words(i, 120).split()))
    rows = [(i, words(i, 100 + i % 40), "en", "quiet") for i in range(500)] + [(1000 + i, shout(i, 3), "en", "loud") for i in range(500)]
    rows += [(2000 + i, shout(i, 3), "en", "quiet") for i in range(6)] + [(3000 + i, shout(i, 1), "en", "loud") for i in range(6)] + [(4000 + i, words(i, 100), "fr", "plain") for i in range(300)]
    m = quality.with_ratios(quality.written(quality.measured(docs(spark, rows), ("doc_id",)), "measured"))
    got = {r.g_source: r for r in quality.fences(quality.written(quality.sketches(m), "sketches")).collect()}
    assert got["quiet"].hi_upper_milli < 170 < got["loud"].hi_upper_milli < 500
    assert got["quiet"].hi_symbol_milli is None and got["plain"].hi_dup_milli is None
    kept = {r.doc_id: r.kept for r in quality.judged(docs(spark, rows), carry=("doc_id",)).select("row.doc_id", "kept").collect()}
    assert not any(kept[2000 + i] or kept[3000 + i] for i in range(6))
    assert np.mean([kept[i] for i in kept if i < 2000 or i >= 4000]) > 0.98


def test_quality_sketches_of_a_large_table(spark):
    """Sums of events of some millions of documents, as whole numbers."""
    rows = [("en", "a", "dup_milli", 0, 2_500_000, 215_000_000_000), ("en", "b", "dup_milli", 0, 7, 7_000_000), ("en", "b", "dup_milli", 248, 15_000, 930_000_000), ("fr", None, "dup_milli", 0, 10, 10_000_000)]
    sk = spark.createDataFrame(rows, "lang string, source string, ratio string, bucket long, n long, e long")
    one, lot = quality.ROW, quality.BORROWED
    every, total = Counter(), sum(r[4] for r in rows)
    for *_, bucket, n, e in rows:
        every.update({(bucket, 0): n, (bucket, 1): e})
    lang = Counter({("en", *k): one * lot * v // total for k, v in every.items()} | {("fr", *k): one * lot * v // total for k, v in every.items()})
    for l, _, _, bucket, n, e in rows:
        lang.update({(l, bucket, 0): one * n, (l, bucket, 1): one * e})
    want = Counter()
    for l, source in {r[:2] for r in rows}:
        own = sum(r[4] for r in rows if r[0] == l)
        want.update({(l, source, *k[1:]): lot * v // (own + lot) for k, v in lang.items() if k[0] == l})
    for l, source, _, bucket, n, e in rows:
        want.update({(l, source, bucket, 0): one * n, (l, source, bucket, 1): one * e})
    got = {(r.lang, r.source, r.bucket): (r.w, r.e) for r in quality.pooled(sk).collect()}
    assert got == {k[:3]: (float(want[*k[:3], 0]), float(want[*k[:3], 1])) for k in want if want[*k[:3], 0] > 0}
    assert quality.fences(sk).count() == 3


def test_shards_move_only_into_what_grows(spark):
    ids = docs(spark, [(i, "t", "en", "s") for i in range(5000)])
    got = sharding.sharded(ids).collect()
    assert {r.shard for r in got} == set(range(24))
    assert all(r.grown_shard in (r.shard, 24) for r in got) and 100 < sum(r.grown_shard == 24 for r in got) < 320
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.text_crc32 == zlib.crc32(b"t") and r.size == 9 for r in got)


def test_heavier_subtree_only_takes(spark):
    t = sharding.tree(24)
    heavier = t | {"/": [(c, w + (c == "/r1")) for c, w in t["/"]]}
    keys = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    got = keys.select(sharding.shard_of(F.col("k"), t).alias("a"), sharding.shard_of(F.col("k"), heavier).alias("b")).where("a != b").collect()
    assert got and all(12 <= r.b < 24 and r.a < 12 for r in got)


def test_mix_meets_targets(spark):
    rows = [(i, words(i, 20 + i % 50), "en", s) for i, s in enumerate(["a"] * 300 + ["b"] * 300 + ["c"] * 30)]
    sized = docs(spark, rows).select("source", mixing.n_words(F.col("text")).alias("size"), "doc_id", "text")
    per = {r.source: r for r in mixing.shares(sized.withColumn("ord", mixing.order_key(F.col("doc_id"), F.col("size"), F.col("text")))).collect()}
    total = sum(len(WORD.findall(t)) for _, t, *_ in rows)
    assert per["c"].target == 3 * per["c"].source_size
    left = total - per["c"].target
    assert per["a"].target == pytest.approx(left / 3) and per["b"].target == pytest.approx(left * 2 / 3)
    taken = Counter()
    copies = Counter()
    for r in mixing.mixed(docs(spark, rows)).collect():
        taken[r.source] += len(WORD.findall(r.text))
        copies[r.doc_id] += 1
    assert all(abs(taken[s] - per[s].target) <= 150 for s in "abc") and sum(taken.values()) <= total and max(copies.values()) <= 3


def test_mix_of_repeated_rows(spark, tmp_path):
    """Repeats are passed one by one: by brute force, and as in DuckDB."""
    rng = random.Random(8)
    rows = [(1, words(1, 90), "en", "a")] * 40 + [(2, words(2, 70), "en", "b")] * 25 + [(2, words(3, 70), "en", "b")] * 5
    rows += [(100 + i, words(i, rng.randint(1, 60)), "en", rng.choice("abc")) for i in range(90)] + [(7, None, "en", None), (7, " ", "en", "c"), (8, "one", "en", None)]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    df = QUERIES["op5_weighted_fair_queue"](spark, str(tmp_path))
    same(df, str(tmp_path), ORACLES["op5_weighted_fair_queue"])
    got = df.collect()
    assert len(got) == len(rows)
    for s in ("a", "b", "c", None):
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 90 and all(r.taken <= 3 * r.size for r in own)
    assert {len({r.times for r in got if r.doc_id == i}) for i in (1, 2)} <= {1, 2}
    budget = sum(len(WORD.findall(t or "")) for _, t, *_ in rows)
    assert budget - 4 * 90 <= sum(r.taken for r in got) <= budget
    assert sum(len(WORD.findall(r.text or "")) for r in mixing.mixed(docs(spark, rows)).collect()) == sum(r.taken for r in got)


@pytest.mark.parametrize(("bits", "run"), [(48, exact.RUN), (6, exact.RUN), (48, 7)])
def test_exact_copies_by_brute_force(spark, bits, run):
    rows = [(i, f"text {i % 37}" if i % 3 else f"own {i}", "en", "s") for i in range(400)] + [(7, None, "en", "s"), (9, "", "en", "s")]
    got = exact.labelled(docs(spark, rows), bits=bits, rows_per_owner=10, run=run).collect()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    want = Counter((i, max(groups[t or ""]), len(groups[t or ""])) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups) == exact.distinct_documents(docs(spark, rows), bits=bits).count()


def test_rice_round_trip():
    rng = np.random.default_rng(1)
    for n, top in ((1, 1), (5, 10), (1000, 2**48), (3000, 4000)):
        v = np.unique(rng.integers(0, top, n))
        assert (exact.rice_decode(len(v), *exact.rice_encode(v)) == v).all()


def edited(rng, w, n):
    w = list(w)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.random()}"
    return w


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_groups_by_brute_force(spark, width, percent):
    rng = random.Random(5)
    texts = [words(i, rng.randint(2, 120), 5000).split() for i in range(60)]
    hub = words(999, 100, 5000).split()  # a group far larger than a leaf
    texts += [edited(rng, hub, rng.randint(0, 5)) for _ in range(150)]
    for i in range(40):
        texts.append(edited(rng, texts[i], rng.randint(0, 3)))
    rows = [(i, " ".join(w), "en", "s") for i, w in enumerate(texts)]
    sets = [{tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or {tuple(w)} for w in texts]
    root = list(range(len(sets)))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in combinations(range(len(sets)), 2):
        i = len(sets[a] & sets[b])
        if 100 * i >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.doc_id: r for r in near.labelled(docs(spark, rows), width, percent).collect()}
    assert [got[i].component_id for i in range(len(sets))] == [find(i) for i in range(len(sets))]
    assert [got[i].n_shingles for i in range(len(sets))] == [len(s) for s in sets]
    kept = {r.doc_id for r in near.one_of_each(docs(spark, rows), width, percent).collect()}
    assert kept == {find(i) for i in range(len(sets))}


def test_near_trees_reach_the_recall_at_their_last_depth():
    import pyarrow as pa

    share = [f"t{k}" for k in range(74)]  # a template: all texts are 0.7 similar, pairs 0.80
    texts = [" ".join(share + [f"b{i}.{k}" for k in range(6)] + [f"o{i}.{j}.{k}" for k in range(10)]) for i in range(300) for j in (0, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(range(600)), pa.array(texts)], names=["rid", "doc_id", "text"])
    signed = pa.Table.from_batches(near._signer(1, 80)([batch]))
    paths = np.array(signed["paths"].to_pylist())
    deep = paths[:, [k for k, (_, j) in enumerate(near._levels(80)) if j == len(near.DEPTHS) - 1]]
    met = deep[::2] == deep[1::2]
    assert met.any(axis=1).all() and not met[:, :16].any(axis=1).all()  # 16 trees lose pairs
    for percent in (80, 85, 95):
        for d, (_, trees) in zip(near.DEPTHS, near._trees(percent)):
            assert (1 - (percent / 100) ** d) ** trees <= 1e-6
    assert near._trees(85)[-1][1] == 36 and near._trees(80)[-1][1] == 59 and near._trees(100)[-1][1] == 1


def test_overlaps_by_brute_force():
    rng = np.random.default_rng(3)
    core = rng.integers(-(2**63), 2**63 - 1, 60)
    sets = [np.unique(np.concatenate([rng.choice(core, 50, replace=False), rng.integers(0, 400, rng.integers(1, 60))])) for _ in range(70)]
    got = near._overlaps(sets)
    assert (got == np.array([[len(np.intersect1d(a, b)) * (i != j) for j, b in enumerate(sets)] for i, a in enumerate(sets)])).all()
    assert near._overlaps([np.array([5]), np.array([5])]).tolist() == [[0, 1], [1, 0]]


def test_near_groups_of_a_cluster_about_the_threshold(spark, monkeypatch):
    """Copies with so many edits that most pairs lie below the threshold, in a
    node of several tiles."""
    monkeypatch.setattr(near, "BLOCK", 60)
    rng = random.Random(15)
    hub = words(77, 200, 9000).split()
    texts = [" ".join(edited(rng, hub, rng.randint(3, 5))) for _ in range(260)]
    sets = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in map(str.split, texts)]
    root = list(range(len(sets)))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in combinations(range(len(sets)), 2):
        i = len(sets[a] & sets[b])
        if 100 * i >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert 10 < len({find(i) for i in range(len(sets))}) < 250
    got = {r.doc_id: r.component_id for r in near.labelled(docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), 3, 85).collect()}
    assert [got[i] for i in range(len(sets))] == [find(i) for i in range(len(sets))]


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert {r.node: r.comp for r in near.components(e).collect()} == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def maximal_runs(rows):
    """Lines to delete, by comparing every line with every earlier one and
    following each match to both its ends."""
    texts = [[(p, x, len(WORD.findall(x))) for p, x in enumerate((t or "").split("\n")) if WORD.search(x)] for _, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0]))]
    gone = []
    for n, later in enumerate(texts):
        out = set()
        for m in range(n + 1):
            for a in range(len(later)):
                for b in range(len(texts[m]) if m < n else a):
                    if later[a][1] != texts[m][b][1] or (a and b and later[a - 1][1] == texts[m][b - 1][1]):
                        continue
                    k = 0
                    while a + k < len(later) and b + k < len(texts[m]) and later[a + k][1] == texts[m][b + k][1]:
                        k += 1
                    if sum(x[2] for x in later[a : a + k]) >= lines.MIN_WORDS:
                        out |= set(range(later[a][0], later[a + k - 1][0] + 1))
        gone.append(out)
    return gone


def test_line_runs_by_brute_force(spark, tmp_path):
    rng = random.Random(3)
    pool = [words(1000 + i, rng.randint(1, 60)) for i in range(40)]
    rows = [(0, "\n".join(pool[:9]), "en", "s"), (1, "\n".join(pool[:12]), "en", "s"), (2, "\n".join(pool[:12]), "en", "s"), (3, None, "en", "s"), (4, "\n".join([pool[1]] * 70), "en", "s")]
    for i in range(5, 90):
        k = rng.randrange(35)
        own = [words(5000 + 10 * i + j, rng.randint(1, 30)) for j in range(rng.randint(0, 5))]
        rows.append((i, "\n".join(own[:2] + pool[k : k + rng.randint(0, 8)] + [""] * (i % 2) + own[2:] + ["All news"] * (i % 3)), "en", "s"))
    five = "\n".join([words(7001, 40), words(7002, 20), words(7003, 9), "Signed, the editor", "All news"])
    rows += [(200, five, "en", "s"), (201, five, "en", "s")]
    want = {i: "\n".join(x for p, x in enumerate((t or "").split("\n")) if p not in g) for (i, t, *_), g in zip(rows, maximal_runs(rows))}
    assert want[201] == ""
    got = {r.doc_id: r.text for r in lines.cleaned(docs(spark, rows)).collect()}
    assert {i: t or "" for i, t in got.items()} == want
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    same(QUERIES["op8_line_winnowing"](spark, str(tmp_path)), str(tmp_path), ORACLES["op8_line_winnowing"])


def test_repeated_rows_and_null_ids_lose_their_lines_once(spark):
    t = "\n".join(words(i, 30) for i in range(3))
    got = sorted(lines.cleaned(docs(spark, [(None, t, "en", "s"), (1, t, "en", "s"), (1, t, "en", "s"), (None, t, "en", "s")])).collect(), key=lambda r: -len(r.text))
    assert got[0].text == t and got[0].doc_id is None and [r.text for r in got[1:]] == ["", "", ""]


def brute_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]


def test_personal_data_by_brute_force(spark):
    rng = random.Random(9)
    bits = ["a@b.co", "x%y@z.org%c@d.net", "@", "@@a@b.c.d", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", "+12", "é", " ", ".", "-", "7", "99", "a.b", "+49 30 1234567 "]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(1, 9)))
        assert [f[:3] for f in pii.find(t) if f[0] in pii.BASE] == brute_spans(t), t
    r = pii.personal_data(docs(spark, [(1, "pay DE89 3704 0044 0532 0130 00 now, a@b.co", "de", "s")])).first()
    assert r.base_sha256 == hashlib.sha256(b"email:37:43").hexdigest() and [f.kind for f in r.found] == ["email", "iban"]
    assert [f[0] for f in pii.find("call my phone (555) 123-4567")] == ["local_phone"] and pii.find("part (555) 123-4567") == []


def test_personal_data_is_linear():
    for t in ("1" * 200_000, "a" * 200_000, "+1" + " " * 200_000, "1." * 100_000, "a.b@" * 50_000, "tel (555) 123-4567, a@b.co " * 40_000, "DE89 " * 100_000):
        pii.find(t)


def test_further_kinds_end_where_they_must_and_do_not_overlap():
    assert [f[:3] for f in pii.find("IBAN DE89 3704 0044 0532 0130 00 PLEASE PAY")] == [("iban", 5, 32)]
    assert [f[0] for f in pii.find("GB82WEST12345698765432, NO9386011117947; DE89370400440532013001")] == ["iban", "iban"]
    for t in ("call tel 123-45-6789 123-45-6789", "phone 555-123-4567 555-123-4567, ssn 123-45-6789", "iban DE89370400440532013000 tel 370-400-4405"):
        spans = sorted((a, z) for k, a, z, _ in pii.find(t) if k not in pii.BASE)
        assert all(z <= a for (_, z), (a, _) in zip(spans, spans[1:])), t
    taken = pii._Taken([(5, 9), (0, 2), (8, 12)])
    assert (taken.starts, taken.ends) == ([0, 5], [2, 12])
    assert [taken.take(*s) for s in ((2, 5), (4, 6), (11, 13), (12, 14), (13, 13 + 1))] == [True, False, False, True, False]


def test_no_tile_lies_within_one_component(spark):
    rng = np.random.default_rng(4)
    rows, base = [], rng.integers(1, 2**60, 90)
    for i in range(1500):  # one component of three blocks, and a few members of others
        rows.append((7, i, 90, 0 if i < 1480 else 1480 + i % 5, np.unique(np.concatenate([base[: 80 if i < 1480 else 88], rng.integers(1, 2**60, 10 if i < 1480 else 2)])).tolist()))
    rows += [(8, i, 90, 0, rows[i][4]) for i in range(600)]  # all joined: nothing to do
    large = spark.createDataFrame(rows, "p long, node long, n int, comp long, shingles array<long>")
    got = {(r.a, r.b) for r in near._tiles(large, 80).collect()}
    sets, comp = {r[1]: set(r[4]) for r in rows if r[0] == 7}, {r[1]: r[3] for r in rows if r[0] == 7}
    want = {(a, b) for a in range(1480, 1500) for b in range(a) if comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert got == want and want


#: Texts with the licences that a reader finds in them, by hand.
READ = [
    ("Licensed under the MIT License", {"MIT"}), ("The MIT License (MIT)", {"MIT"}), ("licensed under the terms of the MIT license", {"MIT"}), ("License: MIT", {"MIT"}),
    ("SPDX-License-Identifier: MIT", {"MIT"}), ("SPDX-License-Identifier:MIT", {"MIT"}), ("/* SPDX-License-Identifier: MIT */", {"MIT"}), ("SPDX-License-Identifier: GPL-3.0-or-later", {"GPL-3.0-or-later"}),
    ("SPDX-License-Identifier: GPL-2.0+", {"GPL-2.0-or-later"}), ("# SPDX-License-Identifier: Apache-2.0 OR MIT", {"Apache-2.0", "MIT"}), ("SPDX-License-Identifier: (BSD-3-Clause AND Zlib) OR MPL-2.0", {"BSD-3-Clause", "Zlib", "MPL-2.0"}),
    ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", {"GPL-2.0-only"}), ("spdx-license-identifier: apache-2.0 and some words under the MIT license", {"Apache-2.0"}), ("SPDX-License-Identifier: LicenseRef-Own", set()),
    ("BSD 3-Clause License", {"BSD-3-Clause"}), ("Released under the BSD 2-Clause License", {"BSD-2-Clause"}), ("Distributed under the BSD license", {"BSD"}), ("Boost Software License - Version 1.0", {"BSL-1.0"}),
    ("Eclipse Public License - v 2.0", {"EPL-2.0"}), ("This is free and unencumbered software released into the public domain", {"Unlicense"}), ("released under The Unlicense", {"Unlicense"}), ("Mozilla Public License, v. 2.0", {"MPL-2.0"}),
    ("Creative Commons Attribution 3.0 Unported", {"CC-BY-3.0"}), ("Creative Commons Attribution-ShareAlike 4.0 International", {"CC-BY-SA-4.0"}), ("CC BY-NC-SA 3.0", {"CC-BY-NC-SA-3.0"}), ("CC0 1.0 Universal", {"CC0-1.0"}), ("Available under CC BY-ND 4.0", {"CC-BY-ND-4.0"}),
    ("GNU General Public License, version 3", {"GPL-3.0"}), ("GNU General Public License v2.0 or later", {"GPL-2.0-or-later"}), ("GPLv3+", {"GPL-3.0-or-later"}), ("under the GNU Lesser General Public License, version 2.1", {"LGPL-2.1"}), ("version 2 of the GNU General Public License", {"GPL-2.0"}),
    ("GNU Affero General Public License version 3", {"AGPL-3.0"}), ("under the terms of the GNU General Public License", {"GPL"}),
    ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", {"GPL-3.0-or-later"}),
    ("See the GNU General Public License for more details", set()), ("Licensed under the MIT License and the Apache License, Version 2.0", {"MIT", "Apache-2.0"}), ("Apache Licence, version 2.0", {"Apache-2.0"}),
    ("not licensed under the MIT License", set()), ("It is no longer available under CC BY 4.0", set()), ("is not, and never was, licensed under the MIT License", set()), ("not yet released under the BSD license but under the MIT license", {"MIT"}),
    ("A licence of another kind is needed", set()), ("All rights reserved", set()), ("Copyright (c) 2019 A. Nobody", set()), ("Nothing here", set()), ("A reserved seat", set()), ("der Tee mit Milch und cc", set()), ("", set()), ("Permission is required", set()),
]


def licences_of(spark, texts):
    rows = licenses.licensed(docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    return [set(r.licenses) for r in rows], rows


def test_licences_as_a_reader_finds_them(spark):
    got, rows = licences_of(spark, [t + "." for t, _ in READ])
    assert [(t, g) for (t, _), g in zip(READ, got)] == READ
    unknown = {t: r.n_unknown for (t, _), r in zip(READ, rows)}
    assert unknown["A licence of another kind is needed"] == unknown["SPDX-License-Identifier: LicenseRef-Own"] == unknown["Permission is required"] == 1 and unknown["Nothing here"] == 0


def test_licences_of_mixed_texts(spark, tmp_path):
    """Sentences at random, by line and wrapped: what each names is united."""
    rng = random.Random(21)
    rows, want = [], []
    for i in range(300):
        some = [rng.choice(READ) for _ in range(rng.randint(1, 7))]
        wrapped = lambda t: t if "SPDX" in t.upper() else " ".join(rng.choice([w, w + "\n"]) if rng.random() < 0.2 else w for w in t.split(" ")).replace("\n ", "\n")
        rows.append((i, "".join(wrapped(t) + rng.choice([".\n", ". "] if "SPDX" not in t.upper() else [".\n\n"]) for t, _ in some), "en", "s"))
        want.append({x for _, names in some for x in names})
    docs(spark, rows + [(500, None, "en", "s"), (501, "", "en", "s")]).write.parquet(str(tmp_path / "documents.parquet"))
    df = QUERIES["op10_license_rules"](spark, str(tmp_path))
    got = {r.doc_id: set(filter(None, r.licenses.split(","))) for r in df.collect()}
    assert [(t, got[i]) for i, t, *_ in rows] == [(t, w) for (_, t, *_), w in zip(rows, want)]
    assert got[500] == got[501] == set()
    same(df, str(tmp_path), ORACLES["op10_license_rules"])


def test_licence_texts(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that:\nRedistributions of source code must retain the above copyright\nnotice. Redistributions in binary form must reproduce the above copyright notice."
    mit = 'Copyright (c) 2020 A\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY. IN NO EVENT SHALL THE AUTHORS BE LIABLE.'
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 2 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY. See the\nGNU General Public License for more details.\n"
    got, rows = licences_of(spark, [bsd, bsd + " Neither the name may be used to endorse or promote products derived from it.", mit, gpl, "x\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.", "Text by CC BY\n4.0.", "Licensed under the Apache License,\nVersion 2.0.\nYou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\nhttp://x\n"])
    assert got[0] == {"BSD-2-Clause"} and got[1] == {"BSD-3-Clause"} and got[2] == {"MIT"} and got[4] == {"CC-BY-NC-4.0", "MIT"} and got[5] == {"CC-BY-4.0"} and got[6] == {"Apache-2.0"}
    assert "GPL-2.0-or-later" in got[3]
    assert rows[4].by_line == "MIT;CC-BY-NC-4.0;"


def test_licence_gate_lets_every_name_through():
    low = [n for n in licenses.NAMES] + list(licenses.WHOLE)
    assert all(any(w in n for w in licenses.NEEDED) or re.search(licenses._CC_GATE, n) for n in low)


def test_pieces_equal_the_library():
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.MODEL)
    t = pieces.Transducer(pieces.load())
    rng = random.Random(2)
    alphabet = "aeiou thnsr.,\n\t'-éßABC0123▁{}()=_日本😀"
    texts = ["", " ", "  a  b", "<s> <unk> <0x0A>", "aaaaaaaaaaaaaaaa", " " * 70, "\x00é", words(4, 500), Path(__file__).read_text()]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(800)]
    many = [np.frombuffer(x, np.int32).tolist() for x in t.encode_all(texts)]
    assert many == [np.frombuffer(t.encode(x), np.int32).tolist() for x in texts] == sp.encode(texts)
    assert [t.decode(x) for x in many] == [sp.decode(x) for x in many] == [x.replace("▁", " ") for x in texts]
    for _ in range(500):
        ids = [rng.randint(3, 600) for _ in range(rng.randint(1, 12))]
        assert t.decode(ids) == sp.decode(ids)


def message(*fields):
    """A protocol-buffer message of (number, int, float, str or bytes)."""
    import struct

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for k, v in fields:
        if isinstance(v, float):
            out += varint(k << 3 | 5) + struct.pack("<f", v)
        elif isinstance(v, int):
            out += varint(k << 3) + varint(v)
        else:
            v = v.encode() if isinstance(v, str) else v
            out += varint(k << 3 | 2) + varint(len(v)) + v
    return out


@pytest.mark.parametrize(("fallback", "squeeze"), [(1, 1), (0, 1), (1, 0), (0, 0)])
def test_unigram_pieces_equal_the_library(fallback, squeeze):
    """The shortest path over scores, with and without byte fallback and the
    squeezing of spaces, for a model written by hand."""
    spm = pytest.importorskip("sentencepiece")
    rng = random.Random(31)
    text = [c for c in "aeinrst"] + ["an", "en", "in", "st", "er", "▁", "▁a", "▁the", "ing", "▁st", "é", "ter", "▁in", "▁an"]
    pieces_ = [message((1, "<unk>"), (2, 0.0), (3, 2)), message((1, "<s>"), (2, 0.0), (3, 3)), message((1, "</s>"), (2, 0.0), (3, 3))]
    pieces_ += [message((1, f"<0x{b:02X}>"), (2, 0.0), (3, 6)) for b in range(256)] if fallback else []
    pieces_ += [message((1, p), (2, -1.0 - rng.random() * 6 - 0.001 * i)) for i, p in enumerate(text)]
    model = b"".join(message((1, p)) for p in pieces_) + message((2, message((3, 1), (35, fallback)))) + message((3, message((1, "identity"), (3, 1), (4, squeeze))))
    sp = spm.SentencePieceProcessor(model_proto=model)
    t = pieces.Transducer(model)
    alphabet = "aeinrst  thg é日x\n"
    texts = ["", " ", "  a  in ", "the string", "x", "xx yy", "日日", "a" * 60] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 50))) for _ in range(400)]
    many = [np.frombuffer(b, np.int32).tolist() for b in t.encode_all(texts)]
    assert many == sp.encode(texts)
    assert [t.decode(ids) for ids in many] == [sp.decode(ids) for ids in many]


def test_pieces_round_trip_in_spark(spark, odd):
    model = pieces.load()
    back = {r.doc_id: r.text for r in pieces.decoded(pieces.encoded(odd, model), model).where("doc_id != 8").collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t, *_ in ODD if i != 8 and i is not None} | ({None: back[None]} if None in back else {})
    assert all(r.round_trip for r in pieces.segmented(odd).collect())


def test_scores_by_brute_force(spark):
    """Base score and score from plain counts, on both paths."""
    rng = random.Random(12)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(60)), "en", "s") for i in range(160)] + [(270, None, "en", "s"), (None, "W1 w2", "en", "s"), (271, "w1 w2 w1", "en", "s"), (271, "w1 w2 w1", "en", "s")]
    d = docs(spark, rows)
    model = lm.trained(d)
    toks = [(i, ["<s>"] + WORD.findall((t or "").translate(LOWER)) + [None]) for i, t, *_ in rows]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(w for i, ts in toks if not out(i) for w in ts[1:])
    n, v = sum(c.values()), len(c)
    value = {p: int(lm._VALUE[x.bit_length()]) for p, x in Counter(p for i, ts in toks if not out(i) for p in zip(ts, ts[1:])).items()}
    assert max(value.values()) > 20 and 1 in value.values()
    mass = Counter()
    for (h, _), x in value.items():
        mass[h] += x
    p = lambda h, w: (value.get((h, w), 0) + lm.MU * (c[w] + 1) / (n + v + 1)) / (mass[h] + lm.MU)
    for limits in ((), (0,), (10**9, 0)):
        got = sorted(lm.scored(d, model, *limits).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
        for r, (i, ts) in zip(got, sorted(toks, key=lambda x: (x[0] is None, x[0])), strict=True):
            assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i, out(i), len(ts) - 1, sum(c[w] > 0 for w in ts[1:]), n)
            assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ts[1:]), rel=1e-9)
            # levels may be read too high, which few are
            assert r.score == pytest.approx(sum(math.log10(p(h, w)) for h, w in zip(ts, ts[1:])), rel=0.02)


def test_scores_by_exchange(spark, odd, empty, monkeypatch):
    """What chunks ask buckets for gives the scores of the broadcast model, with
    and without words that follow a frequent one."""
    rng = random.Random(13)
    rows = [(i, " ".join("the" if rng.random() < 0.3 else f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(90))), "en", "s") for i in range(300)] + [(770, None, "en", "s"), (None, "W1 w2", "en", "s"), (771, "w1 w2 w1", "en", "s"), (771, "w1 w2 w1", "en", "s")]
    monkeypatch.setattr(lm, "WORD_BUCKET_BYTES", 1000)
    for d in (docs(spark, rows).repartition(3).localCheckpoint(), odd, empty):
        key = lambda r: (str(r.doc_id), r.n_tokens, r.base_score)
        want, got = (sorted(x.collect(), key=key) for x in (lm.scored(d, lm.trained(d)), lm.exchanged(d)))
        assert [r[:5] for r in got] == [r[:5] for r in want]
        assert [r.base_score for r in got] == pytest.approx([r.base_score for r in want], rel=1e-9)
        off = [abs(g.score - w.score) for g, w in zip(got, want)]  # levels may be read too high, which few are
        assert all(x < 1 + 0.003 * r.n_tokens for x, r in zip(off, got)) and (len(off) < 100 or sum(x > 0.05 for x in off) < 0.2 * len(off))
    assert lm.learned(docs(spark, rows), 0).count() == len(rows)


def test_exchange_sends_and_keeps_little(spark, tmp_path, monkeypatch):
    """What a document needs of the model is not written bigram by bigram."""
    d = docs(spark, [(i, words(i, 2000, 30_000), "en", "s") for i in range(400)])
    put = []

    def kept(df, tag):
        df.write.parquet(path := str(tmp_path / f"{tag}{len(put)}"))
        put.append(path)
        return spark.read.schema(df.schema).parquet(path)

    monkeypatch.setattr(lm, "written", kept)
    assert lm.learned(d, 0).count() == 400
    text = sum(len(r.text) for r in d.collect())
    assert sum(p.stat().st_size for path in put for p in Path(path).rglob("*.parquet")) < text


def test_probabilities_after_a_word_sum_to_one(spark):
    rows = [(i, words(i, 200, 300) + " rare" * (i == 5), "en", "s") for i in range(50)]
    d = docs(spark, rows)
    model = lm.trained(d)
    sizes = model.selectExpr("max(buckets) AS buckets", "sum(octet_length(seen)) AS seen", "sum(octet_length(above)) AS above", "sum(n_tokens) AS n", "sum(n_unigrams) AS v").first()
    table, at_start = lm.word_table(model)
    s = lm._gathered(model, table, sizes, sizes.n, sizes.v, at_start)
    every = np.array([r.k for r in table.select("k").collect()] + [12345], np.uint64)  # and an unknown word
    assert len(every) == sizes.v + 1
    for h in [lm.START >> lm._KEEP, np.uint64(999), *every[:200]]:
        _, _, p = s.probabilities(np.full(len(every), h, np.uint64), every)
        assert p.sum() == pytest.approx(1, abs=1e-6)


def test_filter_never_reads_too_low():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 2**lm.HASH_BITS, 20_000, dtype=np.uint64))
    levels = lm.levels_of(np.exp(rng.random(len(keys)) * 8).astype(np.int64))
    seen, above = lm.filters(keys, levels)
    f = lm.Filter(1, (len(seen) // 8, len(above) // 8))
    f.put(0, seen, above)
    read = f.level(keys)
    assert (read >= levels).all() and (read == levels).mean() > 0.99
    other = rng.integers(0, 2**lm.HASH_BITS, 2_000_000, dtype=np.uint64)
    assert (f.level(other) > 0).mean() < 5e-6
    assert [int(x) for x in lm._VALUE[:7]] == [0, 1, 2, 5, 11, 22, 45]


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    clean = [(i, "\n".join(words(100 * i + k, 30, 3000) + "." for k in range(6)), "en", f"s{i % 3}") for i in range(120)]
    base = clean[0][1].split(" ")
    rows = clean + [(200 + i, clean[i][1], "en", "s0") for i in range(10)] + [(300, " ".join(edited(rng, base, 2)), "en", "s0"), (400, "short", "en", "s0")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.quality_rules(spark, d, "")
    assert {r.doc_id for r in kept.collect()} == {i for i, *_ in rows} - {400}
    once = corpus_pipeline.exact_dedup(spark, kept, "")
    assert {r.doc_id for r in once.collect()} == {i for i, *_ in clean[10:]} | {200 + i for i in range(10)} | {300}
    near_ = corpus_pipeline.near_dedup(spark, once, "")
    assert {r.doc_id for r in near_.collect()} == {i for i, *_ in clean[10:]} | {200 + i for i in range(10)}
    assert corpus_pipeline.run(spark, str(tmp_path)).where("NOT round_trip").count() == 0


def test_pipeline_of_odd_and_empty_tables(spark, tmp_path):
    """Nulls, repeated rows, clashing columns and an empty table through run()."""
    import corpus_pipeline

    good = "\n".join(words(5000 + k, 30, 3000) + "." for k in range(4))
    rows = [(None, good, "en", None), (1, None, None, "a"), (2, "", "en", "a"), (3, words(9000, 200, 4000), "en", "a"), (3, words(9000, 200, 4000), "en", "a"), (4, words(9001, 150, 4000), None, "b"), (5, LONG, "en", "b"), (6, words(9001, 150, 4000), "xx", "c")]
    for name, some in (("odd", rows), ("none", [])):
        docs(spark, some, clash=True).write.parquet(str(tmp_path / name / "documents.parquet"))
        d = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            d = stage(spark, d, "")
            assert sorted(d.columns) == sorted(docs(spark, [], clash=True).columns)
        got = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert not some and got == [] or {r.doc_id for r in got} <= {None, 3, 4, 5, 6} and all(r.round_trip for r in got)
        if some:
            once = corpus_pipeline.near_dedup(spark, corpus_pipeline.exact_dedup(spark, corpus_pipeline.quality_rules(spark, spark.read.parquet(str(tmp_path / name / "documents.parquet")), ""), ""), "")
            ids = sorted([r.doc_id for r in once.collect()], key=str)
            assert ids.count(3) == 1 and len([i for i in ids if i in (4, 6)]) == 1 and ids.count(None) == 1
