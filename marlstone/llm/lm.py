"""Language-model scores from a log-frequency Bloom filter.

Training documents' unigrams and bigrams are counted whole: tasks send sorted,
Golomb-coded hashes with their counts to buckets of the hash range, buckets add
them up.  Each bucket enters all its bigrams, those seen once too, in Bloom
filters under quantised counts: a bigram whose count has level q (1 for 1, 2 for
2 and 3, 3 from 4, and so on by powers of two) is entered q times, as (bigram, 1)
to (bigram, q).  A reader probes upwards until a probe misses and so reads back
the level, too high with a small probability and never too low.  An entry sets
``FLAGS`` bits in each of several 64-bit words: five at level 1 (32 bits per
entry; an unseen bigram is taken for a seen one about once in a million), two
above.

The probability of a word after another is ``(v + MU * p1) / (S + MU)``: v stands
for the level read, p1 is the word's add-one unigram estimate (one class for all
unknown words), and S the sum of v over what was seen after the other word.
Buckets read their own filters back to find S, so a level read too high counts
there too, and the probabilities after a word sum to 1 but for unseen bigrams
that are taken for seen ones: by V * 1e-6 / (S + MU) in the mean of V words.

Filters grow with the number of bigrams.  Over little text, and where they and
the exact table of words (counts for the base score, S) stay below counted bounds,
they are broadcast.  Over more, :func:`exchanged` builds and probes them in their
bucket, and documents ask for what they need, chunk by chunk.  A model that was
made elsewhere and is beyond the bounds is joined bigram by bigram (:func:`scored`),
which takes many times the text's size of disk.

Edge cases: a null text has the end token only; a null doc_id is crc32 of an
empty string and trains; rows that repeat train and are scored each; with no
training tokens every probability is 1 / (V + 1) = 1; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import documents, give_back, shipped, tidy, written
from .exact import rice_decode, rice_encode
from .hashing import mix, slices, word_hashes

FOLDS, HELD_OUT = 7, 2
#: Weight of the unigram estimate, in counts.
MU = 100.0
#: Bits and 64-bit words per entry, at level 1 and above.
BITS, WORDS = (32, 16), (5, 2)
FLAGS = 4
#: What may be broadcast: bytes of all filters, words of the exact table.
BROADCAST_BYTES = 320_000_000
BROADCAST_WORDS = 12_000_000
#: Bytes of filters that the driver gathers before it broadcasts them.
PART_BYTES = 16_000_000
#: Words of the exact table that the driver gathers at once.
RANGE_WORDS = 400_000
#: Text per bucket and n-grams gathered by a task before it sends them.
BUCKET_BYTES = 3_000_000
SEND = 800_000
#: Bytes of text tokenised, bigrams probed, and tokens gathered at once.
SCORED, PROBED, GATHERED = 300_000, 100_000, 400_000
HASH_BITS = 63  # what tells words and bigrams apart, everywhere alike
END, START = np.uint64(0x1F3A5C7E9B2D4F61), np.uint64(0x2B4D6F8193A5C7E9)

_U = np.uint64
_KEEP = _U(64 - HASH_BITS)
_STEP = _U(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(77)
_MASKS = np.bitwise_or.reduce(_U(1) << np.argsort(_rng.random((4096, 64)), axis=1)[:, :FLAGS].astype(np.uint64), axis=1)
#: What a level stands for: 0, 1, 2, 5, 11, 22, ...: its middle, by ratio.
_VALUE = np.array([0] + [int(2**q * 2**0.5 / 2 + (q == 1) * 0.5) for q in range(1, 60)], np.int64)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, of their histories, and each text's first token."""
    h, first = word_hashes(data, offsets)
    toks = np.insert(h, first[1:], END)
    at = first[:-1] + np.arange(len(first) - 1)
    hist = np.empty_like(toks)
    hist[1:] = toks[:-1]
    hist[at] = START
    return toks >> _KEEP, hist >> _KEEP, at


def bigrams(hist: np.ndarray, toks: np.ndarray) -> np.ndarray:
    return mix(hist * _U(0x9E3779B97F4A7C15) + toks) >> _KEEP


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> _U(HASH_BITS - 32)) * _U(buckets)) >> _U(32)  # by range


def _heads(k: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(k, prepend=k[:1] + _U(1)))


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Parts (keys, counts, other...) as one: sorted keys, summed counts."""
    k, c, *more = (np.concatenate(p) for p in zip(*parts, strict=True))
    order = np.argsort(k, kind="stable")
    heads = _heads(k[order])
    return k[order][heads], np.add.reduceat(c[order], heads), *(m[order][heads] for m in more)


_SENT = "bucket int, kind int, n int, shift int, unary binary, rest binary, counts binary, names binary"
_MODEL = "bucket int, n_unigrams long, n_tokens long, keys binary, counts binary, seen binary, above binary, names binary, masses binary"


def _sender(buckets: int):
    def packed(kind: int, parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        k, c, *names = _summed(parts)
        b = bucket_of(k, buckets)
        rows = []
        for x, z in zip(heads := _heads(b), [*heads[1:], len(b)]):
            own = c[x:z]
            small = own.astype(np.uint8) if own.max() < 256 else own.astype(np.int64)  # told apart by length
            rows.append((int(b[x]), kind, int(z - x), *rice_encode(k[x:z].astype(np.int64)), small.tobytes(), *(n[x:z].tobytes() for n in names), *([b""] if not names else [])))
        types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4)
        return pa.RecordBatch.from_arrays([pa.array(list(col), t) for col, t in zip(zip(*rows), types, strict=True)], names=["bucket", "kind", "n", "shift", "unary", "rest", "counts", "names"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {1: [], 2: []}
        n = 0
        for b in batches:
            for _, _, data, offsets in slices(b.column(0)):
                toks, hist, _ = tokens(data, offsets)
                held[1].append(np.unique(toks, return_counts=True))
                k, i, c = np.unique(bigrams(hist, toks), return_index=True, return_counts=True)
                held[2].append((k, c, hist[i]))
                n += len(k)
                if n > SEND:
                    for kind, parts in held.items():
                        yield packed(kind, parts)
                    held, n = {1: [], 2: []}, 0
        if n:
            for kind, parts in held.items():
                yield packed(kind, parts)

    return send


def levels_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c)."""
    return np.frexp(counts.astype(np.float64))[1]


def _probes(h: np.ndarray, level: int, m: np.ndarray | int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, mask) of each of an entry's words among ``m``."""
    g = mix(h + _U(level) * _STEP)
    for i in range(WORDS[level > 1]):
        x = mix(g + _U(i))
        yield ((x >> _U(32)) * m) >> _U(32), _MASKS[(x & _U(4095)).astype(np.int64)]


class Filter:
    """The filters of ``buckets`` ranges of the hash, side by side."""

    def __init__(self, buckets: int, words: tuple[int, int] = (0, 0)):
        self.buckets = buckets
        self.m, self.start = np.ones((2, buckets), np.uint64), np.zeros((2, buckets), np.uint64)
        self.words = [np.zeros(w + 1, np.uint64) for w in words]  # a first word for buckets without entries
        self.end = [1, 1]

    def put(self, bucket: int, seen: bytes | pa.Buffer, above: bytes | pa.Buffer) -> None:
        for i, part in enumerate((seen, above)):
            part = np.frombuffer(part, np.uint64)
            if len(part):
                self.m[i, bucket], self.start[i, bucket] = len(part), self.end[i]
                self.words[i][self.end[i] : self.end[i] + len(part)] = part
                self.end[i] += len(part)

    def level(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        left, b = np.arange(len(h)), bucket_of(h, self.buckets).astype(np.int64)
        q = 0
        while len(left) and q < len(_VALUE) - 1:
            q += 1
            i = int(q > 1)
            words, m, start = self.words[i], self.m[i], self.start[i]
            for p in range(WORDS[i]):
                x = mix(mix(h[left] + _U(q) * _STEP) + _U(p))
                at = b[left]
                mask = _MASKS[(x & _U(4095)).astype(np.int64)]
                word = words[(start[at] + (((x >> _U(32)) * m[at]) >> _U(32))).astype(np.int64)]
                left = left[(word & mask) == mask]
            out[left] = q
        return out


class Parts:
    """Filters of different buckets, each broadcast by itself: neither the
    driver nor a worker holds more than one of them at a time."""

    def __init__(self, buckets: int, parts: list, part_of: np.ndarray):
        self.buckets, self.parts, self.part_of = buckets, parts, part_of

    def level(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int8)
        which = self.part_of[bucket_of(h, self.buckets).astype(np.int64)]
        for i, part in enumerate(self.parts):
            own = np.flatnonzero(which == i)
            for x in range(0, len(own), PROBED):
                some = own[x : x + PROBED]
                out[some] = getattr(part, "value", part).level(h[some])
            getattr(part, "__dict__", {}).pop("_value", None)  # read again from its file when next asked for
        return out


def filters(keys: np.ndarray, levels: np.ndarray) -> tuple[bytes, bytes]:
    """The filters (level 1, above) of one bucket's bigrams."""
    out = []
    for i, entries in enumerate((len(keys), int(levels.sum()) - len(keys))):
        words = np.zeros(-(-entries * BITS[i] // 64), np.uint64)
        for q in range(i + 1, (1 if i == 0 else int(levels.max(initial=0))) + 1):
            for at, mask in _probes(keys[levels >= q], q, _U(len(words))):
                np.bitwise_or.at(words, at.astype(np.int64), mask)
        out.append(words.tobytes())
    return out[0], out[1]


def _builder(buckets: int):
    def build(t: pa.Table) -> pa.Table:
        got: dict[int, list] = {1: [], 2: []}
        for i in range(t.num_rows):
            r = {c: t.column(c)[i].as_py() for c in t.column_names}
            counts = np.frombuffer(r["counts"], np.uint8 if len(r["counts"]) == r["n"] else np.int64).astype(np.int64)
            keys = rice_decode(r["n"], r["shift"], r["unary"], r["rest"]).astype(np.uint64)
            got[r["kind"]].append((keys, counts) if r["kind"] == 1 else (keys, counts, np.frombuffer(r["names"], np.uint64)))
        bucket = t.column("bucket")[0].as_py()
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        uni, (keys, counts, names) = _summed(got[1]) if got[1] else none[:2], _summed(got[2]) if got[2] else none
        seen, above = filters(keys, levels_of(counts))
        f = Filter(buckets, (len(seen) // 8, len(above) // 8))
        f.put(bucket, seen, above)
        order = np.argsort(names, kind="stable")
        heads = _heads(names[order])
        masses = np.add.reduceat(_VALUE[f.level(keys)][order], heads) if len(heads) else none[1]
        row = {"bucket": [bucket], "n_unigrams": [len(uni[0])], "n_tokens": [int(uni[1].sum())], "keys": [uni[0].tobytes()], "counts": [uni[1].tobytes()], "seen": [seen], "above": [above], "names": [names[order][heads].tobytes()], "masses": [masses.tobytes()]}
        types = {"bucket": pa.int32(), "n_unigrams": pa.int64(), "n_tokens": pa.int64()}
        return pa.table(row, schema=pa.schema([(c, types.get(c, pa.binary())) for c in row]))

    return build


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def trained(docs: DataFrame) -> DataFrame:
    """The model: per bucket of the hash range its exact unigram counts, its
    filters and its part of S, from the training fold of ``docs``."""
    shipped(docs.sparkSession)
    train = docs.where(~held_out(F.col("doc_id"))).select("text")
    size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, -(-size // BUCKET_BYTES))
    sent = train.mapInArrow(tidy(_sender(buckets)), _SENT)
    return written(sent.groupBy("bucket").applyInArrow(_builder(buckets), _MODEL).withColumn("buckets", F.lit(buckets)), "model")


def _pairs(names: tuple[str, str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in zip(b.column(0), b.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_py(), np.int64)), pa.array(np.frombuffer(y.as_py(), np.int64))], names=list(names))

    return rows


def word_table(model: DataFrame) -> tuple[DataFrame, int]:
    """(k, c, s) of every word: hash, count and S; and S of text starts."""
    sums = model.select("names", "masses").mapInArrow(_pairs(("name", "m")), "name long, m long").groupBy("name").agg(F.sum("m").alias("s"))
    words = model.select("keys", "counts").mapInArrow(_pairs(("k", "c")), "k long, c long")
    j = words.join(sums, F.col("k") == F.col("name"), "left").select("k", "c", F.coalesce("s", F.lit(0)).alias("s"))
    start = int(START >> _KEEP)
    at_start = written(model.select("names", "masses").mapInArrow(_start_mass(start), "m long"), "start").agg(F.sum("m")).first()[0]
    return written(j, "words"), at_start or 0


def _start_mass(start: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in zip(b.column(0), b.column(1)):
                hit = np.frombuffer(x.as_py(), np.uint64) == _U(start)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(y.as_py(), np.int64)[hit])], names=["m"])

    return rows


class Scorer:
    """Scores of texts from a filter and the exact table of words; words that
    occur once and are followed once are kept by their hash alone."""

    def __init__(self, f: Filter | Parts, n: int, v: int, at_start: int, once: np.ndarray, often: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.filter, self.n, self.v, self.at_start, self.once, self.often = f, n, v, at_start, once, often

    def known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and S of hashes."""
        c, s = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        s[h == START >> _KEEP] = self.at_start
        for keys, count, mass in ((self.once, None, None), self.often):
            if len(keys):
                i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[i] == h
                c[hit] = 1 if count is None else count[i[hit]]
                s[hit] = 1 if mass is None else mass[i[hit]]
        return c, s

    def terms(self, hist: np.ndarray, toks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each token's count and add-one estimate, and S of its history."""
        some, where = np.unique(np.concatenate([toks, hist]), return_inverse=True)
        c, s = self.known(some)
        c, s = c[where[: len(toks)]], s[where[len(toks) :]]
        return c, (c + 1) / (self.n + self.v + 1), s

    def values(self, grams: np.ndarray) -> np.ndarray:
        """What is read of bigrams."""
        return _VALUE[self.filter.level(grams)]

    def probabilities(self, hist: np.ndarray, toks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each token's count, add-one estimate, and probability after ``hist``."""
        c, first, s = self.terms(hist, toks)
        return c, first, (self.values(bigrams(hist, toks)) + MU * first) / (s + MU)

    def scored(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (rid, doc_id, held_out, text) to their scores.  Texts are read
        until ``GATHERED`` tokens wait; then each part of the filter is asked
        once for all of them."""
        held: list[tuple] = []
        waiting = 0

        def flush() -> Iterator[pa.RecordBatch]:
            read = self.values(np.concatenate([h[1] for h in held]))
            x = 0
            for columns, grams, first, s, at in held:
                p = (read[x : x + len(grams)] + MU * first) / (s + MU)
                x += len(grams)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.add.reduceat(np.log10(p), at))], names=["rid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

        for b in batches:
            for lo, hi, data, offsets in slices(b.column(3), SCORED):
                toks, hist, at = tokens(data, offsets)
                c, first, s = self.terms(hist, toks)
                counted = [np.diff(at, append=len(toks)), np.add.reduceat((c > 0).astype(np.int64), at), np.add.reduceat(np.log10(first), at)]
                held.append(([*(b.column(i).slice(lo, hi - lo) for i in range(3)), *map(pa.array, counted)], bigrams(hist, toks), first, s.astype(np.int32) if s.max() < 2**31 else s, at))
                waiting += len(toks)
                if waiting >= GATHERED:
                    yield from flush()
                    held, waiting = [], 0
                    give_back()
        if held:
            yield from flush()


_RESULT = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _gathered(model: DataFrame, words: DataFrame, sizes, n: int, v: int, at_start: int, ship: Callable = lambda x: x) -> Scorer:
    """The whole model, once it was counted to be within its bounds; ``ship``
    sends a part of it to the workers."""
    buckets = sizes.buckets
    parts, part_of = [], np.zeros(buckets, np.int64)
    step = max(1, buckets * PART_BYTES // max(1, sizes.seen + sizes.above))  # buckets at a time
    for lo in range(0, buckets, step):
        t = model.where(F.col("bucket").between(lo, lo + step - 1)).select("bucket", "seen", "above").toArrow()
        rows = [(t["bucket"][i].as_py(), t["seen"][i].as_buffer(), t["above"][i].as_buffer()) for i in range(t.num_rows)]
        f = Filter(buckets, tuple(sum(len(r[i]) for r in rows) // 8 for i in (1, 2)))
        for r in rows:
            f.put(*r)
            part_of[r[0]] = len(parts)
        del t, rows
        parts.append(ship(f))
        del f
        give_back()
    # a range of the hashes at a time, so that the driver holds little beside the table
    once, often, ranges = [], [], max(1, -(-v // RANGE_WORDS))
    ends = [(i << HASH_BITS) // ranges for i in range(ranges + 1)]
    for lo, hi in zip(ends, ends[1:]):
        t = words.where((F.col("k") >= lo) & (F.col("k") <= hi - 1)).toArrow()
        k, c, x = (t[name].to_numpy() for name in ("k", "c", "s"))
        order = np.argsort(k)
        rare = (c[order] == 1) & (x[order] == 1)
        once.append(k[order][rare].view(np.uint64))
        small = lambda y: y.astype(np.int32) if y.max(initial=0) < 2**31 else y
        often.append((k[order][~rare].view(np.uint64), small(c[order][~rare]), small(x[order][~rare])))
        del t, k, c, x, order, rare
        give_back()
    once, often = np.concatenate(once), tuple(map(np.concatenate, zip(*often, strict=True)))
    give_back()
    return Scorer(Parts(buckets, parts, part_of), n, v, at_start, once, often)


def _asked(buckets: int):
    """Rows (rid, text) to rows (rid, bucket, g, h, w, tf) of each text's
    distinct bigrams."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, data, offsets in slices(b.column(1)):
                toks, hist, at = tokens(data, offsets)
                for k, (x, z) in enumerate(zip(at, [*at[1:], len(toks)])):
                    g, i, tf = np.unique(bigrams(hist[x:z], toks[x:z]), return_index=True, return_counts=True)
                    columns = (np.full(len(g), b.column(0)[lo + k].as_py()), bucket_of(g, buckets).astype(np.int64), g.astype(np.int64), hist[x:z][i].astype(np.int64), toks[x:z][i].astype(np.int64), tf)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["rid", "bucket", "g", "h", "w", "tf"])

    return rows


def _answer(buckets: int):
    """A bucket's distinct bigrams (g, h, w) with what its filter reads."""

    def rows(asked: pa.Table, model: pa.Table) -> pa.Table:
        g = asked["g"].to_numpy()
        v = np.zeros(len(g), np.int64)
        if model.num_rows:
            seen, above = model["seen"][0].as_py(), model["above"][0].as_py()
            f = Filter(buckets, (len(seen) // 8, len(above) // 8))
            f.put(model["bucket"][0].as_py(), seen, above)
            v = _VALUE[f.level(g.astype(np.uint64))] if len(g) else v
        return pa.table({"g": g, "h": asked["h"], "w": asked["w"], "v": v})

    return rows


def _joined(rows: DataFrame, model: DataFrame, words: DataFrame, buckets: int, n: int, v: int, at_start: int) -> DataFrame:
    """Scores of ``rows`` (rid, doc_id, held_out, text) by shuffles alone."""
    asked = written(rows.select("rid", "text").mapInArrow(tidy(_asked(buckets)), "rid long, bucket long, g long, h long, w long, tf long"), "asked")
    distinct = asked.select("bucket", "g", "h", "w").dropDuplicates(["g"])
    parts = model.select(F.col("bucket").cast("long").alias("bucket"), "seen", "above")
    read = distinct.groupBy("bucket").cogroup(parts.groupBy("bucket")).applyInArrow(_answer(buckets), "g long, h long, w long, v long")
    read = read.join(words.select(F.col("k").alias("w"), "c"), "w", "left").join(words.select(F.col("k").alias("h"), "s"), "h", "left")
    mass = F.coalesce("s", F.when(F.col("h") == int(START >> _KEEP), at_start), F.lit(0))
    c, first = F.coalesce("c", F.lit(0)), F.col("first")
    read = read.withColumns({"known": c > 0, "first": (c + 1).cast("double") / F.lit(float(n + v + 1))}).select("g", "known", first, ((F.col("v") + MU * first) / (mass + MU)).alias("p"))
    j = asked.select("rid", "g", "tf").join(read, "g")
    sums = j.groupBy("rid").agg(F.sum("tf").alias("n_tokens"), F.sum(F.when(F.col("known"), F.col("tf")).otherwise(0)).alias("n_known"), F.sum(F.col("tf") * F.log10("first")).alias("base_score"), F.sum(F.col("tf") * F.log10("p")).alias("score"))
    return rows.select("rid", "doc_id", "held_out").join(sums, "rid")


def scored(docs: DataFrame, model: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    zero = lambda c: F.coalesce(c, F.lit(0))
    sizes = model.agg(zero(F.sum("n_tokens")).alias("n"), zero(F.sum("n_unigrams")).alias("v"), F.coalesce(F.max("buckets"), F.lit(16)).alias("buckets"), zero(F.sum(F.octet_length("seen"))).alias("seen"), zero(F.sum(F.octet_length("above"))).alias("above")).first()
    n, v = sizes.n, sizes.v
    words, at_start = word_table(model)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    if sizes.seen + sizes.above <= broadcast_bytes and v <= broadcast_words:
        send = spark.sparkContext.broadcast
        scorer = _gathered(model, words, sizes, n, v, at_start, send)
        parts, scorer.filter.parts = scorer.filter.parts, []  # a function names the broadcasts that it needs
        sent = send(scorer)
        del scorer
        give_back()

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = sent.value
            s.filter.parts = parts
            yield from s.scored(batches)

        out = rows.mapInArrow(tidy(score), _RESULT)
    else:
        out = _joined(written(rows, "rows"), model, words, sizes.buckets, n, v, at_start)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


#: Text in a chunk of documents, and per bucket of words; training text up to
#: which the model is made to be broadcast.
CHUNK_BYTES, WORD_BUCKET_BYTES, SMALL_BYTES = 16_000_000, 8_000_000, 100_000_000
#: Chunks that the words with followers in all buckets are looked for in.
SAMPLED_CHUNKS = 8
#: Bytes of a bigram as it is sent, beside its history; 40 million of one word
#: take another for one of them once in 7 million.
WIRE = 6
_WIRE = _U(HASH_BITS - 8 * WIRE)
_CHUNK = "chunk long, doc_id array<bigint>, held_out array<boolean>, ends binary, texts binary"
_ASKED = "bucket int, chunk long, words binary, word_counts binary, n int, steps binary, bigrams binary, counts binary"
_ANSWER = "chunk long, bucket int, counts binary, masses binary, levels binary, n_tokens long, n_unigrams long, names binary, shares binary"


def _narrow(a: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes each that hold all, compressed."""
    top = int(a.max(initial=0))
    width = 1 if top < 2**8 else 2 if top < 2**16 else 4 if top < 2**32 else 8
    return bytes([width]) + pa.compress(a.astype(f"<u{width}").tobytes(), "zstd", asbytes=True)


def _wide(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(memoryview(b)[1:], n * b[0], "zstd"), f"<u{b[0]}").astype(np.int64) if n else np.zeros(0, np.int64)


def _one(values: pa.Array) -> pa.Array:
    """An array as one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, held_out, text) to one row for each ``CHUNK_BYTES`` of text."""
    codec, task, k = pa.Codec("zstd", 3), TaskContext.get().partitionId(), 0
    held: list[tuple] = []
    size = 0

    def row() -> pa.RecordBatch:
        ids, out, data, sizes = zip(*held)
        columns = [pa.array([(task << 32) + k]), _one(pa.concat_arrays(ids)), _one(pa.concat_arrays(out)), pa.array([np.cumsum(np.concatenate(sizes)).tobytes()]), pa.array([codec.compress(np.concatenate(data).tobytes(), asbytes=True)])]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "doc_id", "held_out", "ends", "texts"])

    for b in batches:
        for lo, hi, data, offsets in slices(b.column(2), CHUNK_BYTES):
            if held and size + len(data) > CHUNK_BYTES:
                yield row()
                held, size, k = [], 0, k + 1
            held.append((b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), data, np.diff(offsets)))
            size += len(data)
    if held:
        yield row()


def _order(a: np.ndarray, bits: int) -> np.ndarray:
    """Stable order of whole numbers of so many bits: numbers are sorted with
    their places in the low bits, which is several times as fast as argsort; what
    the bits left for the numbers don't tell apart is then put right."""
    low = max(1, (len(a) - 1).bit_length())
    cut = max(0, bits + low - 64)
    top = (a.astype(np.uint64) >> _U(cut)) << _U(low)
    top |= np.arange(len(a), dtype=np.uint64)
    top.sort()
    order = (top & _U(2**low - 1)).astype(np.int64)
    if cut:
        top >>= _U(low)
        there = a[order]
        for x in np.unique(top[np.flatnonzero(there[1:] < there[:-1])]):
            i, k = np.searchsorted(top, x), np.searchsorted(top, x, "right")
            order[i:k] = order[i:k][np.argsort(there[i:k], kind="stable")]
    return order


def _told_apart(a: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers, and which of them each is."""
    order = _order(a, bits)
    there = a[order]
    head = np.ones(len(a), bool)
    head[1:] = there[1:] != there[:-1]
    which = np.empty(len(a), np.int64)
    which[order] = np.cumsum(head) - 1
    return there[head], which


class Chunk:
    """A chunk's tokens and what it asks of each bucket: its words, and its
    distinct bigrams in the order of their histories.  A bigram is asked for where
    its history is, so that a bucket has all that follows a word; what follows one
    of ``spread`` (words with very many bigrams, sorted) is dealt to all buckets."""

    def __init__(self, row: dict, buckets: int, spread: np.ndarray):
        offsets = np.concatenate([[0], np.frombuffer(row["ends"], np.int64)])
        data = pa.Codec("zstd").decompress(row["texts"], int(offsets[-1]))
        texts = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), data])
        parts = [tokens(some, own) for _, _, some, own in slices(texts)]
        firsts = np.cumsum([0, *(len(p[0]) for p in parts)])
        self.at = np.concatenate([p[2] + n for p, n in zip(parts, firsts)])
        self.words, self.word = _told_apart(np.concatenate([p[0] for p in parts]), HASH_BITS)
        del parts
        self.lengths = np.diff(self.at, append=len(self.word))
        trained = np.repeat(~np.array(row["held_out"], bool), self.lengths)
        self.word_counts = np.bincount(self.word[trained], minlength=len(self.words))
        self.word_ends = np.searchsorted(bucket_of(self.words, buckets).astype(np.int64), np.arange(buckets + 1))
        wide = (len(self.words)).bit_length()
        pair = np.empty(len(self.word), np.int64)
        pair[1:] = self.word[:-1] << wide
        pair[self.at] = len(self.words) << wide
        pair |= self.word
        pairs, self.gram = _told_apart(pair, 2 * wide)
        names = np.append(self.words, START >> _KEEP)
        before = pairs >> wide
        grams = bigrams(names[before], self.words[pairs & (2**wide - 1)])
        place = np.minimum(np.searchsorted(spread, names), len(spread) - 1)
        dealt = (spread[place] == names)[before]
        mine, theirs = np.flatnonzero(~dealt), np.flatnonzero(dealt)
        bucket = bucket_of(grams[theirs], buckets).astype(np.int64)
        theirs = theirs[_order(bucket * len(spread) + place[before[theirs]], 62)] if len(theirs) else theirs
        order = np.concatenate([mine, theirs])
        # of each bucket: the end of what follows words of its own, and of what is dealt to it
        self.ends = np.searchsorted(before[mine], self.word_ends), np.searchsorted(np.sort(bucket), np.arange(buckets + 1)) + len(mine)
        self.grams = grams[order] >> _WIRE
        self.names_at = np.concatenate([before[mine], place[before[theirs]]])
        self.counts = np.bincount(self.gram[trained], minlength=len(order))[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.gram = rank[self.gram]

    def of(self, b: int) -> tuple[slice, slice, slice]:
        """Places of a bucket: its words, what follows them, what else is dealt to it."""
        own, more = self.ends
        return slice(*self.word_ends[b : b + 2]), slice(*own[b : b + 2]), slice(*more[b : b + 2])

    def asks(self, chunk: int) -> Iterator[tuple]:
        """Rows of ``_ASKED``."""
        for b in range(len(self.word_ends) - 1):
            w, x, y = self.of(b)
            both = lambda a: np.concatenate([a[x], a[y]])  # noqa: B023, E731
            n = x.stop - x.start + y.stop - y.start
            if n or w.stop > w.start:
                at = np.concatenate([self.names_at[x] - w.start, self.names_at[y] + (w.stop - w.start)])
                wire = both(self.grams).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIRE]
                yield b, chunk, self.words[w].tobytes(), _narrow(self.word_counts[w]), int(n), _narrow(np.diff(at, prepend=0)), wire.tobytes(), _narrow(both(self.counts))


def _table(rows: list[tuple], schema: str) -> dict[str, pa.Array]:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    return {n: pa.array(list(c), types[k]) for n, k, c in zip(names, kinds, zip(*rows) if rows else [()] * len(names), strict=True)}


def _asking(buckets: int, spread: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                yield pa.RecordBatch.from_pydict(_table(list(Chunk(row, buckets, spread).asks(row["chunk"])), _ASKED))

    return rows


def _answering(spread: np.ndarray):
    """A bucket's filters from what all chunks have of its bigrams, and what each
    chunk reads of them, with its words' counts and S."""

    def answer(t: pa.Table) -> pa.Table:
        asked = t.to_pylist()
        words = [np.frombuffer(r["words"], np.uint64) for r in asked]
        every, word = _told_apart(np.concatenate(words), HASH_BITS)
        count = np.bincount(word, np.concatenate([_wide(r["word_counts"], len(w)) for r, w in zip(asked, words)]), len(every)).astype(np.int64)
        wires = [np.frombuffer(r["bigrams"], np.uint8).reshape(-1, WIRE) for r in asked]
        keys = np.zeros((sum(map(len, wires)), 8), np.uint8)
        np.concatenate(wires, out=keys[:, :WIRE])
        names = np.concatenate([np.concatenate([w, spread])[np.cumsum(_wide(r["steps"], r["n"]))] for r, w in zip(asked, words)])
        keys, which = _told_apart(bigrams(names, keys.view("<u8").ravel()), HASH_BITS)
        of_key = np.empty(len(keys), np.uint64)
        of_key[which] = names
        names = of_key
        counts = np.bincount(which, np.concatenate([_wide(r["counts"], r["n"]) for r in asked]), len(keys)).astype(np.int64)
        seen = counts > 0
        parts = filters(keys[seen], levels_of(counts[seen]))
        f = Filter(1, tuple(len(p) // 8 for p in parts))
        f.put(0, *parts)
        level = f.level(keys)
        name, own = np.unique(names[seen], return_inverse=True)
        mass = np.bincount(own, _VALUE[level[seen]], len(name)).astype(np.int64)
        i = np.minimum(np.searchsorted(name, every), max(len(name) - 1, 0))
        s = np.where(name[i] == every, mass[i], 0) if len(name) else np.zeros(len(every), np.int64)
        dealt = np.isin(name, spread)
        out, x, k = [], 0, 0
        for r, w in zip(asked, words):
            mine = word[x : x + len(w)]
            more = (0, 0, b"", b"") if out else (int(count.sum()), int((count > 0).sum()), name[dealt].tobytes(), mass[dealt].tobytes())
            out.append((r["chunk"], r["bucket"], _narrow(count[mine]), _narrow(s[mine]), _narrow(level[which[k : k + r["n"]]]), *more))
            x, k = x + len(w), k + r["n"]
        return pa.table(_table(out, _ANSWER))

    return answer


def _scoring(buckets: int, spread: np.ndarray, mass: np.ndarray, n: int, v: int):
    """A chunk and the answers it got, to its documents' scores."""

    def score(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        own = Chunk(row, buckets, spread)
        count, s = np.zeros((2, len(own.words)), np.int64)
        level = np.zeros(len(own.grams), np.uint8)
        for r in answers.to_pylist():
            w, x, y = own.of(r["bucket"])
            words, mine, theirs = (k.stop - k.start for k in (w, x, y))
            count[w], s[w], read = _wide(r["counts"], words), _wide(r["masses"], words), _wide(r["levels"], mine + theirs)
            level[x], level[y] = read[:mine], read[mine:]
        i = np.minimum(np.searchsorted(spread, own.words), len(spread) - 1)
        s = np.where(spread[i] == own.words, mass[i], s)
        before = np.concatenate([[0], s[own.word[:-1]]])
        before[own.at] = mass[np.searchsorted(spread, START >> _KEEP)]
        c = count[own.word]
        first = (c + 1) / (n + v + 1)
        p = (_VALUE[level[own.gram]] + MU * first) / (before + MU)
        sums = [np.add.reduceat(x, own.at) for x in ((c > 0).astype(np.int64), np.log10(first), np.log10(p))]
        return pa.table({"doc_id": pa.array(row["doc_id"], pa.int64()), "held_out": pa.array(row["held_out"], pa.bool_()), "n_tokens": own.lengths, "n_known": sums[0], "base_score": sums[1], "score": sums[2]})

    return score


def _frequent(buckets: int):
    """Words of chunks that are frequent enough to fill half a bucket by
    themselves, if they are so everywhere (h, n), and all tokens (h null)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                own = Chunk(row, 1, np.array([START >> _KEEP]))
                n = np.bincount(own.word)
                often = n * (2 * buckets) >= n.sum()
                yield pa.RecordBatch.from_arrays([pa.array([*own.words[often].astype(np.int64).tolist(), None], pa.int64()), pa.array([*n[often].tolist(), int(n.sum())], pa.int64())], names=["h", "n"])

    return rows


def exchanged(docs: DataFrame) -> DataFrame:
    """:func:`scored` by the model of ``docs`` itself, of which nothing is gathered
    or kept: chunks of documents ask the buckets of the hash range for what they
    need, each of their words and bigrams once, and buckets build their filters
    from what they are asked.  An answer is a byte a bigram, in the order of the
    question, so texts are laid out anew to read it and no bigram is written back."""
    shipped(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, -(-size // WORD_BUCKET_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    chunks = written(rows.mapInArrow(tidy(_chunked), _CHUNK), "chunks")
    # which words are dealt to all buckets changes the load alone, no result
    some = max(1, size // CHUNK_BYTES // SAMPLED_CHUNKS)
    often = chunks.where(F.pmod(F.xxhash64("chunk"), F.lit(some)) == 0).mapInArrow(tidy(_frequent(buckets)), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).collect()
    most = sum(r.n for r in often if r.h is None)
    spread = np.unique(np.array([int(START >> _KEEP), *(r.h for r in often if r.h is not None and r.n * 2 * buckets >= most)], np.uint64))
    asked = chunks.mapInArrow(tidy(_asking(buckets, spread)), _ASKED)
    answers = written(asked.groupBy("bucket").applyInArrow(_answering(spread), _ANSWER), "answers")
    sizes = answers.agg(F.sum("n_tokens"), F.sum("n_unigrams")).first()
    n, v = (x or 0 for x in sizes)
    shares = answers.where(F.octet_length("names") > 0).select("names", "shares").mapInArrow(_pairs(("name", "m")), "name long, m long").groupBy("name").agg(F.sum("m").alias("m")).collect()
    mass = np.zeros(len(spread), np.int64)
    mass[np.searchsorted(spread, np.array([r.name for r in shares], np.uint64))] = [r.m for r in shares]
    told = answers.select("chunk", "bucket", "counts", "masses", "levels")
    out = chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_scoring(buckets, spread, mass, n, v), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def learned(docs: DataFrame, most: int = SMALL_BYTES) -> DataFrame:
    """:func:`scored` by the model of ``docs`` itself: broadcast if its text is
    small, else asked for by shuffles."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return scored(docs, trained(docs)) if size <= most else exchanged(docs)


def op6_log_frequency_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned(documents(spark, sf_dir))
