"""SentencePiece encoding and decoding by shortest paths in a transducer.

A model is compiled into four parts:

* the normaliser: spaces become U+2581 and one is put before the text;
* the pieces: from any place in the text a path reads a piece and writes its id;
* byte fallback: a character that no piece holds writes the ids of its bytes;
* the constraint: an acceptor over pairs of pieces.  In a unigram model it
  accepts every pair and a piece weighs minus its score.  In a BPE model a pair
  weighs 0 if merging turns the pair's text into just that pair, and infinity
  otherwise.  A sequence whose neighbours are all accepted is the one that
  merging makes of the whole text, so the only path of finite weight is the
  BPE encoding, byte for byte what the library gives.

A text is composed with these parts and the path of least weight (tropical
semiring: weights add along a path, the least path counts) is read off from
left to right; for BPE one state per place survives.  Pieces hold U+2581 only
in front and do not mix letters with other characters (both checked when a
model is compiled), so no piece crosses such a border, and texts are composed
segment by segment; segments' paths are remembered within bounds.

Edge cases: a null or empty text has no pieces and decodes to an empty text; a
U+2581 in a text decodes to a space, as in the library; byte pieces that are not
UTF-8 decode to U+FFFD each; rows that repeat are encoded alike; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, shipped, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Segments remembered by a worker: twice this many at most.
REMEMBER = 100_000
#: Segments kept from one task to the next.
KEEP = 20_000
#: Verdicts on pairs of pieces: two to this power are kept.
SLOT_BITS = 21
#: Rows whose ids are sent to Spark at once.
FEW = 800
#: Segments up to this length are remembered.
SHORT = 32
_HASH = np.uint64(0x9E3779B97F4A7C15)
_LETTER = "[A-Za-zÀ-ÖØ-öø-ʯ]"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(b: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of the fields of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        x = shift = 0
        while True:
            x |= (b[i] & 127) << shift
            shift += 7
            i += 1
            if b[i - 1] < 128:
                return x

    while i < len(b):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, b[i : i + n]
            i += n


class Transducer:
    """A compiled model; :meth:`encode` and :meth:`decode` single texts."""

    def __init__(self, model: bytes):
        pieces, trainer, norm = [], {}, {}
        for n, v in _fields(model):
            if n == 1:
                f = dict(_fields(v))
                pieces.append((f[1].decode(), struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0], f.get(3, NORMAL)))
            elif n == 2:
                trainer = dict(_fields(v))
            elif n == 3:
                norm = dict(_fields(v))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE) or norm.get(2) or trainer.get(24) or any(t == USER for *_, t in pieces):
            raise ValueError("only unigram and BPE models with the identity normaliser and without user pieces are known")
        self.prefix, self.squeeze, fallback = norm.get(3, 1), norm.get(4, 1), trainer.get(35, 0)
        self.score = {p: s for p, s, t in pieces if t in (NORMAL, UNUSED)}
        self.id = {p: i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, UNUSED)}
        self.unknown = next(i for i, (*_, t) in enumerate(pieces) if t == UNKNOWN)
        self.bytes = [next((i for i, (p, _, t) in enumerate(pieces) if t == BYTE and p == f"<0x{x:02X}>"), self.unknown) for x in range(256)] if fallback else None
        surface = {NORMAL: lambda p: p.replace(SPACE, " ").encode(), UNUSED: lambda p: p.replace(SPACE, " ").encode(), BYTE: lambda p: bytes([int(p[3:5], 16)]), UNKNOWN: lambda p: " ⁇ ".encode(), CONTROL: lambda p: b""}
        self.surface = [surface[t](p) for p, _, t in pieces]
        self.is_byte = [t == BYTE for *_, t in pieces]
        self.has_space = [p.startswith(SPACE) and t in (NORMAL, UNUSED) for p, _, t in pieces]
        self.longest = max(map(len, self.id))
        self.lowest = min(self.score.values()) - 10
        if self.kind == BPE:  # pieces that merging never makes are on no path
            self.made = {p: i for p, i in self.id.items() if len(p) == 1 or self._merge(p) == [p]}
        else:
            self.made = self.id
        # texts are cut before spaces, and around characters that no piece holds
        # and, where no piece mixes them, between letters and other characters
        inner = any(SPACE in p.lstrip(SPACE) for p in self.id)
        alphabet = {c for p in self.id for c in p}
        alone = "".join(re.escape(c) for c in "\n\r\t" if c not in alphabet)
        letter = {c: bool(re.match(_LETTER, c)) for c in alphabet}
        mixed = any(letter[a] != letter[b] for p in self.id for a, b in zip(p.lstrip(SPACE), p.lstrip(SPACE)[1:]))
        runs = [f"[^{SPACE}{alone}]+"] if mixed else [f"{_LETTER}+", f"(?:(?!{_LETTER})[^{SPACE}{alone}])+"]
        last = [f"{SPACE}+", *([f"[{alone}]"] if alone else [])]
        self.cut = None if inner or self.kind == UNIGRAM else re.compile("|".join([*(f"{SPACE}*{r}" for r in runs), *last]))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.histories: dict[str, list[tuple[float, str, str]]] = {}
        by_end: dict[str, set[int]] = {}
        for p in self.made:
            if len(p) > 1:
                by_end.setdefault(p[-2:], set()).add(len(p))
        #: last two characters -> lengths of the pieces that end so
        self.lengths = {e: tuple(sorted(n, reverse=True)) for e, n in by_end.items()}
        self.codes = {p: self._code(p) for p in self.made}
        self.names = [p for p, *_ in pieces]
        self.met = np.full(1 << SLOT_BITS, -1, np.int64)
        self.verdicts = np.zeros(1 << SLOT_BITS, bool)
        self.hashed: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in {len(p) for p in self.made}:
            same = [p for p in self.made if len(p) == k]
            h = np.zeros(len(same), np.uint64)
            for c in np.frombuffer("".join(same).encode("utf-32-le"), np.uint32).reshape(-1, k).T:
                h = h * _HASH + c.astype(np.uint64)
            order = np.argsort(h)
            self.hashed[k] = h[order], np.array([self.made[p] for p in same], np.int32)[order]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _merge(self, text: str) -> list[str]:
        """What merging makes of a short text: best score first, then leftmost."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            joined = [score.get(a + b, -np.inf) for a, b in zip(parts, parts[1:])]
            best = max(joined)
            if best == -np.inf:
                break
            i = joined.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _history(self, piece: str) -> list[tuple[float, str, str]]:
        """Merging a piece alone: before each merge, and at the end, the score
        of the merge that follows and the outer symbols at that moment."""
        h = self.histories.get(piece)
        if h is None:
            parts, h = list(piece), []
            while True:
                joined = [self.score.get(a + b, -np.inf) for a, b in zip(parts, parts[1:])]
                best = max(joined, default=-np.inf)
                h.append((best, parts[0], parts[-1]))
                if best == -np.inf:
                    break
                i = joined.index(best)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.histories[piece] = h
        return h

    def _accepts(self, a: str, b: str) -> bool:
        """Merging a + b gives [a, b]: both merge on as if alone, and no merge
        across the border comes before a better (or equal, further left) one."""
        ok = self.pairs.get((a, b))
        if ok is None:
            x, y, i, j, get = self._history(a), self._history(b), 0, 0, self.score.get
            while True:
                left, right = x[i][0], y[j][0]
                across = get(x[i][2] + y[j][1])
                if across is not None and across > left and across >= right:
                    ok = False
                    break
                if left == right == -np.inf:
                    ok = True
                    break
                if left >= right:
                    i += 1
                else:
                    j += 1
            if len(self.pairs) > 100_000:
                self.pairs.clear()
            self.pairs[a, b] = ok
        return ok

    def _last_bpe(self, s: str, i: int, last) -> str:
        """The last piece of the path to place ``i`` (over 0) of ``s``, given
        the last piece (``last(j)``) at the places before."""
        made, pairs = self.made, self.pairs
        for n in self.lengths.get(s[i - 2 : i] if i > 1 else "", ()):  # the longest piece first
            j = i - n
            if j >= 0 and (p := s[j:i]) in made:
                if not j:
                    return p
                before = last(j)
                if before not in made:
                    return p
                ok = pairs.get((before, p))
                if ok or ok is None and self._accepts(before, p):
                    return p
        return s[i - 1]

    def _path_bpe(self, s: str) -> list[str]:
        last = [""] * (len(s) + 1)
        for i in range(1, len(s) + 1):
            last[i] = self._last_bpe(s, i, last.__getitem__)
        out, i = [], len(s)
        while i:
            out.append(last[i])
            i -= len(out[-1])
        return out[::-1]

    def _allowed(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The constraint's verdicts on pairs of ids, from a table of pairs
        met before; pairs that it lacks are worked out once each."""
        keys = before.astype(np.int64) * len(self.surface) + ids
        slots = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)
        out = self.verdicts[slots]
        lacking = np.flatnonzero(self.met[slots] != keys)
        if len(lacking):
            new, at = np.unique(keys[lacking], return_inverse=True)
            names = self.names
            ok = np.array([self._accepts(names[k // len(names)], names[k % len(names)]) for k in new.tolist()])
            out[lacking] = ok[at]
            self.met[slots[lacking]] = keys[lacking]
            self.verdicts[slots[lacking]] = out[lacking]
        return out

    def _paths(self, group: list[str]) -> list[bytes]:
        """Ids of segments of one length: the same paths, place by place for
        all segments at once."""
        n_chars, n = len(group[0]), len(group)
        chars = np.frombuffer("".join(group).encode("utf-32-le"), np.uint32).reshape(n, n_chars).astype(np.uint64)
        found: dict[int, np.ndarray] = {}
        h = np.zeros((n, n_chars + 1), np.uint64)
        for k in range(1, min(n_chars, self.longest) + 1):
            h = h[:, : n_chars - k + 1] * _HASH + chars[:, k - 1 :]
            if k in self.hashed:
                keys, ids = self.hashed[k]
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                found[k] = np.where(keys[at] == h, ids[at], -1)
        last = np.full((n, n_chars + 1), -1, np.int32)
        size = np.ones((n, n_chars + 1), np.int64)
        for i in range(1, n_chars + 1):
            left = np.arange(n)
            for k in range(min(i, self.longest), 0, -1):  # the longest piece first
                if k not in found or not len(left):
                    continue
                ids = found[k][left, i - k]
                here = np.flatnonzero(ids >= 0)
                if i > k and len(here):
                    before = last[left[here], i - k]
                    here = here[(before < 0) | self._allowed(before, ids[here])]
                rows = left[here]
                last[rows, i], size[rows, i] = ids[here], k
                left = np.delete(left, here)
        place, rows = np.full(n, n_chars), np.arange(n)
        back = np.empty((n, n_chars), np.int32)
        count = np.zeros(n, np.int64)
        while len(rows):
            at = place[rows]
            count[rows] += 1
            back[rows, n_chars - count[rows]] = last[rows, at]
            place[rows] = at - size[rows, at]
            rows = rows[place[rows] > 0]
        ends = np.cumsum(count) * 4
        flat = back[np.arange(n_chars) >= (n_chars - count)[:, None]].tobytes()
        out = [flat[a:z] for a, z in zip([0, *ends[:-1].tolist()], ends.tolist())]
        if 1 in found:  # characters that no piece holds are rare: one by one
            for r in np.flatnonzero((found[1] < 0).any(axis=1)).tolist():
                out[r] = self._ids(group[r])
        return out

    def remember(self, segments: Iterable[str]) -> None:
        """Find the paths of many segments that are not remembered."""
        if len(self.young) >= REMEMBER:
            self.old, self.young = self.young, {}
        groups: dict[int, list[str]] = {}
        for s in segments:
            if s not in self.young:
                if s in self.old:
                    self.young[s] = self.old[s]
                else:
                    groups.setdefault(len(s), []).append(s)
        for n, group in groups.items():
            if n <= SHORT:
                self.young.update(zip(group, self._paths(group)) if self.kind == BPE and len(group) > 3 else ((s, self._ids(s)) for s in group))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """:meth:`encode` of each text."""
        if self.cut is None or self.squeeze:
            return [self.encode(t) for t in texts]
        front = SPACE if self.prefix else ""
        cut = [self.cut.findall(front + t.replace(" ", SPACE)) if t else [] for t in texts]
        self.remember({x for c in cut for x in c})
        young, one = self.young, self._segment
        return [b"".join([young[x] if x in young else one(x) for x in c]) for c in cut]

    def _path_unigram(self, s: str) -> list[str]:
        cost, last = [0.0] + [np.inf] * len(s), [""] * (len(s) + 1)
        for i in range(len(s)):
            for z in range(i + 1, min(len(s), i + self.longest) + 1):
                p = s[i:z]
                w = self.score.get(p, self.lowest if z == i + 1 else None)
                if w is not None and cost[i] - w < cost[z]:
                    cost[z], last[z] = cost[i] - w, p
        out, i = [], len(s)
        while i:
            out.append(last[i])
            i -= len(last[i])
        return out[::-1]

    def _code(self, p: str) -> bytes:
        i = self.made.get(p)
        ids = [i] if i is not None else [self.bytes[x] for x in p.encode()] if self.bytes else [self.unknown]
        return np.array(ids, np.int32).tobytes()

    def _ids(self, s: str) -> bytes:
        path = self._path_bpe(s) if self.kind == BPE else self._path_unigram(s)
        codes = self.codes
        try:
            return b"".join([codes[p] for p in path])
        except KeyError:  # characters that no piece holds
            if not self.bytes:  # neighbours of them are one unknown piece
                path = [p for k, p in enumerate(path) if p in codes or not k or path[k - 1] in codes]
            return b"".join([codes.get(p) or self._code(p) for p in path])

    def _segment(self, s: str) -> bytes:
        ids = self.young.get(s)
        if ids is None:
            ids = self.old.get(s)
            if ids is None:
                ids = self._ids(s)
            if len(s) <= SHORT:
                self.young[s] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian 32-bit integers."""
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return b""
        s = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        if self.cut is None:
            return self._ids(s)
        young = self.young
        return b"".join([young[x] if x in young else self._segment(x) for x in self.cut.findall(s)])

    def forget(self) -> None:
        """Keep the segments met first, which are the frequent ones."""
        self.young, self.old = dict(islice(self.young.items(), KEEP)), {}
        self.pairs.clear()
        self.histories.clear()

    def decode(self, ids: list[int]) -> str:
        if not ids:
            return ""
        whole = b"".join(map(self.surface.__getitem__, ids))
        first = next((i for i in ids if self.surface[i]), None)
        if self.prefix and first is not None and self.has_space[first]:
            whole = whole[1:]
        try:
            return whole.decode()
        except UnicodeDecodeError:
            return self._decode_slowly(ids)

    def _decode_slowly(self, ids: list[int]) -> str:
        out, run, first = [], b"", True
        for i in [*ids, -1]:
            if i >= 0 and self.is_byte[i]:
                run += self.surface[i]
                first = False
                continue
            while run:
                n = next((n for n in (1, 2, 3, 4) if _is_char(run[:n])), 0)
                out.append(run[:n].decode() if n else "�")
                run = run[n or 1 :]
            if i >= 0 and self.surface[i]:
                p = self.surface[i].decode()
                out.append(p[1:] if first and self.prefix and self.has_space[i] else p)
                first = False
        return "".join(out)


def _is_char(b: bytes) -> bool:
    try:
        return len(b.decode()) == 1
    except UnicodeDecodeError:
        return False


_COMPILED: dict[int, Transducer] = {}


def compiled(model: bytes) -> Transducer:
    """A worker's transducer of a model, kept from task to task."""
    key = hash(model)
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = Transducer(model)
    return _COMPILED[key]


def load(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _ids_array(ids: list[bytes]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))


def _by_few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few rows: ids take several times the room of their text."""
    for b in batches:
        for at in range(0, b.num_rows, FEW):
            yield b.slice(at, FEW)


def encoded(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id and ids (array of int) of each document."""
    spark = docs.sparkSession
    shipped(spark)
    sent = spark.sparkContext.broadcast(model)  # under a megabyte, whatever the corpus

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(sent.value)
        for b in _by_few(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), _ids_array(t.encode_all([x or "" for x in b.column(1).to_pylist()]))], names=["doc_id", "ids"])
        t.forget()

    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(tidy(encode), "doc_id long, ids array<int>")


def decoded(rows: DataFrame, model: bytes) -> DataFrame:
    """doc_id and the text that the ids of ``rows`` (doc_id, ids) decode to."""
    spark = rows.sparkSession
    shipped(spark)
    sent = spark.sparkContext.broadcast(model)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(sent.value)
        for b in _by_few(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.decode(x.as_py() or []) for x in b.column(1)], pa.string())], names=["doc_id", "text"])

    return rows.selectExpr("CAST(doc_id AS LONG) AS doc_id", "ids").mapInArrow(tidy(decode), "doc_id long, text string")


def segmented(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, n_bytes (byte pieces), ids, decoded_sha256 (of what
    the ids decode to) and round_trip (that is the text) of each document."""
    spark = docs.sparkSession
    shipped(spark)
    sent = spark.sparkContext.broadcast(load(model_path))

    def there_and_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(sent.value)
        is_byte = np.array(t.is_byte)
        for b in _by_few(batches):
            n_bytes, digests, same = [], [], []
            texts = [x or "" for x in b.column(1).to_pylist()]
            ids = t.encode_all(texts)
            for text, code in zip(texts, ids, strict=True):
                at = np.frombuffer(code, np.int32)
                back = t.decode(at.tolist())
                n_bytes.append(int(is_byte[at].sum()))
                digests.append(hashlib.sha256(back.encode()).hexdigest())
                same.append(back == text.replace(SPACE, " "))
            n = [len(x) // 4 for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(n_bytes, pa.int64()), _ids_array(ids), pa.array(digests, pa.string()), pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "n_bytes", "ids", "decoded_sha256", "round_trip"])
        t.forget()

    schema = "doc_id long, n_pieces long, n_bytes long, ids array<int>, decoded_sha256 string, round_trip boolean"
    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(tidy(there_and_back), schema)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmented(documents(spark, sf_dir))
