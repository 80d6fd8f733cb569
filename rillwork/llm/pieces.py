"""SentencePiece encoding and decoding, batched: by the type of the model, a Viterbi search or merges in score order.

A unigram model's segmentation is the one with the best sum of its pieces' scores, of equal ones that with the longer
last piece. Distinct words of a batch that have equal length advance together: for each end and piece length the hashes
of all their substrings probe the sorted hashes of the pieces, and vectorised maxima store scores and backpointers.
Characters that no piece has become byte pieces. Text is cut before white-space marks only if no piece crosses there.

A model made for merges (BPE), as the one that the query op6_sentencepiece is given, has other right ids: its words start
as characters, and the adjacent pair whose piece has the best score, of equal ones the first, becomes one until no pair is
a piece. This is the way the query takes. Words of equal length take a step together, with the same probes by hashes and
vectorised maxima; long ones go through a heap each. PieceTable.for_model goes by the type; PieceTable.load alone reads any
file as a unigram model.

Cases: a null text has null ids, an empty one none; decoding null gives null. Ids outside the table are refused.
Repeated rows come out repeated, an empty table gives an empty one. Only the named columns are used.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.llm.shared import map_texts

SPACE = "▁"
# Fixed values of the model format: types of pieces.
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
UNKNOWN_PENALTY = 10.0
#: Stands in a table of steps where a word has none left.
GAP = -2
#: Cells (words by ends) that advance together, at most.
CELLS = 1 << 20
FACTOR = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPREAD = np.uint64(0xC2B2AE3D27D4EB4F)
FILTER_BITS = 22
# Fixed values of the model format: types of models.
UNIGRAM, MERGES = 1, 2
#: Longer words are merged by a heap, one by one, and so searched where fewer than FEW_WORDS have their length.
LONG_WORD, FEW_WORDS = 64, 16


def _fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(number, wire type, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: object = varint()
        elif kind == 2:
            n = varint()
            value = data[at : at + n]
            at += n
        else:
            n = {1: 8, 5: 4}[kind]
            value = data[at : at + n]
            at += n
        yield tag >> 3, kind, value


@dataclass
class PieceTable:
    """Pieces, scores and types of a model, and how it treats white space."""

    pieces: list[str]
    scores: list[float]
    types: list[int]
    dummy_prefix: bool = True
    trim: bool = True
    kind: int = UNIGRAM
    merges: bool = False

    @classmethod
    def load(cls, path: str) -> PieceTable:
        """Read a .model file; normalisation by a character map isn't supported and is refused."""
        with open(path, "rb") as f:
            data = f.read()
        out = cls([], [], [])
        for number, _, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, _, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        (score,) = struct.unpack("<f", v)
                    elif n == 3:
                        kind = v
                out.pieces.append(piece)
                out.scores.append(score)
                out.types.append(kind)
            elif number == 2:
                out.kind = next((v for n, _, v in _fields(value) if n == 3), UNIGRAM)
            elif number == 3:
                for n, _, v in _fields(value):
                    if n == 2 and v:
                        raise ValueError("a model with a character map isn't supported")
                    if n == 3:
                        out.dummy_prefix = bool(v)
                    if n == 4:
                        out.trim = bool(v)
        return out.prepared()

    @classmethod
    def for_model(cls, path: str) -> PieceTable:
        """Read a .model file to encode as its type says; word and character models are refused."""
        table = cls.load(path)
        if table.kind not in (UNIGRAM, MERGES):
            raise ValueError(f"models of type {table.kind} aren't supported")
        table.merges = table.kind == MERGES
        if table.merges and {USER, UNUSED} & {*table.types}:
            raise ValueError("a merge model with user-defined or unused pieces isn't supported")
        return table

    def prepared(self) -> PieceTable:
        """Sorted keys of the pieces that text may match, a bit filter before them, and byte pieces."""
        usable = [i for i, t in enumerate(self.types) if t in (NORMAL, USER) and self.pieces[i]]
        self.longest = max((len(self.pieces[i]) for i in usable), default=1)
        self.index = {self.pieces[i]: (self.scores[i], i) for i in usable}
        keys = np.array([_hash_one(self.pieces[i]) for i in usable], np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ids = keys[order], np.array(usable, np.int64)[order]
        if (np.diff(self.keys.astype(object)) == 0).any():
            raise ValueError("two pieces have one key")
        sums = np.array([sum(map(ord, self.pieces[i])) for i in usable], np.int64)
        self.key_sums = sums[order]
        self.key_scores = np.array([self.scores[i] for i in usable], np.float64)[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        self.unknown = min((self.scores[i] for i in usable), default=0.0) - UNKNOWN_PENALTY
        self.unk_id = next((i for i, t in enumerate(self.types) if t == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        self.crossing = any(SPACE in self.pieces[i].lstrip(SPACE) for i in usable)
        shown = [b" \xe2\x81\x87 " if t == UNKNOWN else b"" if t == CONTROL else bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(SPACE, " ").encode() for p, t in zip(self.pieces, self.types, strict=True)]
        self.out_size = np.array([len(x) for x in shown], np.int64)
        self.out_at = np.cumsum(self.out_size) - self.out_size
        self.out_bytes = np.frombuffer(b"".join(shown), np.uint8)
        return self

    def normal(self, text: str) -> str:
        """Text with white-space marks, and the mark that stands before a text."""
        if self.trim:
            text = " ".join(x for x in text.split(" ") if x)
        return (SPACE * self.dummy_prefix + text.replace(" ", SPACE)) if text else ""

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the ids of text i are ids[offsets[i]:offsets[i + 1]]; a null text has none.

        All texts are one array of code points. Words are told apart by their keys, distinct ones are searched by
        length, and each occurrence gathers the ids of its word.
        """
        normal = [self.normal(t or "") for t in texts]
        edges = np.cumsum([0, *map(len, normal)])
        codes = np.frombuffer("".join(normal).encode("utf-32-le"), "<u4")
        if not len(codes):
            return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int32)
        begins = np.zeros(len(codes), bool)
        begins[edges[:-1][np.diff(edges) > 0]] = True
        if not self.crossing:
            mark = codes == ord(SPACE)
            begins[1:] |= mark[1:] & ~mark[:-1]
        start = np.flatnonzero(begins)
        length = np.diff(np.append(start, len(codes)))
        sums, inverse = _rolling(codes)
        keys = _final((sums[start + length] - sums[start]) * inverse[start], length)
        plain = np.append(0, np.cumsum(codes, dtype=np.int64))
        check = plain[start + length] - plain[start]
        _, first, word = np.unique(keys, return_index=True, return_inverse=True)
        odd = np.flatnonzero((length[first[word]] != length) | (check[first[word]] != check))
        if len(odd):  # two words have one key: each occurrence is a word of its own
            word[odd] = len(first) + np.arange(len(odd))
            first = np.append(first, odd)
        found, at, count = self._search(codes, start[first], length[first])
        many = count[word]
        ends = np.cumsum(many)
        ids = found[np.repeat(at[word] - (ends - many), many) + np.arange(ends[-1])]
        offsets = np.append(0, ends)[np.searchsorted(start, edges)]
        return offsets, ids

    def _search(self, codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words one after the other, and each word's place and number there."""
        at, count = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        parts, total = [], 0
        order = np.argsort(length, kind="stable")
        cut = np.flatnonzero(np.diff(length[order])) + 1
        for group in np.split(order, cut):
            n = int(length[group[0]])
            most = max(1, CELLS // n)
            for k in range(0, len(group), most):
                rows = group[k : k + most]
                block = codes[start[rows][None, :] + np.arange(n)[:, None]]
                ids, many = self._merged(block) if self.merges else self._advance(block)
                at[rows] = total + np.append(0, np.cumsum(many)[:-1])
                count[rows] = many
                parts.append(ids)
                total += len(ids)
        return np.concatenate(parts), at, count

    def _advance(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi over words of equal length, a column each: their ids one word after the other, and how many."""
        n, width = block.shape
        if n > LONG_WORD and width < FEW_WORDS:
            steps = [self._advance_long("".join(map(chr, block[:, c].tolist()))) for c in range(width)]
            found = np.full((width, max(map(len, steps))), GAP, np.int64)
            for c, got in enumerate(steps):
                found[c, : len(got)] = got
            return self._spelt(found)
        sums, inverse = _rolling(block)
        total = np.concatenate([np.zeros((1, width), np.int64), np.cumsum(block, axis=0, dtype=np.int64)])
        best = np.full((n + 1, width), -np.inf)
        best[0] = 0.0
        back = np.zeros((n + 1, width), np.int32)
        piece = np.full((n + 1, width), -1, np.int32)
        for end in range(1, n + 1):
            top, frm, pid = best[end], back[end], piece[end]  # views
            known = np.zeros(0, np.int64)
            for m in range(min(self.longest, end), 0, -1):
                sub = _final((sums[end] - sums[end - m]) * inverse[end - m], m)
                may = np.flatnonzero(self.filter[(sub >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
                if not len(may):
                    continue
                at = np.minimum(np.searchsorted(self.keys, sub[may]), len(self.keys) - 1)
                # a second checksum confirms the keys
                hit = (self.keys[at] == sub[may]) & (self.key_sums[at] == total[end][may] - total[end - m][may])
                may, at = may[hit], at[hit]
                if m == 1:
                    known = may
                score = best[end - m][may] + self.key_scores[at]
                better = score > top[may]
                may, at, score = may[better], at[better], score[better]
                top[may], frm[may], pid[may] = score, end - m, self.ids[at]
            if len(known) < width:
                alone = np.ones(width, bool)
                alone[known] = False
                score = best[end - 1] + self.unknown
                rows = np.flatnonzero(alone & (score > top))
                top[rows], frm[rows], pid[rows] = score[rows], end - 1, -1
        return self._traced(block, back, piece)

    def _advance_long(self, text: str) -> list[int]:
        """Viterbi over one word: a whole text without spaces has no others of its length to advance with."""
        best, back = [0.0], [(0, -1)]
        for end in range(1, len(text) + 1):
            top, frm, pid = -np.inf, end - 1, -1
            for begin in range(max(0, end - self.longest), end):
                got = self.index.get(text[begin:end])
                if got is not None and best[begin] + got[0] > top:
                    top, frm, pid = best[begin] + got[0], begin, got[1]
            if text[end - 1] not in self.index and best[end - 1] + self.unknown > top:
                top, frm, pid = best[end - 1] + self.unknown, end - 1, -1
            best.append(top)
            back.append((frm, pid))
        out, at = [], len(text)
        while at:
            frm, pid = back[at]
            out.append(pid if pid >= 0 else -10 - ord(text[frm]))
            at = frm
        return out[::-1]

    def _traced(self, block: np.ndarray, back: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Follow the backpointers of all words together. A character of no piece becomes its byte pieces."""
        width = block.shape[1]
        cols = np.arange(width)
        at = np.full(width, block.shape[0])
        steps = []
        while at.any():
            got = np.where(at > 0, piece[at, cols], GAP)
            before = back[at, cols]
            lost = got == -1
            if lost.any():
                got[lost] = -10 - block[before[lost], cols[lost]].astype(np.int64)  # the character, to be spelt out
            steps.append(got)
            at = before
        return self._spelt(np.stack(steps[::-1], axis=1).astype(np.int64))

    def _merged(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges of words of equal length, a column each: their ids one word after the other, and how many."""
        n, width = block.shape
        found = np.full((width, n), GAP, np.int64)
        if n > LONG_WORD:
            for c in range(width):
                text = "".join(map(chr, block[:, c].tolist()))
                for a, b in self._merged_long(text):
                    found[c, a] = self.index[text[a:b]][1] if text[a:b] in self.index else -10 - ord(text[a])
            return self._spelt(found)
        sums, inverse = _rolling(block)
        total = np.concatenate([np.zeros((1, width), np.int64), np.cumsum(block, axis=0, dtype=np.int64)])

        def probe(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Whether the substrings a to b of words c are pieces, and the places of these in the keys."""
            sub = _final((sums[b, c] - sums[a, c]) * inverse[a], b - a)
            at = np.minimum(np.searchsorted(self.keys, sub), len(self.keys) - 1)
            return (self.keys[at] == sub) & (self.key_sums[at] == total[b, c] - total[a, c]), at

        def score(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
            hit, at = probe(a, b, c)
            return np.where(hit, self.key_scores[at], -np.inf)

        place, cols = np.arange(n), np.arange(width)
        end, before = np.repeat(place[:, None] + 1, width, axis=1), np.repeat(place[:, None] - 1, width, axis=1)
        alive = np.ones((n, width), bool)
        pair = np.full((n, width), -np.inf)  # of the symbol that begins here and the next one
        for a in range(n - 1):
            pair[a] = score(np.full(width, a), np.full(width, a + 2), cols)
        c = cols
        while True:
            p = np.argmax(pair[:, c], axis=0)
            go = pair[p, c] > -np.inf
            p, c = p[go], c[go]
            if not len(c):
                break
            q = end[p, c]
            e = end[q, c]
            end[p, c], alive[q, c], pair[q, c], pair[p, c] = e, False, -np.inf, -np.inf
            more = e < n
            x, y, z = p[more], e[more], c[more]
            before[y, z] = x
            pair[x, z] = score(x, end[y, z], z)
            r = before[p, c]
            more = r >= 0
            pair[r[more], c[more]] = score(r[more], e[more], c[more])
        c, a = np.nonzero(alive.T)
        hit, at = probe(a, end[a, c], c)
        found[c, a] = np.where(hit, self.ids[at], -10 - block[a, c].astype(np.int64))
        return self._spelt(found)

    def _merged_long(self, text: str) -> list[tuple[int, int]]:
        """The symbols of one word as (begin, end)."""
        n, none = len(text), (None, 0)
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(-s, a, a + 1, a + 2) for a in range(n - 1) if (s := self.index.get(text[a : a + 2], none)[0]) is not None]
        heapify(heap)
        while heap:
            _, p, q, e = heappop(heap)
            if not (alive[p] and end[p] == q and end[q] == e):
                continue
            end[p], alive[q] = e, False
            r = before[p]
            if e < n:
                before[e] = p
                if (s := self.index.get(text[p : end[e]], none)[0]) is not None:
                    heappush(heap, (-s, p, e, end[e]))
            if r >= 0 and (s := self.index.get(text[r:e], none)[0]) is not None:
                heappush(heap, (-s, r, p, e))
        return [(a, end[a]) for a in range(n) if alive[a]]

    def _spelt(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids from a row of steps for each word, with GAP where there is none and -10 - c for a character c to be spelt out."""
        width = len(found)
        flat = found[found != GAP]
        many = (found != GAP).sum(axis=1)
        if (flat >= 0).all():
            return flat.astype(np.int32), many
        spelt = {int(c): [self.bytes[b] for b in chr(-10 - int(c)).encode()] if self.bytes else [self.unk_id] for c in np.unique(flat[flat < 0])}
        grown = np.ones(len(flat), np.int64)
        for c, ids in spelt.items():
            grown[flat == c] = len(ids)
        out = np.repeat(flat, grown)
        place = np.append(0, np.cumsum(grown)[:-1])
        for c, ids in spelt.items():
            for k, i in enumerate(ids):
                out[place[flat == c] + k] = i
        whose = np.repeat(np.arange(width), many)
        return out.astype(np.int32), np.bincount(whose, weights=grown, minlength=width).astype(np.int64)

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
        """The texts of ids: marks become spaces, byte pieces are read as UTF-8 together with what stands beside
        them, control pieces vanish."""
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.pieces)):
            raise ValueError("an id has no piece")
        size = self.out_size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        raw = self.out_bytes[np.repeat(self.out_at[ids] - (ends - size), size) + np.arange(total)].tobytes()
        edge = np.append(0, ends)[offsets]
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(edge.tolist(), edge[1:].tolist(), strict=False)]
        return [t[1:] if self.dummy_prefix and t.startswith(" ") else t for t in texts]


def _rolling(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of weighted code points before each place, along the first axis, and the inverse weight of each place.

    The difference of two sums times the inverse weight of its begin is a polynomial of the substring alone.
    """
    n = codes.shape[0]
    weight = np.cumprod(np.append(np.uint64(1), np.full(n, FACTOR)), dtype=np.uint64)
    inverse = np.cumprod(np.append(np.uint64(1), np.full(n, INVERSE)), dtype=np.uint64)
    w = weight[:n].reshape(n, *[1] * (codes.ndim - 1))
    sums = np.zeros((n + 1, *codes.shape[1:]), np.uint64)
    np.cumsum(_mixed(codes) * w, axis=0, out=sums[1:])
    return sums, inverse


def _mixed(codes: np.ndarray) -> np.ndarray:
    """Code points spread over 64 bits."""
    x = (codes.astype(np.uint64) + np.uint64(1)) * SPREAD
    x ^= x >> np.uint64(29)
    return x * FACTOR


def _final(h: np.ndarray, m: int | np.ndarray) -> np.ndarray:
    """A substring's key from its polynomial and length."""
    x = h ^ (np.atleast_1d(np.asarray(m)).astype(np.uint64) * SPREAD)
    x = (x ^ (x >> np.uint64(32))) * SPREAD
    return x ^ (x >> np.uint64(29))


def _hash_one(piece: str) -> np.uint64:
    codes = np.array([ord(c) for c in piece], np.uint32)
    return _final(_rolling(codes)[0][-1:], len(piece))[0]


def encoded(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ids, an array of ints. Each task reads the model file once."""
    docs = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))

    def each():
        table = PieceTable.for_model(model)

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = part.column(1)
            offsets, ids = table.encode(texts.to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()), mask=texts.is_null())
            return pa.RecordBatch.from_arrays([part.column(0), lists], [id_col, "ids"])

        return work

    return map_texts(docs, each, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decoded(rows: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",), ids_col: str = "ids") -> DataFrame:
    """The columns of keep and text."""
    rows = rows.select(*keep, F.col(ids_col).alias("ids"))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PieceTable.load(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column(n)
                many = np.array(pa.compute.fill_null(pa.compute.list_value_length(lists), 0))
                texts = table.decode(np.append(0, np.cumsum(many)), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
                texts = pa.array(texts, pa.string(), mask=np.array(lists.is_null()))
                yield pa.RecordBatch.from_arrays([*part.columns[:n], texts], [*part.schema.names[:n], "text"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + ", text string")
