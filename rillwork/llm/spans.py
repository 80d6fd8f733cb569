"""Alignment of two tokenizers over the same text, and how often each pair of ids is linked in the corpus.

The text is cut at places that no token of either tokenizer crosses: before a space or a line end between two other
characters, and, if the second model has no piece across it, between a Latin letter and an ASCII sign. The places are found
in the bytes of many texts at once, and Arrow tells the distinct segments. Each of these is encoded once in a task. The tokenizers' character offsets and the second model's spans are the coarse cuts; where
tokens share a character, or a character went to several byte tokens, the lengths of the decoded bytes refine them.
Places where both have a cut part the segment into groups; all pairs of tokens of a group are linked.

Texts are encoded once, a slice of documents at a time. A slice keeps the documents that hold each pair of ids, and its
documents as numbers of its segments; this is written. The slices' counts are summed up, a table that is bounded by the two
vocabularies and not by the corpus. While it has BROADCAST_PAIRS rows at most it goes to the tasks that sum up each
document; a larger one meets the slices' pairs in a join. Both give the same.

Cases: texts that are null or empty, or whose tokens' bytes aren't the text (a literal U+2581 for instance), have no tokens:
zeros, and '' as groups. Rows with a null id are texts like others; repeated rows count as often as they stand. Very
long texts are cut into segments block by block. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.llm.shared import map_texts, with_answers, written

#: Distinct pairs whose counts are sent to the tasks, 17 bytes each.
BROADCAST_PAIRS = 2_000_000
#: Segments that a task keeps, and characters of them, at most about. Of more the rarer ones go.
KEPT_SEGMENTS, KEPT_CHARS = 320_000, 12 << 20
#: Bytes of the texts of a slice.
SLICE_BYTES = 2 << 20
#: Characters that are encoded in one call, and bytes of a text that are cut at a time.
CALL_CHARS, BLOCK_CHARS = 1 << 13, 1 << 20
#: Bytes whose segments are looked up together.
TAKE_CHARS = 4 << 20
#: A pair of ids as one number.
SHIFT = 32
#: Links of a group from which its distinct ids are paired, not its tokens.
LARGE_GROUP = 4096

#: Between letters of U+0041 to U+027F and ASCII signs.
SIGNS = r"(?<=[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u027f])(?=[!-/:-@\[-`{-~])"
BLANK, LETTER, SIGN = (np.array([b < 128 and bool(re.match(p, chr(b))) for b in range(256)]) for p in (r"\s", "[A-Za-z]", r"[!-/:-@\[-`{-~]"))
#: White space beyond ASCII, in UTF-8: by length of the character, its bytes as one number.
WIDE_BLANK = {n: [int.from_bytes(x) for x in (chr(c).encode() for c in range(128, 1 << 16) if chr(c).isspace()) if len(x) == n] for n in (2, 3)}
WIDE_LEAD = np.isin(np.arange(256), [c >> 8 * (n - 1) for n, x in WIDE_BLANK.items() for c in x])


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others, in
    order, for 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; for ints a sort is some times as fast as the hashes of np.unique()."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])[: len(x)]]


def _starts(data: np.ndarray, signs: bool) -> np.ndarray:
    """At which UTF-8 bytes a segment starts: a space or line end between two other characters; with `signs` also an ASCII
    sign after a Latin letter."""
    blank = BLANK[data]
    lead = np.flatnonzero(WIDE_LEAD[data])
    if len(lead):
        three = np.append(data, [0, 0]).astype(np.int64)[lead[:, None] + np.arange(3)] @ [1 << 16, 1 << 8, 1]
        for n, codes in WIDE_BLANK.items():
            blank[lead[np.isin(three >> 8 * (3 - n), codes)][:, None] + np.arange(n)] = True
    start = np.zeros(len(data), bool)
    start[1:-1] = ((data == 32) | (data == 10))[1:-1] & ~blank[:-2] & ~blank[2:]
    if signs:
        letter = LETTER[data]
        letter[1:] |= (data[:-1] >= 0xC3) & (data[:-1] <= 0xC9) & ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
        start[1:] |= letter[:-1] & SIGN[data[1:]]
    return start


def _spans(offsets: list[tuple[int, int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(offsets), np.int64, 2 * len(offsets)).reshape(-1, 2)


class Tokenizers:
    """Both tokenizers, loaded in a task, with the bytes of each of their tokens."""

    def __init__(self, a_file: str, b_file: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        with open(a_file, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or not spec["pre_tokenizer"].get("use_regex", True):
            raise ValueError("the first tokenizer must be byte-level, with its usual pattern and no normaliser")
        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        byte = byte_alphabet()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for piece, i in self.a.get_vocab(with_added_tokens=False).items():
            self.a_bytes[i] = bytes(byte[c] for c in piece)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        vocabulary = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(vocabulary)]
        words = [p for i, p in enumerate(vocabulary) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        if any(re.search("[^▁]▁", p) or "\n" in p for p in words):
            raise ValueError("the second model has pieces across words or lines")
        self.signs = not any(re.search(SIGNS, p) for p in words)
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))

    def cuts_a(self, text: str, raw: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """Ids, byte ends, and whether the bytes are the text's, which are given with the places where characters end."""
        e = self.a.encode(text, add_special_tokens=False)
        ids = np.array(e.ids, np.int64)
        return ids, *self._refined(raw, at, ids, _spans(e.offsets), self.a_len, self.a_bytes)

    def cuts_b(self, text: str, raw: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """The same of the model that writes a space before the text by itself; text starts with that space."""
        e = self.b.encode_as_offset_mapping(text[1:])
        ids, spans = np.array(e["ids"], np.int64), _spans(e["offsets"]) + 1
        if len(spans) and spans[0, 1] > 1:
            spans[0, 0] = 0  # the first piece has the space in it
        return ids, *self._refined(raw, at, ids, spans, self.b_len, self.b_bytes)

    @staticmethod
    def _refined(raw: bytes, at: np.ndarray, ids: np.ndarray, spans: np.ndarray, size: np.ndarray, table: list[bytes]) -> tuple[np.ndarray, bool]:
        if b"".join([table[i] for i in ids.tolist()]) != raw:
            return np.zeros(0, np.int64), False
        begin, end, chars = spans[:, 0], spans[:, 1], len(at) - 1
        whole = (end > begin) & (np.append(begin[1:], chars) == end)  # this token ends where a character does
        coarse = at[np.minimum(end, chars)]
        ends = np.cumsum(size[ids])
        before = np.maximum.accumulate(np.where(whole, np.arange(len(ids)), -1))
        before = np.append(-1, before[:-1])
        refined = np.where(before >= 0, coarse[before] + ends - ends[before], ends)  # decoded bytes since the last sure cut
        ends = np.where(whole, coarse, refined)
        return ends, bool(len(ends)) and bool(ends[-1] == len(raw)) and bool((np.diff(ends) > 0).all())


@dataclass(frozen=True)
class Encoded:
    """Segments that were encoded together: for each ok, n_a, n_b, n_groups, n_links and n_pairs; the text of its groups; and
    the distinct pairs of all, segment after segment, with how often each is linked."""

    names: list[str]
    numbers: np.ndarray
    groups: list[str]
    pairs: np.ndarray
    mult: np.ndarray


def _linked(a: np.ndarray, b: np.ndarray, a_from: np.ndarray, b_from: np.ndarray, na: np.ndarray, nb: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, pair of ids and times of each distinct linked pair of each owner of groups."""
    links = na * nb
    small = links <= LARGE_GROUP
    n = np.where(small, links, 0)
    g = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n)
    keys, owners, times = [(a[a_from[g] + within // nb[g]] << SHIFT) | b[b_from[g] + within % nb[g]]], [owner[g]], [np.ones(len(g), np.int64)]
    for x in np.flatnonzero(~small):
        (ua, ca), (ub, cb) = (np.unique(v[f : f + m], return_counts=True) for v, f, m in ((a, a_from[x], na[x]), (b, b_from[x], nb[x])))
        keys.append(((ua[:, None] << SHIFT) | ub[None, :]).ravel())
        owners.append(np.full(len(keys[-1]), owner[x]))
        times.append((ca[:, None] * cb[None, :]).ravel())
    known, pair = np.unique(np.concatenate(keys), return_inverse=True)
    both, where = np.unique(np.concatenate(owners) * max(len(known), 1) + pair, return_inverse=True)
    total = np.zeros(len(both), np.int64)
    np.add.at(total, where, np.concatenate(times))
    return both // max(len(known), 1), known[both % max(len(known), 1)], total


class Segments:
    """What is known of a task's segments: counts, the text of the groups, and the distinct linked pairs of each."""

    def __init__(self, tokenizers: Tokenizers, texts: bool) -> None:
        self.t, self.texts = tokenizers, texts
        self.index: dict[str, int] = {}
        self.chars = 0
        self.ok, self.n_a, self.n_b, self.n_groups, self.n_links, self.n_pairs, self.used = (np.zeros(0, np.int64) for _ in range(7))
        self.groups: list[str] = []
        self.pairs, self.mult = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of segment after segment

    def forget(self) -> None:
        """Keep half of what is kept at most, the segments that came most often; long ones go."""
        if len(self.index) <= KEPT_SEGMENTS and self.chars <= KEPT_CHARS:
            return
        names = list(self.index)
        most = KEPT_CHARS // max(KEPT_SEGMENTS, 1)
        short = np.fromiter((len(x) <= most for x in names), bool, len(names))
        keep = np.sort(np.argsort(np.where(short, -self.used, 1), kind="stable")[: KEPT_SEGMENTS // 2])
        keep = keep[short[keep]]
        where, _ = self.pairs_of(keep)
        self.pairs, self.mult = self.pairs[where], self.mult[where]
        for c in ("ok", "n_a", "n_b", "n_groups", "n_links", "n_pairs", "used"):
            setattr(self, c, getattr(self, c)[keep])
        self.used //= 2
        left = keep.tolist()
        self.groups = [self.groups[i] for i in left]
        self.index = {names[i]: k for k, i in enumerate(left)}
        self.chars = sum(map(len, self.index))

    def add(self, new: list[str]) -> None:
        """Segments that aren't known yet: joined in few calls, those with spaces at an end or of great length alone."""
        parts: list[list[str]] = []
        size = CALL_CHARS
        alone = []
        for s in new:
            if len(s) > CALL_CHARS or s[-1].isspace() or s[:2].isspace():
                alone.append([s])
                continue
            if size >= CALL_CHARS:
                parts.append([])
                size = 0
            parts[-1].append(s)
            size += len(s) + 2
        done = [x for p in parts + alone for x in self._encoded(p)]
        names = [n for x in done for n in x.names]
        at = len(self.index)
        self.index.update(zip(names, range(at, at + len(names)), strict=True))
        self.chars += sum(map(len, names))
        numbers = np.concatenate([np.zeros((0, 6), np.int64), *(x.numbers for x in done)])
        for k, c in enumerate(("ok", "n_a", "n_b", "n_groups", "n_links", "n_pairs")):
            setattr(self, c, np.append(getattr(self, c), numbers[:, k]))
        self.used = np.append(self.used, np.zeros(len(names), np.int64))
        self.groups += [g for x in done for g in x.groups]
        self.pairs = np.concatenate([self.pairs, *(x.pairs for x in done)])
        self.mult = np.concatenate([self.mult, *(x.mult for x in done)])

    def _encoded(self, segs: list[str]) -> list[Encoded]:
        fill = [" a" if s[0] not in " \n" else "" for s in segs]
        text = " a" + "".join(f + s for f, s in zip(fill, segs, strict=True)) if len(segs) > 1 or segs[0][0] != " " else segs[0]
        lead = 0 if text is segs[0] else 2
        raw = text.encode()
        # where each character ends
        at = np.arange(len(text) + 1) if len(raw) == len(text) else np.append(0, np.flatnonzero((np.frombuffer(raw + b"a", np.uint8) & 0xC0) != 0x80)[1:])
        (a, a_end, a_ok), (b, b_end, b_ok) = self.t.cuts_a(text, raw, at), self.t.cuts_b(text, raw, at)
        size = np.fromiter(map(len, segs), np.int64, len(segs))
        gap = np.fromiter(map(len, fill), np.int64, len(segs)) if lead else np.zeros(1, np.int64)
        stop = lead + np.cumsum(size + gap)
        start, stop = at[stop - size], at[stop]
        sure = a_ok and b_ok
        if sure:
            common = np.intersect1d(a_end, b_end, assume_unique=True)
            edges = np.concatenate([start[start > 0], stop])
            sure = bool(np.isin(edges, common).all())
        if not sure:
            if len(segs) == 1:
                return [Encoded(segs, np.zeros((1, 6), np.int64), [""], np.zeros(0, np.int64), np.zeros(0, np.int64))]
            half = len(segs) // 2
            return self._encoded(segs[:half]) + self._encoded(segs[half:])
        a_to, b_to = np.searchsorted(a_end, common, "right"), np.searchsorted(b_end, common, "right")
        a_from, b_from = np.append(0, a_to[:-1]), np.append(0, b_to[:-1])
        first, last = np.searchsorted(common, start, "right"), np.searchsorted(common, stop, "right")
        owner = np.repeat(np.arange(len(segs)), last - first)  # the segment of each group that isn't filling
        own = np.repeat(first - np.append(0, np.cumsum(last - first)[:-1]), last - first) + np.arange(len(owner))
        na, nb = a_to - a_from, b_to - b_from
        seg, pairs, mult = _linked(a, b, a_from[own], b_from[own], na[own], nb[own], owner)
        sums = [np.append(0, np.cumsum(x)) for x in (na, nb, na * nb)]
        n_a, n_b, n_links = (x[last] - x[first] for x in sums)
        numbers = np.stack([np.ones(len(segs), np.int64), n_a, n_b, last - first, n_links, np.bincount(seg, minlength=len(segs))], axis=1)
        said = [""] * len(segs)
        if self.texts:
            a_text, b_text = (list(map(str, x.tolist())) for x in (a, b))
            bounds = zip(a_from.tolist(), a_to.tolist(), b_from.tolist(), b_to.tolist(), strict=True)
            each = [f"{a_text[i]}|{b_text[k]}" if j - i == m - k == 1 else f"{','.join(a_text[i:j])}|{','.join(b_text[k:m])}" for i, j, k, m in bounds]
            said = [";".join(each[lo:hi]) for lo, hi in zip(first.tolist(), last.tolist(), strict=True)]
        return [Encoded(segs, numbers, said, pairs, mult)]

    def placed(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Segment numbers of text after text, and where each text's end; texts whose tokens aren't the text have none."""
        self.forget()
        found: list[np.ndarray] = []
        held: list[bytes] = []
        owners: list[int] = []
        many = np.zeros(len(texts), np.int64)

        def take() -> None:
            data = b"".join(held)
            begin = np.cumsum([0, *map(len, held)])[:-1]
            start = _starts(np.frombuffer(data, np.uint8), self.t.signs)
            start[begin] = True
            at = np.append(np.flatnonzero(start), len(data))
            segs = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data)).dictionary_encode()
            names = segs.dictionary.to_numpy(zero_copy_only=False).tolist()
            numbers = np.fromiter(map(self.index.get, names, repeat(-1)), np.int64, len(names))
            unknown = np.flatnonzero(numbers < 0)
            if len(unknown):
                new = [names[k] for k in unknown.tolist()]
                self.add(new)
                numbers[unknown] = np.fromiter(map(self.index.__getitem__, new), np.int64, len(new))
            found.append(numbers[segs.indices.to_numpy()])
            np.add.at(many, owners, np.diff(np.append(np.searchsorted(at, begin), len(at) - 1)))
            held.clear()
            owners.clear()

        size = 0
        for i, x in enumerate(texts.cast(pa.large_binary())):
            raw = x.as_py()
            for block in self._blocks(b" " + raw) if raw else ():
                held.append(block)
                owners.append(i)
                size += len(block)
                if size > TAKE_CHARS:
                    take()
                    size = 0
        if held:
            take()
        place = np.concatenate([np.zeros(0, np.int64), *found])
        end = np.append(0, np.cumsum(many))
        self.used += np.bincount(place, minlength=len(self.used))
        text_no = np.repeat(np.arange(len(texts)), many)
        wrong = np.bincount(text_no, weights=1 - self.ok[place], minlength=len(texts)) > 0
        if wrong.any():
            keep = ~wrong[text_no]
            place, end = place[keep], np.append(0, np.cumsum(np.bincount(text_no[keep], minlength=len(texts))))
        return place, end

    def _blocks(self, text: bytes) -> Iterator[bytes]:
        at, size = 0, BLOCK_CHARS
        while len(text) - at > size:
            # not the last bytes, where a character may be cut
            starts = np.flatnonzero(_starts(np.frombuffer(text, np.uint8, size, at), self.t.signs)[:-3])
            if len(starts):
                yield text[at : at + starts[-1]]
                at, size = at + int(starts[-1]), BLOCK_CHARS
            else:
                size *= 2
        yield text[at:]

    def pairs_of(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in pairs and mult of the segments, and the index in `place` that each belongs to."""
        n = self.n_pairs[place]
        start = (np.cumsum(self.n_pairs) - self.n_pairs)[place]
        which = np.repeat(np.arange(len(place)), n)
        return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(len(which)), which


def _document_pairs(s: Segments, place: np.ndarray, end: np.ndarray) -> dict[str, np.ndarray]:
    """What a slice of texts holds, for later: its distinct pairs (pairs) and how many texts have each (held); its distinct
    segments' pairs as places in pairs (of), how many each segment has (many) and how often each is linked (times); and the
    segments of text after text (place)."""
    used = np.flatnonzero(np.bincount(place, minlength=len(s.ok)))
    new = np.zeros(len(s.ok), np.int64)
    new[used] = np.arange(len(used))
    place = new[place]
    where, _ = s.pairs_of(used)
    known, pair = np.unique(s.pairs[where], return_inverse=True)
    many = s.n_pairs[used]
    begin = np.cumsum(many) - many
    text_no = np.repeat(np.arange(len(end) - 1), np.diff(end))
    both = _distinct(text_no * np.int64(max(len(used), 1)) + place)  # each segment of a text once
    seg = both % max(len(used), 1)
    n = many[seg]
    at = np.repeat(begin[seg] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    held = _distinct(np.repeat(both // max(len(used), 1), n) * np.int64(max(len(known), 1)) + pair[at])
    return {"pairs": known, "held": np.bincount(held % max(len(known), 1), minlength=len(known)), "of": pair, "many": many, "times": s.mult[where], "place": place}


#: What of a slice is packed into one value, as ints.
PACKED = ("of", "many", "times", "place", "end")


def _packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays of ints as one compressed value: lengths, then the ints. A task that reads a slice holds this, and unpacks
    one slice at a time."""
    head = np.array([len(a) for a in arrays], "<i8").tobytes()
    return head + pa.Codec("zstd", 1).compress(np.concatenate([*arrays, [0]]).astype("<i4").tobytes(), asbytes=True)


def _unpacked(value: bytes) -> list[np.ndarray]:
    size = np.frombuffer(value, "<i8", len(PACKED))
    ints = np.frombuffer(pa.Codec("zstd").decompress(value[8 * len(PACKED) :], 4 * int(size.sum() + 1), asbytes=True), "<i4")
    return np.split(ints[:-1], np.cumsum(size)[:-1])


def _slices(docs: DataFrame, a_file: str, b_file: str, texts: bool) -> DataFrame:
    """A row for each slice of documents: the counts of each document and its groups, or the hash of them; the slice's pairs
    and how many documents have each; and the rest of what _document_pairs() says, with the places where documents end,
    packed."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ("n_a", "n_b", "n_groups", "n_links")

    def each():
        s = Segments(Tokenizers(a_file, b_file), True)

        def row(x: pa.Array | np.ndarray) -> pa.Array:
            flat = x if isinstance(x, pa.Array) else pa.array(x)
            return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            place, end = s.placed(part.column(1))
            sums = [np.diff(np.append(0, np.cumsum(x[place]))[end]) for x in (s.n_a, s.n_b, s.n_groups, s.n_links)]
            where = place.tolist()
            said = [";".join([s.groups[i] for i in where[lo:hi]]) for lo, hi in zip(end[:-1].tolist(), end[1:].tolist(), strict=True)]
            if not texts:
                said = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in said]
            known = _document_pairs(s, place, end)
            packed = _packed([*(known[c] for c in PACKED[:-1]), end[1:]])
            lists = [row(x) for x in (part.column(0), *sums, pa.array(said, pa.string()), known["pairs"], known["held"].astype(np.int32))]
            return pa.RecordBatch.from_arrays([*lists, pa.array([packed], pa.binary())], ["doc_id", *counts, "groups", "pairs", "held", "packed"])

        return work

    schema = f"doc_id array<{kind}>, {', '.join(f'{c} array<long>' for c in counts)}, groups array<string>, pairs array<long>, held array<int>, packed binary"
    return map_texts(docs, each, schema, most=SLICE_BYTES)


def with_best(counts: DataFrame) -> DataFrame:
    """Add best: whether no pair with the same first id has a higher count. There are as many first ids as the vocabulary has."""
    first = counts.withColumn("a", F.shiftright("pair", SHIFT))
    most = first.groupBy("a").agg(F.max("n").alias("most"))
    return first.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", texts: bool = True, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups, the alignment itself, for each row.

    groups has the ids of each group in order: those of the first tokenizer by commas, |, those of the second, and ; between
    groups. Without texts it is the SHA-256 of that in lower-case hex, '' without tokens: the text is some times as long as
    the document. n_best: links whose pair is the most common one of its first id; count_sum: the counts of all links.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    slices = written(_slices(docs, a_file, b_file, texts), "aligned-slices")
    held = slices.select(F.inline(F.arrays_zip("pairs", "held"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum(F.col("held").cast("long")).alias("n"))
    counts = written(with_best(written(held, "pair-counts")), "pairs")
    small = counts.count() <= broadcast_pairs
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "packed"]
    if small:
        table = counts.sort("pair").toArrow()
        pair, n, best = (table.column(c).to_numpy() for c in ("pair", "n", "best"))
        rows = slices.select(*columns, "pairs")
    else:
        rows = _with_counts(slices, counts).select(*columns, "met")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                v = {c: batch.column(c)[r].values for c in batch.schema.names if c != "packed"}
                of, many, times, place, end = _unpacked(batch.column("packed")[r].as_py())
                if small:
                    at = np.searchsorted(pair, v["pairs"].to_numpy())
                    number, most = n[at], best[at]
                else:
                    met = v["met"]
                    order = np.argsort(met.field("at").to_numpy())
                    number, most = met.field("n").to_numpy()[order], met.field("best").to_numpy(zero_copy_only=False)[order]
                owner = np.repeat(np.arange(len(many)), many)
                sums = []
                for x in (most.astype(np.int64), number):
                    of_segment = np.zeros(len(many), np.int64)
                    np.add.at(of_segment, owner, times.astype(np.int64) * x[of])
                    sums.append(pa.array(np.diff(np.append(0, np.cumsum(of_segment[place]))[np.append(0, end)])))
                yield pa.RecordBatch.from_arrays([v["doc_id"], v["n_a"], v["n_b"], v["n_groups"], v["n_links"], *sums, v["groups"]], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")


def _with_counts(slices: DataFrame, counts: DataFrame) -> DataFrame:
    """Slices with met, the counts of their pairs by place, by a join. A pair stands once in a slice, so none is hot unless
    there are very many slices; a slice's pairs are bounded by its text."""
    numbered = written(slices.withColumn("slice", F.monotonically_increasing_id()), "numbered-slices")
    pairs = numbered.select("slice", F.posexplode("pairs").alias("at", "pair"))
    held = written(counts.join(pairs.groupBy("pair").agg(F.count("*").alias("n__")), "pair"), "pairs-held")
    met = with_answers(pairs, held, ["pair"]).groupBy("slice").agg(F.collect_list(F.struct("at", "n", "best")).alias("met"))
    return numbered.join(met, "slice", "left").withColumn("met", F.coalesce("met", F.array().cast("array<struct<at:int,n:bigint,best:boolean>>")))
