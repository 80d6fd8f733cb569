"""Near copies by SimHash, with candidates from pigeonring chains.

A fingerprint of 64 bits is a ring of four segments of 16. If two fingerprints differ in at most 3 bits, the ring
has a start from which every chain of l consecutive segments differs in at most floor(3 l / 4) bits: 0, 1, 2, 3.
So the first segment is equal and the next one, or the next two, differ in at most 1, or 2, bits. Keys hold the
first segment and those bytes of the following ones of which enough must be equal under that budget; fingerprints
with an equal key are candidates, the chain is checked segment by segment, and what is left gets the full check.

Only distinct fingerprints are compared. Keys that more than BLOCK fingerprints share are dealt out in pairs of
blocks, so no task holds a whole key; a block gives a spanning forest of its links, never all its pairs.

Cases: a text without words, also a null or empty one, has fingerprint zero and is linked as any other. Repeated
rows come out repeated. A null doc_id stands in no minimum: a component of null ids alone has a null id. An empty
table gives an empty result. Only the id and text columns are used, so other names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillwork.llm.components import components
from rillwork.llm.shared import fresh, map_texts, pieces, settled, with_answers, written

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: Fingerprints of one key that one task compares with each other, at most about twice as many in a pair of blocks.
BLOCK = 4096
#: From so many distinct fingerprints on, keys of 32 bits instead of 24 keep the candidates few.
LONG_KEYS_FROM = 1 << 23
#: Ids up to which those of dropped rows are broadcast, so that no text is shuffled; beyond, both sides are.
BROADCAST_ROWS = 1_000_000


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle: A-Z lowered, words joined by a space; one shingle of all words if they are fewer."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, "<u8")
    line = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(line, SEED)], "<u8")
    return np.fromiter((digest(line[a : b - 1], SEED) for a, b in zip(ends, ends[width:], strict=False)), "<u8", len(words) - width + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes, as a signed 64-bit number; zero without hashes."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, a long, for each row."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def each():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            fps = [fingerprint(shingle_hashes(x.as_py())) for x in part.column(1)]
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

        return work

    return map_texts(docs, each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _byte(fp: Column, n: int) -> Column:
    """Byte n of the ring, the first being the highest."""
    return F.shiftrightunsigned(fp, 56 - 8 * (n % 8)).bitwiseAND(F.lit(255).cast("long"))


def chain_keys(fp: Column, long_keys: bool) -> Column:
    """The keys of a fingerprint as an array of longs; the top bits say from which start and which bytes.

    Short keys: the next segment differs in at most 1 bit, so one of its two bytes is equal. Long keys: the next
    two differ in at most 1 and 2 bits together; either the first has two equal bytes, or each has one.
    """
    picks = [(2, 3), *((a, b) for a, b in combinations((2, 3, 4, 5), 2) if a < 4 <= b)] if long_keys else [(2,), (3,)]
    keys = []
    for start in range(4):
        for k, more in enumerate(picks):
            parts = [_byte(fp, 2 * start + n) for n in (0, 1, *more)]
            body = reduce(lambda x, y: F.shiftleft(x, 8).bitwiseOR(y), parts)
            keys.append(body.bitwiseOR(F.lit((start * 8 + k) << 40).cast("long")))
    return F.array(*keys)


def chain_holds(a: np.ndarray, b: np.ndarray, start: np.ndarray | int) -> np.ndarray:
    """Whether chains of 1 to 4 segments from `start` keep their budgets of 0, 1, 2 and 3 bits."""
    turn = (np.asarray(start) * 16).astype(np.uint64)
    x = a ^ b
    x = np.where(turn > 0, (x << turn) | (x >> ((64 - turn) % 64)), x)
    ok = (x >> np.uint64(48)) == 0
    for segments in (2, 3, 4):
        ok &= np.bitwise_count(x >> np.uint64(64 - 16 * segments)) <= segments * DISTANCE // 4
    return ok


def _joined(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Least member of each of n items' classes under the links a-b, on top of the classes in label."""
    label = np.arange(n) if label is None else label
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]


def _forest(fps: np.ndarray, starts: np.ndarray, runs: np.ndarray, sides: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys as (member, least member) pairs of rows.

    Short runs are compared all at once, row i with row i + d; long ones in stripes. In a run that pairs two
    blocks only rows of different blocks are compared.
    """
    n = len(fps)
    begin = np.flatnonzero(np.diff(runs, prepend=runs[0] - 1)) if n else np.zeros(0, int)
    length = np.diff(np.append(begin, n))
    label = np.arange(n)
    long_runs = length > 64
    size = np.repeat(length, length)
    last = np.repeat(begin + length, length)
    found_a, found_b = [], []
    for d in range(1, int(length[~long_runs].max(initial=1))):
        i = np.flatnonzero((np.arange(n) + d < last) & (size <= 64))
        i = i[(~pair[i]) | (sides[i] != sides[i + d])]
        i = i[chain_holds(fps[i], fps[i + d], starts[i])]
        found_a.append(i)
        found_b.append(i + d)
    if found_a:
        label = _joined(n, np.concatenate(found_a), np.concatenate(found_b), label)
    for s, m in zip(begin[long_runs], length[long_runs], strict=True):
        rows = np.arange(s, s + m)
        for at in range(0, m, 256):
            left = rows[at : at + 256]
            ok = chain_holds(fps[left][:, None], fps[rows][None, :], int(starts[s]))
            if pair[s]:
                ok &= sides[left][:, None] != sides[rows][None, :]
            i, j = np.nonzero(ok)
            label = _joined(n, left[i], rows[j], label)
    member = np.flatnonzero(label != np.arange(n))
    return member, label[member]


def _link_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key and pair of blocks. A run that goes on in the next batch is held back."""
    held: pa.Table | None = None

    def links(table: pa.Table) -> pa.RecordBatch:
        key, lo, hi, side, fp = (table.column(c).to_numpy() for c in ("key", "lo", "hi", "side", "fp"))
        change = (np.diff(key, prepend=key[:1]) != 0) | (np.diff(lo, prepend=lo[:1]) != 0) | (np.diff(hi, prepend=hi[:1]) != 0)
        member, root = _forest(fp.astype(np.int64).view(np.uint64), (key >> 43) & 3, np.cumsum(change), side, lo != hi)
        return pa.RecordBatch.from_arrays([pa.array(fp[member]), pa.array(fp[root])], ["u", "v"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        if not table.num_rows:
            continue
        ids = np.stack([table.column(c).to_numpy() for c in ("key", "lo", "hi")])
        other = np.flatnonzero((ids != ids[:, -1:]).any(axis=0))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield links(table.slice(0, cut))
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield links(held)


def fingerprint_links(distinct: DataFrame, long_keys: bool | None = None, block: int = BLOCK) -> DataFrame:
    """Links u, v between distinct fingerprints (column fp) at DISTANCE or less, enough of them to connect all."""
    if long_keys is None:
        long_keys = distinct.count() >= LONG_KEYS_FROM
    keys = distinct.select("fp", F.explode(chain_keys(F.col("fp"), long_keys)).alias("key"))
    busy = written(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block), "busy-keys")
    n_busy = busy.count()
    zero = F.lit(0).cast("int")
    if n_busy:
        # a row of `busy` stands for over `block` rows of keys; still it is broadcast only while it is small
        other = F.broadcast(busy) if n_busy <= 100_000 else busy
        keys = keys.join(other, "key", "left")
        blocks = F.coalesce(F.ceil(F.col("n") / block).cast("int"), F.lit(1))
        keys = keys.select("key", "fp", F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("side"), blocks.alias("blocks"))
        keys = keys.select("key", "fp", "side", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("other"))
        keys = keys.select("key", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "fp")
    else:
        keys = keys.select("key", zero.alias("lo"), zero.alias("hi"), zero.alias("side"), "fp")
    dealt = keys.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "fp")
    return dealt.mapInArrow(_link_runs, "u long, v long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id, the least doc_id that links reach, and component, the least print, for each row."""
    prints = written(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n__")), "distinct")
    return classed(prints, distinct, components(fingerprint_links(distinct.select("fp"))))


def classed(prints: DataFrame, distinct: DataFrame, classes: DataFrame) -> DataFrame:
    """doc_id, fp, component_id and component, its least print, for rows (doc_id, fp). distinct: fp, its least doc_id as first_doc, and its rows as
    n__; classes: node and component. Neither a print that many rows have nor a class of many prints goes to one task."""
    named = distinct.join(classes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_doc", "n__", F.coalesce("component", "fp").alias("component"))
    named = written(named, "named")
    least = named.groupBy("component").agg(F.min("first_doc").alias("component_id"), F.count("*").alias("size__"))
    by_print = written(with_answers(named, least, ["component"], n="size__").select("fp", "component_id", "component", "n__"), "classes")
    return with_answers(prints.select("doc_id", "fp"), by_print, ["fp"]).select("doc_id", "fp", "component_id", "component")


def hex_print(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def with_fingerprint(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """docs with a column for each text's fingerprint."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, at):
                prints = pa.array([fingerprint(shingle_hashes(x.as_py())) for x in part.column(at)], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, prints], [*part.schema.names, name])

    return docs.mapInArrow(run, docs.withColumn(name, F.lit(0).cast("long")).schema)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", find: Callable[..., DataFrame] = near_copies, with_print: Callable[[DataFrame, str, str], DataFrame] = with_fingerprint) -> DataFrame:
    """The rows that stand for their component: those with the least id and, of several with that id, the least print.

    Rows that repeat an id are told apart by their print, so a different text of a repeated id stays if it stands for a
    component of its own; of rows with one id and one print the least text stays. Rows with a null id can't stand for a
    group and all stay. with_print adds the print that find gives as fp.
    """
    found = settled(docs.sparkSession, lambda: find(docs, id_col, text_col), "near-copies")
    rows = found.where("doc_id is not null")
    per = rows.groupBy(F.col("doc_id").alias(id_col)).agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stands"), F.count("*").alias("n"))
    per = written(per.where("not stands or n > 1"), "drop")
    sizes = {r["again"]: r["count"] for r in per.groupBy((F.col("n") > 1).alias("again")).count().collect()}
    few = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    kept = docs.join(few(per.select(id_col), sum(sizes.values())), id_col, "left_anti")
    if not sizes.get(True):
        return kept
    again = few(per.where("n > 1").select(id_col), sizes[True])
    fp, no = (fresh(docs, c) for c in ("fp__", "no__"))
    best = rows.where("doc_id = component_id").groupBy("component", F.col("component_id").alias(id_col)).agg(F.min("fp").alias(fp)).select(id_col, fp)
    best = written(best.join(again, id_col, "left_semi"), "stand")
    same = with_print(docs.join(again, id_col, "left_semi"), text_col, fp).join(few(best, sizes[True]), [id_col, fp], "left_semi")
    first = same.withColumn(no, F.row_number().over(Window.partitionBy(id_col, fp).orderBy(F.xxhash64(text_col), F.col(text_col)))).where(F.col(no) == 1)
    return kept.unionByName(first.select(*docs.columns))
