"""Near copies by the Jaccard similarity of word shingles: every pair of SIMILAR or more is linked.

SimHash prints of the shingle sets come first: those that pigeonring chains find at 3 or fewer bits (simhash.py) are candidates,
and sets that are similar enough are linked. A similarity of 0.8 may lie further apart, so a prefix filter finds all other pairs.

Shingles stand in one order for all texts, rare ones first. Two sets of n shingles at most that are similar enough
share one of their first n // 5 + 1 shingles (prefix filter), so texts with a common one there are candidates; sizes
and places bound what a pair can share, and what is left is compared shingle by shingle, by their 64-bit hashes, where the
sets of a hub's pairs meet. What is rare is estimated on a sample of texts that grows with the table: it changes the cost alone, as any common
order gives the same links.

A group of m copies never meets in m * m pairs. Texts with equal sets are one. By the first FIRST_KEYS shingles of a
prefix each text meets the first and the previous one of its key, which links most groups at little cost; by the whole
prefixes it meets these two only where they are in other components. Only keys whose texts are then still of several
components have these meet in pairs, those with more than BLOCK texts in pairs of blocks. Rows lie in ranges of keys and
texts, so a key that many texts have is spread over tasks; of a key at the edge of a range a task can't tell whether its
texts are of one component, so its rows stay until they are summed up.

Cases: texts without words are equal. Rows with a null doc_id are left out. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.llm.components import components
from rillwork.llm.shared import CHUNK_BYTES, forget, map_texts, pieces, settled, short_shuffles, with_answers, written
from rillwork.llm.simhash import BLOCK, SEED, classed, fingerprint, fingerprint_links, shingle_hashes

WORDS = 5
#: Least similarity of near copies, as a fraction of whole numbers.
SIMILAR = (4, 5)
#: The order of shingles is estimated on about so many texts or, of a large table, one text in SAMPLE_EVERY, so that a
#: shingle of some thousand texts is known as common in a table of any size.
SAMPLE_ROWS, SAMPLE_EVERY = 20_000, 400
#: So many of the most common shingles are told apart: one for TEXTS_A_SHINGLE texts, within bounds (16 bytes each).
COMMON, MOST_COMMON, TEXTS_A_SHINGLE = 100_000, 1_000_000, 1_000
#: Ids of up to so many texts are broadcast to pick out their texts; more are met by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Shingles of a prefix by which texts meet first.
FIRST_KEYS = 8
#: Pairs of a task that go out together, at least.
PAIRS = 1 << 17
#: Rows of a key that are held at a time.
RUN = 1 << 18
#: Pairs of a hub that are compared in one place, about, and first bytes of a hash that are compared before whole ones.
HUB, SHORT = 512, 3


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct shingle hashes in order."""
    return np.unique(shingle_hashes(text, WORDS))


def set_print(hashes: np.ndarray) -> int:
    """One signed 64-bit number for a set of shingles."""
    import xxhash

    return int(np.array([xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), SEED)], np.uint64).view(np.int64)[0])


def prefix(hashes: np.ndarray, common: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The first shingles of a set, one more than a similar set may lack. common: sorted hashes, with their counts."""
    most = len(hashes) * (SIMILAR[1] - SIMILAR[0]) // SIMILAR[1] + 1
    if not len(common):
        return hashes[:most]
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    weight = np.where(common[at] == hashes, count[at], 0)
    return hashes[np.argsort(weight, kind="stable")[:most]]


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles of a sample of texts, sorted, and their counts."""
    n = docs.count()
    if n > SAMPLE_ROWS:
        share = max(SAMPLE_ROWS / n, 1 / SAMPLE_EVERY)
        docs = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def each():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *(shingle_set(x.as_py()) for x in part.column(1))]).view(np.int64))], ["key"])

        return work

    counts = map_texts(docs, each, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 2")
    with short_shuffles(docs.sparkSession):
        rows = counts.orderBy(F.desc("n"), "key").limit(max(COMMON, min(MOST_COMMON, n // TEXTS_A_SHINGLE))).toPandas()
    keys = rows["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], rows["n"].to_numpy(np.int64)[order]


def _prefixes(docs: DataFrame) -> DataFrame:
    """doc_id, fp, n (shingles), keys, the prefix, and sim, the SimHash of the set, for each row."""
    common, count = _common(docs)

    def each():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(x.as_py()) for x in part.column(1)]
            keys = [prefix(s, common, count).view(np.int64) for s in sets]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate(keys), pa.int64()))
            return pa.RecordBatch.from_arrays([part.column(0), pa.array([set_print(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), lists, pa.array([fingerprint(s) for s in sets], pa.int64())], ["doc_id", "fp", "n", "keys", "sim"])

        return work

    return map_texts(docs, each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long, n int, keys array<long>, sim long")


def _chained(stand: DataFrame) -> DataFrame:
    """Pairs u, v of prints (fp) whose SimHashes (sim) are equal or, by pigeonring chains, near; enough of them to connect all."""
    heads = written(stand.groupBy("sim").agg(F.min("fp").alias("head"), F.count("*").alias("n__")), "simhashes")
    near = written(fingerprint_links(heads.select(F.col("sim").alias("fp"))), "chained")
    head = heads.select("sim", "head")
    far = near.join(head.toDF("u", "a"), "u").join(head.toDF("v", "b"), "v").select("a", "b")
    both = with_answers(stand.select("sim", "fp"), heads, ["sim"]).select(F.col("fp").alias("a"), F.col("head").alias("b")).union(far)
    return both.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _can_match(n: np.ndarray, pos: np.ndarray, m: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles whose first common one stands at pos and at `at` may be similar enough."""
    shared = np.minimum(n - pos, m - at)
    return (SIMILAR[1] * np.minimum(n, m) >= SIMILAR[0] * np.maximum(n, m)) & (sum(SIMILAR) * shared >= SIMILAR[0] * (n + m))


def _whole_runs(batches: Iterator[pa.RecordBatch], by: list[str], most: int = 1 << 62) -> Iterator[tuple[pa.Table, bool]]:
    """Rows come sorted by the columns of `by`. A run of equal values that goes on in the next batch is held back. The
    flag tells a part of a run of over `most` rows, which isn't held."""
    held: list[pa.Table] = []
    rows, long_run = 0, False
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        ids = np.stack([table.column(c).to_numpy() for c in by])
        other = np.flatnonzero((ids != ids[:, -1:]).any(axis=0))
        cut = int(other[-1]) + 1 if len(other) else 0
        if long_run:
            same = np.flatnonzero((ids != np.array(last)[:, None]).any(axis=0))
            end = int(same[0]) if len(same) else table.num_rows
            if end:
                yield table.slice(0, end), True
            long_run = end == table.num_rows
            table, cut = table.slice(end), max(cut - end, 0)
            if not table.num_rows:
                continue
        if not cut and held and [held[-1].column(c)[-1].as_py() for c in by] != [table.column(c)[0].as_py() for c in by]:
            yield pa.concat_tables(held), False
            held, rows = [], 0
        if cut:
            yield pa.concat_tables([*held, table.slice(0, cut)]), False
            held, rows = [], 0
        held.append(table.slice(cut))
        rows += table.num_rows - cut
        if rows > most:
            yield pa.concat_tables(held), True
            last, long_run, held, rows = [held[-1].column(c)[-1].as_py() for c in by], True, [], 0
    if held:
        yield pa.concat_tables(held), False


def _columns(table: pa.Table) -> dict[str, np.ndarray]:
    return {c: table.column(c).to_numpy().astype(np.int64) for c in table.column_names}


def _ordered_pairs(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, the larger print first."""
    u, v = np.concatenate([*a, np.zeros(0, np.int64)]), np.concatenate([*b, np.zeros(0, np.int64)])
    pairs = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)]), axis=1)
    return pairs[0], pairs[1]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text of a key with the first and the previous one, where they may match. Pairs of a task go out once, as
    long as they are few. Rows come sorted by key, pos, fp; of a long run every part has a first text of its own."""
    u, v, size = [], [], 0

    def out() -> pa.RecordBatch:
        a, b = _ordered_pairs(u, v)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])

    held = None  # the last row of a part, which the next part of a long run goes on from
    for table, part in _whole_runs(batches, ["key"], RUN):
        c = _columns(table if held is None else pa.concat_tables([held, table]))
        held = table.slice(table.num_rows - 1) if part else None
        again = np.append(False, (np.diff(c["key"]) == 0) & (np.diff(c["fp"]) == 0))
        c = {k: x[~again] for k, x in c.items()}
        starts = np.append(True, np.diff(c["key"]) != 0)
        first = np.flatnonzero(starts)[np.cumsum(starts) - 1]
        rows = np.arange(len(starts))
        for other in (first, np.maximum(rows - 1, first)):
            ok = (other != rows) & _can_match(c["n"], c["pos"], c["n"][other], c["pos"][other]) & (c["fp"] != c["fp"][other])
            u.append(c["fp"][ok])
            v.append(c["fp"][other[ok]])
            size += int(ok.sum())
        if size >= PAIRS:
            yield out()
            u, v, size = [], [], 0
    if size:
        yield out()


def _pairs_across(c: dict[str, np.ndarray], run: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of texts of a run that are in different components and may match. Rows come sorted by n in each run."""
    n, pos, fp, comp, side, pair = c["n"], c["pos"], c["fp"], c["comp"], c["side"], c["lo"] != c["hi"]
    i, d = np.arange(len(run)), 0
    while len(i):
        d += 1
        i = i[i + d < len(run)]
        j = i + d
        near = (run[i] == run[j]) & (SIMILAR[1] * n[i] >= SIMILAR[0] * n[j])
        i, j = i[near], j[near]
        ok = (comp[i] != comp[j]) & (~pair[i] | (side[i] != side[j])) & _can_match(n[i], pos[i], n[j], pos[j])
        yield fp[i[ok]], fp[j[ok]]


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of keys with texts of several components, with the first and the previous text of the key where these are of
    another component and may match. Parts of a long run all come out, and so do the first and the last key of the task."""
    held = None
    runs = _whole_runs(batches, ["key"], RUN)
    now, at_edge = next(runs, None), True
    while now is not None:
        (table, part), after = now, next(runs, None)
        c = _columns(table if held is None else pa.concat_tables([held, table]))
        own = np.arange(len(c["key"])) >= (held is not None)
        held = table.slice(table.num_rows - 1) if part else None
        again = np.append(False, (np.diff(c["key"]) == 0) & (np.diff(c["fp"]) == 0))
        c, own = {k: x[~again] for k, x in c.items()}, own[~again]
        starts = np.append(True, np.diff(c["key"]) != 0)
        at, no = np.flatnonzero(starts), np.cumsum(starts) - 1
        several = np.minimum.reduceat(c["comp"], at) != np.maximum.reduceat(c["comp"], at)
        several[0] |= at_edge
        several[-1] |= after is None
        keep = own & (part | several[no])
        out = []
        for other in (at[no], np.maximum(np.arange(len(no)) - 1, at[no])):
            no_pair = (c["comp"] == c["comp"][other]) | ~_can_match(c["n"], c["pos"], c["n"][other], c["pos"][other])
            out.append(pa.array(c["fp"][other][keep], mask=no_pair[keep]))
        own_columns = [pa.array(c[k][keep], pa.int32() if k in ("n", "pos") else pa.int64()) for k in ("key", "fp", "n", "pos", "comp")]
        yield pa.RecordBatch.from_arrays([*own_columns, *out], ["key", "fp", "n", "pos", "comp", "first", "before"])
        now, at_edge = after, False


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each key's texts, or of those of two of its blocks, that are in different components and may match."""
    a, b, size = [], [], 0

    def out() -> pa.RecordBatch:
        u, v = _ordered_pairs(a, b)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for table, _ in _whole_runs(batches, ["key", "lo", "hi"]):
        c = _columns(table)
        run = np.cumsum(np.append(True, (np.diff(c["key"]) != 0) | (np.diff(c["lo"]) != 0) | (np.diff(c["hi"]) != 0)))
        for u, v in _pairs_across(c, run):
            a.append(u)
            b.append(v)
            size += len(u)
            if size >= PAIRS:
                yield out()
                a, b, size = [], [], 0
    if size:
        yield out()


def _similar(pairs: DataFrame, docs: DataFrame, first: DataFrame, bounded: bool) -> DataFrame:
    """Those pairs u, v of prints, a written table, whose sets are similar enough. first: fp and the doc_id that stands for it.
    bounded: short hashes are compared first, which drops most of other pairs at three eighths of the cost."""
    spark = docs.sparkSession
    if bounded:
        pairs = settled(spark, lambda: _compared(pairs, docs, first, SHORT), "bounded")
    return settled(spark, lambda: _compared(pairs, docs, first, 8), "similar")


def _compared(pairs: DataFrame, docs: DataFrame, first: DataFrame, width: int) -> DataFrame:
    """Those pairs whose sets of hashes, cut to their first `width` bytes, share enough; of cut ones a pair can only share more.

    A pair meets at its hub, the print of more pairs; a hub's pairs are dealt to blocks of about HUB. A set is made where its
    text lies and goes once to each block that needs it, so no set is written, and none is joined to a table of pairs.
    """
    ends = pairs.select(F.col("u").alias("fp")).union(pairs.select("v"))
    degree = written(ends.groupBy("fp").agg(F.count("*").alias("n__")), "degrees").withColumn("d", F.col("n__"))
    both = with_answers(with_answers(pairs, degree.toDF("u", "n__", "du"), ["u"]), degree.toDF("v", "n__", "dv"), ["v"])
    at_u = F.col("du") > F.col("dv")
    met = both.select(F.when(at_u, F.col("u")).otherwise(F.col("v")).alias("hub"), F.when(at_u, F.col("v")).otherwise(F.col("u")).alias("fp"), F.ceil(F.greatest("du", "dv") / HUB).alias("blocks"))
    met = written(met.select("hub", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("block"), "fp"), "met")
    wanted = met.union(met.select("hub", "block", F.col("hub").alias("fp")).distinct())
    homes = wanted.groupBy("fp").agg(F.collect_list(F.struct("hub", "block")).alias("homes"))
    ids = written(first.select("fp", "doc_id").join(homes, "fp").select("doc_id", "fp", "homes"), "candidates")
    texts = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc_id").select("doc_id", "text", "fp", "homes")
    sent = texts.mapInArrow(_sent(width), "hub long, block int, own boolean, fp long, hashes binary")
    dealt = sent.repartition("hub", "block").sortWithinPartitions("hub", "block", F.desc("own"), "fp")
    return dealt.mapInArrow(_at_hubs(width), "u long, v long").distinct()


def _sent(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sets of texts (doc_id, text, fp, homes), a row for each home. A text of the id with another print is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in pieces(batch, 1)):
            held, size = [], 0
            for text, fp, homes in zip(part.column(1), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                hashes = shingle_set(text.as_py())
                if set_print(hashes) != fp:
                    continue
                packed = np.ascontiguousarray(hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()
                for home in homes:
                    held.append((home["hub"], home["block"], home["hub"] == fp, fp, packed))
                    size += len(packed)
                    if size >= CHUNK_BYTES:
                        yield _rows(held)
                        held, size = [], 0
            if held:
                yield _rows(held)

    return run


def _rows(held: list[tuple[int, int, bool, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], ["hub", "block", "own", "fp", "hashes"])


def _at_hubs(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of a hub and another print that share enough. Rows come sorted by hub and block, the hub's own set first."""

    def unpacked(packed: bytes) -> np.ndarray:
        wide = np.zeros((len(packed) // width, 8), np.uint8)
        wide[:, :width] = np.frombuffer(packed, np.uint8).reshape(-1, width)
        return wide.view(">u8").ravel().astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            u, v = [], []
            for h, mine, fp, packed in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                if mine:
                    if h != hub:
                        hub, own = h, unpacked(packed.as_py())
                    continue
                other = unpacked(packed.as_py())
                few, many = (own, other) if len(own) < len(other) else (other, own)
                shared = int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum()) if len(few) else 0
                if sum(SIMILAR) * shared >= SIMILAR[0] * (len(own) + len(other)):
                    u.append(max(h, fp))
                    v.append(min(h, fp))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _dealt(met: DataFrame, classes: DataFrame, block: int) -> DataFrame:
    """Rows of keys with texts of several components, keys of over `block` texts in pairs of blocks."""
    rows = met.select("key", "fp", "n", "pos", "comp").join(_small(classes), "fp", "left")
    rows = written(rows.select("key", "fp", "n", "pos", F.coalesce("component", "comp").alias("comp")), "classed")
    mixed = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n__")).where("low <> high")
    rows = with_answers(rows, mixed.select("key", F.ceil(F.col("n__") / block).cast("int").alias("blocks"), "n__"), ["key"])
    rows = rows.withColumn("side", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "n", "pos", "comp", "fp")
    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "n", "fp")


def _small(rows: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is small."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def with_print(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """docs with a column for the print of each text's set."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, at):
                prints = pa.array([set_print(shingle_set(x.as_py())) for x in part.column(at)], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, prints], [*part.schema.names, name])

    return docs.mapInArrow(run, docs.withColumn(name, F.lit(0).cast("long")).schema)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, fp, component_id, the least doc_id that links reach, and component, for each row with an id."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    prefixes = written(_prefixes(docs), "prefixes")
    prints = written(prefixes.select("doc_id", "fp"), "prints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n__")), "distinct")
    first = distinct.select("fp", F.col("doc_id").alias("first_doc"), "n__")
    extra = written(with_answers(prints, first, ["fp"]).where("doc_id <> first_doc").select("doc_id", "fp"), "copies")
    stand = prefixes.join(_small(extra), ["doc_id", "fp"], "left_anti").select("fp", "n", "keys", "sim")

    keys = stand.select("fp", "n", F.posexplode(F.slice("keys", 1, FIRST_KEYS)).alias("pos", "key")).select("key", "pos", "fp", "n")
    met = keys.repartitionByRange("key", "pos", "fp").sortWithinPartitions("key", "pos", "fp").mapInArrow(_met, "u long, v long")
    pairs = settled(spark, lambda: _chained(stand).union(met).distinct(), "pairs")
    links = _similar(pairs, docs, distinct, False)
    classes = settled(spark, lambda: components(links).withColumnRenamed("node", "fp"), "first-classes")

    whole = stand.join(_small(classes), "fp", "left").select("fp", "n", F.coalesce("component", "fp").alias("comp"), F.posexplode("keys").alias("pos", "key"))
    whole = whole.select("key", "pos", "fp", "n", "comp").repartitionByRange("key", "pos", "fp").sortWithinPartitions("key", "pos", "fp")
    met = written(whole.mapInArrow(_mixed, "key long, fp long, n int, pos int, comp long, first long, before long"), "mixed")
    forget(spark, prefixes)
    if met.limit(1).count():
        again = met.select("fp", F.explode(F.array("first", "before")).alias("w")).where("w is not null")
        again = written(again.select(F.greatest("fp", "w").alias("u"), F.least("fp", "w").alias("v")).distinct().join(_small(pairs), ["u", "v"], "left_anti"), "pairs")
        links = links.union(_similar(again, docs, distinct, True))
        classes = settled(spark, lambda: components(links).withColumnRenamed("node", "fp"), "next-classes")
        more = settled(spark, lambda: _dealt(met, classes, block).mapInArrow(_across, "u long, v long").distinct().join(_small(pairs.union(again)), ["u", "v"], "left_anti"), "more-pairs")
        forget(spark, met)
        if more.limit(1).count():
            found = _similar(more, docs, distinct, True)
            if found.limit(1).count():
                classes = components(links.union(found)).withColumnRenamed("node", "fp")
    return classed(prints, first, classes.withColumnRenamed("fp", "node"))
