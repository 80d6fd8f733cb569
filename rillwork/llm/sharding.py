"""Shards of even size with few cut links, by balanced label propagation.

Groups of linked rows (here: equal texts) that are large against a shard, of which there can only be a few, are placed
first, whole, where most room is; one larger than a shard is first cut into parts by a hash of the row. The other rows
start at random where room is left. In each round the members of a group learn where most of it stands and ask to move
there; quotas for each pair of shards, from an 8 by 8 table of the requests, keep the shards within a slack. Members
that stand together have the same draw, so they move together. Rounds end when they don't bring groups together any
more. At the end a gapless numbering of each shard moves exactly the surplus, ungrouped rows first, so that row counts
differ by one at most.

DataFrame functions only. What reaches the driver are counts by shard and by pair of shards, and sizes of the large
groups, LARGE for each shard at most.

Cases: a null text counts as no bytes and links with no text but other null ones. Repeated rows are rows of their
own. A null doc_id is kept. An empty table gives an empty result. Only id and text columns are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.llm.shared import forget, numbered, with_answers, written

SHARDS = 8
#: Rounds at most; they end before when one brings no group closer together.
ROUNDS = 10
#: Large groups have more rows than an even shard's by this.
LARGE = 100
#: Share by which a shard may exceed its even size during the rounds.
SLACK = 0.05
#: Rows in a bucket of the final numbering, about.
BUCKET_ROWS = 4096
GROUP = ["g1", "g2", "part"]


def linked_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Narrow rows: doc_id, size, text_crc32, own (a number of the row), the group key and a shard, 0."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    g1 = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.xxhash64(text))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), g1.alias("g1"), F.hash(F.col(text_col)).alias("g2"), F.monotonically_increasing_id().alias("own"))
    return rows.withColumn("shard", F.lit(0))


def cut_large_groups(rows: DataFrame, most: int) -> DataFrame:
    """Add part and group_rows: a group of over `most` rows is cut by a hash into parts of about that size."""
    sizes = rows.groupBy("g1", "g2").agg(F.count("*").alias("n")).where("n > 1").withColumn("n__", F.col("n"))
    parts = F.ceil(F.coalesce(F.col("n"), F.lit(1)) / most)
    return with_answers(rows, sizes, ["g1", "g2"], "left").select(
        *rows.columns, F.pmod(F.xxhash64("own", F.lit(9)), parts).cast("int").alias("part"), F.coalesce(F.ceil(F.col("n") / parts), F.lit(1)).cast("long").alias("group_rows")
    )


def place_large(rows: DataFrame, shards: int, total: int) -> DataFrame:
    """Rows with a first shard: parts of large groups whole, longest first, where most room is; the others at random in
    proportion to what room is left."""
    least = max(2, total // (LARGE * shards))
    large = rows.where(F.col("group_rows") >= least).groupBy(*GROUP).agg(F.count("*").alias("n")).collect()
    load, homes = [0] * shards, []
    for r in sorted(large, key=lambda r: (-r["n"], r["g1"], r["g2"], r["part"])):
        j = min(range(shards), key=load.__getitem__)
        load[j] += r["n"]
        homes.append((r["g1"], r["g2"], r["part"], j))
    room = [max(total / shards - n, 0.0) for n in load]
    draw = F.pmod(F.xxhash64("own", F.lit(5)), F.lit(1_000_000)) / 1_000_000 * sum(room)
    start = reduce(lambda c, j: c.when(draw < sum(room[: j + 1]), j), range(shards), F.when(F.lit(False), 0)).otherwise(shards - 1)
    if not homes:
        return rows.withColumn("shard", start)
    values = ", ".join(f"({a}L, {b}, {c}, {j})" for a, b, c, j in homes)
    known = rows.sparkSession.sql(f"SELECT g1, g2, part, home FROM VALUES {values} AS t(g1, g2, part, home)")
    return rows.join(F.broadcast(known), GROUP, "left").withColumn("shard", F.coalesce("home", start)).select(*rows.columns)


def wishes(rows: DataFrame, total: int | None = None) -> DataFrame:
    """Add wish: the shard where most of the row's group stands; ties go by a hash of the group."""
    votes = rows.where("group_rows > 1").groupBy(*GROUP, "shard").agg(F.count("*").alias("c"))
    tie = F.pmod(F.xxhash64(*GROUP, "shard"), F.lit(1 << 20))
    best = votes.groupBy(*GROUP).agg(F.min(F.struct(-F.col("c"), tie.alias("tie"), F.col("shard").alias("wish"))).alias("best"), F.sum("c").alias("n__")).select(*GROUP, "best.wish", "n__")
    return with_answers(rows, best, GROUP, "left", total=total).select(*rows.columns, F.coalesce("wish", "shard").alias("wish"))


def quotas(asked: dict[tuple[int, int], int], count: list[int], slack: float = SLACK) -> dict[tuple[int, int], float]:
    """The share of each request (from, to) to grant, so that no shard ends above its even size and the slack."""
    shards, most = range(len(count)), (1 + slack) * sum(count) / max(len(count), 1)
    share = dict.fromkeys(asked, 1.0)
    for _ in range(200):
        worst = 0.0
        for j in shards:
            come = sum(share[k] * n for k, n in asked.items() if k[1] == j)
            go = sum(share[k] * n for k, n in asked.items() if k[0] == j)
            room = max(most - count[j] + go, 0.0)
            if come > room:
                worst = max(worst, come - room)
                for k in asked:
                    if k[1] == j:
                        share[k] *= room / come
        if worst < 0.5:
            break
    return share


def propagate(rows: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Rounds of label propagation under quotas; each round's table is written to the shared folder."""
    last = total = rows.count()
    for k in range(rounds):
        asked = written(wishes(rows, total), "wishes")
        table = asked.groupBy("shard", "wish").count().collect()
        moves = {(r["shard"], r["wish"]): r["count"] for r in table if r["shard"] != r["wish"]}
        if not moves or sum(moves.values()) >= last:
            return asked.drop("wish")
        last = sum(moves.values())
        count = [sum(r["count"] for r in table if r["shard"] == j) for j in range(shards)]
        share = quotas(moves, count)
        draw = F.pmod(F.xxhash64(*GROUP, "shard", F.lit(100 + k)), F.lit(1_000_000)) / 1_000_000
        limit = reduce(lambda c, m: c.when((F.col("shard") == m[0]) & (F.col("wish") == m[1]), F.lit(share[m])), moves, F.when(F.lit(False), F.lit(0.0))).otherwise(F.lit(0.0))
        moved = written(asked.withColumn("shard", F.when(draw < limit, F.col("wish")).otherwise(F.col("shard"))).drop("wish"), "moved")
        forget(rows.sparkSession, asked)
        rows = moved
    return rows


def even_rows(rows: DataFrame, shards: int = SHARDS, total: int | None = None) -> DataFrame:
    """Exact row counts and slots. Each shard is numbered without gaps, groups first; what lies beyond its quota
    fills the shards that lack rows, in order, so that parts of a group that must move stay together."""
    total = rows.count() if total is None else total
    count = [0] * shards
    for r in rows.groupBy("shard").count().collect():
        count[r["shard"]] = r["count"]
    quota = [total // shards + (j < total % shards) for j in range(shards)]
    buckets = max(1, total // (shards * BUCKET_ROWS))
    large = F.col("group_rows") > BUCKET_ROWS
    mixed = F.xxhash64(*GROUP)
    bucket = F.struct(
        (F.col("group_rows") == 1).alias("single"),
        F.pmod(F.when(F.col("group_rows") == 1, F.xxhash64("own")).otherwise(mixed), F.lit(buckets)).alias("b"),
        F.when(large, mixed).otherwise(F.lit(0)).alias("g"),
        F.when(large, F.pmod(F.xxhash64("own"), F.ceil(F.col("group_rows") / BUCKET_ROWS))).otherwise(F.lit(0)).cast("long").alias("salt"),
    )
    ranked = numbered(rows, ["shard"], bucket, [mixed, F.col("own")], "rank")
    spare = [max(c - q, 0) for c, q in zip(count, quota, strict=True)]
    lack = [max(q - c, 0) for c, q in zip(count, quota, strict=True)]
    before = lambda xs, j: sum(xs[:j])

    def by_shard(values: list[int]) -> Column:
        return F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), F.col("shard") + 1)

    loose = F.col("rank") - by_shard(quota) + by_shard([before(spare, j) for j in range(shards)])
    over = F.col("rank") >= by_shard(quota)
    to, slot = F.col("shard"), F.col("rank")
    for j in range(shards):
        if lack[j]:
            here = over & (loose >= before(lack, j)) & (loose < before(lack, j) + lack[j])
            to = F.when(here, F.lit(j)).otherwise(to)
            slot = F.when(here, loose - before(lack, j) + count[j]).otherwise(slot)
    return ranked.select("doc_id", "size", "text_crc32", to.cast("int").alias("shard"), slot.cast("long").alias("slot"), *GROUP, "group_rows")


def balanced_shards(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and the group key of each row, under the law of even row counts."""
    rows = written(linked_rows(docs, id_col, text_col), "rows")
    total = rows.count()
    grouped = written(cut_large_groups(rows, max(1, total * 4 // (5 * shards))), "groups")
    return even_rows(propagate(place_large(grouped, shards, total), shards, rounds), shards, total)


def cut_links(placed: DataFrame) -> DataFrame:
    """One row: links of a chain through each group, and those that the shards cut at least."""
    at = placed.groupBy("g1", "g2").agg(F.count("*").alias("n"), F.count_distinct("shard").alias("k"))
    return at.agg(F.sum(F.col("n") - 1).alias("links"), F.sum(F.col("k") - 1).alias("cut"))
