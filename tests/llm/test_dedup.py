"""SimHash groups, line spread, shards."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rillwork.llm import lines, sharding, simhash
from rillwork.llm.components import components
from rillwork.llm.shared import numbered


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(prints):
    """prints: {doc: fingerprint}; least doc that links reach."""
    docs = sorted(prints)
    parent = {d: d for d in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in docs}


def near_prints(seed, n):
    """Fingerprints with many at small distances."""
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(n // 8)]
    out = set(base)
    while len(out) < n:
        x = rng.choice(base)
        for _ in range(rng.randint(1, 5)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def test_fingerprints_by_definition(spark, make_docs):
    texts = ["", None, "one", "One TWO", "a b c", "É a\tb\x0bc d", "x " * 500, "word " * 3 + "\n\n end", "İ ß ﬀ q"]
    got = {r.doc_id: r.fp & (2**64 - 1) for r in simhash.fingerprints(make_docs(list(enumerate(texts)))).collect()}
    assert got == {i: plain_print(t) for i, t in enumerate(texts)}


def test_long_text_in_stripes():
    hashes = np.random.default_rng(1).integers(0, 2**63, 200_000, dtype=np.uint64)
    bits = ((hashes[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(axis=0)
    want = sum(1 << b for b in range(64) if 2 * int(bits[b]) > len(hashes))
    assert simhash.fingerprint(hashes.astype("<u8")) & (2**64 - 1) == want


@pytest.mark.parametrize("options", [{"long_keys": False}, {"long_keys": True}, {"long_keys": False, "block": 3}, {"long_keys": True, "block": 2}])
def test_links_equal_brute_force(spark, options):
    prints = near_prints(7, 320)
    df = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in prints], "fp long")
    found = {r.node: r.component for r in components(simhash.fingerprint_links(df, **options)).collect()}
    want = plain_components({x - 2**64 if x >> 63 else x: x for x in prints})
    classes = lambda m: Counter(frozenset(k for k in m if m[k] == c) for c in set(m.values()))
    assert classes({k: found.get(k, k) for k in want}) == classes(want)


def test_chain_condition_never_loses_a_pair():
    rng = random.Random(2)
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a
        for _ in range(3):
            b ^= 1 << rng.randrange(64)
        holds = [bool(simhash.chain_holds(np.array([a], np.uint64), np.array([b], np.uint64), s)[0]) for s in range(4)]
        assert any(holds)


def test_near_copies_end_to_end(spark, make_docs):
    rng = random.Random(4)
    base = [" ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(99)) for _ in range(120)) for _ in range(12)]
    pairs = [(i, t) for i, t in enumerate(base)] + [(100 + i, t.upper()) for i, t in enumerate(base[:5])] + [(200, ""), (201, None), (202, "  \n"), (203, base[0] + " tail"), (200, ""), (None, base[1])]
    got = {(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_copies(make_docs(pairs)).collect()}
    prints = {d: plain_print(t) for d, t in pairs if d is not None}
    want = plain_components(prints)
    assert got == {(d, plain_print(t), want[d] if d is not None else want[1]) for d, t in pairs}


def test_one_of_each_group_stays(spark, make_docs):
    docs = make_docs([(5, "a b c d"), (3, "A B C D"), (3, "A B C D"), (9, "other words stand here now"), (None, "a b c d")])
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 3), (False, 9), (True, 0)]


@pytest.mark.parametrize("most", [0, simhash.BROADCAST_ROWS])
def test_different_texts_of_one_id_stay(spark, make_docs, monkeypatch, most):
    from rillwork.llm import near

    monkeypatch.setattr(simhash, "BROADCAST_ROWS", most)
    one, two, three = (" ".join(f"{p}{i}" for i in range(60)) for p in "abc")
    docs = make_docs([(5, one), (5, two), (5, two), (3, three), (5, three), (7, two), (8, one), (None, one)])
    for options in ({}, {"find": near.near_copies, "with_print": near.with_print}):
        kept = simhash.one_of_each(docs, **options)
        assert kept.columns == docs.columns
        assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(0, one), (3, three), (5, one), (5, two)])


def test_components_of_a_long_chain_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(7, 7), (3, 2), (100, 101)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


LONG = "this line is long enough to count"


def spread_docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, id__ int, h1 string")


def test_lines_on_many_sites_go_but_for_the_first(spark):
    rows = [(i, f"own line number {i} of this document\n  {LONG} \nshort", f"s{i}", 1, "x") for i in range(8)] + [(90, "a line that only one site has\nfoo", "s1", 1, "x")] * 9 + [(91, None, "s1", 1, "x"), (92, "", None, 1, "x")]
    out = lines.remove_boilerplate(spread_docs(spark, rows), removed_col="gone")
    got = {(r.doc_id, r.text, r.gone) for r in out.collect()}
    want = {(0, rows[0][1], 0)} | {(i, f"own line number {i} of this document\nshort", 1) for i in range(1, 8)} | {(90, rows[8][1], 0), (91, None, 0), (92, "", 0)}
    assert got == want and out.columns == ["doc_id", "text", "source", "id__", "h1", "gone"] and out.count() == len(rows)


def test_sites_are_counted_exactly_near_the_threshold(spark):
    rows = [(k * 100 + i, f"{LONG} number {k}", None if i == 99 else f"s{i % k}", 1, "x") for k in (5, 6, 7, 60) for i in range(70)]
    out = lines.remove_boilerplate(spread_docs(spark, rows), min_sites=6)
    left = Counter(r.doc_id // 100 for r in out.where("text <> ''").collect())
    assert left == {5: 70, 6: 1, 7: 1, 60: 1}


def test_line_dedup_shuffled_equals_broadcast(spark, monkeypatch):
    rows = [(i, f"own line number {i} of it\n{LONG}", f"s{i % 9}", 1, "x") for i in range(60)]
    a = sorted(map(tuple, lines.remove_boilerplate(spread_docs(spark, rows)).collect()))
    monkeypatch.setattr(lines, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, lines.remove_boilerplate(spread_docs(spark, rows)).collect())) == a


def plain_lines(rows, min_sites=6, min_chars=20):
    """Texts without lines on many sites but for the first place: the least id (null first)."""
    sites, first = {}, {}
    for i, text, site, *_ in rows:
        for pos, line in enumerate((text or "").split("\n") if text is not None else []):
            line = line.strip(" ")
            if len(line) >= min_chars:
                sites.setdefault(line, set()).add(site)
                at = (i is not None, i or 0, pos)
                first[line] = min(first.get(line, at), at)
    out = []
    for i, text, *_ in rows:
        kept = []
        for pos, line in enumerate((text or "").split("\n")):
            said = line.strip(" ")
            if said not in sites or len(sites[said] - {None}) < min_sites or (i is not None, i or 0, pos) == first[said]:
                kept.append(line)
        out.append((i, None if text is None else "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [lines.BROADCAST_ROWS, 0])
def test_lines_of_odd_documents(spark, monkeypatch, most):
    monkeypatch.setattr(lines, "BROADCAST_ROWS", most)
    long = "\n".join([f"line {k} of a very long text with many lines" for k in range(30_000)] + [LONG] * 3)
    rows = [(None, f"{LONG}\nits own line with a null id", "s0", 1, "x"), (50, long, "s50", 1, "x"), (51, "w" * 3_000_000, "s51", 1, "x"), (52, long, "s52", 1, "x"), (53, "", None, 1, "x"), (54, None, None, 1, "x")]
    rows += [(i, f"  {LONG}  \nown {i}\n\n{LONG}\nline 7 of a very long text with many lines", f"s{i % 4}", 1, "x") for i in range(12)] + [(3, f"own words of another text\n{LONG}", "s9", 1, "x")]
    got = sorted(((r.doc_id, r.text) for r in lines.remove_boilerplate(spread_docs(spark, rows).repartition(3)).collect()), key=str)
    assert got == plain_lines(rows)


def test_no_rows(spark, make_docs):
    none = make_docs([])
    assert lines.remove_boilerplate(none).count() == simhash.near_copies(none).count() == sharding.balanced_shards(none).count() == 0


@pytest.mark.parametrize("n", [1, 7, 8, 203])
def test_shards_are_even_and_groups_stay_together(spark, make_docs, n):
    rng = random.Random(n)
    pairs = [(i, None if i % 50 == 9 else f"text {rng.randrange(n)}" if i % 3 else "") for i in range(n)]
    rows = sharding.balanced_shards(make_docs(pairs)).cache()
    got = rows.collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == n and max(sizes.values()) - min(sizes.get(s, 0) for s in range(8)) <= 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes.get(s, 0)))
    if n == 203:
        cut = sharding.cut_links(rows).first()
        by_chance = sharding.cut_links(rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(8)))).first()
        assert cut.cut < 0.7 * by_chance.cut


def test_shards_of_odd_rows(spark, make_docs):
    pairs = [(i, "é" * (i % 5)) for i in range(40)] + [(None, "no id"), (None, "no id"), (7, "again"), (7, "again"), (8, None), (9, "long " * 400_000), (10, "🙂\0\n")]
    rows = sharding.balanced_shards(make_docs(pairs).repartition(3)).collect()
    got = Counter((r.doc_id, r.size, r.text_crc32) for r in rows)
    assert got == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in pairs)
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(8)) <= 1
    assert Counter((r.shard, r.slot) for r in rows) == Counter((s, k) for s in sizes for k in range(sizes[s]))


def test_fingerprints_of_very_long_texts_link(spark, make_docs):
    rng = random.Random(9)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(300_000))
    pairs = [(4, long), (2, long.upper()), (9, long + " end"), (3, "short and different words here"), (3, "short and different words here"), (None, long)]
    got = sorted(((r.doc_id or 0, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_copies(make_docs(pairs)).collect()))
    assert got == sorted((i or 0, plain_print(t), 3 if i == 3 else 2) for i, t in pairs)


def test_quotas_keep_the_room():
    asked = {(0, 1): 900, (2, 1): 300, (1, 0): 100, (3, 1): 50}
    share = sharding.quotas(asked, [1000, 1000, 1000, 1000])
    come = sum(share[k] * n for k, n in asked.items() if k[1] == 1)
    go = share[1, 0] * 100
    assert come - go <= 51 and all(0 <= x <= 1 for x in share.values())


def test_numbers_without_gaps(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), "id")
    got = numbered(df, ["g"], F.pmod(F.xxhash64("id"), F.lit(7)), [F.col("id")], "no").collect()
    for g in range(3):
        assert sorted(r.no for r in got if r.g == g) == list(range(sum(r.g == g for r in got)))
