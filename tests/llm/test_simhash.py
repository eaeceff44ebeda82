"""SimHash against a plain computation and all pairs."""

import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from tabguard.llm import simhash
from tabguard.llm.components import connected


def plain_print(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, most=4):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= most:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {p: find(p) for p in root}


def test_golay_decoding_is_perfect():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 20_000)
    codes = np.arange(4096, dtype=np.int64)
    whole = codes << 11 | simhash._syndromes(codes << 11)
    assert (simhash._syndromes(whole) == 0).all()
    index = simhash.codewords(words)
    assert (np.bitwise_count(words ^ whole[index]) <= 3).all()
    sizes = np.bincount(simhash.indices(words)[0])
    assert set(sizes.tolist()) == {1, 6}


def test_keys_cover_every_pair_within_four_bits():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    b = a.copy()
    for row in range(len(b)):
        for bit in rng.choice(64, rng.integers(1, 5), replace=False):
            b[row] ^= np.uint64(1) << np.uint64(bit)

    def by_row(prints):
        held = {}
        for row, key in zip(*(x.tolist() for x in simhash.keys(prints))):
            held.setdefault(row, set()).add(key)
        return held

    mine, theirs = by_row(a), by_row(b)
    assert all(mine[row] & theirs[row] for row in range(len(a)))
    assert len(simhash.keys(a)[0]) == sum(map(len, mine.values())) < 33 * len(a)


def test_odd_documents(odd_docs, odd_texts):
    rows = simhash.near_duplicates(odd_docs).collect()
    prints = [(i, plain_print(t)) for i, t in odd_texts]
    assert sorted((str(r.doc_id), r.fingerprint) for r in rows) == sorted((str(i), f"{p:016x}") for i, p in prints)
    roots = plain_components({p for _, p in prints})
    least = {}
    for i, p in prints:
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == sorted((str(i), str(least.get(roots[p]))) for i, p in prints)


@pytest.mark.parametrize("block", [4096, 16])
def test_components_of_dense_groups(spark, block):
    """Clouds of fingerprints around a few centres, in whole buckets and dealt out in blocks."""
    rng = np.random.default_rng(2)
    prints = set()
    for centre in rng.integers(0, 1 << 64, 12, dtype=np.uint64).tolist():
        for _ in range(120):
            p = centre
            for bit in rng.choice(64, rng.integers(0, 6), replace=False).tolist():
                p ^= 1 << bit
            prints.add(p)
    signed = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    links = simhash.near_links(frame, 4, block)
    found = links.distinct().collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 4 for r in found)
    named = {r.vertex: r.root for r in connected(links, "a", "b").collect()}
    groups = {}
    for p in signed:
        groups.setdefault(named.get(p, p), set()).add(p & (1 << 64) - 1)
    expected = {}
    for p, root in plain_components(prints).items():
        expected.setdefault(root, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components_of_chains_hubs_and_loops(spark):
    chain = [(i, i + 1) for i in range(40)]
    hub = [(100, 101 + i) for i in range(60)]
    links = spark.createDataFrame([*chain, *hub, (7, 7), (None, 3), (5, 4), (200, 201), (201, 200)], "a long, b long")
    found = {r.vertex: r.root for r in connected(links, "a", "b").collect()}
    for members, root in ((range(1, 41), 0), (range(101, 161), 100), ([201], 200)):
        assert all(found[m] == root for m in members)
    assert connected(links.where("false"), "a", "b").count() == 0


def test_query_on_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = simhash.op8_simhash(spark, "/root/testdata/sf0.001").collect()
    prints = {r.doc_id: plain_print(r.text) for r in docs.select("doc_id", "text").collect()}
    roots = plain_components(set(prints.values()))
    least = {}
    for i, p in prints.items():
        least[roots[p]] = min(i, least.get(roots[p], i))
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(i, f"{p:016x}", least[roots[p]]) for i, p in prints.items()}


def test_empty_table(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0


def test_distance_beyond_the_keys_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.near_links(spark.createDataFrame([(1,)], "fp long"), 5)
