import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from conftest_llm import table

from linkloom.llm import exact, simhash, trie
from linkloom.llm.components import components

rng = random.Random(7)


def test_rice_code_round_trip():
    for n, span in ((1, 1), (5, 1000), (300, 10**9), (64, 70)):
        values = np.unique(np.array([rng.randrange(span) for _ in range(n)], dtype=np.int64))
        k = exact.rice_parameter(span, len(values))
        assert exact.decode_sorted(exact.encode_sorted(values, k), len(values), k).tolist() == values.tolist()


def by_force(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[b" ".join((b"\0" + (text or "").encode() + b"\0").split()).replace(b"\0", b"")].append(doc)
    return groups


def test_exact_groups_of_odd_rows(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(exact, "SPARE_BITS", 0)  # false alarms must be cleared by the bytes
    out = exact.exact_groups(odd).collect()
    assert len(out) == odd.count()
    found = {(r["doc_id"], r["text_sha256"]): r for r in out}
    same = [r for r in out if r["group_size"] == 3]
    assert {r["doc_id"] for r in same} == {4, 6} and all(r["keep_id"] == 4 for r in same)
    assert [r["kept"] for r in sorted(same, key=lambda r: r["doc_id"])] == [True, True, False]
    blank = [r for r in out if r["doc_id"] in (0, 1)]
    assert {r["keep_id"] for r in blank} == {0} and len(found) == odd.count() - 1
    assert exact.exact_groups(empty).count() == 0
    kept = exact.drop_copies(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted("0 2 3 4 5 None 8".split())


def test_exact_groups_with_a_hot_text(spark):
    texts = ["hot"] * 400 + [f"t{rng.randrange(300)}" for _ in range(800)]
    docs = table(spark, texts).repartition(7)
    out = {r["doc_id"]: r for r in exact.exact_groups(docs).collect()}
    for ids in by_force(enumerate(texts)).values():
        for i in ids:
            assert (out[i]["keep_id"], out[i]["group_size"], out[i]["kept"]) == (min(ids), len(ids), i == min(ids))


def test_fingerprint_of_the_contract():
    def plain(text):
        words = [w for w in text.encode().lower().split()]
        if not words:
            return 0
        parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    for text in ("", "one", "Two words", "A b C a b c", "x " * 50, "ÄÖ \x85 \xa0 é b c d", " ".join(map(str, range(90)))):
        assert int.from_bytes(simhash.fingerprint(text, 3, 64)[0], "big") == plain(text), text


def near_words(n, changes):
    words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
    for _ in range(changes):
        yield " ".join(words)
        words[rng.randrange(n)] = f"v{rng.randrange(10**6)}"


def components_by_force(prints, budget):
    ids = list(prints)
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if (prints[ids[a]] ^ prints[ids[b]]).bit_count() <= budget:
                x, y = root(ids[a]), root(ids[b])
                label[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash_groups_equal_brute_force(spark, docs, odd, empty):
    texts = [r["text"] for r in docs.collect()] + [t for _ in range(12) for t in near_words(400, 6)] + ["", None]
    out = simhash.simhash_groups(table(spark, texts)).collect()
    want = components_by_force({r["doc_id"]: int(r["fingerprint"], 16) for r in out}, 2)
    assert {r["doc_id"]: r["component_id"] for r in out} == want and len(out) == len(texts)
    assert simhash.simhash_groups(odd).count() == odd.count() and simhash.simhash_groups(empty).count() == 0


def test_trie_walk_on_crowded_keys_and_split_nodes(spark, monkeypatch):
    monkeypatch.setattr(trie, "NODE_KEYS", 40)
    monkeypatch.setattr(trie, "FRONTIER", 64)
    near = [0x1234567890ABCDEF ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(250)]
    values = list({*near, *(rng.getrandbits(64) for _ in range(250))})
    signed = [v - 2**64 if v >> 63 else v for v in values]
    keys = spark.createDataFrame([(0, v, v, None) for v in signed], "tab int, key long, item long, payload binary")
    roots = {r["node"]: r["root"] for r in components(trie.trie_links(keys, 64, 2)).collect()}
    want = components_by_force(dict(zip(signed, values)), 2)
    groups, expected = defaultdict(set), defaultdict(set)
    for v in signed:
        groups[roots.get(v, v)].add(v)
        expected[want[v]].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(50)] + [(7, 7), (200, 201), (201, 200)]
    out = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert out == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(50)} | {200: 200, 201: 200}


def test_near_copies_leave_one_of_each_group(spark, odd, empty):
    groups = [list(near_words(300, 4)) for _ in range(15)]
    texts = [t for g in groups for t in g] + [f"alone {i} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(80)) for i in range(20)]
    kept = simhash.keep_one(table(spark, texts))
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {4 * k for k in range(15)} | set(range(60, 80))
    left = simhash.keep_one(odd)
    assert left.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted("0 1 2 3 4 4 None 8".split())
    assert simhash.keep_one(empty).count() == 0


def test_near_copies_go_by_id_and_text(spark):
    (a, b), (c, d) = list(near_words(300, 2)), list(near_words(300, 2))
    other = " ".join(f"u{rng.randrange(10**6)}" for _ in range(80))
    kept = simhash.keep_one(table(spark, [a, b, other, c, d, c], [1, 7, 7, None, None, None]))
    left = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert left[:2] == [(1, a), (7, other)]
    assert len(left) in (3, 4) and {t for _, t in left[2:]} in ({c}, {d})


@pytest.mark.parametrize("items", [simhash.FAMILY_ITEMS, 2])
def test_near_copies_are_those_of_exact_similarity(spark, docs, monkeypatch, items):
    """Pairs on both sides of 0.8, in sets of equal and unequal size and with a line that is often repeated."""
    def changed(words, n):
        return [f"v{rng.randrange(10**6)}" if i in set(range(3, 3 + 9 * n, 9)) else w for i, w in enumerate(words)]

    monkeypatch.setattr(simhash, "FAMILY_ITEMS", items)  # larger families go through the keys
    texts = [r["text"] for r in docs.collect()]
    for n in range(1, 9):
        words = [f"w{rng.randrange(10**6)}" for _ in range(230)]
        texts += [" ".join(words), " ".join(changed(words, n)), " ".join(words[: 230 - 9 * n])]
    line = " ".join(f"l{rng.randrange(10**6)}" for _ in range(9))
    texts += [" ".join([*(f"o{rng.randrange(10**6)}" for _ in range(60)), *([line] * 40)]) for _ in range(4)]
    sets = [set(simhash.shingle_set(t, 5).tolist()) for t in texts]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    kept = {r["doc_id"] for r in simhash.keep_one(table(spark, texts)).collect()}
    assert kept == {i for i in range(len(texts)) if label[i] == i}
