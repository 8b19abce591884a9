"""Alignments against tokens encoded whole and bytes compared one by one."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from conftest_llm import ODD, table
from linkloom.llm import alignment, queries

PATH_A, PATH_B = alignment.default_paths()
TEXTS = [
    *ODD, "tabs\tand\n\nlines  here", " lead and trail \n", "a\rb ;\r\n c", "x y 　z", "it's  we'll\n\n", "▁ sign", "a\x00b",
    "\n first", "\t\t", "é ﬁ Å", "🙂🙂 日本語 テスト", "one one one one", "<s> hi </s> <|endoftext|>", "x" * 300, "a\x85b c", "  ",
]


@pytest.fixture(scope="module")
def models():
    a = Tokenizer.from_file(PATH_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATH_B), alignment.byte_level(PATH_A)[1], alignment.pieces(PATH_B)[1]


def plain(text, models):
    """Ids of both, groups and links (pairs of ids) of one text, by its bytes."""
    if not text:
        return None
    a, b = models[0].encode(" " + text, add_special_tokens=False).ids, models[1].encode(text)
    held_a, held_b = models[2:]
    raw = (" " + text).encode()
    if b"".join(held_a[i] for i in a) != raw or b"".join(held_b[i] for i in b) != raw:
        return None
    own_a = [k for k, i in enumerate(a) for _ in held_a[i]]
    own_b = [k for k, i in enumerate(b) for _ in held_b[i]]
    links = sorted(set(zip(own_a, own_b)))
    cuts = [p for p in range(1, len(raw)) if own_a[p] != own_a[p - 1] and own_b[p] != own_b[p - 1]]
    groups = []
    for low, high in zip([0, *cuts], [*cuts, len(raw)]):
        x, y = sorted(set(own_a[low:high])), sorted(set(own_b[low:high]))
        groups.append(f"{','.join(str(a[k]) for k in x)}|{','.join(str(b[k]) for k in y)}")
    return a, b, groups, [(a[i], b[j]) for i, j in links]


def plain_rows(ids, texts, models):
    found = [plain(t, models) for t in texts]
    counts = Counter(link for f in found if f for link in set(f[3]))
    top = {}
    for (a, _), n in counts.items():
        top[a] = max(n, top.get(a, 0))
    out = []
    for doc, f in zip(ids, found):
        if f is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = f
        best = sum(counts[x] == top[x[0]] for x in links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((doc, len(a), len(b), len(groups), len(links), best, sum(counts[x] for x in links), digest))
    return sorted(out, key=repr)


def run(spark, folder, texts, ids):
    table(spark, texts, ids).write.parquet(str(folder / "documents.parquet"))
    return sorted((tuple(r) for r in queries.op13_alignment(spark, str(folder)).collect()), key=repr)


def test_query_equals_brute_force(spark, tmp_path, models):
    rng = random.Random(2)
    signs = ["a", "the", "qux", ";", "'s", "1", "é", "字", "🙂", ")", "Ünï"]
    made = ["".join(rng.choice(signs) + rng.choice(["", "", " ", "  ", "\n", "\t"]) for _ in range(rng.randrange(60))) for _ in range(150)]
    texts = TEXTS + made + made[:20]
    ids = [None if k == 3 else k // 2 for k in range(len(texts))]
    want = plain_rows(ids, texts, models)
    assert run(spark, tmp_path, texts, ids) == want
    assert sum(r[1] > 0 for r in want) > 100 and sum(r[1] == 0 for r in want) >= 4


def test_given_documents(spark, docs, tmp_path, models):
    rows = docs.select("doc_id", "text").limit(60).collect()
    ids, texts = [r["doc_id"] for r in rows], [r["text"] for r in rows]
    assert run(spark, tmp_path, texts, ids) == plain_rows(ids, texts, models)


def test_chunks_not_held_give_the_same(models):
    texts = [t for t in TEXTS if t] * 2
    held, bare = alignment.Aligner(PATH_A, PATH_B), alignment.Aligner(PATH_A, PATH_B)
    assert bare.chunked
    bare.chunked = False

    def whole(entries):
        return entries and (b"".join(e[0] for e in entries), ";".join(e[2] for e in entries))

    assert [whole(held.aligned(t)) for t in texts] == [whole(bare.aligned(t)) for t in texts]


def test_many_links_are_joined_by_a_shuffle(spark, docs):
    aligned = alignment.alignments(docs.limit(40)).drop("groups")
    assert sorted(alignment.scored(aligned, 0).collect()) == sorted(alignment.scored(aligned).collect())


def test_odd_rows(spark, odd, empty):
    rows = alignment.scored(alignment.alignments(odd)).collect()
    assert len(rows) == odd.count() and all(r["n_links"] >= r["n_groups"] for r in rows)
    assert alignment.scored(alignment.alignments(empty)).collect() == []
