import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from conftest_llm import table
from tokenizers import Tokenizer

from linkloom.llm import packing, token_output, tokens
from linkloom.llm.tokens import WordTokenizer, default_tokenizer

MODEL = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(text):
    return [*MODEL.encode(text or "", add_special_tokens=False).ids, 1]


def test_ids_equal_the_tokenizer_s_own_on_odd_text():
    own = WordTokenizer(default_tokenizer())
    rng = random.Random(1)
    alphabet = "abCÄéßΣσ'’\"!?.,-_|$%0129²½  \n\t\x1c\x85\xa0\u2003日本語🙂\u0301İK"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(800)]
    texts += ["it's we'll 'twas ''s 're", "<|endoftext|>", "a<|startoftext|>b", "ΟΔΟΣ Σ", "\x1c\x1d"]
    for text in texts * 2:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids_of(text)[:-1], repr(text)


def check_places(rows, texts, capacity):
    rows_of, places = defaultdict(list), defaultdict(list)
    for r in rows:
        rows_of[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, text in texts:
        ids = ids_of(text)
        assert len(rows_of[doc]) == -(-len(ids) // capacity)
        for r in rows_of[doc]:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == r["piece"] * capacity and len(part) == r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packs_every_piece_in_nearly_the_least_sequences(spark, docs):
    rows = packing.pack_documents(docs).collect()
    n = check_places(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 4096)
    assert n <= -(-sum(r["length"] for r in rows) // 4096) + 1


def test_packs_blocks_on_several_levels(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 20)
    rng = random.Random(3)
    rows = [(k, 0, 0, rng.randrange(1, 60), 0) for k in range(400)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.pack_pieces(pieces, 100).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(400))
    fill = defaultdict(int)
    for r in out:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 100 and len(fill) <= 1.06 * sum(r[3] for r in rows) / 100


def test_packs_odd_and_no_rows(spark, odd, empty):
    rows = packing.pack_documents(odd).collect()
    assert sum(r["length"] for r in rows) == sum(len(ids_of(r["text"])) for r in odd.collect())
    assert packing.pack_documents(empty).count() == 0


def test_crossover_and_shaking_keep_every_piece():
    rng = random.Random(5)
    lengths = sorted((rng.randrange(1, 70) for _ in range(300)), reverse=True)
    for members in packing.evolve(lengths, packing.evolve(lengths, None, 100, rng), 100, rng):
        fill = defaultdict(int)
        for length, chosen in zip(lengths, members):
            fill[chosen] += length
        assert len(members) == 300 and max(fill.values()) <= 100


def test_segment_tree_finds_what_a_scan_finds():
    rng = random.Random(2)
    for _ in range(30):
        lengths = [rng.randrange(1, 51) for _ in range(120)]
        rooms, bins = [], []
        for i in sorted(range(120), key=lambda i: (-lengths[i], i)):
            fits = [(room, k) for k, room in enumerate(rooms) if room >= lengths[i]]
            if fits:
                room = min(fits)[0]
                k = max(k for r, k in fits if r == room)
                rooms[k] -= lengths[i]
            else:
                rooms.append(50 - lengths[i])
        bins = token_output.best_fit_decreasing(lengths, 50)
        assert sorted(i for b in bins for i in b) == list(range(120))
        assert sorted(50 - sum(lengths[i] for i in b) for b in bins) == sorted(rooms)


def test_packed_ids_come_back_whole(spark, docs, empty):
    packed = token_output.packed_ids(docs)
    back = {r["doc_id"]: r["ids"] for r in token_output.documents_of(packed).collect()}
    for r in docs.collect():
        assert back[r["doc_id"]] == ids_of(r["text"])
    for r in packed.collect():
        assert len(r["ids"]) == 2 * 4096 and r["position_resets"] == r["cu_seqlens"][:-1]
        assert r["cu_seqlens"][-1] == r["n_tokens"] <= 4096
    assert token_output.packed_ids(empty).count() == 0


def test_packed_ids_of_odd_rows(spark, odd):
    packed = token_output.packed_ids(odd).collect()
    assert sum(r["n_tokens"] for r in packed) == sum(len(ids_of(r["text"])) for r in odd.collect())
    one = token_output.packed_ids(table(spark, [None])).first()
    assert one["n_tokens"] == 1 and one["doc_ids"] == [0]


def test_packed_blocks_go_by_pieces_whatever_the_rows(spark, monkeypatch):
    monkeypatch.setattr(token_output, "BLOCK", 20)
    for docs in (table(spark, ["word " * 6000]), table(spark, ["same text"] * 400, [None] * 400)):
        pieces = defaultdict(int)
        for r in token_output.packed_ids(docs, 16).collect():
            pieces[r["sequence_id"] >> 20] += len(r["pieces"])
        assert sum(pieces.values()) >= 375 and len(pieces) >= 15 and max(pieces.values()) <= 50


def test_packing_deals_rows_that_are_alike(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 20)
    rows = [(None, 0, 0, 7, 0)] * 300 + [(5, 0, 0, 9, 0)] * 100
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    blocks, fill = defaultdict(int), defaultdict(int)
    for r in packing.pack_pieces(pieces, 16).collect():
        blocks[r["sequence_id"] >> 20] += 1
        fill[r["sequence_id"]] += r["length"]
    assert sum(blocks.values()) == 400 and max(blocks.values()) <= 50 and max(fill.values()) <= 16


HARD_TEXTS = [
    "", "   ", "a b  z", "x̸y <|ENDOFTEXT|> q", "ẞß İ Σας ΑΣ", "a\x1cb\x85c", "k" * 5000 + " " + "É" * 300,
    "it's 'S'S don't 12345", "é ́ é", "<|endoftext|>x y", "Å ﬁ \U0001f600 ﷺ", "x² ½ Ⅷ ٣", "a_b__c #_$ \x1f",
    "日本語 テスト، עברית", "a<|StartOfText|>b",
]


def test_remembered_words_give_the_tokenizers_own_ids():
    """Lower case by place, odd white space, digits of all kinds, special tokens, composed letters; also when caches are full."""
    rng = random.Random(5)
    letters = "aB'sé́  \nΣ1<|>_\x1d²"
    texts = HARD_TEXTS + ["".join(rng.choice(letters) for _ in range(40)) for _ in range(300)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(97, 122)])) for _ in range(9)) for _ in range(300)]
    own = WordTokenizer(default_tokenizer())
    for text in texts + texts:
        assert own.encode(text) == own.plain(text), text


def test_full_caches_change_no_ids(monkeypatch):
    monkeypatch.setattr(tokens, "CHUNKS_HELD", 2)
    monkeypatch.setattr(tokens, "WORDS_HELD", 2)
    own = WordTokenizer(default_tokenizer())
    for text in ["one two", "one, two three", "four five! four", "one six two"] * 2:
        assert own.encode(text) == own.plain(text), text
