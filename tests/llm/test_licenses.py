"""License scans against all blocks and templates compared plainly."""

import random
import re

import pytest

from conftest_llm import table
from linkloom.llm.licenses import BASE, BLOCK, TEMPLATES, THRESHOLD, Template, license_scan

WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain(text, templates=TEMPLATES):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    places = [(i, k) for k, p in enumerate(BASE) for i in range(len(words)) if tuple(words[i : i + len(p.words)]) == p.words]
    met = []
    for number, at in enumerate(range(0, max(1, len(words)), BLOCK // 2)):
        block = set(words[at : at + BLOCK])
        for t in templates:
            overlap = len(block & set(t.words))
            if overlap >= t.asks(THRESHOLD):
                met.append((t.label, number, overlap, len(t.words)))
    return len(words), places, sorted(met)


def texts():
    rng = random.Random(5)
    out = [None, "", "---", "MIT License", "the MiT license; mit LICENSE", "general public\nlicense", "KLicense mİt license"]
    for _ in range(150):
        words = [rng.choice(["the", "of", "software", "wörd", "license", "mit", "public", "字", "3", "x_y"]) for _ in range(rng.randrange(200))]
        for _ in range(rng.randrange(3)):
            notice = rng.choice(TEMPLATES).text.split()
            for _ in range(rng.randrange(4)):
                notice[rng.randrange(len(notice))] = "other"
            at = rng.randrange(len(words) + 1)
            words[at:at] = notice
        out.append(rng.choice([" ", "\n", ", "]).join(words))
    return out


def seen(rows):
    return sorted(((r["n_words"], [tuple(p) for p in r["places"]], [tuple(m) for m in r["met"]]) for r in rows), key=repr)


def test_equals_all_blocks_against_all_templates(spark):
    found = texts()
    got = license_scan(table(spark, found, [k // 3 for k in range(len(found))])).collect()
    assert seen(got) == sorted(map(plain, found), key=repr)
    assert sum(bool(r["met"]) for r in got) > 50


def test_one_very_common_notice(spark):
    found = ["Released under the MIT License. " * k for k in range(1, 40)] + ["plain text"] * 5
    got = license_scan(table(spark, found, [1] * len(found))).collect()
    assert seen(got) == sorted(map(plain, found), key=repr)


def test_odd_rows(spark, odd, empty):
    got = license_scan(odd).collect()
    assert seen(got) == sorted((plain(r["text"]) for r in odd.collect()), key=repr)
    assert license_scan(empty).collect() == []


def test_a_template_longer_than_half_a_block_is_refused(odd):
    with pytest.raises(ValueError, match="a template needs"):
        license_scan(odd, templates=(Template("long", "word " * 40),))
