import hashlib
import random
import re

import numpy as np
import pytest
from conftest_llm import table

from linkloom.llm import quality, queries, secrets, sentences, toxicity, url_rules

FOLDER = "/root/testdata/sf0.001"


# quality rules
def plain_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))


@pytest.mark.parametrize("text", [None, "", " \n", "a", "a b " * 20, "x\n\nx\n x\n", "# $%|\x85<>", "a b c d e f g h i " * 2,
                                  "é\xa0ü ñ\x0b日 " * 5, "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 0"])
def test_base_statistics(text):
    assert quality.text_stats(text)[:5] == plain_stats(text)


def test_statistics_of_whole_documents(docs):
    for r in docs.limit(60).collect():
        if len(r["text"]) < 6000:
            assert quality.text_stats(r["text"])[:5] == plain_stats(r["text"])


def test_covering_learns_and_keeps_clean_rows(spark, docs, labels, empty):
    rng = np.random.default_rng(1)
    good = [" ".join(f"word{rng.integers(5000)}" for _ in range(60)) for _ in range(120)]
    bad = [" ".join(f"w{rng.integers(5000)}$$#" for _ in range(60)) for _ in range(60)]
    rows = table(spark, good + bad + [None, ""])
    marks = spark.createDataFrame([(i, int(i < 120), 0) for i in range(180)] + [(None, 0, 0), (3, None, 0)],
                                  "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality.judged(rows, marks).collect()}
    assert all(out[i]["kept"] == (i < 120) for i in range(180)) and out[180]["base_failed"] and not out[181]["kept"]
    assert quality.keep_good(rows, marks).columns == rows.columns and quality.keep_good(rows, marks).count() == 120
    assert quality.judged(empty, marks).count() == 0
    no_labels = quality.judged(rows, marks.limit(0)).collect()
    assert all(r["kept"] != r["base_failed"] for r in no_labels)


# secrets
def plain_secrets(text):
    found = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        found += [(m.start(), 0, m.end())] if len(m[2]) >= 6 else []
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))


SECRETS = ["", "🙂 Password = 'abc123x' é", "secret=token: abcdefgh", "token=abc token=abcdef", "xAKIA" + "Z" * 16, "AKIA" + "Z" * 15,
           "f" * 24 + " " + "a" * 23, "api_key:\"0123456789abcdef01234567\"", "pass word=abcdef", "pa\u017fswd=abcdefg", "APIKEY=......",
           "sha " + "0123456789abcdef" * 4 + "\n passwd: ab/cd=ef", "eyJ", "secret" * 50 + "=abcdef"]


def test_secrets_equal_a_plain_search(spark, odd, empty, monkeypatch):
    rules = secrets.BASE + secrets.ADDED
    docs = table(spark, SECRETS + [None, SECRETS[1]], [*range(len(SECRETS)), None, 1])
    out = secrets.find_secrets(docs, secrets.BASE).collect()
    assert len(out) == len(SECRETS) + 2
    for r in out:
        text = SECRETS[r["doc_id"]] if r["doc_id"] is not None else ""
        spans = sorted((s["start"], s["kind"], s["end"]) for rule in secrets.BASE for s in r[rule.kind])
        assert ",".join(f"{rules[k].kind}:{s}:{e}" for s, k, e in spans) == plain_secrets(text), text
    assert secrets.find_secrets(empty).count() == 0 and secrets.find_secrets(odd).count() == odd.count()


def test_added_rules_are_found_and_base_spans_stay(spark):
    text = "ghp_" + "a1" * 20 + " -----BEGIN RSA PRIVATE KEY----- password=hunter22"
    row = secrets.find_secrets(table(spark, [text])).first()
    assert len(row["github"]) == len(row["pem"]) == len(row["assign"]) == 1


def test_trigram_queries():
    assert secrets.trigram_query(secrets.BASE[2].pattern) == []
    assert secrets.trigram_query(secrets.BASE[1].pattern) == [frozenset({"aki", "kia"})]
    assign = secrets.trigram_query(secrets.BASE[0].pattern)
    assert frozenset({"tok", "oke", "ken"}) in assign and len(assign) == 6
    assert secrets.trigram_query("ab?c|x") == []


# toxicity
def test_toxicity_finds_planted_words(spark, empty):
    rng = np.random.default_rng(2)
    plain = [" ".join(f"w{rng.integers(900)}" for _ in range(60)) for _ in range(240)]
    rude = [t + " dreadful numbskull " + " ".join(f"w{rng.integers(900)}" for _ in range(5)) + " numbskull dreadful" for t in plain[:120]]
    docs = table(spark, rude + plain[120:] + [None, ""], [*range(240), 240, None])
    marks = spark.createDataFrame([(i, 1, int(i < 120)) for i in range(240)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in toxicity.toxicity(docs, marks).collect()}
    held = [out[i] for i in range(240) if out[i]["held_out"]]
    assert np.mean([r["predicted"] == int(r["doc_id"] < 120) for r in held]) >= 0.9
    assert 0 <= out[240]["score"] <= 1 and out[None]["predicted"] == 0 and not out[None]["held_out"]
    assert toxicity.toxicity(empty, marks).count() == 0
    assert {r["predicted"] for r in toxicity.toxicity(docs, marks.limit(0)).collect()} == {0}


# sentences
def test_repeated_spans_equal_brute_force(spark, odd, empty):
    rng = np.random.default_rng(3)
    line = lambda: " ".join(f"k{rng.integers(4000)}" for _ in range(rng.integers(3, 15))).capitalize() + "."
    shared = " ".join(line() for _ in range(7))
    texts = [" ".join([*(line() for _ in range(4)), *([shared] if i % 3 == 0 else []), *(line() for _ in range(3))]) for i in range(30)]
    texts += [texts[1], None, "", "Short. Short. Short."]
    first, want = {}, set()
    for i, text in enumerate(texts):
        for a, b, _, _, key in sentences.runs(text or ""):
            if first.setdefault(key, (i, a)) != (i, a):
                want |= {(i, k) for k in range(a, b + 1)}
    out = sentences.repeated_spans(table(spark, texts)).collect()
    got = {(r["doc_id"], k) for r in out for k in range(r["first_sentence"], r["last_sentence"] + 1)}
    assert got == want and {r["doc_id"] for r in out} == {*range(3, 30, 3), 30}
    assert all(r["first_doc_id"] in (0, 1) for r in out)
    cleaned = {r["doc_id"]: r["text"] for r in sentences.without_repeats(table(spark, texts)).collect()}
    assert cleaned[0] == texts[0] and shared[20:-20] not in cleaned[3] and cleaned[30].strip() == "" and cleaned[31] == ""
    assert sentences.repeated_spans(empty).count() == 0 and sentences.without_repeats(odd).count() == odd.count()


def test_every_repeated_window_of_50_words_is_found(spark):
    """Against brute force; a passage whose ends stand inside sentences may keep less than a clause at each of them."""
    rng = np.random.default_rng(8)
    words = lambda n: [f"k{rng.integers(90_000)}" for _ in range(n)]
    endless, tail, inner = words(50), words(30), " ".join(words(70))
    texts = [" ".join([*words(40), *endless, *words(35)]) for _ in range(6)]  # one long sentence
    texts += [" ".join(words(25)) + ". " + " ".join(tail) + ". Short tail here. " + " ".join(words(30)) + "." for _ in range(4)]
    texts += [f"{' '.join(words(9))} {inner} {' '.join(words(12))}. {' '.join(words(25))}." for _ in range(4)]
    signs = lambda n: "".join(chr(int(c)) for c in rng.integers(0x4E00, 0x9FA5, n))
    han = "\u3002".join(signs(14) for _ in range(6)) + "\u3002"
    texts += [signs(20) + "\u3002" + han + signs(30) + "\u3002" for _ in range(3)]
    hindi = " ".join(" ".join(words(8)) + "\u0964" for _ in range(4))
    texts += [" ".join(words(6)) + "\u0964 " + hindi + " " + " ".join(words(40)) + "\u0964" for _ in range(3)]
    spans = {}
    for r in sentences.repeated_spans(table(spark, texts)).collect():
        spans.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    assert not spans.keys() & {0, 6, 10, 14, 17} and spans.keys() == set(range(20)) - {0, 6, 10, 14, 17}
    seen = {}
    for i, text in enumerate(texts):
        at = [m.span() for m in re.finditer(r"[^ ]+", text)]
        repeated = set()
        for k in range(len(at) - 49):
            window = text[at[k][0] : at[k + 49][1]]
            if seen.setdefault(window, i) != i:
                repeated |= set(range(k, k + 50))
        if repeated:
            left = [k for k in repeated if not spans[i] >= set(range(*at[k]))]
            lo, hi = min(repeated) + sentences.CLAUSE - 1, max(repeated) - sentences.CLAUSE + 1
            assert all(k < lo or k > hi for k in left), i
    for i in range(7, 10):
        assert {*range(texts[i].index(tail[0]), texts[i].index("Short tail here.") + 16)} <= spans[i]
    assert all({*range(texts[i].index(han), texts[i].index(han) + len(han))} <= spans[i] for i in (15, 16))
    assert all({*range(texts[i].index(hindi), texts[i].index(hindi) + len(hindi))} <= spans[i] for i in (18, 19))


# url rules
def plain_rule(host, path):
    fits = [r for r in url_rules.LIST if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name)).name if fits else None


URLS = ["http://A.Example.COM/en/x?y#z", "https://www.example.com/en/", "https://x.net/fr/1#top", "x.net/fr/", None, "", "http://com/",
        "http://com", "ftp://a://b/c", "http://é.NET/es/?q", "http://notexample.com/en/", "http://h.net?x/es/", "http://h.net/es", "://", "a://b\nc.net/es/\nd"]


def test_hosts_paths_and_listed_rules(spark, pages_rows=None):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, verdict string, tokens string")
    out = {r["page_id"]: r for r in url_rules.judged_urls(pages).collect()}
    for i, url in enumerate(URLS):
        rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        assert (out[i]["host"], out[i]["path"], out[i]["rule"]) == (host, path, plain_rule(host, path)), url
    assert url_rules.judged_urls(pages.limit(0)).count() == 0


def test_mined_rules_decide_where_no_listed_one_fits(spark):
    rows = [(["a", "b"], "block")] * 50 + [(["a", "c"], "other")] * 60 + [(["b"], "block")] * 20 + [(["d"], "allow")] * 30
    labelled = spark.createDataFrame(rows, "tokens array<string>, label string")
    rules, counts = url_rules.mine(labelled)
    found = {tuple(r["tokens"]): (r["label"], r["confidence"], r["support"]) for r in rules.collect()}
    assert found == {("b",): ("block", 1.0, 70), ("a", "b"): ("block", 1.0, 50), ("d",): ("allow", 1.0, 30)}
    sets = spark.createDataFrame([(["a"],), (["b", "z"],), (["d"],), (["z"],)], "tokens array<string>")
    assert {tuple(r["tokens"]): r["mined"] for r in url_rules.matched(sets, rules, counts).collect()} == {("b", "z"): "block", ("d",): "allow"}


def test_open_urls_do_not_count_against_mined_rules(spark):
    urls = [f"http://a{i}.example.com/en/casino/{i}" for i in range(30)] + [f"http://b{i}.shop.com/ok/{i}" for i in range(30)]
    urls += [f"http://c{i}.org/casino/{i}" for i in range(900)] + [f"http://d{i}.org/plain/{i}" for i in range(10)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    mined = {r["page_id"]: r["mined"] for r in url_rules.judged_urls(pages).collect()}
    assert {mined[i] for i in range(60)} == {None} and {mined[i] for i in range(60, 960)} == {"block"}
    assert {mined[i] for i in range(960, 970)} == {None}


def test_support_is_a_count_at_any_size(spark):
    rows = [(["rare"], "block")] * url_rules.MIN_COUNT + [(["less"], "block")] * (url_rules.MIN_COUNT - 1) + [(["x"], "allow")] * 5000
    rules, _ = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, label string"))
    assert {(r["tokens"][0], r["support"]) for r in rules.collect()} == {("rare", url_rules.MIN_COUNT), ("x", 5000)}


def test_every_query_of_the_folder_runs_and_agrees_with_sql(spark):
    from checks.compare import database, rows_of

    db, sql = database(FOLDER), queries.oracle_sql()
    for name, query in queries.queries().items():
        df = query(spark, FOLDER)
        rows = [tuple(r) for r in df.collect()]
        assert rows, name
        if name in sql:
            found = db.execute(sql[name])
            assert rows_of(df.columns, rows) == rows_of([d[0] for d in found.description], found.fetchall()), name


def test_listed_spans_hash(spark):
    row = queries.op8_secrets(spark, FOLDER).where("spans = ''").first()
    assert row["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_repeats_go_by_row_where_ids_are_shared(spark):
    rng = random.Random(11)

    def prose(n):
        return " ".join(f"w{rng.randrange(10**6)}" + "." * (k % 9 == 8) for k in range(n))

    shared, alone, more = prose(60), prose(60), prose(60)
    docs = table(spark, [shared + " " + prose(20), alone, shared, more, more], [7, 7, 1, None, None])
    out = sorted((str(r["doc_id"]), len(r["text"])) for r in sentences.without_repeats(docs).collect())
    assert ("7", len(alone)) in out and ("1", len(shared)) in out
    assert min(n for d, n in out if d == "7") < 260  # the shared passage goes from the other row
    assert sorted(n for d, n in out if d == "None") == [0, len(more)]
    spans = sentences.repeated_spans(docs).collect()
    assert sorted(str(r["doc_id"]) for r in spans) == ["7", "None"]


def test_toxicity_equals_a_plain_reading(spark):
    """Scores again from the savings of each window, and held-out accuracy on the given documents."""
    folder = "/root/testdata/sf0.01"
    docs, marks = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    out = {r["doc_id"]: r for r in toxicity.toxicity(docs, marks).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    fitted = list(dict.fromkeys((r["text"], r["toxic"]) for r in toxicity.training_rows(docs, toxicity.known_labels(marks)).collect()))
    model = toxicity.fit(fitted)
    machines = [toxicity._compressor(model.ordinary), toxicity._compressor(model.toxic)]
    for doc in list(texts)[:80]:
        raw = texts[doc].encode()
        pieces = [raw[at : at + 64] for at in range(0, max(1, len(raw) - 16), 48)] if raw else []
        saved = sorted((len(machines[0].compress(p)) - len(machines[1].compress(p)) for p in pieces), reverse=True) or [0]
        large = sum(v for v in saved if v > 3)
        x = (saved[0], sum(saved[:3]) / 3, sum(saved) / len(saved), large / len(saved) ** 0.5, np.log1p(large))
        z = model.weights[0] + sum(w * (v - m) / s for w, v, m, s in zip(model.weights[1:], x, model.means, model.scales))
        assert abs(out[doc]["score"] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9
    held = [(out[r["doc_id"]]["score"], r["toxic"]) for r in marks.collect() if r["doc_id"] in out and out[r["doc_id"]]["held_out"]]
    clean, bad = ([s for s, y in held if y == k] for k in (0, 1))
    assert sum(a > b for a in bad for b in clean) > 0.75 * len(bad) * len(clean)
