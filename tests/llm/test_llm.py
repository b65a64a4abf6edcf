"""The operators of the llm subpackage against brute force, round trips and awkward tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from versewise.llm import decontaminate, language_id, license_scan, line_dedup, mixing, ngram_join, order_minhash, pii, token_store, warc_bundle
from versewise.llm.components import connected_components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string, term string, rep long, block int"


def words(text):
    return WORD.findall((text or "").translate(LOW))


def documents(spark, texts, langs=None, sources=None):
    """A table with extra columns whose names clash with those that the operators use inside."""
    rows = [(i, t, (langs or {}).get(i, "en"), (sources or {}).get(i, f"s{i % 3}"), len(t or ""), "x", "y", 7, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def sentence(rnd, n, vocab=300):
    return " ".join(f"w{rnd.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Random texts with exact and near copies, ties, nulls, empty and very long texts."""
    rnd = random.Random(3)
    texts = [sentence(rnd, rnd.randint(1, 120)) for _ in range(60)]
    for i in range(20):
        copy = texts[i].split()
        for _ in range(rnd.randint(0, 2)):
            copy[rnd.randrange(len(copy))] = f"w{rnd.randrange(300)}"
        texts.append(" ".join(copy))
    return texts + [texts[0], texts[0], None, None, "", "   ", "!!! ...", "one", "One.", "a\x01b\x02c", sentence(rnd, 30000), "w1 " * 5000, "é" * 20000, "x"]


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(5, 5), (None, 3)]
    up = {}
    root = lambda a: a if up.setdefault(a, a) == a else root(up[a])
    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {a: root(a) for a in up}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_license_scan(spark):
    texts = [license_scan.TEXTS["MIT"], "intro\n\nLicensed under the Apache License, Version 2.0.\nmore", "Released under the MIT License", None, "", "license", "a b c " * 2000, "x\n\n" + license_scan.TEXTS["ISC"].replace(". ", ".\n") + "\n\ny"]

    def grams(s):
        w = words(s)
        return set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set()

    templates = [(k, grams(t)) for k, v in license_scan.default_templates().items() for t in v]

    def brute(text):
        lines, units, run = (text or "").split("\n"), [text or ""], []
        for line in [*lines, ""]:
            if words(line):
                run.append(line)
            else:
                units.append("\n".join(run))
                run = []
        found = set()
        for g in map(grams, units + lines):
            found |= {k for k, t in templates if g and 2 * len(g & t) / (len(g) + len(t)) >= license_scan.MIN_DICE}
        return found

    got = {r.doc_id: {m.license for m in r.matches if m.unit != "stretch"} for r in license_scan.scan_licenses(documents(spark, [*texts, *texts])).collect()}
    assert got == {i: brute(t) for i, t in enumerate([*texts, *texts])}
    assert license_scan.scan_licenses(documents(spark, texts).limit(0)).count() == 0


def test_license_scan_finds_planted_licenses(spark):
    """Whole licences over several paragraphs inside prose, with words changed, and notices at the end of a line."""
    rnd = random.Random(17)
    prose = lambda n: " ".join(rnd.choice(["the", "of", "to", "this", "any", "or", "software", *[f"w{k}" for k in range(40)]]) for _ in range(n))
    whole = license_scan.TEXTS | {k: license_scan.GNU.format(name=n, version=v) for k, (n, v) in license_scan.GNU_NAMES.items()} | {"BSD-3-Clause": "".join(license_scan.BSD)}
    names, texts = [], []
    for name, text in whole.items():
        for changed in (0, 1, 2):
            w = text.split(" ")
            for _ in range(changed * len(w) // 80):
                w[rnd.randrange(len(w))] = "other"
            body = re.sub(r"\. ", ".\n\n", " ".join(w))
            names.append(name)
            texts.append(f"{prose(90)}\n\n{prose(20)}\n{body}\n\n{prose(120)}")
    names += ["MIT", "ISC"]
    texts += [f"{prose(30)} Released under the MIT License.", f"{prose(12)}\n{prose(8)} licensed under the ISC License. {prose(9)}"]
    clean = [prose(n) for n in (5, 50, 500, 3000)]
    got = {r.doc_id: {m.license for m in r.matches} for r in license_scan.scan_licenses(documents(spark, texts + clean)).collect()}
    found = sum(name in got[i] for i, name in enumerate(names))
    assert found >= 0.95 * len(names), [n for i, n in enumerate(names) if n not in got[i]]
    assert all(not got[len(texts) + i] for i in range(len(clean)))


def test_language_id(spark):
    rnd = random.Random(2)
    make = lambda parts: " ".join("".join(rnd.choices(parts, k=rnd.randint(1, 4))) for _ in range(rnd.randint(20, 80)))
    parts = {"aa": ["the", "ing", "on", "er", "wh"], "bb": ["ung", "sch", "ei", "keit", "ö"]}
    texts = [make(parts["aa" if i % 2 else "bb"]) for i in range(120)] + [None, "", "123 !!!", "THE ING"]
    langs = {i: ("aa" if i % 2 else "bb") for i in range(120)} | {5: None}
    docs = documents(spark, texts, langs)
    model = language_id.fit_languages(docs.where(~language_id.held_out()))
    assert [k for k, _ in model.dictionaries] == ["aa", "bb"]
    got = {r.doc_id: r for r in language_id.predict_languages(docs, model).collect()}
    assert np.mean([got[i].lang_pred == ("aa" if i % 2 else "bb") for i in range(120)]) > 0.98
    assert all(got[i].lang_pred == "und" and got[i].rejected for i in (120, 121, 122)) and got[123].lang_pred in ("aa", "bb")
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.rejected}
    empty = language_id.fit_languages(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict_languages(docs, empty).collect()} == {"und"}


def test_language_id_rejects_narrow_margins_at_every_length(spark):
    rnd = random.Random(2)
    make = lambda parts, n: " ".join("".join(rnd.choices(parts, k=rnd.randint(1, 4))) for _ in range(n))
    parts = {"aa": ["the", "ing", "on", "er", "wh"], "bb": ["ung", "sch", "ei", "keit", "ö"]}
    texts = [make(parts["aa" if i % 2 else "bb"], rnd.randint(20, 80)) for i in range(400)]
    strange = [" ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(n)) for n in (20, 44, 55)]
    docs = documents(spark, texts + strange, {i: ("aa" if i % 2 else "bb") for i in range(400)})
    model = language_id.fit_languages(docs.where("doc_id < 400").where(~language_id.held_out()))
    got = {r.doc_id: r for r in language_id.predict_languages(docs, model, min_margin=language_id.MIN_MARGIN).collect()}
    assert all(got[i].rejected for i in range(400, 403))
    assert np.mean([got[i].rejected for i in range(400)]) <= 0.05


def test_held_out_is_crc_of_the_id(spark):
    got = {r.id: r.h for r in spark.range(50).select("id", language_id.held_out("id").alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)}


def fill(weights, caps, total):
    target, left = {}, set(caps)
    while True:
        level = (total - sum(target.values())) / sum(weights[s] for s in left)
        full = {s for s in left if weights[s] * level > caps[s] + 1e-9}
        if not full:
            return target | {s: weights[s] * level for s in left}
        target |= {s: caps[s] for s in full}
        left -= full


def test_source_mix(spark):
    rnd = random.Random(6)
    texts = [sentence(rnd, rnd.randint(1, 60)) for _ in range(900)] + [None, "", "a\tb\x0bc\xa0d"]
    sources = {i: rnd.choice(["a", "b", "b", "b", "c", "é", "z"]) for i in range(900)} | {i: None for i in range(0, 900, 50)}
    docs = documents(spark, texts, sources=sources)
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == 903
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or ""))
    names = sorted((s for s in by if s is not None)) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    sizes = {s: sum(r.size for r in by[s]) for s in names}
    want = fill(weights, {s: 3.0 * sizes[s] for s in names}, sum(sizes.values()))
    for s in names:
        assert by[s][0].target == pytest.approx(want[s]) and by[s][0].source_size == sizes[s]
        assert abs(sum(r.taken for r in by[s]) - want[s]) <= max(60, 0.02 * want[s])
    again = {r.doc_id: r.taken for r in mixing.mix_sources(docs.repartition(5)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    assert mixing.mix_sources(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_flight_keeps_both_sums(seed):
    rnd = random.Random(seed)
    x, size = [rnd.random() for _ in range(200)], [float(rnd.randint(1, 50)) for _ in range(200)]
    y = mixing.flight(x, size, rnd)
    assert sum(0 < v < 1 for v in y) <= 2
    assert sum(y) == pytest.approx(sum(x)) and np.dot(y, size) == pytest.approx(np.dot(x, size))


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(v // 10 + v % 10 for v in doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def test_personal_data_base_spans(spark, corpus):
    rnd = random.Random(9)
    parts = ["@", ".", "a", "b", "-", "1", "2", "55", "+", "(", ")", " ", "_", "%", "é", "😀", "\x01", "\x02", "192.168.0.1", "4845168114407329", "+1 (017) 555-7713", "x@y.z", "256", "\n", "00"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(800)] + corpus + ["1" * 20000, "a." * 9000 + "@", "1 " * 9000]
    rows = pii.find_personal_data(documents(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        for kind, pattern in KINDS.items():
            want = [(m.start(), m.end()) for m in re.finditer(pattern, texts[r.doc_id] or "") if valid(kind, m[0])]
            assert [(s.start, s.end) for s in r[kind]] == want


def test_personal_data_bootstrap(spark):
    texts = [f"please call the office at +1 (01{i}) 555-77{i}3 during hours {i}" for i in range(6)] + ["please call the office at 5557-99881 during hours", "we paid 5557-12345 for it", "there were 12345 of them"]
    added = {r.doc_id: [(a.kind, a.value) for a in r.added] for r in pii.find_personal_data(documents(spark, texts)).collect() if r.added}
    assert added == {6: [("phone", "5557-99881")]}
    assert pii.find_personal_data(documents(spark, texts).limit(0)).count() == 0


def test_personal_data_bootstrap_of_other_shapes(spark):
    texts = [f"write to our desk at user{c}@mail{c}.org before noon {c}" for c in "abcdef"] + ["write to our desk at anna@localhost before noon", "write to our desk at @ before noon"]
    texts += [f"ring the night line on +1 (01{i}) 555-77{i}3 when late {i}" for i in range(6)] + ["ring the night line on 030 1234 5678 when late", "ring the night line on 5557-99881, when late"]
    texts += [f"+1 (02{i}) 555-77{i}3 rings {i} times" for i in range(6)] + ["5558 7788 rings twice"]
    added = {r.doc_id: {(a.kind, a.value) for a in r.added} for r in pii.find_personal_data(documents(spark, texts)).collect() if r.added}
    assert added[6] == {("email", "anna@localhost")} and 7 not in added
    assert added[14] == {("phone", "030 1234 5678")}
    assert added.get(22) == {("phone", "5558 7788")}


def shingles(text, n=5):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def test_ngram_join(spark, corpus):
    sets = {i: shingles(t) for i, t in enumerate(corpus)}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = dict.fromkeys(sets, 0)
    for i in sets:
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    got = {r.doc_id: r for r in ngram_join.ngram_jaccard_join(documents(spark, corpus)).collect()}
    assert {i: got[i].class_id for i in sets} == {i: root(i) for i in sets}
    assert {i: got[i].n_links for i in sets} == links
    assert ngram_join.ngram_jaccard_join(documents(spark, corpus).limit(0)).count() == 0


def test_ngram_join_splits_large_buckets(spark, monkeypatch):
    rnd = random.Random(12)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(60):
        copy = list(base)
        copy[rnd.randrange(150)] = f"v{rnd.randrange(9999)}"
        texts.append(" ".join(copy))
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 12 * 150 * 8)  # a dozen texts a block
    got = ngram_join.ngram_jaccard_join(documents(spark, texts)).collect()
    sets = [shingles(t) for t in texts]
    want = [sum(len(a & b) / len(a | b) >= 0.8 for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    assert {r.doc_id: r.n_links for r in got} == dict(enumerate(want)) and {r.class_id for r in got} == {0}


def test_banding_reaches_its_recall():
    b = ngram_join.choose_banding(0.8, 0.9999)
    assert b.recall(0.8) >= 0.9999 and b.recall(0.3) < 0.2


def test_order_minhash(spark, corpus):
    rows = {r.doc_id: r for r in order_minhash.edited_neighbours(documents(spark, corpus), block_bytes=4096).collect()}
    order = sorted(range(len(corpus)), reverse=True)
    for k, i in enumerate(order):
        text, following = corpus[i] or "", corpus[order[(k + 1) % len(order)]] or ""
        cut = len(text) // 3
        assert rows[i].n_chars == len(text) and rows[i].edited == text[: len(text) - cut] + following[:cut]
        assert rows[i].next_fp == rows[order[(k + 1) % len(order)]].fp
    by_text = {}
    for i, t in enumerate(corpus):
        by_text.setdefault(t or "", set()).add(tuple(rows[i].fp))
    assert all(len(v) == 1 for v in by_text.values())


def fingerprint(text):
    """The fingerprint by its definition, with Spark's hash of strings and numbers."""
    import regex
    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    chain = lambda seed, data: xxhash.xxh64(data, seed=seed % (1 << 64)).intdigest()
    number = lambda x, n: (x % (1 << 8 * n)).to_bytes(n, "little")
    tokens = regex.findall(order_minhash.TOKEN, text, flags=regex.VERSION1 | regex.ASCII)
    seen, numbered = {}, []
    for i in range(max(1, len(tokens) - 2) if tokens else 0):
        h = 42
        for x in tokens[i : i + 3]:
            h = chain(h, x.encode())
        seen.setdefault(signed(h) >> 31 << 31, []).append(i)
    for h, places in seen.items():
        numbered.append((h, places[0]))
        numbered += [(signed(chain(chain(42, number(h, 8)), number(r, 4))) >> 31 << 31, p) for r, p in enumerate(places[1:], 1)]
    out = []
    for b in range(32):
        two = sorted(x for x in numbered if (x[0] % (1 << 64) >> 31) % 32 == b)[:2]
        two.sort(key=lambda x: x[1])
        before = two[0][0] if len(two) == 2 else 0
        out.append(signed(chain(chain(42, number(before, 8)), number(two[-1][0], 8))) if two else None)
    return out


def test_fingerprint_against_its_definition(spark):
    rnd = random.Random(8)
    texts = [sentence(rnd, n) for n in (1, 2, 3, 40, 400, 1500)] + ["w1 " * 700, "w1 w2 w3 " * 300 + sentence(rnd, 200), "", " ", "日本語の文章" * 40, "a" * 500, "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzXYZ0123456789") for _ in range(900))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(3)
    got = {r.i: r.fp for r in order_minhash.fingerprint_columns(rows, "text", "fp").collect()}
    assert all(got[i] == fingerprint(x) for i, x in enumerate(texts))


def test_fingerprint_of_text_without_blanks_survives_an_insertion(spark):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("的一是不了人我在有他这中大来上个国") for _ in range(400)), "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(1500))]
    rows = spark.createDataFrame([(x, "x" + x[:200] + "y" + x[200:]) for x in texts], "a string, b string")
    rows = order_minhash.fingerprint_columns(order_minhash.fingerprint_columns(rows, "a", "fa"), "b", "fb")
    assert all(r.l > 0.7 for r in rows.select(order_minhash.likeness(F.col("fa"), F.col("fb")).alias("l")).collect())


def test_order_minhash_sees_order_and_repeats(spark):
    rnd = random.Random(5)
    w = [f"t{rnd.randrange(10**6)}" for _ in range(300)]
    swapped = w[150:] + w[:150]
    texts = [" ".join(x) for x in (w, w[:299] + ["new"], swapped, w + w[:40])]
    df = order_minhash.fingerprint_columns(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text", "fp")
    fp = {r.i: r.fp for r in df.collect()}
    like = lambda a, b: np.mean([x == y for x, y in zip(fp[a], fp[b])])
    assert like(0, 1) > 0.8 and like(0, 2) < 0.85 and like(0, 3) > 0.6
    out = spark.createDataFrame([([1, None], [1, None]), ([None, None], [None, None])], "a array<long>, b array<long>").select(order_minhash.likeness(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in out] == [1.0, 1.0]


def test_elias_fano():
    rnd = random.Random(7)
    for n in (0, 1, 2, 63, 64, 65, 500):
        values = np.sort(np.array([rnd.randrange(10**9) for _ in range(n)], np.int64))
        low, low_bytes, high_bytes = token_store.EliasFano.encode(values)
        ef = token_store.EliasFano(n, low, low_bytes, high_bytes)
        assert ef.values(0, n).tolist() == values.tolist() == [ef[i] for i in range(n)]
        assert all(ef.values(i, min(70, n - i)).tolist() == values[i : i + 70].tolist() for i in range(0, n, 61))
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 50_000))
    _, low_bytes, high_bytes = token_store.EliasFano.encode(ends)
    assert 8 * (len(low_bytes) + len(high_bytes)) / len(ends) < 2 + np.log2(ends[-1] / len(ends)) + 1


def test_elias_fano_is_read_where_it_lies():
    ends = np.cumsum(np.random.default_rng(2).integers(1, 3000, 50_000))
    ef = token_store.EliasFano(len(ends), *token_store.EliasFano.encode(ends))
    assert ef.nbytes < 0.25 * ends.nbytes and ef[49_999] == ends[-1]


def test_token_store(spark, corpus):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = [*corpus, "It's they're <|endoftext|> Straße ﬁ İx 中文", "a\x1cb\x85c"]
    folder = token_store.write_token_store(documents(spark, texts), path, range_bytes=20_000)
    got = {r.doc_id: r for r in token_store.read_token_store(spark, folder).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    empty = token_store.write_token_store(documents(spark, texts).limit(0), path)
    assert spark.read.parquet(f"{empty}/_manifest").count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(spark, edits):
    rnd = random.Random(edits)
    pairs = []
    for _ in range(150):
        a = [rnd.choice("abcé") for _ in range(rnd.randint(1, 20))]
        b = list(a)
        for _ in range(rnd.randint(0, 4)):
            i = rnd.randrange(len(b))
            b[i : i + rnd.randint(0, 1)] = [rnd.choice("abcd")] * rnd.randint(0, 1)
            b = b or ["a"]
        if abs(len(a) - len(b)) <= edits:
            pairs.append(("".join(a), "".join(b)))
    got = line_dedup.with_distance(spark.createDataFrame(pairs, "a string, b string"), "a", "b", edits).collect()
    for r in got:
        d = distance(r.a, r.b)
        assert r.distance == (d if d <= edits else None)


def near(a, b):
    most = min(2, max(len(a), len(b)) // 6)
    return abs(len(a) - len(b)) <= most and distance(a, b) <= most


def classes_of(lines):
    """A root of each line's class, by all pairs."""
    up = {x: x for x in lines}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a in up:
        for b in up:
            if a < b and near(a, b):
                up[root(a)] = root(b)
    return root


def test_line_dedup(spark):
    rnd = random.Random(11)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(3, 30))) for _ in range(60)]
    lines = list(base)
    for x in base:
        y = list(x)
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randrange(len(y))
            y[i : i + rnd.randint(0, 1)] = "z" * rnd.randint(0, 1)
            y = y or ["y"]
        lines.append("".join(y))
    texts = ["\n".join(rnd.choice([*lines, "", "  "]) for _ in range(rnd.randint(1, 12))) for _ in range(60)] + [None, "", "short\nshort", "é" * 9000 + "x\n" + "é" * 9000]
    root = classes_of({x for t in texts if t for x in t.split("\n") if x.strip()})
    seen, exact, want = set(), set(), {}
    for i, t in enumerate(texts):
        gone, same = [], 0
        for k, line in enumerate(t.split("\n") if t is not None else []):
            if line.strip():
                if root(line) in seen:
                    gone.append(k)
                    same += line in exact
                seen.add(root(line))
                exact.add(line)
        want[i] = (len(t.split("\n")) if t is not None else 0, gone, same)
    docs = documents(spark, texts).withColumn("dropped", F.lit(1)).withColumn("at", F.lit("z"))
    judged = line_dedup.dedup_lines(docs)
    got = {r.doc_id: (r.n_lines, r.dropped, r.n_exact) for r in judged.collect()}
    assert got == want
    cleaned = line_dedup.drop_lines(docs, judged)
    assert cleaned.columns == docs.columns
    assert {r.doc_id: r.text for r in cleaned.collect()} == {i: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i][1]) for i, t in enumerate(texts)}
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_of_repeated_rows_and_null_ids(spark):
    line = "the same long line of words"
    rows = [(1, line), (1, line), (None, line), (None, line + "\nanother quite long line"), (2, None)]
    got = {(r.doc_id, r.n_lines): (r.dropped, r.n_exact) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1): ([], 0), (None, 1): ([0], 1), (None, 2): ([0], 1), (2, 0): ([], 0)}


@pytest.mark.parametrize("full,pieces,depth", [(3, 9, 2), (2, 5, 3)])
def test_near_lines_of_full_keys(spark, full, pieces, depth):
    """Many copies of one line that are far from each other, near ones among them: the classes are those of all pairs."""
    rnd = random.Random(full)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(40))
    lines = {base}
    while len(lines) < 80:
        y = list(rnd.choice(sorted(lines)) if rnd.random() < 0.3 else base)
        for _ in range(rnd.randint(1, 2)):
            i = rnd.randrange(len(y))
            y[i : i + rnd.randint(0, 2)] = rnd.choice(["", "x", "mn", "pqrs", "opqr"])
        lines.add("".join(y))
    root = classes_of(lines)
    edges = line_dedup.near_lines(spark.createDataFrame([(x,) for x in lines], "line string"), full=full, pieces=pieces, depth=depth)
    nodes = connected_components(edges)
    names = spark.createDataFrame([(x,) for x in lines], "line string").withColumn("node", line_dedup.line_key(F.col("line")))
    rows = names.join(nodes, "node", "left").collect()
    ours, theirs = {}, {}
    for r in rows:
        ours.setdefault(r.component or r.node, set()).add(r.line)
        theirs.setdefault(root(r.line), set()).add(r.line)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_line_dedup_makes_no_pairs_of_near_copies(spark):
    """2,000 lines of which any two are near: one class, with a number of proposed pairs that grows with the lines."""
    base = "".join(random.Random(5).choice("abcdefgh ") for _ in range(100))
    lines = [base] + [base[:i] + c + base[i + 1 :] for i in range(100) for c in "ijklmnopqrstuvwxyzAB"][:2000]
    edges = line_dedup.near_lines(spark.createDataFrame([(x,) for x in lines], "line string"))
    assert edges.count() < 20 * len(lines)
    assert connected_components(edges).agg(F.count("*"), F.count_distinct("component")).first()[:] == (2001, 1)


def test_warc_bundles(spark, tmp_path):
    bodies = ["<p>a</p>", None, "", "<p>a</p>", "é" * 3000, "<p>a</p>", "x\r\n\r\nWARC/1.1"]
    rows = [(i, f"http://h/{i}\r\nX: y" if i != 2 else None, b, "e") for i, b in enumerate(bodies)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    folder = warc_bundle.write_bundles(pages, frame_size=200)
    got = {r.page_id: r for r in warc_bundle.read_bundles(spark, folder).collect()}
    last = {}
    for i, b in enumerate(bodies):
        last[b or ""] = i
    for i, b in enumerate(bodies):
        payload = (b or "").encode()
        keep = last[b or ""]
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == (len(payload), warc_bundle.base32_sha1(payload), "response" if i == keep else "revisit", None if i == keep else keep)
        assert (bytes(got[i].payload) == payload) if i == keep else got[i].payload is None
    for r in warc_bundle.read_index(spark, folder).collect():
        one = warc_bundle.fetch_record(folder, r.bundle, r.frame_start, r.offset, r.length)
        assert one["page_id"] == r.page_id and one["record_id"] == r.record_id
    import zstandard

    path = sorted((__import__("pathlib").Path(folder.removeprefix("file://"))).glob("bundle-*"))[0]
    data = path.read_bytes()
    assert sum(p for _, _, p in warc_bundle.seek_table(data)) == len(zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read())


def test_decontamination(spark, corpus):
    rnd = random.Random(13)
    items = [sentence(rnd, n) for n in (30, 10, 12, 4, 1, 15)] + [None, "...", "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1"]
    items[4] = "unique"
    planted = [f"{sentence(rnd, 20)} {items[0]} {sentence(rnd, 5)}", f"before {items[3].upper()}, after", items[1] + " " + items[1], "it is UNIQUE indeed", " ".join(items[5].split()[:9]), items[2].replace(" ", " -- ")]
    texts = [*corpus, *planted]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    windows = {}
    for i, t in enumerate(items):
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    got = {r.doc_id: r for r in decontaminate.decontaminate(documents(spark, texts), bench).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[x]
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == (len(w), len(hit), len(found), digest, bool(hit))
    assert all(r.n_near_items >= r.n_items for r in got.values())
    assert decontaminate.decontaminate(documents(spark, texts).limit(0), bench).count() == 0
    assert decontaminate.decontaminate(documents(spark, texts), bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_finds_a_replaced_and_an_inserted_word(spark):
    rnd = random.Random(14)
    item = [f"w{i}" for i in range(10)]
    texts = []
    for k in range(10):
        texts.append(item[:k] + ["other"] + item[k + 1 :])
        texts.append(item[:k] + ["other"] + item[k:])
    texts += [item[:4] + ["x", "y", "z"] + item[7:], list(reversed(item)), item[:5] + ["q"] * 9 + item[5:]]
    docs = documents(spark, [sentence(rnd, 8, 5000) + " " + " ".join(x) + " " + sentence(rnd, 8, 5000) for x in texts])
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: (r.n_items, r.n_near_items) for r in decontaminate.decontaminate(docs, bench).collect()}
    assert [got[i] for i in range(20)] == [(1, 1) if i == 1 else (0, 1) for i in range(20)]
    assert [got[i] for i in range(20, 23)] == [(0, 0)] * 3


def test_ngram_join_tells_texts_of_one_id_apart(spark):
    rnd = random.Random(30)
    a, b = sentence(rnd, 30), sentence(rnd, 30)
    rows = [(5, a), (5, b), (3, a), (None, b), (7, None), (7, None)]
    got = sorted(((r.doc_id, r.class_id, r.n_links, r.first) for r in ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(5, 3, 1, False), (3, 3, 1, True), (5, 5, 1, True), (None, 5, 1, False), (7, 7, 0, True), (7, 7, 0, True)], key=str)


def test_pipeline_keeps_one_text_of_each_class_whatever_the_ids(spark):
    import corpus_pipeline

    rnd = random.Random(31)
    a, b = sentence(rnd, 30), sentence(rnd, 30)
    rows = [(5, a, 1), (5, b, 2), (3, a, 3), (3, a, 4), (9, None, 5), (9, None, 6), (None, "other words", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, first long").withColumns({"d": F.lit("x"), "_gone": F.lit(1)})
    kept = corpus_pipeline.deduplicate(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(5, b), (3, a), (9, None), (None, "other words")], key=str)
    assert corpus_pipeline.deduplicate(spark, docs.limit(0), "").count() == 0


def test_pipeline_mix_takes_what_the_mix_says(spark):
    import corpus_pipeline

    rows = [(1, "five words are in here", "a")] * 3 + [(2, "two words", "b"), (3, None, "b"), (None, "one", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"_n": F.lit(9), "n": F.lit(8), "t": F.lit("z"), "col": F.lit(0)})
    asked = {(r.doc_id, r.source): r.n for r in mixing.mix_sources(docs).groupBy("doc_id", "source").agg(F.sum("copies").alias("n")).collect() if r.n}
    mixed = corpus_pipeline.mix(spark, docs, "")
    assert mixed.columns == docs.columns
    got = {(r.doc_id, r.source): r.n for r in mixed.groupBy("doc_id", "source").agg(F.count("*").alias("n")).collect()}
    assert got == asked
    assert corpus_pipeline.mix(spark, docs.limit(0), "").count() == 0


def test_pipeline_stages(spark, corpus, tmp_path):
    import corpus_pipeline

    rnd = random.Random(21)
    texts = [*corpus, *[sentence(rnd, 40) for _ in range(40)]]
    docs = documents(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    bench = [sentence(rnd, 20)]
    docs = docs.union(spark.createDataFrame([(1000, "x " + bench[0], "en", "s1", 9)], docs.schema))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, bench[0])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id for r in now.collect()})
        if name != "token_store":
            assert now.columns == docs.columns
    assert 1000 in seen[1] and 1000 not in seen[2]
    assert {80, 81}.isdisjoint(seen[1]) and {82, 84, 86}.isdisjoint(seen[0])
    assert seen[0] >= set(range(60))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, now.collect()))


def test_lines_whose_letters_differ_are_not_measured(spark):
    """Counts refuse no pair within the edits, and nearly all lines that share a segment only because a word was changed."""
    rnd = random.Random(6)
    base = [sentence(rnd, 40, 900).replace("w", "the river ") for _ in range(4)]
    pairs, apart = [], []
    for x in base * 40:
        y = list(x)
        for _ in range(rnd.randint(0, 2)):
            i = rnd.randrange(len(y))
            y[i : i + rnd.randint(0, 1)] = rnd.choice(["", "e", "ü", "x"])
        pairs.append((x, "".join(y)))
        w = x.split()
        w[rnd.randrange(len(w))] = "another side"
        apart.append((x, " ".join(w)))
    allow = line_dedup.counts_allow(line_dedup.letter_counts(F.col("a")), line_dedup.letter_counts(F.col("b")), F.lit(2))
    rows = lambda p: spark.createDataFrame(p, "a string, b string")
    assert rows(pairs).where(allow).count() == len(pairs)
    assert rows(apart).where(allow).count() < len(apart) // 20


def test_packed_counts_refuse_no_near_pair(spark):
    """Counts around the circle of their bits, far beyond it too: two edits anywhere pass, of all letters or of some."""
    rnd = random.Random(8)
    pairs = []
    for k in range(300):
        x = "".join(rnd.choice("  eeeanirtosdluxyé") for _ in range(rnd.choice([6, 40, 900])))
        y = list(x)
        for _ in range(2):
            i = rnd.randrange(len(y))
            y[i : i + rnd.randint(0, 1)] = rnd.choice(["", "e", " ", "n", "ü"])
        pairs.append((x, "".join(y)))
    rows = spark.createDataFrame(pairs, "a string, b string")
    for letters in (line_dedup.COUNTED, line_dedup.COUNTED[: line_dedup.BEFORE]):
        near = line_dedup.packed_allow(line_dedup.packed_counts(F.col("a"), letters), line_dedup.packed_counts(F.col("b"), letters), 2)
        assert rows.where(near).count() == len(pairs)


def test_lines_far_apart_that_share_a_segment_hardly_meet(spark, monkeypatch):
    """Copies of a line with words put in that no two have alike: near none, so few of them go on to the join of the texts."""
    rnd = random.Random(9)
    base = [sentence(rnd, 30, 300).split() for _ in range(2)]
    lines = []
    for k in range(240):
        w = list(base[k % 2])
        for _ in range(2):
            w.insert(rnd.randrange(len(w)), "".join(rnd.choice("eanirtosdlu") for _ in range(6)))
        lines.append(" ".join(w))
    lines += [x[:40] + "#" + x[41:] for x in lines[:5]]
    met, verify = [], line_dedup._verify
    monkeypatch.setattr(line_dedup, "_verify", lambda lines, pairs, *a: met.append(pairs.count()) or verify(lines, pairs, *a))
    edges = line_dedup.near_lines(spark.createDataFrame([(x,) for x in lines], "line string"))
    assert connected_components(edges).agg(F.count("*"), F.count_distinct("component")).first()[:] == (10, 5)
    assert sum(met) < 3 * len(lines)
