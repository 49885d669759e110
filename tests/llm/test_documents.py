"""Operators on documents against brute force, with nulls, empty and long texts, ties and clashing names."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
import xxhash

from tessella.llm import decontaminate, language, licenses, pieces, pitman_yor, secrets, simhash, suffixes


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def frame(spark, rows, more=False):
    """doc_id, text; with columns whose names the operators use themselves."""
    if more:
        return spark.createDataFrame([(k, t, 1.5, "x", k, None) for k, t in rows], "doc_id long, text string, score double, _t string, fp long, row string")
    return spark.createDataFrame(rows, "doc_id long, text string")


EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (None, "no id here at all"), (5, "same text twice over"), (5, "same text twice over")]

# ---- 1


def base_spans(t):
    word = "".join
    either = lambda w: word(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in w)
    keys = "|".join([*(either(w) for w in ("password", "passwd", "secret", "token")), either("api") + "_?" + either("key")])
    assign = re.compile(rf"""(?:{keys})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def test_secret_spans(spark):
    r = random.Random(1)
    parts = ["token = ", "PassWord:", '"x9_secret": "', "api-key=", "apikey=abc", "AKIA", "A" * 17, "deadbeef" * 3, "é😀", "abc", " ", "=", "ſecret=abcdefg", "\n"]
    rows = [(k, "".join(r.choice(parts) for _ in range(r.randrange(40)))) for k in range(300)]
    rows += [(900, None), (901, ""), (902, "token=abcdefgh " * 2000), (903, "x" * 200_000), (904, "secret = token: abcdefg")]
    got = {x.doc_id: x for x in secrets.scan(frame(spark, rows, True)).collect()}
    assert len(got) == len(rows)
    for k, t in rows:
        s = base_spans(t or "")
        assert got[k].base_sha256 == sha(",".join(f"{secrets.KINDS[kind]}:{a}:{b}" for a, kind, b in s))
        assert [got[k].n_assign, got[k].n_access, got[k].n_hex] == [sum(x[1] == i for x in s) for i in range(3)]
        assert [x for x in got[k].spans.split(",") if x and not x.startswith("random")] == [f"{secrets.KINDS[kind]}:{a}:{b}" for a, kind, b in s]


def test_random_runs_are_found_and_ordinary_ones_left(spark):
    r = random.Random(7)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(r.choice(alphabet) for _ in range(44)) for _ in range(30)]
    dull = ["internationalization-of-things", "thequickbrownfoxjumpsover", "0123456789abcdefghijklmnop", "aaaaaaaaaaaaaaaaaaaaaaaaaaa", "documentation/reference/manual"]
    rows = [(k, f"see {key} here") for k, key in enumerate(keys)] + [(100 + k, f"see {w} here") for k, w in enumerate(dull * 20)]
    got = {x.doc_id: x.n_random for x in secrets.scan(frame(spark, rows)).collect()}
    assert sum(got[k] for k in range(30)) >= 28
    assert sum(v for k, v in got.items() if k >= 100) == 0


def test_redaction(spark):
    rows = [(1, "a token=abcdefgh b"), (2, None), (3, "clean é"), (4, "token=" + "deadbeef" * 4)]
    out = {x.doc_id: x for x in secrets.redact(frame(spark, rows, True)).collect()}
    assert [out[k].text for k in (1, 2, 3, 4)] == ["a [SECRET] b", None, "clean é", "[SECRET]"]
    assert out[1]._t == "x" and out[1].score == 1.5


# ---- 2


def removed(rows):
    seen, out = set(), []
    for k, t in sorted(enumerate(rows), key=lambda x: (x[1][0] if x[1][0] is not None else -1, x[0])):
        t = (t[1] or "").encode()
        gone = bytearray(len(t))
        for p in range(len(t) - suffixes.WINDOW + 1):
            w = t[p : p + suffixes.WINDOW]
            if w in seen:
                gone[p : p + suffixes.WINDOW] = b"\1" * suffixes.WINDOW
            seen.add(w)
        spans = sum(1 for i in range(len(t)) if gone[i] and (not i or not gone[i - 1]))
        out.append((rows[k][0], len(t), sum(gone), spans, sha(bytes(c for c, g in zip(t, gone) if not g))))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot,batch,bits", [(4096, 1 << 22, 19), (5, 3000, 11), (2, 5000, 9)])
def test_repeats_are_removed_exactly(spark, monkeypatch, hot, batch, bits):
    for name, value in (("HOT", hot), ("BATCH_BYTES", batch), ("_PLACE_BITS", bits), ("SHARD_BYTES", 1 << 14), ("_LEAST_BATCH", 64)):
        monkeypatch.setattr(suffixes, name, value)
    r = random.Random(3)
    base = "".join(r.choice("abcde é") for _ in range(3000))
    rows = [(k, (base[r.randrange(2000) :][: r.randint(50, 900)] + "".join(r.choice("xyz") for _ in range(r.randrange(150)))) * r.randint(1, 3)) for k in range(100)]
    rows += [(900, None), (901, ""), (902, "a" * 1000), (903, "a" * 500), (904, "ab" * 400)]
    out = suffixes.remove_repeats(frame(spark, rows).coalesce(1))
    got = sorted(((x.doc_id, x.n_bytes, x.n_bytes - len(x.kept), len(x.removed), sha(bytes(x.kept))) for x in out.collect()), key=str)
    assert got == removed(rows)


def test_repeats_with_odd_rows(spark):
    rows = [*EDGE, (6, "z" * 150), (6, "z" * 150), (None, "z" * 120)]
    out = suffixes.remove_repeats(frame(spark, rows, True).coalesce(1)).collect()
    assert sorted((x.doc_id, x.n_bytes) for x in out if x.doc_id) == sorted((k, len((t or "").encode())) for k, t in rows if k)
    assert suffixes.remove_repeats(frame(spark, []).limit(0)).count() == 0


def test_suffix_family_levels_grow_geometrically():
    family, seen = suffixes.SuffixFamily(), set()
    r = np.random.default_rng(1)
    for _ in range(12):
        keys = np.array([f"{x:016d}".encode() for x in r.integers(0, 3000, 500)], "S16")
        again = family.add(keys, np.arange(len(keys)))
        for k, a in zip(keys.tolist(), again.tolist()):
            assert a == (k in seen)
            seen.add(k)
    sizes = [len(x) for x, _ in family.levels]
    assert sum(sizes) == len(seen) and all(a > 2 * b for a, b in zip(sizes, sizes[1:]))


def test_equal_keys_of_different_windows_are_told_apart():
    """Keys that always collide: only the comparison of bytes is left."""
    r = random.Random(9)
    windows = [bytes([r.randrange(3)]) * suffixes.WINDOW for _ in range(40)]
    x = np.frombuffer(b"".join(windows), np.uint8)
    family, seen = suffixes.SuffixFamily(suffixes._agree(x)), set()
    for k in range(0, 40, 5):
        own = range(k, k + 5)
        again = family.add(np.array([b"k"] * 5, "S16"), np.array([suffixes.WINDOW * i for i in own]))
        for i, a in zip(own, again.tolist()):
            assert a == (windows[i] in seen)
            seen.add(windows[i])


def test_removal_of_repeated_and_null_ids_over_partitions(spark):
    rows = [(6, "z" * 150 + "q"), (6, "z" * 150 + "q"), (7, "a" + "z" * 120), (None, "y" * 120), (8, "y" * 130)]
    out = suffixes.remove_repeats(frame(spark, rows).repartition(3)).collect()
    # the first window of a text's z is new and all later ones are not, so its first byte alone stays
    first = [x for x in out if x.doc_id == 6]
    assert sorted(x.n_bytes - len(x.kept) for x in first) == [149, 151]
    assert [x.n_bytes - len(x.kept) for x in out if x.doc_id == 7] == [120]
    assert [x.n_bytes - len(x.kept) for x in out if x.doc_id is None] == [119]
    assert [x.n_bytes - len(x.kept) for x in out if x.doc_id == 8] == [130]


# ---- 4


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    tokenizers = pytest.importorskip("public_tokenizers")
    return sentencepiece.SentencePieceProcessor(model_file=tokenizers.path(pieces.MODEL_FILE))


def test_pieces_equal_the_library(spark, library):
    r = random.Random(5)
    texts = ["", " ", "  a  b ", "a\nb", "\n\n", " \n", "a \n  b", "▁▁x", "<s>", "<0x0A>", "\x00a", "x" * 3000, "the" * 900, "ab" * 700 + " " + "é" * 900, " " * 2000, "\t\r\n z　", "🇫🇷 日本語 ᚠ"]
    texts += ["".join(r.choice(" \nabtheinäé▁😀.,1\t日") for _ in range(r.randrange(60))) for _ in range(400)]
    rows = [*enumerate(texts), (9999, None)]
    for x in pieces.encode_decode(frame(spark, rows, True), pieces.model_bytes()).collect():
        ids = library.encode(texts[x.doc_id] if x.doc_id < 9999 else "")
        assert list(x.ids) == ids and x.decoded == library.decode(ids)


def test_heap_and_rounds_agree(library, monkeypatch):
    texts = ["internationalisation of things" * 3, "aaaaaaaaaaaaabababababab", "日本語" * 9]
    monkeypatch.setattr(pieces, "ROUND_SYMBOLS", 2)
    assert [list(i) for i in pieces.Codec(pieces.model_bytes()).encode(texts)[0]] == library.encode(texts)


# ---- 5


def test_scores(spark):
    r = random.Random(4)
    vocabulary = ["".join(r.choice(["th", "an", "er", "on"]) for _ in range(r.randint(1, 3))) for _ in range(60)]
    rows = [(k, " ".join(r.choice(vocabulary[: 10 + k % 50]) for _ in range(r.randrange(80)))) for k in range(200)] + [(900, None), (901, "New Words HERE now")]
    got = {x.doc_id: x for x in pitman_yor.score(frame(spark, rows, True)).collect()}
    tokens = {k: (t or "").encode().lower().split() + [b""] for k, t in rows}
    held = {k: crc32(str(k).encode()) % 10 == 0 for k in tokens}
    c = Counter(w for k, ws in tokens.items() if not held[k] for w in ws)
    n, v = sum(c.values()), len(c)
    for k, ws in tokens.items():
        x = got[k]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[k], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(x.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert x.score < 0
    known = [got[k] for k in got if held[k] and got[k].n_known == got[k].n_tokens]
    assert len(known) > 5 and sum(x.score for x in known) > 1.01 * sum(x.base_score for x in known)  # words in no order: the base is right
    parts = [{x.doc_id: x.score for x in pitman_yor.score(frame(spark, rows).repartition(n)).collect()} for n in (1, 3)]
    for k in tokens:
        for other in parts:
            assert math.isclose(other[k], got[k].score, rel_tol=1e-9, abs_tol=1e-9)


def test_words_in_their_usual_order_score_better(spark, monkeypatch):
    monkeypatch.setattr(pitman_yor, "FREQUENT", 200)  # so that some words are frequent and some are rare
    r = random.Random(6)
    nouns = [f"noun{k}" for k in range(40)]
    line = lambda: " ".join(f"the {r.choice(nouns)} of a rare{r.randrange(4000)} ." for _ in range(6))
    rows = [(k, line()) for k in range(400)]
    held = [k for k, _ in rows if crc32(str(k).encode()) % 10 == 0]
    mixed = {}
    for k in held:
        words = rows[k][1].split()
        r.shuffle(words)
        mixed[k] = " ".join(words)
    straight = {x.doc_id: x for x in pitman_yor.score(frame(spark, rows)).collect()}
    shuffled = {x.doc_id: x for x in pitman_yor.score(frame(spark, [(k, mixed.get(k, t)) for k, t in rows])).collect()}
    assert sum(straight[k].score for k in held) > 0.8 * sum(shuffled[k].score for k in held)
    assert sum(straight[k].score for k in held) > 0.8 * sum(straight[k].base_score for k in held)
    assert all(math.isclose(straight[k].base_score, shuffled[k].base_score, rel_tol=1e-9) for k in held)


def test_spelling_model_is_a_distribution():
    words = [b"the", b"then", b"an", b"and", b"in", b"inn"] * 5
    key, word = pitman_yor.spelling_keys(words)
    key, count = np.unique(key, return_counts=True)
    model = pitman_yor.Spelling(key, count * np.arange(1, len(key) + 1) ** 2)
    for context in {int(k) // 257 for k in key} | {12345}:
        p = model.probability(context * 257 + np.arange(257))
        assert (p > 0).all() and np.allclose(p.sum(axis=0), 1, atol=1e-9)


def test_words_and_the_unknown_one_sum_to_one():
    words = [f"w{k}".encode() for k in range(300)]
    c = np.random.default_rng(2).zipf(1.5, 300).clip(1, 5000)
    key, word = pitman_yor.spelling_keys(words)
    base = pitman_yor.spell(words, pitman_yor.Spelling(*np.unique(key, return_counts=True)))
    t = pitman_yor.seat_words(words, c, base, 200.0, 0.6)
    assert (t >= 1).all() and (t <= c[:, None]).all()
    mass = pitman_yor.CONCENTRATION + 0.6 * t.sum(axis=0)
    p = (c[:, None] - 0.6 * t + mass * base) / (c.sum() + pitman_yor.CONCENTRATION)
    assert np.allclose(p.sum(axis=0) + mass * (1 - base.sum(axis=0)) / (c.sum() + pitman_yor.CONCENTRATION), 1, atol=1e-9)


def test_contexts_are_distributions():
    r = np.random.default_rng(5)
    classes = 12
    counts = np.r_[r.integers(50, 3000, classes - 1), 4000]
    n = np.zeros((classes + 1, classes), np.int64)
    for d, c in enumerate(counts):
        n[:, d] = r.multinomial(c, r.dirichlet(np.ones(classes + 1) * 0.3))
    full = [(x * (classes + 1) + d, n[x, d]) for x in range(classes + 1) for d in range(classes)]
    kept = [(k, v) for k, v in full if v >= 40]
    model = pitman_yor.Contexts(counts, np.array([k for k, _ in kept]), np.array([v for _, v in kept]), n.sum(axis=1))
    for x in range(classes + 1):
        p = model.probability(np.full(classes, x), np.arange(classes))
        assert (p > 0).all() and math.isclose(p.sum(), 1, abs_tol=1e-9)
        top = int(n[x].argmax())
        assert n[x, top] < 400 or p.argmax() == top


def test_rare_pairs_and_contexts_count(spark, monkeypatch):
    """What follows a word of two tokens is known, whatever its share of all tokens."""
    monkeypatch.setattr(pitman_yor, "FREQUENT", 8, raising=False)  # shares that once cut contexts and dishes
    monkeypatch.setattr(pitman_yor, "PAIRS", 16, raising=False)
    monkeypatch.setattr(pitman_yor, "BUCKET_TOKENS", 4000, raising=False)
    train = [k for k in range(2000) if crc32(str(k).encode()) % 10]
    held = [k for k in range(2000) if k not in set(train)][:2]
    rows = [(k, f"the of rare{k % 450} mate{k % 450}") for k in train]
    rows += [(held[0], " ".join(f"rare{k} mate{k}" for k in range(100))), (held[1], " ".join(f"rare{k} mate{k + 7}" for k in range(100)))]
    got = {x.doc_id: x for x in pitman_yor.score(frame(spark, rows)).collect()}
    assert got[held[0]].n_known == got[held[1]].n_known == 201
    assert got[held[0]].score > got[held[1]].score + 50  # before: the same but for the spelling of seven words
    again = {x.doc_id: x.score for x in pitman_yor.score(frame(spark, rows).repartition(5)).collect()}
    assert all(math.isclose(again[k], got[k].score, rel_tol=1e-9) for k in got)


def shuffled_rows(spark):
    """Rows that stages so far wrote to shuffles."""
    jvm, context = spark.sparkContext._jvm, spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(jvm.double, 0), None)
    return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in map(stages.apply, range(stages.size()))}


def test_words_of_blocks_travel_packed(spark):
    """Blocks that share their words send them to the vocabulary and get their prices in few rows, with the same scores."""
    words, parts = 2000, 8
    rows = [(k, " ".join(f"w{(k * 7 + j) % words}" for j in range(words))) for k in range(parts * 4)]
    before = shuffled_rows(spark)
    got = {x.doc_id: x for x in pitman_yor.score(frame(spark, rows).repartition(parts, "doc_id")).collect()}
    assert sum(n for k, n in shuffled_rows(spark).items() if k not in before) < 2 * parts * words  # before: three rows for each word of a block
    assert all(x.n_tokens == x.n_known == words + 1 for x in got.values()) and len(got) == len(rows)
    whole = {x.doc_id: x.score for x in pitman_yor.score(frame(spark, rows).coalesce(1)).collect()}
    assert all(math.isclose(whole[k], got[k].score, rel_tol=1e-9) for k in got)


def test_seated_contexts_sum_to_one():
    r = np.random.default_rng(3)
    size = 402
    pairs, n = np.unique(r.zipf(1.4, 30000).clip(1, 60) * size + r.zipf(1.3, 30000).clip(1, 400) - 1, return_counts=True)
    tables, own, open_, less, concentration = pitman_yor.seat_contexts(pairs, n, size, np.full(len(pairs), 1 / 400))
    where = np.searchsorted(own, pairs // size)
    total = np.bincount(where, n)
    kept = np.bincount(where, n - less * tables / pitman_yor.SAMPLES) / (total + concentration)
    assert (tables >= pitman_yor.SAMPLES).all() and (tables <= n * pitman_yor.SAMPLES).all()
    assert np.allclose(kept + open_, 1, atol=1e-9)


@pytest.mark.parametrize("less", [0.1, 0.5, 0.9])
def test_seating_is_that_of_single_customers(less):
    """Table counts against Gibbs moves of one customer at a time, which need no Stirling numbers."""
    r = random.Random(4)
    for c, weight in ((3, 0.5), (12, 2.0), (40, 0.05)):
        tables, seen = [c], []
        for sweep in range(6000):
            for _ in range(c if sweep < 20 else 3):
                at = r.choices(range(len(tables)), tables)[0]
                tables[at] -= 1
                if not tables[at]:
                    del tables[at]
                at = r.choices(range(len(tables) + 1), [*(x - less for x in tables), weight])[0]
                if at == len(tables):
                    tables.append(1)
                else:
                    tables[at] += 1
            seen.append(len(tables))
        n = 4000
        draws = pitman_yor.Seats(less).draw(np.full(n, c), np.full(n, weight), pitman_yor.uniform(np.arange(n), 1))
        assert draws.min() >= 1 and draws.max() <= c and abs(draws.mean() - np.mean(seen[200:])) < 0.12 * np.mean(seen[200:])


@pytest.mark.parametrize("less", [0.1, 0.5, 0.9])
def test_large_dishes_follow_the_exact_law(less, monkeypatch):
    n, c = 500, 600
    weight, u = np.geomspace(0.01, 20, n), pitman_yor.uniform(np.arange(n), 2)
    scaled = pitman_yor.Seats(less).draw(np.full(n, c), weight, u)
    monkeypatch.setattr(pitman_yor, "_EXACT", c)
    exact = pitman_yor.Seats(less).draw(np.full(n, c), weight, u)
    assert (np.abs(scaled - exact) <= 2 + 0.15 * exact).mean() > 0.97
    huge = pitman_yor.Seats(less).draw(np.array([10**7, 10**9]), np.array([1e-4, 50.0]), np.array([0.5, 0.5]))
    assert huge[0] == 1 and 1 <= huge[1] <= 10**9


def test_scores_of_odd_rows(spark):
    out = pitman_yor.score(frame(spark, EDGE)).collect()
    assert len(out) == len(EDGE) and sorted(x.n_tokens for x in out) == sorted(len((t or "").split()) + 1 for _, t in EDGE)
    assert pitman_yor.score(frame(spark, []).limit(0)).count() == 0
    long = pitman_yor.score(frame(spark, [(1, "a b c " * 60_000), (2, "a b"), (2, "a b")])).collect()
    assert sorted(x.n_tokens for x in long) == [3, 3, 180_001]


# ---- 7


def test_language_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    net = language.train(docs)
    out = language.identify(docs, net, "doc_id", "lang").withColumn("held", language.held_out()).where("held").collect()
    assert len(out) > 100 and sum(x.lang == x.lang_pred for x in out) >= 0.98 * len(out)
    assert all(0 <= x.score <= 1 for x in out)


def test_language_odd_rows(spark):
    rows = [(k, "the cat and the dog " * 3, "en") for k in range(1, 40)] + [(k, "der Hund und die Katze " * 3, "de") for k in range(40, 80)]
    docs = spark.createDataFrame([*rows, (80, None, "en"), (81, "12 34 !!", "en"), (82, "the dog " * 5000, None)], "doc_id long, text string, lang string")
    got = {x.doc_id: (x.lang_pred, x.score) for x in language.identify(docs, language.train(docs), "doc_id").collect()}
    assert got[80] == got[81] == ("und", 0.0) and got[82][0] == "en"
    assert {language.has_letter(t.encode()) for t in ("½ ² 12", "", "!?", "Ⅷ 8")} == {False} and language.has_letter("1é".encode())
    assert language.identify(docs.limit(0), language.train(docs), "doc_id").count() == 0
    assert language.train(docs.where("lang IS NULL")) is None
    assert {x.lang_pred for x in language.identify(docs, None, "doc_id").collect()} == {"und"}


# ---- 8


def leaks(docs, bench):
    def words(t):
        return re.findall(r"[^\x20\x09-\x0d]+", (t or "").lower())

    def grams(w):
        return [" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))]

    out = set()
    for d, t in docs:
        w = words(t)
        for k, b in bench:
            v = words(b)
            if not v:
                continue
            q = Counter(grams(v))
            width = min(5, len(v))
            for a in range(max(1, len(w) - len(v) + 1)):
                p = Counter(" ".join(w[a : a + len(v)][i : i + width]) for i in range(len(w[a : a + len(v)]) - width + 1))
                both = sum((p & q).values())
                if both / (sum(p.values()) + sum(q.values()) - both) >= 0.8:
                    out.add((d, k))
                    break
    return out


def test_leaks_equal_all_windows(spark):
    r = random.Random(9)
    w = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(r.choice(w) for _ in range(r.choice([3, 5, 20, 40])))) for k in range(20)] + [(50, ""), (51, None)]
    docs = []
    for k in range(60):
        body = [r.choice(w) for _ in range(r.randrange(60))]
        if k % 3 == 0:
            put = items[k % 20][1].upper().split() if k % 2 else items[k % 20][1].split()
            if k % 4 == 0 and len(put) > 30:
                put[-1] = "edited"
            at = r.randrange(len(body) + 1)
            body[at:at] = put
        docs.append((k, "\n".join(body) if k % 5 == 0 else " ".join(body)))
    docs += [(900, None), (901, ""), (902, " ".join(w) * 50 + " " + items[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(frame(spark, docs, True), bench)
    assert {(x.doc_id, x.item_id) for x in got.collect()} == leaks(docs, items)
    assert decontaminate.contaminated(frame(spark, docs), bench.limit(0)).count() == 0
    assert decontaminate.contaminated(frame(spark, []).limit(0), bench).count() == 0


def edited(r, w, words):
    """Copies with words replaced, put in, taken out or moved anywhere."""
    w = list(w)
    for _ in range(r.choice([0, 1, 1, 1, 2, 2, 3])):
        at = r.randrange(len(w))
        kind = r.choice("replace insert delete pair move cut".split())
        if kind == "replace":
            w[at] = r.choice(words)
        elif kind == "insert":
            w.insert(at, r.choice(words))
        elif kind == "pair":
            w[at:at] = [r.choice(words), r.choice(words)]
        elif kind == "move":
            w.insert(r.randrange(len(w)), w.pop(at))
        elif kind == "cut":
            w = w[r.randrange(4) : len(w) - r.randrange(4)] or w
        elif len(w) > 1:
            del w[at]
    return w


@pytest.mark.parametrize("piece", [512, 16])
def test_edits_anywhere_lose_no_leak(spark, monkeypatch, piece):
    monkeypatch.setattr(decontaminate, "PIECE", piece)
    r = random.Random(12)
    words = [f"w{k}" for k in range(900)]
    items = [(k, [r.choice(words) for _ in range(r.choice([6, 9, 15, 30, 50, 80]))]) for k in range(40)]
    items += [(100, "to be or not to be or not to be or not to be".split()), (101, ["la"] * 12), (7000, items[3][1])]
    docs = []
    for k in range(500):
        copy = edited(r, r.choice(items)[1], words)
        before, after = ([r.choice(words) for _ in range(r.choice([0, 0, 3, 40]))] for _ in range(2))
        docs.append((k, " ".join(before + copy + after)))
    docs += [(8, "one more text with this doc_id"), (None, " ".join(items[5][1])), (None, " ".join(items[5][1]))]
    bench = [(k, " ".join(v)) for k, v in items]
    got = decontaminate.contaminated(frame(spark, docs), spark.createDataFrame(bench, "item_id long, text string")).collect()
    want = leaks(docs, bench)
    assert {(x.doc_id, x.item_id) for x in got} == want and len(want) > 150
    assert all(x.similarity >= 0.8 for x in got)


def test_windows_are_few(spark):
    """Windows to fingerprint are as many as the stretches of shared shingles, not as all pairs."""
    r = random.Random(13)
    words = [f"w{k}" for k in range(500)]
    items = [(k, " ".join(r.choice(words) for _ in range(40))) for k in range(100)]
    docs = [(k, items[k % 100][1] + " " + " ".join(r.choice(words) for _ in range(40))) for k in range(300)]
    known = decontaminate.items(spark.createDataFrame(items, "item_id long, text string"))
    assert decontaminate.windows(frame(spark, docs), known).count() <= 2 * 300


# ---- 9


def groups(rows):
    fps = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                label[find(i)] = find(j)
    ids: dict = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            ids[find(i)] = min(ids.get(find(i), k), k)
    return sorted(((k, f - (1 << 64) if f >> 63 else f, ids[find(i)]) for i, ((k, _), f) in enumerate(zip(rows, fps))), key=str)


@pytest.mark.parametrize("shard", [16384, 20])
def test_groups_equal_all_pairs(spark, monkeypatch, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "_LEAF", 8)
    r = random.Random(2)
    rows = [(k, " ".join(r.choice("abcdefgh") for _ in range(r.choice([0, 1, 2, 3, 6, 300])))) for k in range(150)]
    long = " ".join(f"w{r.randrange(500)}" for _ in range(600)).split()
    for k in range(150, 250):
        copy = list(long)
        copy[r.randrange(600)] = f"x{k}"
        rows.append((k, " ".join(copy)))
    rows += [(400, None), (401, ""), (402, "A B C"), (403, "a b c")]
    got = simhash.near_duplicates(frame(spark, rows, True)).collect()
    assert sorted(((x.doc_id, x.fp, x.component_id) for x in got), key=str) == groups(rows)


def test_fingerprint_definition():
    words = b"The quick Brown fox the quick brown fox".lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(b"The quick Brown fox the quick brown fox") == want
    assert simhash.fingerprint(b" \t") == 0 and simhash.fingerprint(b"One two") == xxhash.xxh64_intdigest(b"one two", 42)


def test_hash_equals_that_of_sql(spark):
    from pyspark.sql import functions as F

    v = spark.range(1).select(F.xxhash64(F.lit("one two"))).first()[0]
    assert v % (1 << 64) == simhash.fingerprint(b"one two")


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (102, 101)], "a long, b long")
    got = {x.node: x.root for x in simhash.components(edges).collect()}
    assert all(got[k] == 0 for k in range(1, 61)) and got[101] == got[102] == 100


def test_shards_are_bounded():
    r = np.random.default_rng(1)
    points, shard = np.unique(r.integers(0, 1 << 63, 60_000).astype(np.uint64)), 2000
    sample = points[:: len(points) // (64 * 30)]
    nodes, shards = simhash.upper_tree(sample, shard * len(sample) / len(points), 3)
    sizes = Counter()
    for idx, k in simhash.route(points, nodes, 3):
        sizes[k] += len(idx)
    assert len(sizes) == shards and max(sizes.values()) <= 3 * shard


def test_copies_of_a_point_do_not_grow_with_the_points():
    points = np.unique(np.random.default_rng(2).integers(0, 1 << 64, 50_000, np.uint64))
    for n in (10**4, 5 * 10**4, 10**7, 10**9):
        blocks, bits = simhash.blocks_of(n, 3)
        assert len(list(simhash.cells(points, blocks, bits))) == 4 and (4 << bits) >= min(4 * n // simhash.CELL, 4 << 16)
    sizes = Counter(c for own in simhash.cells(points, *simhash.blocks_of(len(points), 3)) for c in own.tolist())
    assert sum(sizes.values()) == 4 * len(points) and max(sizes.values()) < 2 * simhash.CELL


@pytest.mark.parametrize("cell, shard", [(16, 16384), (64, 40)])
@pytest.mark.parametrize("radius", [0, 3, 9])
def test_links_of_cells_equal_all_pairs(spark, monkeypatch, cell, shard, radius):
    """Points at random and in clouds; crowded cells are dealt on by trees."""
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(simhash, "SHARD", shard)
    r = random.Random(9)
    points = [r.getrandbits(64) for _ in range(400)]
    for _ in range(600):
        p = r.choice(points[:5] + points[-200:])
        for _ in range(r.randint(1, 4)):
            p ^= 1 << r.randrange(64)
        points.append(p)
    points = sorted(set(points))
    label = list(range(len(points)))
    for i, p in enumerate(points):
        for j in range(i):
            if (p ^ points[j]).bit_count() <= radius and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    links = simhash.links(spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in points], "fp long"), radius).collect()
    at, got = {p: i for i, p in enumerate(points)}, list(range(len(points)))
    for x in links:
        i, j = at[x.a % (1 << 64)], at[x.b % (1 << 64)]
        assert (points[i] ^ points[j]).bit_count() <= radius or label[i] == label[j]
        old, new = got[i], got[j]
        got = [new if x == old else x for x in got]
    pairs = {(a, b) for a, b in zip(label, got)}
    assert len(pairs) == len(set(label)) == len(set(got))


def test_groups_of_an_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, []).limit(0)).count() == 0
    assert len(simhash.near_duplicates(frame(spark, EDGE)).collect()) == len(EDGE)


# ---- 10


def test_licences(spark):
    mit = licenses.TEXTS["MIT"].replace("<year> <copyright holders>", "2020 Someone").replace("License", "LICENCE").replace(" ", "  ")
    bare = licenses.TEXTS["MIT"].split("\n", 1)[1]
    noted = "\n".join("# " + x for x in bare.replace("<year>", "1999-2004").split("\n"))
    wrapped = "Copyright (c) 2001 Someone\n" + licenses.TEXTS["ISC"].split("\n\n", 2)[2].replace("the above copyright notice", "the above\ncopyright notice")
    more = [(11, bare), (12, noted), (13, wrapped), (14, "The MIT License (MIT)\n\n" + bare), (15, licenses.TEXTS["BSD-3-Clause"].replace("the copyright holder nor", "Some Company, Inc. nor").replace("BY THE COPYRIGHT HOLDERS", "BY SOME COMPANY")), (16, bare * 3000)]
    found = {x.doc_id: x.license_id for x in licenses.scan(frame(spark, more), licenses.known_licenses(spark)).collect()}
    assert found == {11: "MIT", 12: "MIT", 13: "ISC", 14: "MIT", 15: "BSD-3-Clause", 16: None}
    rows = [(1, mit), (1, mit), (2, None), (3, ""), (4, "!!"), (5, mit + " more"), (6, licenses.TEXTS["ISC"].upper())]
    got = sorted((x.doc_id, x.license_id) for x in licenses.scan(frame(spark, rows, True), licenses.known_licenses(spark)).collect() if x.license_id)
    assert got == [(1, "MIT"), (1, "MIT"), (6, "ISC")]
    assert licenses.scan(frame(spark, []).limit(0), licenses.known_licenses(spark)).count() == 0
    assert licenses.scan(frame(spark, rows), licenses.known_licenses(spark).limit(0)).where("license_id IS NOT NULL").count() == 0


def test_long_licences_by_digest(spark):
    import os

    folder = "/usr/share/common-licenses"
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "MPL-2.0": "MPL-2.0", "BSD": "BSD-3-Clause"}
    there = {f: n for f, n in names.items() if os.path.exists(f"{folder}/{f}")}
    if not there:
        pytest.skip("no licence texts here")
    rows = []
    for k, f in enumerate(there):
        with open(f"{folder}/{f}", encoding="utf-8") as file:
            rows.append((k, file.read()))
    got = {x.doc_id: x.license_id for x in licenses.scan(frame(spark, rows), licenses.known_licenses(spark)).collect()}
    assert got == dict(enumerate(there.values()))
