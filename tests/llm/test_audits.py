"""Operators 11 to 13 against brute force, and rows without ids in all operators that key on them."""

import hashlib
import itertools
import re
from fractions import Fraction
from itertools import permutations
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ragloom.llm import chosen_path, common, decontaminate, divergence, filter_audit, mixing, ngram_jaccard, pii, quality, quotes, secret_scan, suffix_dedup, toxicity
from test_operators import words

LABELS = "doc_id long, quality int, toxic int"


# ---------------------------------------------------------------- filter interactions


def audit_brute(rows, labels):
    """rows of (doc_id, text, lang); labels of (doc_id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    texts = {}
    for i, t, _ in rows:
        if i is not None:
            texts[t or ""] = min(i, texts.get(t or "", i))
    docs = []
    for i, t, lang in rows:
        t = t or ""
        w = words(t)
        copy = t in texts and (i is None or texts[t] < i)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= x <= "Z" for x in t) > 10 * len(t), "D": any(x in "#$%&*|" for x in t), "E": copy}
        docs.append((lang or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        own, shapley = [d for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                failed = sum(f in d[1] for d in own)
                out[part, "".join(order), k + 1] = [len(left), len(gone), failed - len(gone), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, k), row in out.items():
            if p == part:
                row.append(shapley[order[k - 1]])
    return out


def test_filter_audit_matches_brute_force(spark, odd_texts):
    rng = np.random.default_rng(4)
    prose = lambda n, vocabulary=5000: " ".join(f"w{int(x)}" for x in rng.integers(0, vocabulary, n))
    rows = [(i, t, "en") for i, t in enumerate(odd_texts)]
    rows += [(100 + i, prose(int(rng.integers(90, 140)), int(rng.choice((40, 5000)))) + str(rng.choice(("", " ABCDEFGHIJ" * 9, " #", " | x"))), str(rng.choice(("en", "de")))) for i in range(60)]
    long = prose(30_000)
    edges = ["x" * n for n in (255, 256, 257, 1279, 1280, 1281, 5376, 5377)]
    rows += [(300 + i, t, "de") for i, t in enumerate([long, long, long + "y", "z" + long[1:], *edges, *edges, edges[4][:-1] + "y", "\n x\t", "\n x\t", "", None])]
    rows += [(101, rows[20][1], None), (102, rows[20][1], ""), (None, rows[20][1], "en"), (None, "only without an id", "en"), (None, "only without an id", "fr"), (5, odd_texts[5], "en"), (5, odd_texts[5], "en")]
    labels = [(i, int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in range(100, 160)] + [(101, 0, 1), (102, None, None), (None, 1, 1), (9999, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, mask int, cls string").repartition(4)
    found = filter_audit.masks(docs)
    got = filter_audit.interactions(filter_audit.mask_counts(found, spark.createDataFrame(labels, LABELS)))
    assert {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in got.collect()} == audit_brute(rows, labels)


def test_filter_audit_of_shuffled_classes_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "BROADCAST_ROWS", 0)
    rows = [(i, f"text {i % 4} of {'a' * (i % 3)}", "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    none = spark.createDataFrame([], LABELS)
    got = filter_audit.interactions(filter_audit.mask_counts(filter_audit.masks(docs), none))
    assert {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in got.collect()} == audit_brute(rows, [])
    assert filter_audit.interactions(filter_audit.mask_counts(filter_audit.masks(docs.limit(0)), none)).count() == 0


def test_texts_that_share_all_hashes_are_told_apart_by_their_text(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "class_chain", lambda text: F.array(F.xxhash64(F.length(text))))
    docs = spark.createDataFrame([(1, "ab", "en"), (2, "cd", "en"), (3, "ab", "en"), (4, "cd", "en"), (5, "xyz", "en")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["mask"] >= 16 for r in filter_audit.masks(docs).collect()}
    assert got == {1: False, 2: False, 3: True, 4: True, 5: False}


# ---------------------------------------------------------------- source divergence


def divergence_brute(rows, least, top):
    """rows of (text, lang, source): dense distances in whole numbers."""
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(lang or "", source or "", terms(t)) for t, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = {}
        for _, _, w in own:
            for x in set(w):
                held[x] = held.get(x, 0) + 1
        kept = sorted(x for x, n in held.items() if n >= least)

        def prices(some, kept=kept):
            n = {x: 0 for x in kept}
            for _, _, w in some:
                for x in w:
                    if x in n:
                        n[x] += 1
            total = sum(n.values()) + 5 * len(kept)
            return n, {x: 1 + floor(Fraction(10**9 * (v + 5), total)) for x, v in n.items()}

        _, whole = prices(own)
        groups = {s: prices([d for d in own if d[1] == s]) for s in {d[1] for d in own}}
        for s, (n, p) in groups.items():
            pair = sorted(((-sum(abs(p[x] - q[x]) for x in kept), o.encode()) for o, (_, q) in groups.items() if o != s))
            term = sorted(((whole[x] - p[x], x.encode()) for x in kept if n[x] and p[x] > whole[x]))[:top]
            out += [(lang, s, part, item.decode(), -v, k) for part, found in (("pair", pair), ("term", term)) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


def test_divergence_matches_dense_sums(spark, odd_texts):
    rng = np.random.default_rng(9)
    vocabulary = [*(f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(100)), "é", "É", "漢字", "Ab", "aB"]
    rows = []
    for k in range(240):
        source = ("s0", "s1", "s2", None, "é", "z")[int(rng.integers(0, 6))]
        weights = rng.dirichlet(np.full(len(vocabulary), 0.3 if source == "s1" else 2.0))
        rows.append((" ".join(rng.choice(vocabulary, int(rng.integers(0, 80)), p=weights)) + str(rng.choice(("", "1x2", "-"))), (None, "en", "de")[int(rng.integers(0, 3))], source))
    rows += [(t, "en", "odd") for t in odd_texts] + [("123 456", "en", "no terms"), (None, "en", "null"), ("rare words alone", "xx", "a"), ("rare words", "xx", "b"), (None, "yy", None), ("ab ab", "en", "s0")] * 2
    docs = spark.createDataFrame([(i, *r, 7, "x") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, value int, term string").repartition(5)
    for least, top in ((12, 4), (30, 50), (10_000, 50)):
        got = divergence.divergence(docs, least, top)
        assert sorted(tuple(r) for r in got.collect()) == divergence_brute(rows, least, top)
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_prices_are_exact_however_large(spark):
    rows = [(n, total, kept) for n in (0, 1, 10**9 + 7, 9 * 10**14) for total, kept in ((n, 1), (n + 10**15 + 1, 3), (n + 7, 10**6))] + [(0, 0, 0)]
    got = spark.createDataFrame(rows, "n long, total long, kept long").select(divergence.price(F.col("n"), F.col("total"), F.col("kept"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (n + 5) // (total + 5 * kept) if total + kept else None for n, total, kept in rows]


# ---------------------------------------------------------------- chosen paths


def near_brute(texts, num):
    low = lambda t: words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for i, w in ((i, low(t)) for i, t in texts.items())}
    root = {i: i for i in texts}
    for i in sorted(texts):
        for j in sorted(texts):
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    return {i: (len(sets[i]), root[i]) for i in texts}


@pytest.mark.parametrize(("small", "depth", "rows"), [(512, 8, 100_000), (3, 8, 100_000), (3, 2, 0)])
def test_chosen_paths_link_what_brute_force_links(make_docs, odd_texts, monkeypatch, small, depth, rows):
    monkeypatch.setattr(chosen_path, "SMALL", small)
    monkeypatch.setattr(chosen_path, "DEPTH", depth)
    monkeypatch.setattr(chosen_path, "BROADCAST_ROWS", rows)
    rng = np.random.default_rng(6)
    texts = dict(enumerate(odd_texts))
    for g in range(4):  # near copies around the threshold, and a passage that unlike texts share
        base = [f"g{g}t{k}" for k in range(90)]
        for k in range(15):
            w = list(base)
            for p in rng.choice(90, size=k % 4, replace=False):
                w[p] = f"x{g}{k}{p}"
            texts[1000 + 100 * g + k] = " ".join(w)
    for k in range(40):
        texts[2000 + k] = " ".join([f"own{k}w{j}" for j in range(int(rng.integers(3, 60)))] + [f"shared{j}" for j in range(30)])
    chain = [f"c{k}" for k in range(200)]
    for k in range(12):  # each links to the next, the ends are far apart
        texts[3000 + k] = " ".join(f"new{j}" if j < 6 * k else chain[j] for j in range(200))
    got = {r[0]: (r[1], r[2]) for r in chosen_path.near_duplicates(make_docs(texts)).collect()}
    assert got == near_brute(texts, 85)


def test_chosen_paths_lose_no_pair_at_the_threshold(make_docs):
    """200 pairs of 109 shingles of which 101 of 117, or 104 of 114, agree, none of which another document could hold together."""
    rng = np.random.default_rng(15)
    texts = {}
    for k in range(200):
        base = [f"p{k}w{j}" for j in range(113)]
        other = list(base)
        at = int(rng.integers(5, 100))
        other[at] = "y"
        if k % 2:
            other[at + 3] = "z"
        texts[2 * k], texts[2 * k + 1] = " ".join(base), " ".join(other)
    want = near_brute(texts, 85)
    assert len({r for _, r in want.values()}) == 200
    assert {r[0]: (r[1], r[2]) for r in chosen_path.near_duplicates(make_docs(texts)).collect()} == want


def test_chosen_paths_of_nothing_and_repeats(spark, make_docs):
    assert chosen_path.near_duplicates(make_docs([]).limit(0)).count() == 0
    docs = make_docs(["a b c d e f g"] * 3)
    got = chosen_path.near_duplicates(docs.union(docs)).collect()
    assert sorted((r[0], r[1], r[2]) for r in got) == sorted([(i, 3, 0) for i in range(3)] * 2)


def test_the_query_keeps_one_of_each_group(spark, tmp_path):
    texts = ["one two three four five six", "One Two three four five six", "other", "", None]
    spark.createDataFrame(list(enumerate(texts)) + [(None, "nameless")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["kept"] for r in chosen_path.op13_chosen_path(spark, str(tmp_path)).collect()}
    assert got == {0: True, 1: False, 2: True, 3: True, 4: True, None: True}


@pytest.mark.parametrize("join", [ngram_jaccard.ngram_jaccard_join, chosen_path.near_duplicates])
def test_near_copies_of_rows_without_id_and_of_one_id(spark, join):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(5, base), (None, base), (7, base + " end"), (None, "other text without a name"), (9, "a b c d e f"), (9, base + " tail"), (3, "a b c d e f")]
    got = sorted((r[0] or 0, r[1], r[2] or 0) for r in join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(5, 56, 5), (0, 56, 5), (7, 57, 5), (0, 1, 0), (9, 2, 3), (9, 57, 5), (3, 2, 3)])


# ---------------------------------------------------------------- secrets in the tables' prose


def test_secret_model_of_the_corpus_leaves_its_prose_alone(spark):
    """No find beside base spans in the tables, and 0.9 of unseen random strings of each length and kind."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fitted = secret_scan.fit(docs)
    found = secret_scan.find_secrets(docs, fitted=fitted).select(F.explode("spans").alias("s")).where("s.kind = 'random'")
    assert found.count() == 0
    samples = [(s, max(n for n in secret_scan.LENGTHS if n <= len(s)), s.isalpha(), s.islower(), s.isupper()) for s, y in secret_scan.labelled(1500, seed=123) if y]
    rows = spark.createDataFrame(samples, "s string, step int, alpha boolean, lower boolean, upper boolean")
    hit = (secret_scan.log_ratio(F.col("s"), fitted) > secret_scan.threshold(F.length("s"), fitted)).cast("double")
    scored = rows.withColumn("hit", hit)
    assert min(r[1] for r in scored.groupBy("step").agg(F.avg("hit")).collect()) >= 0.9
    assert min(r[3] for r in scored.where("alpha").groupBy("lower", "upper", F.col("step") < 16).agg(F.avg("hit")).collect()) >= 0.88


# ---------------------------------------------------------------- rows without ids


BIG = 2**53 + 1


def test_decontamination_keeps_null_and_large_ids(spark):
    item = " ".join(f"b{k}" for k in range(12))
    docs = spark.createDataFrame([(None, "x " + item), (BIG, item), (None, "clean"), (0, None)], "doc_id long, text string").coalesce(1)
    got = decontaminate.decontaminate(docs, spark.createDataFrame([("i", item)], "item_id string, text string")).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_hit"]) for r in got)) == [(False, 0, 0, 0), (False, BIG, 12, 12), (True, 0, 1, 0), (True, 0, 13, 12)]


def test_repeated_strings_of_rows_without_ids(spark):
    shared, text = "s" * 30 + "".join(f"{k:04d}" for k in range(120)), "u" * 450
    rows = [(None, "one " + shared), (BIG, shared + " two"), (None, text), (None, text), (None, None), (4, "short")]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    kept = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(True, 0, len(shared) + 4, len(shared), kept("one ")), (False, BIG, len(shared) + 4, len(shared), kept(" two")), (True, 0, 450, 450, kept("")), (True, 0, 450, 450, kept("")), (True, 0, 0, 0, kept("")), (False, 4, 5, 0, kept("short"))]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted(want)


def test_row_operators_keep_null_ids(spark, make_docs):
    prose = " ".join(f"word{k}" for k in range(40))
    docs = spark.createDataFrame([(None, prose, "en", "s"), (1, prose + " a@b.org", None, None), (None, None, None, None)], "doc_id long, text string, lang string, source string")
    for out in (quality.quality(docs), pii.find_pii(docs), secret_scan.find_secrets(docs), mixing.mix(docs)):
        assert sorted((r["doc_id"] is None for r in out.select("doc_id").collect())) == [False, True, True]
    labels = spark.createDataFrame([(1, 1, 1), (None, 0, 0)], LABELS)
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert sum(r["doc_id"] is None for r in scored) == 2 and all(0 <= r["score"] <= 1 for r in scored)


def test_messages_without_a_place_are_kept_unlinked(spark):
    rows = [("c", 1, "user", "the first message of all"), ("c", 2, "user", "> the first message of all\nyes"), (None, 3, "user", "> the first message of all\nno"), ("c", None, "user", "the first message of all")]
    got = {(r["conv_id"], r["turn"]): (r["reply_turn"], r["root_conv"], r["root_turn"]) for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()}
    assert got == {("c", 1): (None, "c", 1), ("c", 2): (1, "c", 1), (None, 3): (None, None, 3), ("c", None): (None, "c", None)}


def test_pipeline_drops_rows_without_ids_like_others(spark, tmp_path):
    item = " ".join(f"b{k}" for k in range(12))
    spark.createDataFrame([("i", item)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(None, "x " + item), (None, base), (4, base), (None, base + " end"), (None, "for itself alone"), (8, "y1 y2 y3 y4 y5 y6 " + item)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    near = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in near.collect()) == sorted([(0, "x " + item), (4, base), (0, "for itself alone"), (8, "y1 y2 y3 y4 y5 y6 " + item)])
    clean = corpus_pipeline.drop_contaminated(spark, near, str(tmp_path))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in clean.collect()) == [(0, "for itself alone"), (4, base)]


def test_keys_of_rows(spark):
    got = spark.createDataFrame([(1, "a"), (None, "a"), (None, "a"), (None, None), (None, "")], "i long, t string").select(common.row_key("i", "t")).collect()
    keys = [r[0] for r in got]
    assert keys[0] == 1 and keys[1] == keys[2] > 2**61 and keys[3] == keys[4] != keys[1]




def test_the_ordinary_model_counts_every_text(spark):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("etaoins"), size=9)) for _ in range(50)]
    common = [(i, f"{words[i % 50]} row{i}") for i in range(9_000)]
    # words of three letters of their own, in a few long texts only
    rare = [(10_000 + i, "pad " * 8_000 + f"zqxjzqxjzqxj {i}") for i in range(8)]
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    place = secret_scan.ALPHABET.index
    at = place("z") * len(secret_scan.ALPHABET) + place("q")
    without, fitted = secret_scan.fit(table(common)), secret_scan.fit(table(common + rare))
    assert fitted.table[at] < without.table[at]
    # a string that copies of one text alone have is not a word
    copies = [(20_000 + i, "zqxjzqxjzqxj once") for i in range(50)]
    assert secret_scan.fit(table(common + copies)).table == without.table


def test_the_ordinary_model_takes_no_half_of_the_texts_alone(spark):
    """Pairs are those of every word in two different texts, whichever half the texts fall into; thresholds clear words of either half."""
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("qxzjkw"), size=14)) for _ in range(40)]
    rows = [(2 * i + k, f"{w} {w} text {k} {i}") for i, w in enumerate(words) for k in (0, 1)]
    fitted = secret_scan.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    place = secret_scan.ALPHABET.index
    pairs = np.zeros((len(secret_scan.ALPHABET),) * 2)
    for w, n in [*((w, 4) for w in words), ("text", 80)]:
        for a, b in itertools.pairwise(w):
            pairs[place(a), place(b)] += n
            pairs[place(a.upper()), place(b.upper())] += n * secret_scan.CAPITALS
    assert np.allclose(fitted.table, secret_scan.train(pairs).table, atol=2e-6)
    scored = spark.createDataFrame([(w,) for w in words], "w string").select((secret_scan.log_ratio(F.col("w"), fitted) > secret_scan.threshold(F.length("w"), fitted)).alias("hit"))
    assert scored.where("hit").count() == 0
