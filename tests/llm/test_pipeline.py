import re

import corpus_pipeline as cp
from ragloom.llm import registry
from test_operators import link_brute, secret_brute

SF = "/root/testdata/sf0.001"


def windows_hit(texts, items):
    """Documents that hold a window of 10 words of an item, or a whole shorter item."""
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wanted = {}
    for q in map(low, items):
        for k in range(max(len(q) - 9, 1) if q else 0):
            wanted.setdefault(len(q[k : k + 10]), set()).add(tuple(q[k : k + 10]))
    words = {i: low(t) for i, t in texts.items()}
    return {i for i, w in words.items() if any(tuple(w[p : p + n]) in own for n, own in wanted.items() for p in range(len(w) - n + 1))}


def test_stages_match_brute_force_on_their_own_input(spark):
    """Each stage but the classifier's against brute force on all that its predecessor kept; repeats and odd rows added."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(10_000, None, "en", None, 0), (10_001, "", None, "src0", 0), (10_002, "token=0123456789abcdef0123456789abcdef", "en", "src1", 38)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).unionByName(docs.where("doc_id < 3").withColumn("doc_id", docs["doc_id"] + 20_000))
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    stage = dict(cp.STAGES)
    near = stage["n-gram Jaccard join"](spark, docs, SF).cache()
    linked = link_brute(rows(docs))
    assert set(rows(near)) == {i for i, (_, root) in linked.items() if root == i}
    clean = stage["benchmark decontamination"](spark, near, SF).cache()
    assert set(rows(clean)) == set(rows(near)) - windows_hit(rows(near), items)
    bare = rows(stage["secret scans"](spark, clean, SF))
    assert set(bare) == set(rows(clean)) and not any(secret_brute(t) for t in bare.values())
    assert bare[10_000] is None and bare[10_002] == cp.PLACEHOLDER


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_stages_keep_columns_and_clean_documents_and_run_repeats_them(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert tuple(docs.columns) == cp.COLUMNS, name
    after = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(after) <= set(before) and len(after) > len(before) / 2
    assert all(cp.PLACEHOLDER in t or t == before[i] for i, t in after.items())
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(cp.STAGES[-1][1](spark, docs, SF)) == key(cp.run(spark, SF))


def test_redaction_of_overlapping_spans_and_nulls(spark):
    rows = [(1, "é token=0123456789abcdef0123456789abcdef0123 end", "en", "s", 3), (2, None, "en", "s", 0), (3, "clean", None, None, 5)]
    got = {r["doc_id"]: r for r in cp.redact_secrets(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SF).collect()}
    assert got[1]["text"] == f"é {cp.PLACEHOLDER} end" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] is None and got[3]["text"] == "clean"


def test_registry_has_each_operator_once():
    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{k}" for k in range(1, 14)]
