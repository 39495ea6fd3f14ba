import hashlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from colsense.llm import byte_bpe, line_crf, quality_rules, source_mix
from tests.llm.test_near_copies import plain_heads
from tests.llm.test_source_mix import plain_rake, plain_topics

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    """Each stage, held against plain code over its own input; then the whole."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = [r.asDict() for r in docs.collect()]
    got = docs
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, got, SF).cache()
        out[name] = [r.asDict() for r in got.collect()]
        if name != "byte-level BPE":
            assert got.columns == columns

    want = []
    for r in rows:
        judged = quality_rules.judge(r["text"])
        if judged[8]:
            want.append(r | {"text": judged[9], "n_chars": len(judged[9])})
    key = lambda r: r["doc_id"]
    assert sorted(out["quality rules"], key=key) == sorted(want, key=key) and len(want) < len(rows)

    chain = line_crf.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), view=quality_rules.learned)
    want = [r for r, s in zip(want, chain.scores([r["text"] for r in want])) if s >= line_crf.THRESHOLD]
    assert sorted(out["quality classifier"], key=key) == sorted(want, key=key)

    heads = set(plain_heads([(r["doc_id"], r["text"]) for r in want]))
    want = [r for r in want if r["doc_id"] in heads]
    assert sorted(out["SimHash near-dedup"], key=key) == sorted(want, key=key)

    marks = dict(zip([r["doc_id"] for r in want], plain_topics([r["text"] for r in want])))
    weight = plain_rake([(r["source"], r["lang"], *marks[r["doc_id"]]) for r in want], [None] * 3)
    top = min(source_mix.MOST, max(weight.values()))
    found = {r["doc_id"]: r.probability for r in source_mix.mixed(source_mix.marked(spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in want], "doc_id long, text string, lang string, source string"))).collect()}
    assert all(np.isclose(found[r["doc_id"]], weight[(r["source"], r["lang"], marks[r["doc_id"]][0])] / top, atol=1e-4) for r in want)
    kept = out["source mix"]
    assert {r["doc_id"] for r in kept} <= set(marks) and 0 < len(kept) < len(want)
    chance = defaultdict(float)
    for r in want:
        chance["sum"] += found[r["doc_id"]]
    assert abs(chance["sum"] - len(kept)) < 5 * len(want) ** 0.5

    truth = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.parse_ranks(byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))), special_tokens={})
    want = []
    for r in kept:
        ids = np.array(truth.encode_ordinary(r["text"]), "<u4")
        want.append({"doc_id": r["doc_id"], "n_tokens": len(ids), "ids_sha256": hashlib.sha256(ids.tobytes()).hexdigest(), "decoded_sha256": hashlib.sha256(r["text"].encode()).hexdigest()})
    assert sorted(out["byte-level BPE"], key=key) == sorted(want, key=key)


def test_clean_labelled_documents_stay(spark):
    """The filters keep what the labels call good (texts under 20 words fail a hard limit) and drop what they call bad."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:2]:
        kept = stage(spark, kept, "/root/testdata/sf0.01")
    kept = {r.doc_id for r in kept.select("doc_id").collect()}
    long = {r.doc_id for r in docs.collect() if len(r.text.split()) >= 20}
    good = [d for d, q in labels.items() if q == 1 and d in long]
    bad = [d for d, q in labels.items() if q == 0]
    assert sum(d in kept for d in good) >= 0.98 * len(good) and sum(d in kept for d in bad) <= 0.05 * len(bad)


def test_classifier_rejects_what_rules_keep(spark):
    """Lines that no rule fails, but that the labels' bad documents are left with, go at the second stage."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    junk = "\n".join(["Thtion | edeaing.", "And | reornd.", "Hatiat, | thanon the.", "Erretion | ththinat."] * 1 + [f"Word{i} | other{i}." for i in range(12)])
    some = docs.limit(20).unionByName(spark.createDataFrame([(-1, junk, "en", "src1", len(junk))], docs.schema))
    kept = corpus_pipeline.rules(spark, some, sf).cache()
    assert -1 in {r.doc_id for r in kept.collect()}
    after = {r.doc_id for r in corpus_pipeline.classified(spark, kept, sf).collect()}
    assert after == {r.doc_id for r in kept.collect()} - {-1}


def test_odd_rows_through_all_stages(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows and a clashing column; then an empty table."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    base = docs.filter("length(text) > 500").orderBy("doc_id").limit(3).collect()
    rows = [tuple(r) for r in docs.collect()] + [(9001, None, None, None, None), (9002, "", "en", None, 0), (None, base[0].text, "en", "s", 1), (9003, base[1].text, None, "s", None)]
    rows += [tuple(base[2])] * 3 + [(9004, " ".join(f"long{i} text{i % 97}," for i in range(60_000)) + ".", "en", "src1", 1)]
    odd = spark.createDataFrame(rows, docs.schema).selectExpr("*", "'x' AS Weight", "'y' AS score")
    for empty in (False, True):
        folder = tmp_path / str(empty)
        (odd.limit(0) if empty else odd).write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
        got = [r.asDict() for r in corpus_pipeline.run(spark, str(folder)).collect()]
        assert len({r["doc_id"] for r in got}) == len(got)
        assert not got if empty else got and not {9001, 9002} & {r["doc_id"] for r in got}


def test_classifier_keeps_clean_documents(spark):
    """Of the documents labelled good that the rules keep, held out or not, the classifier drops none."""
    sf = "/root/testdata/sf0.1"
    good = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").select("doc_id").distinct()
    kept = corpus_pipeline.rules(spark, spark.read.parquet(f"{sf}/documents.parquet").join(good, "doc_id", "left_semi"), sf)
    assert corpus_pipeline.classified(spark, kept, sf).count() == kept.count() > 3000
