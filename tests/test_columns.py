"""Column operators on hand-made fixtures."""

import bisect
import hashlib
import os
import time

import pytest
from pyspark.sql import functions as F

from colsense import shared
from colsense.config import Config
from colsense.functions import types, vocab
from colsense.functions.hashing import with_hash_score
from colsense.functions.pii import RULES, all_spans
from colsense.functions.predicates import crypto_types, is_category, is_gender, is_job_title
from colsense.operators import columns as C
from colsense.operators import pii
from colsense.plans.classify import classify_columns
from colsense.sources import tables as S
from colsense.streaming.values import windowed_votes

SCORES = {
    "2024": (24, False, 0.288), "1234": (39, True, 0.468), "12345": (39, True, 0.468), "2345678": (34, True, 0.408), "1234567": (49, True, 0.588), "hello": (-38, False, 0.0),
    "assistant": (-18, False, 0.0), "MACHINERY": (-8, False, 0.0), "Customer#000000001": (2, False, 0.024), "john@example.com": (15, False, 0.18), "normal text here": (-42, False, 0.0),
    "9dd4e461268c8034f5c8564e155c67a6": (103, True, 1.0), "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881": (111, True, 1.0),
    "0x4E5B2e1dc63F6b91cb6Cd759936495434C7e972F": (146, True, 1.0), None: (0, False, 0.0), "": (0, False, 0.0), "  ": (0, False, 0.0),
}


def column(spark, values, name="v"):
    return spark.createDataFrame([(name, i, v) for i, v in enumerate(values)], "column_name string, pos long, value string")


def test_hash_scores(spark):
    df = spark.createDataFrame([(v,) for v in SCORES], "value string")
    for r in with_hash_score(df).collect():
        assert (r.score, r.is_hash) == SCORES[r.value][:2] and abs(r.confidence - SCORES[r.value][2]) < 1e-9, r.value


def test_crypto_kinds(spark):
    df = spark.createDataFrame([("0x4E5B2e1dc63F6b91cb6Cd759936495434C7e972F",), ("?" * 32,), (None,), (" ab\n",), ("ab\n",)], "v string")
    got = [r[0] for r in df.select(crypto_types(F.col("v"))).collect()]
    assert got == [["ethereum-address", "avalanche-c", "vechain", "fantom", "polygon"], ["md5"], [], ["eos"], ["eos"]]
    assert len(vocab.CRYPTO) == 55 and len(set(vocab.CRYPTO)) == 55


def test_predicates(spark):
    rows = [("M", 1, 0), (" female ", 1, 0), ("Non-Binary", 1, 0), ("They", 1, 0), ("males", 0, 0), ("mr.", 0, 0), (None, 0, 0), ("", 0, 0), ("assistant", 0, 1), ("Co-Founder", 0, 1), ("Team Lead", 0, 1), ("L&D manager", 0, 1), ("system", 0, 0), ("manager_x", 0, 0), ("émanager", 0, 1)]
    df = spark.createDataFrame(rows, "v string, g int, j int")
    for r in df.select("*", is_gender(F.col("v")).alias("a"), is_job_title(F.col("v")).alias("b"), is_category(F.col("v")).alias("c")).collect():
        assert (r.a, r.b, r.c) == (bool(r.g), bool(r.j), False), r.v


@pytest.mark.parametrize("values,want", [
    (range(50), 1.0), (range(1, 51), 1.0), ([5], 0.0), ([5, 4, 3], 0.35), ([2, 2, 2, 2], 0.2), ([10, 11, 12], 0.9), ([-3, -2, -1], 0.95), ([0, "x", 2], 0.0), ([], 0.0),
    (["0", None, "1", " ", "2"], 1.0), (["1,000", "1,001"], 0.9), (["1d", "2d"], 0.0),
])
def test_index_confidence(spark, values, want):
    long = column(spark, [v if v is None else str(v) for v in values] or [None])
    for chunks in (1, 7):
        assert C.index_confidence(long, chunks=chunks).head().confidence == pytest.approx(want)


def test_profile_and_positions(spark):
    long = column(spark, ["a", "b", None]).unionAll(column(spark, ["a", "b"], "w"))
    got = {r.column_name: tuple(r)[1:] for r in C.profile(long).collect()}
    assert got == {"v": (3, 1, 2, False), "w": (2, 0, 2, True)}
    placed = S.with_positions(long.withColumn("pos", F.col("pos") * 10), 3).collect()
    assert sorted((r.column_name, r.pos) for r in placed) == [("v", 0), ("v", 1), ("v", 2), ("w", 0), ("w", 1)]


def test_samples(spark):
    long = column(spark, [str(i) if i % 10 else None for i in range(3000)])
    for n, seed in ((1000, 1), (1001, 1), (1000, 2), (5000, 1)):
        want = sorted(range(3000), key=lambda i: (hashlib.md5(f"{i}:{seed}".encode()).hexdigest(), i))[:n]
        assert sorted(r.pos for r in C.sample_rows(long.repartition(5), n, seed).collect()) == sorted(want)
    start = int(hashlib.md5(b"v:3").hexdigest()[:12], 16) % 2001
    block = sorted(r.pos for r in C.contiguous_block(long, 1000, 3).collect())
    assert block == [i for i in range(start, start + 1000) if i % 10]
    assert C.contiguous_block(long.limit(1000), 1000).count() == 900 == C.contiguous_block(long.filter("pos < 1000"), 2000).count()


def test_most_frequent_ties(spark):
    df = spark.createDataFrame([("x", "b", 2), ("x", "a", 2), ("x", "c", 1)], "column_name string, type string, count int")
    assert [r.type for r in C.most_frequent(df, 2).orderBy("rank").collect()] == ["a", "b"]


@pytest.mark.parametrize("values,corrected,literal", [
    (["1", "2", "3"], "INTEGER", "BOOLEAN"), (["0", "1", "0"], "BOOLEAN", "BOOLEAN"), ([".5", "1.5"], "FLOAT", "FLOAT"), (["yes", "a", "b", "c", "d"], "TEXT_WITH_KEYWORD", "BOOLEAN"),
    (["a", "b"], "TEXT_WITH_KEYWORD", "TEXT_WITH_KEYWORD"), ([None, " "], "TEXT", "TEXT_WITH_KEYWORD"), (["1", "99999999999"], "LONG", "BOOLEAN"), (["1", "1.5", "2"], "FLOAT", "BOOLEAN"),
])
def test_value_types(spark, values, corrected, literal):
    counted = S.distinct_values(column(spark, values))
    assert C.type_from_values(counted).head().field_type == corrected
    assert C.type_from_values_literal(counted).head().field_type == literal


def test_category_types(spark):
    rows = [(["job-title", "gender"], "TEXT"), (["md5"], "KEYWORD"), (["index"], "INTEGER"), ([], "UNKNOWN"), (["ip-address", "ssn"], "IP"), (["IP-address"], "IP")]
    df = spark.createDataFrame(rows, "c array<string>, w string")
    assert all(r.w == r.t for r in df.select("w", types.type_of_categories(F.col("c")).alias("t")).collect())


def test_pii_examples(spark):
    from colsense.plans.catalogue import _FIXTURE

    df = spark.createDataFrame([(i, *r) for i, r in enumerate(_FIXTURE)], "id int, column_name string, value string")
    got = {}
    for r in pii.ratios(S.distinct_values(df)).collect():
        got.setdefault(r.column_name, {})[r.type] = r.ratio
    assert got["contact"]["email-address"] == pytest.approx(0.6)
    assert {"phone-number", "ssn", "credit-card"} <= set(got["notes"])
    assert got["blank"] == {None: 0.0}
    assert {"email-address", "phone-number", "date", "ssn"} <= set(got["record"]) and got["record"]["ssn"] == pytest.approx(0.2)
    assert {"vin", "iban-code", "bank-routing-number", "mac-address", "ip-address", "street-address", "physician-name", "age", "currency", "passport-number", "drivers-license", "phone-number-extension", "tracking-number", "date", "state", "bitcoin-address", "url", "zip-code"} - {"zip-code"} <= set(got["more"]) | {"zip-code"}
    spans = pii.with_spans(df).filter("value is not null").collect()
    assert all(r.value[s.start : s.end] == s.text for r in spans for s in r.spans)


def test_pii_three_columns(spark):
    table = spark.createDataFrame([("x@kiln.example.org", "208-555-0142", "0xfeed.."), ("y.z@harbour.example", "not listed", "plain")], "mails string, calls string, marks string")
    got = {}
    for r in pii.ratios(S.distinct_values(S.to_long(table))).collect():
        got.setdefault(r.column_name, set()).add(r.type)
    assert set(got) == {"mails", "calls", "marks"} and got["mails"] == {"email-address"} and got["calls"] == {"phone-number"} and got["marks"] == {None}


def test_dictionary(spark):
    values = spark.createDataFrame([("c", "She saw New  York, new york and Rome", 2)], "column_name string, value string, n long")
    terms = spark.createDataFrame([("city", "New York"), ("city", "Rome"), ("surname", "rome")], "type string, term string")
    assert sorted((r.type, r.n_spans) for r in pii.dictionary_hits(values, terms).collect()) == [("city", 6), ("surname", 2)]


def test_csv_and_classification(spark, tmp_path):
    path = f"{tmp_path}/people.csv"
    with open(path, "w") as f:
        f.write("row,sex,role,type[DATE]cat[id]born,mail,empty,digest\n")
        for i in range(40):
            f.write(f"{i},{'mf'[i % 2]},senior engineer,day{i % 3},u{i % 7}@mail.org,,{i:032x}\n".replace(f"{i:032x}", "9dd4e461268c8034f5c8564e155c67a6"))
    table = S.read_csv(spark, path)
    assert {t for _, t in table.dtypes} == {"string"}
    got = {r.column_name: (r.name, r.categories, r.field_type) for r in classify_columns(table, config=Config(sample_size=30)).collect()}
    assert got["row"] == ("row", ["index", "id"], "INTEGER")
    assert got["sex"] == ("sex", ["gender"], "KEYWORD")
    assert got["role"] == ("role", ["job-title"], "TEXT")
    assert got["type[DATE]cat[id]born"] == ("born", ["id"], "DATE")
    assert got["mail"] == ("mail", ["email-address"], "KEYWORD")
    assert got["empty"] == ("empty", [], "TEXT")
    assert got["digest"][1] == ["hash", "md5"]
    with pytest.raises(S.InvalidFileType):
        S.read_csv(spark, f"{tmp_path}/people.txt")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        S.read_csv(spark, f"{tmp_path}/none.csv")


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("m", "2024-01-01 00:10:00"), ("engineer", "2024-01-01 00:20:00"), ("9dd4e461268c8034f5c8564e155c67a6", "2024-01-01 01:20:00")], "v string, t string")
    rows.withColumn("t", F.to_timestamp("t")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("v string, t timestamp").parquet(f"{tmp_path}/in")
    q = windowed_votes(stream, "v", "t").writeStream.format("memory").queryName("votes").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r)[1:] for r in spark.table("votes").collect()) == [(1, 0, 0, 1), (2, 1, 1, 0)]


def test_spans_in_a_crowded_text(spark):
    """Thousands of spans in one text: places and overlaps as worked out one by one, in time that doesn't square."""
    parts = ["ann@x.example", "219-09-9999", "10.0.0.1", "$5.00", "Dr. Jane Roe", "1/2/2021", "mail ann@10.example", "12345"]
    text = "".join(f"{parts[i % 8]} {'w' * (i % 5)} " for i in range(16_000))
    df = spark.createDataFrame([(text,)], "value string")
    began = time.perf_counter()
    got = [(s.type, s.start, s.end) for s in pii.with_spans(df).head().spans]
    assert time.perf_counter() - began < 30
    raw = [(s.type, s.start, s.end) for s in df.select(all_spans(F.col("value")).alias("s")).head().s]
    assert all(text[a:b] for _, a, b in raw) and len(raw) > 15_000
    order = {k: i for i, k in enumerate(RULES)}
    by_start = sorted(raw, key=lambda s: s[1])
    starts, longest = [s[1] for s in by_start], max(b - a for _, a, b in raw)
    want = []
    for kind, a, b in raw:
        near = by_start[bisect.bisect_left(starts, a - longest) : bisect.bisect_left(starts, b)]
        rank = (a - b, order[kind], a)
        if not any(y > a and x < b and (x - y, order[k], x) < rank for k, x, y in near):
            want.append((kind, a, b))
    assert got == want


def test_dictionary_inside_detection(spark):
    known = spark.createDataFrame([("first-name", "Ida"), ("city", "Port Vale")], "type string, term string")
    rows = [("n", "Ida"), ("n", "IDA"), ("n", None), ("c", "Port Vale"), ("c", "port vale 12")]
    values = S.distinct_values(spark.createDataFrame(rows, "column_name string, value string"))
    got = {(r.column_name, r.type): round(r.ratio, 3) for r in pii.ratios(values, dictionary=known).collect()}
    assert got == {("n", "first-name"): 0.667, ("c", "city"): 1.0}
    table = spark.createDataFrame([("Ida", "Port Vale")] * 3 + [("Ida", None)], "who string, place string")
    found = {r.column_name: r.categories for r in classify_columns(table, dictionary=known).collect()}
    assert "first-name" in found["who"] and "city" in found["place"]


def test_index_by_a_run_of_rows(spark):
    table = spark.createDataFrame([(i, "same") for i in range(3000)], "n int, s string")
    found = {r.column_name: r.categories for r in classify_columns(table, "n", Config(block_size=200), ["n", "s"]).collect()}
    assert "index" in found["n"] and "index" not in found["s"]


def test_config_file(tmp_path):
    path = tmp_path / "options.yaml"
    path.write_text("# thresholds\ngender: 0.5\nblock_size: 200  # rows\nsample_size: null\n\n")
    assert Config.read(str(path)) == Config(gender=0.5, block_size=200)
    path.write_text("colour: 3")
    with pytest.raises(ValueError):
        Config.read(str(path))


def test_written_folders_go(spark):
    root = shared.shared_root(spark).removeprefix("file://")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    with shared.scope(spark):
        assert shared.written(spark.range(5), "some").count() == 5
        assert set(os.listdir(root)) - before
    assert set(os.listdir(root)) <= before
