import re
from pathlib import Path

import duckdb
import pytest

from colsense.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """Base counts, straight from their definitions."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit))


CASES = {
    "null": None,
    "empty": "",
    "blank": " \n\t\v\f\r ",
    "short": "only a few words here",
    "clean": "A clean line of plain prose that says a few things in order.\nAnother line that follows it and ends as it should, with a stop.",
    "marks": "every### word$$$ here%%% has&&& marks*** after### it$$$ all%%% along&&& the*** line### so$$$ it%%% is&&& junk*** that### must$$$ go%%% away&&& now*** yes###",
    "shout": "ALL!! OF!! THIS!! IS!! SHOUTED!! AT!! THE!! READER!! WORD!! BY!! WORD!! UNTIL!! THE!! END!! OF!! THE!! TEXT!! WHICH!! NEVER!! COMES!! HERE!!",
    "menu": " | ".join(f"item{i}" for i in range(30)),
    "repeat": "one two three four five six seven eight " * 6,
    "filler": "\n".join(" ".join([w] * 6) for w in "ab cd ef gh ij kl".split()),
    "notice": "We value you. Read our privacy policy.\n" + "A long and clean line of plain prose that says a few more things in good order for all who read it to the end.",
    "run-on": "words that run on and on without any stop " * 1 + " ".join(f"w{i}" for i in range(45)),
    "addresses": "\n".join(f"See HTTP://a{i}.org and https://b{i}.org/x, www.c{i}.org too {i}" for i in range(5)),
    "few addresses": "\n".join(f"The site https://b{i}.org/x has n{i} more o{i} to p{i} say q{i} here, number {i}." for i in range(5)),
    "imprint": "Alle Rechte vorbehalten, Nummer eins.\nLire la suite de cet article.\n" + "Ein langer Satz mit vielen guten Worten, der am Ende seinen Punkt hat, wie es sich für ihn und alle anderen gehört.",
    "odd space": "a b c d\re\x1cf " * 8,
}
KEPT = {"clean", "notice", "few addresses"}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    got = Q.judge(CASES[name])
    assert got[:5] == plain(CASES[name])
    assert got[8] == (name in KEPT)
    if name == "notice":
        assert got[9].startswith("A long") and got[5] == 1


def test_query_matches_sql(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(CASES.values())] + [(None, CASES["clean"]), (1, CASES["menu"]), (99, "word " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.query(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(Q.ORACLE)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)


def test_filter_keeps_columns(spark):
    docs = spark.createDataFrame([(1, CASES["notice"], "x", 1), (2, None, None, None)], "doc_id long, text string, Kept string, n_chars long")
    row = Q.filtered(docs).collect()
    assert [tuple(r) for r in row] == [(1, CASES["notice"].split("\n")[1], "x", len(CASES["notice"].split("\n")[1]))]
    assert Q.filtered(docs.limit(0)).columns == docs.columns


def test_matches_sql_on_table(spark):
    sf = "/root/testdata/sf0.001"
    if not Path(sf).exists():
        pytest.skip("no table")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(Q.ORACLE)
    assert sorted(map(tuple, Q.query(spark, sf).select(*want.columns).collect())) == sorted(want.fetchall())
