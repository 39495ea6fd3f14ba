"""File and column names: the examples that users of such names rely on."""

import pytest
from pyspark.sql import functions as F

from colsense.functions import names

FIELDS = ["loader", "total_rows", "id_column_name", "elastic_index_name", "number_of_shards", "number_of_replicas", "case_id", "md5", "display_name", "section"]
FULL = "ledger[display_section=annex,md5=9e107d9d,elastic_replicas=2,loader=orc,case_id=K-77,total_rows=42,elastic_index_name=ledgers,display_name=Year End,elastic_shards=6,id_column_name=entry_no].tsv"
FILES = {
    "notes.md": {"file_name": "notes.md"},
    FULL: {"file_name": "ledger.tsv"} | dict(zip(FIELDS, ["orc", "42", "entry_no", "ledgers", 6, 2, "K-77", "9e107d9d", "Year End", "annex"])),
    "q3[Case_ID=B9,MD5=ff].orc": {"file_name": "q3.orc", "case_id": "B9", "md5": "ff"},
    "q3[\tcase_id  =  B 9  ,\n md5=ff ].orc": {"file_name": "q3.orc", "case_id": "B 9", "md5": "ff"},
    "q3[md5=aa] (copy)[md5=bb].orc": {"file_name": "q3 (copy)[md5=bb].orc", "md5": "aa"},
    "q3[note,colour=red,display_name=Q 3,=blue,].orc": {"file_name": "q3.orc", "display_name": "Q 3"},
    "[total_rows=7]": {"file_name": "", "total_rows": "7"},
    "plan[a,b].json": {"file_name": "plan.json"},
    None: {}, "": {}, " \t": {},
    "logs[total_rows=many,elastic_replicas=0,elastic_shards=12].gz": {"file_name": "logs.gz", "number_of_shards": 12, "number_of_replicas": 0, "total_rows": "many"},
    "logs[elastic_shards=two,elastic_replicas=3000000000].gz": {"file_name": "logs.gz"},
    "logs[loader=gz": {"file_name": "logs[loader=gz"},
    "x[md5=1,md5=2=3]\ny[]": {"file_name": "x\ny[]", "md5": "2=3"},
}


def test_file_names(spark):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(FILES)], "i int, name string")
    for r in df.select("i", names.file_metadata(F.col("name")).alias("m")).collect():
        want = list(FILES.values())[r.i]
        assert r.m.asDict() == {f: want.get(f) for f in ["file_name", *FIELDS]}, list(FILES)[r.i]


COLUMNS = [
    ("type[INTEGER]cat[index,ID]row", "row", "INTEGER", ["index", "id"]),
    ("cat[foo]type[integer]x", "x", "UNKNOWN", []),
    ("type[DATE]", "unnamed", "DATE", []),
    (" ", "", "UNKNOWN", []), (None, "", "UNKNOWN", []),
    ("subTYPE[TEXT]y cat[ md5 ,hash,md5]", "suby", "TEXT", ["md5", "hash", "md5"]),
    ("type[A]type[DATE]z", "z", "UNKNOWN", []), ("plain", "plain", "UNKNOWN", []),
]


@pytest.mark.parametrize("name,rest,kind,cats", COLUMNS)
def test_column_names(spark, name, rest, kind, cats):
    m = spark.createDataFrame([(name,)], "n string").select(names.column_metadata(F.col("n")).alias("m"))
    got = m.head().m
    assert (got.column_name, got.field_type, got.categories) == (rest, kind, cats)
    back = m.select(names.encoded_column(F.col("m.column_name"), F.col("m.field_type"), names.with_category(F.col("m.categories"), F.lit("id")))).head()[0]
    assert back == f"type[{kind}]cat[{','.join([*cats, 'id'])}]{rest}"
