"""Named queries over the driver's tables, with equivalent DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsense.functions import names, types, vocab
from colsense.functions.hashing import FEATURES, with_hash_features, with_hash_score
from colsense.functions.predicates import crypto_types, is_category, is_gender, is_job_title
from colsense.operators import columns as C
from colsense.operators import pii as P
from colsense.plans import oracle as O
from colsense.plans.classify import classify_columns
from colsense.sources.tables import distinct_values, to_long

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Sources in long form: (table, order, columns).

CUSTOMER = {"customer": ("c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])}
KEYS = {"customer": ("c_custkey", ["c_custkey", "c_nationkey"]), "nation": ("n_nationkey", ["n_nationkey", "n_regionkey", "n_name"]), "orders": ("o_orderkey", ["o_orderkey", "o_custkey"])}
PEOPLE = {"conversations": ("conv_id * 1000 + turn", ["role", "text"])}


def _long(spark: SparkSession, sf_dir: str, tables: dict) -> DataFrame:
    parts = [to_long(_table(spark, sf_dir, t), columns, F.expr(order)) for t, (order, columns) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@_query(f"""SELECT column_name, count(*)::BIGINT AS n_rows, count(*) FILTER (WHERE value IS NULL)::BIGINT AS n_missing, count(DISTINCT value)::BIGINT AS n_unique,
count(*) FILTER (WHERE value IS NULL) = 0 AND count(DISTINCT value) = count(*) AS is_id FROM ({O.long(CUSTOMER | PEOPLE)}) GROUP BY column_name""")
def column_profile(spark, sf_dir):
    return C.profile(_long(spark, sf_dir, CUSTOMER | PEOPLE))


@_query(O.index_confidence(O.long(KEYS)))
def index_confidence(spark, sf_dir):
    return C.index_confidence(_long(spark, sf_dir, KEYS))


_LINES = """SELECT 'l_partkey' AS column_name, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos, l_partkey::VARCHAR AS value FROM lineitem"""


@_query(O.index_confidence(_LINES))
def index_confidence_lines(spark, sf_dir):
    """A column that is no index, in an order made total; positions come from ranges, not from one sort."""
    from colsense.sources.tables import with_positions

    lines = _table(spark, sf_dir, "lineitem").select(F.lit("l_partkey").alias("column_name"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("pos"), F.col("l_partkey").cast("string").alias("value"))
    return C.index_confidence(with_positions(lines))


_TERMS = ["M", " female ", "Non-Binary", "They", "males", "mr.", "Mr", "x", None, ""]


@_query(f"""SELECT count(*)::BIGINT AS n_rows, count(*) FILTER (WHERE g)::BIGINT AS n_gender, count(*) FILTER (WHERE g) / count(*)::DOUBLE AS gender_ratio
FROM (SELECT {O.gender("v")} AS g FROM (SELECT ([{", ".join("NULL" if t is None else O.text(t) for t in _TERMS)}])[c_custkey % {len(_TERMS)} + 1] AS v FROM customer))""")
def gender_votes(spark, sf_dir):
    terms = F.array(*[F.lit(t).cast("string") for t in _TERMS])
    values = _table(spark, sf_dir, "customer").select(is_gender(terms[(F.col("c_custkey") % len(_TERMS)).cast("int")]).alias("g"))
    return values.agg(F.count("*").alias("n_rows"), F.count_if(F.col("g")).alias("n_gender"), (F.count_if(F.col("g")) / F.count("*")).alias("gender_ratio"))


@_query(f"SELECT doc_id, {O.job('text')} AS is_job_title FROM documents")
def job_title_rows(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", is_job_title(F.col("text")).alias("is_job_title"))


@_query(f"""SELECT role AS column_name, count(*)::BIGINT AS n_rows, count(*) FILTER (WHERE {O.job("role")})::BIGINT AS n_job_title, count(*) FILTER (WHERE {O.job("role")}) / count(*)::DOUBLE AS job_title_ratio FROM conversations GROUP BY role""")
def job_title_votes(spark, sf_dir):
    values = _table(spark, sf_dir, "conversations").select(F.col("role").alias("column_name"), F.col("role").alias("value"), F.lit(1).alias("n"))
    return C.votes(C.tallies(C.scored_values(values))).select("column_name", "n_rows", "n_job_title", "job_title_ratio")


_DIGESTS = """SELECT c_custkey AS k, unnest([md5(c_name), sha1(c_name), sha256(c_name), '0x' || substr(sha256(c_name), 1, 40), '0x' || sha256(c_name), c_name, c_custkey::VARCHAR, c_mktsegment, upper(md5(c_name)), 'bc1' || substr(sha256(c_name), 1, 39)]) AS value FROM customer"""


def _digests(spark, sf_dir):
    name = F.col("c_name")
    made = [F.md5(name), F.sha1(name), F.sha2(name, 256), F.concat(F.lit("0x"), F.substring(F.sha2(name, 256), 1, 40)), F.concat(F.lit("0x"), F.sha2(name, 256)), name, F.col("c_custkey").cast("string"), F.col("c_mktsegment"), F.upper(F.md5(name)), F.concat(F.lit("bc1"), F.substring(F.sha2(name, 256), 1, 39))]
    spread = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment").repartition(spark.sparkContext.defaultParallelism)  # a small file would be one task
    return spread.select(F.col("c_custkey").alias("k"), F.explode(F.array(*made)).alias("value"))


@_query(f"SELECT k, value, {O.crypto('value')} AS kinds FROM ({_DIGESTS})")
def crypto_kinds(spark, sf_dir):
    return _digests(spark, sf_dir).select("k", "value", crypto_types(F.col("value")).alias("kinds"))


@_query(f"SELECT k, value, {', '.join(FEATURES)} FROM ({O.hash_score(_DIGESTS)})")
def hash_features(spark, sf_dir):
    return with_hash_features(_digests(spark, sf_dir)).select("k", "value", *FEATURES)


@_query(f"SELECT k, value, score, is_hash, round(confidence, 9) AS confidence, hash_types FROM ({O.hash_score(_DIGESTS)})")
def hash_score(spark, sf_dir):
    return with_hash_score(_digests(spark, sf_dir)).select("k", "value", "score", "is_hash", F.round("confidence", 9).alias("confidence"), "hash_types")


_HASH_COLUMNS = f"SELECT column_name, value FROM ({O.long({'customer': ('c_custkey', ['c_custkey', 'c_name'])})}) UNION ALL SELECT 'digest' AS column_name, md5(c_name) AS value FROM customer UNION ALL SELECT 'address' AS column_name, '0x' || substr(sha256(c_name), 1, 40) AS value FROM customer"


def _hash_columns(spark, sf_dir):
    table = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.md5("c_name").alias("digest"), F.concat(F.lit("0x"), F.substring(F.sha2("c_name", 256), 1, 40)).alias("address"))
    return C.tallies(C.scored_values(distinct_values(to_long(table, order="c_custkey"))))


@_query(f"""SELECT column_name, count(*)::BIGINT AS n_rows, count(*) FILTER (WHERE is_hash)::BIGINT AS n_hash, count(*) FILTER (WHERE is_hash AND confidence > 0.75::DOUBLE)::BIGINT AS n_hash_strict,
count(*) FILTER (WHERE is_hash) / count(*)::DOUBLE AS hash_ratio FROM ({O.hash_score(_HASH_COLUMNS)}) GROUP BY column_name""")
def hash_votes(spark, sf_dir):
    return C.votes(_hash_columns(spark, sf_dir)).select("column_name", "n_rows", "n_hash", "n_hash_strict", "hash_ratio")


_KINDS = f"SELECT column_name, type, count(*)::BIGINT AS count FROM (SELECT column_name, unnest(hash_types) AS type FROM ({O.hash_score(_HASH_COLUMNS)}) WHERE is_hash%s) GROUP BY ALL"


@_query(_KINDS % " AND confidence > 0.75::DOUBLE")
def hash_kinds_strict(spark, sf_dir):
    return C.hash_type_counts(_hash_columns(spark, sf_dir), strict=True)


@_query(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY count DESC, type)::INTEGER AS rank FROM ({_KINDS % ''})) WHERE rank <= 5")
def hash_top_kinds(spark, sf_dir):
    return C.most_frequent(C.hash_type_counts(_hash_columns(spark, sf_dir)), 5)


_TOKENS = "SELECT doc_id, unnest(regexp_extract_all(text, '[0-9a-fA-F]{32,}')) AS value FROM documents"


@_query(f"SELECT doc_id, value, score, is_hash, hash_types FROM ({O.hash_score(_TOKENS)})")
def hash_document_tokens(spark, sf_dir):
    tokens = _table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9a-fA-F]{32,}"), F.lit(0))).alias("value"))
    return with_hash_score(tokens).select("doc_id", "value", "score", "is_hash", "hash_types")


_FILE = "'part_' || p_partkey || '[loader=csv, TOTAL_ROWS = ' || p_size || ' ,elastic_shards=' || p_size || ',elastic_replicas=x,bad,display_name=' || p_brand || ',loader=' || p_type || '][kept].csv'"
_FIELD = "list_filter(pairs, lambda p: p.k = '{k}')[-1].v"


def _file_sql() -> str:
    fields = []
    for k, f in vocab.FILE_KEYS.items():
        x = _FIELD.format(k=k)
        fields.append(f"{'try_cast(' + x + ' AS INTEGER)' if f.startswith('number_of') else x} AS {f}")
    return f"""WITH n AS (SELECT p_partkey, {_FILE} AS name FROM part), c AS (SELECT *, regexp_extract(name, '\\[([^\\]]+)\\]', 1) AS content FROM n),
h AS (SELECT p_partkey, name, list_transform(list_filter(list_transform(string_split(content, ','), lambda p: {O.trim("p")}), lambda p: contains(p, '=')),
  lambda p: struct_pack(k := lower({O.trim("substr(p, 1, strpos(p, '=') - 1)")}), v := {O.trim("substr(p, strpos(p, '=') + 1)")})) AS pairs FROM c)
SELECT p_partkey, regexp_replace(name, '\\[[^\\]]+\\]', '') AS file_name, {", ".join(fields)} FROM h"""


@_query(_file_sql())
def file_metadata(spark, sf_dir):
    name = F.concat(F.lit("part_"), "p_partkey", F.lit("[loader=csv, TOTAL_ROWS = "), "p_size", F.lit(" ,elastic_shards="), "p_size", F.lit(",elastic_replicas=x,bad,display_name="), "p_brand", F.lit(",loader="), "p_type", F.lit("][kept].csv"))
    return _table(spark, sf_dir, "part").select("p_partkey", names.file_metadata(name).alias("m")).select("p_partkey", "m.*")


_COLUMN = "'Type[' || ([{t}])[n_nationkey % 4 + 1] || ']x cat[ID, ' || n_name || ',Index,md5] ' || n_name"
_KIND = ["INTEGER", "date", "KEYWORD", "oops"]


def _column_sql() -> str:
    known = ", ".join(f"'{c}'" for c in vocab.CATEGORIES)
    kinds = ", ".join(f"'{t}'" for t in vocab.FIELD_TYPES)
    name = _COLUMN.format(t=", ".join(f"'{t}'" for t in _KIND))
    return f"""SELECT n_nationkey, {O.trim("regexp_replace(regexp_replace(name, '(?i)type\\[[^\\]]+\\]', '', 'g'), '(?i)cat\\[[^\\]]*\\]', '', 'g')")} AS column_name,
CASE WHEN regexp_extract(name, '(?i)type\\[([^\\]]+)\\]', 1) IN ({kinds}) THEN regexp_extract(name, '(?i)type\\[([^\\]]+)\\]', 1) ELSE 'UNKNOWN' END AS field_type,
list_filter(list_transform(string_split(regexp_extract(name, '(?i)cat\\[([^\\]]*)\\]', 1), ','), lambda c: lower({O.trim("c")})), lambda c: c IN ({known})) AS categories
FROM (SELECT n_nationkey, {name} AS name FROM nation)"""


def _column_names(spark, sf_dir):
    kinds = F.array(*map(F.lit, _KIND))[(F.col("n_nationkey") % 4).cast("int")]
    name = F.concat(F.lit("Type["), kinds, F.lit("]x cat[ID, "), "n_name", F.lit(",Index,md5] "), "n_name")
    return _table(spark, sf_dir, "nation").select("n_nationkey", names.column_metadata(name).alias("m")).select("n_nationkey", "m.*")


@_query(_column_sql())
def column_metadata(spark, sf_dir):
    return _column_names(spark, sf_dir)


@_query(f"SELECT n_nationkey, 'type[' || field_type || ']cat[' || array_to_string(list_append(categories, 'hash'), ',') || ']' || column_name AS encoded FROM ({_column_sql()})")
def column_encode(spark, sf_dir):
    cats = names.with_category(F.col("categories"), F.lit("hash"))
    return _column_names(spark, sf_dir).select("n_nationkey", names.encoded_column(F.col("column_name"), F.col("field_type"), cats).alias("encoded"))


_CATEGORY_ROWS = [(i, c.upper() if i % 3 == 0 else c) for i, c in enumerate(vocab.CATEGORIES)] + [(900, "nothing"), (901, None), (902, "Hash "), (903, "EMAIL-address")]


def _rows_sql(rows: list[tuple], columns: str) -> str:
    shown = lambda v: "NULL" if v is None else f"[{', '.join(map(shown, v))}]::VARCHAR[]" if isinstance(v, list) else O.text(v) if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) AS t({columns})"


@_query(f"SELECT i, v, coalesce(lower(v) IN ({', '.join(O.text(c) for c in vocab.CATEGORIES)}), false) AS is_category, {O.category_type('v')} AS field_type FROM ({_rows_sql(_CATEGORY_ROWS, 'i, v')})")
def category_valid(spark, sf_dir):
    rows = spark.createDataFrame(_CATEGORY_ROWS, "i int, v string")
    return rows.select("i", "v", is_category(F.col("v")).alias("is_category"), types.category_type(F.col("v")).alias("field_type"))


_LISTS = [(1, ["job-title", "gender"]), (2, ["md5"]), (3, ["index"]), (4, []), (5, ["nothing", "drivers-license"]), (6, ["ip-address", "email-address"]), (7, ["date", "ip-address"]), (8, ["street-address", "age"]), (9, ["Bank-Routing-Number", "first-name"]), (10, ["ip-address"])]


@_query(f"SELECT i, {O.type_of_categories('c')} AS field_type FROM ({_rows_sql(_LISTS, 'i, c')})")
def type_from_categories(spark, sf_dir):
    return spark.createDataFrame(_LISTS, "i int, c array<string>").select("i", types.type_of_categories(F.col("c")).alias("field_type"))


_TYPED = {"customer": ("c_custkey", ["c_custkey", "c_name", "c_nationkey"]), "part": ("p_partkey", ["p_size", "p_brand"]), "conversations": ("conv_id", ["turn", "role"]), "labels": ("doc_id", ["quality", "toxic"])}


@_query(O.values_types(O.long(_TYPED)))
def type_from_data(spark, sf_dir):
    return C.type_from_values(distinct_values(_long(spark, sf_dir, _TYPED)))


@_query(O.values_types_literal(O.long(_TYPED)))
def type_from_data_literal(spark, sf_dir):
    return C.type_from_values_literal(distinct_values(_long(spark, sf_dir, _TYPED)))


_SPANS = O.spans("SELECT doc_id AS id, text AS t FROM documents WHERE text IS NOT NULL")


def _document_spans(spark, sf_dir):
    return P.with_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


@_query(f"SELECT id AS doc_id, type, s AS start, e AS \"end\", hit AS text FROM ({_SPANS})")
def pii_spans(spark, sf_dir):
    return _document_spans(spark, sf_dir).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")


@_query(f"SELECT doc_id, coalesce(n, 0) > 0 AS has_pii, coalesce(kinds, []) AS types, kind AS \"primary\" FROM documents LEFT JOIN (SELECT id, sum(n)::BIGINT AS n, list_sort(list(type)) AS kinds, arg_min(type, (-n, type)) AS kind FROM (SELECT id, type, count(*) AS n FROM ({_SPANS}) GROUP BY ALL) GROUP BY id) ON id = doc_id")
def pii_documents(spark, sf_dir):
    """Whether a text has personal data, the set of its kinds, and the most frequent one."""
    spans = _document_spans(spark, sf_dir)
    return spans.select("doc_id", (F.size("spans") > 0).alias("has_pii"), P.span_types(F.col("spans")).alias("types"), P.primary_type(F.col("spans")).alias("primary"))


@_query(f"SELECT 'text' AS column_name, type, count(*)::BIGINT AS n_spans FROM ({_SPANS}) GROUP BY type UNION ALL SELECT 'url' AS column_name, type, count(*)::BIGINT AS n_spans FROM ({O.spans('SELECT page_id AS id, url AS t FROM pages')}) GROUP BY type")
def pii_frequency(spark, sf_dir):
    values = to_long(_table(spark, sf_dir, "documents"), ["text"], "doc_id").unionAll(to_long(_table(spark, sf_dir, "pages"), ["url"], "page_id"))
    return P.frequencies(distinct_values(values))


_FIXTURE = [
    ("contact", "ines.k@harbour.example"), ("contact", "orders+7@kiln.example.org"), ("contact", "none given"), ("contact", ""), ("contact", "a.b_c@x-y.co.nz"),
    ("notes", "Ring 208-555-0142"), ("notes", "SSN: 219-09-9999"), ("notes", "0x52908400098527886E0F7030069857D2E4169EE7"), ("notes", "nothing of note"), ("notes", "card: 4111111111111111"),
    ("blank", ""), ("blank", " "), ("blank", None),
    ("record", "Omar Vale, omar@kiln.example, 415.555.0176"), ("record", "Ida Berg, DOB: 1990-11-02, ida@kiln.example"), ("record", "Walk-in, left no details"), ("record", "SSN 078-05-1120"), ("record", "000-12-3456 and 123-00-4567"),
    ("more", "VIN 1M8GDM9AXKP042788 or 1M8GDM9AXKP042789"), ("more", "GB82WEST12345698765432, GB82WEST12345698765431"), ("more", "routing 021000021 or 021000022"), ("more", "00:1a:2B:3c:4d:5e at 10.0.0.1, 300.1.1.1"),
    ("more", "12 Main Street, Austin, TX 78701-1234"), ("more", "Dr. Jane Roe, aged 41, paid $1,250.50"), ("more", "passport no 123456789, DL: A1234567, ext 42"), ("more", "1Z999AA10123456784 on 3 March 2021, 2/30/2021, 12/31/2020"), ("more", "born in New York, 45 years old, call 1 (743) 555-3824"), ("more", "1BoatSLRHtKNngkdXEeobR76b53LETtpyT https://x.org/a?b=1"),
]
_FIXTURE_ROWS = [(i, *r) for i, r in enumerate(_FIXTURE)]
_FIXTURE_SQL = _rows_sql(_FIXTURE_ROWS, "id, column_name, value")


@_query(f"""WITH r AS ({_FIXTURE_SQL}), n AS (SELECT column_name, count(*) AS size FROM r GROUP BY ALL),
k AS (SELECT column_name, type, count(*)::BIGINT AS n_spans FROM ({O.spans(f"SELECT id, lower({O.trim('value')}) AS t FROM ({_FIXTURE_SQL}) WHERE value IS NOT NULL", any_case=True)}) JOIN r USING (id) GROUP BY ALL)
SELECT column_name, type, coalesce(n_spans, 0)::BIGINT AS n_spans, coalesce(n_spans, 0) / size::DOUBLE AS ratio FROM n LEFT JOIN k USING (column_name)""")
def pii_ratio(spark, sf_dir):
    rows = spark.createDataFrame(_FIXTURE_ROWS, "id int, column_name string, value string")
    return P.ratios(distinct_values(rows))


_TEXTS = {"documents": ("doc_id", ["text"]), "pages": ("page_id", ["url", "html"])}


def _texts_sql(any_case: bool) -> str:
    """Return SQL for (column_name, type, n_spans, size) of the texts of the tables, column by column."""
    value = f"lower({O.trim('{c}')})" if any_case else "{c}"
    parts = [(t, c, O.spans(f"SELECT {key} AS id, {value.format(c=c)} AS t FROM {t} WHERE {c} IS NOT NULL", any_case=any_case)) for t, (key, columns) in _TEXTS.items() for c in columns]
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, type, count(*)::BIGINT AS n_spans, (SELECT count(*) FROM {t}) AS size FROM ({spans}) GROUP BY type" for t, c, spans in parts)


@_query(f"SELECT column_name, type, n_spans FROM ({_texts_sql(False)})")
def pii_frequency_tables(spark, sf_dir):
    """``pii_frequency`` with the raw pages as well."""
    return P.frequencies(distinct_values(_long(spark, sf_dir, _TEXTS)))


@_query(f"SELECT column_name, type, n_spans, n_spans / size::DOUBLE AS ratio FROM ({_texts_sql(True)})")
def pii_ratio_tables(spark, sf_dir):
    """The ratios over whole tables; ``pii_ratio`` holds the rules against a few chosen rows."""
    return P.ratios(distinct_values(_long(spark, sf_dir, _TEXTS)))


_DICTIONARY = [("city", "The"), ("city", "Of The"), ("first-name", "and"), ("surname", "the of and"), ("hospital", "General Hospital"), ("county", "est en")]


@_query(f"""WITH w AS (SELECT regexp_extract_all(lower(text), '[a-z]+(?:[''-][a-z]+)*') AS w FROM documents), g AS (SELECT unnest(w) AS term FROM w
UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w UNION ALL SELECT unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w)
SELECT 'text' AS column_name, type, count(*)::BIGINT AS n_spans FROM g JOIN (SELECT type, lower(term) AS term FROM ({_rows_sql(_DICTIONARY, "type, term")})) USING (term) GROUP BY type""")
def pii_dictionary(spark, sf_dir):
    dictionary = spark.createDataFrame(_DICTIONARY, "type string, term string")
    return P.dictionary_hits(distinct_values(to_long(_table(spark, sf_dir, "documents"), ["text"], "doc_id")), dictionary)


@_query(f"SELECT column_name, pos, value FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY md5(pos::VARCHAR || ':0'), pos) AS r FROM ({O.long(CUSTOMER)})) WHERE r <= 1000")
def sample_rows(spark, sf_dir):
    """The seeded sample of 1000 rows of each column (a sampling operator)."""
    return C.sample_rows(_long(spark, sf_dir, CUSTOMER))


@_query(f"""WITH l AS (SELECT column_name, row_number() OVER (PARTITION BY column_name ORDER BY pos) - 1 AS pos, value FROM ({O.long(CUSTOMER)})),
s AS (SELECT column_name, CASE WHEN count(*) > 1000 THEN ('0x' || substr(md5(column_name || ':0'), 1, 12))::BIGINT % (count(*) - 999) ELSE 0 END AS start FROM l GROUP BY column_name)
SELECT column_name, pos::BIGINT AS pos, value FROM l JOIN s USING (column_name) WHERE pos >= start AND pos < start + 1000 AND NOT {O.blank("value")}""")
def contiguous_block(spark, sf_dir):
    """A seeded run of 1000 rows of each column (a sampling operator)."""
    from colsense.sources.tables import with_positions

    return C.contiguous_block(with_positions(_long(spark, sf_dir, CUSTOMER)))


def _classify_sql() -> str:
    tables = {"customer": ("c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]), "conversations": ("conv_id * 1000 + turn", ["role", "text"])}
    source = O.long(tables)
    return f"""
WITH l AS MATERIALIZED ({source}), d AS MATERIALIZED (SELECT column_name, value, count(*) AS n FROM l GROUP BY ALL),
h AS MATERIALIZED ({O.hash_score("SELECT column_name, value, n FROM d")}),
v AS (SELECT column_name, sum(n) AS size, coalesce(sum(n) FILTER (WHERE {O.gender("value")}), 0) / sum(n) > 0.75 AS g, coalesce(sum(n) FILTER (WHERE {O.job("value")}), 0) / sum(n) > 0.75 AS j, coalesce(sum(n) FILTER (WHERE is_hash), 0) / sum(n) > 0.75 AS h FROM h GROUP BY column_name),
k AS (SELECT column_name, list(type) AS kinds FROM (SELECT column_name, type, row_number() OVER (PARTITION BY column_name ORDER BY sum(n) DESC, type) AS r FROM (SELECT column_name, n, unnest(hash_types) AS type FROM h WHERE is_hash) GROUP BY column_name, type) WHERE r <= 5 GROUP BY column_name),
p AS MATERIALIZED (SELECT column_name, type FROM (SELECT column_name, type, row_number() OVER (PARTITION BY column_name ORDER BY sum(n) DESC, type) AS r
   FROM ({O.spans("SELECT row_number() OVER (ORDER BY column_name, value) AS id, value AS t FROM d WHERE value IS NOT NULL")}) JOIN (SELECT row_number() OVER (ORDER BY column_name, value) AS id, column_name, n FROM d WHERE value IS NOT NULL) USING (id) GROUP BY column_name, type) WHERE r = 1),
i AS (SELECT column_name, count(*) FILTER (WHERE value IS NULL) = 0 AND count(DISTINCT value) = count(*) AS is_id FROM l GROUP BY column_name),
x AS ({O.index_confidence("SELECT * FROM l")}), t AS ({O.values_types("SELECT column_name, value FROM l")}),
c AS (SELECT column_name, t.field_type AS by_values, t.n_filled, list_distinct_ordered FROM (SELECT v.column_name, list_concat(CASE WHEN is_index THEN ['index'] ELSE []::VARCHAR[] END, list_sort(list_concat(
  CASE WHEN g THEN ['gender'] ELSE []::VARCHAR[] END, CASE WHEN j THEN ['job-title'] ELSE []::VARCHAR[] END, CASE WHEN h THEN list_concat(['hash'], coalesce(kinds, []::VARCHAR[])) ELSE []::VARCHAR[] END,
  CASE WHEN NOT (g OR j OR h) AND p.type IS NOT NULL THEN [p.type] ELSE []::VARCHAR[] END, CASE WHEN is_id THEN ['id'] ELSE []::VARCHAR[] END))) AS list_distinct_ordered
  FROM v LEFT JOIN k USING (column_name) LEFT JOIN p USING (column_name) JOIN i USING (column_name) JOIN x USING (column_name)) JOIN t USING (column_name))
SELECT column_name, column_name AS name, list_distinct_ordered AS categories, CASE WHEN n_filled = 0 THEN 'TEXT' WHEN {O.type_of_categories("list_distinct_ordered")} <> 'UNKNOWN' THEN {O.type_of_categories("list_distinct_ordered")} ELSE by_values END AS field_type FROM c"""


@_query(_classify_sql())
def classify(spark, sf_dir):
    """The flagship: categories and field types of the columns of customer and conversations."""
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    people = _table(spark, sf_dir, "conversations").select("role", "text", (F.col("conv_id") * 1000 + F.col("turn")).alias("__order"))
    return classify_columns(customer, "c_custkey").unionAll(classify_columns(people, "__order", columns=["role", "text"]))


QUERIES["classify_columns"] = QUERIES.pop("classify")
ORACLE_SQL["classify_columns"] = ORACLE_SQL.pop("classify")
