"""DuckDB SQL for the operators, built from the same vocabularies and patterns."""

from __future__ import annotations

from colsense.functions import vocab
from colsense.functions.pii import RULES, VIN_WEIGHTS
from colsense.functions.predicates import GENDER_TERMS, JOB_TERMS
from colsense.functions.text import alternatives
from colsense.functions.types import BOOLEAN, FLOAT, INTEGER
from colsense.operators.columns import NUMBER

_TRIM = r"'\A[\x00-\x20]+|[\x00-\x20]+\z', '', 'g'"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def trim(x: str) -> str:
    return f"regexp_replace({x}, {_TRIM})"


def blank(x: str) -> str:
    return f"coalesce({trim(x)} = '', true)"


def whole(x: str, pattern: str) -> str:
    return f"regexp_full_match({x}, {text('(?:' + pattern + ')')})"


def gender(x: str) -> str:
    return f"coalesce({whole(trim(x), '(?i)(?:' + alternatives(GENDER_TERMS) + ')')}, false)"


def job(x: str) -> str:
    return f"coalesce(regexp_matches({trim(x)}, {text('(?i)' + chr(92) + 'b(?:' + alternatives(JOB_TERMS) + ')' + chr(92) + 'b')}), false)"


def crypto(x: str) -> str:
    found = [f"CASE WHEN length({x}) = {n} THEN '{name}' END" for name, n in vocab.DIGEST_LENGTHS]
    found += [f"CASE WHEN {whole(trim(x), form)} THEN '{name}' END" for name, form in vocab.ADDRESS_FORMS]
    return f"CASE WHEN {x} IS NULL THEN []::VARCHAR[] ELSE list_filter([{', '.join(found)}], lambda k: k IS NOT NULL) END"


def hash_score(source: str) -> str:
    """Return SQL for all columns of ``source`` (SQL with a column value), the features, score, is_hash, confidence and hash_types."""
    n = "len::DOUBLE"
    pairs = "range(1, len)"
    return rf"""
SELECT * EXCLUDE (t, len, chars, codes, counts, mean, upper, grams, spaced, hexed, prefixed, b58, b32),
       score >= 25 AND t IS NOT NULL AS is_hash, greatest(0.0::DOUBLE, least(100.0::DOUBLE, score * 1.2::DOUBLE)) / 100 AS confidence,
       CASE WHEN t IS NULL THEN []::VARCHAR[] ELSE {crypto("value")} END AS hash_types
FROM (
SELECT *, CASE WHEN t IS NULL THEN 0.0::DOUBLE ELSE (
  CASE WHEN entropy > 3.5 THEN 15 WHEN entropy < 2.5 THEN -10 ELSE 0 END + CASE WHEN chi_square < 50 AND NOT spaced THEN 12 ELSE 0 END
  + CASE WHEN bigram_entropy > 4.5 THEN 13 WHEN bigram_entropy < 3.0 THEN -8 ELSE 0 END + CASE WHEN uniformity > 0.85::DOUBLE AND len > 20 THEN 10 ELSE 0 END
  + CASE WHEN abs(serial_correlation) < 0.1::DOUBLE AND len > 20 THEN 10 ELSE 0 END + CASE WHEN abs(runs_z) < 2.0 AND len > 20 THEN 8 ELSE 0 END
  + CASE WHEN vowel_ratio > 0 AND vowel_ratio < 0.3::DOUBLE AND NOT spaced THEN 8 WHEN vowel_ratio > 0.35::DOUBLE AND vowel_ratio < 0.45::DOUBLE THEN -12 ELSE 0 END
  + CASE WHEN digit_ratio > 0.3::DOUBLE AND NOT spaced THEN 10 ELSE 0 END + CASE WHEN case_mix > 0.8::DOUBLE AND NOT spaced AND len > 20 THEN 7 ELSE 0 END
  + CASE WHEN run_length_ratio > 0.9::DOUBLE AND len > 30 THEN 10 ELSE 0 END + CASE WHEN hexed OR prefixed THEN 20 ELSE 0 END + CASE WHEN prefixed THEN 15 ELSE 0 END
  + CASE WHEN b58 AND len BETWEEN 26 AND 35 THEN 18 ELSE 0 END + CASE WHEN b32 THEN 25 ELSE 0 END
  + CASE WHEN len IN ({", ".join(map(str, vocab.HASH_LENGTHS))}) AND (hexed OR prefixed) THEN 15 ELSE 0 END + CASE WHEN spaced THEN -30 ELSE 0 END
  + CASE WHEN len < 10 AND regexp_full_match(t, '[a-zA-Z]+') THEN -20 ELSE 0 END + CASE WHEN prefixed AND len = 66 THEN 20 ELSE 0 END
  + CASE WHEN prefixed AND len = 42 THEN 20 ELSE 0 END + CASE WHEN regexp_matches(t, '^(?:1|3|bc1)') AND (b58 OR b32) THEN 15 ELSE 0 END)::DOUBLE END AS score
FROM (
SELECT *, contains(t, ' ') AS spaced, regexp_full_match(t, '[a-fA-F0-9]+') AS hexed, regexp_full_match(t, '0x[a-fA-F0-9]+') AS prefixed,
  regexp_full_match(t, '[1-9A-HJ-NP-Za-km-z]+') AS b58, regexp_full_match(t, '(bc1|tb1)[a-z0-9]+') AS b32,
  round(-list_sum(list_transform(counts, lambda x: x / {n} * log2(x / {n}))), 9) AS entropy,
  round(list_sum(list_transform(counts, lambda x: pow(x - {n} / len(counts), 2) / ({n} / len(counts)))), 9) AS chi_square,
  CASE WHEN len < 2 THEN 0.0::DOUBLE ELSE round(-list_sum(list_transform(list_distinct(grams), lambda g: len(list_filter(grams, lambda y: y = g)) / ({n} - 1) * log2(len(list_filter(grams, lambda y: y = g)) / ({n} - 1)))), 9) END AS bigram_entropy,
  round(1 / (1 + sqrt(list_sum(list_transform(counts, lambda x: pow(x - {n} / len(counts), 2))) / len(counts)) / ({n} / len(counts))), 9) AS uniformity,
  CASE WHEN len < 2 OR list_sum(list_transform({pairs}, lambda i: pow(codes[i] - mean, 2))) <= 0 THEN 0.0::DOUBLE
       ELSE round(list_sum(list_transform({pairs}, lambda i: (codes[i] - mean) * (codes[i + 1] - mean))) / list_sum(list_transform({pairs}, lambda i: pow(codes[i] - mean, 2))), 9) END AS serial_correlation,
  (SELECT CASE WHEN len < 2 OR NOT v > 0 THEN 0.0::DOUBLE ELSE round((runs - (2 * n1 * n2 / {n} + 1)) / sqrt(v), 9) END FROM (
     SELECT *, 2 * n1 * n2 * (2 * n1 * n2 - n1 - n2) / nullif((n1 + n2) * (n1 + n2) * (n1 + n2 - 1), 0) AS v FROM (
       SELECT len(list_filter(codes, lambda c: c > mean))::DOUBLE AS n1, len(list_filter(codes, lambda c: c <= mean))::DOUBLE AS n2,
              1 + len(list_filter({pairs}, lambda i: (codes[i] > mean) <> (codes[i + 1] > mean)))::DOUBLE AS runs))) AS runs_z,
  CASE WHEN len(regexp_extract_all(lower(t), '\p{{L}}')) = 0 THEN 0.0::DOUBLE ELSE round(len(regexp_extract_all(lower(t), '[aeiou]')) / len(regexp_extract_all(lower(t), '\p{{L}}')), 9) END AS vowel_ratio,
  round(len(regexp_extract_all(t, '\p{{Nd}}')) / {n}, 9) AS digit_ratio,
  CASE WHEN len < 2 THEN 0.0::DOUBLE ELSE round(len(list_filter({pairs}, lambda i: upper[i] <> upper[i + 1])) / ({n} - 1), 9) END AS case_mix,
  round((len - len(list_filter({pairs}, lambda i: chars[i] = chars[i + 1])) + len(list_filter({pairs}, lambda i: chars[i] = chars[i + 1] AND (i = 1 OR chars[i - 1] <> chars[i])))) / {n}, 9) AS run_length_ratio
FROM (
SELECT *, list_transform(list_distinct(chars), lambda c: len(list_filter(chars, lambda x: x = c))::DOUBLE) AS counts, list_sum(codes) / {n} AS mean,
  list_transform(chars, lambda c: c <> lower(c)) AS upper, list_transform(range(1, len), lambda i: t[i:i + 1]) AS grams
FROM (
SELECT *, length(t) AS len, string_split(t, '') AS chars, list_transform(string_split(t, ''), lambda c: unicode(c)::DOUBLE) AS codes
FROM (SELECT *, nullif({trim("value")}, '') AS t FROM ({source}))))))"""


def long(tables: dict[str, tuple[str, list[str]]]) -> str:
    """Return SQL for (column_name, pos, value) of columns of tables: name -> (order expression, columns)."""
    parts = [f"SELECT '{c}' AS column_name, ({order})::BIGINT AS pos, {c}::VARCHAR AS value FROM {table}" for table, (order, columns) in tables.items() for c in columns]
    return " UNION ALL ".join(parts)


def index_confidence(source: str) -> str:
    number = f"CASE WHEN {whole(trim('value'), NUMBER)} THEN try_cast(replace({trim('value')}, ',', '') AS DOUBLE) END"
    return f"""
WITH s AS ({source}), v AS (SELECT column_name, pos, {number} AS v FROM s WHERE NOT {blank("value")}),
d AS (SELECT *, v - lag(v) OVER (PARTITION BY column_name ORDER BY pos) AS step FROM v),
a AS (SELECT column_name, count(*) AS n, count(*) FILTER (WHERE v IS NULL) AS bad, count(DISTINCT v) AS u, count(*) FILTER (WHERE step > 0) AS up,
      count(*) FILTER (WHERE abs(step - 1) < 0.001::DOUBLE) AS nx, count(*) FILTER (WHERE v = floor(v)) AS w, arg_min(v, pos) AS f FROM d GROUP BY column_name),
c AS (SELECT column_name, n, CASE WHEN n <= 1 OR bad > 0 THEN 0.0::DOUBLE ELSE round(least(1.0::DOUBLE, greatest(0.0::DOUBLE,
      u / n::DOUBLE * 0.2::DOUBLE + up / (n - 1)::DOUBLE * 0.25::DOUBLE + nx / (n - 1)::DOUBLE * 0.35::DOUBLE
      + CASE WHEN f IN (0, 1) THEN 0.1::DOUBLE WHEN f < 10 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END + w / n::DOUBLE * 0.1::DOUBLE)), 9) END AS confidence FROM a)
SELECT k.column_name, coalesce(n, 0)::BIGINT AS n, coalesce(confidence, 0.0::DOUBLE) AS confidence, coalesce(confidence, 0.0::DOUBLE) >= 0.7::DOUBLE AS is_index
FROM (SELECT DISTINCT column_name FROM s) k LEFT JOIN c USING (column_name)"""


def values_types(source: str) -> str:
    """Return SQL for (column_name, n_filled, field_type) of ``source`` (column_name, value)."""
    x = trim("value")
    return f"""
SELECT column_name, count(*) FILTER (WHERE filled)::BIGINT AS n_filled, CASE WHEN count(*) FILTER (WHERE filled) = 0 THEN 'TEXT'
  WHEN count(*) FILTER (WHERE filled AND b) >= 0.8 * count(*) FILTER (WHERE filled) THEN 'BOOLEAN'
  WHEN count(*) FILTER (WHERE filled AND i) >= 0.8 * count(*) FILTER (WHERE filled) THEN CASE WHEN count(*) FILTER (WHERE filled AND i AND small IS NULL) > 0 THEN 'LONG' ELSE 'INTEGER' END
  WHEN count(*) FILTER (WHERE filled AND (i OR f)) >= 0.8 * count(*) FILTER (WHERE filled) THEN 'FLOAT' ELSE 'TEXT_WITH_KEYWORD' END AS field_type
FROM (SELECT column_name, NOT {blank("value")} AS filled, {whole(x, BOOLEAN)} AS b, {whole(x, INTEGER)} AS i, {whole(x, FLOAT)} AS f, try_cast({x} AS INTEGER) AS small FROM ({source})) GROUP BY column_name"""


def values_types_literal(source: str) -> str:
    x = trim("value")
    return f"""
SELECT column_name, CASE WHEN coalesce(bool_or(NOT {blank("value")} AND ({whole(x, BOOLEAN)} OR {whole(x, INTEGER)})), false) THEN 'BOOLEAN'
  WHEN coalesce(bool_or(NOT {blank("value")} AND {whole(x, FLOAT)}), false) THEN 'FLOAT' ELSE 'TEXT_WITH_KEYWORD' END AS field_type
FROM ({source}) GROUP BY column_name"""


def category_type(x: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.CATEGORY_TYPES.items())
    return f"CASE lower({trim(x)}) {cases} ELSE 'UNKNOWN' END"


def type_of_categories(x: str) -> str:
    known = f"list_filter(list_transform({x}, lambda c: {category_type('c')}), lambda t: t <> 'UNKNOWN')"
    order = ", ".join(f"'{t}'" for t in vocab.TYPE_PRIORITY)
    ranked = f"list_filter([{order}], lambda t: list_contains({known}, t))[1]"
    return f"CASE WHEN len({known}) = 0 THEN 'UNKNOWN' WHEN len(list_distinct({known})) = 1 THEN {known}[1] ELSE coalesce({ranked}, 'UNKNOWN') END"


_MONTH = "regexp_replace({x}, '^([0-9]+ [A-Za-z]{3})[a-z]*', '\\1')"
_ROUTE = [f"substr({{x}}, {i}, 1)::INT" for i in range(1, 10)]
_CHECKS = {
    "ssn": "NOT regexp_matches({x}, '^(?:000|666|9)') AND substr({x}, 5, 2) <> '00' AND substr({x}, 8, 4) <> '0000'",
    "credit-card": "(SELECT sum(CASE WHEN i % 2 = 0 THEN d * 2 - CASE WHEN d * 2 > 9 THEN 9 ELSE 0 END ELSE d END) % 10 = 0 FROM (SELECT unnest(list_reverse(string_split(regexp_replace({x}, '[^0-9]', '', 'g'), '')))::INT AS d, unnest(range(1, len(regexp_replace({x}, '[^0-9]', '', 'g')) + 1)) AS i))",
    "ip-address": "contains({x}, ':') OR len(list_filter(string_split({x}, '.'), lambda o: try_cast(o AS INT) > 255)) = 0",
    "date": f"CASE WHEN contains({{x}}, '-') THEN try_strptime({{x}}, '%Y-%m-%d') IS NOT NULL WHEN contains({{x}}, '/') THEN try_strptime({{x}}, '%m/%d/%Y') IS NOT NULL ELSE try_strptime({_MONTH}, '%d %b %Y') IS NOT NULL END",
    "age": "try_cast(regexp_replace({x}, '[^0-9]', '', 'g') AS INT) <= 120",
    "bank-routing-number": f"(3 * ({_ROUTE[0]} + {_ROUTE[3]} + {_ROUTE[6]}) + 7 * ({_ROUTE[1]} + {_ROUTE[4]} + {_ROUTE[7]}) + {_ROUTE[2]} + {_ROUTE[5]} + {_ROUTE[8]}) % 10 = 0",
    "iban-code": "(list_reduce(list_prepend(0, list_transform(string_split(upper(substr({x}, 5) || substr({x}, 1, 4)), ''), lambda c: CASE WHEN regexp_matches(c, '[0-9]') THEN c::INT ELSE unicode(c) - 55 END)), lambda a, c: (a * CASE WHEN c > 9 THEN 100 ELSE 10 END + c) % 97)) = 1",
    "vin": "upper(substr({x}, 9, 1)) = CASE WHEN (" + " + ".join(f"{w} * substr(translate(upper({{x}}), 'ABCDEFGHJKLMNPRSTUVWXYZ', '12345678123457923456789'), {i}, 1)::INT" for i, w in enumerate(VIN_WEIGHTS, 1)) + ") % 11 = 10 THEN 'X' ELSE ((" + " + ".join(f"{w} * substr(translate(upper({{x}}), 'ABCDEFGHJKLMNPRSTUVWXYZ', '12345678123457923456789'), {i}, 1)::INT" for i, w in enumerate(VIN_WEIGHTS, 1)) + ") % 11)::VARCHAR END",
}


def spans(source: str, key: str = "id", any_case: bool = False) -> str:
    """Return SQL for (key, type, s, e, hit) of the spans without overlaps of ``source`` (key, t)."""
    parts = []
    for rank, (kind, rule) in enumerate(RULES.items()):
        left, right = (r"\b" if b else "" for b in rule.borders)
        pattern = text(("(?i)" if any_case else "") + f"{left}(?:{rule.core}){right}")
        check = _CHECKS[kind].replace("{x}", "hit") if kind in _CHECKS else "true"
        parts.append(f"""
SELECT {key}, {rank} AS rank, '{kind}' AS type, s, s + length(hit) AS e, hit FROM (
  SELECT {key}, hits[i] AS hit, (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0))::INT AS s FROM (
    SELECT {key}, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT {key}, regexp_extract_all(t, {pattern}) AS hits, string_split_regex(t, {pattern}) AS gaps FROM src WHERE regexp_matches(t, {pattern})))) WHERE {check}""")
    return f"""
WITH src AS ({source}), found AS MATERIALIZED ({" UNION ALL ".join(parts)})
SELECT {key}, type, s, e, hit FROM found a WHERE NOT EXISTS (SELECT 1 FROM found b WHERE b.{key} = a.{key} AND b.s < a.e AND a.s < b.e
  AND (b.e - b.s > a.e - a.s OR (b.e - b.s = a.e - a.s AND (b.rank < a.rank OR (b.rank = a.rank AND b.s < a.s)))))"""
