"""Personal data in text: a pattern for each kind, checks of its matches, and spans without overlaps.

The rules are this library's own, made from public formats.  Every pattern has
a core that both Java and RE2 read alike, with ASCII word borders around it.
Of spans that overlap, one goes if the other is longer, or as long and of a
kind further up in ``RULES``.  Names of people, cities, counties and hospitals
come from a dictionary, see ``colsense.operators.pii``.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from colsense.functions import vocab
from colsense.functions.text import bordered

SPAN = "array<struct<type:string,start:int,end:int,text:string>>"


@dataclass(frozen=True)
class Rule:
    core: str
    check: Callable[[Column], Column] | None = None
    borders: tuple[bool, bool] = (True, True)

    def pattern(self, any_case: bool) -> str:
        body = bordered(self.core, self.borders[1]) if self.borders[0] else f"(?:{self.core})"
        return ("(?i)" if any_case else "") + body


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def ssn_ok(x: Column) -> Column:
    return ~x.rlike(r"\A(?:000|666|9)") & (F.substring(x, 5, 2) != "00") & (F.substring(x, 8, 4) != "0000")


def card_ok(x: Column) -> Column:
    return F.call_function("luhn_check", _digits(x))


def ip_ok(x: Column) -> Column:
    return x.contains(":") | F.forall(F.split(x, r"\."), lambda o: o.try_cast("int") <= 255)


def date_ok(x: Column) -> Column:
    short = F.initcap(F.regexp_replace(x, r"\A([0-9]+ [A-Za-z]{3})[a-z]*", "$1"))
    return F.when(x.contains("-"), F.try_to_timestamp(x, F.lit("yyyy-MM-dd")).isNotNull()).when(x.contains("/"), F.try_to_timestamp(x, F.lit("M/d/yyyy")).isNotNull()).otherwise(F.try_to_timestamp(short, F.lit("d MMM yyyy")).isNotNull())


def age_ok(x: Column) -> Column:
    return _digits(x).try_cast("int") <= 120


def routing_ok(x: Column) -> Column:
    d = [F.substring(x, i, 1).try_cast("int") for i in range(1, 10)]
    return (3 * (d[0] + d[3] + d[6]) + 7 * (d[1] + d[4] + d[7]) + d[2] + d[5] + d[8]) % 10 == 0


def iban_ok(x: Column) -> Column:
    turned = F.upper(F.concat(F.substring(x, 5, 40), F.substring(x, 1, 4)))
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


VIN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)


def vin_ok(x: Column) -> Column:
    numbers = F.translate(F.upper(x), "ABCDEFGHJKLMNPRSTUVWXYZ", "12345678123457923456789")
    total = F.lit(0)
    for i, w in enumerate(VIN_WEIGHTS, 1):
        total = total + w * F.substring(numbers, i, 1).try_cast("int")
    rest = total % 11
    return F.upper(F.substring(x, 9, 1)) == F.when(rest == 10, "X").otherwise(rest.cast("string"))


_MONTHS = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"

RULES: dict[str, Rule] = {
    "email-address": Rule(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    "url": Rule(r"""(?:https?://|www\.)[^\x00-\x20"'<>]+""", borders=(True, False)),
    "iban-code": Rule(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", iban_ok),
    "vin": Rule(r"[A-HJ-NPR-Z0-9]{17}", vin_ok),
    "credit-card": Rule(r"[0-9](?:[ -]?[0-9]){12,15}", card_ok),
    "mac-address": Rule(r"(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}"),
    "ip-address": Rule(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}", ip_ok),
    "ssn": Rule(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", ssn_ok),
    "phone-number": Rule(r"(?:1[ .-]?\(?)?[0-9]{3}(?:\) ?|[ .-])[0-9]{3,4}[ .-][0-9]{4}"),
    "date": Rule(rf"[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}|[0-9]{{1,2}} (?:{_MONTHS}) [0-9]{{4}}", date_ok),
    "bitcoin-address": Rule("[13][a-km-zA-HJ-NP-Z1-9]{25,34}|bc1p[a-z0-9]{58}|bc1[a-z0-9]{39,59}"),
    "tracking-number": Rule("1Z[A-Z0-9]{16}|[0-9]{20,22}|[Ff]ed[Ee]x(?: [Tt]racking)?[.:#]? ?[0-9]{12}(?:[0-9]{3})?"),
    "bank-routing-number": Rule("[0-9]{9}", routing_ok),
    "drivers-license": Rule(r"(?:DL|[Dd]river'?s [Ll]icen[cs]e)(?: [Nn]o| [Nn]umber)?[.:#]? ?[A-Z]{0,3}[0-9]{4,12}"),
    "passport-number": Rule(r"[Pp]assport(?: [Nn]o| [Nn]umber)?[.:#]? ?[A-Z]{0,2}[0-9]{6,9}|[A-Z][0-9]{8}"),
    "street-address": Rule(r"[0-9]{1,6}(?: [A-Za-z0-9.]+){1,4} (?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Place|Pl|Square|Sq|Highway|Hwy)"),
    "physician-name": Rule(r"(?:Dr\.?|Doctor) [A-Z][a-z]+(?: [A-Z][a-z]+)?|[A-Z][a-z]+ [A-Z][a-z]+,? MD"),
    "currency": Rule(r"\$ ?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]{1,2})?", borders=(False, False)),
    "age": Rule("[0-9]{1,3}[ -](?:years?|yrs?)[ -]old|[0-9]{1,3} ?y/?o|[Aa]ged? [0-9]{1,3}", age_ok),
    "phone-number-extension": Rule(r"(?:x|ext\.?|extension) ?[0-9]{1,6}"),
    "zip-code": Rule("[0-9]{5}(?:-[0-9]{4})?"),
    "state": Rule("|".join(sorted(vocab.STATES.values(), key=lambda s: (-len(s), s)))),
    "state-abbreviation": Rule("|".join(vocab.STATES)),
}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Return ``use`` of ``value``, which is worked out once, not anew in each lambda that reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _chunks(items: Column) -> Column:
    """Cut a list into about as many parts as each has items, so that work on parts grows with n to the 1.5, not the square."""
    size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(items).cast("double"))).cast("int"))
    return _let(size, lambda c: F.transform(F.sequence(F.lit(0), F.ceil(F.size(items) / c).cast("int") - 1), lambda i: F.slice(items, i * c + 1, c)))


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0), lambda a, x: a + x["g"] + F.char_length(x["hit"]))


def _placed(found: Column, gaps: Column, kind: str) -> Column:
    """Return the spans of the matches ``found``, whose places follow from the texts between them."""
    pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda h, g: F.struct(h.alias("hit"), F.char_length(g).alias("g")))

    def spans(chunks: Column) -> Column:
        sums = F.transform(chunks, _sum)
        return _let(sums, lambda own: F.flatten(F.transform(chunks, lambda chunk, i: _let(F.aggregate(F.slice(own, F.lit(1), i), F.lit(0), lambda a, x: a + x), lambda base: F.transform(chunk, lambda x, j: _let(base + _sum(F.slice(chunk, F.lit(1), j)) + x["g"], lambda start: F.struct(F.lit(kind).alias("type"), start.alias("start"), (start + F.char_length(x["hit"])).alias("end"), x["hit"].alias("text"))))))))

    return _let(pairs, lambda bound: _let(_chunks(bound), spans))


def matches(text: Column, kind: str, any_case: bool = False) -> Column:
    """Return the spans of one kind in ``text`` whose check holds, in order."""
    rule = RULES[kind]
    pattern = rule.pattern(any_case)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)  # what stands between the matches gives their places
    spans = _placed(found, gaps, kind)
    if rule.check is not None:
        spans = F.filter(spans, lambda s: F.coalesce(rule.check(s["text"]), F.lit(False)))
    return F.when(text.rlike(pattern), spans.cast(SPAN)).otherwise(F.array().cast(SPAN))


#: Kinds whose every match has a digit, and those with a mark of their own: texts without it aren't searched for them.
_MARKS = {"email-address": "@", "currency": r"\$", "mac-address": "[:-]", "ip-address": "[.:]"} | dict.fromkeys(
    ("credit-card", "ssn", "phone-number", "date", "tracking-number", "bank-routing-number", "drivers-license", "passport-number", "street-address", "age", "phone-number-extension", "zip-code", "iban-code", "bitcoin-address"), "[0-9]",
)


def all_spans(text: Column, any_case: bool = False, kinds: list[str] | None = None) -> Column:
    """Return the spans of every kind in ``text``, overlaps included; none for null or blank."""
    none = F.array().cast(SPAN)
    parts = []
    for mark, own in itertools.groupby(kinds or RULES, _MARKS.get):
        spans = F.concat(*[matches(text, k, any_case) for k in own])
        parts.append(spans if mark is None else F.when(text.rlike(mark), spans).otherwise(none))
    return F.when(text.isNull(), none).otherwise(F.concat(*parts))


def without_overlaps(spans: Column) -> Column:
    """Drop each span that overlaps a better one: longer, or as long and of an earlier kind, or as long and further left.

    Spans are sorted and cut into parts, and only parts that reach a span are looked at for it.
    """
    order = F.create_map(*[F.lit(x) for i, k in enumerate(RULES) for x in (k, i)])
    rank = lambda s: F.try_element_at(order, s["type"])
    items = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), rank(s).alias("rank"))))
    def better(t: Column, s: Column, rank_s: Column) -> Column:
        long_t, long_s = t["end"] - t["start"], s["end"] - s["start"]
        return (t["start"] < s["end"]) & (s["start"] < t["end"]) & ((long_t > long_s) | ((long_t == long_s) & ((t["rank"] < rank_s) | ((t["rank"] == rank_s) & (t["start"] < s["start"])))))

    def kept(parts: Column) -> Column:
        return F.filter(spans, lambda s: ~F.exists(parts, lambda p: (p["low"] < s["end"]) & (s["start"] < p["high"]) & F.exists(p["items"], lambda t: better(t, s, rank(s)))))

    def reach(c: Column) -> Column:
        return F.struct(F.element_at(c, 1)["start"].alias("low"), F.array_max(F.transform(c, lambda t: t["end"])).alias("high"), c.alias("items"))

    return F.when(F.size(spans) > 1, _let(items, lambda i: _let(F.transform(_chunks(i), reach), kept))).otherwise(spans)
