"""Personal data: regular expressions propose spans, validators confirm them, nearby words adjust the score.

DataFrame functions only. Kinds, in order: email, ip, card, phone (the base),
then iban, confirmed by its mod-97 checksum. Every confirmed span stays;
context moves its score only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import dealt, only
from .spans import bound, counted, joined, matches, part, pieces, spans

#: A match starts at the start of its run of characters or where the last match ended, which spares a long run a try at each of its places.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
}
#: The characters of each country's IBAN.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_of(length: int, countries: str) -> str:
    """An IBAN of so many characters that ends where its run of characters does."""
    groups, rest = divmod(length - 4, 4)
    tail = rf"\x20?[A-Z0-9]{{{rest}}}" if rest else ""
    return rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{groups}}}{tail}(?![A-Z0-9])"


#: What is searched for: an IBAN has its country's length, so that a word or number behind it isn't taken with it; other proposals are as in PATTERNS.
SOUGHT = PATTERNS | {"iban": f"(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(_iban_of(n, c) for n, c in IBAN_LENGTHS.items())}|{PATTERNS['iban']})"}
BASE = ("email", "ip", "card", "phone")

#: A confirmed span's score in percent without context, and the words that raise it.
SCORES = {"email": 90, "ip": 60, "card": 80, "phone": 60, "iban": 90}
CONTEXT = {
    "email": "mail|contact|write|correo|courriel",
    "ip": "ip|address|server|host|login",
    "card": "card|visa|mastercard|credit|payment|karte|tarjeta|carte",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|konto|cuenta|compte",
}
REACH = 40
RAISE = 20


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, r"[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""
    each = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without blanks has remainder 1: its first four characters go to its end, letters count from 10."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)) == 1


def confirmed(kind: str, match: Column) -> Column:
    """Whether a proposed match is one."""
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, r"^0+(?=[0-9])", "").rlike(r"^([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.char_length(_digits(match)).between(16, 19) & luhn(_digits(match))
    if kind == "phone":
        return F.char_length(_digits(match)).between(8, 15)
    if kind == "iban":
        return mod97(F.replace(match, F.lit(" "), F.lit("")))
    return F.lit(True)


def _scored(kind: str, cut: Column, s: Column) -> Column:
    near = F.concat(part(cut, F.greatest(s["start"] - REACH, F.lit(0).cast("long")), s["start"]), F.lit(" "), part(cut, s["end"], s["end"] + REACH))
    hit = F.translate(near, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").rlike(CONTEXT[kind])
    return F.least(F.lit(100), F.lit(SCORES[kind]) + F.when(hit, RAISE).otherwise(0))


def _confirmed_spans(kind: str, pattern: str) -> Column:
    at = F.filter(spans(F.col("text"), F.col(kind), pattern), lambda s: confirmed(kind, s["match"]))
    return F.transform(at, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _with_scores(found: Column) -> Column:
    """The spans with their scores; the text is cut into pieces once, and only if it has spans."""
    score = lambda cut, s: F.coalesce(*[F.when(s["kind"] == k, _scored(k, cut, s)) for k in PATTERNS])
    each = lambda cut: F.transform(found, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score(cut, s).alias("score")))
    return bound(F.when(F.size(found) > 0, pieces(F.col("text"))).otherwise(F.expr("CAST(array() AS array<string>)")), each)


def find_pii(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, spans) for every row of docs; spans have kind, start, end, score (percent), by kind as listed, then start.

    Null texts count as empty; every text, however long, is searched whole in
    time near its length. Repeated rows and null ids come out as they come in, an empty table gives no rows, other
    columns are ignored.
    """
    rows = dealt(only(docs, "doc_id", "text").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    got = rows.select("doc_id", "text", *[matches(F.col("text"), p).alias(k) for k, p in SOUGHT.items()])
    each = [_confirmed_spans(kind, pattern) for kind, pattern in SOUGHT.items()]
    found = got.select("doc_id", "text", F.concat(*each).alias("found"))
    return found.select("doc_id", _with_scores(F.col("found")).alias("spans"))


def pii_report(docs: DataFrame) -> DataFrame:
    """find_pii with the counts and digest of the base kinds."""
    rows = find_pii(docs)
    base = F.filter("spans", lambda s: s["kind"].isin(list(BASE)))
    counts = [counted(F.col("spans"), k).alias(f"n_{k}") for k in BASE]
    return rows.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.concat_ws(",", F.transform("spans", lambda s: s["score"].cast("string"))).alias("scores"))
