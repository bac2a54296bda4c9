"""Format-preserving pseudonyms for personal data, in column expressions only.

Values are found by one pattern, validated, and replaced by a keyed permutation within their
format, so that equal values stay equal in all documents, different ones stay different, and the text
keeps its shape. Kinds:

  card    13 to 19 digits, bare or in printed groups, with a right Luhn digit; the digits
          before the last are permuted, the last is computed anew
  ip      dotted IPv4 with octets to 255; permuted as a 32-bit number
  date    year-month-day or day.month.year (also with /) from 1900 to 2099; permuted as a day number
  ssn     area-group-serial with valid ranges; permuted among the valid ones
  phone   international or printed North American numbers; the digits after the country code, which stays
  email   characters before the last two labels of the domain, within digits and letters, as if in small letters
  secret  16 to 64 hex digits assigned to a token, secret, password or key

Digits are permuted as a value, without the blanks, dashes and brackets between them, and then laid over these: so a
card or a phone number keeps its pseudonym in every printed form, with and without its country code, and an address in every case.

What has the form but fails validation stays as it is. Nothing is looked up or joined, so
there is neither a shuffle nor a table of originals.

Defined cases: null stays null; an empty text stays empty; values repeated in a text are each
replaced; a value in the middle of a longer digit run is none; other columns are kept, whatever their names.
IPv4 octets and unpadded days and months keep their range, not their number of digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import feistel
from quire.llm.common import LOWER, UPPER, fresh

#: The default key of the pseudonyms; give your own to keep them from being undone.
KEY = "quire"
DIGITS = "0123456789"
KINDS = ("card", "ip", "date", "ssn", "phone", "email", "secret")

# The forms, as Java patterns. Every run is bounded, so no text takes quadratic time.
_EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9\-]{0,62}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
_SECRET = r"(?<=(?:token|secret|password|passwd|api_key|api-key|apikey)\s{0,3}[=:]\s{0,3}[\"']{0,1})[0-9a-fA-F]{16,64}(?![0-9a-zA-Z])"
_PHONE = (
    r"(?<![\d+])\+\d{1,3}[ .\-]?\(?\d{2,4}\)?[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\d)"
    r"|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d\-])\d{3}-\d{3}-\d{4}(?![\d\-])"
)
_IP = r"(?<!\d)(?<!\d\.)\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)"
_DATE = r"(?<![\d\-])\d{4}-\d{2}-\d{2}(?![\d\-])|(?<!\d)(?<!\d[./])\d{1,2}\.\d{1,2}\.\d{4}(?!\d)|(?<!\d)(?<!\d[./])\d{1,2}/\d{1,2}/\d{4}(?!\d)"
_SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
_CARD = r"(?<!\d)(?:\d{4}([ \-])\d{4}\1\d{4}\1\d{1,7}|\d{4}[ \-]\d{6}[ \-]\d{5}|\d{13,19})(?!\d)"
PATTERN = "|".join((_CARD, _EMAIL, _SECRET, _PHONE, _IP, _DATE, _SSN))

# Country codes of one and of two digits; all others have three.
ONE_DIGIT = "^[17]"
TWO_DIGITS = "^(?:20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|53|54|55|56|57|58|60|61|62|63|64|65|66|81|82|84|86|90|91|92|93|94|95|98)"

FIRST_DAY, DAYS = "1900-01-01", 73049  # to 2099-12-31
_SSN_AREAS, _SSN_GROUPS, _SSN_SERIALS = 898, 99, 9999


def _luhn(digits: Column, first: int) -> Column:
    """The Luhn sum; first 1: the last digit counts once, 0: the last digit is doubled."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(c.cast("int").alias("v"), i.alias("i")))

    def value(x: Column) -> Column:
        double = x.v * 2
        return F.when((x.i + first) % 2 == 1, x.v).otherwise(F.when(double > 9, double - 9).otherwise(double))

    return F.aggregate(places, F.lit(0), lambda s, x: s + value(x))


def _bound(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _laid(digits: Column, form: Column) -> Column:
    """The digits in the places of the digits of a form, whose other characters stay."""
    return _bound(digits, lambda d: F.array_join(F.transform(F.split(form, ""), lambda c, i: F.when(
        c.between("0", "9"), F.substr(d, F.length(F.regexp_replace(F.substr(form, F.lit(1), i + 1), r"\D", "")), F.lit(1))).otherwise(c)), ""))


def _card(m: Column, key: str) -> Column:
    bare = F.regexp_replace(m, r"\D", "")

    def filled(body: Column) -> Column:
        return F.concat(body, ((F.lit(10) - _luhn(body, 0) % 10) % 10).cast("string"))

    body = feistel.permute_text(F.substr(bare, F.lit(1), F.length(bare) - 1), key + "card", (DIGITS,))
    return F.when(_luhn(bare, 1) % 10 == 0, _laid(_bound(body, filled), m))


def _ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda c: c.cast("long"))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda s, o: s * 256 + o)
    new = feistel.permute(number, 1 << 32, key + "ip")
    parts = F.transform(F.array(*[F.lit(k) for k in (24, 16, 8, 0)]), lambda k: (F.call_function("div", new, F.pow(F.lit(2), k).cast("long")) % 256).cast("string"))
    return F.when(F.array_max(octets) < 256, F.array_join(parts, "."))


def _date(m: Column, key: str) -> Column:
    iso = m.contains("-")
    mark = F.when(m.contains("."), F.lit(".")).otherwise(F.lit("/"))
    parts = F.split(m, r"[./\-]")
    text = F.when(iso, m).otherwise(F.concat_ws("-", parts[2], F.lpad(parts[1], 2, "0"), F.lpad(parts[0], 2, "0")))
    number = F.datediff(F.try_to_date(text, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date")).cast("long")
    inside = F.when((number >= 0) & (number < DAYS), number)
    new = F.date_add(F.lit(FIRST_DAY).cast("date"), feistel.permute(inside, DAYS, key + "date").cast("int"))

    def filled(value: Column, like: Column) -> Column:
        return F.when((F.length(like) == 2) & (value < 10), F.concat(F.lit("0"), value.cast("string"))).otherwise(value.cast("string"))

    spoken = F.concat(filled(F.dayofmonth(new), parts[0]), mark, filled(F.month(new), parts[1]), mark, F.date_format(new, "yyyy"))
    return F.when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(spoken)


def _ssn(m: Column, key: str) -> Column:
    p = F.transform(F.split(m, "-"), lambda c: c.cast("long"))
    valid = (p[0] >= 1) & (p[0] <= 899) & (p[0] != 666) & (p[1] >= 1) & (p[2] >= 1)
    area = p[0] - F.when(p[0] > 666, 2).otherwise(1)
    n = _SSN_AREAS * _SSN_GROUPS * _SSN_SERIALS
    new = feistel.permute(F.when(valid, (area * _SSN_GROUPS + p[1] - 1) * _SSN_SERIALS + p[2] - 1), n, key + "ssn")
    rest = F.call_function("div", new, F.lit(_SSN_SERIALS).cast("long"))
    place = F.call_function("div", rest, F.lit(_SSN_GROUPS).cast("long"))
    shown = place + F.when(place + 1 >= 666, 2).otherwise(1)
    return F.concat(
        F.lpad(shown.cast("string"), 3, "0"), F.lit("-"), F.lpad((rest % _SSN_GROUPS + 1).cast("string"), 2, "0"), F.lit("-"),
        F.lpad((new % _SSN_SERIALS + 1).cast("string"), 4, "0"),
    )


def _phone(m: Column, key: str) -> Column:
    bare = F.regexp_replace(m, r"\D", "")
    code = F.when(~m.startswith("+"), 0).when(bare.rlike(ONE_DIGIT), 1).when(bare.rlike(TWO_DIGITS), 2).otherwise(3)
    new = F.concat(F.substr(bare, F.lit(1), code), feistel.permute_text(F.substr(bare, code + 1), key + "phone", (DIGITS,)))
    return _laid(new, m)


def _email(m: Column, key: str) -> Column:
    tail = F.regexp_extract(m, r"[@.][^@.]+\.[^@.]+$", 0)
    head = F.substr(m, F.lit(1), F.length(m) - F.length(tail))
    new = feistel.permute_text(F.translate(head, UPPER, LOWER), key + "email", (DIGITS, LOWER))
    cased = _bound(new, lambda n: F.array_join(F.transform(F.split(head, ""), lambda c, i: F.when(
        c.between("A", "Z"), F.upper(F.substr(n, i + 1, F.lit(1)))).otherwise(F.substr(n, i + 1, F.lit(1)))), ""))
    return F.concat(cased, tail)


def _secret(m: Column, key: str) -> Column:
    return feistel.permute_text(m, key + "secret", ("0123456789abcdef", "ABCDEF"))


def pseudonym(m: Column, key: str = KEY) -> Column:
    """struct(kind, new) of one found string; kind is null and new the string itself if it isn't valid."""
    forms = (
        ("email", m.contains("@"), _email),
        ("ip", m.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), _ip),
        ("date", m.rlike(r"^(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})$"), _date),
        ("ssn", m.rlike(r"^\d{3}-\d{2}-\d{4}$"), _ssn),
        ("card", m.rlike(r"^\d[\d \-]{12,22}$") & ~m.rlike(r"^\d{3}-\d{3}-\d{4}$"), _card),
        ("phone", m.rlike(r"[(+\-]"), _phone),
        ("secret", m.rlike(r"^[0-9a-fA-F]+$"), _secret),
    )
    kind, new = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), m)
    for name, fits, make in forms:
        kind = kind.when(fits, F.lit(name))
        new = new.when(fits, make(m, key))
    return F.transform(
        F.array(F.struct(kind.alias("kind"), new.alias("new"))),
        lambda x: F.struct(F.when(x.new.isNotNull(), x.kind).alias("kind"), F.coalesce(x.new, m).alias("new")),
    )[0]


def pseudonymize(df: DataFrame, text: str = "text", key: str = KEY, kinds: str | None = None) -> DataFrame:
    """Replace the text column; with kinds, add an array column of that name with the kind of each value."""
    t = F.col(f"`{text}`")
    found = F.when(t.rlike("[0-9@]|[A-Fa-f]{16}"), F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0)))
    own = fresh(df.columns, "_new")
    listed = df.withColumn(own, F.transform(found, lambda m: pseudonym(m, key)))
    changed = F.exists(own, lambda x: x.kind.isNotNull())
    gaps = F.split(t, PATTERN, -1)
    joined = F.array_join(
        F.zip_with(gaps, F.col(own), lambda g, x: F.concat(g, F.coalesce(x.new, F.lit("")))), ""
    )
    columns = [F.when(changed, joined).otherwise(t).alias(text) if c == text else F.col(f"`{c}`") for c in df.columns if c != kinds]
    if kinds:
        named = F.filter(F.transform(own, lambda x: x.kind), lambda k: k.isNotNull())
        columns.append(F.coalesce(named, F.array().cast("array<string>")).alias(kinds))
    return listed.select(*columns)
