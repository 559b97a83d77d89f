"""Format-preserving pseudonyms by a keyed Feistel network, in DataFrame
functions only.

Personal numbers, dates, addresses and access keys are found by one pattern,
validated (Luhn sum, IBAN remainder, octet range, calendar, issued ranges of social
security numbers), and replaced within their format:
every character keeps its class (digit, letter, hexadecimal), separators stay,
cards stay Luhn-valid, dates stay dates from 1900 to 2099 and IP addresses
addresses.  The network is a permutation of each format, keyed by SHA-256, so
equal values get equal pseudonyms in every document and different ones differ,
however they are punctuated: a number of the North American plan is one number
with its country code, with it and a plus sign, or without.  A date in month-day order
counts as one of its own format.

Each row is rewritten on its own, without a shuffle; rows in which the pattern
finds nothing pass through.

Edge cases: null text stays null, empty text empty; long texts are one pass of
the pattern; repeated rows get the same result; every other column passes
unchanged, whatever its name; values that fail their validation stay as they are; an
empty table gives no rows.  The key is part of the expressions: a deployment that logs
plans hides it with Spark's redaction settings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import bind, fresh, quoted

ROUNDS = 8
EDGE, TAIL = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
#: total length of an IBAN by country
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FO FI GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU"}
#: country calling codes of one or two digits; all others have three
CALLING = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
_H = "[0-9A-Fa-f]{1,4}"
_IP6 = "|".join([f"(?:{_H}:){{7}}{_H}", *(f"(?:{_H}:){{1,{7 - k}}}(?::{_H}){{1,{k}}}" for k in range(1, 7)), f"(?:{_H}:){{1,7}}:", f":(?::{_H}){{1,7}}"])
_EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}"
_IP = r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9A-Za-z]|\.[0-9])"
_DATE = EDGE + r"(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.](?:19|20)[0-9]{2})" + TAIL
_CARD = EDGE + r"[0-9](?:[ \-]?[0-9]){12,18}" + TAIL
#: a password, token or key: six characters at least, signs only inside
VALUE = r"[0-9A-Za-z][0-9A-Za-z_\-.+/~!$%^*#]{4,}[0-9A-Za-z]"
#: what goes before a value, in any letter case
NAME = r"(?i:pass(?:word|wd|phrase|code)|pwd|secret(?:[_\- ]?key)?|token|(?:api|access|private|auth)[_\- ]?key)[\"']?[ \t]*+(?:=>|:?=|:)[ \t]*+[\"']?"
#: pattern by kind, in the order in which they are tried; ``named`` is a name and
#: its value, ``secret`` a value alone after the two most usual names
KINDS = {
    "email": _EMAIL,
    "access_key": EDGE + r"AKIA[0-9A-Z]{16}" + TAIL,
    "named": r"(?!(?:password=|token = \")(?!" + _CARD + "|" + _DATE + "))" + NAME + "(?!" + _EMAIL + "|" + _IP + ")" + VALUE,
    "secret": r"(?:(?<=password=)|(?<=token = \"))(?!" + _IP + ")" + VALUE,
    "ip": _IP,
    "ip6": r"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]*+[0-9])(?:" + _IP6 + r")(?![0-9A-Za-z:]|\.[0-9])",
    "iban": EDGE + "(?:" + "|".join(f"(?:{'|'.join(c.split())})[0-9]{{2}}(?: ?[0-9A-Z]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + ")" + TAIL,
    "date": _DATE,
    "phone": r"(?<![0-9A-Za-z+])(?:\+?1[ .\-]?)?(?:\([0-9]{3}\)[ .\-]?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}" + TAIL,
    "world_phone": r"(?<![0-9A-Za-z+])\+[1-9](?:[ .\-/]?(?:\([0-9]{1,5}\)[ .\-/]?)?[0-9]){6,14}" + TAIL,
    "ssn": EDGE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + TAIL,
    "card": _CARD,
}
PATTERN = "|".join(KINDS.values())
#: alphabet by mask letter; characters outside it stay
ALPHABETS = {"d": "0123456789", "n": "23456789", "h": "0123456789abcdef", "l": "abcdefghijklmnopqrstuvwxyz",
             "u": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "k": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"}
#: days from 1900-01-01 to 2099-12-31 are DAYS_A * DAYS_B
DAYS_A, DAYS_B = 17, 4297
#: social security numbers: areas 001-665 and 667-899, groups 01-99, serials 0001-9999
AREAS, GROUPS, SERIALS = 898, 99, 9999


def _prf(key: str, *parts: Column) -> Column:
    """48 keyed bits."""
    joined = F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(joined, 256), 1, 12), 16, 10).cast("bigint")


def _shift(half: Column, mask: Column, other: Column, rnd: Column, key: str, tweak: Column) -> Column:
    """``half`` with every character moved within its alphabet by keyed bits of ``other``."""
    def one(i: Column) -> Column:
        c, m = F.substring(half, i, F.lit(1)), F.substring(mask, i, F.lit(1))
        alphabet = F.when(m == "", "")
        for letter, signs in ALPHABETS.items():
            alphabet = alphabet.when(m == letter, signs)
        alphabet = alphabet.otherwise("")
        at = F.instr(alphabet, c)
        moved = F.substring(alphabet, (F.pmod(at - 1 + _prf(key, tweak, rnd, i, other), F.length(alphabet)) + 1).cast("int"), F.lit(1))
        return F.when((alphabet != "") & (at > 0), moved).otherwise(c)

    # one place at a time: no sequence for an empty half
    return F.when(F.length(half) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(half)), one), "")).otherwise("")


def permute(value: Column, mask: Column, key: str, tweak: Column) -> Column:
    """Feistel permutation of ``value``; ``mask`` has an alphabet letter per
    character.  The halves swap every round, an even number of times."""
    n = F.floor(F.length(value) / 2).cast("int")
    begin = F.struct(F.substring(value, F.lit(1), n).alias("a"), F.substring(value, n + 1, F.length(value)).alias("b"),
                     F.substring(mask, F.lit(1), n).alias("ma"), F.substring(mask, n + 1, F.length(value)).alias("mb"))
    step = lambda s, r: F.struct(s["b"].alias("a"), _shift(s["a"], s["ma"], s["b"], r, key, tweak).alias("b"), s["mb"].alias("ma"), s["ma"].alias("mb"))
    return bind(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, step), lambda end: F.concat(end["a"], end["b"]))


def _move(a: Column, b: Column, size_a: Column | int, size_b: Column | int, key: str, tweak: str) -> Column:
    """Feistel permutation of the pairs (a, b) with 0 <= a < size_a, 0 <= b < size_b:
    each part is moved in turn by keyed bits of the other."""
    size = [x if isinstance(x, Column) else F.lit(x) for x in (size_a, size_b)]

    def step(x: Column, r: Column) -> Column:
        first = F.pmod(x["a"] + _prf(key, F.lit(f"{tweak}-a"), r, x["b"]), size[0]).cast("bigint")
        second = F.pmod(x["b"] + _prf(key, F.lit(f"{tweak}-b"), r, first), size[1]).cast("bigint")
        return F.struct(first.alias("a"), second.alias("b"))

    begin = F.struct(F.floor(a).cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), begin, step)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _refill(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced, in order, by ``digits``."""
    def fill(d: Column) -> Column:
        def one(i: Column) -> Column:
            c = F.substring(form, i, F.lit(1))
            return F.when(c.rlike("[0-9]"), F.substring(d, F.length(_digits(F.substring(form, F.lit(1), i))), F.lit(1))).otherwise(c)

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), one), "")

    return bind(digits, fill)


def _luhn_sum(body: Column) -> Column:
    """Luhn sum of the digits before a check digit."""
    n = F.length(body)
    term = lambda i: (lambda d: F.when((n - i) % 2 == 0, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d))(F.substring(body, i, F.lit(1)).cast("int"))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + term(i))


def _check_digit(body: Column) -> Column:
    return ((10 - _luhn_sum(body) % 10) % 10).cast("string")


def _card(s: Column, key: str) -> Column:
    d = _digits(s)
    body, first = F.substring(d, F.lit(2), F.length(d) - 2), F.substring(d, F.lit(1), F.lit(1))
    new = F.concat(first, permute(body, F.repeat(F.lit("d"), F.length(body)), key, F.concat(F.lit("card"), first)))
    valid = _check_digit(F.substring(d, F.lit(1), F.length(d) - 1)) == F.substring(d, F.length(d), F.lit(1))
    return F.when(valid, _refill(s, bind(new, lambda x: F.concat(x, _check_digit(x))))).otherwise(s)


def _phone(s: Column, key: str) -> Column:
    d = _digits(s)
    own = F.substring(d, F.length(d) - 9, F.lit(10))
    new = permute(own, F.lit("nddndddddd"), key, F.lit("phone"))
    return _refill(s, F.concat(F.substring(d, F.lit(1), F.length(d) - 10), new))


def _world_phone(s: Column, key: str) -> Column:
    """The calling code stays, and a trunk zero in brackets, which is not dialled."""
    d, trunk = _digits(s), F.when(s.contains("(0)"), "0").otherwise("")
    dialled = _digits(F.regexp_replace(s, r"\(0\)", ""))
    code = F.regexp_extract(dialled, "^(?:" + CALLING + "|[0-9]{3})", 0)
    own = F.substring(dialled, F.length(code) + 1, F.length(dialled))
    new = permute(own, F.repeat(F.lit("d"), F.length(own)), key, F.concat(F.lit("phone+"), code))
    american = (code == "1") & (F.length(own) == 10) & (trunk == "")
    return F.when(american, _phone(s, key)).when(F.length(d).between(8, 16), _refill(s, F.concat(code, trunk, new))).otherwise(s)


def _ssn(s: Column, key: str) -> Column:
    """Numbers that can have been issued, to such numbers."""
    area, group, serial = F.substring(s, 1, 3).cast("int"), F.substring(s, 5, 2).cast("int"), F.substring(s, 8, 4).cast("int")
    issued = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    a = (area - 1 - F.when(area > 666, 1).otherwise(0)) * GROUPS + group - 1
    number = lambda n, w: F.lpad(n.cast("string"), w, "0")

    def shown(x: Column) -> Column:
        of = F.floor(x["a"] / GROUPS) + 1
        return F.concat_ws("-", number(of + F.when(of > 665, 1).otherwise(0), 3), number(x["a"] % GROUPS + 1, 2), number(x["b"] + 1, 4))

    return F.when(issued, bind(_move(a, serial - 1, AREAS * GROUPS, SERIALS, key, "ssn"), shown)).otherwise(s)


def _mod97(s: Column) -> Column:
    """Remainder of digits and capital letters (A is 10, Z is 35) read as a number."""
    def step(m: Column, i: Column) -> Column:
        c = F.ascii(F.substring(s, i, F.lit(1)))
        return F.when(c < 58, m * 10 + c - 48).otherwise(m * 100 + c - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), step)


def _iban(s: Column, key: str) -> Column:
    """Country and blanks stay, the account is permuted, the check digits follow."""
    def fill(c: Column) -> Column:
        def one(i: Column) -> Column:
            at = F.length(F.replace(F.substring(s, F.lit(1), i), F.lit(" "), F.lit("")))
            return F.when(F.substring(s, i, F.lit(1)) == " ", " ").otherwise(F.substring(c, at, F.lit(1)))

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(s)), one), "")

    plain = F.replace(s, F.lit(" "), F.lit(""))
    country, own = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
    new = permute(own, _mask_by_class(own), key, F.concat(F.lit("iban"), country))
    whole = bind(new, lambda x: F.concat(country, F.lpad((98 - _mod97(F.concat(x, country, F.lit("00")))).cast("string"), 2, "0"), x))
    return F.when(_mod97(F.concat(own, F.substring(plain, 1, 4))) == 1, bind(whole, fill)).otherwise(s)


def _ip6(s: Column, key: str) -> Column:
    """All eight groups, however the address was shortened."""
    part = lambda i: F.filter(F.split(F.coalesce(F.get(F.split(s, "::"), F.lit(i)), F.lit("")), ":"), lambda g: g != "")
    left, right = part(0), part(1)
    groups = F.concat(left, F.array_repeat(F.lit("0"), F.lit(8) - F.size(left) - F.size(right)), right)
    hexed = F.array_join(F.transform(groups, lambda g: F.lower(F.lpad(g, 4, "0"))), "")
    spread = lambda x: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(29), F.lit(4)), lambda i: F.substring(x, i, F.lit(4))), ":")
    return bind(permute(hexed, F.lit("h" * 32), key, F.lit("ip6")), spread)


def _ip(s: Column, key: str) -> Column:
    hexed = F.array_join(F.transform(F.split(s, r"\."), lambda o: F.lower(F.lpad(F.hex(o.cast("bigint")), 2, "0"))), "")
    octets = lambda x: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(7), F.lit(2)), lambda i: F.conv(F.substring(x, i, F.lit(2)), 16, 10)), ".")
    return bind(permute(hexed, F.lit("hhhhhhhh"), key, F.lit("ip")), octets)


def _date(s: Column, key: str) -> Column:
    """Year first, or day first, or month first where day first is no date.  The day of
    a month-first date is over 12 and stays so: its month moves among those of its
    length, its day from 13 to the month's end."""
    iso, sep = s.contains("-"), F.substring(s, F.lit(3), F.lit(1))
    cut = lambda *at: F.try_to_timestamp(F.concat_ws("-", *[F.substring(s, *map(F.lit, x)) for x in at]), F.lit("yyyy-MM-dd")).cast("date")
    first = F.lit("1900-01-01").cast("date")

    def moved(d: Column) -> Column:
        n = F.datediff(d, first)
        to = bind(_move(n / DAYS_B, n % DAYS_B, DAYS_A, DAYS_B, key, "date"), lambda x: F.date_add(first, (x["a"] * DAYS_B + x["b"]).cast("int")))
        return bind(to, lambda x: F.when(iso, F.date_format(x, "yyyy-MM-dd")).otherwise(F.concat(F.date_format(x, "dd"), sep, F.date_format(x, "MM"), sep, F.date_format(x, "yyyy"))))

    day = F.when(iso, cut((1, 4), (6, 2), (9, 2))).otherwise(cut((7, 4), (4, 2), (1, 2)))
    late = F.when(~iso, cut((7, 4), (1, 2), (4, 2)))
    return bind(F.struct(day.alias("day"), late.alias("late")),
                lambda x: F.when(x["day"].isNotNull(), moved(x["day"])).when(x["late"].isNotNull(), _late_date(x["late"], sep, key)).otherwise(s))


LONG_MONTHS, SHORT_MONTHS = (1, 3, 5, 7, 8, 10, 12), (4, 6, 9, 11)


def _late_date(d: Column, sep: Column, key: str) -> Column:
    """A date whose day is over 12, month first, among months of the same length."""
    y, m, length = F.year(d), F.month(d), F.dayofmonth(F.last_day(d))
    place = lambda months: F.array_position(F.array(*map(F.lit, months)), m) - 1
    leaps = F.floor((y - 1901) / 4)  # leap years from 1904 before this year
    index = F.when(length == 31, (y - 1900) * 7 + place(LONG_MONTHS)).when(length == 30, (y - 1900) * 4 + place(SHORT_MONTHS)) \
        .when(length == 29, (y - 1904) / 4).otherwise(y - 1900 - F.greatest(leaps, F.lit(0)))
    months = F.when(length == 31, 1400).when(length == 30, 800).when(length == 29, 49).otherwise(151)
    tweak = "late"

    def shown(x: Column) -> Column:
        i = x["a"]
        of = lambda names: F.element_at(F.array(*map(F.lit, names)), (i % len(names) + 1).cast("int"))
        month = F.when(length == 31, of(LONG_MONTHS)).when(length == 30, of(SHORT_MONTHS)).otherwise(2)
        year = F.when(length == 31, 1900 + F.floor(i / 7)).when(length == 30, 1900 + F.floor(i / 4)).when(length == 29, 1904 + 4 * i) \
            .otherwise(F.when(i == 0, 1900).otherwise(1900 + i + F.floor((i - 1) / 3)))
        two = lambda n: F.lpad(n.cast("string"), 2, "0")
        return F.concat(two(month), sep, two(x["b"] + 13), sep, year.cast("string"))

    # the length is part of the domain, so each has a permutation of its own
    return bind(_move(index, F.dayofmonth(d) - 13, months, length - 12, key, tweak), shown)


def _mask_by_class(s: Column) -> Column:
    return F.translate(s, ALPHABETS["d"] + ALPHABETS["l"] + ALPHABETS["u"], "d" * 10 + "l" * 26 + "u" * 26)


def _email(s: Column, key: str) -> Column:
    own = F.substring_index(s, "@", 1)
    return F.concat(permute(own, _mask_by_class(own), key, F.lit("email")), F.substring(s, F.length(own) + 1, F.length(s)))


def _secret(s: Column, key: str) -> Column:
    mask = F.when(s.rlike("^[0-9a-f]+$"), F.repeat(F.lit("h"), F.length(s))).otherwise(_mask_by_class(s))
    return permute(s, mask, key, F.lit("secret"))


def pseudonym(s: Column, key: str) -> Column:
    """The pseudonym of one found value, without a name."""
    whole = lambda kind: s.rlike("^(?:" + KINDS[kind] + ")$")
    return F.when(s.contains("@"), _email(s, key)) \
        .when(whole("access_key"), F.concat(F.lit("AKIA"), permute(F.substring(s, F.lit(5), F.lit(16)), F.lit("k" * 16), key, F.lit("access")))) \
        .when(whole("ip"), _ip(s, key)).when(whole("ip6"), _ip6(s, key)).when(whole("iban"), _iban(s, key)) \
        .when(whole("date"), _date(s, key)).when(whole("phone"), _phone(s, key)).when(whole("world_phone"), _world_phone(s, key)) \
        .when(whole("ssn"), _ssn(s, key)) \
        .when(whole("card"), _card(s, key)).otherwise(_secret(s, key))


def pseudonymise(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with the values in ``text`` replaced; ``count`` names a column for
    the number of values changed (null text: 0)."""
    t = quoted(text)
    values, names, bare, own, secret, new, done = fresh(docs, "_found", "_name", "_value", "_own", "_secret", "_new", "_text")
    found = docs.withColumn(values, F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0)))
    # a name before a value stays; what is no valid value of another kind is a secret there
    named = "^(?:" + KINDS["named"] + ")$"
    found = found.withColumn(names, F.transform(values, lambda s: F.when(s.rlike(named), F.regexp_extract(s, "^" + NAME, 0)).otherwise("")))
    found = found.withColumn(bare, F.zip_with(values, names, lambda s, n: F.substring(s, F.length(n) + 1, F.length(s))))
    changed = found.withColumn(own, F.transform(bare, lambda v: pseudonym(v, key)))
    again = F.zip_with(bare, own, lambda v, x: F.when(x == v, v))
    changed = changed.withColumn(secret, F.zip_with(names, again, lambda n, v: F.when((n != "") & v.isNotNull(), _secret(v, key))))
    changed = changed.withColumn(own, F.zip_with(secret, own, lambda v, x: F.coalesce(v, x)))
    changed = changed.withColumn(new, F.zip_with(names, own, lambda n, x: F.concat(n, x)))
    parts = F.split(t, PATTERN, -1)
    woven = F.array_join(F.zip_with(parts, F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    out = changed.withColumn(done, F.when(F.size(values) > 0, woven).otherwise(t))
    if count:
        differ = F.size(F.filter(F.zip_with(values, new, lambda a, b: a != b), lambda x: x))
        out = out.withColumn(count, F.when(F.col(values).isNotNull(), differ).otherwise(0).cast("bigint"))
    return out.withColumn(text, F.col(done)).drop(values, names, bare, own, secret, new, done)
