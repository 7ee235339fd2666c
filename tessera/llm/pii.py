"""Format-preserving pseudonyms by keyed Feistel permutations, in DataFrame expressions only.

A value is found by its format, validated (check digits, calendar, ranges), permuted within the values of that format, and written back in its own layout, so a
card stays a valid card, a date a date of the same style, and equal values get equal pseudonyms in every document. The permutation of a numbered domain
of a * b values is a Feistel network over (l, r), 0 <= l < a, 0 <= r < b, whose rounds add a keyed SHA-256 of one half to the other, modulo a or b; no value needs to be walked
again. Texts such as addresses and secrets are permuted likewise, half a string against the other, each character within its own class.

| kind | format | what is permuted |
|-|-|-|
| card | 13 to 19 digits, plain or grouped, Luhn | all digits but the check digit, which is made anew |
| phone | North American number | area and exchange codes (each from 200 on) and the line |
| intl | ``+`` and 8 to 15 digits | all digits after the country code's |
| ssn | ddd-dd-dddd with an assigned area | area, group and serial |
| iban | mod-97 | the digits and letters after the check digits, which are made anew |
| ip | IPv4 | all 32 bits |
| date | y-m-d, y/m/d, d.m.y, d/m/y from 1900 to 2099 | the day's number |
| email | local part and domain | letters and digits of each; the last label stays |
| secret | AKIA keys, ``password=`` and the like, 40 hexadecimal digits | letters and digits |

Values that look alike but aren't valid stay as they are. The key must be given; whoever has it can invert the permutation, so keep it as you keep the texts (it is part of the query's plan).

Defined results: a null text stays null and an empty text empty, with nothing found; very long texts are processed whole; rows that repeat are treated alike; an empty table
gives no rows; other columns pass through, except those named as a result (``n_found``, ``kinds``), which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import unused

ROUNDS = 10
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)  # 17 * 4297 days end on 2099-12-31

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_LOCAL = r"[A-Za-z0-9._%+\-]"
#: In the order in which they are tried at a place. E-mails and secrets have no greatest length, so a value is always replaced whole.
PATTERNS = {
    "email": _LOCAL + r"+@(?:[A-Za-z0-9.\-](?<![@.]\.))+(?<=\.)[A-Za-z]{2,}",
    "secret": r"AKIA[A-Z0-9]{16}(?![A-Z0-9])|(?i:password|passwd|pwd|secret|token|api_key)=[^\s\"'<>]{4,}+|(?<![0-9A-Za-z])[0-9a-f]{40}(?![0-9A-Za-z])",
    "phone": r"(?:\+1[ .\-]?)?(?:\([2-9][0-9]{2}\) ?|(?<![0-9])[2-9][0-9]{2}[ .\-])[2-9][0-9]{2}[ .\-][0-9]{4}(?![0-9])",
    "intl": r"\+[1-9][0-9]{0,2}[ .\-]?\(?[0-9]{1,4}\)?(?:[ .\-]?[0-9]{2,4}){1,4}(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9])(?!\.[0-9])",
    "date": r"(?<![0-9/.\-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9])(?![/.\-][0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ \-][0-9]{4}[ \-][0-9]{4}[ \-][0-9]{4}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5}|[0-9]{13,19})(?![0-9])",
}
#: All of them. An e-mail's match begins where a run of local characters does or the match before it ended, so only these places are tried, and long runs take linear time.
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values()).replace(f"(?:{_LOCAL}+@", rf"(?:(?:(?<!{_LOCAL})|\G){_LOCAL}++@", 1)
#: Every match of a pattern has one of these; a text without any is passed on untouched.
_HAS = r"[0-9@=]|AKIA|[a-f]{40}"


def _prf(key: str, domain: Column | str, i: Column, x: Column) -> Column:
    """60 pseudo-random bits."""
    domain = F.lit(domain) if isinstance(domain, str) else domain
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), domain, i.cast("string"), x.cast("string")).cast("binary"), 256), 1, 15), 16, 10).cast("long")


def permuted(key: str, domain: Column | str, left: Column, right: Column, a: Column | int, b: Column | int) -> Column:
    """struct(l, r): the image of (left, right) in the permutation of [0, a) x [0, b)."""
    a, b = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (a, b))

    def step(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        lefts = F.when(odd, F.pmod(s["l"] + F.pmod(_prf(key, domain, i, s["r"]), a), a)).otherwise(s["l"])
        rights = F.when(odd, s["r"]).otherwise(F.pmod(s["r"] + F.pmod(_prf(key, domain, i, s["l"]), b), b))
        return F.struct(lefts.alias("l"), rights.alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _characters(s: Column) -> Column:
    return F.when(F.length(s) > 0, F.split(s, "")).otherwise(F.array().cast("array<string>"))


def _turned(c: Column, v: Column, hexadecimal: Column) -> Column:
    """A character moved by v places within its class."""
    code = F.ascii(c)
    within = lambda first, n: F.char((F.lit(first) + F.pmod(code - first + v, F.lit(n))).cast("long"))
    digits = F.lit("0123456789abcdef")
    return (
        F.when(hexadecimal, F.substring(digits, (F.pmod(F.position(c, digits) - 1 + v, F.lit(16)) + 1).cast("int"), F.lit(1)))
        .when(c.between("0", "9") & (F.length(c) == 1), within(48, 10))
        .when(c.between("a", "z") & (code < 123), within(97, 26))
        .when(c.between("A", "Z") & (code < 91), within(65, 26))
        .otherwise(c)
    )


def permuted_text(key: str, domain: str, s: Column, hexadecimal: Column | bool = False) -> Column:
    """A string's image among the strings of its layout: each character stays in its class."""
    hexadecimal = F.lit(hexadecimal) if isinstance(hexadecimal, bool) else hexadecimal
    half = F.floor(F.length(s) / 2).cast("int")

    def moved(x: Column, other: Column, i: Column) -> Column:
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(domain), i.cast("string"), other).cast("binary"), 512)
        byte = lambda t, j: F.conv(F.substring(t, (F.pmod(j, F.lit(64)) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
        return F.transform(F.array(stream), lambda t: F.array_join(F.transform(_characters(x), lambda c, j: _turned(c, byte(t, j), hexadecimal)), ""))[0]

    def step(t: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(F.when(odd, moved(t["l"], t["r"], i)).otherwise(t["l"]).alias("l"), F.when(odd, t["r"]).otherwise(moved(t["r"], t["l"], i)).alias("r"))

    start = F.struct(F.substring(s, F.lit(1), half).alias("l"), F.substring(s, half + 1, F.length(s)).alias("r"))
    out = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    return F.concat(out["l"], out["r"])


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _refilled(layout: Column, digits: Column) -> Column:
    """The layout with its digits replaced, from left to right."""
    at = lambda j: F.length(_digits(F.substring(layout, F.lit(1), j + 1)))
    return F.array_join(F.transform(_characters(layout), lambda c, j: F.when(c.rlike("^[0-9]$"), F.substring(digits, at(j), F.lit(1))).otherwise(c)), "")


def _padded(x: Column, n: Column | int) -> Column:
    return F.lpad(x.cast("string"), n if isinstance(n, Column) else F.lit(n), F.lit("0"))


def _luhn(payload: Column) -> Column:
    """The check digit that makes the payload valid."""

    def step(s: Column, i: Column) -> Column:
        x = F.substring(payload, F.length(payload) - i + 1, F.lit(1)).cast("int")
        return s + F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

    total = F.aggregate(F.sequence(F.lit(1), F.length(payload)), F.lit(0), step)
    return F.pmod(-total, F.lit(10)).cast("string")


def _mod97(s: Column) -> Column:
    """A string of digits and capitals (A as 10) modulo 97."""

    def step(m: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (m * 10 + F.ascii(c) - 48) % 97).otherwise((m * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(_characters(s), F.lit(0), step)


def _pseudonym(m: Column, key: str) -> Column:
    """struct(kind, value); the kind is null and the value ``m`` where it isn't valid."""
    is_ = lambda kind: m.rlike(f"^(?:{PATTERNS[kind]})$")
    pair = lambda kind, ok, value: F.when(ok, F.struct(F.lit(kind).alias("kind"), value.alias("value"))).otherwise(F.struct(F.lit(None).cast("string").alias("kind"), m.alias("value")))
    d = _digits(m)
    part = lambda s, at, n: F.substring(s, F.lit(at) if isinstance(at, int) else at, F.lit(n) if isinstance(n, int) else n)
    number = lambda s, at, n: part(s, at, n).cast("long")

    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    top = F.substring_index(domain, ".", -1)
    body = part(domain, 1, F.length(domain) - F.length(top))
    email = F.concat(permuted_text(key, "local", local), F.lit("@"), permuted_text(key, "domain", body), top)

    head = F.when(m.contains("="), F.concat(F.substring_index(m, "=", 1), F.lit("="))).when(m.startswith("AKIA"), F.lit("AKIA")).otherwise(F.lit(""))
    hexadecimal = m.rlike("^[0-9a-f]{40}$")
    tail = part(m, F.length(head) + 1, F.length(m))
    secret = F.concat(head, permuted_text(key, "secret", tail, hexadecimal))

    ten = F.right(d, F.lit(10))
    p = permuted(key, "phone", number(ten, 1, 3) - 200, (number(ten, 4, 3) - 200) * 10000 + number(ten, 7, 4), 800, 8_000_000)
    phone = F.transform(F.array(p), lambda x: F.concat(part(d, 1, F.length(d) - 10), _padded(x["l"] + 200, 3), _padded(F.floor(x["r"] / 10000) + 200, 3), _padded(x["r"] % 10000, 4)))[0]

    country = F.regexp_extract(m, r"^\+([0-9]{1,3})", 1)
    intl = F.concat(country, permuted_text(key, "intl", part(d, F.length(country) + 1, 20)))

    plain = F.regexp_replace(m, " ", "")
    bban = permuted_text(key, "iban", part(plain, 5, 40))
    check = F.transform(F.array(bban), lambda b: F.struct(b.alias("b"), _padded(98 - _mod97(F.concat(b, part(plain, 1, 2), F.lit("00"))), 2).alias("c")))[0]
    solid = F.transform(F.array(check), lambda x: F.concat(part(plain, 1, 2), x["c"], x["b"]))[0]
    at = lambda j: F.length(F.regexp_replace(F.substring(m, F.lit(1), j + 1), " ", ""))
    iban = F.transform(F.array(solid), lambda s: F.array_join(F.transform(_characters(m), lambda c, j: F.when(c == " ", c).otherwise(F.substring(s, at(j), F.lit(1)))), ""))[0]
    iban_ok = _mod97(F.concat(part(plain, 5, 40), part(plain, 1, 4))) == 1

    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    q = permuted(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
    ip = F.transform(F.array(q), lambda x: F.concat_ws(".", *[v.cast("string") for h in ("l", "r") for v in (F.floor(x[h] / 256), x[h] % 256)]))[0]

    first = m.rlike("^[0-9]{4}")
    y, mo, da = F.when(first, part(d, 1, 4)).otherwise(part(d, 5, 4)), F.when(first, part(d, 5, 2)).otherwise(part(d, 3, 2)), F.when(first, part(d, 7, 2)).otherwise(part(d, 1, 2))
    day = F.datediff(F.try_to_date(F.concat_ws("-", y, mo, da), "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date")).cast("long")
    t = permuted(key, "date", F.floor(day / DAYS[1]), day % DAYS[1], *DAYS)
    new_day = F.transform(F.array(t), lambda x: F.date_add(F.lit(FIRST_DAY).cast("date"), (x["l"] * DAYS[1] + x["r"]).cast("int")))[0]
    date = F.transform(F.array(new_day), lambda x: F.when(first, F.date_format(x, "yyyyMMdd")).otherwise(F.date_format(x, "ddMMyyyy")))[0]

    area, group, serial = number(d, 1, 3), number(d, 4, 2), number(d, 6, 4)
    s = permuted(key, "ssn", (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1, serial - 1, 898 * 99, 9999)
    ssn = F.transform(
        F.array(s),
        lambda x: F.concat(_padded(F.floor(x["l"] / 99) + F.when(F.floor(x["l"] / 99) >= 665, 2).otherwise(1), 3), _padded(x["l"] % 99 + 1, 2), _padded(x["r"] + 1, 4)),
    )[0]
    ssn_ok = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)

    payload = part(d, 1, F.length(d) - 1)
    small = F.floor(F.length(payload) / 2).cast("int")
    large = F.length(payload) - small
    c = permuted(key, F.concat(F.lit("card"), F.length(d).cast("string")), part(payload, 1, small).cast("long"), part(payload, small + 1, large).cast("long"), F.pow(F.lit(10), small).cast("long"), F.pow(F.lit(10), large).cast("long"))
    new_payload = F.transform(F.array(c), lambda x: F.concat(_padded(x["l"], small), _padded(x["r"], large)))[0]
    card = F.transform(F.array(new_payload), lambda x: F.concat(x, _luhn(x)))[0]
    card_ok = _luhn(payload) == F.right(d, F.lit(1))

    return (
        F.when(is_("email"), pair("email", F.lit(True), email))
        .when(is_("secret"), pair("secret", F.lit(True), secret))
        .when(is_("phone"), pair("phone", F.lit(True), _refilled(m, phone)))
        .when(is_("intl"), pair("intl", F.length(d).between(8, 15), _refilled(m, intl)))
        .when(is_("iban"), pair("iban", iban_ok, iban))
        .when(is_("ip"), pair("ip", F.lit(True), ip))
        .when(is_("date"), pair("date", day.between(0, DAYS[0] * DAYS[1] - 1), _refilled(m, date)))
        .when(is_("ssn"), pair("ssn", ssn_ok, _refilled(m, ssn)))
        .when(is_("card"), pair("card", card_ok, _refilled(m, card)))
        .otherwise(F.struct(F.lit(None).cast("string").alias("kind"), m.alias("value")))
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text", n_found: str = "n_found", kinds: str = "kinds") -> DataFrame:
    """``docs`` with the text's values replaced, and ``n_found`` (long) and ``kinds`` (the kind of each, in the order of the text). ``key``: a secret of your own."""
    if not key:
        raise ValueError("pseudonyms need a key")
    kept = [c for c in docs.columns if c not in (n_found, kinds)]
    old, new = unused("found", docs), unused("new", docs)
    columns, body = [F.col(f"`{c}`") for c in kept], F.col(f"`{text}`")
    none = F.array().cast("array<string>")
    found = docs.select(*columns, F.when(body.rlike(_HAS), F.regexp_extract_all(body, F.lit(_ANY), F.lit(0))).otherwise(none).alias(old))
    made = found.select(*columns, F.transform(old, lambda m: _pseudonym(m, key)).alias(new))
    woven = F.array_join(F.zip_with(F.split(body, _ANY, -1), new, lambda g, n: F.concat(g, F.coalesce(n["value"], F.lit("")))), "")
    named = F.filter(F.transform(new, lambda n: n["kind"]), lambda k: k.isNotNull())
    whole = F.when(F.size(new) > 0, woven).otherwise(body).alias(text)
    return made.select(*[whole if c == text else F.col(f"`{c}`") for c in kept], F.size(named).cast("long").alias(n_found), named.alias(kinds))
