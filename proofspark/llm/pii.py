"""Format-preserving pseudonyms for personal data, as DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofspark.llm.common import documents

#: Characters of an account number by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """Numbers of the length of their country; of countries not named, of any length up to the next account number."""

    def groups(n: int) -> str:
        return f"(?: ?[A-Z0-9]{{4}}){{{n // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")

    known = [f"(?:{c.replace(' ', '|')})[0-9]{{2}}{groups(n - 4)}" for n, c in IBAN_LENGTHS.items()]
    named = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")
    start = f"(?!(?:{named})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2}})"
    other = f"[A-Z]{{2}}[0-9]{{2}}(?: ?{start}[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?"
    each = "|".join(f"{k}(?![A-Za-z0-9])" for k in [*known, other])
    return f"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{each})"


#: What is looked for, in order of precedence; one alternation, so that a place has one kind.
#: Fixed formats: addresses, numbers and dates of the named kinds.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@[A-Za-z0-9][A-Za-z0-9\-]{0,62}(?:\.[A-Za-z0-9\-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": _iban_pattern(),
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-(?:[A-Za-z0-9]{20}|(?=[A-Za-z_\-]*[0-9])[A-Za-z0-9_\-]{20})[A-Za-z0-9_\-]*)(?![A-Za-z0-9])",
    "assigned": r"(?<![A-Za-z0-9])(?i:password|passwd|secret|token|api_?key)(?: ?[=:] ?)[\"']?[A-Za-z0-9_\-/+]{8}(?:[A-Za-z0-9_\-/+.=~!@#$%^*:?]*[A-Za-z0-9_\-/+=~!@#$%^])?",
    "quoted_key": r"\"[0-9a-f]{32,64}\"",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "iso_date": r"(?<![0-9\-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9\-])",
    "slash_date": r"(?<![0-9/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])",
    "dot_date": r"(?<![0-9.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){3})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{2,4}\)[ .\-]?|[0-9]{3}[ .\-])[0-9]{3,4}[ .\-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z])\+[0-9](?:[ .\-]?[0-9]){8,13}(?![0-9])",
}
ANY = "(?:" + "|".join(PATTERNS.values()) + ")"
#: Quick test that spares most texts the search: what every pattern needs.
HINT = r"[0-9@]|[=:] ?[\"']?[A-Za-z0-9_\-/+]{8}|gh[pousr]_[A-Za-z]{36}|sk-[A-Za-z]{20}"
DATES = {"iso_date": "yyyy-MM-dd", "slash_date": "dd/MM/yyyy", "dot_date": "dd.MM.yyyy"}
#: Dates are permuted among the 270 * 271 days from this one on.
FIRST_DAY, DAYS = "1900-01-01", (270, 271)
ROUNDS = 8
#: Digits that one network permutes at once; longer numbers are permuted part by part.
WIDTH = 16


def _hash(key: Column, *parts: Column | str) -> Column:
    """Hexadecimal keyed digest of texts."""
    parts = tuple(F.lit(p) if isinstance(p, str) else p for p in parts)
    return F.sha2(F.concat_ws("|", key, F.sha2(F.concat_ws("|", key, *parts), 256)), 256)


def _keyed(key: Column, *parts: Column | str) -> Column:
    """A keyed whole number below 2^52."""
    return F.conv(F.substring(_hash(key, *parts), 1, 13), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: Column, tweak: Column) -> Column:
    """Permutes pairs (left below ``a``, right below ``b``) by ``ROUNDS`` keyed rounds.

    A round adds a keyed function of one half to the other, modulo that half's size, so each round, and
    the whole, is one-to-one for every key. Gives a struct of l and r.
    """
    a, b = a.cast("long"), b.cast("long")

    def step(s: Column, i: Column) -> Column:
        n = i.cast("string")
        low = F.pmod(s["r"] + F.pmod(_keyed(key, tweak, n, s["l"].cast("string")), b), b)
        top = F.pmod(s["l"] + F.pmod(_keyed(key, tweak, n, s["r"].cast("string")), a), a)
        even = F.pmod(i, F.lit(2)) == 0
        return F.struct(F.when(even, s["l"]).otherwise(top).alias("l"), F.when(even, low).otherwise(s["r"]).alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _padded(value: Column, width: Column | int) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def _permute_part(d: Column, key: Column, tweak: Column) -> Column:
    n = F.length(d)
    low = F.ceil(n / 2).cast("int")
    high = n - low
    ten = F.lit(10.0)
    halves = feistel(
        F.when(high > 0, d.substr(F.lit(1), high).cast("long")).otherwise(F.lit(0).cast("long")),
        d.substr(high + 1, low).cast("long"),
        F.pow(ten, high), F.pow(ten, low), key, tweak,
    )
    join = lambda s: F.concat(F.when(high > 0, _padded(s["l"], high)).otherwise(F.lit("")), _padded(s["r"], low))
    return F.when(n == 0, d).otherwise(F.element_at(F.transform(F.array(halves), join), 1))


def permute_digits(d: Column, key: Column, tweak: Column | str) -> Column:
    """A keyed permutation of the digit strings of each length, up to twice ``WIDTH`` digits."""
    tweak = F.concat_ws(":", F.lit(tweak) if isinstance(tweak, str) else tweak, F.length(d).cast("string"))
    head = d.substr(F.lit(1), F.lit(WIDTH))
    rest = d.substr(F.lit(WIDTH + 1), F.length(d))
    return F.concat(
        _permute_part(head, key, F.concat_ws(":", tweak, F.lit("0"))),
        _permute_part(rest, key, F.concat_ws(":", tweak, F.lit("1"), head)),
    )


def _fill(layout: Column, d: Column) -> Column:
    """The layout with its digits replaced by those of ``d`` in turn."""
    place = lambda c, i: F.when(
        c.rlike("^[0-9]$"), d.substr(F.length(_digits(layout.substr(F.lit(1), i + 1))), F.lit(1))
    ).otherwise(c)
    return F.array_join(F.transform(F.split(layout, ""), place), "")


def luhn_sum(d: Column, doubled: int) -> Column:
    """Luhn sum of digits; ``doubled`` is 1 if the second digit from the right is doubled, 0 if the first is."""
    value = lambda c, i: F.when(
        F.pmod(i, F.lit(2)) == doubled, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)
    ).otherwise(c.cast("int"))
    digits = F.filter(F.split(F.reverse(d), ""), lambda c: c != "")
    return F.aggregate(F.transform(digits, value), F.lit(0), lambda acc, x: acc + x)


def mod_97(text: Column) -> Column:
    """Remainder of the number that capital letters (10 to 35) and digits spell."""
    add = lambda acc, c: F.when(
        c.rlike("^[0-9]$"), F.pmod(acc * 10 + c.try_cast("int"), F.lit(97))
    ).otherwise(F.pmod(acc * 100 + (F.ascii(c) - 55), F.lit(97)))
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), add)


def _card(m: Column, key: Column) -> Column:
    d = _digits(m)
    n = F.length(d)
    body = F.concat(d.substr(F.lit(1), F.lit(1)), permute_digits(d.substr(F.lit(2), n - 2), key, "card"))
    check = F.pmod(10 - F.pmod(luhn_sum(body, 0), F.lit(10)), F.lit(10))
    return F.when(F.pmod(luhn_sum(d, 1), F.lit(10)) == 0, _fill(m, F.concat(body, check.cast("string"))))


def _iban(m: Column, key: Column) -> Column:
    plain = F.regexp_replace(m, " ", "")
    country, bban = plain.substr(F.lit(1), F.lit(2)), plain.substr(F.lit(5), F.length(plain))
    valid = mod_97(F.concat(bban, plain.substr(F.lit(1), F.lit(4)))) == 1
    new = _fill(bban, permute_digits(_digits(bban), key, F.concat(F.lit("iban"), F.regexp_replace(bban, "[0-9]", "0"), country)))
    check = _padded(98 - mod_97(F.concat(new, country, F.lit("00"))), 2)
    return F.when(valid, _fill(m, F.concat(check, _digits(new))))


def _ip(m: Column, key: Column) -> Column:
    o = F.transform(F.split(m, "[.]"), lambda x: x.cast("long"))
    two = F.lit(1 << 16)
    to_text = lambda s: F.concat_ws(".", *[F.shiftright(s[h], b).bitwiseAND(255).cast("string") for h in "lr" for b in (8, 0)])
    new = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], two, two, key, F.lit("ip"))
    return F.when(F.forall(o, lambda x: x <= 255), F.element_at(F.transform(F.array(new), to_text), 1))


def _ssn(m: Column, key: Column) -> Column:
    part = [F.element_at(F.split(m, "-"), i).cast("long") for i in (1, 2, 3)]
    valid = part[0].between(1, 899) & (part[0] != 666) & (part[1] > 0) & (part[2] > 0)
    area = F.when(part[0] > 666, part[0] - 2).otherwise(part[0] - 1)
    new = feistel(area * 99 + part[1] - 1, part[2] - 1, F.lit(898 * 99), F.lit(9999), key, F.lit("ssn"))

    def to_text(s: Column) -> Column:
        n = F.floor(s["l"] / 99)
        return F.concat_ws("-", _padded(F.when(n >= 665, n + 2).otherwise(n + 1), 3), _padded(F.pmod(s["l"], F.lit(99)) + 1, 2), _padded(s["r"] + 1, 4))

    return F.when(valid, F.element_at(F.transform(F.array(new), to_text), 1))


def _date(m: Column, layout: str, key: Column) -> Column:
    parsed = F.try_to_timestamp(m, F.lit(layout)).cast("date")
    day = F.date_diff(parsed, F.lit(FIRST_DAY).cast("date"))
    a, b = DAYS
    new = feistel(F.floor(day / b), F.pmod(day, F.lit(b)), F.lit(a), F.lit(b), key, F.lit("date"))
    to_text = lambda s: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (s["l"] * b + s["r"]).cast("int")), layout)
    return F.when(day.between(0, a * b - 1), F.element_at(F.transform(F.array(new), to_text), 1))


def _phone(m: Column, key: Column) -> Column:
    country = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .\-(])", 0)
    rest = m.substr(F.length(country) + 1, F.length(m))
    d = _digits(rest)
    new = F.concat(country, _fill(rest, permute_digits(d, key, F.concat(F.lit("phone"), country))))
    return F.when(F.length(_digits(m)).between(10, 15), new)


def _email(m: Column, key: Column) -> Column:
    low = F.lower(m)
    host = _hash(key, "host", F.substring_index(low, "@", -1)).substr(1, 8)
    return F.concat(F.lit("u"), _hash(key, "email", low).substr(1, 16), F.lit("@h"), host, F.lit(".example"))


def _value(m: Column, prefix: str, suffix: str, key: Column, capital: bool = False) -> Column:
    """Keeps a prefix and a suffix; what is between becomes hexadecimal digits of the same length."""
    head, tail = F.regexp_extract(m, prefix, 0), F.regexp_extract(m, suffix, 0)
    n = F.length(m) - F.length(head) - F.length(tail)
    body = m.substr(F.length(head) + 1, n)
    seed = _hash(key, "value", body)
    more = lambda i: _hash(key, F.concat(F.lit("value"), (i + 1).cast("string")), seed)
    rest = F.when(n > 128, F.array_join(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.floor((n - 1) / 64).cast("int"))), more), ""))
    stream = F.concat(seed, _hash(key, "value2", body), F.coalesce(rest, F.lit("")))
    return F.concat(head, (F.upper(stream) if capital else stream).substr(F.lit(1), n), tail)


def pseudonym(m: Column, key: Column) -> Column:
    """The pseudonym of one match; what isn't valid for its kind stays as it is."""
    make = {
        "email": _email(m, key), "iban": _iban(m, key), "ip": _ip(m, key), "ssn": _ssn(m, key),
        "card": _card(m, key), "phone": _phone(m, key),
        "secret": _value(m, "^(?:AKIA|gh[a-z]_|sk-)", "$", key, capital=True),
        "assigned": _value(m, "^.*?[=:] ?[\"']?", "$", key),
        "quoted_key": _value(m, '^"', '"$', key),
    } | {kind: _date(m, layout, key) for kind, layout in DATES.items()}
    case = F
    for kind, pattern in PATTERNS.items():
        case = case.when(m.rlike(f"^(?:{pattern})$"), make[kind])
    return F.coalesce(case, m)


def pseudonymize(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with personal data and secrets in ``text`` replaced, and ``n_replaced`` added.

    Card numbers (Luhn), IBANs (mod 97), social security numbers, phone numbers, addresses of machines and
    dates are permuted by keyed Feistel networks within their own format and stay valid; equal values get
    equal pseudonyms in all documents, different ones different ones. Mail addresses and secrets become
    keyed digests. What fails its check stays. Needs no Python on the executors.

    A null text stays null with no replacements. Repeated rows give repeated rows. A column ``n_replaced``
    of ``docs`` is replaced; all others stay. An empty table stays empty.
    """
    secret = F.lit(key)
    t = F.col(text)
    found = F.when(t.rlike(HINT), F.regexp_extract_all(t, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    pieces = F.when(F.size("_found") > 0, F.split(t, ANY, -1))
    rows = docs.drop("n_replaced") if text != "n_replaced" else docs
    rows = rows.withColumn("_found", F.coalesce(found, F.array().cast("array<string>")))
    rows = rows.withColumn("_new", F.transform("_found", lambda m: pseudonym(m, secret))).withColumn("_pieces", pieces)
    joined = F.concat(
        F.array_join(F.zip_with(F.slice("_pieces", F.lit(1), F.size("_found")), "_new", lambda p, m: F.concat(p, m)), ""),
        F.element_at("_pieces", -1),
    )
    changed = F.size(F.filter(F.arrays_zip("_found", "_new"), lambda z: z["_found"] != z["_new"])).cast("long")
    return (
        rows.withColumn(text, F.when(F.size("_found") > 0, joined).otherwise(t))
        .withColumn("n_replaced", changed)
        .drop("_found", "_new", "_pieces")
    )


def op6_pii(spark, folder: str) -> DataFrame:
    """All documents with pseudonyms in place of personal data."""
    return pseudonymize(documents(spark, folder).select("doc_id", "text"), key="proofspark-pseudonyms")
