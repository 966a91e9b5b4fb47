"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Values that a pattern finds and a rule validates (check digits, octets, calendar, area numbers)
are permuted by a keyed Feistel network within their own format, so the same value becomes the
same pseudonym in every document, a pseudonym is valid where its value was, and different values
written alike never meet. Spaces, dashes, points and brackets in cards, phones and account numbers
stay where they are while the bare digits are permuted, so a value keeps its pseudonym however it
is written (a phone with or without its country's code, too). Everything is built from SQL functions on the JVM: the text is parted at its matches,
the matches are mapped, and the parts are joined again.

* numbers of known range (IPv4, dates, social security numbers) use a Feistel network over the
  product of two residues, which is a permutation of exactly that range;
* strings (card and phone digits, hexadecimal secrets, account numbers, mail names) use one over
  the string's halves that shifts each letter within its kind (of other alphabets within its 64
  code points) and leaves signs in place; check digits are computed anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
KEY = "wavemill-demonstration-key"

#: Fixed formats: what stands around a value, and the values, in the order in which they are tried.
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}_.+-])", r"(?![\p{L}\p{N}_])"
#: Lengths of account numbers, so that none takes in the word or number after it.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    rest = lambda n: f"(?: ?[A-Z0-9]{{4}}){{{n // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    of = [f"(?:{names.replace(' ', '|')})[0-9]{{2}}{rest(n - 4)}" for n, names in _IBAN_LENGTHS.items()]
    return "(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(of) + r"|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)"


#: Numbers of countries of one length, then up to 15 digits in any groups, but not the head of a dotted or dashed value.
_PHONES = (
    r"\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}",
    r"\+33[ .-]?(?:\(0\)[ .-]?)?[1-9](?:[ .-]?[0-9]){8}(?![.-][0-9])",
    r"\+34(?:[ .-]?[0-9]){9}(?![.-][0-9])",
    r"\+[0-9](?:[ .-]?[0-9]){7,14}(?![.-][0-9])",
    r"\+[0-9]{1,3}[ .-]?\([0-9]{1,5}\)(?:[ .-]?[0-9]){4,11}(?![.-][0-9])",
    r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-][0-9]{2,4}){2,3}",
    r"\([0-9]{3}\) ?[0-9]{3}[.-][0-9]{4}",
    r"[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}",
)
PATTERNS = {
    "email": r"[\p{L}\p{N}_][\p{L}\p{N}._%+-]{0,253}@[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,62}[\p{L}\p{N}])?(?:\.[\p{L}\p{N}-]{1,62})*\.\p{L}{2,24}",
    "iban": _iban_pattern(),
    "date": r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})",
    "ipv4": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.[0-9])",
    "card": r"(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "phone": "(?:" + "|".join(_PHONES) + ")",
    "secret": r"(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})",
}
#: A value may follow signs, but none that would make it part of a longer one; a date may have a time.
_ANY = _BEFORE + "(?:(?:" + "|".join(PATTERNS.values()) + ")" + _AFTER + r"|[0-9]{4}-[0-9]{2}-[0-9]{2}(?=T[0-9]{2}))"
#: Texts without it hold no value.
_HINT = r"[0-9]{2}|@|[0-9]\.[0-9]"
#: The range of dates: 270 * 271 days from this one, to 2100-05-02.
_FIRST_DAY, _DAYS = "1900-01-01", (270, 271)


def _prf(key: str, *parts: Column) -> Column:
    """56 pseudo-random bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *(p.cast("string") for p in parts)), 256), 1, 14), 16, 10).cast("long")


def feistel_number(value: Column, left: int, right: int, key: str, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of 0 .. left * right - 1."""

    def step(acc: Column, i: Column) -> Column:
        a, b = acc["a"], acc["b"]
        even = F.struct(((a + _prf(key, i, b)) % left).alias("a"), b.alias("b"))
        return F.when(i % 2 == 0, even).otherwise(F.struct(a.alias("a"), ((b + _prf(key, i, a)) % right).alias("b")))

    start = F.struct(F.floor(value / F.lit(right)).cast("long").alias("a"), (value % right).cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step, lambda acc: acc["a"] * right + acc["b"])


def _shift(text: Column, by: Column) -> Column:
    """Each ASCII digit and letter moved within its kind by three hexadecimal digits of ``by``."""

    def move(c: Column, i: Column) -> Column:
        k = F.conv(F.substr(by, (i % 21) * 3 + 1, F.lit(3)), 16, 10).cast("int")
        turn = lambda first, n: F.char(F.lit(first) + (F.ascii(c) - first + k) % n)
        other = F.ascii(c)  # the code point
        moved = other - other % 64 + (other % 64 + k) % 64
        written = F.decode(F.unhex(F.lpad(F.hex(moved), 4, "0")), "UTF-16BE")
        letter = c.rlike(r"^\p{L}$") & ~c.between("A", "z") & other.between(0xC0, 0xD7FF)
        return F.when(c.between("0", "9"), turn(48, 10)).when(c.between("a", "z"), turn(97, 26)).when(c.between("A", "Z"), turn(65, 26)).when(letter, written).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), move), "")


def _hex_shift(text: Column, by: Column, upper: bool) -> Column:
    letters = "0123456789ABCDEF" if upper else "0123456789abcdef"

    def move(c: Column, i: Column) -> Column:
        k = F.conv(F.substr(by, i % 64 + 1, F.lit(1)), 16, 10).cast("int")
        return F.substr(F.lit(letters), (F.instr(F.lit(letters), c) - 1 + k) % 16 + 1, F.lit(1))

    return F.array_join(F.transform(F.split(text, ""), move), "")


def feistel_text(text: Column, key: str, shift=_shift, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of the strings that have the same kinds of characters in place."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")

    def step(acc: Column, i: Column) -> Column:
        a, b = acc["a"], acc["b"]
        by = F.sha2(F.concat_ws("|", F.lit(key), i.cast("string"), F.when(i % 2 == 0, b).otherwise(a)), 256)
        return F.when(i % 2 == 0, F.struct(shift(a, by).alias("a"), b.alias("b"))).otherwise(F.struct(a.alias("a"), shift(b, by).alias("b")))

    start = F.struct(F.substr(text, F.lit(1), half).alias("a"), F.substr(text, half + 1, n - half).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step, lambda acc: F.concat(acc["a"], acc["b"]))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn_sum(digits: Column, double_last: int) -> Column:
    """The weighted digit sum; the last digit is doubled if ``double_last`` is 1."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 1 - double_last, c.cast("int") * 2 - F.when(c >= "5", 9).otherwise(0)).otherwise(c.cast("int")),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _mod97(text: Column) -> Column:
    """The remainder by 97 of a string whose letters stand for 10 to 35."""
    return F.aggregate(
        F.split(text, ""),
        F.lit(0),
        lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )


def _refilled(x: Column, bare: Column, letters: bool = False) -> Column:
    """x with its digits (and capitals) replaced by those of ``bare``, in order; signs stay."""
    counts = lambda c: c.between("0", "9") | c.between("A", "Z") if letters else c.between("0", "9")
    step = lambda acc, c: F.when(counts(c), F.struct(F.concat(acc["out"], F.substr(bare, acc["i"], F.lit(1))).alias("out"), (acc["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["i"].alias("i")))
    return F.aggregate(F.split(x, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("i")), step, lambda acc: acc["out"])


def _card(x: Column, key: str) -> Column:
    """The first digit, which names the issuer's kind, stays; the check digit is computed."""

    def of(digits: Column) -> Column:
        body = F.concat(F.substr(digits, F.lit(1), F.lit(1)), feistel_text(F.substr(digits, F.lit(2), F.char_length(digits) - 2), key + "|card"))
        check = lambda b: F.concat(b, ((10 - _luhn_sum(b, 1) % 10) % 10).cast("string"))
        return F.when(_luhn_sum(digits, 0) % 10 == 0, _let(_let(body, check), lambda new: _refilled(x, new))).otherwise(x)

    return _let(_digits(x), of)


def _let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _iban(x: Column, key: str) -> Column:
    def of(bare: Column) -> Column:
        country = F.substr(bare, F.lit(1), F.lit(2))
        valid = _mod97(F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))) == 1
        check = lambda rest: F.lpad((98 - _mod97(F.concat(rest, country, F.lit("00")))).cast("string"), 2, "0")
        again = lambda rest: _let(F.concat(country, check(rest), rest), lambda new: _refilled(x, new, True))
        return F.when(valid, _let(feistel_text(F.substr(bare, F.lit(5)), key + "|iban"), again)).otherwise(x)

    return _let(F.regexp_replace(x, " ", ""), of)


def _ipv4(x: Column, key: str) -> Column:
    """Zeros before a number stay before the new one, as 01.2.3.4 isn't how 1.2.3.4 is written."""
    zeros = F.transform(F.split(x, r"\."), lambda o: F.regexp_extract(o, "^(0*)[0-9]", 1))

    def permuted(o: Column) -> Column:
        value = ((F.get(o, F.lit(0)) * 256 + F.get(o, F.lit(1))) * 256 + F.get(o, F.lit(2))) * 256 + F.get(o, F.lit(3))
        octet = lambda v, s: F.shiftright(v, s).bitwiseAND(F.lit(255)).cast("string")
        dotted = lambda v: F.concat_ws(".", *(F.concat(F.get(zeros, F.lit(i)), octet(v, s)) for i, s in enumerate((24, 16, 8, 0))))
        return F.when(F.array_max(o) <= 255, _let(feistel_number(value, 65536, 65536, key + "|ipv4"), dotted)).otherwise(x)

    return _let(F.split(x, r"\.").cast("array<long>"), permuted)


def _date(x: Column, key: str) -> Column:
    """Slashed dates are day/month; those that can't be are month/day, and go to such ones."""
    sign = F.substr(x, F.lit(3), F.lit(1))
    iso = F.substr(x, F.lit(5), F.lit(1)) == "-"
    first, second, year = (F.substr(x, F.lit(a), F.lit(n)) for a, n in ((1, 2), (4, 2), (7, 4)))
    start = F.lit(_FIRST_DAY).cast("date")
    day_of = lambda text: F.datediff(F.try_to_date(text, "yyyy-MM-dd"), start).cast("long")
    day = day_of(F.when(iso, x).otherwise(F.concat_ws("-", year, second, first)))
    month_first = day_of(F.when(sign == "/", F.concat_ws("-", year, first, second)))
    mapped = lambda d: feistel_number(d, *_DAYS, key + "|date")
    known = lambda d: d.between(0, _DAYS[0] * _DAYS[1] - 1)

    def written(d: Column) -> Column:
        date = F.date_add(start, d.cast("int"))
        return F.when(iso, F.date_format(date, "yyyy-MM-dd")).otherwise(F.concat_ws("", F.date_format(date, "dd"), sign, F.date_format(date, "MM"), sign, F.date_format(date, "yyyy")))

    def written_month_first(d: Column) -> Column:
        # Mapped on until the day is no month again: a permutation of such dates. 64 steps miss with 1e-26.
        again = lambda v, _: F.when(F.dayofmonth(F.date_add(start, v.cast("int"))) > 12, v).otherwise(mapped(v))
        return _let(F.aggregate(F.sequence(F.lit(1), F.lit(64)), mapped(d), again), lambda v: F.date_format(F.date_add(start, v.cast("int")), "MM/dd/yyyy"))

    other = _let(month_first, lambda d: F.when(known(d), written_month_first(d)).otherwise(x))
    ok = lambda d: F.when(known(d), _let(mapped(d), written)).when(d.isNull(), other).otherwise(x)
    return _let(day, ok)


def _ssn(x: Column, key: str) -> Column:
    area, group, serial = (F.substr(x, F.lit(a), F.lit(n)).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    value = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1

    def written(v: Column) -> Column:
        a = F.floor(v / (99 * 9999)).cast("long") + 1
        return F.concat_ws("-", *(F.lpad(p.cast("string"), n, "0") for p, n in ((F.when(a >= 666, a + 1).otherwise(a), 3), (F.floor(v / 9999).cast("long") % 99 + 1, 2), (v % 9999 + 1, 4))))

    return F.when(valid, _let(feistel_number(value, 898, 99 * 9999, key + "|ssn"), written)).otherwise(x)


#: The country codes of one and of two digits; all others have three.
_CODES = "^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def _phone(x: Column, key: str) -> Column:
    """7 to 15 digits. The country code stays, and so does a zero in brackets, which isn't dialled."""

    def of(text: Column) -> Column:
        digits = _digits(text)
        code = F.when(x.startswith("+"), F.regexp_extract(digits, _CODES, 0)).otherwise("")
        new = F.concat(code, feistel_text(F.substr(digits, F.char_length(code) + 1), key + "|phone"))
        return F.when(F.char_length(digits).between(7, 15), F.replace(_let(new, lambda n: _refilled(text, n)), F.lit("(\x01)"), F.lit("(0)"))).otherwise(x)

    return _let(F.replace(x, F.lit("(0)"), F.lit("(\x01)")), of)


def _email(x: Column, key: str) -> Column:
    """The name is permuted; the host stays, so documents of one host stay comparable."""
    at = F.instr(x, "@")
    return F.concat(feistel_text(F.substr(x, F.lit(1), at - 1), key + "|email"), F.substr(x, at))


def _secret(x: Column, key: str) -> Column:
    """A hexadecimal string of both letters and digits."""
    lower = feistel_text(x, key + "|secret", lambda t, by: _hex_shift(t, by, False))
    upper = feistel_text(x, key + "|secret", lambda t, by: _hex_shift(t, by, True))
    return F.when(x.rlike("[a-f]") & x.rlike("[0-9]"), lower).when(x.rlike("[A-F]") & x.rlike("[0-9]"), upper).otherwise(x)


def pseudonym(x: Column, key: str = KEY) -> Column:
    """The pseudonym of one matched value; the value itself if no rule validates it."""
    kinds = {"email": _email, "iban": _iban, "date": _date, "ipv4": _ipv4, "card": _card, "ssn": _ssn, "phone": _phone, "secret": _secret}
    out = None
    for kind, f in kinds.items():
        test = x.contains("@") if kind == "email" else x.rlike(f"^{PATTERNS[kind]}$")
        out = F.when(test, f(x, key)) if out is None else out.when(test, f(x, key))
    return out.otherwise(x)


def replaced(text: Column, key: str = KEY) -> Column:
    """(text, n_values): the text with its personal values replaced, and how many were.

    Null stays null, with none.
    """
    pattern = F.lit(_ANY)

    def mapped(found: Column) -> Column:
        new = F.transform(found, lambda x: pseudonym(x, key))
        joined = lambda n: F.struct(
            F.array_join(F.flatten(F.zip_with(F.split(text, _ANY, -1), F.concat(n, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "").alias("text"),
            F.size(F.filter(F.zip_with(found, n, lambda a, b: a != b), lambda d: d)).cast("long").alias("n_values"),
        )
        return _let(new, joined)

    none = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n_values"))
    return F.when(text.rlike(_HINT), _let(F.regexp_extract_all(text, pattern, F.lit(0)), mapped)).otherwise(none)


def pseudonymize(docs: DataFrame, key: str = KEY) -> DataFrame:
    """The documents with personal values replaced in ``text``, and n_values; nothing else changes.

    A row for each input row: no shuffle, no Python. Null texts stay null, empty ones empty.
    Values are replaced wherever they stand, so repeated rows stay equal. A column ``n_values``
    that is there already is replaced.
    """
    names = [c for c in docs.columns if c.lower() not in ("text", "n_values")]
    return docs.select("*", replaced(F.col("text"), key).alias("__replaced")).select(*(F.col(f"`{c}`") for c in names), "__replaced.text", "__replaced.n_values")
