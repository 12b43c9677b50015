"""PII: format-preserving Feistel pseudonyms of validated numbers, dates and addresses (native)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.llm.work import table

ROUNDS = 8

# No pattern repeats a group without a bound: the engine recurses once for each turn of a group, and a long text
# would exhaust its stack. A domain has at most 127 labels, a local part 64 characters.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,125}\.[A-Za-z]{2,}"
HEX = r"(?<![A-Za-z0-9])[0-9a-f]{32,128}(?![A-Za-z0-9])|(?<![A-Za-z0-9])[0-9A-F]{32,128}(?![A-Za-z0-9])"
#: characters of an IBAN by country; other countries take any length
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL OM SO", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
_KNOWN = "|".join(" ".join(IBAN_LENGTHS.values()).split())
_BY_COUNTRY = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
                       for n, c in IBAN_LENGTHS.items())
IBAN = (rf"(?<![A-Za-z0-9])(?:{_BY_COUNTRY}|(?!{_KNOWN})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)"
        r"(?![A-Za-z0-9])")
IPV4 = r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
YMD = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{4}\.[0-9]{2}\.[0-9]{2})(?![0-9])"
DMY = r"(?<![0-9./-])(?:[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9])"
CARD = (r"(?<![0-9])(?:[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{1,7}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{1,7}|[0-9]{4} [0-9]{6} [0-9]{4,5}"
        r"|[0-9]{4}-[0-9]{6}-[0-9]{4,5}|[0-9]{13,19})(?![0-9])")
PHONE = (r"(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?(?:[0-9]{2,4}|[0-9][ .-][0-9]{2,4})(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9])"
         r"|(?<![0-9(+-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])")
KINDS = {"email": EMAIL, "hex": HEX, "iban": IBAN, "ipv4": IPV4, "ssn": SSN, "ymd": YMD, "dmy": DMY, "card": CARD, "phone": PHONE}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())

DAYS_HIGH, DAYS_LOW = 17, 4297  # 1900-01-01 to 2099-12-31 are 17 * 4297 days
FIRST_DAY = "1900-01-01"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), 0)


def _feistel(a: Column, b: Column, size_a: Column, size_b: Column, tweak: Column, key: str) -> Column:
    """Permute the pair (a, b) of [0, size_a) x [0, size_b): struct with fields a and b.

    Each round adds to one half, modulo its size, a keyed SHA-256 of the other and swaps them, which
    can be undone whatever the hash is; so the whole is a permutation of the pairs."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), size_a.cast("long").alias("m"), size_b.cast("long").alias("n"))

    def step(x: Column, r: Column) -> Column:
        digest = F.sha2(F.concat_ws(":", F.lit(key), tweak, r.cast("string"), x["b"].cast("string")).cast("binary"), 256)
        add = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % x["m"]
        return F.struct(x["b"].alias("a"), ((x["a"] + add) % x["m"]).alias("b"), x["n"].alias("m"), x["m"].alias("n"))

    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), start, step)


def _power(base: int, n: Column) -> Column:
    return F.aggregate(F.array_repeat(F.lit(base).cast("long"), n), F.lit(1).cast("long"), lambda x, y: x * y)


def _digits(s: Column, tweak: Column, key: str, base: int = 10) -> Column:
    """Permute a string of digits of ``base`` among those of its length, in blocks of 16."""

    def block(d: Column, place: Column) -> Column:
        low = F.floor(F.char_length(d) / 2).cast("int")
        high = F.char_length(d) - low
        number = lambda x: F.coalesce(F.conv(x, base, 10).cast("long"), F.lit(0))
        both = _feistel(number(F.substring(d, F.lit(1), high)), number(F.substring(d, high + 1, low)),
                        _power(base, high), _power(base, low), F.concat_ws(":", tweak, place.cast("string"), F.char_length(d).cast("string")), key)
        write = lambda x, n: F.when(n > 0, F.lpad(F.lower(F.conv(x.cast("string"), 10, base)), n, "0")).otherwise(F.lit(""))
        return _let(both, lambda p: F.concat(write(p["a"], high), write(p["b"], low)))

    return F.when(F.char_length(s) > 0, F.array_join(F.transform(
        F.sequence(F.lit(0), F.floor((F.char_length(s) - 1) / 16).cast("int")),
        lambda k: _let(F.substring(s, k * 16 + 1, F.lit(16)), lambda d: block(d, k))), "")).otherwise(F.lit(""))


def _refill(form: Column, kind: str, chars: Column) -> Column:
    """``form`` with its characters of the class ``kind`` replaced by ``chars`` in turn."""
    start = F.struct(F.lit("").alias("done"), chars.alias("rest"))
    return F.aggregate(F.split(form, ""), start, lambda x, c: F.when(
        c.rlike(f"^{kind}$"), F.struct(F.concat(x["done"], F.substring(x["rest"], 1, 1)).alias("done"), F.substring(x["rest"], F.lit(2), F.lit(1000)).alias("rest")))
        .otherwise(F.struct(F.concat(x["done"], c).alias("done"), x["rest"].alias("rest"))))["done"]


def _only_digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn_sum(digits: Column, doubled_first: bool) -> Column:
    """Luhn sum from the right; ``doubled_first`` if the last digit is doubled."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(doubled_first).alias("twice"))

    def step(x: Column, c: Column) -> Column:
        d = c.cast("int")
        double = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.struct((x["sum"] + F.when(x["twice"], double).otherwise(d)).alias("sum"), (~x["twice"]).alias("twice"))

    return F.aggregate(F.split(F.reverse(digits), ""), start, step)["sum"]


def _card(m: Column, key: str) -> Column:
    """A number that passes Luhn's check becomes another that does; null if it doesn't pass."""
    def made(d: Column) -> Column:
        body = _digits(F.substring(d, F.lit(1), F.char_length(d) - 1), F.lit("card"), key)
        whole = _let(body, lambda b: F.concat(b, ((10 - _luhn_sum(b, True) % 10) % 10).cast("string")))
        return F.when(F.char_length(d).between(13, 19) & (_luhn_sum(d, False) % 10 == 0), _refill(m, "[0-9]", whole))
    return _let(_only_digits(m), made)


def _mod97(s: Column) -> Column:
    """The number that an alphanumeric string spells (A = 10 ... Z = 35), modulo 97."""
    return F.aggregate(F.split(s, ""), F.lit(0), lambda x, c: F.when(
        c.rlike("^[0-9]$"), (x * 10 + c.cast("int")) % 97).otherwise((x * 100 + F.ascii(c) - 55) % 97))


def _iban(m: Column, key: str) -> Column:
    """Digits of the account part are permuted, letters stay, the check digits are computed anew."""
    def made(s: Column) -> Column:
        land, account = F.substring(s, 1, 2), F.substring(s, 5, 100)
        new = _refill(account, "[0-9]", _digits(_only_digits(account), F.concat(F.lit("iban"), land), key))
        whole = _let(new, lambda a: F.concat(land, F.lpad((98 - _mod97(F.concat(a, land, F.lit("00")))).cast("string"), 2, "0"), a))
        return F.when(F.char_length(s).between(15, 34) & (_mod97(F.concat(account, F.substring(s, 1, 4))) == 1), _refill(m, "[A-Z0-9]", whole))
    return _let(F.replace(m, F.lit(" "), F.lit("")), made)


def _ipv4(m: Column, key: str) -> Column:
    def made(p: Column) -> Column:
        o = [F.get(p, k).cast("int") for k in range(4)]
        both = _feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), F.lit("ipv4"), key)
        text = lambda x: F.concat_ws(".", F.floor(x / 256).cast("string"), (x % 256).cast("string"))
        return F.when(F.forall(p, lambda x: x.cast("int") <= 255), _let(both, lambda q: F.concat_ws(".", text(q["a"]), text(q["b"]))))
    return _let(F.split(m, r"\."), made)


def _ssn(m: Column, key: str) -> Column:
    """Area 001-899 without 666, group 01-99, serial 0001-9999."""
    area, group, serial = (F.get(F.split(m, "-"), k).cast("int") for k in range(3))
    rank = F.when(area > 666, area - 2).otherwise(area - 1)
    both = _feistel(rank * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), F.lit("ssn"), key)

    def text(p: Column) -> Column:
        place = F.floor(p["a"] / 99)
        number = F.when(place >= 665, place + 2).otherwise(place + 1)
        return F.concat_ws("-", F.lpad(number.cast("string"), 3, "0"), F.lpad((p["a"] % 99 + 1).cast("string"), 2, "0"),
                           F.lpad((p["b"] + 1).cast("string"), 4, "0"))

    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), _let(both, text))


def _other_day(year: Column, month: Column, day: Column, key: str) -> Column:
    """Another day of 1900 to 2099; null if the parts are no day of these years."""
    at = F.datediff(F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date"))
    return F.when(year.between(1900, 2099), _let(at, lambda n: F.when(n.isNotNull(), _let(
        _feistel(F.floor(n / DAYS_LOW), n % DAYS_LOW, F.lit(DAYS_HIGH), F.lit(DAYS_LOW), F.lit("day"), key),
        lambda p: F.date_add(F.lit(FIRST_DAY).cast("date"), (p["a"] * DAYS_LOW + p["b"]).cast("int"))))))


def _ymd(m: Column, key: str) -> Column:
    mark = F.substring(m, 5, 1)
    year, month, day = (F.get(F.split(m, "[-/.]"), k).cast("int") for k in range(3))
    return _let(_other_day(year, month, day, key), lambda d: F.when(d.isNotNull(), F.concat(
        F.date_format(d, "yyyy"), mark, F.date_format(d, "MM"), mark, F.date_format(d, "dd"))))


def _dmy(m: Column, key: str) -> Column:
    """Day, month and year, or month first where only that is a day; as many digits as before."""
    mark = F.regexp_extract(m, "([-/.])", 1)
    part = lambda k: F.get(F.split(m, "[-/.]"), k)
    a, b, year = (part(k).cast("int") for k in range(3))
    width = lambda k, x: F.when(F.char_length(part(k)) == 1, x.cast("string")).otherwise(F.lpad(x.cast("string"), 2, "0"))

    def text(first, second):
        return lambda d: F.when(d.isNotNull(), F.concat(
            width(0, first(d)), mark, width(1, second(d)), mark, F.year(d).cast("string")))

    return F.coalesce(_let(_other_day(year, b, a, key), text(F.day, F.month)), _let(_other_day(year, a, b, key), text(F.month, F.day)))


def _phone(m: Column, key: str) -> Column:
    """The country code stays; 7 to 15 digits in all."""
    def made(d: Column) -> Column:
        code = F.when(m.startswith("+"), F.char_length(F.regexp_extract(m, r"^\+([0-9]{1,3})", 1))).otherwise(F.lit(0))
        code = F.when(m.startswith("+1"), F.lit(1)).otherwise(code)
        new = F.concat(F.substring(d, F.lit(1), code), _digits(F.substring(d, code + 1, F.lit(20)), F.concat(F.lit("phone"), F.substring(d, F.lit(1), code)), key))
        return F.when(F.char_length(d).between(7, 15), _refill(m, "[0-9]", new))
    return _let(_only_digits(m), made)


def _email(m: Column, key: str) -> Column:
    """Letters and digits of the local part are permuted as base 36, upper case as lower case; marks
    and the domain stay. A local part without any stays."""
    local, domain = F.regexp_extract(m, "^([^@]*)@", 1), F.regexp_extract(m, "(@.*)$", 1)
    # letters beyond a-z have no place in base 36: they go and select the permutation instead
    plain = F.regexp_replace(F.lower(local), "[^a-z0-9]", "")
    odd = F.regexp_replace(F.lower(local), r"[a-z0-9._%+-]", "")
    new = _digits(plain, F.concat(F.lit("email"), odd), key, 36)
    shape = F.regexp_replace(local, r"[^A-Za-z0-9._%+-]", "")
    return F.concat(_refill(shape, "[A-Za-z0-9]", new), domain)


def _hex(m: Column, key: str) -> Column:
    """Secrets in hexadecimal, with letters and digits; the case stays."""
    new = _digits(F.lower(m), F.lit("hex"), key, 16)
    return F.when(m.rlike("[0-9]") & m.rlike("[A-Fa-f]"), F.when(m.rlike("[A-F]"), F.upper(new)).otherwise(new))


MAKERS = {"email": _email, "hex": _hex, "iban": _iban, "ipv4": _ipv4, "ssn": _ssn, "ymd": _ymd, "dmy": _dmy, "card": _card, "phone": _phone}


def _tried(match: Column, key: str) -> Column:
    """The pseudonym of a value by the first kind that it is valid for; null if there is none."""
    tries = [F.when(match.rlike(f"^(?:{pattern})$"), MAKERS[kind](match, key)) for kind, pattern in KINDS.items()]
    return F.coalesce(*tries)


def pseudonym(match: Column, key: str) -> Column:
    """The pseudonym of a value by the first kind that it is valid for; itself if there is none."""
    return F.coalesce(_tried(match, key), match)


BREAK, ESCAPE = "\ue000", "\ue001"  # of the private use area; those of the text itself are written otherwise meanwhile
_HEAD = "^([^A-Za-z0-9]*[A-Za-z0-9]+)(?=[^A-Za-z0-9])"  # first word or number of a value that has more


def _all(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def _joined(text: Column, new: Column) -> Column:
    """``text`` with its matches replaced by ``new`` in turn."""
    return F.array_join(F.zip_with(F.split(text, ANY, -1), F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def _broken(text: Column, key: str) -> Column:
    """``text`` with a break behind the first word or number of every match that is no valid value,
    until all matches are valid or have no more than one: so later values inside are found."""
    plain = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "1")), F.lit(BREAK), F.lit(ESCAPE + "0"))
    start = F.struct(plain.alias("text"), F.lit(True).alias("more"))

    def again(x: Column) -> Column:
        found = _all(x["text"])
        new = F.transform(found, lambda m: F.when(m.rlike(_HEAD) & _tried(m, key).isNull(), F.regexp_replace(m, _HEAD, "$1" + BREAK)).otherwise(m))
        return _let(_joined(x["text"], new), lambda t: F.struct(t.alias("text"), (t != x["text"]).alias("more")))

    # each step but the last breaks behind at least one word or number with a digit
    steps = F.sequence(F.lit(0), F.regexp_count(text, F.lit("[A-Za-z0-9]+")) + 1)
    return F.aggregate(steps, start, lambda x, _: F.when(x["more"], again(x)).otherwise(x))["text"]


def _unbroken(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit(BREAK), F.lit("")), F.lit(ESCAPE + "0"), F.lit(BREAK))
    return F.replace(text, F.lit(ESCAPE + "1"), F.lit(ESCAPE))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """Rows ``doc_id, text, n_replaced``: every valid value in the whole text replaced.

    Card numbers (Luhn), IBANs (modulo 97), US social security numbers, IPv4 addresses, dates of 1900
    to 2099, phone numbers, e-mail addresses and hexadecimal secrets are permuted within their format
    by Feistel networks keyed with ``key``, which must be kept secret; check digits are computed anew, so a pseudonym is as valid
    as the value. The same value has the same pseudonym in every document; two values of one format
    and length never share one (but for letters beyond a-z in an e-mail address, which go). Everything else stays as it is.

    The text is split at the matches and joined again with their pseudonyms in between; a match that
    is no valid value is searched for values behind its first word or number. Null text stays
    null. Rows are never shuffled, so repeated rows, null ids and empty tables need no care."""
    d = docs.select("doc_id", "text", F.when(F.col("text").rlike("[0-9@]"), _all(F.col("text")))
                    .otherwise(F.array().cast("array<string>")).alias("found"))
    tried = F.transform("found", lambda m: _tried(m, key))
    d = d.select("doc_id", "text", "found", F.when(F.size("found") > 0, tried).alias("tried"))
    invalid = F.exists(F.zip_with("found", "tried", lambda a, b: b.isNull() & a.rlike(_HEAD)), lambda x: x)
    d = d.select("doc_id", "text", "found", "tried", F.when((F.size("found") > 0) & invalid, _broken(F.col("text"), key)).alias("broken"))
    d = d.select("doc_id", "text", "tried", "broken", F.when(F.col("broken").isNull(), F.col("found")).otherwise(_all(F.col("broken"))).alias("found"))
    again = F.when(F.col("broken").isNull(), F.col("tried")).otherwise(F.transform("found", lambda m: _tried(m, key)))
    d = d.select("doc_id", "text", "broken", "found", F.when(F.size("found") > 0, F.zip_with("found", again, lambda a, b: F.coalesce(b, a))).alias("new"))
    whole = F.when(F.col("broken").isNull(), _joined(F.col("text"), F.col("new"))).otherwise(_unbroken(_joined(F.col("broken"), F.col("new"))))
    n = F.size(F.filter(F.zip_with("found", "new", lambda a, b: a != b), lambda x: x))
    return d.select("doc_id", F.when(F.size("found") > 0, whole).otherwise(F.col("text")).alias("text"),
                    F.when(F.size("found") > 0, n).otherwise(F.lit(0)).cast("long").alias("n_replaced"))


def op5_pseudonyms(spark, sf_dir):
    """``pseudonymise`` over all documents, with a key for tests: who knows it can undo the permutations."""
    return pseudonymise(table(spark, sf_dir, "documents"), "key of the test query")
