"""The pseudonyms in plain Python, value by value: what tests compare the native operator with."""

import datetime as dt
import hashlib

import regex

from leadlake.llm import pseudonyms as P

LETTERS = "0123456789abcdefghijklmnopqrstuvwxyz"


def feistel(a, b, m, n, tweak, key):
    for r in range(8):
        digest = hashlib.sha256(f"{key}:{tweak}:{r}:{b}".encode()).hexdigest()
        a, b, m, n = b, (a + int(digest[:15], 16) % m) % m, n, m
    return a, b


def written(x, n, base):
    out = ""
    for _ in range(n):
        x, d = divmod(x, base)
        out = LETTERS[d] + out
    return out


def digits(s, tweak, key, base=10):
    out = ""
    for k in range(0, len(s), 16):
        d = s[k:k + 16]
        low = len(d) // 2
        high = len(d) - low
        a, b = feistel(int(d[:high], base), int(d[high:] or "0", base), base ** high, base ** low, f"{tweak}:{k // 16}:{len(d)}", key)
        out += written(a, high, base) + written(b, low, base)
    return out


def refill(form, chars, fits):
    rest = iter(chars)
    return "".join(next(rest, "") if fits(c) else c for c in form)


def digit(c):
    return "0" <= c <= "9"


def luhn(d, twice):
    total = 0
    for c in reversed(d):
        x = int(c) * (2 if twice else 1)
        total += x - 9 if x > 9 else x
        twice = not twice
    return total % 10


def card(m, key):
    d = "".join(filter(digit, m))
    if not 13 <= len(d) <= 19 or luhn(d, False):
        return None
    body = digits(d[:-1], "card", key)
    return refill(m, body + str(-luhn(body, True) % 10), digit)


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def iban(m, key):
    s = m.replace(" ", "")
    if not 15 <= len(s) <= 34 or mod97(s[4:] + s[:4]) != 1:
        return None
    account = refill(s[4:], digits("".join(filter(digit, s[4:])), "iban" + s[:2], key), digit)
    return refill(m, f"{s[:2]}{98 - mod97(account + s[:2] + '00'):02d}{account}", lambda c: c != " ")


def ipv4(m, key):
    o = [int(x) for x in m.split(".")]
    if max(o) > 255:
        return None
    a, b = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ipv4", key)
    return f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"


def ssn(m, key):
    area, group, serial = map(int, m.split("-"))
    if not 1 <= area <= 899 or area == 666 or not group or not serial:
        return None
    areas = [x for x in range(1, 900) if x != 666]
    a, b = feistel(areas.index(area) * 99 + group - 1, serial - 1, 898 * 99, 9999, "ssn", key)
    return f"{areas[a // 99]:03d}-{a % 99 + 1:02d}-{b + 1:04d}"


def other_day(year, month, day, key):
    try:
        n = (dt.date(year, month, day) - dt.date(1900, 1, 1)).days
    except ValueError:
        return None
    if not 1900 <= year <= 2099:
        return None
    a, b = feistel(n // 4297, n % 4297, 17, 4297, "day", key)
    return dt.date(1900, 1, 1) + dt.timedelta(a * 4297 + b)


def ymd(m, key):
    d = other_day(int(m[:4]), int(m[5:7]), int(m[8:]), key)
    return d and f"{d.year:04d}{m[4]}{d.month:02d}{m[4]}{d.day:02d}"


def dmy(m, key):
    mark = next(c for c in m if c in "-/.")
    x, y, z = m.split(mark)
    for month_first in (False, True):
        a, b = (int(y), int(x)) if not month_first else (int(x), int(y))
        d = other_day(int(z), a, b, key)
        if d:
            one, two = (d.month, d.day) if month_first else (d.day, d.month)
            return mark.join([f"{one:d}" if len(x) == 1 else f"{one:02d}", f"{two:d}" if len(y) == 1 else f"{two:02d}", str(d.year)])
    return None


def phone(m, key):
    d = "".join(filter(digit, m))
    code = 0
    if m.startswith("+"):
        code = 1 if m[1] == "1" else len(regex.match(r"\+([0-9]{1,3})", m)[1])
    if not 7 <= len(d) <= 15:
        return None
    return refill(m, d[:code] + digits(d[code:], "phone" + d[:code], key), digit)


def email(m, key):
    local, _, domain = m.partition("@")
    lower = local.lower()
    alnum = lambda c: c in LETTERS
    odd = "".join(c for c in lower if c not in LETTERS + "._%+-")
    new = digits("".join(filter(alnum, lower)), "email" + odd, key, 36)
    shape = "".join(c for c in local if c.isascii())
    return refill(shape, new, lambda c: c.isalnum()) + "@" + domain


def hexadecimal(m, key):
    if not any(map(digit, m)) or not any(c.lower() in "abcdef" for c in m):
        return None
    new = digits(m.lower(), "hex", key, 16)
    return new.upper() if any(c in "ABCDEF" for c in m) else new


MAKERS = {"email": email, "hex": hexadecimal, "iban": iban, "ipv4": ipv4, "ssn": ssn, "ymd": ymd, "dmy": dmy, "card": card, "phone": phone}


def tried(m, key):
    for kind, pattern in P.KINDS.items():
        if regex.fullmatch(pattern, m):
            new = MAKERS[kind](m, key)
            if new is not None:
                return new
    return None


def pseudonymised(text, key):
    """(text, values replaced): matches from the left; an invalid one is searched behind its first word or number."""
    if text is None:
        return None, 0
    break_at = set()  # places that no value crosses
    while True:
        marked = "".join(("\x00" if i in break_at else "") + c for i, c in enumerate(text))
        out, n, end, more = [], 0, 0, False
        for m in regex.finditer(P.ANY, marked):
            value, new = m[0], tried(m[0], key)
            head = regex.match("[^A-Za-z0-9]*[A-Za-z0-9]+(?=[^A-Za-z0-9])", value)
            if new is None and head:
                cut = m.start() + head.end()
                break_at = break_at | {cut - marked.count("\x00", 0, cut)}
                more = True
            out += [marked[end:m.start()], value if new is None else new]
            n += new is not None and new != value
            end = m.end()
        if not more:
            return ("".join(out) + marked[end:]).replace("\x00", ""), n
