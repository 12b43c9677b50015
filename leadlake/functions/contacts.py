"""Contact extraction as column expressions (#52-#54, #61)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


from leadlake import constants as K
from leadlake.functions.regex import clean_distinct, js_regex

EMAIL_RE = js_regex(K.EMAIL_PATTERN)
PHONE_RE = js_regex(K.PHONE_PATTERN)


def extract_emails(text: Column) -> Column:
    """Email-pattern matches, trimmed, distinct in first-seen order (case-sensitive) (#52)."""
    found = clean_distinct(F.regexp_extract_all(text, F.lit(EMAIL_RE), 0))
    return F.when(F.contains(text, F.lit("@")), found).otherwise(F.array().cast("array<string>"))


def digits(col: Column) -> Column:
    return F.regexp_replace(col, r"[^0-9]", "")


def extract_phones(text: Column) -> Column:
    """North-American phone matches with at least 10 digits, distinct in order (#53)."""
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PHONE_RE), 0)
    return clean_distinct(F.filter(raw, lambda p: F.length(digits(p)) >= 10))


def is_social(link: Column, match: str = "substring") -> Column:
    """Link points at a social network. ``substring`` (default) reproduces the
    application's ``includes`` test; ``host`` requires the link's host to be the
    domain or a sub-domain of it."""
    if match == "host":
        host = F.lower(F.regexp_extract(link, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
        conds = [(host == d) | host.endswith("." + d) for d in K.SOCIAL_DOMAINS]
    else:
        conds = [F.instr(link, d) > 0 for d in K.SOCIAL_DOMAINS]
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def extract_socials(links: Column, match: str = "substring") -> Column:
    """External links on a social network, distinct in order (#54)."""
    return clean_distinct(F.filter(F.coalesce(links, F.array().cast("array<string>")),
                                   lambda l: is_social(l, match)))


def empty_people() -> Column:
    return F.array().cast("array<struct<name:string,role:string>>")


def outreach_struct(emails: Column, phones: Column, socials: Column, contact_url: Column,
                    people: Column | None = None) -> Column:
    return F.struct(emails.alias("emails"), phones.alias("phones"), socials.alias("socials"),
                    contact_url.cast("string").alias("contact_url"),
                    (people if people is not None else empty_people()).alias("people"))


def fold_phone(outreach: Column, phone: Column) -> Column:
    """Add a discovery-time phone unless a phone with the same digits exists;
    creates an empty outreach when there was none (#61)."""
    base = F.coalesce(outreach, outreach_struct(F.array().cast("array<string>"), F.array().cast("array<string>"),
                                                F.array().cast("array<string>"), F.lit(None)))
    known = F.exists(base["phones"], lambda p: digits(p) == digits(phone))
    added = base.withField("phones", F.concat(base["phones"], F.array(phone)))
    has_phone = phone.isNotNull() & (phone != "")
    return (F.when(~has_phone, outreach)
            .when(known, base)
            .otherwise(added))
