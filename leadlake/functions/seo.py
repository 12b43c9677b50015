"""On-page SEO audit as one struct-valued column expression (#59)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


from leadlake import constants as K
from leadlake.functions.html import has_markdown_h1, word_count
from leadlake.functions.regex import blank_to_null


@dataclass(frozen=True)
class AuditRules:
    """Audit thresholds and points (defaults = the application's rules)."""
    points: dict = field(default_factory=lambda: dict(K.AUDIT_POINTS))
    title_min: int = K.TITLE_MIN
    title_max: int = K.TITLE_MAX
    description_min: int = K.DESCRIPTION_MIN
    description_max: int = K.DESCRIPTION_MAX
    thin_words: int = K.THIN_WORDS
    cap: int = 100


def _fmt(template: str, value: Column) -> Column:
    head, tail = template.split("{}")
    return F.concat(F.lit(head), value.cast("string"), F.lit(tail))


def audit_seo(*, final_url: Column, status_code: Column, title: Column, og_title: Column,
              description: Column, og_description: Column, og_image: Column, favicon: Column,
              text: Column, requested_url: Column, has_h1: Column | None = None,
              words: Column | None = None, rules: AuditRules = AuditRules()) -> Column:
    """Audit struct: the 12 signals, the ordered issue list and the opportunity
    score (points, capped). ``has_h1`` defaults to the markdown-heading test."""
    p = rules.points
    furl = F.coalesce(blank_to_null(final_url), requested_url)
    https_ok = F.coalesce(furl.startswith("https://"), F.lit(False))
    t = F.coalesce(blank_to_null(title), blank_to_null(og_title))
    tlen = F.coalesce(F.length(t), F.lit(0))
    d = F.coalesce(blank_to_null(description), blank_to_null(og_description))
    dlen = F.coalesce(F.length(d), F.lit(0))
    h1 = has_h1 if has_h1 is not None else has_markdown_h1(text)
    words = words if words is not None else word_count(text)
    has_og_title = blank_to_null(og_title).isNotNull()
    has_og_image = blank_to_null(og_image).isNotNull()
    has_fav = blank_to_null(favicon).isNotNull()
    status = status_code.cast("int")
    http_error = F.coalesce((status != 0) & (status >= 400), F.lit(False))

    rules_ = [
        (~https_ok, F.lit(K.ISSUE_NOT_HTTPS), p["not_https"]),
        (t.isNull(), F.lit(K.ISSUE_NO_TITLE), p["no_title"]),
        (t.isNotNull() & (tlen < rules.title_min), _fmt(K.ISSUE_TITLE_SHORT, tlen), p["title_short"]),
        (t.isNotNull() & (tlen > rules.title_max), _fmt(K.ISSUE_TITLE_LONG, tlen), p["title_long"]),
        (d.isNull(), F.lit(K.ISSUE_NO_DESCRIPTION), p["no_description"]),
        (d.isNotNull() & (dlen < rules.description_min), _fmt(K.ISSUE_DESCRIPTION_SHORT, dlen), p["description_short"]),
        (d.isNotNull() & (dlen > rules.description_max), _fmt(K.ISSUE_DESCRIPTION_LONG, dlen), p["description_long"]),
        (~h1, F.lit(K.ISSUE_NO_H1), p["no_h1"]),
        (~(has_og_title & has_og_image), F.lit(K.ISSUE_NO_OG), p["no_og"]),
        (~has_fav, F.lit(K.ISSUE_NO_FAVICON), p["no_favicon"]),
        ((words > 0) & (words < rules.thin_words), _fmt(K.ISSUE_THIN, words), p["thin"]),
        (http_error, _fmt(K.ISSUE_HTTP, status), p["http_error"]),
    ]
    # flatten of 0/1-element arrays keeps the projection code-generated (no lambda)
    empty = F.array().cast("array<string>")
    issues = F.flatten(F.array(*[F.when(c, F.array(msg)).otherwise(empty) for c, msg, _ in rules_]))
    points = sum((F.when(c, F.lit(pts)).otherwise(F.lit(0)) for c, _, pts in rules_), F.lit(0))
    return F.struct(
        furl.alias("final_url"), https_ok.alias("https_ok"), status.alias("status_code"),
        t.alias("title"), tlen.alias("title_length"), d.alias("description"),
        dlen.alias("description_length"), h1.alias("has_h1"), has_og_title.alias("has_og_title"),
        has_og_image.alias("has_og_image"), has_fav.alias("has_favicon"), words.alias("word_count"),
        issues.alias("issues"), F.least(points, F.lit(rules.cap)).alias("opportunity_score"),
    )
