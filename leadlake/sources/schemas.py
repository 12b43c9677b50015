"""Declared schemas (never inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()
I = T.IntegerType()
L = T.LongType()
B = T.BooleanType()
D = T.DoubleType()
TS = T.TimestampType()
ARR_S = T.ArrayType(S)

PAGES = T.StructType([
    T.StructField("page_id", L), T.StructField("url", S), T.StructField("html", S),
])

# One search hit as captured from a provider; rank is the 1-based position.
SERP = T.StructType([
    T.StructField("provider_ord", I), T.StructField("query", S), T.StructField("rank", I),
    T.StructField("url", S), T.StructField("title", S), T.StructField("description", S),
])
# Raw provider payload: one JSON object per (provider, query).
SERP_JSON = T.StructType([
    T.StructField("provider", S), T.StructField("query", S), T.StructField("page", I), T.StructField("num", I),
    T.StructField("results", T.ArrayType(T.StructType([
        T.StructField("url", S), T.StructField("title", S), T.StructField("description", S),
    ]))),
])

PLACE = T.StructType([
    T.StructField("displayName", T.StructType([T.StructField("text", S)])),
    T.StructField("websiteUri", S),
    T.StructField("nationalPhoneNumber", S),
    T.StructField("internationalPhoneNumber", S),
    T.StructField("formattedAddress", S),
    T.StructField("rating", D),
    T.StructField("userRatingCount", L),
])
# Raw places payload: one JSON object per (query, page).
PLACES_JSON = T.StructType([
    T.StructField("query", S), T.StructField("page_no", I),
    T.StructField("places", T.ArrayType(PLACE)), T.StructField("nextPageToken", S),
])

PERSON = T.StructType([T.StructField("name", S), T.StructField("role", S)])
OUTREACH = T.StructType([
    T.StructField("emails", ARR_S), T.StructField("phones", ARR_S), T.StructField("socials", ARR_S),
    T.StructField("contact_url", S), T.StructField("people", T.ArrayType(PERSON)),
])
SEO = T.StructType([
    T.StructField("final_url", S), T.StructField("https_ok", B), T.StructField("status_code", I),
    T.StructField("title", S), T.StructField("title_length", I), T.StructField("description", S),
    T.StructField("description_length", I), T.StructField("has_h1", B),
    T.StructField("has_og_title", B), T.StructField("has_og_image", B),
    T.StructField("has_favicon", B), T.StructField("word_count", I),
    T.StructField("issues", ARR_S), T.StructField("opportunity_score", I),
])

SPECS = T.StructType([
    T.StructField("spec_ord", I), T.StructField("niche", S), T.StructField("location", S),
    T.StructField("lim", I), T.StructField("channels", ARR_S),
])

SEARCHES = T.StructType([
    T.StructField("id", L), T.StructField("niche", S), T.StructField("location", S),
    T.StructField("lim", I), T.StructField("channels", ARR_S), T.StructField("label", S),
    T.StructField("active", B), T.StructField("created_at", TS),
])

RUNS = T.StructType([
    T.StructField("id", L), T.StructField("started_at", TS), T.StructField("finished_at", TS),
    T.StructField("status", S), T.StructField("search_count", I), T.StructField("lead_count", I),
    T.StructField("enrich", B), T.StructField("error", S),
])

LEAD = T.StructType([
    T.StructField("name", S), T.StructField("website", S), T.StructField("domain", S),
    T.StructField("description", S), T.StructField("query", S), T.StructField("channels", ARR_S),
    T.StructField("outreach", OUTREACH), T.StructField("seo", SEO), T.StructField("score", I),
    T.StructField("score_reasons", ARR_S),
])

STORED_LEAD = T.StructType([
    T.StructField("id", L), T.StructField("name", S), T.StructField("domain", S),
    T.StructField("website", S), T.StructField("description", S), T.StructField("query", S),
    T.StructField("channels", ARR_S), T.StructField("outreach", OUTREACH), T.StructField("seo", SEO),
    T.StructField("score", I), T.StructField("opportunity_score", I), T.StructField("issues_count", I),
    T.StructField("has_email", B), T.StructField("score_reasons", ARR_S), T.StructField("status", S),
    T.StructField("notes", S), T.StructField("run_id", L), T.StructField("created_at", TS),
    T.StructField("updated_at", TS),
])

GEO = T.StructType([
    T.StructField("country_code", S), T.StructField("country", S), T.StructField("state_code", S),
    T.StructField("state", S), T.StructField("city", S),
])
