"""URL functions and predicates as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of assets, language segments, blocked paths and parameters.
ASSET_SUFFIXES = (
    ".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".ico", ".css", ".js", ".json",
    ".xml", ".pdf", ".zip", ".mp4", ".mp3", ".woff", ".woff2", ".ttf", ".eot",
)
ENGLISH_SEGMENTS = ("en", "en-us", "en-gb")
OTHER_LANGUAGE_SEGMENTS = (
    "ar", "ar-sa", "bn", "de", "es", "fr", "fr-fr", "gu", "hi", "hi-in", "id", "it",
    "ja", "kn", "ko", "ml", "mr", "nl", "pa", "pl", "pt", "ru", "ta", "te", "th",
    "tr", "vi", "zh", "zh-cn", "zh-tw",
)
BLOCKED_SEGMENTS = ("cart", "checkout", "account", "search")
BLOCKED_PATHS = ("/cart", "/checkout", "/account", "/search", "/collections/all")
BLOCKED_PARAMETERS = ("variant=", "sort=", "page=")

#: scheme, authority, path, query of RFC 3986 (appendix B).
_PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(F.trim(F.coalesce(url, F.lit(""))), _PARTS, i)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host(url: Column) -> Column:
    """Authority in lower case without one leading www."""
    return F.regexp_replace(F.lower(F.trim(_part(url, 2))), r"^www\.", "")


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def normalize_url(url: Column) -> Column:
    """https by default, host folded, no fragment, no trailing slashes except the root's."""
    s = F.when(scheme(url) == "", F.lit("https")).otherwise(scheme(url))
    p = F.regexp_replace(path(url), r";[^/]*$", "")
    p = F.when(p.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(p, "/+$", ""))
    q = F.when(query(url) == "", F.lit("")).otherwise(F.concat(F.lit("?"), query(url)))
    return F.concat(s, F.lit("://"), host(url), p, q)


def is_valid_url(url: Column) -> Column:
    return scheme(url).isin("http", "https") & (_part(url, 2) != "")


def is_asset_url(url: Column) -> Column:
    p = F.lower(path(url))
    out = F.lit(False)
    for s in ASSET_SUFFIXES:
        out = out | p.endswith(s)
    return out


def same_domain(a: Column, b: Column) -> Column:
    return host(a) == host(b)


def same_url(a: Column, b: Column) -> Column:
    return normalize_url(a) == normalize_url(b)


def sitemap_url(root: Column) -> Column:
    n = normalize_url(root)
    return F.concat(scheme(n), F.lit("://"), host(n), F.lit("/sitemap.xml"))


def is_english_url(url: Column) -> Column:
    """By the first path segment: language codes other than English are rejected."""
    p = F.regexp_replace(path(normalize_url(url)), "^/+|/+$", "")
    first = F.regexp_replace(F.lower(F.element_at(F.split(p, "/", 2), 1)), "_", "-")
    return (
        F.when(p == "", F.lit(True))
        .when(first.isin(*OTHER_LANGUAGE_SEGMENTS), F.lit(False))
        .when(first.isin(*ENGLISH_SEGMENTS), F.lit(True))
        .otherwise(~first.rlike("^[a-z]{2}(?:-[a-z]{2})?$"))
    )


def skip_reason(url: Column, strict_parameters: bool = False) -> Column:
    """Why a URL isn't crawled, or null.

    Parameters count as blocked only without a value, unless ``strict_parameters``.
    """
    p = F.regexp_replace(F.lower(path(url)), "/+$", "")
    segments = F.filter(F.split(p, "/"), lambda s: s != "")
    first, second = F.try_element_at(segments, F.lit(1)), F.try_element_at(segments, F.lit(2))
    q = F.lower(query(url))
    out = F.when(first.isin(*BLOCKED_SEGMENTS), F.concat(F.lit("blocked path "), first)).when(
        (first == "collections") & (second == "all"), F.lit("blocked path collections/all")
    )
    for b in BLOCKED_PARAMETERS:
        pattern = rf"(?:^|&){b}" if strict_parameters else rf"(?:^|&){b}(?:=|&|$)"
        out = out.when(q.rlike(pattern), F.lit(f"blocked query parameter {b}"))
    for b in BLOCKED_PATHS:
        out = out.when(F.contains(p, F.lit(b)), F.lit(f"blocked path {b}"))
    return out


def allowed_domain(host_name: Column, domains: Column) -> Column:
    """An empty list allows all; else the domain itself or one below it."""
    h = F.lower(host_name)
    return (F.size(domains) == 0) | F.exists(domains, lambda d: (h == d) | h.endswith(F.concat(F.lit("."), d)))


def origin_allowed(host_name: Column, domains: Column) -> Column:
    """As ``allowed_domain``, but no host is no, and entries may begin with a wildcard."""
    h = F.lower(F.trim(F.coalesce(host_name, F.lit(""))))
    clean = F.transform(domains, lambda d: F.regexp_replace(F.lower(F.trim(d)), r"^\*\.", ""))
    return (h != "") & allowed_domain(h, clean)


def private_host(host_name: Column) -> Column:
    return F.lower(host_name).rlike(r"^(localhost$|127\.|10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)")


def slug(text: Column, most: int = 40) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.substring(s, 1, most)


def snapshot_name(url: Column) -> Column:
    """A file name from host, path and a short digest of the URL."""
    p = F.regexp_replace(F.regexp_replace(path(url), "^/+|/+$", ""), "/", "_")
    p = F.when(p == "", F.lit("home")).otherwise(p)
    name = F.concat(_part(url, 2), F.lit("_"), p, F.lit("_"), F.substring(F.sha2(url, 256), 1, 10), F.lit(".html"))
    return F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "_")


def gateway_url(url: Column) -> Column:
    """The gateway's key of a URL: host folded without port, one trailing slash and the fragment go; what is no URL stays, trimmed."""
    authority = F.regexp_replace(F.regexp_replace(host(url), "^[^@]*@", ""), r":\d*$", "")
    p = F.when(path(url) == "", F.lit("/")).when(path(url) == "/", F.lit("/")).otherwise(F.regexp_replace(path(url), "/$", ""))
    q = F.when(query(url) == "", F.lit("")).otherwise(F.concat(F.lit("?"), query(url)))
    return F.when(is_valid_url(url), F.concat(scheme(url), F.lit("://"), F.regexp_replace(authority, r"^www\.", ""), p, q)).otherwise(F.trim(url))


def domain_name(entry: Column) -> Column:
    """The host in a list of domains: scheme, www., port and path go; blank gives empty."""
    t = F.lower(F.trim(F.coalesce(entry, F.lit(""))))
    full = F.when(t == "", F.lit("")).when(F.contains(t, F.lit("://")), t).otherwise(F.concat(F.lit("https://"), t))
    return F.regexp_replace(host(full), r":\d*$", "")


def domain_names(entries: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.coalesce(entries, F.array().cast("array<string>")), domain_name), lambda d: d != ""))


def folder_name(name: Column, most: int = 40) -> Column:
    """A name for a folder; null and empty give "site"."""
    s = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9._-]", "-"), r"\.+", "-")
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("site")).otherwise(F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, most))
