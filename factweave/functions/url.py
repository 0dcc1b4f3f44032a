"""URL expressions: safety test, comparison key, publisher host, redirect unwrapping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: query parameters that only track the reader ------------------------------------
TRACKING_PARAMETERS = (
    r"utm_.*|ga_.*|gclid|gbraid|wbraid|fbclid|msclkid|mc_cid|mc_eid|igshid|ref|referrer|cmpid|ncid|smid|spm|"
    r"__twitter_impression|guccounter|guce_referrer.*|at_medium|at_campaign|amp"
)
REDIRECT_PARAMETERS = ("url", "u", "target", "redirect")
DEVICE_PREFIX = r"^(www|m|amp|mobile)\."
SECOND_LEVEL_LABELS = ("co", "com", "org", "net", "gov", "ac", "edu")

_SHAPE = r"(?i)^(https?)://(?:([^/?#@]*)@)?([^\s/?#@:]+|\[[0-9a-f:.]+\])(?::(\d*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_USERINFO, _HOST, _PORT, _PATH, _QUERY = 2, 3, 4, 5, 6


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _SHAPE, group)


def is_safe_url(url: Column) -> Column:
    """http or https, a host, and no embedded credentials. NULL input gives false."""
    trimmed = F.trim(url)
    no_login = F.regexp_replace(_part(trimmed, _USERINFO), ":", "") == ""
    return F.coalesce(trimmed.rlike(_SHAPE) & no_login, F.lit(False))


def url_host(url: Column) -> Column:
    """Lower-case host of a safe URL, else NULL."""
    return F.when(is_safe_url(url), F.lower(_part(F.trim(url), _HOST)))


def bare_host(url: Column) -> Column:
    """Host without one leading device label (www, m, amp, mobile)."""
    return F.regexp_replace(url_host(url), DEVICE_PREFIX, "")


def _parameters(query: Column) -> Column:
    """Query string as an array of struct(key, position, value), decoded."""
    pieces = F.filter(F.split(query, "&"), lambda p: p != "")
    decode = lambda c: F.coalesce(F.try_url_decode(c), c)
    return F.transform(
        pieces,
        lambda p, i: F.struct(
            decode(F.substring_index(p, "=", 1)).alias("key"),
            i.alias("position"),
            decode(F.regexp_replace(p, "^[^=]*=?", "")).alias("value"),
        ),
    )


def normalise_url(url: Column) -> Column:
    """Comparison key: https, no device label, default port, tracking, fragment or trailing clutter."""
    raw = F.trim(url)
    host = F.regexp_replace(F.lower(_part(raw, _HOST)), DEVICE_PREFIX, "")
    port = _part(raw, _PORT)
    port = F.when(port.isin("", "80", "443"), F.lit("")).otherwise(F.concat(F.lit(":"), port))
    path = F.regexp_replace(_part(raw, _PATH), r"(?i)/amp/?$", "/")
    path = F.regexp_replace(path, r"(?i)/index\.(html?|php)$", "/")
    path = F.when(F.length(path) > 1, F.regexp_replace(path, r"/+$", "")).otherwise(path)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    kept = F.filter(_parameters(_part(raw, _QUERY)), lambda p: ~p["key"].rlike(f"(?i)^({TRACKING_PARAMETERS})$"))
    pairs = F.transform(F.array_sort(kept), lambda p: F.concat(F.url_encode(p["key"]), F.lit("="), F.url_encode(p["value"])))
    query = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(F.lit(""))
    return F.when(is_safe_url(url), F.concat(F.lit("https://"), host, port, path, query)).otherwise(F.lower(raw))


def publisher_host(url: Column) -> Column:
    """Last two labels of the host, three under a generic second level; NULL for an unsafe URL."""
    host = bare_host(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    keep = F.when(F.element_at(labels, F.greatest(n - 1, F.lit(1))).isin(*SECOND_LEVEL_LABELS), F.lit(3)).otherwise(F.lit(2))
    return F.when(n <= 2, host).otherwise(F.array_join(F.slice(labels, -keep, keep), "."))


def host_suffixes(host: Column) -> Column:
    """The host and every parent domain, longest first: a.b.c -> [a.b.c, b.c, c]."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def query_parameter(url: Column, name: str) -> Column:
    """Decoded first value of one query parameter, NULL when absent."""
    first = F.try_element_at(F.filter(_parameters(_part(F.trim(url), _QUERY)), lambda p: p["key"] == name), F.lit(1))
    return first["value"]


def unwrap_redirect(url: Column) -> Column:
    """Destination carried in a redirect parameter when it is itself a safe URL, else the URL."""
    options = [query_parameter(url, name) for name in REDIRECT_PARAMETERS]
    inner = F.coalesce(*[F.when(is_safe_url(o), o) for o in options], url)
    return F.when(is_safe_url(url), inner).otherwise(url)
