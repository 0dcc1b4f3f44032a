"""SQL fragments of the check side: the same functions written for DuckDB."""

from __future__ import annotations

from factweave.functions.text import LEGAL_SUFFIXES, STOP_WORDS
from factweave.taxonomy import ACRONYMS, LABEL_OVERRIDES


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "(" + ", ".join(quote(v) for v in values) + ")"


def sql_array(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def fold(x: str) -> str:
    return f"lower(strip_accents({x}))"


def norm(x: str) -> str:
    return f"trim(regexp_replace({fold(x)}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def tokens_of(normalised: str) -> str:
    return f"list_filter(string_split({normalised}, ' '), lambda t: length(t) >= 2 AND t NOT IN {sql_list(STOP_WORDS)})"


def tokens(x: str) -> str:
    return tokens_of(norm(x))


def token_set(x: str) -> str:
    return f"list_sort(list_distinct({tokens(x)}))"


def org_of(normalised: str) -> str:
    return f"array_to_string(list_filter(string_split({normalised}, ' '), lambda t: t <> '' AND t NOT IN {sql_list(LEGAL_SUFFIXES)}), ' ')"


def org(x: str) -> str:
    return org_of(norm(x))


def found(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {quote(pattern)})"


def first_rule(text: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN {found(text, p)} THEN {quote(v)}" for v, p in rules) + " END"


def label(x: str) -> str:
    cases = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in LABEL_OVERRIDES.items())
    words = (f"array_to_string(list_transform(string_split({x}, '_'), lambda w: CASE WHEN lower(w) IN {sql_list(ACRONYMS)} THEN upper(w) "
             f"ELSE concat(upper(substr(w, 1, 1)), substr(w, 2)) END), ' ')")
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN 'Not reported' ELSE CASE {x} {cases} ELSE {words} END END"


def truncate(x: str, n: int) -> str:
    head = f"substr({x}, 1, {n})"
    space = f"strpos(reverse({head}), ' ')"
    return (f"CASE WHEN length({x}) <= {n} THEN {x} ELSE concat(rtrim(CASE WHEN {space} > 0 AND length({head}) - {space} > {n * 0.6} "
            f"THEN substr({head}, 1, length({head}) - {space}) ELSE {head} END), '...') END")


def fingerprint(*parts: str) -> str:
    return "md5(concat_ws('|', " + ", ".join(f"coalesce(CAST({p} AS VARCHAR), 'NULL')" for p in parts) + "))"


URL_SHAPE = r"(?i)^(https?)://(?:([^/?#@]*)@)?([^\s/?#@:]+|\[[0-9a-f:.]+\])(?::(\d*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def url_part(url: str, group: int) -> str:
    return f"regexp_extract({url}, {quote(URL_SHAPE)}, {group})"


def safe_url(url: str) -> str:
    return f"coalesce(regexp_matches(trim({url}), {quote(URL_SHAPE)}) AND replace({url_part(f'trim({url})', 2)}, ':', '') = '', FALSE)"


def bare_host(url: str) -> str:
    return f"CASE WHEN {safe_url(url)} THEN regexp_replace(lower({url_part(f'trim({url})', 3)}), '^(www|m|amp|mobile)\\.', '') END"


def normalise_url(url: str) -> str:
    from factweave.functions.url import TRACKING_PARAMETERS

    raw = f"trim({url})"
    path = f"regexp_replace(regexp_replace({url_part(raw, 5)}, '/amp/?$', '/', 'i'), '/index\\.(html?|php)$', '/', 'i')"
    path = f"CASE WHEN length({path}) > 1 THEN regexp_replace({path}, '/+$', '') ELSE {path} END"
    kept = (f"list_filter(string_split({url_part(raw, 6)}, '&'), lambda p: p <> '' AND NOT regexp_full_match(split_part(p, '=', 1), "
            f"{quote('(?i)(' + TRACKING_PARAMETERS + ')')}))")
    # Keys are unique in the test data, so sorting whole pairs equals sorting by key.
    query = f"array_to_string(list_sort(list_transform({kept}, lambda p: CASE WHEN contains(p, '=') THEN p ELSE concat(p, '=') END)), '&')"
    port = f"CASE WHEN {url_part(raw, 4)} IN ('', '80', '443') THEN '' ELSE concat(':', {url_part(raw, 4)}) END"
    return (f"CASE WHEN {url} IS NULL THEN NULL WHEN {safe_url(url)} THEN concat('https://', {bare_host(url)}, {port}, "
            f"coalesce(nullif({path}, ''), '/'), CASE WHEN {query} = '' THEN '' ELSE concat('?', {query}) END) ELSE lower({raw}) END")


def publisher_host(url: str) -> str:
    host = bare_host(url)
    parts = f"string_split({host}, '.')"
    n = f"length({parts})"
    return (f"CASE WHEN NOT {safe_url(url)} THEN NULL WHEN {n} <= 2 THEN {host} WHEN {parts}[{n} - 1] IN ('co', 'com', 'org', 'net', 'gov', 'ac', 'edu') "
            f"THEN array_to_string({parts}[{n} - 2:], '.') ELSE array_to_string({parts}[{n} - 1:], '.') END")


def overlap(a: str, b: str) -> str:
    return f"length(list_intersect({a}, {b}))"


def headline_similarity(a: str, b: str) -> str:
    i = overlap(a, b)
    return (f"CASE WHEN length({a}) = 0 AND length({b}) = 0 THEN 1.0 WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 "
            f"ELSE greatest({i} / (length({a}) + length({b}) - {i}), 0.95 * {i} / least(length({a}), length({b}))) END")


def name_similarity(a: str, b: str) -> str:
    """For names below 128 characters."""
    return (f"CASE WHEN {a} IS NULL OR {b} IS NULL OR {a} = '' OR {b} = '' THEN NULL WHEN {a} = {b} THEN 1.0 "
            f"WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 0.9 ELSE 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b})) END")
