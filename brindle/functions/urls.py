"""What a URL found in a script is, and what it tells: kind, confidence, parameters, joined with a base."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are never URLs, and where static files lie.
NOT_URLS = r"^(?:XMLHttpRequest|_blank|_self|_parent|_top|true|false|null|undefined|[0-9]+)\z"
OTHER_SCHEMES = r"(?i)^(?:javascript|data|mailto|tel):"
STATIC_FILES = ("/favicon.ico", "/manifest.json")
STATIC_FOLDERS = ("/static/", "/assets/", "/images/", "/img/", "/fonts/")
STATIC_SUFFIX = r"\.(?:png|jpe?g|gif|svg|ico|webp|bmp|css|woff2?|ttf|eot|otf)\z"
SCRIPT_SUFFIX, SCRIPT_FOLDER = r"\.m?js\z", r"(?:^|/)(?:static|assets|js|scripts)/"


def _absolute(url: Column) -> Column:
    return url.rlike("(?i)^https?://") | F.startswith(url, F.lit("//"))


def is_request_url(url: Column, templates: bool = False) -> Column:
    """``templates``: also a scheme followed by a placeholder, as resolved expressions have it."""
    bare = F.trim(url)
    good = _absolute(bare) | F.startswith(bare, F.lit("/"))
    if templates:
        good = good | (F.contains(bare, F.lit("${")) & bare.rlike("(?i)^https?:"))
    return F.char_length(bare).between(1, 2048) & ~bare.rlike(NOT_URLS) & ~bare.rlike(OTHER_SCHEMES) & good


def url_kind(url: Column) -> Column:
    path = F.lower(F.substring_index(url, "?", 1))
    static = path.isin(*STATIC_FILES) | path.rlike(STATIC_SUFFIX)
    for folder in STATIC_FOLDERS:
        static = static | F.startswith(path, F.lit(folder))
    static = static | (path.rlike(SCRIPT_SUFFIX) & path.rlike(SCRIPT_FOLDER))
    return F.when(static, "asset").otherwise("api")


def url_confidence(url: Column, kind: Column, rooted: str = "high", absolute: str = "medium") -> Column:
    """Of resolved calls; text scans have ``rooted`` medium and ``absolute`` low."""
    return (F.when(kind == "asset", "low").when(F.startswith(url, F.lit("/")), rooted)
            .when(_absolute(url), absolute).otherwise("low"))


def path_params(url: Column) -> Column:
    """Placeholders of a name or a member first, then names behind a colon."""
    braces = F.regexp_extract_all(url, F.lit(r"\$\{([A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)?)\}"), F.lit(1))
    colons = F.regexp_extract_all(url, F.lit(r":([A-Za-z_$][A-Za-z0-9_$]*)"), F.lit(1))
    return F.concat(braces, colons)


def query_params(url: Column) -> Column:
    query = F.coalesce(F.get(F.split(url, r"\?"), F.lit(1)), F.lit(""))
    names = F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1))
    return F.filter(names, lambda n: n != "")


def host(url: Column) -> Column:
    """With a port that isn't the scheme's own; null if there is none."""
    name = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("AUTHORITY"))), "^.*@", "")
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    bare = F.when(scheme == "https", F.regexp_replace(name, ":443$", "")).when(scheme == "http", F.regexp_replace(name, ":80$", ""))
    return F.coalesce(bare, name)


def normal_base(url: Column) -> Column:
    return F.regexp_replace(F.trim(url), "/+$", "")


def is_base_url(url: Column) -> Column:
    return _absolute(url) | F.startswith(url, F.lit("/"))


def joined_url(base: Column, path: Column) -> Column:
    one = F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(path, "^/+", ""))
    return F.when(_absolute(path), path).otherwise(one)


def is_asset_url(url: Column) -> Column:
    return F.trim(url).rlike(r"(?i)\.(?:js|mjs|css|map)(?:\z|\?)")


def asset_type(url: Column) -> Column:
    path = F.lower(F.substring_index(url, "?", 1))
    return F.when(path.rlike(r"\.m?js\z"), "script").when(F.endswith(path, F.lit(".css")), "style").otherwise("asset")


def chunk_name(url: Column) -> Column:
    """File name without its extension and a hash ahead of that; null without a file name."""
    parts = F.filter(F.split(url, "[/?#]"), lambda x: x != "")
    name = F.get(parts, F.size(parts) - 1)
    return F.regexp_replace(F.regexp_replace(name, r"(?i)\.[a-f0-9]{6,}(?=\.(?:m?js|css|map)\z)", ""), r"(?i)\.(?:m?js|css|map)\z", "")


def pathname(url: Column) -> Column:
    """Path of an absolute url, ``/`` if it has none; null of others."""
    path = F.try_parse_url(url, F.lit("PATH"))
    return F.when(F.try_parse_url(url, F.lit("HOST")).isNotNull(), F.when(F.coalesce(path, F.lit("")) == "", "/").otherwise(path))


__all__ = ["asset_type", "chunk_name", "host", "is_asset_url", "is_base_url", "is_request_url", "joined_url", "normal_base", "path_params", "pathname", "query_params", "url_confidence", "url_kind"]
