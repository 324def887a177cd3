"""URL expressions: everything that needs no resolution or IDNA is a Column expression."""

from __future__ import annotations

import ipaddress
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Query keys that only track, suffixes of two labels, file endings, path segments and
# host labels that a search leaves out.
TRACKING_KEYS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "spm", "from", "source")
TWO_LABEL_SUFFIXES = ("com.cn", "net.cn", "org.cn", "gov.cn", "co.uk", "org.uk", "com.au", "co.jp")
BINARY_SUFFIXES = (".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".pdf", ".zip", ".rar", ".7z", ".mp4", ".mp3", ".css", ".js")
AUTH_SEGMENTS = ("login", "signin", "register", "passport", "user")
EXCLUDED_LABELS = ("ad", "ads", "advert", "login", "passport", "account", "shop", "mall", "pay", "cps", "tracking")
BINARY_EXTENSIONS = (
    "jpg", "jpeg", "png", "gif", "svg", "webp", "ico", "bmp", "pdf", "zip", "rar", "7z", "tar", "gz",
    "mp4", "mp3", "avi", "mov", "webm", "wav", "css", "js", "json", "xml", "woff", "woff2", "ttf", "eot",
)
INDEX_NAMES = ("index.shtml", "index.html", "index.htm")

_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!$)|$)){4}$"


def strings(*values: str) -> Column:
    return F.array(*map(F.lit, values))


def _clean(url: Column) -> Column:
    trimmed = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?U)^[\s\x00-\x1f]+|[\s\x00-\x1f]+$", "")
    return F.regexp_replace(trimmed, "[\t\r\n]", "")


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(_clean(url), "(?s)" + _SPLIT, n)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def netloc(url: Column) -> Column:
    return _part(url, 2)


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def _host_port(url: Column) -> Column:
    return F.regexp_replace(netloc(url), "^.*@", "")


def _host_of(at: Column) -> Column:
    bracketed = F.regexp_extract(at, r"^\[([^\]]*)\]", 1)
    return F.lower(F.when(F.startswith(at, F.lit("[")), bracketed).otherwise(F.regexp_extract(at, "^[^:]*", 0)))


def _port_of(at: Column) -> Column:
    return F.regexp_extract(at, r"^(?:\[[^\]]*\]|[^:]*):([0-9]+)$", 1).try_cast("int")


def _is_well_formed(at: Column, port: Column) -> Column:
    shape = F.rlike(at, F.lit(r"^(?:\[[0-9A-Fa-f:.]+\]|[^\[\]:]*)(?::[0-9]{0,9})?$"))
    return shape & (F.coalesce(port, F.lit(0)) <= 65535)


def host(url: Column) -> Column:
    """Lower-cased, without user, port and IPv6 brackets; '' if there is none."""
    return _host_of(_host_port(url))


def port(url: Column) -> Column:
    """The port that is written, as int; null if there is none or it is no number."""
    return _port_of(_host_port(url))


def well_formed(url: Column) -> Column:
    """Whether the authority can be taken apart (ports up to 65535, brackets in pairs)."""
    return _is_well_formed(_host_port(url), port(url))


def has_user(url: Column) -> Column:
    return F.contains(netloc(url), F.lit("@"))


def _decode(x: Column) -> Column:
    return F.url_decode(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def quote(x: Column) -> Column:
    """Percent-encoding that keeps ``/`` and ``~``."""
    return F.replace(F.replace(_encode(x), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def query_pairs(url: Column) -> Column:
    """array<struct<key, value>> in order, decoded; blank values stay, empty parts go."""
    return _pairs_of(query(url))


def _pairs_of(query: Column) -> Column:
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    at = lambda p: F.instr(p, "=")
    return F.transform(
        parts,
        lambda p: F.struct(
            _decode(F.when(at(p) > 0, F.substr(p, F.lit(1), at(p) - 1)).otherwise(p)).alias("key"),
            _decode(F.when(at(p) > 0, F.substr(p, at(p) + 1)).otherwise(F.lit(""))).alias("value"),
        ),
    )


def _let(x: Column, body) -> Column:
    """body(x), with x worked out once."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def normalize(url: Column) -> Column:
    """The key of a URL: no fragment and tracking keys, scheme and host lower-cased, trailing slashes
    gone, query sorted by key (equal keys keep their order); '' if it can't be taken apart."""
    part = lambda x, n: F.regexp_extract(x, "(?s)" + _SPLIT, n)
    split = _let(_clean(url), lambda x: F.struct(F.lower(part(x, 1)).alias("scheme"), part(x, 2).alias("netloc"), part(x, 3).alias("path"), part(x, 4).alias("query")))
    with_at = _let(split, lambda x: F.struct(x.alias("url"), F.regexp_replace(x["netloc"], "^.*@", "").alias("at")))
    whole = _let(with_at, lambda x: F.struct(x["url"].alias("url"), x["at"].alias("at"), _host_of(x["at"]).alias("host"), _port_of(x["at"]).alias("port")))
    return _let(whole, _normalized)


def _normalized(x: Column) -> Column:
    """x: url (struct of scheme, netloc, path, query), at (netloc without user), host and port."""
    url, host, port = x["url"], x["host"], x["port"]
    kept = F.filter(_pairs_of(url["query"]), lambda q: ~F.lower(q["key"]).isin(*TRACKING_KEYS))
    numbered = F.transform(kept, lambda q, i: F.struct(q["key"].alias("key"), i.alias("i"), q["value"].alias("value")))
    encoded = F.transform(F.array_sort(numbered), lambda q: F.concat(_encode(q["key"]), F.lit("="), _encode(q["value"])))
    search = F.when(url["query"] == "", "").otherwise(F.array_join(encoded, "&"))
    raw_path = F.when(url["path"] == "", F.lit("/")).otherwise(url["path"])
    short_path = F.when(raw_path == "/", raw_path).otherwise(F.regexp_replace(raw_path, "/+$", ""))
    user = F.regexp_extract(url["netloc"], "^(?:.*@)?", 0)
    name = F.when(F.contains(host, F.lit(":")), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    authority = F.concat(user, name, F.when(port.isNotNull(), F.concat(F.lit(":"), port.cast("string"))).otherwise(""))
    whole = F.concat(
        F.when(url["scheme"] != "", F.concat(url["scheme"], F.lit(":"))).otherwise(""),
        F.when(url["netloc"] != "", F.concat(F.lit("//"), authority)).otherwise(""),
        short_path,
        _let(search, lambda s: F.when(s != "", F.concat(F.lit("?"), s)).otherwise("")),
    )
    return F.when(_is_well_formed(x["at"], port), whole).otherwise("")


def is_ip(name: Column) -> Column:
    return F.rlike(name, F.lit(_IPV4)) | F.contains(name, F.lit(":"))


def ascii_host(name: Column) -> Column:
    """Canonical form of an ASCII host: lower-cased, no trailing dots, null if empty."""
    return F.nullif(F.regexp_replace(F.lower(name), r"\.+$", ""), F.lit(""))


@F.pandas_udf(T.StringType())
def canonical_host(names: pd.Series) -> pd.Series:
    """ascii_host for any host: IDNA names in ASCII, IP addresses compressed, null if invalid."""

    def one(name):
        name = (name or "").lower().rstrip(".")
        try:
            return ipaddress.ip_address(name).compressed
        except ValueError:
            pass
        try:
            return name.encode("idna").decode("ascii").lower() or None
        except UnicodeError:
            return None

    return names.map(one)


def authority(url: Column) -> Column:
    """struct<host, port> of an http(s) URL without a user, the port's default filled in; else null."""
    usual = F.when(scheme(url) == "https", 443).otherwise(80)
    valid = scheme(url).isin("http", "https") & ~has_user(url) & well_formed(url) & ascii_host(host(url)).isNotNull()
    return F.when(valid, F.struct(ascii_host(host(url)).alias("host"), F.coalesce(port(url), usual).alias("port")))


def registrable_domain(name: Column) -> Column:
    labels = F.split(F.regexp_replace(F.lower(name), r"^\.+|\.+$", ""), r"\.")
    last = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    return (
        F.when(F.size(labels) <= 2, F.array_join(labels, "."))
        .when(last(2).isin(*TWO_LABEL_SUFFIXES), last(3))
        .otherwise(last(2))
    )


def same_site(a: Column, b: Column) -> Column:
    """One registrable domain, or the same IP address."""
    x, y = authority(a)["host"], authority(b)["host"]
    same = F.when(is_ip(x) | is_ip(y), x == y).otherwise(registrable_domain(x) == registrable_domain(y))
    return F.coalesce(same, F.lit(False))


def is_html_candidate(url: Column) -> Column:
    low = F.lower(path(url))
    ending = F.rlike(low, F.lit("(?:" + "|".join(s.replace(".", r"\.") for s in BINARY_SUFFIXES) + ")$"))
    auth = F.arrays_overlap(F.split(low, "/"), strings(*AUTH_SEGMENTS))
    return well_formed(url) & scheme(url).isin("http", "https") & (netloc(url) != "") & ~ending & ~auth


def file_name(url: Column) -> Column:
    return F.substring_index(path(url), "/", -1)


def is_binary(url: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(url), r"\.([^.]*)$", 1)).isin(*BINARY_EXTENSIONS)


def _page_name(url: Column) -> Column:
    return F.lower(F.substring_index(F.regexp_replace(path(url), "/+$", ""), "/", -1))


def _is_query_hub(url: Column) -> Column:
    return (query(url) != "") & (_page_name(url) != "") & ~F.contains(_page_name(url), F.lit("."))


def is_hub(url: Column) -> Column:
    return _page_name(url).isin(*INDEX_NAMES) | _is_query_hub(url)


def is_article(url: Column) -> Column:
    return F.rlike(_page_name(url), F.lit(r"\.s?html?$")) & ~_page_name(url).isin(*INDEX_NAMES)


def link_rank(url: Column) -> Column:
    """Listings by query first, then index pages, articles, the rest."""
    return F.when(_is_query_hub(url), 0).when(_page_name(url).isin(*INDEX_NAMES), 1).when(is_article(url), 2).otherwise(3)


def redacted(url: Column) -> Column:
    """scheme://host[:port]/path: no user, query or fragment, and no port that is the scheme's own."""
    usual = ((scheme(url) == "https") & (port(url) == 443)) | ((scheme(url) == "http") & (port(url) == 80))
    tail = F.when(port(url).isNotNull() & ~usual, F.concat(F.lit(":"), port(url).cast("string"))).otherwise("")
    return F.concat(scheme(url), F.lit("://"), host(url), tail, F.when(path(url) == "", "/").otherwise(path(url)))


def host_key(url: Column) -> Column:
    """host:port, to deal requests out by."""
    return F.concat_ws(":", authority(url)["host"], authority(url)["port"].cast("string"))


def url_allowed(url: Column, root_host: str, allowed=(), excluded=(), related: bool = False) -> Column:
    """Whether a domain policy lets a search read the URL."""
    name = F.regexp_replace(host(url), r"\.+$", "")
    fold = lambda names: [n.lower().rstrip(".") for n in names]
    barred = name.isin(*fold(excluded)) if excluded else F.lit(False)
    explicit = (name.isin(*fold(allowed)) if allowed else F.lit(False)) & ~barred
    near = F.lit(related) & ~barred & ~F.arrays_overlap(F.split(name, "[-.]"), strings(*EXCLUDED_LABELS))
    near = near & (registrable_domain(name) == registrable_domain(F.lit(root_host)))
    return is_html_candidate(url) & (name != "") & (explicit | near)


@F.pandas_udf(T.StringType())
def join_url(base: pd.Series, target: pd.Series) -> pd.Series:
    """A reference resolved against its page (RFC 3986); '' if that fails."""

    def one(b, t):
        try:
            return urljoin(b or "", t or "")
        except ValueError:
            return ""

    return pd.Series([one(b, t) for b, t in zip(base, target, strict=True)], dtype=object)
