"""URL identity as Column expressions: canonical form, variants, job key, scope, host rules.

All of it stays inside the JVM, so predicates on these columns can still be pushed and generated as code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .addresses import is_private_ip

# RFC 3986, appendix B: groups 2 scheme, 4 authority, 5 path, 7 query, 9 fragment.
PARTS = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"

# Query keys that take part in a page's identity.
KEPT_KEYS = ("pageId", "spaceKey", "title")

# Page actions that edit rather than show.
EDIT_ACTIONS = ("editpage.action", "createpage.action", "editblogpost.action")

# Hosts that a start URL may not name.
BLOCKED_HOSTS = ("localhost", "127.0.0.1", "0.0.0.0", "::1", "[::1]", "169.254.169.254", "metadata.google.internal", "metadata.azure.com")


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, PARTS, k)


def strip(c: Column) -> Column:
    """Trim Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 2))


def host(url: Column) -> Column:
    return F.lower(_part(url, 4))


def path(url: Column) -> Column:
    return _part(url, 5)


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def query_pairs(query: Column) -> Column:
    """array<struct<k,v>> of a query string, decoded; blank values stay, empty pieces go."""
    pieces = F.filter(F.split(query, "&", -1), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(_decode(F.substring_index(p, "=", 1)).alias("k"), F.when(F.contains(p, F.lit("=")), _decode(F.regexp_replace(p, "^[^=]*=", ""))).otherwise("").alias("v")))


def query_value(url: Column, key: str) -> Column:
    """First value of a query key, null if absent."""
    return F.get(F.filter(query_pairs(_part(url, 7)), lambda p: p["k"] == key), F.lit(0))["v"]


def _build(s: Column, authority: Column, p: Column, q: Column) -> Column:
    return F.concat(F.when(s != "", F.concat(s, F.lit(":"))).otherwise(""), F.when(authority != "", F.concat(F.lit("//"), authority)).otherwise(""), p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def canonical(url: Column) -> Column:
    """Canonical page URL. Apply once: values are decoded, so a second pass may read them differently."""
    u = strip(url)
    p = F.regexp_replace(F.when(path(u) == "", "/").otherwise(path(u)), "/+", "/")
    kept = F.array_sort(F.filter(query_pairs(_part(u, 7)), lambda x: x["k"].isin(*KEPT_KEYS)))
    q = F.array_join(F.transform(kept, lambda x: F.concat(x["k"], F.lit("="), x["v"])), "&")
    return _build(scheme(u), _part(u, 4), p, q)


def display_variant(url: Column) -> Column:
    """The page's other display form, with or without /public; null if it has none."""
    p = path(url)
    swap = F.when(p.startswith("/display/public/"), F.regexp_replace(p, "^/display/public/", "/display/")).when(p.startswith("/display/"), F.regexp_replace(p, "^/display/", "/display/public/"))
    tail = F.concat(F.when(_part(url, 6) != "", _part(url, 6)).otherwise(""), _part(url, 8))
    return F.concat(_build(scheme(url), _part(url, 4), F.lit(""), F.lit("")), swap, tail)


def page_key(url: Column) -> Column:
    """One key for both display forms, so that a lookup of either is an equi-join."""
    return F.regexp_replace(url, "^([^:/?#]+://[^/?#]*)/display/public/", "$1/display/")


def start_url_key(url: Column) -> Column:
    """Key of a job: no scheme, host in lower case, one display form, no trailing slash."""
    c = canonical(F.coalesce(url, F.lit("")))
    p = F.regexp_replace(F.regexp_replace(path(c), "^(.*?)/display/public/", "$1/display/"), "/+$", "")
    return F.concat(host(c), p, F.lit("?"), _part(c, 7))


def scope(url: Column) -> Column:
    """struct<domain, path_prefix, space_key> of a start URL."""
    parts = F.filter(F.split(path(url), "/", -1), lambda x: x != "")
    at = lambda i: F.get(parts, F.lit(i))
    n = F.size(parts)
    public = (n >= 3) & (at(0) == "display") & (at(1) == "public")
    short = (n >= 2) & at(0).isin("display", "spaces")
    key = F.when(public, at(2)).when(short, at(1))
    prefix = F.when(public, F.concat(F.lit("/display/public/"), at(2), F.lit("/"))).when(short, F.concat(F.lit("/"), at(0), F.lit("/"), at(1), F.lit("/"))).otherwise("/")
    return F.struct(host(url).alias("domain"), prefix.alias("path_prefix"), key.alias("space_key"))


def in_scope(url: Column, domain: Column, path_prefix: Column, space_key: Column) -> Column:
    p = F.when(path(url) == "", "/").otherwise(path(url))
    shown = F.startswith(p, F.concat(F.lit("/display/"), space_key, F.lit("/"))) | F.startswith(p, F.concat(F.lit("/display/public/"), space_key, F.lit("/")))
    action = p.startswith("/pages/") & p.endswith(".action") & ~F.substring_index(p, "/", -1).isin(*EDIT_ACTIONS) & query_value(url, "pageId").isNotNull()
    named = F.coalesce(query_value(url, "spaceKey") == space_key, F.lit(False))
    by_space = space_key.isNotNull() & (space_key != "") & (shown | action | named)
    return scheme(url).isin("http", "https") & (host(url) == domain) & (F.startswith(p, path_prefix) | F.coalesce(by_space, F.lit(False)))


def match_form(url: Column, start_is_public: Column) -> Column:
    """Put a child URL into the display form of the start URL."""
    public, p = F.contains(path(url), F.lit("/display/public/")), path(url)
    to_public = start_is_public & p.startswith("/display/") & ~public
    to_short = ~start_is_public & p.startswith("/display/public/")
    return F.when(to_public | to_short, display_variant(url)).otherwise(url)


def page_id(url: Column) -> Column:
    """First pageId of the query if it is all digits."""
    v = query_value(url, "pageId")
    return F.when(v.rlike(r"^\d+$"), v)


def is_page_href(href: Column) -> Column:
    h = strip(href)
    return (h != "") & ~h.startswith("#") & ~F.lower(h).startswith("javascript:")


def is_http(url: Column) -> Column:
    return F.coalesce(strip(url).rlike("^https?://"), F.lit(False))


def same_origin(a: Column, b: Column) -> Column:
    return (host(a) != "") & (host(a) == host(b))


def ipv4_from_number(h: Column) -> Column:
    """Hexadecimal, octal (tried before decimal) or decimal host numbers as a dotted quad."""
    n = F.when(F.lower(h).rlike("^0x[0-9a-f]{1,8}$"), F.conv(F.substring(h, 3, 20), 16, 10)).when(h.rlike("^0[0-7]{1,12}$"), F.conv(h, 8, 10)).when(h.rlike("^[0-9]{1,10}$"), h).try_cast("long")
    quad = F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])
    return F.when(n.between(0, 0xFFFFFFFF), quad).otherwise(h)


def start_url_problem(url: Column) -> Column:
    """Why a start URL is refused; null if it is accepted."""
    u = strip(F.coalesce(url, F.lit("")))
    h = F.regexp_extract(F.regexp_replace(F.lower(_part(u, 4)), "^[^@]*@", ""), r"^(\[[^\]]*\]|[^:]*)", 1)
    bare = F.regexp_replace(h, r"^\[|\]$", "")
    return F.when(u == "", "empty").when(~scheme(u).isin("http", "https"), "scheme").when(_part(u, 4) == "", "no host").when(bare.isin(*BLOCKED_HOSTS) | is_private_ip(ipv4_from_number(bare)), "blocked host")


# Words for "no exit", scheme aliases, accepted schemes with their default ports.
DIRECT_WORDS = ("direct", "direto", "none", "sem-proxy")
EXIT_ALIASES = {"socks5h": "socks5", "socks": "socks5", "socks4a": "socks4"}
EXIT_PORTS = {"http": 80, "https": 443, "socks5": 1080, "socks4": 1080}
EXIT_URL = r"^([^:/?#]+)://(?:([^:@/]*)(?::([^@/]*))?@)?(\[[^\]]+\]|[^:/?#@]+)(?::(\d+))?/?$"


def exit_url(raw: Column) -> Column:
    """Normalised exit URL; null where the value is refused."""
    v = strip(raw)
    four = r"^([^:@/\[]+):(\d+):([^:]+):(.+)$"
    v = F.when(~F.contains(v, F.lit("://")) & v.rlike(four), F.concat(F.lit("http://"), F.url_encode(F.regexp_extract(v, four, 3)), F.lit(":"), F.url_encode(F.regexp_extract(v, four, 4)), F.lit("@"), F.regexp_extract(v, four, 1), F.lit(":"), F.regexp_extract(v, four, 2))).otherwise(v)
    v = F.when(F.contains(v, F.lit("://")), v).otherwise(F.concat(F.lit("http://"), v))
    g = lambda k: F.regexp_extract(v, EXIT_URL, k)
    s = F.lower(g(1))
    for a, b in EXIT_ALIASES.items():
        s = F.when(F.lower(g(1)) == a, b).otherwise(s)
    port = F.coalesce(F.nullif(g(5), F.lit("")).try_cast("int"), *[F.when(s == k, F.lit(p)) for k, p in EXIT_PORTS.items()])
    auth = F.when(g(2) != "", F.concat(g(2), F.when(g(3) != "", F.concat(F.lit(":"), g(3))).otherwise(""), F.lit("@"))).otherwise("")
    good = v.rlike(EXIT_URL) & s.isin(*EXIT_PORTS) & port.between(1, 65535) & ~(s.startswith("socks") & (g(2) != ""))
    good = good & (v != "") & ~F.lower(strip(raw)).isin(*DIRECT_WORDS)
    return F.when(good, F.concat(s, F.lit("://"), auth, F.lower(g(4)), F.lit(":"), port.cast("string")))


def masked_exit(url: Column) -> Column:
    return F.when(F.coalesce(url, F.lit("")) == "", "direct").otherwise(F.regexp_replace(url, "://[^@/]*@", "://***:***@"))
