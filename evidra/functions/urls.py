"""URL functions as column expressions.

The parts of a URL come from the pattern of RFC 3986, which never fails,
unlike ``parse_url``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

_PARTS = r"(?s)^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _PARTS, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def authority(url: Column) -> Column:
    return F.lower(_part(url, 2))


def _encoded(text: Column) -> Column:
    """A query part decoded and encoded again; what cannot be decoded is encoded as it is."""
    return F.replace(F.url_encode(F.coalesce(F.try_url_decode(text), text)), F.lit("*"), F.lit("%2A"))


def _without_tracking(query: Column) -> Column:
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    name = lambda p: F.regexp_extract(p, r"^([^=]*)", 1)
    value = lambda p: F.regexp_extract(p, r"^[^=]*=(.*)$", 1)
    kept = F.filter(pairs, lambda p: ~F.lower(F.coalesce(F.try_url_decode(name(p)), name(p))).isin(fixed.TRACKING_PARAMS))
    return F.array_join(F.transform(kept, lambda p: F.concat(_encoded(name(p)), F.lit("="), _encoded(value(p)))), "&")


def _joined(scheme_: Column, host: Column, path: Column, query: Column) -> Column:
    start = F.when(scheme_ != "", F.concat(scheme_, F.lit(":"))).otherwise("")
    place = F.when(host != "", F.concat(F.lit("//"), host)).otherwise("")
    return F.concat(start, place, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _path(url: Column) -> Column:
    path = _part(url, 3)
    return F.when(path.isin("", "/"), "/").otherwise(F.rtrim(path, F.lit("/")))


def canonical_url(url: Column) -> Column:
    """One form for URLs that lead to the same page.

    Scheme and host in lower case, default ports, fragment, tracking
    parameters and slashes at the end removed, other parameters kept in
    order, also empty ones.
    """
    url = F.trim(url)
    host = authority(url)
    host = F.when((scheme(url) == "http") & host.endswith(":80"), F.expr("null").cast("string")).otherwise(host)
    host = F.coalesce(host, F.regexp_replace(authority(url), ":80$", ""))
    host = F.when(scheme(url) == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    return _joined(scheme(url), host, _path(url), _without_tracking(_part(url, 4)))


def plain_canonical_url(url: Column) -> Column:
    """The weaker form of the hub evaluation: only case, fragment and slashes at the end."""
    url = F.trim(url)
    return _joined(scheme(url), authority(url), _path(url), _part(url, 4))


def domain_of(url: Column) -> Column:
    """Host in lower case without one leading ``www.``; a port stays."""
    return F.regexp_replace(authority(F.trim(F.coalesce(url, F.lit("")))), r"^www\.", "")


def url_title(url: Column) -> Column:
    """``domain — last part of the path``, or the domain alone."""
    shown = F.try_element_at(F.filter(F.split(_part(url, 3), "/"), lambda p: p != ""), F.lit(-1))
    return F.when(domain_of(url) == "", url).when(F.length(shown) > 2, F.concat(domain_of(url), F.lit(" — "), F.substring(shown, 1, 40))).otherwise(domain_of(url))


def is_denied(url: Column) -> Column:
    """Pages that never hold claims: categories, social media, video, wiki actions."""
    found = F.lit(False)
    for part in fixed.DENIED_URL_PARTS:
        found = found | F.contains(url, F.lit(part))
    return found


def is_safe_literal(url: Column) -> Column:
    """http or https with a host that is no private, local or reserved literal address.

    Names are accepted here; resolving them is the fetcher's business and
    is not a function of the URL.
    """
    host = F.regexp_extract(F.regexp_replace(authority(F.trim(url)), r"^[^@]*@", ""), r"^(\[[^\]]*\]|[^:]*)", 1)
    octets = F.transform(F.split(host, r"\."), lambda x: F.try_to_number(x, F.lit("999")).cast("int"))
    v4 = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    a, b = F.get(octets, F.lit(0)), F.get(octets, F.lit(1))
    local = a.isin(0, 10, 127) | (a >= 224) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & b.isin(0, 168)) | ((a == 100) & b.between(64, 127)) | ((a == 198) & b.isin(18, 19))
    v6 = host.startswith("[")
    local6 = host.rlike(r"^\[(::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|ff[0-9a-f]{2}:.*|::ffff:(10|127|0)\..*|::ffff:(192\.168|169\.254)\..*|2001:db8:.*)\]$")
    return scheme(F.trim(url)).isin("http", "https") & (host != "") & (host != "localhost") & ~F.coalesce(v4 & local, F.lit(False)) & ~(v6 & local6)


def is_loopback_base(url: Column) -> Column:
    """Whether a search endpoint is plain http on this machine, without user, query or fragment."""
    host = F.regexp_replace(authority(url), r":\d*$", "")
    return (scheme(url) == "http") & host.isin(fixed.LOOPBACK_HOSTS) & ~F.contains(url, F.lit("?")) & ~F.contains(url, F.lit("#"))


def next_page(link: Column) -> Column:
    """The next page in a ``Link`` header, if it is a page of the hub's model list; else null."""
    url = F.regexp_extract(link, fixed.NEXT_LINK, 1)
    return F.when(url.rlike(fixed.HUB_PAGE), url)
