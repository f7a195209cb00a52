"""Column helpers for URLs: canonical forms, comparison keys, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .let import let

# The shapes of addresses and hosts.
_SPLIT = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_LABELS = r"^[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)*$"
_V4 = r"^\d{1,3}(\.\d{1,3}){3}$"
_V6 = r"^\[[0-9a-f:.]*:[0-9a-f:.]*\]$"
# Query parameters that only track the click.
TRACKING = ["fbclid", "gclid", "msclkid"]
LOCAL_SUFFIXES = r"(^|\.)localhost$|\.(local|internal|home|lan)$"
# Address blocks that are not globally routable.
PRIVATE_V4 = (r"^(0|10|127|22[4-9]|23\d|24\d|25[0-5])\.|^100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|"
              r"^169\.254\.|^172\.(1[6-9]|2\d|3[01])\.|^192\.168\.|^192\.0\.[02]\.|^198\.1[89]\.|"
              r"^198\.51\.100\.|^203\.0\.113\.")


_HOST_PORT = r"^(\[[^\]]*\]|[^:]*)(?::(\d*))?$"


def _parts(url: Column) -> Column:
    """Struct of scheme, netloc, host, port, path and query."""
    first = lambda u: F.struct(u.alias("url"), *[F.regexp_extract(u, _SPLIT, n).alias(k) for n, k in enumerate(
        ("scheme", "netloc", "path", "query"), 1)])
    second = lambda p: F.struct(
        p["url"].alias("url"), F.lower(p["scheme"]).alias("scheme"), p["netloc"].alias("netloc"), p["path"].alias("path"), p["query"].alias("query"),
        F.lower(F.regexp_replace(F.regexp_extract(p["netloc"], _HOST_PORT, 1), r"\.+$", "")).alias("host"),
        F.regexp_extract(p["netloc"], _HOST_PORT, 2).alias("port"))
    return let(let(url, first), second)


def _clean(url: Column) -> Column:
    """No spaces, control characters, backslashes or broken percent escapes."""
    return ~url.rlike(r"(?U)[\s\x00-\x1f\x7f\\]") & ~url.rlike(r"%(?![0-9a-fA-F]{2})")


def _port_suffix(scheme: Column, port: Column) -> Column:
    default = ((scheme == "http") & (port.cast("string") == "80")) | ((scheme == "https") & (port == "443"))
    number = F.regexp_replace(port, "^0+(?=\\d)", "")
    return F.when((port == "") | default, F.lit("")).otherwise(F.concat(F.lit(":"), number))


def _port_ok(netloc: Column, port: Column) -> Column:
    shape = netloc.rlike(r"^(\[[^\]]*\]|[^:]*)(:\d*)?$")
    return shape & ((port == "") | ((F.length(port) <= 5) & (F.expr("1") * port.try_cast("int") <= 65535)))


def _form_encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _pair(p: Column) -> Column:
    return F.struct(F.try_url_decode(F.regexp_replace(p, "=.*$", "")).alias("k"),
                    F.try_url_decode(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v"))


def canonical_url(url: Column) -> Column:
    """Canonical HTTP(S) URL or null: no default port, tracking keys or fragment; sorted query.

    Hosts outside ASCII are rejected, so callers keep them as reject rows.
    """
    def build(p: Column) -> Column:
        ok = (_clean(p["url"]) & p["scheme"].isin("http", "https") & ~F.contains(p["netloc"], F.lit("@"))
              & (p["host"].rlike(_LABELS) | p["host"].rlike(_V6)) & _port_ok(p["netloc"], p["port"]))
        pairs = F.transform(F.filter(F.split(p["query"], "&"), lambda x: x != ""), _pair)
        kept = F.filter(pairs, lambda s: ~F.startswith(F.lower(s["k"]), F.lit("utm_")) & ~F.lower(s["k"]).isin(TRACKING))
        text = F.array_join(F.transform(F.array_sort(kept), lambda s: F.concat(
            _form_encode(s["k"]), F.lit("="), _form_encode(s["v"]))), "&")
        head = F.concat(p["scheme"], F.lit("://"), p["host"], _port_suffix(p["scheme"], p["port"]),
                        F.when(p["path"] == "", F.lit("/")).otherwise(p["path"]))
        return F.when(F.coalesce(ok, F.lit(False)), let(text, lambda q: F.concat(
            head, F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q)))))

    return let(_parts(url), build)


def _quote(c: Column, extra: str = "") -> Column:
    safe = r"[A-Za-z0-9/%:@!$&'()*+,;=\-._~" + extra + "]"
    return F.when(c.rlike("^" + safe + "*$"), c).otherwise(F.array_join(F.transform(F.split(c, ""), lambda ch: F.when(
        (ch == "") | ch.rlike("^" + safe + "$"), ch).otherwise(F.url_encode(ch))), ""))


def public_url(url: Column) -> Column:
    """Public HTTP(S) URL or null: local names and private addresses rejected, query order kept."""
    def build(p: Column) -> Column:
        host, port = p["host"], p["port"]
        v4 = host.rlike(_V4)
        v4_ok = v4 & host.rlike(r"^((25[0-5]|2[0-4]\d|1?\d?\d)(\.|$)){4}$") & ~host.rlike(PRIVATE_V4)
        v6_ok = host.rlike(r"^\[[23][0-9a-f]{3}:[0-9a-f:]*\]$") & ~host.rlike(r"^\[2001:0?db8:")
        name_ok = ~v4 & host.rlike(_LABELS) & F.contains(host, F.lit(".")) & ~host.rlike(LOCAL_SUFFIXES)
        port_ok = _port_ok(p["netloc"], port) & ((port == "") | (port.try_cast("int") >= 1))
        ok = ((F.length(p["url"]).between(1, 4096)) & _clean(p["url"]) & p["scheme"].isin("http", "https")
              & ~F.contains(p["netloc"], F.lit("@")) & (v4_ok | v6_ok | name_ok) & port_ok)
        out = F.concat(p["scheme"], F.lit("://"), host, _port_suffix(p["scheme"], port),
                       F.when(p["path"] == "", F.lit("/")).otherwise(_quote(p["path"])),
                       F.when(p["query"] == "", F.lit("")).otherwise(F.concat(F.lit("?"), _quote(p["query"], "?"))))
        return F.when(F.coalesce(ok, F.lit(False)), out)

    return let(_parts(url), build)


def url_key(url: Column) -> Column:
    """Comparison key: scheme, host, port, path and query; empty text when not HTTP(S)."""
    def build(p: Column) -> Column:
        bare = F.regexp_replace(p["netloc"], r"^:?@", "")
        return let(F.struct(bare.alias("bare"), F.lower(F.regexp_extract(bare, _HOST_PORT, 1)).alias("host"),
                            F.regexp_extract(bare, _HOST_PORT, 2).alias("port")), lambda h: _key(p, h))

    def _key(p: Column, h: Column) -> Column:
        ok = (p["scheme"].isin("http", "https") & (h["host"] != "") & ~F.contains(h["bare"], F.lit("@")) & _port_ok(h["bare"], h["port"]))
        out = F.concat(p["scheme"], F.lit("://"), h["host"],
                       F.when(h["port"].rlike("^0+$"), F.lit("")).otherwise(_port_suffix(p["scheme"], h["port"])),
                       F.when(p["path"] == "", F.lit("/")).otherwise(p["path"]),
                       F.when(p["query"] == "", F.lit("")).otherwise(F.concat(F.lit("?"), p["query"])))
        return F.when(F.coalesce(ok, F.lit(False)), out).otherwise(F.lit(""))

    return let(_parts(F.trim(url)), build)


def host_of(url: Column) -> Column:
    """Lower-case host name, ``unknown`` when there is none."""
    netloc = F.regexp_replace(F.regexp_extract(url, _SPLIT, 2), "^.*@", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(netloc, _HOST_PORT, 1), r"\.+$", ""))
    return F.when(host == "", F.lit("unknown")).otherwise(host)


def resolve_href(base: Column, href: Column) -> Column:
    """Absolute form of a link found on a page (absolute, rooted, query or relative)."""
    def dots(path: Column) -> Column:
        for _ in range(4):
            path = F.regexp_replace(F.regexp_replace(path, r"/\./", "/"), r"/(?!\.\./)[^/?#]+/\.\./", "/")
        return F.regexp_replace(path, r"^(/\.\.)+/", "/")

    def build(p: Column) -> Column:
        root = F.concat(p["scheme"], F.lit("://"), p["netloc"])
        folder = F.regexp_replace(F.when(p["path"] == "", F.lit("/")).otherwise(p["path"]), "[^/]*$", "")
        return let(href, lambda h: (
            F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h)
            .when(F.startswith(h, F.lit("//")), F.concat(p["scheme"], F.lit(":"), h))
            .when(F.startswith(h, F.lit("/")), F.concat(root, h))
            .when(F.startswith(h, F.lit("?")), F.concat(root, p["path"], h))
            .when(F.startswith(h, F.lit("#")), F.concat(F.regexp_replace(p["url"], "#.*$", ""), h))
            .otherwise(F.concat(root, dots(F.concat(folder, h))))))

    return let(_parts(base), build)


_RAW_URL = r"https?://[^\s<>\[\]\"']+"
_DOI_HOSTS = r"^https?://((dx|www)\.)?doi\.org/"


def doi_identifiers(quote: Column) -> Column:
    """Distinct lower-cased DOIs, bare or behind a resolver link."""
    linked = F.transform(
        F.filter(F.regexp_extract_all(quote, F.lit(_RAW_URL), 0), lambda u: F.lower(u).rlike(_DOI_HOSTS)),
        lambda u: F.lower(F.try_url_decode(F.regexp_replace(F.regexp_replace(u, r"(?i)^https?://[^/]+/+", ""), r"[?#].*$", ""))))
    bare = F.transform(F.regexp_extract_all(quote, F.lit(r"(?iU)(?<!\w)10\.\d{4,9}/[^\s<>\[\]\"']+"), 0),
                       lambda d: F.lower(d))
    valid = lambda d: d.rlike(r"^10\.\d{4,9}/[^\s<>\"?#]+$")
    return F.array_distinct(F.filter(F.concat(linked, bare), valid))


def url_identifiers(quote: Column) -> Column:
    """Distinct literal URLs with a path, resolver links left out."""
    return F.array_distinct(F.filter(
        F.regexp_extract_all(quote, F.lit(_RAW_URL), 0),
        lambda u: ~F.lower(u).rlike(_DOI_HOSTS) & u.rlike(r"^https?://[^/?#]+/+[^/?#]")))


def harvested_urls(text: Column) -> Column:
    """Distinct literal URLs in prose, trailing punctuation trimmed."""
    raw = F.regexp_extract_all(text, F.lit(r"https?://[^\s<>\"']+"), 0)
    return F.array_distinct(F.filter(F.transform(raw, lambda u: public_url(
        F.regexp_replace(u, r"[.,;:!?)\]}]+$", ""))), lambda u: u.isNotNull()))
