"""DOI and public-URL rules."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from papertrellis.functions.text import let, strip

_RESOLVER = r"(?:https?://)?(?:dx\.)?doi\.org/"


def normalize_doi(c: Column) -> Column:
    """Canonical https://doi.org/ url of a DOI in any usual spelling, else null."""
    raw = strip(c.cast("string"))
    # '+' is literal in a DOI, but url_decode would turn it into a space
    plain = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    bare = F.regexp_replace(plain, rf"(?i)^{_RESOLVER}", "")
    bare = F.regexp_replace(bare, r"(?i)^doi:\s*", "")
    bare = F.regexp_replace(bare, rf"(?i)^(?:{_RESOLVER})+", "")
    bare = F.regexp_replace(strip(bare), r"^[<>]+|[<>]+$", "")
    bare = F.regexp_replace(bare, r"[.,;)]+$", "")
    return let(bare, lambda b: F.when(b.rlike(r"^10\.\d{4,9}/[^\s<>]+$"), F.concat(F.lit("https://doi.org/"), b)))


@F.pandas_udf(T.BooleanType())
def _address_is_global(host: pd.Series) -> pd.Series:
    def check(value):
        try:
            return ipaddress.ip_address(value).is_global
        except (TypeError, ValueError):
            return None

    return host.map(check, na_action="ignore").astype("object")


_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"

# IPv4 ranges that are not globally reachable, as first and last address.
_CLOSED_IPV4 = (
    ("0.0.0.0", "0.255.255.255"),
    ("10.0.0.0", "10.255.255.255"),
    ("100.64.0.0", "100.127.255.255"),
    ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"),
    ("172.16.0.0", "172.31.255.255"),
    ("192.0.0.0", "192.0.0.8"),
    ("192.0.0.11", "192.0.0.255"),
    ("192.0.2.0", "192.0.2.255"),
    ("192.168.0.0", "192.168.255.255"),
    ("198.18.0.0", "198.19.255.255"),
    ("198.51.100.0", "198.51.100.255"),
    ("203.0.113.0", "203.0.113.255"),
    ("240.0.0.0", "255.255.255.255"),
)


def _ipv4_is_global(host: Column) -> Column:
    octets = F.transform(F.split(host, r"\."), lambda p: F.coalesce(p.try_cast("long"), F.lit(0)))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda n, p: n * 256 + p)
    ranges = F.array(*[
        F.struct(F.lit(int(ipaddress.ip_address(a))).alias("a"), F.lit(int(ipaddress.ip_address(b))).alias("b"))
        for a, b in _CLOSED_IPV4
    ])
    return let(number, lambda n: ~F.exists(ranges, lambda r: n.between(r["a"], r["b"])))


_URL = r"(?i)^(https)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def validate_public_https_url(c: Column, *, check_addresses: bool = True) -> Column:
    """Canonical form of a public https url; null for local, private or non-https ones.

    IPv4 literals are tested in the JVM. ``check_addresses`` also tests IPv6
    literals, in Arrow batches; without it those are refused, so that the
    expression can stand inside a lambda.
    """
    url = strip(c.cast("string"))
    six = F.lower(F.regexp_extract(url, r"(?i)^https://\[([^\]]*)\]", 1))
    six_ok = F.coalesce(_address_is_global(F.when(six != "", six)), F.lit(False)) if check_addresses else F.lit(False)
    return let(F.struct(url.alias("url"), six.alias("six"), six_ok.alias("six_ok")), _canonical)


def _canonical(p: Column) -> Column:
    """Every part is bound once, so the expression stays small."""
    parts = F.struct(
        F.regexp_extract(p["url"], _URL, 2).alias("authority"),
        F.regexp_extract(p["url"], _URL, 3).alias("path"),
        F.regexp_extract(p["url"], _URL, 4).alias("query"),
        p["url"].rlike(_URL).alias("https"), p["six"].alias("six"), p["six_ok"].alias("six_ok"),
    )

    def with_host(a: Column) -> Column:
        named = F.lower(F.regexp_extract(a["authority"], r"^([^:\[\]@]*)(?::\d*)?$", 1))
        return F.struct(
            a.alias("a"),
            F.when(a["six"] != "", F.concat(F.lit("["), a["six"], F.lit("]")))
            .otherwise(F.regexp_replace(named, r"\.+$", "")).alias("host"),
            F.regexp_extract(a["authority"], r":(\d*)$", 1).alias("port"),
        )

    def judged(h: Column) -> Column:
        host, port, a = h["host"], h["port"], h["a"]
        named_ok = host.contains(".") & ~host.rlike(r"\.(localhost|local|internal)$")
        number = F.coalesce(port.try_cast("int"), F.when(port == "", F.lit(443)).otherwise(F.lit(99999)))
        ok = (
            a["https"] & (host != "") & ~a["authority"].contains("@") & (number <= 65535)
            & F.when(a["six"] != "", a["six_ok"]).when(host.rlike(_IPV4), _ipv4_is_global(host)).otherwise(named_ok)
        )
        return F.when(
            ok,
            F.concat(
                F.lit("https://"), host,
                F.when(number == 443, F.lit("")).otherwise(F.concat(F.lit(":"), number.cast("string"))),
                F.when(a["path"] == "", F.lit("/")).otherwise(a["path"]),
                F.when(a["query"] == "?", F.lit("")).otherwise(a["query"]),
            ),
        )

    return let(parts, lambda a: let(with_host(a), judged))


def context_url(c: Column, *, check_addresses: bool = True) -> Column:
    """DOI hosts go through the DOI rule, every other host through the public-url rule."""
    host = F.lower(F.regexp_extract(strip(c.cast("string")), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    doi_host = F.regexp_replace(host, r"^www\.", "").isin("doi.org", "dx.doi.org")
    return F.when(doi_host, normalize_doi(c)).otherwise(
        validate_public_https_url(c, check_addresses=check_addresses)
    )
