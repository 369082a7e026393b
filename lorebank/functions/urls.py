"""Url expressions: parts, platform labels, routing and the address hygiene gate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorebank import constants as K
from lorebank.functions.columns import let
from lorebank.functions.text import col_of, or_default, trim_ws

# ---- fixed values: address ranges that are not public unicast (network, prefix bits) ------------
RESERVED_V4 = (
    ("0.0.0.0", 8),
    ("10.0.0.0", 8),
    ("100.64.0.0", 10),
    ("127.0.0.0", 8),
    ("169.254.0.0", 16),
    ("172.16.0.0", 12),
    ("192.0.0.0", 24),
    ("192.0.2.0", 24),
    ("192.31.196.0", 24),
    ("192.52.193.0", 24),
    ("192.88.99.0", 24),
    ("192.168.0.0", 16),
    ("192.175.48.0", 24),
    ("198.18.0.0", 15),
    ("198.51.100.0", 24),
    ("203.0.113.0", 24),
    ("224.0.0.0", 4),
    ("240.0.0.0", 4),
)
# Textual prefixes of IPv6 networks that are not public unicast.
RESERVED_V6 = (
    r"^(::1?$|f[cd]|fe[89ab]|ff|64:ff9b:|100::|2002:|2001:(0{1,4}:|:|0?1[0-9a-f]:|0?2[0-9a-f]:|0?db8:)|::(ffff:)?[0-9a-f:]*$|5f00:|3fff:)"
)


def scheme_of(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(trim_ws(url), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def _authority(url: Column | str) -> Column:
    return F.regexp_extract(trim_ws(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\]*)", 1)


def host_of(url: Column | str) -> Column:
    """Lower-case host without credentials, port, brackets or a closing dot."""
    bare = F.regexp_replace(_authority(url), r"^.*@", "")
    host = F.regexp_replace(bare, r":\d*$", "")
    return F.regexp_replace(F.lower(host), r"^\[|\]$|\.$", "")


def embedded_url(text: Column | str) -> Column:
    """First http(s) url inside a pasted text, or the text itself."""
    return or_default(F.regexp_extract(trim_ws(text), K.EMBEDDED_URL, 0), trim_ws(text))


def file_name_from_url(url: Column | str) -> Column:
    """Last path segment, percent-decoded."""
    path = F.regexp_extract(trim_ws(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    last = F.regexp_extract(path, r"([^/]+)/*$", 1)
    return F.coalesce(F.try_url_decode(last), F.lit(""))


def platform_of(url: Column | str) -> Column:
    """Platform label by substrings of the whole url, else the host without ``www.``."""
    u = col_of(url)
    label = None
    for name, parts in K.PLATFORM_RULES:
        hit = F.lit(False)
        for part in parts:
            hit = hit | F.contains(u, F.lit(part))
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return label.otherwise(or_default(F.regexp_replace(host_of(u), r"^www\.", ""), K.EXTERNAL_PLATFORM))


def pasted_platform_of(text: Column | str) -> Column:
    t = col_of(text)
    label = None
    for name, pattern in K.PASTED_PLATFORM_RULES:
        hit = t.rlike(f"(?i){pattern}")
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return label.otherwise(K.PASTED_DEFAULT)


def media_route(url: Column | str) -> Column:
    """video, podcast or article, tested on the whole url in this order."""
    u = col_of(url)
    return (
        F.when(u.rlike(K.VIDEO_URL), "video").when(u.rlike(K.AUDIO_URL) | u.rlike(K.PODCAST_URL), "podcast").otherwise("article")
    )


def is_short_link(url: Column | str) -> Column:
    return host_of(url).rlike(K.SHORT_LINK_HOST)


def _v4_number(host: Column) -> Column:
    """IPv4 literal as a number; hex, octal and shortened forms included; null for anything else."""
    literal = host.rlike(r"^(0x[0-9a-f]*|\d+)(\.(0x[0-9a-f]*|\d+)){0,3}$")

    def number(p: Column) -> Column:
        return (
            F.when(p.rlike("^0x"), F.conv(F.concat(F.lit("0"), F.substring(p, 3, 20)), 16, 10))
            .when(p.rlike("^0[0-7]+$"), F.conv(p, 8, 10))
            .otherwise(p)
            .try_cast("long")
        )

    def total(parts: Column) -> Column:
        n = F.size(parts)
        lead = F.aggregate(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))), F.lit(0).cast("long"), lambda a, x: a * 256 + x)
        return lead * F.pow(F.lit(256), 5 - n).cast("long") + F.element_at(parts, -1)

    return F.when(literal, let(F.transform(F.split(host, r"\."), number), total))


def _is_public_v4(number: Column) -> Column:
    reserved = F.lit(False)
    for network, bits in RESERVED_V4:
        a, b, c, d = (int(x) for x in network.split("."))
        low = ((a * 256 + b) * 256 + c) * 256 + d
        reserved = reserved | number.between(low, low + 2 ** (32 - bits) - 1)
    return ~reserved & (number < 2**32)


def url_verdict(url: Column | str) -> Column:
    """ok, bad_format, bad_scheme, credentials, blocked_host or private_address.

    Names pass: resolving them belongs to the fetcher, which checks every address again.
    """
    u = trim_ws(url)
    parts = F.struct(scheme_of(u).alias("scheme"), _authority(u).alias("authority"), host_of(u).alias("host"))

    def verdict(p: Column) -> Column:
        host = p["host"]
        mapped = F.regexp_extract(host, r"^::ffff:(\d+\.\d+\.\d+\.\d+)$", 1)
        literal = F.when(F.contains(host, F.lit(":")), mapped).otherwise(host)
        private_v4 = let(_v4_number(literal), lambda n: n.isNotNull() & ~_is_public_v4(n))
        return (
            F.when(p["scheme"] == "", "bad_format")
            .when(~p["scheme"].isin("http", "https"), "bad_scheme")
            .when(p["authority"] == "", "bad_format")
            .when(F.contains(p["authority"], F.lit("@")), "credentials")
            .when((host == "") | host.isin(*K.BLOCKED_HOSTS) | F.endswith(host, F.lit(".local")), "blocked_host")
            .when(private_v4, "private_address")
            .when((mapped == "") & F.contains(host, F.lit(":")) & host.rlike(RESERVED_V6), "private_address")
            .otherwise("ok")
        )

    return F.when(F.col(url).isNull() if isinstance(url, str) else url.isNull(), "bad_format").otherwise(let(parts, verdict))
