"""Static safety audit of source URLs; nothing is resolved or fetched."""

from __future__ import annotations

from functools import reduce
from operator import or_
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigsense import schema as S

# fixed values: IPv4 ranges that are not public, as (first address, prefix length)
NOT_PUBLIC = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16),
    ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16),
    ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4),
    ("240.0.0.0", 4),
]


def _number(ip: str) -> int:
    a, b, c, d = (int(x) for x in ip.split("."))
    return (a << 24) + (b << 16) + (c << 8) + d


def ipv4_number(host: Column) -> Column:
    """An IPv4 literal as a number, NULL for anything else.

    One to four parts, each decimal, octal (leading 0) or hexadecimal (0x); the last one fills
    the bytes that are left, so 127.1 and 2130706433 are both 127.0.0.1.
    """
    ok = host.rlike(r"^(0x[0-9a-f]{0,12}|[0-9]{1,12})(\.(0x[0-9a-f]{0,12}|[0-9]{1,12})){0,3}\.?$")
    parts = F.filter(F.split(F.regexp_replace(host, r"\.$", ""), r"\."), lambda p: p != "")
    value = F.transform(parts, lambda p: F.coalesce(
        F.when(p.startswith("0x"), F.conv(F.substring(p, 3, 12), 16, 10)).when(p.rlike("^0[0-7]+$"), F.conv(p, 8, 10)).otherwise(p)
        .try_cast("long"), F.lit(0).cast("long")))
    n = F.size(value)
    head, last = F.slice(value, 1, F.greatest(n - 1, F.lit(0))), F.get(value, n - 1)
    rest = F.pow(F.lit(256.0), (5 - n).cast("double")).cast("long")
    total = F.aggregate(head, F.lit(0).cast("long"), lambda s, x: s * 256 + x) * rest + last
    return F.when(ok & n.between(1, 4) & ~F.exists(head, lambda x: x > 255) & (last < rest), total)


def mapped_ipv4(address: Column) -> Column:
    """The IPv4 literal inside an IPv4-mapped IPv6 address, NULL for anything else."""
    mapped = r"^(?:(?:0{1,4}:){5}|::(?:0{1,4}:){0,4}|(?:0{1,4}:){1,4}:(?:0{1,4}:){0,3})ffff:"
    dotted = F.regexp_extract(address, mapped + r"([0-9]+(?:\.[0-9]+){3})$", 1)
    two = mapped + "([0-9a-f]{1,4}):([0-9a-f]{1,4})$"
    number = F.conv(F.regexp_extract(address, two, 1), 16, 10).try_cast("long") * 65536 + F.conv(F.regexp_extract(address, two, 2), 16, 10).try_cast("long")
    return F.when(dotted != "", dotted).when(address.rlike(two), number.cast("string"))


def not_public_ip(host: Column) -> Column:
    """True for private, loopback, link-local and reserved literals, IPv6 included."""
    v6 = F.regexp_replace(host, r"^\[|\]$", "")
    n = F.coalesce(ipv4_number(host), ipv4_number(mapped_ipv4(v6)))
    spans = [(_number(first), _number(first) + (1 << (32 - bits)) - 1) for first, bits in NOT_PUBLIC]
    # The one-element array gives the number a name, so that its expression is there only once.
    hit = F.exists(F.array(n), lambda x: reduce(or_, [x.between(lo, hi) for lo, hi in spans]))
    six = v6.contains(":") & v6.rlike(r"^(::1?$|f[cd]|fe[89ab]|ff|2001:db8|64:ff9b:1:|100::)")
    return F.coalesce(hit, F.lit(False)) | F.coalesce(six, F.lit(False))


def source_url_audit(
    df: DataFrame, allowlist: Sequence[str], url: str = "url", setting: str = "the source allowlist"
) -> DataFrame:
    """Scheme, host, port and the list of rule violations of each URL.

    Allowlist entries match a host exactly, or as '*.domain' the domain and its subdomains.
    """
    allow = [a.strip().lower() for a in allowlist if a.strip()]
    text = F.trim(F.coalesce(F.col(url), F.lit("")))
    scheme = F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    authority = F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    server = F.regexp_replace(authority, r"^.*@", "")
    host = F.lower(F.when(server.startswith("["), F.regexp_extract(server, r"^\[([^\]]*)\]", 1)).otherwise(
        F.split_part(server, F.lit(":"), F.lit(1))))
    df = df.withColumn("hostname", F.nullif(host, F.lit("")))
    host = F.col("hostname")
    given = F.regexp_extract(server, r":(\d+)$", 1).try_cast("int")
    port = F.coalesce(given, F.when(scheme == "https", F.lit(443)).when(scheme == "http", F.lit(80)))
    exact = [a for a in allow if not a.startswith("*.")]
    domains = [a[2:] for a in allow if a.startswith("*.")]
    listed = host.isin(exact) if exact else F.lit(False)
    for d in domains:
        listed = listed | (host == d) | host.endswith(f".{d}")
    if not allow:
        gate = F.lit(f"{setting} is empty; outbound URLs are disabled")
    elif "*" in allow:
        gate = F.lit(f"{setting} cannot include wildcard '*'")
    else:
        gate = F.when(host.isNotNull() & ~listed, F.lit(f"Source hostname is not in {setting}"))
    errors = F.array_compact(F.array(
        F.when(~F.coalesce(scheme.isin(S.URL_SCHEMES), F.lit(False)), F.lit("Only http/https source URLs are allowed")),
        F.when(host.isNull(), F.lit("Source URL must include a hostname")),
        F.when(host.isin(S.BLOCKED_HOSTS), F.lit("Source hostname is blocked")),
        gate,
        F.when(not_public_ip(host), F.lit("Source hostname is a blocked address")),
    ))
    return df.withColumns({
        "scheme": F.nullif(scheme, F.lit("")), "port": port, "errors": errors,
    }).withColumn("valid", F.size("errors") == 0)
