"""Scalar functions as columns: paths, names, sizes, addresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of a snapshot path type/id/time, and of one with namespaces before it (ns/a/ns/b/type/id/time).
GROUP = r"^(?:((?:ns/[A-Za-z0-9_][A-Za-z0-9._-]*/)*))?(host|vm|ct)/([A-Za-z0-9_][A-Za-z0-9._-]*)(?:/(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ))?$"
REPOSITORY = r"^(?:(?:([^@:]+@[^@:!]+(?:![^@:]+)?)@)?([A-Za-z0-9.-]+|\[[0-9A-Fa-f:]+\]):)?(?:(\d{1,5}):)?([A-Za-z0-9_][A-Za-z0-9._-]*)$"


def snapshot_parts(path: Column) -> dict[str, Column]:
    """Namespace (as a/b), type, id and time of a group or snapshot path; null where the path isn't one."""
    ok = path.rlike(GROUP)
    part = lambda i: F.when(ok, F.regexp_extract(path, GROUP, i))
    ns = F.array_join(F.filter(F.split(part(1), "/"), lambda x: (x != "ns") & (x != "")), "/")
    return {"ns": ns, "type": part(2), "id": part(3), "time": F.when(part(4) != "", part(4))}


def namespace_path(ns: Column) -> Column:
    """ns/a/ns/b of an array."""
    return F.array_join(F.transform(ns, lambda x: F.concat(F.lit("ns/"), x)), "/")


def repository_parts(text: Column) -> dict[str, Column]:
    """User, host (localhost if none), port (8007 if none) and store of [[user@]host:[port:]]store."""
    ok = text.rlike(REPOSITORY)
    part = lambda i: F.when(ok, F.nullif(F.regexp_extract(text, REPOSITORY, i), F.lit("")))
    return {"user": part(1), "host": F.when(ok, F.coalesce(part(2), F.lit("localhost"))), "port": F.when(ok, F.coalesce(part(3).try_cast("int"), F.lit(8007))), "store": part(4)}


def archive_type(name: Column) -> Column:
    """dynamic, fixed or blob by suffix, null for others."""
    return F.when(F.endswith(name, F.lit(".didx")), "dynamic").when(F.endswith(name, F.lit(".fidx")), "fixed").when(F.endswith(name, F.lit(".blob")), "blob")


def human_bytes(n: Column, digits: int = 2) -> Column:
    """A size with a binary unit."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB"), 1):
        out = F.when(n >= 1 << 10 * i, F.format_string(f"%.{digits}f {unit}", n / (1 << 10 * i))).otherwise(out)
    return out


def parse_bytes(text: Column) -> Column:
    """Bytes of a size such as 10, 1.5 MiB, 20MB or 3k; null where it isn't one."""
    shape = r"(?i)^\s*([0-9]+(?:\.[0-9]+)?)\s*([kmgtp]?)(i?)b?\s*$"
    power = F.instr(F.lit(" kmgtp"), F.when(F.regexp_extract(text, shape, 2) == "", " ").otherwise(F.lower(F.regexp_extract(text, shape, 2)))) - 1
    base = F.when(F.regexp_extract(text, shape, 3) == "", 1000.0).otherwise(1024.0)
    return F.when(text.rlike(shape), F.floor(F.nullif(F.regexp_extract(text, shape, 1), F.lit("")).try_cast("double") * F.pow(base, power)).cast("long"))


def escape_unit(text: Column) -> Column:
    """A path as a unit name: slashes to dashes, other characters but letters, digits, _ . and : as \\xNN."""
    trimmed = F.regexp_replace(text, "^/+|/+$", "")
    one = lambda c: F.when(c == "/", "-").when(c.rlike("[A-Za-z0-9_.:]"), c).otherwise(F.concat(F.lit("\\x"), F.lower(F.hex(F.encode(c, "UTF-8")))))
    joined = F.array_join(F.transform(F.split(trimmed, ""), one), "")
    return F.when(trimmed == "", "-").when(F.startswith(trimmed, F.lit(".")), F.concat(F.lit("\\x2e"), F.substr(joined, F.lit(2)))).otherwise(joined)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def vlan(name: Column) -> tuple[Column, Column]:
    """(VLAN id, raw device) of an interface name such as vmbr0.100 or vlan100."""
    dotted = F.regexp_extract(name, r"^(.+)\.(\d{1,4})$", 2)
    plain = F.regexp_extract(name, r"^vlan(\d{1,4})$", 1)
    return F.coalesce(F.nullif(dotted, F.lit("")), F.nullif(plain, F.lit(""))).try_cast("int"), F.nullif(F.regexp_extract(name, r"^(.+)\.(\d{1,4})$", 1), F.lit(""))


def physical_nic(name: Column) -> Column:
    return name.rlike(r"^(?:eth\d+|en[^:.]+|ib[^:.]+)$")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where value is worked out once a row however often f uses it: the optimizer, which copies what a name stands for, leaves lambda variables alone."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def ipv4(text: Column) -> Column:
    """An IPv4 address as a number; an IPv4-mapped IPv6 one counts as IPv4; null for others."""
    shape = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"

    def number(plain: Column) -> Column:
        parts = F.transform(F.regexp_extract_all(plain, F.lit(r"\d+"), F.lit(0)), lambda p: p.try_cast("bigint"))
        return F.when(plain.rlike(shape), F.aggregate(parts, F.lit(0).cast("bigint"), lambda n, p: F.when(p <= 255, n * 256 + p)))

    return once(F.regexp_replace(text, "(?i)^::ffff:", ""), number)


def _ipv6_bits(text: Column) -> Column:
    """128 digits of an IPv6 address, null for others; one :: stands for groups of zeros."""
    groups = lambda half: F.filter(F.split(half, ":"), lambda g: g != "")

    def spread(halves: Column) -> Column:
        sides = F.struct(F.size(halves).alias("n"), groups(F.get(halves, F.lit(0))).alias("left"), groups(F.get(halves, F.lit(1))).alias("right"))
        zeros = lambda s: F.array_repeat(F.lit("0"), F.greatest(8 - F.size(s["left"]) - F.size(s["right"]), F.lit(0)))
        short = lambda s: F.when(F.size(s["left"]) + F.size(s["right"]) < 8, F.concat(s["left"], zeros(s), s["right"]))
        return once(sides, lambda s: F.when(s["n"] == 1, s["left"]).when(s["n"] == 2, short(s)))

    digits = lambda whole: F.when((F.size(whole) == 8) & F.forall(whole, lambda g: F.length(g) <= 4), F.array_join(F.transform(whole, lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), ""))
    good = text.rlike("^[0-9A-Fa-f:]+$") & ~text.rlike(":::|^:[^:]|[^:]:$")
    return F.when(good, once(once(F.split(text, "::"), spread), digits))


def address_bits(text: Column) -> Column:
    """An address as binary digits: 32 of an IPv4 one (or an IPv4-mapped IPv6 one), 128 of an IPv6 one, null for others."""
    return once(text, lambda t: F.coalesce(F.lpad(F.bin(ipv4(t)), 32, "0"), _ipv6_bits(t)))


def network_bits(cidr: Column) -> tuple[Column, Column]:
    """(the prefix as binary digits, the number of digits of the family's addresses) of a network; both are null for others. No digits are the whole family."""
    bits, length = address_bits(F.get(F.split(cidr, "/"), F.lit(0))), F.get(F.split(cidr, "/"), F.lit(1)).try_cast("int")
    good = length.between(0, F.length(bits))
    return F.when(good, F.left(bits, length)), F.when(good, F.length(bits))
