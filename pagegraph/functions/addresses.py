"""Which addresses are not public, as Column expressions: an address becomes a number of fixed width, which is looked up
in a table of ranges."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Special-purpose IPv4 blocks (private, loopback, link-local, documentation, multicast, reserved), and
# the public addresses in them.
IPV4_BLOCKS = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16),
    ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)
IPV4_PUBLIC = (("192.0.0.9", 32), ("192.0.0.10", 32))
# The same for IPv6, by the first groups: what lies outside 2000::/3 but for fec0::/10, and blocks inside.
IPV6_BLOCKS = (("0000", 3), ("4000", 2), ("8000", 2), ("c000", 3), ("e000", 4), ("f000", 5), ("f800", 6), ("fc00", 7), ("fe00", 9), ("fe80", 10), ("ff00", 8), ("20010000", 23), ("20010db8", 32), ("2002", 16))
IPV6_PUBLIC = (("20010001000000000000000000000001", 128), ("20010001000000000000000000000002", 128), ("20010003", 32), ("200100040112", 48), ("20010020", 28), ("20010030", 28))

OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
QUAD = rf"{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}"


def _range4(block: tuple[str, int]) -> tuple[int, int]:
    low = int.from_bytes(bytes(map(int, block[0].split("."))), "big")
    return low, low + (1 << 32 - block[1]) - 1


def _range6(block: tuple[str, int]) -> tuple[str, str]:
    low = int(block[0].ljust(32, "0"), 16)
    return f"{low:032x}", f"{low + (1 << 128 - block[1]) - 1:032x}"


def _within(value: Column, ranges: list[tuple]) -> Column:
    return reduce(lambda a, b: a | b, (value.between(*r) for r in ranges))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value being made once: an array of one binds it to a name."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ipv4_number(address: Column) -> Column:
    """A dotted quad as a long; null if it is none."""

    def number(parts: Column) -> Column:
        of = [F.get(parts, F.lit(k)).cast("long") for k in range(4)]
        return of[0] * (1 << 24) + of[1] * (1 << 16) + of[2] * (1 << 8) + of[3]

    return F.when(address.rlike(rf"\A{QUAD}\z"), let(F.split(address, r"\.", -1), number))


def ipv6_digits(address: Column) -> Column:
    """An IPv6 address, with a dotted quad at its end too, as 32 hexadecimal digits; null if it is none."""
    none = F.array().cast("array<string>")
    groups = lambda side: F.when(side == "", none).otherwise(F.split(side, ":", -1))

    def digits(x: Column) -> Column:  # struct(short, left, right)
        n = F.size(x["left"]) + F.size(x["right"])
        fits = F.forall(F.concat(x["left"], x["right"]), lambda g: g.rlike(r"\A[0-9a-f]{1,4}\z")) & F.when(x["short"], n <= 7).otherwise(n == 8)
        whole = F.concat(x["left"], F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - n)), x["right"])
        return F.when(fits, F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), ""))

    def halves(x: Column) -> Column:  # the sides of ::
        short = F.size(x) == 2
        right = F.when(short, groups(F.get(x, F.lit(1)))).otherwise(none)
        return F.when(F.size(x) <= 2, let(F.struct(short.alias("short"), groups(F.get(x, F.lit(0))).alias("left"), right.alias("right")), digits))

    def spelled(tail: Column) -> Column:  # the number of the quad at the end, if there is one
        low = lambda n: F.lower(F.hex(n))
        own = F.concat_ws(":", low(F.shiftright(tail, 16)), low(tail.bitwiseAND(0xFFFF)))
        return F.lower(F.when(tail.isNotNull(), F.concat(F.regexp_replace(address, rf"{QUAD}\z", ""), own)).otherwise(address))

    s = let(ipv4_number(F.regexp_extract(address, rf":({QUAD})\z", 1)), spelled)
    return F.when(F.contains(address, F.lit(":")) & ~F.contains(address, F.lit(":::")), let(F.split(s, "::", -1), halves))


def is_private_ip(host: Column) -> Column:
    """Whether a host is an address, with brackets and zone or without, that is not public; false for names and null."""

    def not_public(x: Column) -> Column:  # struct(v4, v6)
        blocked4 = _within(x["v4"], list(map(_range4, IPV4_BLOCKS))) & ~_within(x["v4"], list(map(_range4, IPV4_PUBLIC)))
        blocked6 = _within(x["v6"], list(map(_range6, IPV6_BLOCKS))) & ~_within(x["v6"], list(map(_range6, IPV6_PUBLIC)))
        return F.when(x["v4"].isNotNull(), blocked4).otherwise(blocked6)

    h = F.regexp_replace(F.split(F.coalesce(host, F.lit("")), "%", -1)[0], r"^[\[\]]+|[\[\]]+$", "")
    return F.coalesce(let(h, lambda a: let(F.struct(ipv4_number(a).alias("v4"), ipv6_digits(a).alias("v6")), not_public)), F.lit(False))
