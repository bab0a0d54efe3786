import ipaddress
from random import Random

from pyspark.sql import functions as F

from pagegraph.functions import addresses


def standard(h):
    try:
        ip = ipaddress.ip_address((h or "").split("%", 1)[0].strip("[]"))
    except ValueError:
        return False
    return ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved


def samples():
    r = Random(11)
    out = ["", None, "h.example", "1.2.3", "1.2.3.4.5", "01.2.3.4", "256.1.1.1", "1.2.3.4 ", "１.2.3.4", "::", "::1", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "12345::", "g::", "::1.2.3.4", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3", "::1.2.3.4:5", "[::1]", "[fe80::1%eth0]", "fe80::1%25eth0", "[]", "[[10.0.0.1]]", "10.0.0.1%x", "2001:4860:4860::8888", "FE80::1", "::FFFF:7F00:1", "192.0.0.9", "192.0.0.10", "192.0.0.11", "\n::1", "::1\n", "10.0.0.1\n"]
    edges = [addresses._range4(b) for b in addresses.IPV4_BLOCKS + addresses.IPV4_PUBLIC]
    out += [str(ipaddress.IPv4Address(x)) for a, b in edges for x in (a - 1, a, a + 1, b, b + 1) if 0 <= x < 2**32]
    wide = [tuple(int(x, 16) for x in addresses._range6(b)) for b in addresses.IPV6_BLOCKS + addresses.IPV6_PUBLIC]
    near = [x for a, b in wide for x in (a - 1, a, a + 1, b, b + 1) if 0 <= x < 2**128]
    some = near + [r.getrandbits(128) for _ in range(1500)] + [r.getrandbits(r.choice((16, 40, 96))) << r.choice((0, 32, 80)) for _ in range(1500)] + [0x2001 << 112 | r.getrandbits(20) << 92 | r.getrandbits(8) for _ in range(1000)]
    for x in some:
        a = ipaddress.IPv6Address(x % 2**128)
        out += [str(a), a.exploded.upper() if r.random() < 0.5 else f"[{a}]"]
    for _ in range(2500):
        x = r.getrandbits(32)
        out.append(r.choice(("{}", "::ffff:{}", "64:ff9b::{}", "2002:{}::", "::{}", "{}%1")).format(ipaddress.IPv4Address(x)))
    return out


def test_equal_to_the_standard_library(spark):
    hosts = samples()
    assert len(hosts) > 10_000
    df = spark.createDataFrame(list(enumerate(hosts)), "n int, h string").repartition(4)
    got = dict(df.select("n", addresses.is_private_ip(F.col("h"))).collect())
    assert [(h, got[n]) for n, h in enumerate(hosts) if got[n] != standard(h)] == []
    plan = df.select(addresses.is_private_ip(F.col("h")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
