"""Property tests: column helpers against independent statements of their rules
(the standard library's address types, a ladder of units) on many random
values. One Spark job evaluates all values of a test."""

import datetime as dt
import ipaddress

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowwarden.functions import scalars as L

MANY = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.too_slow, HealthCheck.function_scoped_fixture])

addresses = st.integers(0, 2 ** 32 - 1).map(lambda n: str(ipaddress.IPv4Address(n)))
private = st.sampled_from(["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16"]).flatmap(
    lambda net: st.integers(0, ipaddress.ip_network(net).num_addresses - 1).map(lambda i: str(ipaddress.ip_network(net)[i])))
PRIVATE_NETWORKS = [ipaddress.ip_network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16")]


@MANY
@given(st.lists(st.one_of(addresses, private), min_size=40, max_size=80))
def test_well_formed_addresses(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "ip string")
    for r in df.select("ip", L.ip_to_int("ip").alias("n"), L.is_private_ip("ip").alias("p")).collect():
        address = ipaddress.ip_address(r.ip)
        assert r.n == int(address), r.ip
        assert r.p == any(address in net for net in PRIVATE_NETWORKS), r.ip


def test_malformed_addresses(spark):
    """Text that isn't four numbers has no number; parts above 255 carry on."""
    expected = {"": 0, "1": 0, "1.2.3": 0, "1.2.3.4.5": 0, "a.b.c.d": 0, "1.2.x.4": 0, "0.0.0.0": 0, "0.0.0.256": 256, "0.0.1.0": 256,
                "001.0.0.7": 2 ** 24 + 7, "300.0.0.0": 300 * 2 ** 24}
    df = spark.createDataFrame([(v,) for v in expected] + [(None,)], "ip string")
    got = {r.ip: (r.n, r.p) for r in df.select("ip", L.ip_to_int("ip").alias("n"), L.is_private_ip("ip").alias("p")).collect()}
    assert {k: v[0] for k, v in got.items() if k is not None} == expected and got[None][0] == 0
    assert not any(p for k, (n, p) in got.items() if n == 0)


LADDER = [(86400, "day"), (3600, "hour"), (60, "minute"), (1, "second")]


def spoken(micros: int) -> str:
    """The largest unit of which a day, or more than one other unit, has passed."""
    seconds = micros // 1_000_000
    for size, unit in LADDER:
        count, rest = divmod(seconds, size)
        if unit in ("day", "second") and (count or unit == "second") or count and (count > 1 or rest):
            return f"{count} {unit}{'' if count == 1 else 's'} ago"
    raise AssertionError


def test_ladder_at_its_edges(spark):
    as_of = dt.datetime(2024, 1, 31)
    expected = {0: "0 seconds ago", 1: "1 second ago", 59: "59 seconds ago", 60: "60 seconds ago", 61: "1 minute ago", 120: "2 minutes ago",
                3599: "59 minutes ago", 3600: "60 minutes ago", 3601: "1 hour ago", 7200: "2 hours ago", 86399: "23 hours ago",
                86400: "1 day ago", 172800: "2 days ago"}
    df = spark.createDataFrame([(s, as_of - dt.timedelta(seconds=s)) for s in expected], "s long, ts timestamp")
    got = {r.s: r.t for r in df.select("s", L.time_ago("ts", F.lit(as_of).cast("timestamp")).alias("t")).collect()}
    assert got == expected


@MANY
@given(st.lists(st.integers(0, 10 * 86400 * 1_000_000), min_size=40, max_size=80))
def test_time_ago_ladder(spark, micros):
    as_of = dt.datetime(2024, 1, 31)
    df = spark.createDataFrame([(m, as_of - dt.timedelta(microseconds=m)) for m in micros if (m // 1_000_000) not in (60, 3600)],
                               "m long, ts timestamp")
    for r in df.select("m", L.time_ago("ts", F.lit(as_of).cast("timestamp")).alias("s")).collect():
        assert r.s == spoken(r.m), r.m
