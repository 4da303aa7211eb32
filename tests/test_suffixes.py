"""Registrable domains against a plain reading of the rules."""

import random

from sitewright.operators import suffixes as SX

RULES = ["// comment", "", "com", "uk", "co.uk  // note", "*.ck", "!www.ck", "jp", "*.kawasaki.jp", "!city.kawasaki.jp", "deep.host.com", ".lead"]
KNOWN = {
    "a.b.com": ("com", "b.com"), "com": ("com", None), "x.co.uk": ("co.uk", "x.co.uk"), "co.uk": ("co.uk", None), "www.x.co.uk.": ("co.uk", "x.co.uk"), "b.uk": ("uk", "b.uk"), "x.any.ck": ("any.ck", "x.any.ck"), "any.ck": ("any.ck", None),
    "ck": ("ck", None), "www.ck": ("ck", "www.ck"), "a.www.ck": ("ck", "www.ck"), "city.kawasaki.jp": ("kawasaki.jp", "city.kawasaki.jp"), "a.city.kawasaki.jp": ("kawasaki.jp", "city.kawasaki.jp"), "b.a.kawasaki.jp": ("a.kawasaki.jp", "b.a.kawasaki.jp"),
    "unknown": ("unknown", None), "a.unknown": ("unknown", "a.unknown"), "A.B.COM": ("com", "b.com"), "x.deep.host.com": ("deep.host.com", "x.deep.host.com"), "host.com": ("com", "host.com"), "127.0.0.1": (None, None), "[::1]": (None, None), "a.lead": ("lead", "a.lead"),
}


def plain(host):
    labels, best = host.split("."), 1
    rules = [rule.split()[0] for rule in RULES if rule and not rule.startswith("//")]
    for start in range(len(labels)):
        tail = ".".join(labels[start:])
        if "!" + tail in rules:
            best = len(labels) - start - 1
            break
        if tail in rules:
            best = max(best, len(labels) - start)
        if start and "*." + tail in rules:
            best = max(best, len(labels) - start + 1)
    best = min(best, len(labels))
    return ".".join(labels[-best:]), ".".join(labels[-best - 1 :]) if len(labels) > best else None


def test_rules(spark):
    rules = SX.rule_table(spark.createDataFrame([(rule,) for rule in RULES], "value string"))
    rows = spark.createDataFrame([(host, "x", "y") for host in (*KNOWN, None, "", "a.b.com")], "host string, key string, apexes string")
    got = {r.host: (r.suffix, r.apex) for r in SX.with_apex(rows, rules).collect()}
    assert got == KNOWN | {None: (None, None), "": (None, None)}
    assert SX.with_apex(rows, rules).count() == len(KNOWN) + 3
    assert SX.with_apex(rows.limit(0), rules).count() == 0


def test_random_hosts(spark):
    draw = random.Random(1)
    parts = ["www", "a", "ck", "kawasaki", "jp", "city", "co", "uk", "com", "deep", "host"]
    hosts = {".".join(draw.choice(parts) for _ in range(draw.randrange(1, 6))) for _ in range(400)}
    rules = SX.rule_table(spark.createDataFrame([(rule,) for rule in RULES], "value string"))
    got = {r.host: (r.suffix, r.apex) for r in SX.resolved(spark.createDataFrame([(host,) for host in hosts], "host string"), rules).collect()}
    assert got == {host: plain(host) for host in hosts}
