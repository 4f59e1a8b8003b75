"""Queries that SQL cannot express, held to plain Python on the smallest tables."""

import hashlib
import re
from collections import defaultdict

import lectern.plans  # noqa: F401
from lectern.operators import chunks
from lectern.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


def rows(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet").collect()


def test_calendar_lanes(spark):
    days = {r.o_orderkey: (r.o_orderdate, r.o_orderkey % 5) for r in rows(spark, "orders")}
    groups = defaultdict(list)
    for r in QUERIES["o_o13_calendar_lanes"](spark, FOLDER).collect():
        day, more = days[r.o_orderkey]
        ordinal = day.toordinal()
        assert r.week.toordinal() == ordinal - ordinal % 7
        groups[r.o_custkey, r.week].append((ordinal, -(ordinal + more), r.o_orderkey, r.lane))
    assert sum(map(len, groups.values())) == len(days)
    for events in groups.values():
        busy = []
        for start, end, _, lane in sorted(events, key=lambda e: e[:3]):
            want = next((i for i, until in enumerate(busy) if until < start), len(busy) if len(busy) < 5 else None)
            assert lane == want
            if want is not None:
                busy[want:want + 1] = [-end]


def test_leases(spark):
    events, names = defaultdict(list), {"click": "claim", "purchase": "complete", "error": "fail"}
    for r in rows(spark, "events"):
        events[r.user_id].append((int(r.ts.timestamp()), names.get(r.event_type)))
    now = max(at for e in events.values() for at, _ in e) - 600
    got = {r.id: (r.status, r.since) for r in QUERIES["o_t2_leases"](spark, FOLDER).collect()}
    assert set(got) == set(events)
    for user, news in events.items():
        status, since = "PENDING", 0
        for at, event in sorted(news, key=lambda e: e[0]):
            if status == "PROCESSING" and at - since > 1800:
                status, since = "PENDING", since + 1800
            if event == "claim" and status in ("PENDING", "FAILED"):
                status, since = "PROCESSING", at
            elif event in ("complete", "fail") and status == "PROCESSING":
                status, since = {"complete": "COMPLETED", "fail": "FAILED"}[event], at
        if status == "PROCESSING" and since + 1800 < now - 2:
            status, since = "PENDING", since + 1800
        assert got[user] == (status, since) or abs(since + 1800 - now) <= 2


def test_entity_groups(spark):
    parts = {r.p_partkey: r for r in rows(spark, "part")}
    never = {(a, b) for k in parts if k % 40 == 0 for a, b in ((k, k + 40), (k + 40, k))}
    kinds = defaultdict(list)
    for k, r in sorted(parts.items()):
        key = "".join(c for c in re.sub("#[0-9]+", "", f"{r.p_brand} {r.p_type}".lower()) if c.isalnum())
        kinds[key, r.p_brand].append(k)
    want = {}
    for (key, brand), members in kinds.items():
        groups = []
        for k in members:
            home = next((g for g in groups if not any((k, m) in never for m in g)), None)
            groups.append([k]) if home is None else home.append(k)
        for g in groups:
            best = max(g, key=lambda k: (parts[k].p_size, -k))
            digest = hashlib.sha256(f"{key}|{brand}|{','.join(map(str, g))}".encode()).hexdigest()[:32]
            want.update({k: (digest, best, len(g), "HIGH" if len(g) > 1 else "MEDIUM") for k in g})
    assert {r.p_partkey: tuple(r)[1:] for r in QUERIES["o_k4_entity_groups"](spark, FOLDER).collect()} == want


def test_chunks_leave_the_worker_in_parts():
    rows = [(1, k, f"k{k}", "ATTACHMENT", "x" * 400) for k in range(10)]
    parts = list(chunks.in_batches(iter(rows), 1000))
    assert [r for p in parts for r in p] == rows and max(len(p) for p in parts) == 3 and list(chunks.in_batches([], 5)) == [[]]
