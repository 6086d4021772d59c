"""Fields over tiles: settled in one round where the ring shows that they are, in more where it doesn't; far columns."""

import random

import test_tiles as plain

from splatlake.operators import navfield


def counted(monkeypatch):
    calls = []
    own = navfield.written
    monkeypatch.setattr(navfield, "written", lambda df, name: calls.append(name) or own(df, name))
    return calls


def test_rounds_of_fields(spark, monkeypatch):
    calls = counted(monkeypatch)
    rng = random.Random(9)
    spans = [(x, z, 0, 100) for x in range(100, 156) for z in range(-20, 20) if rng.random() < 0.88]
    navfield.watershed(navfield.border_distance(plain.frame(spark, spans), 2, 6), 2, 6)
    assert calls.count("dist") == 1 and calls.count("steps") == 1


def test_fields_that_reach_over_a_ring(spark, monkeypatch):
    calls = counted(monkeypatch)
    spans = [(x, z, 0, 100) for x in range(97, 163) for z in range(-35, 33)]
    link = plain.plain_links(spans, 1, 4)
    dist = plain.plain_distance(link)
    field = navfield.border_distance(plain.frame(spark, spans), 1, 4)
    assert {(r.gx, r.gz, r.top): r.dist for r in field.collect()} == dist and max(dist.values()) > 2 * navfield.STRAIGHT * navfield.RING
    assert {r.id: r.region for r in navfield.watershed(field, 1, 4).collect()} == plain.plain_watershed(link, dist)
    assert calls.count("dist") > 1


def test_columns_beyond_a_million(spark):
    spans = [(x + 2_900_000, z, t, r) for x, z, t, r in plain.ground()]
    link = plain.plain_links(spans, 2, 6)
    found = navfield.watershed(navfield.border_distance(plain.frame(spark, spans), 2, 6), 2, 6).collect()
    pieces = {}
    for s, region in plain.plain_watershed(link, plain.plain_distance(link)).items():
        pieces.setdefault(region, set()).add(s)
    groups = {}
    for r in found:
        groups.setdefault(r.region, set()).add(plain.number((r.gx, r.gz, r.top)))
    assert len(found) == len(spans) and sorted(map(sorted, groups.values())) == sorted(map(sorted, pieces.values()))
