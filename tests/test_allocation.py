"""Greedy allocations against a plain loop over all that was given before."""

from __future__ import annotations

import random

import pytest

from korridor.operators.allocation import _Ends, allocate, place_bundles


def test_allocate_against_a_loop(spark):
    r = random.Random(5)
    duties = [(r.choice([1, 1, 2, None]), i, s := r.randint(0, 300), s + r.randint(-1, 40)) for i in range(150)]
    fleet = [(g, 100 * (g or 0) + k) for g in (1, 2, None) for k in range(4)] + [(9, 999)]
    got = {x.duty: x.vehicle for x in allocate(spark.createDataFrame(duties, "g int, duty int, s long, e long").repartition(4), spark.createDataFrame(fleet, "g int, vehicle int"), "g", "duty", "vehicle", "s", "e", 5).collect()}
    want, given, cursor = {}, [], {}
    for g, i, s, e in sorted(duties, key=lambda d: (d[2], d[1])):
        pool = sorted(v for h, v in fleet if h == g)
        turn = pool[cursor.get(g, 0) :] + pool[: cursor.get(g, 0)]
        free = [v for v in turn if e >= s and not any(w == v and s < b + 5 and a < e + 5 for w, a, b in given)]
        want[i] = free[0] if free else None
        if free:
            given.append((free[0], s, e))
            cursor[g] = (pool.index(free[0]) + 1) % len(pool)
    assert got == want and any(v is None for v in want.values())


@pytest.mark.parametrize(("n", "span", "vehicles"), [(300, 3000, 5), (300, 400, 60), (200, 100_000, 3)])
def test_stretches_are_turned_as_one_loop_would(spark, n, span, vehicles):
    """Many cuts and none, few vehicles and more than duties: the plain loop's answer, from stretches side by side."""
    r = random.Random(n + span)
    duties = [(1, i, s := r.randint(0, span), s + r.randint(0, 60)) for i in range(n)]
    got = {x.d: x.v for x in allocate(spark.createDataFrame(duties, "g int, d int, s long, e long").repartition(3), spark.createDataFrame([(1, k) for k in range(vehicles)], "g int, v int"), "g", "d", "v", "s", "e", 7, 500).collect()}
    ends, cursor, want = [None] * vehicles, 0, {}
    for _, i, s, e in sorted(duties, key=lambda d: (d[2], d[1])):
        free = next((k % vehicles for k in range(cursor, cursor + vehicles) if ends[k % vehicles] is None or ends[k % vehicles] + 7 <= s), None)
        want[i] = free
        if free is not None:
            ends[free], cursor = e, (free + 1) % vehicles
    assert got == want


def test_first_free_place():
    r = random.Random(2)
    for n in (1, 2, 3, 7, 20):
        ends, plain, cursor = _Ends(n), [None] * n, 0
        for t in range(400):
            end = t + r.randint(0, 3 * n)
            want = next((k % n for k in range(cursor, cursor + n) if plain[k % n] is None or plain[k % n] <= t), None)
            assert ends.take(cursor, t, end) == want
            if want is not None:
                plain[want], cursor = end, (want + 1) % n


def test_bundles_never_overlap_and_come_in_order(spark):
    r = random.Random(8)
    slots = [(r.choice([1, 2]), k, r.randint(0, 4), s := r.randint(0, 100), s + 10) for k in range(20)]
    pool = [(r.choice([1, 2]), i, r.randint(0, 12), s := r.randint(0, 100), s + 8) for i in range(60)]
    got = {}
    for x in place_bundles(spark.createDataFrame(slots, "g int, slot int, n int, s int, e int").repartition(3), spark.createDataFrame(pool, "g int, item int, who int, s int, e int"), "g", "slot", "n", "item", "who", "s", "e").collect():
        got.setdefault((x.g, x.slot), []).append(x.item)
    want = {}
    for g in (1, 2):
        now, unused = {i: (w, s, e) for h, i, w, s, e in pool if h == g}, sorted(i for h, i, *_ in pool if h == g)
        for _, k, n, s, e in sorted(x for x in slots if x[0] == g):
            for i in list(unused):
                if len(want.get((g, k), [])) >= n:
                    break
                if not any(j != i and w == now[i][0] and s < b and a < e for j, (w, a, b) in now.items()):
                    want.setdefault((g, k), []).append(i)
                    now[i] = (now[i][0], s, e)
                    unused.remove(i)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()} and want
