import datetime as dt
import random

from skein import registry


def test_all_roots_equal_brute_force(spark, tmp_path):
    rng, start = random.Random(6), dt.datetime(2024, 1, 1)
    # Users come in phases, so that some reach others only one way.
    rows = [(i, start + dt.timedelta(hours=i), rng.randrange(i // 12 * 3, i // 12 * 3 + 4), rng.choice(["view", "error"]), float(rng.randrange(200))) for i in range(48)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    users = [r[2] for r in rows]
    edges = {(a, b) for a, b in zip(users, users[1:], strict=False) if a != b}
    nodes, levels = {x for e in edges for x in e}, {}
    for root in nodes:
        seen, front, depth = {root: 0}, {root}, 0
        while front:
            depth += 1
            front = {b for a, b in edges if a in front and b not in seen}
            seen |= dict.fromkeys(front, depth)
        levels[root] = seen
    run = {n: registry.queries()[n](spark, str(tmp_path)).collect() for n in ("transitive_closure", "dependency_chain", "impact_analysis")}
    reach = {r: len(set(s) - {r}) + any((x, r) in edges for x in s) for r, s in levels.items()}
    assert {r.root: r.reached for r in run["transitive_closure"]} == {r: n for r, n in reach.items() if n}
    assert {(r.root, r.id, r.depth) for r in run["dependency_chain"]} == {(r, x, n) for r, s in levels.items() for x, n in s.items() if n <= 2}
    got = {r.root: (r.direct, r.direct + r.transitive, r.fan_out) for r in run["impact_analysis"]}
    assert got == {r: (sum(b == r for _, b in edges), sum(r in levels[x] and x != r for x in nodes), sum(a == r for a, _ in edges)) for r in nodes}
