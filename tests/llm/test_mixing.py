from collections import Counter
from fractions import Fraction
from math import ceil, floor

from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import mixing


def deviations(order, weights):
    """The largest distance, in blocks, of any source from its exact share after any slot."""
    total, seen, worst = sum(map(Fraction, weights.values())), Counter(), Fraction(0)
    share = {s: Fraction(w) / total for s, w in weights.items()}
    last = dict.fromkeys(weights, 0)
    for t, s in enumerate(order, 1):
        # Between two of its blocks a source only falls behind: its extremes are just before and just after a block.
        worst = max(worst, abs(seen[s] - (t - 1) * share[s]), abs(seen[s] + 1 - t * share[s]))
        seen[s] += 1
        last[s] = t
    return max([worst, *(abs(seen[s] - len(order) * share[s]) for s in weights)])


def order_of(blocks, weights):
    """The sources slot by slot; each one's blocks must come in their order."""
    seen, out = Counter(), []
    for s, block in mixing.in_slots(blocks, weights):
        assert block == seen[s]
        seen[s] += 1
        out.append(s)
    assert seen == Counter({s: n for s, n in blocks.items() if n})
    return out


def earliest_deadline_first(blocks, weights):
    """The schedule written down plainly: at every slot look at every source's next block."""
    left, out = {s: n for s, n in blocks.items() if n}, []
    while left:
        live = [s for s in left if weights[s] > 0] or list(left)
        total = sum(Fraction(weights[s]) or 1 for s in live)
        share = {s: (Fraction(weights[s]) or 1) / total for s in live}
        done, slot = dict.fromkeys(live, 0), 0
        while all(left.get(s) for s in live):
            open_blocks = [(ceil((done[s] + 1) / share[s]), s) for s in live if floor(done[s] / share[s]) <= slot]
            _, s = min(open_blocks)
            out.append(s)
            done[s] += 1
            left[s] -= 1
            slot += 1
        left = {s: n for s, n in left.items() if n}
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.just(0.0), st.floats(1e-3, 1), st.integers(1, 5)), st.integers(0, 30)), min_size=1, max_size=8))
def test_slot_by_slot_against_the_plain_schedule(sources):
    weights = {f"s{i}": w for i, (w, _) in enumerate(sources)}
    blocks = {f"s{i}": n for i, (_, n) in enumerate(sources)}
    assert order_of(blocks, weights) == earliest_deadline_first(blocks, weights)


def test_rows_against_the_plain_schedule(spark):
    rows = [(i, "hot" if i % 3 == 0 else None if i % 10 == 1 else "" if i % 10 == 2 else f"s{i % 4}") for i in range(1500)]
    got = mixing.schedule(spark.createDataFrame(rows, "doc_id long, source string"), {"hot": 0.4, "s1": 0.3, "": 0.1}, block=7).collect()
    sizes = Counter(s for _, s in rows)
    name = lambda s: "" if s is None else f"={s}"  # noqa: E731  as the schedule breaks ties
    weights = {name(s): {"hot": 0.4, "s1": 0.3, "": 0.1}.get(s, 0.1) for s in sizes}
    want = earliest_deadline_first({name(s): -(-n // 7) for s, n in sizes.items()}, weights)
    found = {}
    for r in got:
        found.setdefault(r.slot, set()).add(name(r.source))
    assert [found[t] for t in range(len(want))] == [{s} for s in want]


def test_the_plan_is_written_in_parts(spark):
    blocks, weights = {"a": 30, "b": 11, "c": 1}, {"a": 0.5, "b": 0.2, "c": 0.3}
    rows = mixing.plan(spark, blocks, weights, rows=10).orderBy("slot").collect()
    assert [(r.s, r.block) for r in rows] == list(mixing.in_slots(blocks, weights)) and [r.slot for r in rows] == list(range(42))
    assert mixing.plan(spark, {}, {}).count() == 0


def test_every_source_stays_within_one_block_of_its_exact_weight():
    weights = {"a": 0.618, "b": 0.38, "c": 0.0015, "d": 0.0005}
    blocks = {s: int(w * 50_000) + 100 for s, w in weights.items()}
    order = order_of(blocks, weights)
    assert len(order) == sum(blocks.values()) and deviations(order[:50_000], weights) < 1


def test_five_thousand_sources_and_a_hot_one():
    weights = {"hot": 1 / 3} | {f"s{i}": 2 / 3 / 5000 * (1 + i % 7 / 10) for i in range(5000)}
    blocks = {s: int(w * 60_000) + 3 for s, w in weights.items()}
    order = order_of(blocks, weights)
    assert len(order) == sum(blocks.values()) and deviations(order[:50_000], weights) < 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(1e-4, 1), min_size=1, max_size=12), st.integers(1, 40))
def test_any_weights_keep_the_bound_until_a_source_runs_out(weights, n):
    weights = {f"s{i}": w for i, w in enumerate(weights)}
    order = order_of(dict.fromkeys(weights, n), weights)
    first_out = min(max(t for t, s in enumerate(order) if s == k) for k in weights) + 1
    assert len(order) == n * len(weights) and deviations(order[:first_out], weights) < 1


def docs(spark):
    rows = [(i, f"t{i}", None if i % 10 == 0 else "hot" if i % 3 == 0 else f"s{i % 4}", i) for i in range(3000)] + [(7, "t7", "s3", 7)] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, source string, slot long")


def test_schedule_places_each_row_once_and_follows_weights(spark):
    d = docs(spark)
    weights = {"hot": 0.5, "s1": 0.25}
    got = mixing.schedule(d, weights, block=10).collect()
    assert len(got) == 3002 and len({r.position for r in got}) == 3002
    assert Counter((r.doc_id, r.source) for r in got) == Counter((r.doc_id, r.source) for r in d.collect())
    order = [r.source for r in sorted(got, key=lambda r: r.position)]
    share = {"hot": 0.5} | dict.fromkeys(("s0", "s1", "s2", "s3", None), 0.25)
    assert deviations([order[t] for t in range(0, 800, 10)], share) < 1


def test_ties_of_weights_and_of_keys_have_a_fixed_order(spark):
    rows = [(i % 50, s) for i in range(400) for s in "ba"]
    d = spark.createDataFrame(rows, "doc_id long, source string")
    first, again = (sorted((r.position, r.source, r.doc_id) for r in mixing.schedule(x, {"a": 1, "b": 1}, block=4).collect()) for x in (d, d.repartition(7)))
    assert first == again and [s for _, s, _ in first[:8]] == ["a"] * 4 + ["b"] * 4


def test_mix_keeps_rows_and_columns_and_empty_table(spark):
    d = docs(spark)
    d = d.selectExpr("*", "1 as __key", "2 as __Position", "3 as position", "4 as bucket", "5 as s", "6 as h")
    out = mixing.mix(d)
    assert out.columns == d.columns and Counter(map(tuple, out.collect())) == Counter(map(tuple, d.collect()))
    assert mixing.schedule(d.limit(0)).count() == 0


def test_schedule_follows_the_weights_with_a_hot_source_and_many_small_ones(spark):
    rows = [(i, "hot" if i < 1500 else f"s{i % 199}") for i in range(5500)]
    weights = {"hot": 0.33} | {f"s{i}": 0.67 / 199 for i in range(199)}
    got = mixing.schedule(spark.createDataFrame(rows, "doc_id long, source string"), weights, block=1).collect()
    assert sorted(r.position for r in got) == list(range(5500))
    seen, total = Counter(), sum(weights.values())
    for t, r in enumerate(sorted(got, key=lambda r: r.position)[:4000], 1):
        seen[r.source] += 1
        assert all(abs(seen[s] - t * weights[s] / total) < 1 + 1e-9 for s in ("hot", "s0", "s77", r.source))


def test_sources_of_weight_zero_come_last():
    order = order_of({"a": 5, "b": 7, "none": 3, "empty": 0}, {"a": 1, "b": 0.1, "none": 0, "empty": 1})
    assert len(order) == 15 and order[12:] == ["none"] * 3
