"""Observed-remove sets against a plain set of dots, and the laws of merging."""

import random

import pytest

from backuplake.operators import ordered, replicated
from backuplake.operators.replicated import State, merge

OPS = "actor string, counter bigint, element string, is_removal boolean, seen map<string,bigint>"


class Replica:
    """Keeps its additions and what it has seen; its log is what the library gets."""

    def __init__(self, name):
        self.name, self.entries, self.vector, self.log = name, set(), {}, []

    def act(self, element, is_removal):
        seen = dict(self.vector)
        self.vector[self.name] = self.vector.get(self.name, 0) + 1
        if is_removal:
            self.entries = {e for e in self.entries if e[0] != element}
        else:
            self.entries.add((element, self.name, self.vector[self.name]))
        self.log.append((self.name, self.vector[self.name], element, is_removal, seen))

    def pull(self, other):
        mine = {e for e in self.entries if e in other.entries or e[2] > other.vector.get(e[1], 0)}
        theirs = {e for e in other.entries if e in self.entries or e[2] > self.vector.get(e[1], 0)}
        self.entries = mine | theirs
        self.vector = {a: max(self.vector.get(a, 0), other.vector.get(a, 0)) for a in {*self.vector, *other.vector}}


def simulated(seed, steps=150):
    rng, replicas = random.Random(seed), [Replica(n) for n in "abc"]
    for _ in range(steps):
        r = rng.choice(replicas)
        if rng.random() < 0.15:
            r.pull(rng.choice(replicas))
        else:
            r.act(rng.choice(["x", "y", "z", None, ""]), rng.random() < 0.4)
    return replicas


def states(spark, replicas):
    entries = "element string, actor string, counter bigint"
    return [
        State(spark.createDataFrame(sorted(r.entries, key=str), entries), spark.createDataFrame(sorted(r.vector.items()), "actor string, counter bigint"))
        for r in replicas
    ]


def values(state):
    return {tuple(r) for r in state.entries.collect()}, {tuple(r) for r in state.vector.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_merging_is_one_state_in_any_order(spark, seed):
    replicas = simulated(seed)
    a, b, c = states(spark, replicas)
    whole = Replica("whole")
    for r in replicas:
        whole.pull(r)
    want = whole.entries, set(whole.vector.items())
    assert values(merge([a, b, c])) == want
    assert values(merge([merge([c, a]), b])) == want
    assert values(merge([a, merge([b, merge([a, c])]), c])) == want
    assert values(merge([a, a])) == values(a)


@pytest.mark.parametrize("seed", [3, 4])
def test_logs_give_the_states(spark, seed):
    replicas = simulated(seed)
    log = spark.createDataFrame([op for r in replicas for op in r.log] + [(None, 1, "x", True, {}), ("a", None, "x", True, {"a": 99})], OPS)
    for r, state in zip(replicas, states(spark, replicas)):
        assert values(replicated.apply(log, state.vector)) == (r.entries, set(r.vector.items()))
    whole = Replica("whole")
    for r in replicas:
        whole.pull(r)
    assert values(replicated.apply(log)) == (whole.entries, set(whole.vector.items()))


def test_an_addition_that_a_removal_did_not_see_stays(spark):
    a, b = Replica("a"), Replica("b")
    a.act("x", False)
    b.pull(a)
    b.act("x", True)
    a.act("x", False)
    merged = merge(states(spark, [a, b]))
    assert [tuple(r) for r in replicated.elements(merged).collect()] == [("x", 1)]


def test_numbers_follow_the_order_over_blocks(spark, monkeypatch, rows):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 10)
    ops = spark.createDataFrame([("a", i) for i in range(100, 0, -1)] + [("b", 5), (None, 1)], "actor string, at int")
    assert rows(replicated.numbered(ops, ["at"]), "actor", "at", "counter") == [*[("a", i, i) for i in range(1, 101)], ("b", 5, 1)]
