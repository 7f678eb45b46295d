import hashlib
import random
import zlib

import numpy as np
import pytest

from lavka.llm import prefix_trie as P
from lavka.llm.queries import shared_starts

ROWS = "conv_id long, turn long, role string, text string"


def conversations(rng, n, deepest):
    """Few different turns, so that many conversations begin alike; copies, gaps, repeated rows."""
    turns = [(rng.choice(["user", "assistant", "", None]), rng.choice([None, "", "hi", "é日", "x" * 40])) for _ in range(4)]
    rows, whole = [], []
    for conv in range(n):
        path = [rng.choice(turns[:rng.choice([1, 1, 2, 4])]) for _ in range(rng.randint(1, deepest))]
        if whole and rng.random() < 0.5:
            path = rng.choice(whole)[:rng.randint(1, deepest)] + (path[:2] if rng.random() < 0.5 else [])
        whole.append(path)
        rows += [(conv * 7, None if i == 0 and rng.random() < 0.5 else i, *turn) for i, turn in enumerate(path)]
    rng.shuffle(rows)
    return rows


def by_conversation(rows):
    out = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            out.setdefault(conv, []).append((turn is not None, turn or 0, role, hashlib.sha256(text.encode()).hexdigest(), text))
    return {c: [(r, t) for *_, r, _, t in sorted(turns)] for c, turns in out.items()}


def rebuilt(paths):
    out = {}
    for c, own in paths.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = paths.get(c - c % 100 if c >= 0 else -(-c - -c % 100), [])[:h] + own[h:]
    return out


def brute(paths):
    nodes = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    children = {}
    for node in nodes:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def below(node):
        yield node
        for child in children.get(node, []):
            yield from below(child)

    out = []
    for node, members in nodes.items():
        tree = list(below(node))
        ends = ",".join(str(c) for c in sorted(members) if len(paths[c]) == len(node))
        out.append((
            min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), len(children.get(node, [])),
            sum(q not in children for q in tree), sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in tree if q),
            hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("cell", [P.CELL, 1, 3])
def test_against_brute_force(spark, cell):
    """Cells of one and three turns cut nearly all conversations."""
    for seed, n, deepest in ((1, 120, 6), (2, 25, 30)):
        rows = conversations(random.Random(seed), n, deepest)
        found = P.conversation_trie(spark.createDataFrame(rows, ROWS), cell).collect()
        assert sorted(map(tuple, found), key=str) == brute(by_conversation(rows))


def test_rebuilt_conversations(spark):
    rng = random.Random(3)
    rows = [(conv * 5 - 300, *rest) for conv, *rest in conversations(rng, 130, 7) if conv % 11 or conv > 400]
    made = shared_starts(P.turn_rows(spark.createDataFrame(rows, ROWS)))
    expected = rebuilt(by_conversation(rows))
    assert any(not path for path in expected.values())
    assert sorted(map(tuple, P.trie(*made).collect()), key=str) == brute(expected)


def test_many_equal_conversations(spark, monkeypatch):
    """A third and more are alike: they are spread over ranges, and their ids are hashed in pieces."""
    monkeypatch.setattr(P, "TEXT", 60)
    rows = [(c, t, "user", f"text {t}") for c in range(900) for t in range(3)] + [(c, 0, "user", "other") for c in range(900, 1300)]
    frame = spark.createDataFrame(rows, ROWS)
    found = P.conversation_trie(frame)
    assert sorted(map(tuple, found.collect()), key=str) == brute(by_conversation(rows))
    turns = P.turn_rows(frame)
    ranged = P.in_ranges(P.paths(turns, turns.select("conv").distinct()))
    sizes = [r["count"] for r in ranged.groupBy("range").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 700


def test_sparse_table():
    rng = np.random.default_rng(1)
    values = rng.integers(-1, 5, 200)
    table = P.SparseTable(values)
    at, bound = rng.integers(0, 200, 500), rng.integers(0, 6, 500)
    for i, b, left, right in zip(*(v.tolist() for v in (at, bound, table.left(at, bound), table.right(at, bound))), strict=True):
        assert all(values[left + 1:i + 1] >= b) and (left == 0 or values[left] < b)
        assert all(values[i + 1:right + 1] >= b) and (right == 199 or values[right + 1] < b)
    low = rng.integers(0, 200, 300)
    high = low + rng.integers(0, 200 - low)
    assert table.least(low, high).tolist() == [min(values[a:b + 1]) for a, b in zip(low, high, strict=True)]


def test_nulls_repeats_clashing_columns_and_empty(spark):
    long = "word " * 20_000
    rows = [(None, 0, "user", "lost"), (None, None, None, None), (4, 1, None, long), (4, 1, None, long), (4, None, "a", None),
            (9, None, None, None), (2 ** 40, 5, "user", ""), (2 ** 40, 5, "user", "tie"), (-7, 0, "user", "")]
    extra = spark.createDataFrame(rows, ROWS).selectExpr(
        "*", "text as conv", "text as depth", "role as a", "role as b", "turn as size", "turn as n", "text as path", "text as range",
        "text as _text", "turn as _one", "text as _digest", "turn as cell")
    found = P.conversation_trie(extra).collect()
    assert sorted(map(tuple, found), key=str) == brute(by_conversation(rows))
    nothing = extra.where("1 = 0")
    assert P.conversation_trie(nothing).collect() == []
    assert P.trie(*shared_starts(P.turn_rows(nothing))).collect() == []
