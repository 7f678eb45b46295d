import hashlib
import random

from lavka.llm.exact_dedup import digest_rows, drop_exact_copies, exact_groups, merge_runs


def lower_ascii(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def brute(rows, pick=max):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(lower_ascii(text), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = pick([i for i in ids if i is not None], default=None)
        kept = False
        for i in sorted(ids, key=lambda i: (i is None, i)):
            now = i == keep and not kept
            kept = kept or now
            out.append((i, keep, len(ids), now, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark, awkward):
    expected = brute([(r.doc_id, r.text) for r in awkward.collect()])
    assert sorted(map(tuple, exact_groups(awkward).collect()), key=str) == expected


def test_smallest_stays_with_any_number_of_runs(spark):
    random.seed(1)
    rows = [(i, random.choice(["a", "A", "b", f"t{i % 50}"])) for i in range(500)]
    random.shuffle(rows)
    for parts, bits in ((1, 4), (7, 1), (40, 2)):
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        merged = merge_runs(digest_rows(frame), keep="min", bits=bits).select("keep_id", "group_size").collect()
        assert sorted(map(tuple, merged)) == sorted({(k, n) for _, k, n, _, _ in brute(rows, min)})


def test_drop_copies_keeps_columns_and_leaves_one_row(awkward):
    left = drop_exact_copies(awkward)
    assert left.columns == awkward.columns
    rows = left.collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=str) == sorted([
        (2, "the CAT sat on the mat."), (4, ""), (5, " \t\n"), (7, rows[0].text if rows[0].doc_id == 7 else next(r.text for r in rows if r.doc_id == 7)),
        (8, "ÉTÉ à la plage"), (9, "été à la plage"), (10, "one"), (10, "other"), (11, "12 34 !?"), (12, "日本語のテキスト"),
    ], key=str)


def test_empty(empty):
    assert exact_groups(empty).collect() == [] and drop_exact_copies(empty).collect() == []


def test_no_python_in_the_plan(awkward):
    plan = exact_groups(awkward)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan and "Pandas" not in plan


def test_runs_are_sorted_and_neighbours_merged(awkward):
    """Also with few partitions, where one round does."""
    merged = merge_runs(digest_rows(awkward.coalesce(2)))
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and plan.count("Aggregate [") == 1
