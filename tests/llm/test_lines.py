import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliant.llm import lines

SCHEMA = "doc_id long, text string, _gone string, n int, line string, pos int"
STRIP = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(STRIP))


def brute(rows, at_least, keep_first=False):
    seen, first = Counter(), {}
    for d, t in sorted(dict.fromkeys(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        own = {key(x) for x in (t or "").split("\n")} - {""}
        seen.update(own)
        for k in own:
            first.setdefault(k, d)
    out = []
    for d, t in rows:
        parts = (t or "").split("\n")
        kept = [x for x in parts if seen[key(x)] < at_least or keep_first and first.get(key(x), -1) == d]
        out.append((d, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def rows_of():
    rng = random.Random(5)
    pool = ["Footer", " footer\t", "ÉCOLE", "école", "a", "Ä b\r", " x", "menu", "x" * 5000]
    rows = []
    for i in range(40):
        rows.append((i, "\n".join(rng.choice([*pool, f"own {i} {j}", ""]) for j in range(rng.randint(1, 9)))))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "footer"), (103, "footer"), (104, "footer\nmine"), (None, "footer\nx y"), (None, None)]
    rows.append((200, "\n".join(["footer", "solo line"] * 3000)))
    return rows


@pytest.mark.parametrize(("at_least", "batches", "fanout"), [(10, 4, 4), (3, 5, 2), (1, 3, 2)])
def test_matches_brute_force(spark, at_least, batches, fanout):
    rows = rows_of()
    df = spark.createDataFrame([(d, t, "x", 1, "y", 2) for d, t in rows], SCHEMA).repartition(3)
    got = lines.drop_common_lines(df, at_least=at_least, batches=batches, fanout=fanout)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got.collect()), key=str) == brute(rows, at_least)
    assert {"line", "pos"} <= set(got.columns)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("foliant_run_")]


def test_first_document_keeps_its_lines(spark):
    rows = [(d, t) for d, t in rows_of() if d != 103]
    df = spark.createDataFrame([(d, t, "x", 1, "y", 2) for d, t in rows], SCHEMA).repartition(3)
    got = lines.drop_common_lines(df, at_least=10, keep_first=True)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got.collect()), key=str) == brute(rows, 10, True)


def test_empty_table(spark):
    assert lines.drop_common_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_runs_of_limit_one_store_unseen_lines(spark):
    runs = lines.LineRuns(spark, 1, fanout=3)
    for part in ([1, 2, 3], [3, 4], [4, 5], [1, 6]):
        runs.add(spark.createDataFrame([(x, x, 0) for x in part], "k1 long, k2 long, doc long"))
    assert [len(x) for x in runs.levels] == [1, 1]
    assert sorted((r.k1, r.n) for r in runs.totals().collect()) == [(x, 1) for x in range(1, 7)]
    runs.drop()


def test_merge_join_reads_runs_in_place(spark):
    runs = lines.LineRuns(spark, 2)
    batch = spark.range(50).select(F.col("id").alias("k1"), F.col("id").alias("k2"), F.col("id").alias("doc"))
    runs.add(batch)
    run = runs.runs()[0]
    plan = batch.hint("merge").join(run, ["k1", "k2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1
    runs.drop()
