import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from foliant.llm import quality

SCHEMA = "doc_id long, text string, source string, n_words int, row string, kept string"
STRIP = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    on = defaultdict(set)
    hosts = defaultdict(set)
    low = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(STRIP))
    for d, t, s in rows:
        hosts[s or ""].add((d, t))
        for x in (t or "").split("\n"):
            on[s or "", low(x)].add((d, t))
    out = []
    for d, t, s in rows:
        t0, t = t, t or ""
        words = WORD.findall(t)
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        n = Counter(grams)
        cover = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
        full = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(words) < 50 or 100 * len(cover) > 50 * len(words)
        chars = sum(len(low(x)) for x in full)
        common = sum(len(low(x)) for x in full if len(on[s or "", low(x)]) >= max(10, min(100, 0.005 * len(hosts[s or ""]))))
        left = chars - common
        out.append((
            d, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), len(cover), failed,
            not failed and not (common and (left < 0.3 * chars or left < 200)),
        ))
    return sorted(out, key=str)


def rows_of():
    rng = random.Random(8)
    line = lambda n: " ".join(rng.choice(["alpha", "beta#", "Gamma", "é", "<d>", "x1"]) + str(rng.randint(0, 40)) for _ in range(n))
    shared = [line(12), line(30), " SHARED " + line(3)]
    rows = []
    for i in range(80):
        own = [line(rng.randint(1, 20)) for _ in range(rng.randint(1, 8))]
        own += rng.sample(shared, rng.randint(0, 3)) + rng.choice([[], [own[0]], own])
        rng.shuffle(own)
        rows.append((i, "\n".join(own), rng.choice(["h1", "h2", None])))
    rows += [(100, None, "h1"), (101, "", "h1"), (102, " \n\t\n", None), (103, "a b c", "h1"), (104, "a a a a", "h2"), (105, "w " * 60, "h1")]
    rows += [(106, "\n".join(shared * 3), "h1"), (3, rows[3][1], rows[3][2]), (3, "other " + line(70), "h1"), (None, line(90), "h2"), (107, line(9000), "h2")]
    return rows


def test_matches_brute_force(spark):
    rows = rows_of()
    df = spark.createDataFrame([(d, t, s, 1, "r", "k") for d, t, s in rows], SCHEMA).repartition(3)
    got = quality.quality(df).collect()
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert sorted((tuple(r[c] for c in cols) for r in got), key=str) == brute(rows)
    assert {r.kept for r in got} == {True, False}


def test_empty_table(spark):
    assert quality.quality(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_template_of_a_very_large_host(spark):
    """A line of some hundred documents is common however many other documents its host has."""
    template = " ".join(f"template{i}" for i in range(60))
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(70)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(100000)))))
    host = spark.range(60_000).select("id", F.when(F.col("id") < 150, F.concat(F.lit(template), F.lit("\nown "), F.col("id"))).otherwise(words).alias("text"), F.lit("big").alias("source"))
    got = {r.doc_id: r.kept for r in quality.quality(host.withColumnRenamed("id", "doc_id")).where("doc_id < 300").collect()}
    assert not any(got[i] for i in range(150)) and all(got[i] for i in range(150, 300))


def test_hashes_that_are_too_many_to_send_are_joined(spark, monkeypatch):
    df = spark.createDataFrame([(d, t, s, 1, "r", "k") for d, t, s in rows_of()], SCHEMA).repartition(3)
    sent, joined = (quality.line_depletion(df, "doc_id", "text", "source", sent=n).collect() for n in (1 << 20, 0))
    assert sorted(sent, key=str) == sorted(joined, key=str) and sent


def test_equal_rows_are_judged_as_one(spark):
    """What two equal rows have besides common lines is not added up."""
    shared = " ".join(f"shared{i}" for i in range(60))
    rows = [(i, f"{shared}\n{'own' + str(i):x<150}", "h") for i in range(12)]
    df = spark.createDataFrame([(d, t, s, 1, "r", "k") for d, t, s in [*rows, rows[0], (0, rows[0][1], "other")]], SCHEMA)
    got = quality.quality(df, least_left=0.1).collect()
    assert sorted((r.doc_id, r.kept) for r in got) == sorted([(i, False) for i in range(12)] + [(0, False), (0, True)])


def test_lines_met_once_are_moved_as_one_hash(spark):
    """Each such line is moved once, as one number, whatever the size of its text."""
    n, lines = 4000, 25
    text = F.concat_ws("\n", F.transform(F.sequence(F.lit(1), F.lit(lines)), lambda i: F.concat_ws(" ", F.lit("line"), F.xxhash64("doc_id", i), F.xxhash64(i, "doc_id"))))
    df = spark.range(n).withColumnRenamed("id", "doc_id").select("doc_id", text.alias("text"), F.lit("host").alias("source"))
    store = spark.sparkContext._jsc.sc().statusStore()

    def moved():
        own = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(own.apply(i).shuffleWriteBytes() for i in range(own.size()))

    before = moved()
    assert quality.line_depletion(df, "doc_id", "text", "source").where("common_chars > 0").collect() == []
    assert 0 < moved() - before < 40 * n * lines
