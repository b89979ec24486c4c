import random

from conftest import rows

from lodestrata.operators.intervals import periods_and_gaps

SCHEMA = "log string, a long, b long, piece string, extra int"


def brute(spans):
    by = {}
    for log, a, b in spans:
        if a is not None and b is not None and a < b:
            by.setdefault(log, []).append((a, b))
    out = set()
    for log, iv in by.items():
        merged = []
        for a, b in sorted(iv):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        out |= {(log, "period", a, b) for a, b in merged}
        out |= {(log, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return sorted(out, key=repr)


def run(spark, spans):
    df = spark.createDataFrame([(x, a, b, "clash", 1) for x, a, b in spans], SCHEMA).drop("piece")
    return sorted((tuple(r) for r in periods_and_gaps(df, ["log"], "a", "b").select("log", "piece", "a", "b").collect()), key=repr)


def test_touching_nested_repeated_and_bad_bounds(spark):
    spans = [("x", 1, 5), ("x", 5, 7), ("x", 2, 3), ("x", 9, 12), ("x", 9, 12), ("x", 20, 20), ("x", 30, 25), ("x", None, 4), ("x", 4, None), (None, 1, 2), (None, 4, 5), ("y", 3, 3)]
    assert run(spark, spans) == brute(spans)


def test_random_with_a_hot_log_over_many_chunks(spark):
    rng = random.Random(4)
    spans = [("hot" if rng.random() < 0.5 else f"l{rng.randrange(9)}", s := rng.randrange(3000), s + rng.choice([0, 1, 2, 5, 5, 40])) for _ in range(4000)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keep all chunks
    try:
        assert run(spark, spans) == brute(spans)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_empty(spark):
    assert rows(periods_and_gaps(spark.createDataFrame([], SCHEMA), ["log"], "a", "b")) == []
