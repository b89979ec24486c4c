import json
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import oplog
from lodestrata.operators.fold import fold_log
from lodestrata.streaming.fold import apply, new_state, record, settle

LOG = "coll string, rec string, _seq long, _op string, document string, embedding array<float>, metadata string"
BASE = "coll string, rec string, document string, embedding array<float>, metadata string"


def brute(log, base):
    state = {(c, r): {"seq": None, "d": d, "e": e, "m": json.loads(m) if m else {}} for c, r, d, e, m in base}
    done = set()
    for c, r, seq, op, d, e, m in sorted(log, key=lambda x: x[2]):
        if r is None or (c, r, seq) in done:
            continue
        done.add((c, r, seq))
        op, key = (op or "").lower(), (c, r)
        live = key in state
        if op == "delete":
            state.pop(key, None)
        elif (op == "add" and not live) or op == "upsert" or (op == "update" and live):
            s = state.setdefault(key, {"seq": None, "d": None, "e": None, "m": {}})
            s["seq"] = seq
            s["d"], s["e"] = (d if d is not None else s["d"]), (e if e is not None else s["e"])
            for k, v in (json.loads(m) if m else {}).items():
                s["m"].pop(k, None)
                if v is not None:
                    s["m"][k] = v
    return state


def result(df):
    return {(r["coll"], r["rec"]): {"seq": r["last_seq"], "d": r["document"], "e": r["embedding"], "m": {k: json.loads(v) for k, v in r["metadata"].items()}} for r in df.collect()}


def random_log(n, keys, seed):
    rng = random.Random(seed)
    out = []
    for seq in range(1, n + 1):
        r = "hot" if rng.random() < 0.3 else rng.choice(keys)
        m = {k: v for k, v in (("a", rng.choice([1, 2.5, None])), ("b", rng.choice(["x", None, [1, 2]])), ("c", True)) if rng.random() < 0.5}
        out.append(("k", r, seq, rng.choice(["add", "Update", "UPSERT", "upsert", "delete", "backfill_fn", None]), rng.choice([None, f"d{seq}"]), rng.choice([None, [float(seq)]]), json.dumps(m) if m else None))
    out += rng.sample(out, n // 10)
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("heavy", [50_000, 40])
def test_random_logs_equal_sequential_replay(spark, heavy):
    log = random_log(600, [f"r{i}" for i in range(25)], 1) + [(None, "r1", 5, "add", "x", None, None), ("k", None, 7, "add", "x", None, None)]
    base = [("k", f"r{i}", f"base{i}", [float(i)], '{"a": 7, "z": "keep"}') for i in range(0, 25, 2)] + [("k", "untouched", None, None, None)]
    got = result(fold_log(spark.createDataFrame(log, LOG), spark.createDataFrame(base, BASE), ["coll", "rec"], heavy))
    assert got == brute(log, base)


def test_update_before_starter_has_no_effect(spark):
    log = [("k", "r", 2, "update", "early", None, '{"a": 1}'), ("k", "r", 3, "add", None, None, '{"b": 2}'), ("k", "r", 4, "add", "late", None, None), ("k", "s", 1, "delete", None, None, None)]
    got = result(fold_log(spark.createDataFrame(log, LOG), spark.createDataFrame([], BASE), ["coll", "rec"]))
    assert got == {("k", "r"): {"seq": 3, "d": None, "e": None, "m": {"b": 2}}}


def test_empty_and_unreadable_metadata(spark):
    empty = spark.createDataFrame([], LOG)
    assert fold_log(empty, spark.createDataFrame([], BASE), ["coll", "rec"]).count() == 0
    log = [("k", "r", 1, "add", "d", None, "{broken"), ("k", "r", 2, "update", None, None, "[1]")]
    got = result(fold_log(spark.createDataFrame(log, LOG), spark.createDataFrame([], BASE), ["coll", "rec"]))
    assert got == {("k", "r"): {"seq": 2, "d": "d", "e": None, "m": {}}}


def model(log, base):
    """Offset ids and kinds of change by sequential replay."""
    top, place, kind = max([o for _, o in base], default=0), {i: o for i, o in base}, {}
    live, inlog = {i for i, _ in base}, set(place)
    for i, seq, op in sorted(log, key=lambda x: x[1]):
        if op == "delete":
            if i in live:
                live.discard(i)
                if i in inlog:
                    kind[i] = "delete_existing"
                else:
                    kind.pop(i, None), place.pop(i, None)
        elif op in ("add", "upsert") and i not in live:
            live.add(i)
            if i in inlog:
                kind[i] = "overwrite_existing"
            else:
                top += 1
                place[i], kind[i] = top, "add_new"
        elif i in live and op in ("update", "upsert"):
            kind.setdefault(i, "update_existing")
    return {(i, place[i], k) for i, k in kind.items()}


def test_offset_ids_and_kinds_of_change(spark):
    rng = random.Random(8)
    ops = [(f"r{rng.randrange(12)}", n, rng.choice(["add", "update", "upsert", "delete"])) for n in range(1, 200)]
    base = [(f"r{i}", 10 + i) for i in range(0, 12, 3)]
    log = spark.createDataFrame([(i, n, o, None, None, None) for i, n, o in ops], "id string, log_offset long, op string, document string, embedding array<float>, metadata string")
    segment = spark.createDataFrame([(i, o, "d", None, None) for i, o in base], "id string, offset_id long, document string, embedding array<float>, metadata string")
    got = {tuple(r) for r in oplog.materialize(log, segment).select("id", "offset_id", "mat_op").collect()}
    assert got == model(ops, base)
    assert oplog.count_records(log, segment).first()["n"] == oplog.current_records(log, segment).count()


def test_partition_key_keeps_chunks_together(spark):
    df = spark.createDataFrame([("doc-1",), ("doc-22",), ("a-b",)], "id string")
    assert [r[0] for r in df.select(oplog.partition_key(F.col("id"), True)).collect()] == ["doc", "doc", "a-b"]


def test_stream_state_equals_replay_in_any_order():
    log = random_log(200, ["a", "b"], 3)
    for seed in range(20):
        mine, order = {}, log + log[::7]
        random.Random(seed).shuffle(order)
        for n, (_, r, seq, op, d, e, m) in enumerate(order):
            apply(mine.setdefault(r, new_state()), {"op": op, "log_offset": seq, "document": d, "embedding": e, "metadata": m})
            if n % 5 == seed % 5:
                settle(mine[r])
        got = {}
        for r, s in mine.items():
            settle(s)
            s = record(s)
            if r is not None and s["live"]:
                got["k", r] = (s["last_log_offset"], s["document"], s["embedding"], s["metadata"])
        assert got == {k: (s["seq"], s["d"], s["e"], s["m"]) for k, s in brute(log, []).items()}


def test_stream_state_is_bounded_by_a_promise_of_lateness():
    s = new_state()
    for n in range(1000):
        apply(s, {"op": "upsert", "log_offset": n, "document": str(n), "embedding": None, "metadata": None})
        settle(s, 10)
    assert len(s["starts"]) <= 12 and record(s)["document"] == "999"
    apply(s, {"op": "delete", "log_offset": 995, "document": None, "embedding": None, "metadata": None})
    settle(s, 10)
    assert s["starts"] == [996, 997, 998, 999] and record(s)["live"]
