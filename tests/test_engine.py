from __future__ import annotations

import math
import random
import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ringview.functions import scalars as S
from ringview.operators import collections as K
from ringview.operators import deltas as D
from ringview.operators.gmr import Gmr, Stored, V, constant
from ringview.operators.ordered import running_sums, sums_before
from ringview.sources import adaptors as A
from ringview.streaming import views as W


def rows(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=repr)


def gmr(spark, data, *variables):
    kinds = ", ".join(f"{v} long" for v in variables)
    return Gmr(spark.createDataFrame(data, f"{kinds}, {V} long"), variables)


# Algebra


def test_scan_join_sum(spark) -> None:
    r = Gmr.scan(spark.createDataFrame([(1, 2), (1, 2), (3, 3)], "a long, b long"), {"a": "X", "b": "Y"})
    s = Gmr.scan(spark.createDataFrame([(2, 5), (3, 7)], "b long, c long"), {"b": "Y", "c": "Z"})
    assert rows((r * s).sum(["Z"]).df) == [(5, 2), (7, 1)]
    assert rows(r.where("X = Y").df) == [(3, 3, 1)]
    assert rows(Gmr.scan(r.df, [("X", "A"), ("Y", "A")]).df) == [(3, 1)]
    assert rows((r - r).sum(["X"]).pruned().df) == []
    assert rows((r * constant(r.df, 3)).sum().df) == [(9,)]
    assert rows(r.where("X > 9").sum().df) == [(0,)]


def test_sums_keep_rows_apart_until_merged(spark) -> None:
    r = gmr(spark, [(1, 2)], "X")
    assert rows((r + r).df) == [(1, 2), (1, 2)] and rows((r + r).sum(["X"]).df) == [(1, 4)]
    with pytest.raises(ValueError, match="same variables"):
        r + gmr(spark, [(1, 2)], "Y")


def test_lift_exists_absent_look_up(spark) -> None:
    r = gmr(spark, [(1, 2), (1, -2), (2, 5), (3, 1)], "X")
    assert rows(r.exists().df) == [(2, 1), (3, 1)]
    assert rows(r.sum(["X"]).lift("L").df) == [(1, 0, 1), (2, 5, 1), (3, 1, 1)]
    assert rows(r.lift("X", F.lit(2)).df) == [(2, 1)]
    assert rows(r.exists().absent(gmr(spark, [(1, 7), (2, 8)], "X")).df) == [(1, 7)]
    view = gmr(spark, [(2, 10)], "X")
    assert rows(r.look_up(view).sum(["X"]).df) == [(1, 0), (2, 50), (3, 0)]
    assert rows(r.look_up(view, F.lit(100)).sum(["X"]).df) == [(1, 0), (2, 50), (3, 100)]
    assert rows(r.slice(view).df) == [(2, 5)]


EXPRESSIONS = {
    "join": D.Sum(D.rel("R", "A", "B") * D.rel("S", "B", "C"), ("A",)),
    "self join": D.Sum(D.rel("R", "A", "B") * D.rel("R", A="X", B="B"), ("A",)),
    "union": D.Sum(D.rel("R", "A", "B") + D.rel("S", B="A", C="B"), ("A",)),
    "exists": D.Sum(D.Exists(D.Sum(D.rel("R", "A", "B"), ("B",))) * D.rel("S", "B", "C"), ("C",)),
    "lift": D.Sum(D.Lift(D.Sum(D.rel("R", "A", "B"), ("A",)), "M"), ("M",)),
    "scalar lift": D.Sum(D.Where(D.Lift(D.Sum(D.rel("S", "B", "C")), "M") * D.rel("R", "A", "B"), "M > A"), ("A",)),
    "difference": D.Sum(D.rel("R", "A", "B") - D.Where(D.rel("R", "A", "B"), "A > B"), ("B",)),
}


@pytest.mark.parametrize("name", EXPRESSIONS)
def test_change_equals_recomputation(spark, name) -> None:
    rnd = random.Random(name)
    draw = lambda n, lo: [(rnd.randrange(4), rnd.randrange(4), rnd.choice(lo)) for _ in range(n)]
    env = {"R": gmr(spark, draw(12, [1]), "A", "B"), "S": gmr(spark, draw(10, [1]), "B", "C")}
    changes = {"R": gmr(spark, draw(5, [1, -1]), "A", "B"), "S": gmr(spark, draw(4, [1, -1]), "B", "C")}
    e = EXPRESSIONS[name]
    by = e.by
    maintained = e.after(env, changes).sum(by).pruned()
    fresh = e.rows({k: env[k] + changes[k] for k in env}).sum(by).pruned()
    assert rows(maintained.df) == rows(fresh.df)
    stored = {k: Stored(g.sum(g.vars).pruned().df, g.vars, g.df) for k, g in env.items()}
    assert rows(e.after(stored, changes).sum(by).pruned().df) == rows(fresh.df)


def test_views_from_a_stream(spark, tmp_path) -> None:
    schemas = {"R": ["A", "B"], "S": ["B", "C"]}
    rnd = random.Random(5)
    events = [(rnd.choice("RS"), rnd.choice([1, 1, -1]), rnd.randrange(3), rnd.randrange(3), rnd.randrange(3)) for _ in range(24)]
    for k in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/{k}.csv").write_text("".join("|".join(map(str, e)) + "\n" for e in events[k * 8 : k * 8 + 8]))
    source = A.read_delimited(spark, f"{tmp_path}/in", "rel string, op int, A long, B long, C long", stream=True)
    base = W.start(f"{tmp_path}/base", spark, schemas, {k: gmr(spark, [], *v) for k, v in schemas.items()})
    view = W.View(W.ViewLog(spark, f"{tmp_path}/view", ("A",)), D.rel("R", "A", "B") * D.rel("S", "B", "C"), lambda: F.col("C"))
    view.bootstrap(base.relations(1))
    W.stream(source, base, {"v": view}, schemas, f"{tmp_path}/checkpoint").awaitTermination()

    def expected(upto):
        r, s, out, n = Counter(), Counter(), Counter(), Counter()
        for rel, op, a, b, x in upto:
            (r if rel == "R" else s)[(a, b) if rel == "R" else (b, x)] += op
        for (a, b), m in r.items():
            for (b2, x), k in s.items():
                if b == b2:
                    out[a] += m * k * x
                    n[a] += m * k
        return sorted((a, out[a], n[a]) for a in n if n[a])

    assert rows(view.log.as_of(), "A", V, "__n") == expected(events)
    log = rows(view.log.as_of(1))
    batch = spark.createDataFrame(events[:8], "rel string, op int, A long, B long, C long")
    if rows(view.log.as_of(1), "A", V, "__n") == expected(events[:8]):  # the first file read first
        W.maintain(base, {"v": view}, schemas, batch, 1)
    assert rows(view.log.as_of(1)) == log and rows(view.log.as_of(), "A", V, "__n") == expected(events)
    view.log.compact(2)
    assert rows(view.log.as_of(), "A", V, "__n") == expected(events)


def test_compaction_survives_a_crash(spark, tmp_path) -> None:
    log = W.ViewLog(spark, f"{tmp_path}/log", ("k",))
    part = lambda *x: spark.createDataFrame([(k, v, 1) for k, v in x], f"k string, {V} double, __n long")
    for vid, row in ((0, ("a", 1.0)), (1, ("a", 2.0)), (2, ("b", 4.0))):
        log.write(vid, part(row))
    now = rows(log.as_of())
    zero = W.ViewLog(spark, f"{tmp_path}/zero", ("k",))
    zero.write(0, part(("a", 1.0)))
    for _ in range(2):
        zero.compact(0)
        assert rows(zero.as_of()) == [("a", 1.0, 1)] and zero.compacted() == 0
    (tmp_path / "log/upto=1").mkdir()  # a sum that was not written to its end counts for nothing
    assert log.compacted() is None and rows(log.as_of()) == now
    shutil.copytree(tmp_path / "log/vid=0", tmp_path / "kept")
    log.compact(1)
    assert rows(log.as_of()) == now and sorted(x.name for x in (tmp_path / "log").iterdir()) == ["upto=1", "vid=2"]
    shutil.copytree(tmp_path / "kept", tmp_path / "log/vid=0")  # an old version whose deletion did not happen counts once
    assert rows(log.as_of()) == now
    log.compact(1)
    assert rows(log.as_of()) == now and not (tmp_path / "log/vid=0").exists()
    with pytest.raises(ValueError, match="compacted"):
        log.write(1, part(("a", 9.0)))
    with pytest.raises(ValueError, match="compacted"):
        log.as_of(1, strict=True)
    log.write(4, part(("a", 8.0)))
    log.write(3, part(("c", 5.0)))
    assert rows(log.as_of(3)) == [("a", 3.0, 2), ("b", 4.0, 1), ("c", 5.0, 1)]
    log.compact(4)
    assert rows(log.as_of()) == [("a", 11.0, 3), ("b", 4.0, 1), ("c", 5.0, 1)]


@pytest.mark.parametrize("name", EXPRESSIONS)
def test_a_change_of_a_large_log_equals_recomputation(spark, monkeypatch, name) -> None:
    monkeypatch.setattr("ringview.operators.gmr.KEY_BITS", 8)  # most keys share a bit with another
    rnd = random.Random(name)
    draw = lambda n, lo: [(rnd.randrange(4), rnd.randrange(9), rnd.choice(lo)) for _ in range(n)]
    env = {"R": gmr(spark, draw(12, [1]), "A", "B"), "S": gmr(spark, draw(10, [1]), "B", "C")}
    changes = {"R": gmr(spark, draw(3, [1, -1]), "A", "B"), "S": gmr(spark, draw(3, [1, -1]), "B", "C")}
    stored = {k: Stored(g.sum(g.vars).pruned().df, g.vars, g.df, 1 << 40) for k, g in env.items()}
    e = EXPRESSIONS[name]
    fresh = e.rows({k: env[k] + changes[k] for k in env}).sum(e.by).pruned()
    assert rows(e.after(stored, changes).sum(e.by).pruned().df) == rows(fresh.df)


def test_a_change_joins_a_log_once_and_sums_nothing_before(spark) -> None:
    env = {"R": gmr(spark, [(1, 2, 1)], "A", "B"), "S": gmr(spark, [(2, 3, 1)], "B", "C")}
    stored = {k: Stored(g.sum(g.vars).pruned().df, g.vars, g.df) for k, g in env.items()}
    change = (D.rel("R", "A", "B") * D.rel("S", "B", "C")).change(stored, {"R": gmr(spark, [(5, 2, 1)], "A", "B")})
    plan = change.df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Aggregate" not in plan and rows(change.df) == [(5, 2, 3, 1)]


def test_a_large_log_is_picked_by_bits_before_it_is_joined(spark) -> None:
    many = gmr(spark, [(k, 0, 1) for k in range(5000)], "B", "C")
    stored = {"S": Stored(many.df, many.vars, many.df, 1 << 40)}
    near = D.rel("S", "B", "C").beside(stored, gmr(spark, [(1, 7, 1), (1, 9, 1)], "A", "B"))
    assert {7, 9} <= {r["B"] for r in near.df.collect()} and near.df.count() < 10


def test_a_stream_writes_its_sums_in_proportion_to_what_came_in(spark, tmp_path) -> None:
    schemas = {"R": ["A"], "S": ["A"]}
    (tmp_path / "in").mkdir()
    for k in range(10):
        (tmp_path / f"in/{k}.csv").write_text("".join(f"R|1|{200 * k + i}\n" for i in range(200)))
    source = A.read_delimited(spark, f"{tmp_path}/in", "rel string, op int, A long", stream=True, files_per_batch=1)
    base = W.start(f"{tmp_path}/base", spark, schemas, {k: gmr(spark, [], *v) for k, v in schemas.items()})
    view = W.View(W.ViewLog(spark, f"{tmp_path}/view", ()), D.rel("R", "A"))
    sums, compact = [], W.ViewLog.compact

    def counted(log, vid):
        compact(log, vid)
        sums.append(log.as_of().count())

    with pytest.MonkeyPatch.context() as m:
        m.setattr(W.ViewLog, "compact", counted)
        W.stream(source, base, {"n": view}, schemas, f"{tmp_path}/checkpoint", compact_every=1).awaitTermination()
    assert 0 < len([x for x in sums if x]) <= 4 and rows(view.log.as_of(), "__n") == [(2000,)] and base.logs["R"].as_of().count() == 2000
    assert not list((tmp_path / "base/S").glob("vid=[1-9]*"))  # a batch without rows of a relation leaves no version of it


def test_what_rounding_leaves_is_no_row(spark) -> None:
    old = Gmr(spark.createDataFrame([(1, 0.1), (1, 0.2), (2, 0.5)], f"X long, {V} double"), ("X",))
    change = Gmr(spark.createDataFrame([(1, -0.3)], f"X long, {V} double"), ("X",))
    for e, left in ((D.Sum(D.Exists(D.rel("R", "X")), ("X",)), [(2, 1)]), (D.Sum(D.Lift(D.Sum(D.rel("R", "X"), ("X",)), "M"), ("X", "M")), [(2, 0.5, 1)])):
        assert rows(e.after({"R": old}, {"R": change}).sum(e.by).pruned().df) == left
    tiny = Gmr(spark.createDataFrame([(1, 1e-30)], f"X long, {V} double"), ("X",))
    assert rows(tiny.exists().df) == [(1, 1)]


def test_running_sums(spark) -> None:
    rnd = random.Random(3)
    data = [(rnd.choice("ab"), rnd.randrange(40), rnd.randrange(9)) for _ in range(300)]
    df = spark.createDataFrame(data, "g string, k long, v long").repartition(3)
    for ranges in (1, 2, 7, 50):
        up, down, each = running_sums(df, "k", ["v"], ranges=ranges), running_sums(df, "k", ["v"], descending=True, ranges=ranges), running_sums(df, "k", ["v"], group=["g"], ranges=ranges)
        assert rows(up) == sorted(((g, k, v, sum(x[2] for x in data if x[1] < k)) for g, k, v in data), key=repr)
        assert rows(down) == sorted(((g, k, v, sum(x[2] for x in data if x[1] > k)) for g, k, v in data), key=repr)
        assert rows(each) == sorted(((g, k, v, sum(x[2] for x in data if x[1] < k and x[0] == g)) for g, k, v in data), key=repr)
    assert running_sums(df.limit(0), "k", ["v"]).count() == 0
    points = spark.createDataFrame([(5,), (5,), (99,), (-1,)], "k long")
    assert rows(sums_before(points, df, "k", "v")) == sorted([(-1, 0), (5, sum(x[2] for x in data if x[1] < 5)), (99, sum(x[2] for x in data))], key=repr)


def test_replaced_slices(spark) -> None:
    view, new = (spark.createDataFrame(x, "k long, j long, v long") for x in ([(1, 1, 5), (1, 2, 6), (2, 1, 7)], [(1, 9, 1)]))
    assert rows(W.replace_slice(view, new, ["k"])) == [(1, 9, 1), (2, 1, 7)]
    assert rows(W.replace_slice(view, new, [])) == [(1, 9, 1)]


def test_batches_end_where_the_tag_changes_or_they_are_full(spark) -> None:
    e = spark.createDataFrame([(k, t) for k, t in enumerate("aaabba")], "seq long, t string")
    assert [r[1] for r in rows(W.runs(e, "seq", ["t"]), "seq", "batch")] == [1, 1, 1, 2, 2, 3]
    assert [r[1] for r in rows(W.runs(e, "seq", ["t"], size=2), "seq", "batch")] == [1, 1, 2, 3, 3, 4]


# Collections


def test_bags_sets_and_maps(spark) -> None:
    c = spark.createDataFrame([(1,), (1,), (2,), (None,)], "x long")
    assert rows(K.delete(c, spark.createDataFrame([(1,), (7,), (None,)], "x long"))) == [(1,), (2,)]
    assert K.combine(c, c, "set").count() == 3 and K.combine(c, c).count() == 8
    a, b = (spark.createDataFrame(x, "k long, v long") for x in ([(1, 1), (2, 2)], [(2, 9), (3, 3)]))
    assert rows(K.combine(a, b, "map", ["k"])) == [(1, 1), (2, 9), (3, 3)]
    assert rows(K.upsert(a, b, ["k"], "v", F.col("new.v"), F.col("old.v") + F.col("new.v"))) == [(1, 1), (2, 11), (3, 3)]
    assert rows(K.update(a, a.where("k = 1"), b.where("k = 3"))) == [(2, 2), (3, 3)]
    assert rows(K.set_all(a, v=0)) == [(1, 0), (2, 0)] and K.clear(a).count() == 0
    first, rest = K.delete_with(b, F.col("v") > 1, F.col("k"))
    assert rows(first) == [(2, 9)] and rows(rest) == [(3, 3)]
    with pytest.raises(ValueError, match="no kind"):
        K.combine(a, b, "heap")


def test_vectors_and_readers(spark) -> None:
    v = spark.createDataFrame([(0, 5), (2, 7)], "pos long, value long")
    assert rows(K.at(v, 2)) == [(2, 7)] and rows(K.at(v, 1, default={"value": 0})) == [(1, 0)] and rows(K.at(v, 2, default={"value": 0})) == [(2, 7)]
    assert rows(K.insert_at(v, spark.createDataFrame([(1, 1), (2, 8)], "pos long, value long"))) == [(0, 5), (1, 1), (2, 8)]
    assert rows(K.update_at(v, 0, F.col("value") * 2)) == [(0, 10), (2, 7)] and rows(K.pop(v)) == [(2, 7)]
    taken, left = K.delete_at(v, 2, 0)
    assert rows(taken) == [(2, 7)] and rows(left) == [(0, 5), (2, 0)]
    assert rows(K.nearest(v, "pos", 2, "lt")) == [(0, 5)] and rows(K.nearest(v, "pos", 1, "geq")) == [(2, 7)] and rows(K.nearest(v, "pos", 0, "lt")) == []
    assert rows(K.min_entry(v, "pos")) == [(0, 5)] and K.peek(v).count() == 1 and K.is_empty(K.clear(v))
    assert rows(K.fold(v.where("pos > 9"), s=F.sum("value"))) == [(0,)] and rows(K.size(v)) == [(2,)]
    assert rows(K.equijoin(v, v, ["pos"])) == [(0, 5, 5), (2, 7, 7)] and rows(K.sort(v, F.desc("pos")))[0] == (0, 5)


def test_versions(spark) -> None:
    m = spark.createDataFrame([("a", 1, 1), ("a", 3, 3), ("b", 2, 2)], "k string, vid long, v long")
    assert rows(K.as_of(m, ["k"], 3), "k", "v") == [("a", 1), ("b", 2)] and rows(K.as_of(m, ["k"], 3, strict=False), "k", "v") == [("a", 3), ("b", 2)]
    changes = spark.createDataFrame([("a", 10), ("c", 10)], "k string, v long")
    up = K.upsert_before(m, changes, ["k"], 3, "v", F.col("new.v"), F.col("old.v") + F.col("new.v"))
    assert rows(up) == [("a", 1, 1), ("a", 3, 11), ("b", 2, 2), ("c", 3, 10)]
    assert rows(K.delete_prefix(m, ["k"], 3)) == [("a", 3, 3), ("b", 2, 2)]
    assert rows(K.delete_prefix(m, ["k"], 3, F.col("k") == "b")) == rows(m)
    assert rows(K.update_suffix(m, F.col("k") == "a", 1, "v", F.lit(0))) == [("a", 1, 1), ("a", 3, 0), ("b", 2, 2)]


def test_tagged_logs(spark) -> None:
    log = spark.createDataFrame([(0, "a", 1), (1, "b", 2)], "seq long, tag string, x long")
    new = spark.createDataFrame([(0, 2), (1, 3), (2, 3)], "seq long, x long")
    assert rows(K.log_append(log, new, "b")) == [(0, "a", 1), (1, "b", 2), (2, "b", 2), (3, "b", 3), (4, "b", 3)]
    assert [r[1:] for r in rows(K.log_append(log, new, "b", unique=True))] == [("a", 1), ("b", 2), ("b", 3)]
    assert [r[1] for r in rows(K.log_runs(K.log_append(log, new, "b")), "seq", "run")] == [1, 2, 2, 2, 2]


# Scalars


def test_scalars(spark) -> None:
    one = spark.range(1).select(F.lit(-7).alias("x"), F.lit("abcdef").alias("s"), F.lit("1999-2-3").alias("d"))
    got = one.select(
        S.divide_int("x", 2), S.divide("x", F.lit(0)), S.modulo("x", F.lit(4)), S.modulo("x", F.lit(0)), S.reciprocal(F.lit(4)), S.substring("s", 1, 2), S.regex_match("b", "s"), S.regex_match("a.c", "s"),
        S.date_code(S.parse_date("d")), S.date_part("MONTH", S.parse_date("d")), S.average(F.lit(0), F.lit(0)), S.to_int(F.lit(-1.9)),
    ).first()
    assert tuple(got) == (-3, 0.0, -3, 0, 0.25, "bc", 0, 1, 19990203, 2, 0.0, -1)
    p = lambda *x: tuple(F.lit(float(k)) for k in x)
    angles = spark.range(1).select(S.vec_length(p(3, 4, 0)), S.vector_angle(p(1, 0, 0), p(0, 1, 0)), S.dihedral_angle(p(1, 0, 0), p(0, 0, 0), p(0, 0, 1), p(0, 1, 1))).first()
    assert angles[0] == 5 and angles[1] == pytest.approx(math.pi / 2) and abs(angles[2]) == pytest.approx(math.pi / 2)
    with pytest.raises(ValueError, match="no date part"):
        S.date_part("week", "d")
    with pytest.raises(ValueError, match="taken"):
        S.register("abs", S.absolute)
    with S.scope():
        S.register("mine", lambda x: x / 2, takes=["double"], returns="long")
        with pytest.raises(ValueError, match="taken"):
            S.register("mine", lambda x: x, takes=["long"])
        assert one.select(S.call("mine", F.lit("9"))).first()[0] == 4
        with pytest.raises(ValueError, match="2 arguments"):
            S.call("mine", 1, 2)
    with pytest.raises(ValueError, match="no function"):
        S.call("mine", 1)
    assert one.select(S.substring("s", 1, 5, strict=True)).first()[0] == "bcdef"
    with pytest.raises(Exception, match="out of range"):
        one.select(S.substring("s", 2, 5, strict=True)).collect()


# Sources


def test_delimited_sources(spark, tmp_path) -> None:
    (tmp_path / "a.csv").write_text("0|1|x|2020-01-02\n1||y|\n")
    got = A.read_delimited(spark, f"{tmp_path}/a.csv", "k long, s string, d date", deletions=True)
    assert [(r["op"], r["k"], r["s"], str(r["d"])) for r in got.collect()] == [(1, 1, "x", "2020-01-02"), (-1, 0, "y", "1900-01-01")]
    (tmp_path / "t.csv").write_text("1|a\n1|a\n2|b\n")
    assert A.static_table(spark, f"{tmp_path}/t.csv", "k long, s string").count() == 2
    (tmp_path / "f.txt").write_text("  12ab \n   3   \n")
    assert rows(A.read_fixed_width(spark, f"{tmp_path}/f.txt", [("k", 4, "long"), ("s", 3, "string")])) == [(12, "ab"), (3, "")]
    A.write(got.drop("d"), f"{tmp_path}/out", "json")
    assert A.read_json(spark, f"{tmp_path}/out", "op int, k long, s string").count() == 2


def test_multiplexed_and_generated_sources(spark) -> None:
    r, s = spark.createDataFrame([(1, 2)], "a long, b long"), spark.createDataFrame([(3, 0), (4, 1)], "c long, event int")
    wide = A.multiplex({"R": r, "S": s}, {"R": "a", "S": "c"}, seed=1)
    assert rows(A.demultiplex(wide, "s", {"x": "c"})) == [(-1, 3), (1, 4)] and rows(A.demultiplex(wide, "r", {"b": "b"})) == [(1, 2)]
    made = A.random_rows(spark, 50, "a long, b double, c string, d date, e boolean", seed=4)
    assert rows(made) == rows(A.random_rows(spark, 50, "a long, b double, c string, d date, e boolean", seed=4)) and made.distinct().count() == 50
    assert A.in_sequence(r, r).select("source").distinct().count() == 2
    assert rows(A.first_available(spark, r.limit(0), r)) == [(1, 2)] and rows(A.constant(spark, [(5,)], "x long")) == [(5,)]


def test_order_book(spark) -> None:
    m = spark.createDataFrame([(1.0, 11, "B", 100.0, 9.0), (2.0, 12, "S", 50.0, 10.0), (3.0, 11, "E", 30.0, 0.0), (4.0, 11, "D", 0.0, 0.0), (5.0, 99, "D", 1.0, 1.0)], "t double, id long, action string, volume double, price double")
    bids, asks = A.order_book(m)
    assert rows(bids, "op", "broker_id", "volume", "price") == [(-1, 1, 30.0, 9.0), (-1, 1, 70.0, 9.0), (1, 1, 100.0, 9.0)] and rows(asks, "op", "volume") == [(1, 50.0)]
