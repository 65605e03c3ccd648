"""Analytics, training and evaluation operators on small tables with known results."""

import pytest
from pyspark.sql import functions as F

from reportmill.functions import vocabulary as V
from reportmill.operators import inspection as I
from reportmill.operators import metrics as M
from reportmill.operators import relational as R
from reportmill.operators import training as T
from reportmill.sources import sinks, tables


def test_accuracy_and_recall(spark):
    df = spark.createDataFrame([("p", "p"), ("p", "n"), ("n", "n"), ("n", "n")], "t string, p string")
    got = {r["label"]: r for r in M.class_metrics(df, [], "t", "p", ["p", "n", "u"]).collect()}
    assert got["p"]["recall"] == 0.5 and got["p"]["precision"] == 1.0 and got["u"]["f1"] == 0.0
    avg = M.averages(M.class_metrics(df, [], "t", "p", ["p", "n", "u"]), []).first()
    assert avg["n"] == 4 and avg["macro_recall"] == 0.75


def test_precedence(spark):
    rows = [(1, "negative"), (1, "uncertain"), (1, "positive"), (2, "negative"), (2, "uncertain"), (3, "negative"), (3, "no_evidence"), (4, "no_evidence")]
    got = {r["study"]: r["status"] for r in M.aggregate_local(spark.createDataFrame(rows, "study int, label string"), ["study"], "label").collect()}
    assert got == {1: "positive", 2: "uncertain", 3: "negative", 4: "unknown"}


def test_training_dedup(spark):
    rows = [("a", "ACL", "seen.", "pos"), ("b", "ACL", "seen.", "pos"), ("c", "ACL", "x.", "pos"), ("d", "ACL", "x.", "neg")]
    clean, clash = T.training_dedup(spark.createDataFrame(rows, "id string, target string, text string, label string"), "target", "text", "label", "id")
    assert [(r["id"], r["n_rows"]) for r in clean.collect()] == [("a", 2)]
    assert clash.count() == 2


def test_novelty(spark):
    train = spark.createDataFrame([("ACL", "seen.")], "target string, text string")
    test = spark.createDataFrame([("ACL", "seen."), ("MCL", "seen.")], "target string, text string")
    assert {r["target"]: r["is_novel"] for r in T.novelty(test, train, ["target", "text"]).collect()} == {"ACL": False, "MCL": True}


def test_weights_are_capped(spark):
    df = spark.createDataFrame([("ACL",)] * 100 + [("MCL",)], "target string")
    w = [r["weight"] for r in R.capped_weights(df, ["target"], 2.0).collect()]
    assert max(w) / min(w) <= 2.0 + 1e-9


def test_contrastive_uses_least_used(spark):
    rows = spark.createDataFrame([(i, 0, f"t{i}", "T", ["a", "b", "c"]) for i in range(30)] + [(99, 0, "none", "N", [])], "study int, idx int, normalized_clause string, clause string, safe_targets array<string>")
    got = T.contrastive(rows, 1).groupBy("target").count().collect()
    assert {r["target"]: r["count"] for r in got} == {"a": 10, "b": 10, "c": 10, None: 1}
    dealt = {r["target"]: r["count"] for r in T.contrastive(rows, 1, 3).groupBy("target").count().collect()}
    assert sum(dealt.values()) == 31 and max(dealt[t] for t in "abc") - min(dealt[t] for t in "abc") <= 3


def test_guards_leave_one_target(spark):
    usable = spark.createDataFrame([(1, 0, "the acl is torn.", "The ACL is torn.", "ACL")], "study int, idx int, normalized_clause string, raw string, target string")
    found = spark.createDataFrame([(1, [0], t) for t in V.TARGETS if t not in ("ACL", "MCL")], "study int, source_indices array<int>, target string")
    safe = T.safe_targets(usable, T.guard_keys(found))
    assert [r["safe_targets"] for r in safe.collect()] == [["MCL"]]
    assert [(r["target"], r["label"]) for r in T.contrastive(safe, 5).collect()] == [("MCL", "no_evidence")]
    alone = T.safe_targets(usable, T.guard_keys(found.limit(0))).first()["safe_targets"]
    assert alone == [t for t in V.TARGETS if t != "ACL"]


def test_explicit_cues(spark):
    cases = [("ACL", "the acl is not visualized.", True), ("Effusion", "small joint effusion.", True), ("Fracture", "moderate joint effusion.", False), ("Synovitis", "minimal sinovyal kalinlasma.", True)]
    one = spark.range(1).select(*[I.explicit_cue(t, F.lit(c)).alias(str(i)) for i, (t, c, _) in enumerate(cases)]).first()
    assert list(one) == [want for *_, want in cases]


def test_alignment(spark):
    texts = ["Hallazgos: Rotura del LCA. Derramé articular leve.", "Findings: ACL; intact.", None]
    got = T.surface_clauses(spark.createDataFrame(list(enumerate(texts)), "study int, report string")).collect()
    first = [r for r in got if r["study"] == 0]
    assert [r["raw"] for r in first] == ["Hallazgos: Rotura del LCA.", "Derramé articular leve."] and all(r["diagnostic"] for r in first)
    assert any(r["raw"] is None for r in got if r["study"] == 1)


def test_splits_keep_families(spark):
    rows = [(i, f"f{i if i > 60 else i % 7}", ["x", "y"][i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, "study int, family string, kind string")
    got = T.assign_splits(df, "study", "family", ["kind"])
    assert got.count() == 400
    assert {r["violations"] for r in T.leaks(got, ["split_group", "family"]).collect()} == {0}
    n = {r["split"]: r["count"] for r in got.groupBy("split").count().collect()}
    assert 0.6 < n["train"] / 400 < 0.8 and min(n.values()) > 40
    kinds = {(r["kind"], r["split"]): r["count"] for r in got.groupBy("kind", "split").count().collect()}
    assert all(abs(kinds[k, s] - 200 * ratio) < 20 for k in "xy" for s, ratio in T.SPLITS.items())
    assert T.assign_splits(df.limit(0), "study", "family", ["kind"]).count() == 0
    assert T.assign_splits(df, "study", "family", ["kind"]).exceptAll(T.assign_splits(df, "study", "family", ["kind"])).count() == 0
    with pytest.raises(ValueError, match="ratios"):
        T.check_ratios({"train": 0.7, "test": 0.2})


def test_wilson(spark):
    got = spark.range(1).select(M.wilson(F.lit(8), F.lit(10)).alias("w"), M.wilson(F.lit(0), F.lit(0)).alias("none")).first()
    assert got["w"]["low"] == pytest.approx(0.4901625, abs=1e-6) and got["w"]["high"] == pytest.approx(0.9433178, abs=1e-6) and got["none"] is None


def test_same_rows(spark):
    a = spark.createDataFrame([(1, "x", 0.0), (1, "x", -0.0), (2, None, None), (2, "", None), (3, "y", 1.0)], "i int, t string, v double")
    b = spark.createDataFrame([("x", 1, 0.0), ("", 2, None), ("", 2, None), ("z", 3, 1.0)], "t string, i long, v double").select("i", "t", "v")
    assert [tuple(r) for r in R.same_rows(a, b).collect()] == [(a.exceptAll(b).count(), b.exceptAll(a).count())] == [(3, 2)]
    assert tuple(R.same_rows(a.limit(0), b.limit(0)).first()) == (0, 0)
    twice = a.select("i", "t", F.col("i").alias("t"))
    assert tuple(R.same_rows(twice, twice.limit(0)).first()) == (5, 0)
    assert [f.dataType.simpleString() for f in R.same_rows(a, b).schema] == ["bigint", "bigint"]


def test_same_rows_deals_no_text(spark, capsys):
    texts = spark.createDataFrame([(i, "word " * 2000 + str(i), "en") for i in range(40)], "i int, t string, lang string")
    R.same_rows(texts, texts.orderBy("lang")).explain()
    plan = capsys.readouterr().out
    assert "rangepartitioning" not in plan and plan.count("sha2(") >= 2


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'two\nlines, "quoted"', [1, 2]), (2, None, [])], "id int, text string, xs array<int>")
    sinks.write_csv(df, str(tmp_path / "t.csv"), single=True)
    back = tables.csv(spark, str(tmp_path / "t.csv"), "id string, text string, xs string").orderBy("id").collect()
    assert back[0]["text"] == 'two\nlines, "quoted"' and back[0]["xs"] == "[1,2]"
    tree = tables.file_tree(spark, str(tmp_path), r"/([^/]+\.csv)/", "part-*").collect()
    assert [(r["group"], r["n_files"]) for r in tree] == [("t.csv", 1)]
    assert "| 1 |" in sinks.markdown(df.select("id"))
    assert sinks.human_bytes(1536) == "1.5 KiB"
