"""Reports with known outcomes, under both policies, and the parts they are made of."""

import pytest
from pyspark.sql import functions as F

from reportmill.functions import clauses as C
from reportmill.functions import vocabulary as V
from reportmill.operators import labelling as L

BASE = [
    ("Findings: ACL tear.", {"ACL": "positive"}), ("Findings: No ACL tear.", {"ACL": "negative"}), ("Possible ACL tear.", {"ACL": "uncertain"}), ("Small joint effusion.", {"ACL": "unknown"}),
    ("Clinical history: suspected ACL tear. Findings: ACL intact.", {"ACL": "negative"}),
    ("Hallazgos:\nAdelgazamiento del LCA, correlacionar con antecedentes regionales.\nNo hay derrame articular.", {"Effusion": "negative"}),
    ("Lateral meniscus tear without extrusion.", {"Lateral Meniscus": "positive"}), ("Mild degeneration of the medial meniscus but no tears.", {"Medial Meniscus": "positive"}),
    ("Retinacular defect not seen.Fracture of tibial plateau.", {"Fracture": "positive"}), ("Ligamentos cruzados y colaterales de grosor y señal normales.", {"ACL": "negative", "MCL": "negative"}),
    ("Tears of the cruciate ligaments.", {"ACL": "unknown"}), ("Both menisci are intact.", {"Medial Meniscus": "negative", "Lateral Meniscus": "negative"}),
    ("Tears involve both menisci.", {"Medial Meniscus": "positive", "Lateral Meniscus": "positive"}),
    ("Cartílago de compartimentos femorotibiales de grosor y señal normal.", {"Medial OA": "negative", "Lateral OA": "negative"}),
    ("Eklem sivisi saptanmamistir.", {"Effusion": "negative"}), ("No hay quistes poplíteos.", {"Baker's": "negative"}), ("CONSTATATIONS :\nFractures :\nAucune.", {"Fracture": "negative"}),
    ("ACL intact. ACL intact. ACL intact. ACL tear.", {"ACL": "positive"}), ("ACL intact with mucoid degeneration.", {"ACL": "positive"}),
    ("Medial meniscus tear displaced into the gutter adjacent to the MCL.", {"MCL": "unknown"}), ("MCL:\n  deep MCL; high grade partial tear", {"MCL": "positive"}), ("Arka çapraz ve yan bağlar normal.", {"ACL": "unknown"}),
]
WIDER = [
    ("Findings: small joint effusion.", {"Synovitis": "unknown"}), ("Findings: subchondral bone marrow edema in the medial femoral condyle.", {"Contusion": "unknown"}),
    ("Findings: perisynovial cyst. No other abnormality.", {"Synovitis": "unknown"}), ("Bulgular: Eklem mesafesinde hafif efüzyon izlenmiştir.", {"Effusion": "positive"}),
    ("Bulgular: Eklemde sıvı artışı saptanmamıştır.", {"Effusion": "negative"}), ("Nalaz: Sitna Baker cista.", {"Baker's": "positive"}),
    ("Befund: Gelenkerguss mit verdickter Synovia und synovialen Proliferationen.", {"Synovitis": "positive"}), ("Constatations: Il n'y a pas de trait fracturaire.", {"Fracture": "negative"}),
    ("Bevindingen: Denudatie van het kraakbeen mediaal femorotibiaal met osteofyten.", {"Medial OA": "positive"}),
    ("Findings: Mild to moderate medial and lateral femorotibial chondrosis.", {"Medial OA": "positive", "Lateral OA": "positive"}),
    ("Findings: lateral compartment cartilage: no focal cartilage defects.", {"Lateral OA": "negative"}),
    ("Findings: medial patellofemoral ligament and patellar retinacula are normal.", {"PF OA": "unknown"}),
    ("Bulgular: Lateral menisküste grade I dejenerasyon, medial menisküste grade III dejenerasyon ve yırtık.", {"Medial Meniscus": "positive", "Lateral Meniscus": "positive"}),
    ("Nalaz: Degenerativno promijenjen lateralni menisk, bez znakova rupture.", {"Lateral Meniscus": "positive"}),
    ("Findings: Medial meniscus tear displaced into the gutter adjacent to the MCL.", {"MCL": "unknown"}),
    ("Findings: a stable cystic lesion anterior to the lateral meniscus. Lateral meniscus intact.", {"Lateral Meniscus": "negative"}),
    ("Findings: a cystic lesion in front of the ACL. ACL is intact.", {"ACL": "negative"}),
    ("Findings: preserved medial and lateral tibiofemoral cartilage; focal cartilage loss at the femoral trochlea.", {"Medial OA": "negative", "Lateral OA": "negative", "PF OA": "positive"}),
    ("Findings: ACL tear.", {"ACL": "positive"}),
]


def table(spark, texts):
    return spark.createDataFrame([(i, t) + (None,) * 12 for i, t in enumerate(texts)], "study long, report string, " + ", ".join(f"`{t}` double" for t in V.TARGETS))


@pytest.mark.parametrize(("policy", "cases"), [("v2", BASE), ("v3", WIDER)])
def test_statuses(spark, policy, cases):
    rows = L.supervision(table(spark, [t for t, _ in cases]), policy)
    got = {(r["study"], r["target"]): r for r in rows.collect()}
    assert len(got) == 12 * len(cases)
    wrong = [(cases[i][0], t, s, got[i, t]["status"]) for i, (_, want) in enumerate(cases) for t, s in want.items() if got[i, t]["status"] != s]
    assert not wrong
    assert {r["n"] for r in L.output_violations(rows).collect()} == {0}


def test_confidence_and_evidence(spark):
    texts = ["Findings: ACL tear.", "Possible ACL tear.", "Both menisci are intact.", "ACL intact. ACL tear.", None, ""]
    got = {(r["study"], r["target"]): r for r in L.supervision(table(spark, texts), "v2").collect()}
    assert got[0, "ACL"]["confidence"] > got[1, "ACL"]["confidence"]
    assert got[2, "Medial Meniscus"]["confidence"] < 0.85
    assert "tear" in got[3, "ACL"]["evidence"][0] and "conflict" in got[3, "ACL"]["rationale"]
    assert {got[4, t]["status"] for t in V.TARGETS} == {got[5, t]["status"] for t in V.TARGETS} == {"unknown"}


def test_provenance(spark):
    got = {r["target"]: r for r in L.supervision(table(spark, ["Findings: ACL tear."])).collect()}["ACL"]
    assert got["evidence"][0] == got["evidence_provenance"][0]["evidence"]
    assert "v3_target" in got["detectors"]


def test_segments():
    found = C.segment("Menisco medial de morfología normal,\ninespecífico.\nNo hay derrame.")
    assert len(found) == 2 and "normal, inespecifico" in found[0].text
    assert all(v.kind == "strict" for v in C.views(C.segment("ACL intact. Patellar tendinosis.")))
    assert C.segment(None) == C.segment("") == []


def test_official_labels_win(spark):
    wide = table(spark, ["Findings: ACL tear."]).drop("ACL").withColumn("ACL", L.F.lit(0.0))
    r = {x["target"]: x for x in L.supervision(wide).collect()}["ACL"]
    assert (r["derived_label"], r["official_label"], r["final_label"], r["final_source"]) == (1, 0, 0, "official")
    bad = {x["check"]: x["n"] for x in L.input_violations(wide).collect()}
    assert bad["partial_labels"] == 1


def test_each_report_of_a_batch_is_read_once(spark):
    calls = []

    def number(x):
        calls.append(x)
        return [(len(calls), x, [len(calls)])]

    rows = spark.createDataFrame([(i, [None, "a", "b"][i % 3]) for i in range(90)], "study int, report string").coalesce(1)
    got = rows.select("report", L._udf(number, "array<struct<n:int,t:string,xs:array<int>>>")("report").alias("x")).collect()
    assert all(r["x"][0]["t"] == r["report"] and r["x"][0]["xs"] == [r["x"][0]["n"]] for r in got)
    assert {r["x"][0]["n"] for r in got} == {1, 2, 3}


@pytest.mark.parametrize("policy", ["v2", "v3"])
def test_supervision_joins_once(spark, capsys, policy):
    rows = table(spark, ["Findings: ACL tear.", "Findings: ACL tear.", None, "No joint effusion."])
    made = L.supervision(rows, policy)
    made.select("study", "target", "status", "official_label", "report_sha256").explain()
    assert capsys.readouterr().out.count("Join") == 1
    assert made.count() == 4 * len(V.TARGETS)
    again = rows.unionByName(rows)
    assert L.supervision(again, policy).count() == 8 * len(V.TARGETS)  # repeated studies break the input contract, and are not multiplied
    assert L.supervision(rows.withColumn("study", F.lit(None).cast("long")), policy).count() == 0
