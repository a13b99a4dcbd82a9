"""End to end on the hospital scenario's shapes: two source systems, mismatched keys, a missing field.

HIS keys patients 1..100; EMR writes ``MRN-001``..``MRN-100``. Targets: patients
(subject_id!, name!, gender, dob, dod) and admissions. Expected: ``dod`` is
missing, everything else maps directly from HIS; no EMR table is needed.
"""

import datetime as dt
import random
import uuid

from pyspark.sql import functions as F

from kiln.operators import delivery as D
from kiln.operators import mapping as M
from kiln.operators import pii as I
from kiln.operators import quality as Q
from kiln.operators.cleaning import apply_clean_rules
from kiln.operators.profile import column_stats
from kiln.operators.standard import conform, coverage_audit, readiness
from kiln.plans import helpers as H
from kiln.plans.spec import CleanRule, Field, Mapping, Standard
from kiln.sources.ods import sync_to_ods


def his_emr(spark):
    rnd = random.Random(7)
    patients = [
        (i, f"患者{i}" if i % 2 else f"Name {i}", rnd.choice("MF"), dt.date(1950 + i % 50, 1 + i % 12, 1 + i % 28),
         "138" + str(10000000 + i), f"北京市朝阳区建国路{i}号")
        for i in range(1, 101)
    ]
    admissions = []
    for h in range(1, 301):
        loc = rnd.choice(["HOME", "DIED", "SNF"])
        t0 = dt.datetime(2020, 1, 1) + dt.timedelta(hours=h * 7)
        admissions.append((h, 1 + h % 100, t0, t0 + dt.timedelta(days=3), "EMERGENCY", loc, 1 if loc == "DIED" else 0))
    diagnoses = [(d, f"MRN-{1 + d % 100:03d}", f"I{d % 50:02d}", dt.date(2020, 1, 1) + dt.timedelta(days=d)) for d in range(1, 501)]
    return (
        spark.createDataFrame(patients, "subject_id int, name string, gender string, dob date, phone string, address string"),
        spark.createDataFrame(
            admissions,
            "hadm_id int, subject_id int, admittime timestamp_ntz, dischtime timestamp_ntz, admission_type string, "
            "discharge_location string, hospital_expire_flag smallint",
        ),
        spark.createDataFrame(diagnoses, "diagnosis_id int, patient_mrn string, icd_code string, diagnosis_date date"),
    )


PATIENTS = Standard(
    "patients",
    (Field("subject_id", "INTEGER", False), Field("name", "VARCHAR(100)", False), Field("gender", "VARCHAR(1)"),
     Field("dob", "DATE"), Field("dod", "DATE")),
)
ADMISSIONS = Standard(
    "admissions",
    (Field("subject_id", "INTEGER", False), Field("hadm_id", "INTEGER", False), Field("admittime", "TIMESTAMP", False),
     Field("dischtime", "TIMESTAMP"), Field("admission_type", "VARCHAR(40)", False),
     Field("discharge_location", "VARCHAR(60)"), Field("hospital_expire_flag", "SMALLINT")),
)


def test_hospital_flow(spark):
    pat, adm, dia = his_emr(spark)
    # profile and PII: phone and address found, key column not flagged
    stats = {r.column_name: r for r in column_stats(pat, "patient_info").collect()}
    assert stats["subject_id"].is_unique_candidate and stats["subject_id"].row_count == 100
    scan = {r.column_name: r for r in I.pii_scan(pat).collect()}
    assert scan["phone"].detected_by == "name" and scan["address"].pii_types == "address"
    assert scan["subject_id"].detected_by == "none"

    # mappings: every target field direct from HIS except dod
    maps = [Mapping(f.name, "direct", "his.patient_info", f.name) for f in PATIENTS.fields if f.name != "dod"]
    maps.append(Mapping("dod", "missing"))
    amaps = [Mapping(f.name, "direct", "his.admission_records", f.name) for f in ADMISSIONS.fields]
    maps_df = spark.createDataFrame(
        [(m.target, m.kind, m.source_table, m.source_field) for m in maps + amaps],
        "target_field string, kind string, source_table string, source_field string",
    )
    catalog = spark.createDataFrame(
        [("his", 0, "patient_info", c) for c in pat.columns]
        + [("his", 0, "admission_records", c) for c in adm.columns]
        + [("emr", 1, "diagnoses", c) for c in dia.columns],
        "source_id string, source_order int, table_name string, column_name string",
    )
    assert H.check_mappings(maps_df, catalog).count() == 0
    used = [(r.source_id, r.tables) for r in H.used_sources(maps_df, catalog.select("source_id", "source_order", "table_name").distinct()).collect()]
    assert used == [("his", ["admission_records", "patient_info"])]  # nothing from EMR

    # sync only the used tables, then model, clean, conform
    sid = f"his{uuid.uuid4().hex[:6]}"
    res = sync_to_ods(spark, sid, {"patient_info": pat, "admission_records": adm})
    assert {r.status for r in res.collect()} == {"success"}
    ods_pat = spark.table(f"ods_{sid}.patient_info")
    model = conform(
        apply_clean_rules(M.build_map(ods_pat, maps, PATIENTS), [CleanRule("name", ("trim_whitespace", "coalesce_null"), default="未知")]),
        PATIENTS,
    )
    cov = coverage_audit(model, PATIENTS).collect()
    assert [r.field_name for r in cov if r.filled_rows == 0] == ["dod"]
    rec = readiness(coverage_audit(model.drop("dod"), PATIENTS)).first()
    assert rec.uncovered == 1 and rec.recommendation == "suggest"

    # cross-system keys join after normalising
    joined = M.enrich(dia.withColumn("subject_id", M.normalise_key("patient_mrn")), model, "subject_id", "subject_id", ["name"])
    assert joined.filter(F.col("name").isNull()).count() == 0

    # quality gate, then delivery
    rules = H.rules_from_standard(PATIENTS)
    report = Q.qc_report([Q.check_not_null(model, list(rules.not_null), "patients"), Q.check_unique(model, ["subject_id"], "patients")])
    assert H.qc_gate(report)
    db = f"prod{uuid.uuid4().hex[:6]}"
    out = D.deliver(spark, {"clean_patients": model}, "atomic", db)
    assert out.first().rows == 100 and spark.table(f"{db}.patients").columns == PATIENTS.names
    # expire flag is 1 exactly when the discharge location is DIED
    bad = Q.check_custom(adm, "expire_flag", "(hospital_expire_flag = 1) = (discharge_location = 'DIED')").first()
    assert bad.failures == 0
