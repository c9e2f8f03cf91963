"""Outputs that appear together, configurations checked before a job, numbered lines and lines that do not fit."""

import os
from functools import partial

import pytest
from pyspark.sql import functions as F

from medstrand.plans import job
from medstrand.sources import outputs, readers, sinks

FAILING = "raise_error('scanned')"


def rows(spark, n):
    return spark.range(n).withColumnRenamed("id", "k")


def visible(path):
    """Names below a folder, hidden staging and checksum files included."""
    return sorted(os.listdir(path)) if os.path.isdir(path) else []


def test_together(spark, tmp_path):
    base = str(tmp_path)
    tables = {f"{base}/x/a": rows(spark, 5), f"{base}/b": rows(spark, 0)}
    assert outputs.write_together(spark, tables, f"{base}/manifest.json") == {f"{base}/x/a": 5, f"{base}/b": 0}
    back = outputs.read_together(spark, f"{base}/manifest.json")
    assert [df.count() for df in back.values()] == [5, 0]
    assert not [name for name in visible(base) + visible(f"{base}/x") if "staged" in name]


def test_second_table_fails(spark, tmp_path):
    base = str(tmp_path)
    tables = {f"{base}/a": rows(spark, 5), f"{base}/b": rows(spark, 5).withColumn("v", F.expr(FAILING))}
    with pytest.raises(Exception, match="scanned"):
        outputs.write_together(spark, tables, f"{base}/manifest.json")
    assert visible(base) == []
    with pytest.raises(FileNotFoundError):
        outputs.read_together(spark, f"{base}/manifest.json")


def test_second_move_fails(spark, tmp_path):
    """A target that another job makes meanwhile is left as it is, and the first table is taken back."""
    base = str(tmp_path)

    def meddling(df, path):
        df.write.parquet(path)
        os.makedirs(f"{base}/b")

    tables = {f"{base}/a": rows(spark, 5), f"{base}/b": rows(spark, 5)}
    with pytest.raises(OSError):
        outputs.write_together(spark, tables, f"{base}/manifest.json", {f"{base}/b": meddling})
    assert visible(base) == ["b"] and visible(f"{base}/b") == []


@pytest.mark.parametrize("there", ["a", "b", "manifest.json"])
def test_existing_output_stops_before_the_scan(spark, tmp_path, there):
    base = str(tmp_path)
    os.makedirs(f"{base}/{there}")
    tables = {f"{base}/{name}": rows(spark, 5).withColumn("v", F.expr(FAILING)) for name in "ab"}
    with pytest.raises(FileExistsError, match=there):
        outputs.write_together(spark, tables, f"{base}/manifest.json")
    assert visible(base) == [there]


def test_outputs_within_one_another(spark, tmp_path):
    with pytest.raises(ValueError, match="within"):
        outputs.require_absent(spark, [f"{tmp_path}/a", f"{tmp_path}/a/b"])
    with pytest.raises(ValueError, match="within"):
        outputs.require_absent(spark, [f"{tmp_path}/a", f"{tmp_path}/a/"])
    outputs.require_absent(spark, [f"{tmp_path}/a", f"{tmp_path}/ab"])


def test_lines_over_many_splits(spark, tmp_path):
    """Files cut into splits of 1 KB, with empty lines and both line ends, against Python's numbering."""
    texts = {}
    for f in range(3):
        lines = ["" if i % 11 == 3 else f"tök:{f}:{i}" * (1 + i % 4) for i in range(400 + f)]
        texts[f] = lines
        (tmp_path / f"part-{f}.txt").write_bytes(("\r\n" if f == 1 else "\n").join(lines).encode() + (b"\n" if f != 2 else b""))
    want = [(line, i) for i, line in enumerate(line for f in range(3) for line in texts[f])]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        lines = readers.numbered_lines(spark, str(tmp_path))
        got = sorted(((r["line"], r["id"]) for r in lines.collect()), key=lambda x: x[1])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want
    tokens = readers.read_vocabulary(spark, str(tmp_path))
    assert sorted(r["id"] for r in tokens.collect()) == [i for line, i in want if line]


@pytest.mark.parametrize("parts", [1, 4])
def test_vocabulary_parts(spark, tmp_path, parts):
    words = spark.createDataFrame([(i, f"w{i}") for i in range(1000)], "id int, token string").repartition(5)
    path = f"{tmp_path}/v"
    sinks.write_vocabulary(words, path, parts)
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    assert len(files) == parts
    back = {(r["id"], r["token"]) for r in readers.read_vocabulary(spark, path).collect()}
    assert back == {(i, f"w{i}") for i in range(1000)}


def test_empty_file(spark, tmp_path):
    (tmp_path / "v.txt").write_text("")
    assert readers.read_vocabulary(spark, f"{tmp_path}/v.txt").collect() == []


def test_lines_that_do_not_fit(spark, tmp_path):
    lines = ["a|b|", "||", "a|", "a|b|c|", "a|b|c", "a|b", "a", "", 'a|"b|']
    (tmp_path / "x.rrf").write_text("\n".join(lines) + "\n")
    found = {r["_line"]: (r["A"], r["B"], r["_fault"]) for r in readers.rrf_lines(spark, f"{tmp_path}/x.rrf", ["A", "B"]).collect()}
    assert found == {
        "a|b|": ("a", "b", None), "||": (None, None, None), 'a|"b|': ("a", '"b', None), "a|": (None, None, "short"),
        "a|b|c|": (None, None, "long"), "a|b|c": (None, None, "long"), "a|b": (None, None, "open"), "a": (None, None, "short"), "": (None, None, "short"),
    }
    good, bad = readers.read_rrf_checked(spark, f"{tmp_path}/x.rrf", ["A", "B"], ["B"])
    assert good.columns == ["B"] and good.count() + bad.count() == len(lines)


YAML = """
tables:
  patient:
    select_expr: ["CAST(id AS BIGINT) AS person_id", "born || ' 00:00:00' AS raw", "TO_TIMESTAMP(raw) AS px_birth_date"]
    filter_expr: person_id IS NOT NULL
  diagnosis:
    select_expr:
      - CAST(id AS BIGINT) AS person_id
      - TO_TIMESTAMP(at) AS date
      - code AS dx_diagnosis_code
      - "'ICD10CM' AS dx_diagnosis_code_type"
    filter_expr: dx_diagnosis_code IS NOT NULL
number_of_days_threshold: 1
event_date_filter: date >= TIMESTAMP'2012-01-01'
"""


@pytest.fixture
def given(spark, tmp_path):
    (tmp_path / "c.yaml").write_text(YAML)
    tables = {
        "patient": spark.createDataFrame([(1, "1990-01-01"), (2, "1980-05-05")], "id int, born string"),
        "diagnosis": spark.createDataFrame(
            [(1, "2013-01-01", "A"), (1, "2013-02-01", "B"), (2, "2010-01-01", "C")], "id int, at string, code string"
        ),
    }
    return partial(job.read_config, spark, f"{tmp_path}/c.yaml"), tables


def test_job_from_a_file(spark, tmp_path, given):
    read, tables = given
    base = f"{tmp_path}/out"
    job.run_job(spark, read(), tables, base)
    back = outputs.read_manifest(spark, f"{base}/manifest.json")
    assert back == {f"{base}/sequences": 1, f"{base}/cutflow": 8}
    assert [r["person_id"] for r in spark.read.parquet(f"{base}/sequences").collect()] == [1]
    with pytest.raises(FileExistsError):
        job.run_job(spark, read(), tables, base)


@pytest.mark.parametrize(
    "change, named",
    [
        (lambda c: c["tables"]["diagnosis"]["select_expr"].append("nothing AS x"), r"tables.diagnosis.select_expr\[4\]"),
        (lambda c: c["tables"]["diagnosis"]["select_expr"].append("max(code) AS x"), r"tables.diagnosis.select_expr\[4\]"),
        (lambda c: c["tables"]["patient"].update(select_expr=["count(*) AS person_id"]), r"tables.patient.select_expr\[0\]"),
        (lambda c: c["tables"]["diagnosis"].update(filter_expr="dx_diagnosis_code"), "tables.diagnosis.filter_expr"),
        (lambda c: c["tables"]["diagnosis"].update(filter_expr="count(*) > 1"), "tables.diagnosis.filter_expr"),
        (lambda c: c["tables"]["diagnosis"].update(filter_expr="a = = b"), "tables.diagnosis.filter_expr"),
        (lambda c: c.update(event_date_filter="dates > now()"), "event_date_filter on diagnosis"),
        (lambda c: c["tables"]["diagnosis"]["select_expr"].pop(), "tables.diagnosis.select_expr: missing columns"),
        (lambda c: c.pop("number_of_days_threshold"), "number_of_days_threshold: missing"),
        (lambda c: c["tables"].pop("patient"), "tables.patient: missing"),
        (lambda c: c["tables"]["patient"].pop("filter_expr"), "tables.patient.filter_expr: missing"),
    ],
)
def test_faults_are_named(spark, given, change, named):
    read, tables = given
    config = read()
    job.check_config(config, tables)
    change(config)
    with pytest.raises(ValueError, match=named):
        job.check_config(config, tables)


def test_several_faults_in_one_error(spark, given):
    read, tables = given
    config = read()
    config["tables"]["patient"]["filter_expr"] = "no_such"
    config["tables"]["diagnosis"]["filter_expr"] = "no_such"
    with pytest.raises(ValueError, match=r"(?s)tables.patient.filter_expr.*tables.diagnosis.filter_expr"):
        job.check_config(config, tables)


def test_json_and_other_files(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"a": [1, "x"]}')
    assert job.read_config(spark, f"{tmp_path}/c.json") == {"a": [1, "x"]}
    (tmp_path / "c.yml").write_text("- 1\n")
    with pytest.raises(ValueError, match="no mapping"):
        job.read_config(spark, f"{tmp_path}/c.yml")
