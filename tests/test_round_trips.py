"""What is landed, set aside, written in order and read back."""

import json
import os

import pytest
from pyspark.sql import functions as F

from evisift.sources import landed, ordered

GOOD = '{"username":"ann","http_status":200,"public_repos":3,"error":null}'


@pytest.fixture
def snapshots(tmp_path):
    lines = [
        GOOD, '{"username":"bob","http_status":404}', '{"username":"cut","http_status":2', '{"username":"dan","http_status":"gone"}',
        '{"http_status":200,"public_repos":1}', '{"username":"","http_status":200}', "[1, 2]", "not json", "", '{"username":"eve","more":[1]}',
    ]
    (tmp_path / "profiles").mkdir()
    (tmp_path / "profiles" / "a.json").write_text("\n".join(lines))
    (tmp_path / "profiles" / "b.json").write_text(GOOD.replace("ann", "zoe"))
    return str(tmp_path / "profiles")


def test_faulty_lines_are_told_and_the_others_read(spark, snapshots):
    rows = landed.read(spark, snapshots, landed.PROFILE_LINES).collect()
    good = {r.username: (r.http_status, r.public_repos) for r in rows if r.fault is None}
    assert good == {"ann": (200, 3), "bob": (404, None), "eve": (None, None), "zoe": (200, 3)}
    faults = sorted((r.fault, r.line) for r in rows if r.fault)
    assert [f for f, _ in faults].count(landed.NO_KEY) == 2
    assert {line for f, line in faults if f == landed.UNREADABLE} == {
        '{"username":"cut","http_status":2', '{"username":"dan","http_status":"gone"}', "[1, 2]", "not json"}
    assert all(r.landed_file.endswith(("a.json", "b.json")) for r in rows)
    assert {r.username for r in landed.read_profiles(spark, snapshots).collect()} == set(good)
    assert landed.read_profiles(spark, snapshots).columns == ["username", "http_status", "public_repos", "error"]


def test_landing_sets_faulty_lines_aside(spark, snapshots, tmp_path):
    aside = str(tmp_path / "quarantine")
    sound = landed.land(spark, snapshots, landed.PROFILE_LINES, aside)
    assert sound.count() == 4
    rows = landed.quarantined(spark, aside).collect()
    assert len(rows) == 6 and {r.kind for r in rows} == {"profiles"} and all(r.line and r.landed_file for r in rows)
    # a mended line is landed like any other, and a second batch adds to the first
    (tmp_path / "mended").mkdir()
    (tmp_path / "mended" / "c.json").write_text('{"username":"cut","http_status":200}\nbroken again')
    assert [r.username for r in landed.land(spark, str(tmp_path / "mended"), landed.PROFILE_LINES, aside).collect()] == ["cut"]
    assert landed.quarantined(spark, aside).count() == 7


def test_times_that_cannot_be_read_are_no_fault(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"username":"ann","created_at":"2024-01-02T03:04:05Z"}\n{"username":"ann","created_at":"soon"}\n{"username":"bob"}')
    rows = landed.read_events(spark, str(tmp_path / "e.json")).collect()
    assert len(rows) == 3 and sum(r.created_at is not None for r in rows) == 1
    (tmp_path / "r.json").write_text('{"username":"ann","topics":"llm"}\n{"username":"ann","topics":["llm"],"fork":false}')
    assert [r.topics for r in landed.read_repos(spark, str(tmp_path / "r.json")).collect()] == [["llm"]]
    (tmp_path / "j.json").write_text('{"doc_id":7,"response":"{}"}\n{"response":"{}"}')
    assert [(r.doc_id, r.response) for r in landed.read_responses(spark, str(tmp_path / "j.json")).collect()] == [("7", "{}")]


def numbered(spark, n):
    return spark.range(1, n + 1, numPartitions=3).select(
        F.col("id").alias("position"), F.struct((F.col("id") * 2).alias("x"), F.array(F.lit("a")).alias("y")).alias("nested"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("n"), "id")).alias("name"),
    ).repartition(5)


def test_files_stand_in_the_order_of_their_rows(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = numbered(spark, 101)
    ordered.write(rows, folder, files=4)
    files = sorted(f for f in os.listdir(folder) if f.startswith("part-"))
    told = [json.loads(line) for f in files for line in open(f"{folder}/{f}")]
    assert [t["position"] for t in told] == list(range(1, 102)) and "name" in told[2] and told[2]["name"] is None
    listed = ordered.manifest(spark, folder).collect()
    assert [m.file for m in listed] == files[: len(listed)] and sum(m.rows for m in listed) == 101 and len(listed) > 1
    back = ordered.read(spark, folder)
    assert back.schema.simpleString() == rows.schema.simpleString()
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))


def test_a_range_reads_only_its_files(spark, tmp_path):
    folder = str(tmp_path / "out")
    ordered.write(numbered(spark, 100), folder, files=5)
    part = ordered.read(spark, folder, 40, 43)
    assert sorted(r.position for r in part.collect()) == [40, 41, 42, 43]
    assert len(part.inputFiles()) < len(ordered.read(spark, folder).inputFiles())
    assert ordered.read(spark, folder, 500).collect() == []


def test_a_missing_file_is_noticed_and_an_empty_table_goes_round(spark, tmp_path):
    folder = str(tmp_path / "out")
    ordered.write(numbered(spark, 30), folder, files=3)
    lost = ordered.manifest(spark, folder).collect()
    spark.createDataFrame([r for r in lost if r.first > 1], ordered.MANIFEST).coalesce(1).write.mode("overwrite").json(f"{folder}.manifest")
    with pytest.raises(ValueError, match="rows from 1 on"):
        ordered.read(spark, folder)
    ordered.write(numbered(spark, 30).limit(0), str(tmp_path / "none"))
    assert ordered.read(spark, str(tmp_path / "none")).collect() == []


def test_top_reasons_tell_the_activity(spark):
    from evisift.plans.report import top_reasons

    rows = spark.sql("""
        SELECT id AS rank, concat('n', id) AS candidate_name, true AS eligible, 1.0D AS total_score, 'p' AS project_summary,
               CASE WHEN id = 1 THEN 'last public activity ~3d ago' ELSE '' END AS github_summary,
               named_struct('rationale', map('penalties', array('No project-quality penalties'), 'ai_project_depth', array('a', 'b', 'c', 'd'))) AS score_breakdown
        FROM range(1, 3)""")
    assert [(r.activity, r.reasons, r.penalties) for r in top_reasons(rows).orderBy("rank").collect()] == [
        ("last public activity ~3d ago", ["a", "b", "c"], []), (None, ["a", "b", "c"], [])]
