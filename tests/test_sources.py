"""Zone maps open only what is needed and refuse changed files; studies resume by origin."""
import os
import pathlib

import pytest
from pyspark.sql import functions as F

from settlegrid.checks import ContractError
from settlegrid.sources import panels as S, records as R

HEADER = list(R.COLUMNS.values())


@pytest.fixture
def folder(tmp_path):
    place = tmp_path / "meter files+a"
    place.mkdir()
    for month in (1, 2, 3):
        names = HEADER if month != 2 else HEADER[::-1]
        row = dict(zip(HEADER, ["001", "", "1", "20230301", "20230301", "1", "2.5", "I", "F"]))
        lines = [",".join(names)]
        for day in (1, 20):
            row["Settlement Date"] = f"2023{month:02}{day:02}"
            lines.append(",".join(row[n] for n in names))
        (place / f"m{month}.csv").write_text("\n".join(lines) + "\n")
    return place


def test_zone_map_and_pruned_scan(spark, folder):
    zones = R.zone_map(spark, str(folder)).orderBy("source")
    rows = zones.collect()
    assert [(r["settlement_start"], r["settlement_end"], r["rows"]) for r in rows] == [(f"2023{m:02}01", f"2023{m:02}20", 2) for m in (1, 2, 3)]
    assert rows[1]["header"] == HEADER[::-1] and all(r["length"] == os.path.getsize(folder / f"m{m}.csv") for m, r in enumerate(rows, 1))
    got = R.load_records(spark, None, "2023-02-10", "2023-03-05", "I", zones)
    assert sorted(r["settle_date"] for r in got.collect()) == ["20230220", "20230301"]
    assert len(got.inputFiles()) == 2 < len(rows)
    whole = R.load_records(spark, str(folder / "m2.csv"), "2023-02-10", "2023-02-28")
    assert [r["volume"] for r in whole.collect()] == ["2.5"]
    with pytest.raises(ContractError):
        R.load_records(spark, None, "2024-01-01", "2024-02-01", "I", zones)


def test_changed_sources_are_refused(spark, folder):
    stored = R.zone_map(spark, str(folder)).collect()
    zones = spark.createDataFrame(stored, R.zone_map(spark, str(folder)).schema)
    load = lambda first, last, **k: R.load_records(spark, None, first, last, "I", zones, **k).count()
    target = pathlib.Path(folder / "m2.csv")
    text, stat = target.read_text(), target.stat()
    os.utime(target, (stat.st_atime, stat.st_mtime + 100))  # touched, but the same
    assert load("2023-02-01", "2023-02-28") == 2
    target.write_text(text.replace("2.5", "9.5"))  # the same length
    with pytest.raises(ContractError, match="m2"):
        load("2023-02-01", "2023-02-28")
    assert load("2023-01-01", "2023-01-31") == 2  # a changed file that is not asked for does not matter
    os.utime(target, (stat.st_atime, stat.st_mtime))
    with pytest.raises(ContractError):
        load("2023-02-01", "2023-02-28", check_digests=True)
    target.write_text(text + text.splitlines()[1] + "\n")
    with pytest.raises(ContractError):
        load("2023-02-01", "2023-02-28")


def test_a_study_resumes_where_it_was_cut_off(spark, tmp_path):
    made = []

    def cases(fail_at=None):
        def of(origin):
            if origin == fail_at:
                raise RuntimeError("cut off")
            made.append(origin)
            return spark.range(5).select(F.lit(origin).alias("origin_pos"), F.col("id").alias("lead"), (F.col("id") * origin).alias("prediction"))
        return of

    root, whole = f"{tmp_path}/a", f"{tmp_path}/b"
    with pytest.raises(ContractError):
        S.read_origins(spark, root)
    with pytest.raises(RuntimeError):
        S.append_origins(spark, root, [10, 20, 30, 40], cases(30), "s1")
    spark.range(99).write.parquet(f"{root}/cases/origin_pos=30")  # rows of a job that died before its entry
    assert S.read_origins(spark, root).count() == 10
    made.clear()
    assert S.append_origins(spark, root, [10, 20, 30, 40], cases(), "s1") == made == [30, 40]
    assert S.append_origins(spark, whole, [10, 20, 30, 40], cases(), "s1") == [10, 20, 30, 40]
    rows = lambda r: sorted(map(tuple, S.read_origins(spark, r).select("origin_pos", "lead", "prediction").collect()))
    assert rows(root) == rows(whole) and len(rows(root)) == 20
    assert {o: n for o, (n, _) in S.committed_origins(spark, root).items()} == {10: 5, 20: 5, 30: 5, 40: 5}
    with pytest.raises(ContractError):
        S.append_origins(spark, root, [50], cases(), "other settings")
