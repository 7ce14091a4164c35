"""Records, revisions, calendar and dense panel."""
import csv
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from settlegrid.checks import ContractError
from settlegrid.functions.clock import SettlementCalendar
from settlegrid.operators import panel as P, revisions as R
from settlegrid.sources import panels as S, records as SR

SCHEMA = ("series string, settle_date date, period int, volume double, flow string, rev_agg date, "
          "rev_flow timestamp, rev_run long, estimated boolean")


def rec(series, day, period, volume, flow="I", agg="2022-07-01", run=1, est=False):
    return (series, date.fromisoformat(day), period, volume, flow, date.fromisoformat(agg),
            datetime.fromisoformat(agg), run, est)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def full_day(series, day, n, **kw):
    return [rec(series, day, p, float(p), **kw) for p in range(1, n + 1)]


@pytest.mark.parametrize("day,n", [("2022-03-27", 46), ("2022-06-20", 48), ("2022-10-30", 50)])
def test_clock_change_days(spark, day, n):
    cal = SettlementCalendar(day, day)
    assert cal.n_slots == n
    rows = cal.frame(spark).orderBy("pos").collect()
    assert [r["period"] for r in rows] == list(range(1, n + 1))
    p = P.build_panel(frame(spark, full_day("A", day, n)), cal)
    assert [r["value"] for r in p.orderBy("pos").collect()] == [float(x) for x in range(1, n + 1)]


def test_latest_revision_by_date_then_run(spark):
    rows = [rec("A", "2022-06-20", 1, 1.0, run=9), rec("A", "2022-06-20", 1, 2.0, run=10),
            rec("A", "2022-06-20", 1, 3.0, agg="2022-06-01", run=99)]
    out = R.resolve_revisions(R.sign_volumes(frame(spark, rows))).collect()
    assert [(r["volume"], r["n_rows"]) for r in out] == [(2.0, 3)]


def test_later_revision_may_flip_direction(spark):
    rows = [rec("A", "2022-06-20", 1, 5.0, "I", run=1), rec("A", "2022-06-20", 1, 4.0, "E", run=2)]
    out = R.resolve_revisions(R.sign_volumes(frame(spark, rows))).first()
    assert (out["volume"], out["flow"]) == (-4.0, "E")


@pytest.mark.parametrize("second", [rec("A", "2022-06-20", 1, 6.0), rec("A", "2022-06-20", 1, None),
                                    rec("A", "2022-06-20", 1, 0.0, "E")])
def test_conflict_at_latest_revision_is_an_error(spark, second):
    first = rec("A", "2022-06-20", 1, 5.0 if second[4] == "I" else 0.0)
    df = R.sign_volumes(frame(spark, [first, second]))
    assert R.conflicting_keys(df).count() == 1
    with pytest.raises(Exception, match="Conflicting"):
        R.resolve_revisions(df).collect()


def test_exact_duplicates_are_dropped(spark):
    df = R.sign_volumes(frame(spark, [rec("A", "2022-06-20", 1, 5.0)] * 3))
    assert R.resolve_revisions(df).first()["n_rows"] == 3


@pytest.mark.parametrize("row", [rec("A", "2022-06-20", 1, -5.0), rec("A", "2022-06-20", 1, 5.0, None)])
def test_unsigned_volume_and_known_flag(spark, row):
    with pytest.raises(Exception, match="unsigned|direction flag"):
        R.sign_volumes(frame(spark, [row])).collect()


def test_outside_calendar_and_missing_day(spark):
    cal = SettlementCalendar("2022-06-20", "2022-06-21")
    df = frame(spark, [rec("A", "2022-06-20", 49, 1.0)])
    assert P.outside_calendar(df, cal).count() == 1
    with pytest.raises(Exception, match="calendar"):
        P.build_panel(df, cal).collect()
    with pytest.raises(ContractError, match="settlement day"):
        P.build_observed_panel(frame(spark, full_day("A", "2022-06-20", 48)), cal)


def test_dense_panel_gaps_ids_and_audit(spark):
    cal = SettlementCalendar("2022-06-20", "2022-06-20")
    rows = [rec("A", "2022-06-20", 5, 1.0), rec("A", "2022-06-20", 9, 2.0, "E", est=True), rec("B", "2022-06-20", 48, None)]
    ids = spark.createDataFrame([("A",), ("Z",)], "series string")
    p = P.build_panel(frame(spark, rows), cal, ids=ids)
    got = {(r["series"], r["pos"]): (r["value"], r["source"]) for r in p.collect()}
    assert len(got) == 3 * 48
    assert got[("A", 4)] == (1.0, "observed_import") and got[("A", 8)] == (-2.0, "observed_export")
    assert got[("B", 47)] == (None, "missing") and got[("Z", 0)] == (None, "missing")
    audit = P.panel_audit(frame(spark, rows), cal).first().asDict()
    assert audit["genuinely_missing_periods"] == 94 and audit["estimated_rows_after_resolution"] == 1


def test_complete_cases(make_panel):
    p = make_panel({"ok": [1, 2, 3], "flat": [1, 1, 1], "gap": [1, None, 3]})
    assert {r["series"] for r in P.complete_series(p).collect()} == {"ok"}
    assert {r["series"] for r in P.excluded_series(p).collect()} == {"flat", "gap"}


def test_panel_contract(spark, make_panel):
    p = make_panel({"A": [1, 2, 3, 4], "B": [1, None, 3, 4]})
    S.check_panel(p)
    for bad in (p.where("pos <> 1"), p.unionByName(p.limit(1)), p.where("NOT (series = 'A' AND pos = 3)"),
                p.withColumn("value", F.lit(float("inf"))), p.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 MINUTE"))):
        with pytest.raises(ContractError):
            S.check_panel(bad)


def write_csv(path, names, rows):
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(names)
        w.writerows(rows)


def test_files_with_different_column_orders(spark, tmp_path):
    names = [SR.COLUMNS[k] for k in ("series", "settle_date", "period", "rev_agg", "rev_flow", "rev_run", "volume", "flow")]
    rows = [["007", "20220620", p, "20220701", "20220701", 1, p, "I"] for p in range(1, 49)]
    write_csv(tmp_path / "a.csv", names, rows)
    late = dict(zip(names, ["007", "20220620", 1, "20220702", "20220702", 1, 999, "I"]))
    other = list(reversed(names)) + [SR.COLUMNS["estimated"]]
    write_csv(tmp_path / "b.csv", other, [[late.get(n, "T") for n in other]])
    raw = SR.load_records(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], "2022-06-20", "2022-06-20", "signed_net")
    p = P.build_panel(R.parse_records(raw), SettlementCalendar("2022-06-20", "2022-06-20"))
    got = {r["pos"]: (r["series"], r["value"], r["estimated"]) for r in p.collect()}
    assert got[0] == ("007", 999.0, True) and got[1] == ("007", 2.0, False)
    spans = SR.source_spans(SR.source_coverage(R.parse_records(raw)))
    assert sorted(r["rows"] for r in spans.collect()) == [1, 48]
    with pytest.raises(ContractError):
        SR.load_records(spark, str(tmp_path / "a.csv"), "2023-01-01", "2023-01-02")
    write_csv(tmp_path / "c.csv", names[:-2], [])
    with pytest.raises(ContractError, match="missing columns"):
        SR.read_raw(spark, str(tmp_path / "c.csv"))


def test_broken_text_rows_stop_the_job(spark, tmp_path):
    names = list(SR.COLUMNS.values())
    good = ["A", "20220620", "1", "20220701", "20220701", "1", "2.5", "I", "F"]
    for column, value in (("settle_date", "20220231"), ("period", "1.5"), ("volume", "x"), ("volume", "inf"), ("rev_agg", "2022")):
        row = list(good)
        row[list(SR.COLUMNS).index(column)] = value
        path = tmp_path / f"{column}{value}.csv"
        write_csv(path, names, [row])
        with pytest.raises(Exception):
            R.parse_records(SR.read_raw(spark, str(path))).collect()


def test_sinks_refuse_to_overwrite(spark, make_panel, tmp_path):
    S.write_table(make_panel({"A": [1, 2]}), str(tmp_path / "out"))
    with pytest.raises(Exception, match="exist"):
        S.write_table(make_panel({"A": [1, 2]}), str(tmp_path / "out"))


def test_hot_key_is_combined_before_the_shuffle(spark):
    """A third of all rows share one key: the map side must reduce it."""
    plan = R.latest_candidates(frame(spark, [rec("A", "2022-06-20", 1, 1.0)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_max") >= 1 and plan.count("Exchange hashpartitioning") == 1
