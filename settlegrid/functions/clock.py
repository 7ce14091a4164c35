"""UTC half-hour slots and their Europe/London clock views."""
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..checks import ContractError

ZONE = "Europe/London"
SLOT_SECONDS = 1800


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def local(ts) -> Column:
    return F.from_utc_timestamp(as_col(ts), ZONE)


def local_date(ts) -> Column:
    return F.to_date(local(ts))


def utc_midnight(day) -> Column:
    """UTC instant of the local midnight that starts ``day``."""
    return F.to_utc_timestamp(as_col(day).cast("timestamp"), ZONE)


def slots_between(first_day, last_day) -> Column:
    """Half-hours from local midnight of one day to local midnight of another (46/48/50 per day)."""
    seconds = F.unix_seconds(utc_midnight(last_day)) - F.unix_seconds(utc_midnight(first_day))
    return (seconds / SLOT_SECONDS).cast("int")


def settlement_period(ts) -> Column:
    """Elapsed half-hours since local midnight, from 1; reaches 50 on the autumn day."""
    seconds = F.unix_seconds(as_col(ts)) - F.unix_seconds(utc_midnight(local_date(ts)))
    return (F.floor(seconds / SLOT_SECONDS) + 1).cast("int")


def clock_slot(ts) -> Column:
    """Local half-hour of the day, 0..47 (both autumn repeats share a slot)."""
    t = local(ts)
    return (F.hour(t) * 2 + F.floor(F.minute(t) / 30)).cast("int")


def monday_index(day) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(as_col(day))


def day_type(day) -> Column:
    return F.when(monday_index(day) >= 5, "weekend").otherwise("weekday")


def season_name(month) -> Column:
    m = as_col(month)
    return (F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring")
            .when(m.isin(6, 7, 8), "summer").otherwise("autumn"))


def hour_band(hour) -> Column:
    h = as_col(hour)
    return (F.when(h < 6, "00-05").when(h < 12, "06-11").when(h < 18, "12-17").otherwise("18-23"))


def calendar_slices(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Local year, season, hour, hour band and day type of every row."""
    t = local(ts)
    return df.withColumns({
        "year": F.year(t), "season": season_name(F.month(t)), "hour": F.hour(t),
        "hour_band": hour_band(F.hour(t)), "daytype": day_type(F.to_date(t))})


def _epoch(day: date) -> int:
    return int(datetime(day.year, day.month, day.day, tzinfo=ZoneInfo(ZONE)).timestamp())


@dataclass(frozen=True)
class SettlementCalendar:
    """Every half-hour of the local days ``start``..``end`` inclusive.

    Positions are arithmetic on the epoch, so neither numbering nor membership
    needs a join or an ordered window. ``n_slots`` bounds the rows of one series
    in a dense panel (17,520 a year), which is what makes a window per series safe.
    """

    start: str
    end: str

    def __post_init__(self):
        if date.fromisoformat(self.start) > date.fromisoformat(self.end):
            raise ContractError("Empty date window")

    @property
    def epoch(self) -> int:
        return _epoch(date.fromisoformat(self.start))

    @property
    def n_slots(self) -> int:
        return (_epoch(date.fromisoformat(self.end) + timedelta(days=1)) - self.epoch) // SLOT_SECONDS

    @property
    def n_days(self) -> int:
        return (date.fromisoformat(self.end) - date.fromisoformat(self.start)).days + 1

    def ts(self, pos) -> Column:
        return F.timestamp_seconds(F.lit(self.epoch) + as_col(pos).cast("long") * SLOT_SECONDS)

    def pos(self, ts) -> Column:
        return F.floor((F.unix_seconds(as_col(ts)) - self.epoch) / SLOT_SECONDS).cast("int")

    def pos_of_period(self, settle_date, period) -> Column:
        """Position of a (date, period) pair; NULL when the pair is not in this calendar."""
        d, p = as_col(settle_date), as_col(period)
        inside = (d.between(F.lit(self.start).cast("date"), F.lit(self.end).cast("date"))
                  & (p >= 1) & (p <= slots_between(d, F.date_add(d, 1))))
        first = ((F.unix_seconds(utc_midnight(d)) - self.epoch) / SLOT_SECONDS).cast("int")
        return F.when(inside, first + p - 1)

    def frame(self, spark: SparkSession) -> DataFrame:
        """The calendar table: settle_date, period, ts, pos."""
        slots = spark.range(self.n_slots).select(F.col("id").cast("int").alias("pos"))
        slots = slots.withColumn("ts", self.ts("pos"))
        return slots.select(local_date("ts").alias("settle_date"),
                            settlement_period("ts").alias("period"), "ts", "pos")
