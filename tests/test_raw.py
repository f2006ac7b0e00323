"""Raw bookings CSV ingest on a hand-written micro file (FIXTURES section 1)."""

import datetime as dt

from ratewise.sources import io
from ratewise.sources.raw import to_bookings

HEADER = ("hotel,is_canceled,lead_time,arrival_date_year,arrival_date_month,arrival_date_day_of_month,"
          "stays_in_weekend_nights,stays_in_week_nights,adults,children,market_segment,distribution_channel,"
          "is_repeated_guest,reserved_room_type,customer_type,adr")
ROWS = [
    "Resort Hotel,0,10,2016,July,1,1,2,2,0,Online TA,TA/TO,0,A,Transient,120.5",
    "City Hotel,1,3,2016,August,15,0,1,1,,Direct,Direct,1,D,Contract,95.0",       # null children
    "City Hotel,0,45,2017,  March ,3,0,0,2,1,Groups,TA/TO,0,G,Transient,210.0",   # zero nights, padded month
    "Resort Hotel,0,0,2015,December,31,2,5,2,2,Online TA,TA/TO,0,Z,Group,80.0",   # room type outside lookup
    "City Hotel,0,7,2016,May,9,1,1,1,0,Online TA,TA/TO,0,A,Transient,0",          # adr 0: dropped
    "Resort Hotel,0,90,2017,January,20,1,3,2,0,Offline TA/TO,TA/TO,0,C,Transient,150.0",
]


def test_micro_csv_ingest(spark, tmp_path):
    p = tmp_path / "raw.csv"
    p.write_text(HEADER + "\n" + "\n".join(ROWS) + "\n")
    raw = io.read_bookings(spark, str(p), fmt="csv", schema=io.RAW_BOOKINGS_SCHEMA)
    out = to_bookings(raw).orderBy("checkin_date").collect()
    assert len(out) == 5  # the adr = 0 row is gone
    by_date = {r.checkin_date: r for r in out}
    assert dt.date(2017, 3, 3) in by_date and by_date[dt.date(2017, 3, 3)].length_of_stay == 1
    assert by_date[dt.date(2016, 8, 15)].children == 0
    z = by_date[dt.date(2015, 12, 31)]
    assert 100 <= z.base_price < 180  # default range for an unknown room type
    a = by_date[dt.date(2016, 7, 1)]
    assert 80 <= a.base_price < 130 and a.is_weekend == 1 and a.season == "Summer"  # a Friday
    assert all(0.2 <= r.occupancy_rate <= 0.98 for r in out)
    assert sum(r.is_test for r in out) == 1  # floor(0.8 * 5) = rank 4 -> the last date
    again = to_bookings(io.read_bookings(spark, str(p), fmt="csv", schema=io.RAW_BOOKINGS_SCHEMA).repartition(3))
    assert sorted(tuple(r) for r in again.collect()) == sorted(tuple(r) for r in out)


def test_require_and_present(spark):
    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    assert io.present(df, ["b", "c", "a"]) == ["b", "a"]
    try:
        io.require(df, ["a", "zz"])
    except ValueError as e:
        assert "zz" in str(e)
    else:
        raise AssertionError("require should fail")
