"""The five recommender scenarios (FIXTURES section 4) through P1, P3, P4, P5."""

import pytest

from ratewise.operators import recommend as P

SCENARIOS = [
    # name, base, occ, lead, weekend, holiday, magnitude, month, event_type
    ("Standard weekday", 150.0, 0.60, 14, None, None, 0, 3, "None"),
    ("Weekend peak", 150.0, 0.85, 3, 1, None, None, 7, "None"),
    ("Concert event", 150.0, 0.90, 7, None, None, 2, 8, "Concert"),
    ("Holiday last-minute", 200.0, 0.95, 1, None, 1, 3, 12, "Holiday"),
    ("Low demand winter", 150.0, 0.35, 60, None, None, None, 1, "None"),
]
SCHEMA = ("name string, base_price double, occupancy_rate double, lead_time_days int, is_weekend int, "
          "is_holiday int, event_magnitude int, month int, event_type string")


@pytest.fixture(scope="module")
def requests(spark):
    return spark.createDataFrame(SCENARIOS, SCHEMA)


def test_completion_defaults(requests):
    done = {r.name: r for r in P.complete_requests(requests).collect()}
    r = done["Standard weekday"]
    assert r.competitor_avg_price == pytest.approx(157.5)
    assert r.competitor_min_price == pytest.approx(157.5 * 0.92)
    assert r.competitor_max_price == pytest.approx(157.5 * 1.08)
    assert (r.is_weekend, r.is_holiday, r.length_of_stay, r.demand_score) == (0, 0, 2, 0.7)
    assert r.day_of_week == 1 and done["Weekend peak"].day_of_week == 4
    assert done["Concert event"].has_event == 1 and done["Low demand winter"].has_event == 0
    assert done["Weekend peak"].high_demand == 0  # demand default 0.7 fails the second condition
    assert (r.weather_score, r.reviews_score, r.room_type_enc, r.season_enc) == (3, 4.2, 2, 1)


def test_rule_prices(requests):
    done = P.complete_requests(requests)
    got = {r.name: r.rule_price for r in P.rule_price(done).collect()}
    assert got == {"Standard weekday": 166.5, "Weekend peak": 186.0, "Concert event": 225.0,
                   "Holiday last-minute": 300.0, "Low demand winter": 143.25}


def test_factors_and_context(requests):
    done = P.rule_price(P.complete_requests(requests))
    rows = {r.name: r for r in P.price_context(P.pricing_factors(done), "rule_price").collect()}
    assert rows["Weekend peak"].factors == ["high occupancy (85%) adds premium",
                                            "last-minute booking (3 days) adds premium",
                                            "weekend adds ~10% premium"]
    assert rows["Concert event"].factors == ["high occupancy (90%) adds premium", "concert event adds 30% premium"]
    assert rows["Low demand winter"].factors == []
    r = rows["Standard weekday"]
    assert r.vs_base_pct == pytest.approx(11.0)
    assert r.vs_comp_pct == pytest.approx((166.5 - 157.5) / 157.5 * 100, abs=1e-6)
    assert r.expected_revenue == pytest.approx(166.5 * 0.6 * 2)


def test_roi_payback_999_without_increment(spark):
    from ratewise.operators.scenarios import roi
    props = spark.createDataFrame([("a", 100, 0.7, 120.0), ("empty", 50, 0.0, 100.0)],
                                  "property string, num_rooms int, avg_occupancy double, current_avg_rate double")
    out = {r.property: r for r in roi(props).collect()}
    assert out["empty"].payback_months == 999.0
    cur = 100 * 365 * 0.7 * 120.0
    assert out["a"].current_revenue == round(cur)
    assert out["a"].payback_months == pytest.approx(round(18000 / (cur * 0.18) * 12, 1))
    assert out["a"].five_year_roi_ratio == pytest.approx(round((cur * 0.18 * 5 - 30000) / 30000, 2))
