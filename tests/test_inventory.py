from datetime import date, timedelta

import pytest

from stockloom.operators import inventory

D0 = date(2024, 1, 1)


def history(frame, series):
    rows = [(k, D0 + timedelta(weeks=i), q) for k, levels in series.items() for i, q in enumerate(levels)]
    return frame(rows, "item string, date date, quantity_on_hand double")


def project_by_walking(levels, horizon):
    falls = [a - b for a, b in zip(levels, levels[1:]) if a is not None and b is not None]
    if not falls or levels[-1] is None:
        return [None] * horizon
    usage, level, out = sum(falls) / len(falls) / 7, levels[-1], []
    for _ in range(horizon):
        level = max(level - usage, 0)
        out.append(level)
    return out


SERIES = {
    "falls": [100.0, 90.0, 70.0, 65.0],
    "runs out": [100.0, 50.0, 5.0],
    "grows": [10.0, 20.0, 25.0],
    "below zero and grows": [-30.0, -20.0, -8.0],
    "gap": [100.0, 90.0, None, 60.0, 55.0],
    "flat": [7.0, 7.0],
    "single": [5.0],
    "last unknown": [9.0, 6.0, None],
}


def test_projection_against_a_walk(frame):
    got = {}
    for r in inventory.project_inventory(history(frame, SERIES), ["item"], horizon=40).collect():
        got.setdefault(r.item, {})[r.date] = r.inventory_level
    for item, levels in SERIES.items():
        last = D0 + timedelta(weeks=len(levels) - 1)
        expected = project_by_walking(levels, 40)
        assert len(got[item]) == 40
        for i, level in enumerate(expected):
            assert got[item][last + timedelta(days=i + 1)] == pytest.approx(level, abs=1e-9), item


def reorder_by_walking(levels, params, passes):
    lead, threshold, quantity = params
    levels, events, after = dict(levels), [], None
    for _ in range(passes):
        due = [d for d in sorted(levels) if levels[d] <= threshold and (after is None or d > after)]
        if not due:
            break
        after = due[0] + timedelta(days=lead)
        events.append((due[0], after, quantity))
        levels = {d: v + quantity if d >= after else v for d, v in levels.items()}
    return levels, events


@pytest.mark.parametrize("passes", [1, 2, 3])
def test_reorders_against_a_walk(frame, passes):
    params = {"falls": (3, 50, 20), "runs out": (2, 100, 4), "grows": (5, 10, 3), "flat": (40, 7, 9), "late": (1, -1, 5)}
    levels = {
        "falls": [60.0 - 2 * i for i in range(30)],
        "runs out": [max(9.0 - i, 0.0) for i in range(30)],
        "grows": [20.0 + i for i in range(30)],
        "flat": [7.0] * 30,
        "late": [30.0 - i for i in range(30)],
        "no parameters": [1.0] * 30,
    }
    rows = [(k, D0 + timedelta(days=i), v) for k, s in levels.items() for i, v in enumerate(s)]
    df = frame(rows, "item string, date date, inventory_level double")
    given = frame([(k, *p) for k, p in params.items()], "item string, lead_time_days int, reorder_threshold int, reorder_quantity int")
    got = {(r.item, r.date): r.inventory_level for r in inventory.apply_reorders(df, given, ["item"], passes).collect()}
    events = {}
    for r in inventory.reorder_events(df, given, ["item"], passes).collect():
        events.setdefault(r.item, []).append((r.order_day, r.arrival_day, r.quantity))
    for item, s in levels.items():
        walked = {D0 + timedelta(days=i): v for i, v in enumerate(s)}
        expected, placed = reorder_by_walking(walked, params[item], passes) if item in params else (walked, [])
        assert {d: got[item, d] for d in walked} == expected, item
        assert sorted(events.get(item, [])) == placed, item


def test_one_item_without_keys(frame):
    df = history(frame, {"x": [20.0, 13.0]}).drop("item")
    levels = inventory.project_inventory(df, [], horizon=5)
    assert [r.inventory_level for r in levels.orderBy("date").collect()] == [12.0, 11.0, 10.0, 9.0, 8.0]
    params = frame([(1, 11, 10)], "lead_time_days int, reorder_threshold int, reorder_quantity int")
    after = inventory.apply_reorders(levels, params, [], 1).orderBy("date").collect()
    assert [r.inventory_level for r in after] == [12.0, 11.0, 20.0, 19.0, 18.0]


def test_level_at_arrival_beyond_the_horizon(frame):
    levels = frame([("a", D0, 5.0)], "item string, date date, inventory_level double")
    events = frame([("a", D0, 1), ("a", D0 + timedelta(days=9), 2)], "item string, arrival_day date, n int")
    assert {r.n: r.level_at_arrival for r in inventory.level_at_arrival(levels, events, ["item"]).collect()} == {1: 5.0, 2: None}


def test_state_reports_missing_items(frame):
    df = frame([("a", D0, 5, 1, 2), ("a", D0 + timedelta(days=1), 4, 3, 2)], "item string, date date, quantity_on_hand int, reorder_threshold int, lead_time_days int")
    asked = frame([("a",), ("z",), ("a",)], "item string")
    rows = {r.item: (r.quantity_on_hand, r.reorder_threshold, r.found) for r in inventory.inventory_state(df, asked, "item").collect()}
    assert rows == {"a": (4, 3, True), "z": (None, None, False)}
