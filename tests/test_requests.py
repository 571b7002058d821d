"""Request histories with approvals that run out, against a fold in plain Python."""

import datetime as dt
from collections import Counter, defaultdict

import numpy as np

from sievegate.operators.access import apply_request_events

START = dt.datetime(2024, 1, 1)
SCHEMA = "user_id long, doc_id long, event_id long, created_at timestamp_ntz, kind string, expires_at timestamp_ntz"
NEXT = {"request": ("pending", None), "approve": ("approved", "pending"), "reject": ("rejected", "pending"), "revoke": ("revoked", "approved")}


def fold(rows):
    """Each pair's events in order; an approval ends at its end, before whatever comes then."""
    out, pairs = [], defaultdict(list)
    for user, doc, event, at, kind, end in rows:
        pairs[user, doc].append((at, event, kind, end))
    for (user, doc), events in pairs.items():
        state, held = "none", None

        def run_out(now):
            nonlocal state, held
            if state == "approved" and held[1] is not None and held[1] <= now:
                out.append((user, doc, held[0], "expire", "approved", True, "revoked"))
                state = "revoked"

        for at, event, kind, end in sorted(events):
            run_out(at)
            then, needed = NEXT[kind]
            valid = state != "pending" if kind == "request" else state == needed
            out.append((user, doc, event, kind, state, valid, then if valid else state))
            if valid:
                state, held = then, (event, end) if kind == "approve" else held
        run_out(dt.datetime.max)
    return sorted(out)


def judged(spark, rows):
    return sorted(tuple(r) for r in apply_request_events(spark.createDataFrame(rows, SCHEMA)).collect())


def test_random_histories(spark):
    rng, rows = np.random.default_rng(6), []
    for event in range(6000):
        at = START + dt.timedelta(hours=int(rng.integers(0, 60)))
        kind = str(rng.choice(["request", "approve", "reject", "revoke"], p=[0.3, 0.35, 0.1, 0.25]))
        end = at + dt.timedelta(hours=int(rng.integers(-3, 12))) if rng.random() < 0.7 else None
        # One pair has a third of all events.
        user, doc = (0, 0) if event % 3 == 0 else (int(rng.integers(0, 30)), int(rng.integers(0, 8)))
        rows.append((user, doc, event, at, kind, end))
    got = judged(spark, rows)
    assert got == fold(rows)
    kinds = Counter((kind, valid) for *_, kind, _, valid, _ in got)
    assert all(kinds[k, v] for k in NEXT for v in (True, False)) and kinds["expire", True] > 100


def test_revoking_after_the_end_is_invalid(spark):
    hour = lambda h: START + dt.timedelta(hours=h)
    rows = [(1, 1, 1, hour(0), "request", None), (1, 1, 2, hour(1), "approve", hour(5)), (1, 1, 3, hour(5), "revoke", None),
            (2, 1, 4, hour(0), "request", None), (2, 1, 5, hour(1), "approve", hour(5)), (2, 1, 6, hour(4), "revoke", None),
            (3, 1, 7, hour(0), "request", None), (3, 1, 8, hour(1), "approve", hour(1)), (3, 1, 9, hour(1), "revoke", None),
            (4, 1, 10, hour(0), "approve", hour(9)), (4, 1, 11, hour(2), "request", None)]
    got = {(r[2], r[3]): r[4:] for r in judged(spark, rows)}
    assert got[3, "revoke"] == ("revoked", False, "revoked") and got[2, "expire"] == ("approved", True, "revoked")
    assert got[6, "revoke"] == ("approved", True, "revoked") and (5, "expire") not in got
    assert got[9, "revoke"] == ("revoked", False, "revoked") and got[8, "expire"][1]
    assert got[10, "approve"] == ("none", False, "none") and got[11, "request"] == ("none", True, "pending")
    assert (10, "expire") not in got and judged(spark, rows[:0]) == []
