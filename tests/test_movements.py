"""State per block of movements: random exports, corrections and withdrawals in any order equal one batch."""

import datetime as dt
import random
from decimal import Decimal as D

import pytest

from arlens.operators.ledger import clean_ledger
from arlens.streaming import movements as mv

SCHEMA = "orden_origen long, cliente string, documento string, fecha date, fecha_vencimiento date, debe decimal(28,2), haber decimal(28,2), saldo decimal(28,2)"


def frame(spark, rows):
    return clean_ledger(spark.createDataFrame([(i, c, d, f, None, D(a), D(b), D(0)) for i, (c, d, f, a, b) in enumerate(rows)], SCHEMA))


def draw(rng, n):
    names = ["Hot", "Hot", "Ana", "Bea", "", None]
    return [(rng.choice(names), rng.choice(["F - 1", "F - 2", "", None]), rng.choice([None, dt.date(2000, rng.randrange(1, 13), 3)]), rng.randrange(100), rng.randrange(50)) for _ in range(n)]


def expected(landings):
    """landings: (time, export, rows). Of each export the latest landing; of each movement the latest export."""
    latest = {}
    for t, export, rows in landings:
        if export not in latest or latest[export][0] < t:
            latest[export] = (t, rows)
    held = {}
    for export, (t, rows) in sorted(latest.items(), key=lambda x: x[1][0]):
        seen = {}
        order = sorted(range(len(rows)), key=lambda i: (rows[i][2] is not None, rows[i][2] or dt.date.min, i))
        for i in order:
            c, d, _, a, b = rows[i]
            if c:
                k = (c, d or "")
                seen[k] = seen.get(k, 0) + 1
                held[(*k, seen[k])] = (a, b)
    out = {}
    for (c, _, _), (a, b) in held.items():
        n, x, y = out.get(c, (0, 0, 0))
        out[c] = (n + 1, x + a, y + b)
    return out


def got(spark, out):
    return {r["cliente"]: (r["movimientos"], int(r["debe"]), int(r["haber"])) for r in mv.totals(spark, out).collect()}


@pytest.mark.parametrize("seed", [1])
def test_random_landings_restarts_and_disorder(spark, scratch, seed, monkeypatch):
    monkeypatch.setattr(mv, "BLOCK", 7)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    rng = random.Random(seed)
    folder, out, ckpt = f"{scratch}/in", f"{scratch}/out", f"{scratch}/ckpt"
    landings, times = [], rng.sample(range(1, 100), 6)      # landed out of their order
    for step, t in enumerate(times):
        export = rng.choice(["a", "b"])
        rows = draw(rng, rng.choice([0, 20, 60])) if step % 3 else draw(rng, 60)
        if landings and rng.random() < 0.5:                  # the export before, rows moved, changed and withdrawn
            _, export, old = rng.choice(landings)
            rows = [r for r in old if rng.random() < 0.8] + draw(rng, 5)
            rng.shuffle(rows)
        mv.land(frame(spark, rows).repartition(2), folder, export, t)
        landings.append((t, export, rows))
        if step in (1, 3, 5):                                # each run starts from the checkpoint of the one before
            mv.run_movements(spark, folder, out, ckpt, files_a_batch=rng.choice([2, None]))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got(spark, out) == expected(landings)


def test_late_older_landing_does_not_bring_rows_back(spark, scratch):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    folder, out, ckpt = f"{scratch}/in", f"{scratch}/out", f"{scratch}/ckpt"
    day = dt.date(2000, 1, 1)
    mv.land(frame(spark, [("Ana", "F - 1", day, 100, 0)]), folder, "x", 10)
    mv.run_movements(spark, folder, out, ckpt)
    mv.land(frame(spark, [("Ana", "F - 9", day, 50, 0), ("Ana", "F - 1", day, 100, 0)]), folder, "x", 20)
    mv.run_movements(spark, folder, out, ckpt)
    assert got(spark, out) == {"Ana": (2, 150, 0)}
    mv.land(frame(spark, [("Ana", "F - 1", day, 7, 0), ("New", "F - 3", day, 7, 0)]), folder, "x", 15)       # older than what is held
    mv.land(frame(spark, []), folder, "y", 30)
    mv.run_movements(spark, folder, out, ckpt)
    assert got(spark, out) == {"Ana": (2, 150, 0)}
    mv.land(frame(spark, []), folder, "x", 40)                                  # all withdrawn
    mv.run_movements(spark, folder, out, ckpt)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got(spark, out) == {}
