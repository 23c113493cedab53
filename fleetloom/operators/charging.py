"""Charge plans: the cheapest slots of each vehicle on its charger, the emptiest vehicle first."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .folds import fold_sorted
from .ordered import running_total

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fixed values of the battery model: energy step in kWh, efficiency, hours of a slot.
STEP, EFFICIENCY, SLOT_H = 0.25, 0.93, 0.25


def taper(share: np.ndarray) -> np.ndarray:
    """Share of the power that a battery takes: all up to 80 %, then less, 15 % at least."""
    return np.where(share <= 0.8, 1.0, np.maximum(0.15, 1 - (share - 0.8) / 0.2 * 0.85))


def levels(capacity: float, start: float, target: float, power: float) -> tuple[int, np.ndarray]:
    """Steps from start to target kWh, and the most steps that one slot adds from each level on the way."""
    top = max(0, min(math.ceil((target - start) / STEP - 1e-9), math.floor((capacity - start) / STEP + 1e-9)))
    return top, np.floor((power * SLOT_H * EFFICIENCY * taper((start + STEP * np.arange(top + 1)) / capacity) + 1e-9) / STEP).astype(int)


def cheapest(capacity: float, start: float, target: float, power: float, price: np.ndarray) -> tuple[float, np.ndarray] | None:
    """(cost, steps in each slot) of the cheapest way from start to target kWh; None if there is none. Slots priced inf are taken.

    Backwards over slots: due[t, i] is the least cost from level i before slot t; all levels are moved by all numbers of steps at once."""
    top, room = levels(capacity, start, target, power)
    if top <= 0:
        return 0.0, np.zeros(len(price), int)
    steps = np.arange(max(0, min(int(room.max()), top)) + 1)
    barred = np.where(steps <= np.maximum(room, 0)[:, None], 0.0, np.inf)
    due = np.full((len(price) + 1, top + len(steps)), np.inf)  # levels past the top are never left
    due[-1, top] = 0.0
    for t in range(len(price) - 1, -1, -1):
        if np.isfinite(price[t]):
            ways = np.lib.stride_tricks.sliding_window_view(due[t + 1], len(steps))
            due[t, : top + 1] = (ways + price[t] * steps * STEP / EFFICIENCY + barred).min(1)
        else:
            due[t] = due[t + 1]
    if not np.isfinite(due[0, 0]):
        return None
    level, used = 0, np.zeros(len(price), int)
    for t in range(len(price)):
        ways = due[t + 1, level : level + room[level] + 1].copy()
        ways[1:] += price[t] * np.arange(1, len(ways)) * STEP / EFFICIENCY
        used[t] = int(np.argmin(ways))
        level += used[t]
    return float(due[0, 0]), used


def soonest(capacity: float, start: float, target: float, power: float, price: np.ndarray) -> tuple[float, np.ndarray] | None:
    """As cheapest, but charging at once at full power up to the very target, whatever the price; what slots add isn't whole steps."""
    level, cost, used = start, 0.0, np.zeros(len(price))
    for t in np.flatnonzero(np.isfinite(price)):
        if level >= target - 1e-9:
            break
        add = min(power * SLOT_H * EFFICIENCY * float(taper(np.float64(level / capacity))), target - level, capacity - level)
        used[t] = add / STEP
        cost += float(price[t]) * add / EFFICIENCY
        level += add
    return (cost, used) if level >= target - 1e-6 else None


def soonest_steps(capacity: float, start: float, target: float, power: float, price: np.ndarray) -> tuple[float, np.ndarray] | None:
    """As soonest, in whole steps to the level that cheapest ends at: no plan of cheapest can cost more."""
    top, room = levels(capacity, start, target, power)
    level, cost, used = 0, 0.0, np.zeros(len(price), int)
    for t in np.flatnonzero(np.isfinite(price)):
        used[t] = min(room[level], top - level)
        cost += float(price[t]) * int(used[t]) * STEP / EFFICIENCY
        level += used[t]
    return (cost, used) if level == top else None


def share_out(vehicles: DataFrame, chargers: DataFrame) -> DataFrame:
    """Vehicles (vin, depot, soc) dealt in turn, the emptiest first, to the chargers (charger, depot, power) of their depot."""
    one = F.lit(1).cast("long")
    c = running_total(chargers.withColumn("one", one), "depot", ["charger"], "one").withColumnsRenamed({"before": "__i", "total": "__n"}).drop("one")
    v = running_total(vehicles.withColumn("one", one), "depot", ["soc", "vin"], "one").withColumnRenamed("before", "__r").drop("one", "total")
    size = c.select("depot", "__n").distinct()
    return v.join(size, "depot").withColumn("__i", F.col("__r") % F.col("__n")).drop("__n", "__r").join(c.drop("__n"), ["depot", "__i"]).drop("__i")


def charge_plan(vehicles: DataFrame, prices: list[float], *, target_pct: float = 80.0, way: Callable = cheapest) -> DataFrame:
    """vin, charger, feasible, cost, slots (steps of 0.25 kWh in each slot, comma-joined; not whole ones from soonest) for vehicles (vin, charger, power, capacity, soc).

    A charger serves its vehicles in order of charge, and a slot once: a fold by charger whose state is the taken slots.
    way: cheapest, or one of the baselines that don't look at prices, soonest and soonest_steps."""
    base = np.asarray(prices, float)

    def step(taken: np.ndarray, row: tuple) -> tuple:
        charger, soc, vin, power, capacity = row
        found = way(capacity, soc / 100 * capacity, target_pct / 100 * capacity, power, np.where(taken, np.inf, base))
        if found is None:
            return vin, charger, False, 0.0, ""
        taken |= found[1] > 0
        return vin, charger, True, found[0], ",".join(map(str, found[1].tolist()))

    rows = vehicles.where(F.col("soc") < target_pct).where("capacity > 0").select("charger", "soc", "vin", "power", "capacity")
    # A row is a few bytes, but a plan takes milliseconds: tasks must not be put together by their bytes.
    parts = int(vehicles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return fold_sorted(rows, "charger", ["soc", "vin"], lambda: np.zeros(len(base), bool), step, "vin long, charger long, feasible boolean, cost double, slots string", parts=parts)


def beside_soonest(plans: DataFrame, vehicles: DataFrame, prices: list[float], *, target_pct: float = 80.0) -> DataFrame:
    """vin, charger, dearer of plans (as charge_plan gives them, in whole steps) for vehicles: whether soonest_steps, in the slots that the plans before it at its charger leave free, costs less or is the only one that gets there.

    The cost of a plan is what its slots cost, or what it says if that is more."""
    base = np.asarray(prices, float)

    def step(taken: np.ndarray, row: tuple) -> tuple:
        charger, soc, vin, power, capacity, feasible, cost, slots = row
        plain = soonest_steps(capacity, soc / 100 * capacity, target_pct / 100 * capacity, power, np.where(taken, np.inf, base))
        if feasible:
            used = np.array(slots.split(","), int)
            cost = max(cost, float((base * used).sum()) * STEP / EFFICIENCY)
            taken |= used > 0
        return vin, charger, plain is not None and (not feasible or cost > plain[0] + 1e-6)

    rows = vehicles.join(plans, ["vin", "charger"]).select("charger", "soc", "vin", "power", "capacity", "feasible", "cost", "slots")
    parts = int(vehicles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return fold_sorted(rows, "charger", ["soc", "vin"], lambda: np.zeros(len(base), bool), step, "vin long, charger long, dearer boolean", parts=parts)


def intervals(plans: DataFrame) -> DataFrame:
    """vin, charger, first_slot, end_slot (exclusive), kwh of the unbroken stretches of plans (vin, charger, feasible, slots)."""
    slots = plans.where("feasible AND slots <> ''").select("vin", "charger", F.posexplode(F.split("slots", ",")).alias("slot", "steps")).withColumn("steps", F.col("steps").cast("double")).where("steps > 0")
    runs = slots.withColumn("run", F.col("slot") - F.row_number().over(Window.partitionBy("vin", "charger").orderBy("slot")))
    found = runs.groupBy("vin", "charger", "run").agg(F.min("slot").alias("first_slot"), (F.max("slot") + 1).alias("end_slot"), (F.sum("steps") * F.lit(STEP)).alias("kwh"))
    return found.drop("run")
