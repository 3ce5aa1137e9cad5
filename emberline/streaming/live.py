"""Extension: wind and the live perimeter of each area, kept by a stateful stream.

Rows come in any order.  An area keeps the wind of windows that are still open and the
cells that have caught fire, and closes a window once what it has seen is later than the
window's end by the delay.  Then it says the mean wind of the window and how large the fire
and its perimeter were at its end.  A row for a window that is closed goes to a side output
instead and changes nothing.  The clock of an area is its own latest row, kept in the state,
so results depend on the order of its rows alone: not on batches, restarts or other areas.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.types import _parse_datatype_string

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS = "area long, at long, kind string, x int, y int, value double"
#: kind: window or late; a window has n winds, their mean (null without), cells and perimeter at its end
OUT = "area long, kind string, start long, n long, speed double, cells long, perimeter long"
SIDES = ((0, 1), (0, -1), (1, 0), (-1, 0))


class Area(StatefulProcessor):
    """State of one area: its clock, open windows (count and sum of winds), cells to come and cells on fire."""

    def __init__(self, size: int, delay: int):
        self.size, self.delay = size, delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clock = handle.getValueState("clock", "latest long, closed long, cells long, perimeter long")
        self.windows = handle.getMapState("windows", "start long", "n long, sum double")
        self.waiting = handle.getMapState("waiting", "x int, y int", "at long")
        self.fire = handle.getMapState("fire", "x int, y int", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        latest, closed, cells, perimeter = self.clock.get() or (None, None, 0, 0)
        for row in rows:
            start = row.at // self.size * self.size
            if closed is not None and start < closed:
                yield Row(area=key[0], kind="late", start=row.at, n=1, speed=row.value, cells=None, perimeter=None)
                continue
            if row.kind == "wind":
                n, total = self.windows.getValue((start,)) if self.windows.containsKey((start,)) else (0, 0.0)
                self.windows.updateValue((start,), (n + 1, total + row.value))
            else:
                cell = (row.x, row.y)
                known = self.waiting.getValue(cell)[0] if self.waiting.containsKey(cell) else None
                if not self.fire.containsKey(cell) and (known is None or row.at < known):
                    self.waiting.updateValue(cell, (row.at,))
                if not self.windows.containsKey((start,)):
                    self.windows.updateValue((start,), (0, 0.0))
            latest = row.at if latest is None else max(latest, row.at)
            while True:  # windows that end before the clock, less the delay, in order
                ended = sorted(k[0] for k in self.windows.keys() if k[0] + self.size + self.delay <= latest)
                if not ended:
                    break
                for first in ended:
                    n, total = self.windows.getValue((first,))
                    self.windows.removeKey((first,))
                    end = first + self.size
                    lit = sorted((v[0], tuple(k)) for k, v in self.waiting.iterator() if v[0] < end)
                    for at, cell in lit:
                        perimeter += 4 - 2 * sum(self.fire.containsKey((cell[0] + i, cell[1] + j)) for i, j in SIDES)
                        cells += 1
                        self.fire.updateValue(cell, (at,))
                        self.waiting.removeKey(cell)
                    closed = end if closed is None else max(closed, end)
                    yield Row(area=key[0], kind="window", start=first, n=n, speed=total / n if n else None, cells=cells, perimeter=perimeter)
        if latest is not None:
            self.clock.update((latest, closed if closed is not None else -(1 << 62), cells, perimeter))


PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def follow(rows: DataFrame, size: int = 600, delay: int = 1800) -> DataFrame:
    """OUT for a stream of ROWS (at: seconds), for append mode; the state store is RocksDB's.

    Rows of an area are handled in the order in which a batch has them.  Null times are
    left out.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    dealt = rows.where("area IS NOT NULL AND at IS NOT NULL").groupBy("area")
    return dealt.transformWithState(statefulProcessor=Area(size, delay), outputStructType=_parse_datatype_string(OUT), outputMode="Append", timeMode="None")


def windows(rows: DataFrame, size: int = 600) -> DataFrame:
    """The batch form: (area, start, n, speed, cells, perimeter) of every window with a row, exactly."""
    start = (F.floor(F.col("at") / size) * size).cast("long")
    named = rows.withColumn("start", start)
    wind = F.col("kind") == "wind"
    facts = named.groupBy("area", "start").agg(F.count_if(wind).alias("n"), F.avg(F.when(wind, F.col("value"))).alias("speed"))
    fire = rows.where(~wind).groupBy("area", "x", "y").agg(F.min("at").alias("at"))
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in SIDES])
    beside = fire.select("area", "x", "y", "at", F.inline(near)).withColumns({"nx": F.col("x") + F.col("i"), "ny": F.col("y") + F.col("j")})
    other = fire.select("area", F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("at").alias("since"))
    # two cells side by side share an edge from when the later one burns
    shared = beside.join(other, ["area", "nx", "ny"]).select("area", F.greatest("at", "since").alias("at"), F.lit(0).alias("cells"), F.lit(-1).alias("edges"))
    steps = fire.select("area", "at", F.lit(1).alias("cells"), F.lit(4).alias("edges")).unionByName(shared)
    steps = steps.groupBy("area", (F.floor(F.col("at") / size) * size).cast("long").alias("start")).agg(F.sum("cells").alias("more"), F.sum("edges").alias("edges"))
    so_far = Window.partitionBy("area").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    joined = facts.join(steps, ["area", "start"], "left").na.fill(0, ["more", "edges"])
    return joined.select("area", "start", "n", "speed", F.sum("more").over(so_far).alias("cells"), F.sum("edges").over(so_far).alias("perimeter"))


class Progress(StreamingQueryListener):
    """What a stream has done: rows read, batches, state rows, and the error that ended it."""

    def __init__(self):
        self.rows, self.batches, self.state_rows, self.error, self.ended = 0, 0, 0, None, False

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.ended, self.error = False, None

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.rows += p.numInputRows
        self.batches += 1
        self.state_rows = sum(s.numRowsTotal for s in p.stateOperators)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.error, self.ended = event.exception, True
