"""The sequential part of rebalancing: greedy moves inside one snapshot."""

import heapq
import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle

from dockflow.schemas import EARTH_RADIUS_M

OUTPUT = ("from_station_id", "to_station_id", "move_bikes", "from_surplus", "to_deficit",
           "distance_meters", "priority", "expires_at")
#: Columns of an end as it reaches the assignment; `room` is the least of its balances, which every move lowers alike.
END = ("is_target", "station_id", "amount", "room", "lat", "lon", "expires_at")
#: Sources for which a grid cell is sized.
PER_CELL = 4


def _metres(lat, lon, lats, lons):
    """Haversine distance from one point to many, in the engine's own operation order."""
    half_lat = np.sin(np.radians(lats - lat) / 2)
    half_lon = np.sin(np.radians(lons - lon) / 2)
    chord = half_lat * half_lat + np.cos(np.radians(lat)) * np.cos(np.radians(lats)) * half_lon * half_lon
    return EARTH_RADIUS_M * 2 * np.arctan2(np.sqrt(chord), np.sqrt(1 - chord))


class Sources:
    """The open sources of a snapshot on a grid of latitude and longitude; a source without bikes left leaves it."""

    def __init__(self, ends):
        self.names = [e.station_id for e in ends]
        self.left = [int(e.room) for e in ends]
        self.surplus = [int(e.amount) for e in ends]
        self.expires = [e.expires_at for e in ends]
        self.lats, self.lons = np.array([e.lat for e in ends], float), np.array([e.lon for e in ends], float)
        self.low = (self.lats.min(), self.lons.min()) if ends else (0.0, 0.0)
        spans = (np.ptp(self.lats), np.ptp(self.lons)) if ends else (0.0, 0.0)
        side = max(1.0, math.sqrt(len(ends) / PER_CELL))
        self.step = tuple(max(span / side, 1e-9) for span in spans)
        # Over more than half of the globe a difference in longitude is no bound for a distance.
        self.wide = spans[1] > 90
        self.flattest = math.cos(math.radians(float(np.abs(self.lats).max()))) if ends else 1.0
        self.cells, places = {}, [self._cell(a, b) for a, b in zip(self.lats, self.lons)]
        for i, cell in enumerate(places):
            self.cells.setdefault(cell, set()).add(i)
        self.last = tuple(max((c[k] for c in self.cells), default=0) for k in (0, 1))

    def _cell(self, lat, lon):
        return int((lat - self.low[0]) / self.step[0]), 0 if self.wide else int((lon - self.low[1]) / self.step[1])

    def take(self, i, bikes):
        self.left[i] -= bikes
        self.surplus[i] -= bikes
        if not self.left[i]:
            cell = self._cell(self.lats[i], self.lons[i])
            self.cells[cell].discard(i)
            if not self.cells[cell]:
                del self.cells[cell]

    def _ring(self, at, r):
        """The open sources of the cells at distance `r` from cell `at`, of those the grid has."""
        rows = range(max(0, at[0] - r), min(self.last[0], at[0] + r) + 1)
        for a in rows:
            whole = abs(a - at[0]) == r
            columns = range(max(0, at[1] - r), min(self.last[1], at[1] + r) + 1) if whole else {at[1] - r, at[1] + r}
            for b in columns:
                yield from self.cells.get((a, b), ())

    def _beyond(self, lat, lon, at, r):
        """No source outside the rings up to `r` is nearer than so many metres."""
        edge = [(at[k] - r) * self.step[k] + self.low[k] for k in (0, 1)], [(at[k] + r + 1) * self.step[k] + self.low[k] for k in (0, 1)]
        gaps = [min(v - edge[0][k], edge[1][k] - v) for k, v in enumerate((lat, lon))]
        north = EARTH_RADIUS_M * math.radians(max(0.0, gaps[0]))
        if self.wide:
            return north * (1 - 1e-9)
        turn = math.sin(math.radians(min(max(0.0, gaps[1]), 180.0)) / 2) * math.sqrt(max(0.0, math.cos(math.radians(lat)) * self.flattest))
        return min(north, EARTH_RADIUS_M * 2 * math.asin(min(1.0, turn))) * (1 - 1e-9)

    def nearest(self, lat, lon):
        """(metres, source) from the nearest on, equal distances in the order of the sources; rings are read as far as needed."""
        at = self._cell(min(max(lat, self.low[0]), self.lats.max()), min(max(lon, self.low[1]), self.lons.max()))
        heap, r, reach = [], 0, max(at[0], at[1], self.last[0] - at[0], self.last[1] - at[1])
        while heap or r <= reach:
            bound = -1.0
            if r <= reach:
                found = np.array(sorted(self._ring(at, r)), np.int64)
                for m, i in zip(_metres(lat, lon, self.lats[found], self.lons[found]).tolist(), found.tolist()):
                    heapq.heappush(heap, (m, i))
                bound = self._beyond(lat, lon, at, r) if r < reach else math.inf
                r += 1
            else:
                bound = math.inf
            while heap and heap[0][0] < bound:
                yield heapq.heappop(heap)


def _moves(sources, target, done):
    """Moves to one target from its nearest open sources; `done` moves were made before."""
    wanted, deficit, made = int(target.room), int(target.amount), []
    for metres, s in sources.nearest(target.lat, target.lon):
        bikes = min(sources.left[s], wanted)
        rounded = int(np.floor(metres + 0.5))
        made.append((sources.names[s], target.station_id, bikes, sources.surplus[s], deficit, rounded, done + len(made) + 1, min(sources.expires[s], target.expires_at)))
        wanted, deficit = wanted - bikes, deficit - bikes
        sources.take(s, bikes)
        if wanted == 0:
            break
    return made


def assign_batches(batches, snapshot):
    """Moves of snapshots whose ends arrive sorted: all sources, then the targets in service order, each served as it comes."""
    current, waiting, sources, done = object(), [], None, 0
    for batch in batches:
        found = []
        for row in batch.itertuples(index=False):
            at = getattr(row, snapshot)
            if at != current and not (pd.isna(at) and current is None):
                current, waiting, sources, done = None if pd.isna(at) else at, [], None, 0
            if not row.is_target:
                waiting.append(row)
                continue
            if sources is None:
                sources, waiting = Sources(waiting), []
            if sources.cells:
                made = _moves(sources, row, done)
                done += len(made)
                found += [(at, *move) for move in made]
        yield pd.DataFrame(found, columns=[snapshot, *OUTPUT])


# Tasks receive these functions by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
