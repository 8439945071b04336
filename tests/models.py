"""Plain-Python models of the semantics, for comparison on small random inputs."""

from __future__ import annotations

import math


def step(total):
    if total >= 0:
        for threshold, period in [
            (60, 10), (80, 36), (100, 60), (150, 120), (250, 360), (300, 400), (500, 500),
        ]:
            if total <= threshold:
                return period
    return 500


def dead_band(rows, start, threshold):
    """``rows``: (value, any_change); returns the positions announced."""
    last, out = start, []
    for i, (value, change) in enumerate(rows):
        if abs(value - last) >= (1 if change else threshold):
            last = value
            out.append(i)
    return out


class Cluster:
    """One supervised cluster, message by message."""

    def __init__(self, start=3600, threshold=5, n=50):
        self.clients, self.costs, self.gaps = {}, [], []
        self.failed, self.period, self.threshold, self.n = None, start, threshold, n
        self.announced, self.totals, self.unregistered = [], [], []

    def message(self, at, client, verb, payload):
        if verb == "IN":
            self.clients[client] = 0
            self.totals.append((*at, sum(self.clients.values())))
        elif verb in ("OUT", "UPDATE"):
            if client not in self.clients:
                self.unregistered.append(at)
                return
            if verb == "OUT":
                del self.clients[client]
            else:
                self.clients[client] = int(payload)
            total = sum(self.clients.values())
            self.totals.append((*at, total))
            if verb == "UPDATE" and step(total) != self.period:
                self.announce(at, step(total))
        elif verb == "UPDATE-CC":
            self.costs.append(int(float(payload)))
            self.compute(at)
        elif verb == "UPDATE-MTBF":
            t = int(float(payload))
            if self.failed is not None:
                self.gaps.append(t - self.failed)
            first, self.failed = self.failed is None, t
            if not first:
                self.compute(at)

    def compute(self, at):
        costs, gaps = self.costs[-self.n :], self.gaps[-self.n :]
        if not costs or not gaps:
            return
        c, m = sum(costs) / len(costs) / 1000.0, sum(gaps) / len(gaps)
        if c * m < 0:
            return
        period = max(10, int(math.sqrt(2 * c * m)))
        if abs(period - self.period) >= self.threshold:
            self.announce(at, period)

    def announce(self, at, period):
        self.period = period
        self.announced.append((*at, period))


def time_between_failures(rows, carry):
    """``rows``: (t, verb) of one cluster; returns (position, value) per counted failure."""
    out, up, tslf, tebi, total, last_up = [], False, None, 0, 0, None
    for i, (t, verb) in enumerate(rows):
        if verb == "START":
            up, tslf, last_up = True, t, t
        elif verb == "STOP":
            if tslf is not None and t - tslf > 0:
                tebi = t - tslf
            if up and last_up is not None:
                total += t - last_up
            up, last_up = False, None
        elif up:
            out.append((i, t - tslf + tebi if carry == "last" else total + t - last_up))
            tslf, tebi, total, last_up = t, 0, 0, t
    return out
