"""Keyed state machines as pure steps: batch folds and live streams share them.

A machine has a schema for its outputs and keeps its state in plain JSON values. step(state, row) takes a key's next row, in the
order of arrival; due(state) tells when it wants a tick without one; tick(state, now) is that. Each returns the new state and
outputs (tuples in the schema's order).
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from ..functions.structured import clip

Out = list[tuple]


class Machine:
    schema = ""
    keys = ()
    columns = ()

    def step(self, state, row: dict) -> tuple[object, Out]:
        raise NotImplementedError

    def due(self, state) -> int | None:
        return None

    def tick(self, state, now: int) -> tuple[object, Out]:
        return state, []


@dataclass
class Dedup(Machine):
    """Runs of the same entry: the first is stored, what repeats within ``window`` of it is counted and summed up."""

    window: int = 10_000
    longest: int = 2048
    schema = "ts long, host string, app string, severity int, message string, repeats long"
    keys = ("host", "app", "severity", "message")
    columns = ("ts", "host", "app", "severity", "message")

    def step(self, state, row):
        entry = (row["ts"], row["host"], row["app"], row["severity"], row["message"], 0)
        if len(row["message"].encode()) > self.longest:
            return state, [entry]
        now = row["arrival"]
        if state and state["start"] <= now < state["start"] + self.window:
            return state | {"n": state["n"] + 1, "last": max(state["last"], row["ts"])}, []
        out = self._summary(state) if state else []
        return {"start": now, "last": row["ts"], "n": 0, "row": list(entry[1:5])}, [*out, entry]

    def _summary(self, state) -> Out:
        if not state["n"]:
            return []
        host, app, severity, message = state["row"]
        seconds = max(0, state["last"] - state["start"]) // 1000
        return [(state["last"], host, app, severity, f"{message} [repeated {state['n']} more times over {seconds}s]", state["n"])]

    def due(self, state):
        return state["start"] + self.window if state else None

    def tick(self, state, now):
        return (None, self._summary(state)) if state and not state["start"] <= now < state["start"] + self.window else (state, [])


@dataclass
class PatternAlert(Machine):
    """Fires when the last ``count`` matches lie within ``window``, at most once in ``cooldown``; firing clears them."""

    rule: str = "alert"
    count: int = 3
    window: int = 60_000
    cooldown: int = 300_000
    schema = "ts long, rule string, host string, count int, window_secs long, sample string"
    keys = ("host",)
    columns = ("host", "message")

    def step(self, state, row):
        now = row["arrival"]
        times, fired = state or ([], None)
        times = [*times, now][-self.count :]
        if len(times) == self.count and now - times[0] <= self.window and (fired is None or now - fired >= self.cooldown):
            return [[], now], [(now, self.rule, row["host"], self.count, self.window // 1000, row["message"])]
        return [times, fired], []


@dataclass
class Silence(Machine):
    """A host that sends nothing for longer than its threshold is silent, once; then it recovers. 0 never alerts."""

    threshold: int = 60_000
    hosts: dict[str, int] = field(default_factory=dict)
    forget: int = 7 * 86_400_000
    schema = "ts long, kind string, host string, silent_for long, threshold long"
    keys = ("host",)
    columns = ("host",)

    def _limit(self, host: str) -> int:
        return self.hosts.get(host, self.threshold)

    def step(self, state, row):
        host, now = row["host"], row["arrival"]
        out = [(now, "recovered", host, 0, self._limit(host))] if state and state["alerted"] else []
        return {"host": host, "last": now, "alerted": False}, out

    def due(self, state):
        if not state or not self._limit(state["host"]):
            return None
        if not state["alerted"]:
            return state["last"] + self._limit(state["host"]) + 1
        return None if state["host"] in self.hosts else state["last"] + self.forget + 1

    def tick(self, state, now):
        gone, limit = now - state["last"], self._limit(state["host"])
        if not limit or gone <= limit:
            return state, []
        out = [] if state["alerted"] else [(now, "silent", state["host"], gone, limit)]
        return (None if gone > self.forget and state["host"] not in self.hosts else state | {"alerted": True}), out


@dataclass
class Volume(Machine):
    """Entries per window against a baseline: the mean of the first ``windows`` windows, then a moving average; rows are (window
    number, n), without gaps. The baseline stays while a surge or drop lasts, until that has lasted ``windows`` windows."""

    window: int = 300_000
    windows: int = 12
    least: float = 10.0
    high: float = 3.0
    low: float = 0.2
    cooldown: int = 3_600_000
    schema = "ts long, kind string, host string, n long, baseline long"
    keys = ("host",)
    columns = ("host", "number", "n")

    def step(self, state, row):
        base, seen, odd, fired = state or (0.0, 0, 0, None)
        now, n, out = (row["number"] + 1) * self.window, row["n"], []
        surge = drop = False
        if seen >= self.windows and base >= self.least:
            surge, drop = self.high > 0 and n >= self.high * base, self.low > 0 and n <= self.low * base
            if (surge or drop) and (fired is None or now - fired >= self.cooldown):
                fired = now
                out = [(now, "surge" if surge else "drop", row["host"], n, int(base + 0.5))]
        odd = odd + 1 if surge or drop else 0
        if not odd or odd >= self.windows:
            alpha = 1.0 if not seen else 1 / (seen + 1) if seen < self.windows else 2 / (self.windows + 1)
            base, seen = (1 - alpha) * base + alpha * n, seen + 1
        return [base, seen, odd, fired], out


@dataclass
class Watch(Machine):
    """New templates after the learning period, and surges of known ones. The notices of all templates share one limit per
    minute: ``per_minute`` applies it to them in order."""

    learn_until: int = 0
    window: int = 60_000
    factor: float = 5.0
    least: int = 20
    history: int = 10
    schema = "ts long, kind string, template string, host string, severity int, n long, usual long, sample string"
    keys = ("template",)
    columns = ("template", "host", "severity", "message")

    def step(self, state, row):
        now = row["arrival"]
        told = lambda kind, n, usual: [(now, kind, row["template"], row["host"], row["severity"], n, usual, row["message"])]
        if state is None:
            return [1, now, 0.0, 0, None], told("new", 1, 0) if now >= self.learn_until else []
        n, start, usual, windows, surged = state
        if self.factor <= 0:
            return state, []
        if now < start:
            start, n = now, 0
        if (passed := (now - start) // self.window) > 0:
            for i in range(min(passed, 64)):
                last = n if not i else 0
                usual = last if not windows else 0.9 * usual + 0.1 * last
                windows += 1
            start, n = start + passed * self.window, 0
        n += 1
        if windows >= self.history and n >= self.least and n >= self.factor * max(usual, 1.0) and (surged is None or now - surged >= 5 * self.window):
            return [n, start, usual, windows, now], told("surge", n, int(usual + 0.5))
        return [n, start, usual, windows, surged], []


@dataclass
class PerMinute(Machine):
    """The first ``most`` notices of each minute, which begins with a notice; one key for all."""

    most: int = 10
    schema = Watch.schema
    keys = ()
    columns = ("kind", "template", "host", "severity", "n", "usual", "sample")

    def step(self, state, row):
        start, sent = state or (None, 0)
        now = row["arrival"]
        if start is None or not start <= now < start + 60_000:
            start, sent = now, 0
        if sent >= self.most:
            return [start, sent], []
        return [start, sent + 1], [(now, *(row[c] for c in self.columns))]


@dataclass
class RateLimit(Machine):
    """Token buckets: ``rate`` a second, up to ``burst`` (0: four times the rate). Refused entries cost nothing."""

    rate: float = 10
    burst: float = 0
    schema = "id long, host string, arrival long, allowed boolean"
    keys = ("host",)
    columns = ("id", "host")

    def step(self, state, row):
        now, most = row["arrival"], self.burst or 4 * self.rate
        tokens, last = state or (most, now)
        tokens, last = min(most, tokens + max(0, now - last) / 1000 * self.rate), max(now, last)
        ok = tokens >= 1
        return [tokens - ok, last], [(row["id"], row["host"], now, ok)]


#: No host has this name.
OTHERS = "\0"


@dataclass
class BothLimits(Machine):
    """Buckets of hosts and one of all: an entry needs a token of both, or takes none. One key, and so one task, for all rows: that
    is what a limit on everything means, and RateLimit alone has no such stage."""

    host_rate: float = 10
    host_burst: float = 0
    all_rate: float = 100
    all_burst: float = 0
    most_hosts: int = 4096  # hosts beyond these, in order of arrival, share one bucket
    schema = RateLimit.schema
    keys = ()
    columns = ("id", "host")

    def step(self, state, row):
        host, whole = RateLimit(self.host_rate, self.host_burst), RateLimit(self.all_rate, self.all_burst)
        hosts, everything = state or ({}, None)
        name = row["host"] if row["host"] in hosts or len(hosts) < self.most_hosts else OTHERS
        one, told = host.step(hosts.get(name), row)
        if told[0][3]:
            both, told = whole.step(everything, row)
            everything = both
            if not told[0][3]:
                one = [one[0] + 1, one[1]]
        hosts[name] = one  # the state is this fold's own
        return [hosts, everything], told


@dataclass
class Quota(Machine):
    """A token's budget: ``per_sec`` with ten seconds of burst, which one batch may overdraw, and ``per_day`` in UTC."""

    per_sec: float | None = None
    per_day: int | None = None
    schema = "token string, arrival long, events long, wait_secs long"
    keys = ("token",)
    columns = ("token", "events")

    def step(self, state, row):
        now, most = row["arrival"], 10 * (self.per_sec or 0)
        bucket, last, day, used = state or (most, now, now // 86_400_000, 0)
        if self.per_sec:
            bucket = min(most, bucket + max(0, now - last) / 1000 * self.per_sec)
        if day != now // 86_400_000:
            day, used = now // 86_400_000, 0
        wait = 0
        if self.per_sec and bucket <= 0:
            wait = max(1, int(-(bucket // self.per_sec)))
        if self.per_day is not None and used >= self.per_day:
            wait = max(wait, 1, -(-((day + 1) * 86_400_000 - now) // 1000))
        if not wait:
            bucket, used = bucket - row["events"], used + row["events"]
        return [bucket, now, day, used], [(row["token"], now, row["events"], wait)]


@dataclass
class Multiline(Machine):
    """Lines of a file as events: a line that matches ``start`` begins one, which ends at the next, at ``most`` lines, at
    ``longest`` bytes, or after ``idle`` without a line."""

    start: str = r"^\S"
    most: int = 500
    longest: int = 65_536
    idle: int = 1_000
    schema = "file string, line long, lines long, text string"
    keys = ("file",)
    columns = ("file", "line", "text")

    def step(self, state, row):
        held, now = state or [], row["arrival"]
        size = sum(len(x.encode()) + 1 for x in held[3:]) if held else 0
        if held and (re.search(self.start, row["text"]) or len(held) - 3 >= self.most or size + len(row["text"].encode()) > self.longest):
            return [row["file"], row["line"], now, row["text"]], self._event(held)
        if held:
            return [held[0], held[1], now, *held[3:], row["text"]], []
        return [row["file"], row["line"], now, row["text"]], []

    def _event(self, held) -> Out:
        return [(held[0], held[1], len(held) - 3, clip("\n".join(held[3:]), self.longest))]

    def due(self, state):
        return state[2] + self.idle if state else None

    def tick(self, state, now):
        return (None, self._event(state)) if state and now >= state[2] + self.idle else (state, [])


@dataclass
class Chunks(Machine):
    """Chunked datagrams, whole when all their chunks came within ``expiry`` of the first; a repeated chunk changes nothing.
    Chunks are hexadecimal; rows are (peer, id, number, of, data)."""

    expiry: int = 5_000
    most: int = 128
    longest: int = 1 << 20
    schema = "peer string, arrival long, data string"
    keys = ("peer", "id")
    columns = ("peer", "number", "of", "data")

    def step(self, state, row):
        now, of = row["arrival"], row["of"]
        if not 0 < of <= self.most or not 0 <= row["number"] < of:
            return state, []
        first, held = state if state and now - state[0] <= self.expiry else (now, {})
        held = {str(row["number"]): row["data"]} | held
        if sum(map(len, held.values())) > 2 * self.longest:
            return None, []
        if len(held) == of:
            return None, [(row["peer"], now, "".join(held[str(i)] for i in range(of)))]
        return [first, held], []

    def due(self, state):
        return state[0] + self.expiry + 1 if state else None

    def tick(self, state, now):
        return (None, []) if state and now - state[0] > self.expiry else (state, [])


def packed(state) -> str:
    return json.dumps(state)


def unpacked(text: str | None):
    return json.loads(text) if text else None
