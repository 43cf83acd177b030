"""Small mutable tables, on the driver: saved views, alert rules, maintenance windows, mutes; and filters of audit and alert history."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.regexes import check
from .model import ALERTS_DEFAULT, AUDIT_DEFAULT
from .operators.maintenance import Once

# What a saved view may hold, and how much of everything there may be.
VIEW_KEYS = ("q", "host", "app", "level", "f", "re", "tag", "range", "since", "until", "group")
VIEWS, VIEW_NAME, VIEW_QUERY, VIEW_VALUE = 100, 80, 2000, 500
RULES, WINDOWS, MUTES, LONGEST_MINUTES = 100, 100, 200, 10_080


class Store:
    """Named values in one JSON file (or in memory), listed by name in any case, then by age."""

    def __init__(self, path: str | None = None):
        self.path = Path(path) if path else None
        self.rows: list[dict] = json.loads(self.path.read_text()) if self.path and self.path.exists() else []

    def _save(self) -> None:
        if self.path:
            part = self.path.with_suffix(".part")
            part.write_text(json.dumps(self.rows))
            part.replace(self.path)

    def put(self, name: str, value: object, most: int) -> int:
        """Adds or replaces; the id of the row."""
        row = next((r for r in self.rows if r["name"] == name), None)
        if row is None:
            if len(self.rows) >= most:
                raise ValueError(f"at most {most}")
            row = {"id": 1 + max((r["id"] for r in self.rows), default=0), "name": name}
            self.rows.append(row)
        row["value"] = value
        self._save()
        return row["id"]

    def remove(self, row_id: int) -> bool:
        before = len(self.rows)
        self.rows = [r for r in self.rows if r["id"] != row_id]
        self._save()
        return len(self.rows) < before

    def listed(self) -> list[dict]:
        return sorted(self.rows, key=lambda r: (r["name"].lower(), r["id"]))


class Views(Store):
    def save(self, name: str, query: dict[str, str]) -> int:
        name = name.strip()
        if not name or len(name) > VIEW_NAME or any(ord(c) < 32 for c in name):
            raise ValueError(f"a view's name has 1 to {VIEW_NAME} characters")
        for k, v in query.items():
            if k not in VIEW_KEYS:
                raise ValueError(f"unknown key {k!r} in a view")
            if len(v.encode()) > VIEW_VALUE:
                raise ValueError(f"{k} is longer than {VIEW_VALUE} bytes")
        if sum(len(k.encode()) + len(v.encode()) + 2 for k, v in query.items()) > VIEW_QUERY:
            raise ValueError(f"the query is longer than {VIEW_QUERY} bytes")
        return self.put(name, dict(query), VIEWS)


class AlertRules(Store):
    def save(self, name: str, rule: dict) -> int:
        if not name.strip():
            raise ValueError("a rule needs a name")
        built(rule)
        return self.put(name, dict(rule), RULES)

    def usable(self) -> list[tuple[str, dict]]:
        """Rules that build; others are left out."""
        found = []
        for r in self.listed():
            try:
                built(r["value"])
            except (ValueError, TypeError, KeyError):
                continue
            found.append((r["name"], r["value"]))
        return found


def built(rule: dict) -> dict:
    count, window = int(rule["count"]), int(rule["window_secs"])
    if not 1 <= count <= 10_000 or window < 1:
        raise ValueError("count must be 1 to 10000 and window_secs 1 or more")
    if rule.get("pattern"):
        check(rule["pattern"])
    if not any(rule.get(k) for k in ("pattern", "host", "app", "severity")):
        raise ValueError("a rule needs a pattern, host, app or severity")
    return rule


@dataclass
class Maintenance:
    windows: list[tuple[int, Once]] = field(default_factory=list)
    next_id: int = 1

    def add(self, hosts: list[str], minutes: int, now: int, text: str = "") -> int:
        if not 1 <= minutes <= LONGEST_MINUTES:
            raise ValueError(f"minutes must be 1 to {LONGEST_MINUTES}")
        self.windows = self.listed(now)
        if len(self.windows) >= WINDOWS:
            raise ValueError(f"at most {WINDOWS} windows")
        self.windows.append((self.next_id, Once(hosts, now, now + minutes * 60_000, text)))
        self.next_id += 1
        return self.next_id - 1

    def listed(self, now: int) -> list[tuple[int, Once]]:
        return [w for w in self.windows if w[1].until > now]

    def remove(self, window_id: int) -> bool:
        before = len(self.windows)
        self.windows = [w for w in self.windows if w[0] != window_id]
        return len(self.windows) < before


@dataclass
class Mutes:
    rules: dict[str, tuple[int, str]] = field(default_factory=dict)

    def set(self, rule: str, minutes: int, now: int, text: str = "") -> None:
        if not 1 <= minutes <= LONGEST_MINUTES:
            raise ValueError(f"minutes must be 1 to {LONGEST_MINUTES}")
        self.rules = self.listed(now)
        if rule not in self.rules and len(self.rules) >= MUTES:
            raise ValueError(f"at most {MUTES} mutes")
        self.rules[rule] = (now + minutes * 60_000, text)

    def clear(self, rule: str) -> bool:
        return self.rules.pop(rule, None) is not None

    def listed(self, now: int) -> dict[str, tuple[int, str]]:
        return {k: v for k, v in self.rules.items() if v[0] > now}


# Of each kind of request, the paths that are one whole and those that only begin one.
AUDIT_PATHS = {
    "ingestion": {"whole": ("/ingest", "/gelf", "/v1/logs"), "begin": ("/loki/",)},
    "reads": {"whole": ("/api/logs", "/api/export", "/api/tail", "/api/audit", "/api/tokens"), "begin": ("/api/logs/",)},
}
REFUSED = (401, 403)


def _audit_kind(path: Column, kind: str) -> Column:
    listed = AUDIT_PATHS[kind]
    return path.rlike("^(?:" + "|".join([*(f"{p}$" for p in listed["whole"]), *listed["begin"]]) + ")")


def audit_wanted(method: Column, path: Column, status: Column) -> Column:
    """Which requests are recorded: refusals, changes but for ingestion, and reads of entries."""
    served = F.when(method == "GET", _audit_kind(path, "reads")).otherwise(~_audit_kind(path, "ingestion"))
    return served | status.isin(*REFUSED)


def audit_history(audit: DataFrame, since: int | None = None, until: int | None = None, token: str | None = None, refused: bool = False, limit: int = AUDIT_DEFAULT) -> DataFrame:
    found = _between(audit, since, until)
    if token is not None:
        found = found.where(F.col("token") == token)
    if refused:
        found = found.where(F.col("status").isin(*REFUSED))
    return found.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(limit)


def alert_history(alerts: DataFrame, since: int | None = None, until: int | None = None, kind: str | None = None, host: str | None = None, limit: int = ALERTS_DEFAULT) -> DataFrame:
    found = _between(alerts, since, until)
    if kind is not None:
        found = found.where(F.col("kind") == kind)
    if host is not None:
        found = found.where(F.col("host") == host)
    return found.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(limit)


def purged(history: DataFrame, now: int, days: int) -> DataFrame:
    return history.where(F.col("ts") >= now - days * 86_400_000)


def _between(rows: DataFrame, since: int | None, until: int | None) -> DataFrame:
    if since is not None:
        rows = rows.where(F.col("ts") >= since)
    return rows if until is None else rows.where(F.col("ts") <= until)
