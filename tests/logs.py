"""Builders for session-log records, as in the log format's own conventions."""

from __future__ import annotations

import json
import tempfile
from datetime import UTC, datetime, timedelta
from pathlib import Path

from tallyspark.fixed_values import USAGE_LIMIT_ID

BASE = datetime(2026, 8, 10, 12, 0, tzinfo=UTC)
PARENT = "2d9c4f10-7b3e-4a52-9c61-0f8a5e1d7b34"
CHILD = "6e01b8a3-5c24-4d97-8f1b-93ac7d2e4f60"


def at(seconds: float) -> str:
    return (BASE + timedelta(seconds=seconds)).isoformat().replace("+00:00", "Z")


def nanos(seconds: float) -> int:
    return int((BASE + timedelta(seconds=seconds)).timestamp()) * 10**9


def meta(seconds, thread=PARENT, provider="openai", **extra):
    payload = {"id": thread, **({"model_provider": provider} if provider else {}), **extra}
    return {"timestamp": at(seconds), "type": "session_meta", "payload": payload}


def model(seconds, name, **extra):
    return {"timestamp": at(seconds), "type": "turn_context", "payload": {"model": name, **extra}}


def settings(seconds, **body):
    payload = {"type": "thread_settings_applied", "thread_settings": {"model": "x", **body}}
    return {"timestamp": at(seconds), "type": "event_msg", "payload": payload}


def counters(n):
    """A fifth of the tokens is output."""
    return {"input_tokens": n - n // 5, "output_tokens": n // 5, "total_tokens": n}


def usage(seconds, total=None, last=None, source=USAGE_LIMIT_ID, primary=None, secondary=None, balance=None, info=True):
    body = {"type": "token_count"}
    if info:
        body["info"] = {}
        if total is not None:
            body["info"]["total_token_usage"] = total if isinstance(total, dict) else counters(total)
        if last is not None:
            body["info"]["last_token_usage"] = last if isinstance(last, dict) else counters(last)
    if source is not None:
        limits = {"limit_id": source}
        if primary is not None:
            limits["primary"] = primary if isinstance(primary, dict) else window(primary)
        if secondary is not None:
            limits["secondary"] = secondary
        if balance is not None:
            limits["credits"] = {"has_credits": True, "unlimited": False, "balance": f"{balance:.10f}"}
        body["rate_limits"] = limits
    record = {"timestamp": at(seconds), "type": "event_msg", "payload": body}
    if seconds is None:
        del record["timestamp"]
    return record


def window(percent, minutes=300, resets=None):
    resets = resets if resets is not None else int(BASE.timestamp()) + 3600
    return {"used_percent": percent, "window_minutes": minutes, "resets_at": resets}


class Home:
    """A home folder with session logs."""

    def __init__(self):
        self.root = Path(tempfile.mkdtemp(prefix="tally-home-"))

    def write(self, records, thread=PARENT, suffix="", archived=False, tail="", day="2026/08/10", stamp="12-00-00"):
        folder = self.root / ("archived_sessions" if archived else f"sessions/{day}")
        folder.mkdir(parents=True, exist_ok=True)
        name = f"rollout-{day.replace('/', '-')}T{stamp}-{thread}{suffix}.jsonl"
        lines = [r if isinstance(r, (str, bytes)) else json.dumps(r) for r in records]
        data = b"".join((x if isinstance(x, bytes) else x.encode()) + b"\n" for x in lines)
        (folder / name).write_bytes(data + tail.encode())
        return folder / name
