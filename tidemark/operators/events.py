"""Events of the catalog: payloads and where they go."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from typing import Any, Protocol


class Sink(Protocol):
    """Takes an event body; True if it was accepted."""

    def __call__(self, body: dict[str, Any]) -> bool: ...


class MemorySink:
    """Keeps events in a list."""

    def __init__(self) -> None:
        self.sent: list[dict[str, Any]] = []

    def __call__(self, body: dict[str, Any]) -> bool:
        self.sent.append(body)
        return True


class FileSink:
    """Appends events to a file, one JSON object a line."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, body: dict[str, Any]) -> bool:
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(json.dumps(body, sort_keys=True) + "\n")
        return True


class HttpSink:
    """Posts events to ``https://<domain>/event``. Any failure is reported as False."""

    def __init__(self, domain: str, timeout: float = 10.0, opener: Callable = urllib.request.urlopen):
        self.url, self.timeout, self.opener = f"https://{domain}/event", timeout, opener

    def __call__(self, body: dict[str, Any]) -> bool:
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        try:
            with self.opener(request, timeout=self.timeout) as answer:
                return 200 <= answer.status < 300
        except (urllib.error.URLError, OSError, ValueError):
            return False


class QueueSink:
    """Hands events over to a queue function as (url, JSON text)."""

    def __init__(self, domain: str, enqueue: Callable[[str, str], Any]):
        self.url, self.enqueue = f"https://{domain}/event", enqueue

    def __call__(self, body: dict[str, Any]) -> bool:
        try:
            self.enqueue(self.url, json.dumps(body))
        except Exception:
            return False
        return True


class Events:
    """Sends events of one workspace; without a sink nothing is sent."""

    def __init__(self, sink: Sink | None = None, clock: Callable[[], int] | None = None):
        self.sink = sink
        self.clock = clock or (lambda: int(time.time() * 1000))

    @property
    def enabled(self) -> bool:
        return self.sink is not None

    def body(self, action: str, workspace: str, collection: str | None, resource_type: str, resource_name: str, data: dict | None = None) -> dict:
        """The event as it is sent."""
        head = {"action": action, "workspace": workspace, "collection": collection, "resource_type": resource_type, "resource_name": resource_name}
        return {"event": {**head, "timestamp": self.clock()}, "data": data or {}}

    def send(self, *args, **kwargs) -> bool:
        return self.sink(self.body(*args, **kwargs)) if self.sink else False


_default: Events | None = None


def default_events() -> Events:
    """Events of this process: to ``TIDEMARK_EVENT_DOMAIN``, if it is set."""
    global _default
    if _default is None:
        domain = os.environ.get("TIDEMARK_EVENT_DOMAIN")
        _default = Events(HttpSink(domain) if domain else None)
    return _default


def emit(*args, **kwargs) -> bool:
    """Send through the events of this process."""
    return default_events().send(*args, **kwargs)


def _given(**kw) -> dict[str, Any]:
    return {k: v for k, v in kw.items() if v is not None}


def dataset_created(schema, location: str | None = None, properties: dict | None = None) -> dict[str, Any]:
    fields = [{"name": f.name, "type": f.dataType.simpleString()} for f in getattr(schema, "fields", [])]
    return {"location": location, "properties": properties or {}, "schema": {"fields": fields}}


def dataset_deleted() -> dict[str, Any]:
    return {}


def dataset_updated(description: str | None = None, properties: dict | None = None) -> dict[str, Any]:
    return {"description": description, "properties": properties or {}}


def dataset_committed(snapshot_id: int, sequence_number: int, record_count: int, file_count: int) -> dict[str, Any]:
    return {"snapshot_id": snapshot_id, "sequence_number": sequence_number, "record_count": record_count, "file_count": file_count}


def collection_created(properties: dict | None = None) -> dict[str, Any]:
    return {"properties": properties or {}}


def view_created(definition: str, properties: dict | None = None) -> dict[str, Any]:
    return {"definition": definition, "properties": properties or {}}


def view_deleted() -> dict[str, Any]:
    return {}


def view_updated(description: str | None = None, properties: dict | None = None) -> dict[str, Any]:
    return {"description": description, "properties": properties or {}}


def view_executed(execution_time_ms: int | None = None, row_count: int | None = None, error: str | None = None) -> dict[str, Any]:
    return _given(execution_time_ms=execution_time_ms, row_count=row_count, error=error)
