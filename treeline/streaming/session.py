"""A session over one root: framed requests in, responses and coalesced change hints out. The session holds no rows; every read runs its query anew."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator
from typing import BinaryIO

from .events import MAX_SEQUENCE, READS

MAX_REQUEST, MAX_MESSAGE, QUEUE = 4 << 20, 8 << 20, 8
OPERATIONS = ("query", "explain", "index_status", "refresh", "subscribe", "unsubscribe", "shutdown")


class RootChanged(RuntimeError):
    """The root isn't the one that the session was opened on; the session is over."""


class ChangeQueue:
    """Changes seen and not yet told, at most `size`; beyond it they are dropped, and a rescan is asked for instead."""

    def __init__(self, size: int = QUEUE):
        self.size, self.held, self.lost = size, deque(), False

    def offer(self, paths: list[str]) -> bool:
        if len(self.held) >= self.size:
            self.lost = True
            return False
        self.held.append(paths)
        return True

    def drain(self) -> str | None:
        """`rescan_required` if anything was dropped, `workspace_changed` if anything is held, else None; both are forgotten."""
        kind = "rescan_required" if self.lost else "workspace_changed" if self.held else None
        self.held.clear()
        self.lost = False
        return kind


def frames(stream: BinaryIO, most: int = MAX_REQUEST) -> Iterator[bytes | None]:
    """Lines of a stream; None for one that is longer than `most`, which is read to its end in pieces and not kept."""
    while line := stream.readline(most + 1):
        if len(line.rstrip(b"\n")) <= most:
            yield line.rstrip(b"\n")
            continue
        while line and not line.endswith(b"\n"):
            line = stream.readline(1 << 16)
        yield None


def message(value: dict, most: int = MAX_MESSAGE) -> bytes:
    """A line of JSON; a value that would be too long becomes an error of the same id."""
    line = json.dumps(value, separators=(",", ":"), ensure_ascii=False).encode() + b"\n"
    if len(line) > most:
        line = json.dumps({"id": value.get("id"), "ok": False, "error": "message_too_large"}, separators=(",", ":")).encode() + b"\n"
    return line


class Session:
    """handlers: a function of a request's arguments for each reading operation; token: what identifies the root now."""

    def __init__(self, handlers: dict[str, Callable[[dict], object]], token: Callable[[], object], changes: ChangeQueue | None = None):
        self.handlers, self.token, self.changes = handlers, token, changes or ChangeQueue()
        self.root, self.subscribed, self.dirty, self.number, self.open = token(), False, False, 0, True

    def _pinned(self) -> None:
        if self.token() != self.root:
            self.open = False
            raise RootChanged("root_authority_changed")

    def event(self) -> dict | None:
        """The next hint, or None: nothing changed, nobody listens, or the last hint hasn't been followed by a read."""
        kind = self.changes.drain()
        if not self.open or kind is None or not self.subscribed or self.dirty:
            return None
        self._pinned()
        if self.number >= MAX_SEQUENCE:
            raise OverflowError("the session's event numbers are used up")
        self.number, self.dirty = self.number + 1, True
        return {"event": kind, "sequence": self.number}

    def respond(self, frame: bytes | None) -> dict:
        """The response to one frame. Errors of a request leave the session as it was."""
        if frame is None:
            return {"id": None, "ok": False, "error": "request_too_large"}
        try:
            request = json.loads(frame)
            key, operation = request["id"], request["operation"]
        except (ValueError, KeyError, TypeError):
            return {"id": None, "ok": False, "error": "invalid_request"}
        if operation not in OPERATIONS:
            return {"id": key, "ok": False, "error": "unknown_operation"}
        self._pinned()
        result = None
        if operation in self.handlers:
            try:
                result = self.handlers[operation](request.get("arguments", {}))
            except Exception as error:
                return {"id": key, "ok": False, "error": getattr(error, "code", type(error).__name__)}
            self._pinned()
        self.subscribed = {"subscribe": True, "unsubscribe": False}.get(operation, self.subscribed)
        self.dirty = self.dirty and operation not in READS
        self.open = self.open and operation != "shutdown"
        return {"id": key, "ok": True, "result": result}

    def serve(self, stream: BinaryIO, out: BinaryIO) -> None:
        """Answer frames until shutdown, the stream's end, or a change of the root, which is told last."""
        try:
            for frame in frames(stream):
                out.write(message(self.respond(frame)))
                if not self.open:
                    break
                if hint := self.event():
                    out.write(message(hint))
        except RootChanged as error:
            out.write(message({"id": None, "ok": False, "error": str(error), "terminal": True}))
