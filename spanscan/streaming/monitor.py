"""Streamed responses watched as they come: frames put together, text scanned over a rolling tail, tool calls gathered.

A stream is a small state machine that takes chunks in order. The same machine runs over a finished table
(`applyInPandas`, a stream at a time) and over a live stream (`transformWithStateInPandas`, its state kept by Spark).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.context import DANGEROUS
from ..operators.matching import Rule
from .reassembly import TAIL

#: Bytes of an unfinished frame; characters that are kept of text without tools, and from how many bytes on; tool calls at once, bytes of their arguments and of a name; characters of an excerpt.
BUFFER, IDLE_KEPT, IDLE = 1 << 20, 1_024, 65_536
CALLS, ARGUMENTS, NAME, EXCERPT = 64, 1 << 20, 1_024, 2_048
#: What a stream that calls tools has in it; what is sent in place of the rest of a stream that is closed.
TOOLS = ("tool_use", "input_json_delta", "tool_calls", "function_call")
REDACTED = 'event: redacted\ndata: {"error":"response_blocked"}\n\ndata: [DONE]\n\n'
OVERSIZE = 'event: oversize\ndata: {"error":"buffer_exceeded"}\n\ndata: [DONE]\n\n'
_END = re.compile(r"\n\n|\r\n\r\n")


def compiled(rules: tuple[Rule, ...]) -> list[tuple[str, str, re.Pattern]]:
    return [(r.name or r.id, r.category, re.compile(r.pattern)) for r in rules]


def payloads(frame: str) -> Iterator[str]:
    for line in frame.split("\n"):
        if line.startswith("data:") and (p := line[5:].strip()) not in ("", "[DONE]"):
            yield p


def _object(text: str) -> dict | None:
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def known_text(o: dict) -> str | None:
    """The text that a payload adds, whichever provider's shape it has."""
    match o:
        case {"choices": [{"delta": {"content": str(t)}}, *_]} | {"choices": [{"delta": {"reasoning": str(t)}}, *_]} | {"choices": [{"message": {"content": str(t)}}, *_]} | {"choices": [{"text": str(t)}, *_]}:
            return t
        case {"delta": {"text": str(t)}} | {"delta": {"partial_json": str(t)}}:
            return t
        case {"candidates": [{"content": {"parts": list(found)}}, *_]}:
            return "".join(p["text"] for p in found if isinstance(p, dict) and isinstance(p.get("text"), str))
    return None


def text_of(frame: str) -> str:
    """All that a frame's payloads say; those of unknown shapes as they are, with a space."""
    out = []
    for p in payloads(frame):
        t = known_text(o) if (o := _object(p)) is not None else None
        out.append(p + " " if t is None else t)
    return "".join(out)


@dataclass
class Frames:
    """Forwards a stream frame by frame, until its text is detected or a frame gets too large."""

    buffer: str = ""
    tail: str = ""
    status: str = "open"
    names: list[str] = field(default_factory=list)

    def _seen(self, frame: str, rules: list) -> bool:
        if new := text_of(frame):
            self.tail = (self.tail + new)[-TAIL:]
            self.names = sorted({n for n, _, p in rules if p.search(self.tail)})
            if self.names:
                self.status, self.buffer = "redacted", ""
        return self.status == "redacted"

    def take(self, chunk: str, rules: list) -> str:
        if self.status != "open":
            return ""
        self.buffer += chunk
        if len(self.buffer.encode()) > BUFFER:
            self.status, self.buffer = "oversize", ""
            return OVERSIZE
        out, at = [], 0
        for m in _END.finditer(self.buffer):
            frame, at = self.buffer[at : m.start()], m.end()
            if self._seen(frame, rules):
                return "".join(out) + REDACTED
            out.append(frame + "\n\n")
        self.buffer = self.buffer[at:]
        return "".join(out)

    def end(self, rules: list) -> str:
        rest, self.buffer = self.buffer, ""
        if self.status != "open" or not rest:
            return ""
        return REDACTED if self._seen(rest, rules) else rest

    def rows(self, key, chunks: Iterator[tuple[int, str, bool]], rules: list) -> Iterator[tuple]:
        for seq, chunk, last in chunks:
            out = self.take(chunk, rules) + (self.end(rules) if last else "")
            yield (*key, seq, out, self.status, list(self.names))


@dataclass
class Calls:
    """Puts tool calls together, in two shapes, and tells of those whose arguments are dangerous. Past its limits a stream is watched no more."""

    buffer: str = ""
    engaged: bool = False
    disabled: bool = False
    pending: dict[str, list[str]] = field(default_factory=dict)  #: name and arguments, by shape and number

    def _off(self) -> None:
        self.disabled, self.engaged, self.buffer = True, False, ""
        self.pending.clear()

    def _admit(self, key: str, name: str | None = None, more: str | None = None) -> None:
        held = sum(len(a.encode()) for _, a in self.pending.values())
        if key not in self.pending and len(self.pending) >= CALLS or name and len(name.encode()) > NAME or more and held + len(more.encode()) > ARGUMENTS:
            self._off()
            return
        call = self.pending.setdefault(key, ["", ""])
        call[0], call[1] = name or call[0], call[1] + (more or "")

    def _frame(self, frame: str) -> list[list[str]]:
        done = []
        for p in payloads(frame):
            if self.disabled:
                break
            match o := _object(p):
                case {"type": "content_block_start", "index": int(i), "content_block": {"type": "tool_use"} as block}:
                    self.pending.pop(f"a{i}", None)
                    self._admit(f"a{i}", str(block.get("name") or ""))
                case {"type": "content_block_delta", "index": int(i), "delta": {"type": "input_json_delta", "partial_json": str(t)}} if f"a{i}" in self.pending:
                    self._admit(f"a{i}", more=t)
                case {"type": "content_block_stop", "index": int(i)} if f"a{i}" in self.pending:
                    done.append(self.pending.pop(f"a{i}"))
            match o:
                case {"choices": [{"delta": {"tool_calls": list(calls)}}, *_]}:
                    for c in calls:
                        if isinstance(c, dict) and not self.disabled:
                            f = c.get("function") if isinstance(c.get("function"), dict) else {}
                            self._admit(f"o{c.get('index') or 0}", f.get("name"), f.get("arguments"))
            match o:
                case {"choices": [{"finish_reason": "tool_calls"}, *_]}:
                    done += [self.pending.pop(k) for k in [k for k in self.pending if k[0] == "o"]]
        return done

    def take(self, chunk: str) -> list[list[str]]:
        if self.disabled:
            return []
        if len(self.buffer.encode()) + len(chunk.encode()) > BUFFER:
            self._off()
            return []
        self.buffer += chunk
        if not self.engaged:
            self.engaged = any(t in self.buffer for t in TOOLS)
            if not self.engaged:
                if len(self.buffer.encode()) > IDLE:
                    self.buffer = self.buffer[-IDLE_KEPT:]
                return []
        done, at = [], 0
        for m in _END.finditer(self.buffer):
            frame, at = self.buffer[at : m.start()], m.end()
            done += self._frame(frame)
            if self.disabled:
                return done
        self.buffer = self.buffer[at:]
        return done

    def end(self) -> list[list[str]]:
        """What is left at the end of a response; the stream is as new afterwards."""
        done = self._frame(self.buffer) if self.buffer and not self.disabled else []
        done += list(self.pending.values())
        self.buffer, self.engaged, self.disabled = "", False, False
        self.pending.clear()
        return done

    def rows(self, key, chunks: Iterator[tuple[int, str, bool]], rules: list) -> Iterator[tuple]:
        for seq, chunk, last in chunks:
            for name, args in self.take(chunk) + (self.end() if last else []):
                hits = [(n, c) for n, c, p in rules if args and p.search(args)]
                if bad := sorted({c for _, c in hits} & set(DANGEROUS)):
                    yield (*key, seq, name, args[:EXCERPT], sorted({n for n, _ in hits}), bad)


KINDS = {
    "frames": (Frames, "seq long, forward string, status string, names array<string>", ["seq", "forward", "status", "names"]),
    "calls": (Calls, "seq long, tool_name string, arg_excerpt string, names array<string>, categories array<string>", ["seq", "tool_name", "arg_excerpt", "names", "categories"]),
}


def _chunks(rows: pd.DataFrame) -> Iterator[tuple[int, str, bool]]:
    for seq, chunk, last in rows.sort_values("seq", kind="stable")[["seq", "chunk", "is_end"]].itertuples(index=False):
        yield int(seq), chunk or "", bool(last)


def watched(chunks: DataFrame, rules: tuple[Rule, ...], kind: str, stream: str = "stream_id") -> DataFrame:
    """Over a table of chunks (stream, seq, chunk, is_end): `frames` gives a row for each chunk with what is forwarded and the status, `calls` a row for each dangerous call."""
    machine, schema, names = KINDS[kind]
    ready = compiled(rules)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(machine().rows(key, _chunks(rows), ready)), columns=[stream, *names])

    of = chunks.schema[stream].dataType.simpleString()
    return chunks.select(stream, "seq", "chunk", "is_end").groupBy(stream).applyInPandas(run, f"{stream} {of}, {schema}")


class Watcher(StatefulProcessor):
    """One stream's machine, its state kept as JSON and dropped when the stream ends or `ttl` milliseconds after its last chunk."""

    def __init__(self, kind: str, rules: tuple[Rule, ...], columns: list[str], ttl: int | None = None):
        self.kind, self.rules, self.columns, self.ttl = kind, rules, columns, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ready = compiled(self.rules)
        self.state = handle.getValueState("machine", StructType([StructField("json", StringType())]), self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        machine = KINDS[self.kind][0]
        now = machine(**json.loads(self.state.get()[0])) if self.state.exists() else machine()
        every = pd.concat(list(rows))
        out = list(now.rows(key, _chunks(every), self.ready))
        if every["is_end"].any():
            self.state.clear()
        else:
            self.state.update((json.dumps(asdict(now)),))
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def watching(chunks: DataFrame, rules: tuple[Rule, ...], kind: str, stream: str = "stream_id", ttl: int | None = None) -> DataFrame:
    """As `watched`, over a live stream; chunks of one stream have to arrive in order from batch to batch."""
    _, schema, names = KINDS[kind]
    of = chunks.schema[stream].dataType.simpleString()
    processor = Watcher(kind, rules, [stream, *names], ttl)
    return chunks.select(stream, "seq", "chunk", "is_end").groupBy(stream).transformWithStateInPandas(processor, f"{stream} {of}, {schema}", "Append", "ProcessingTime" if ttl else "None")
