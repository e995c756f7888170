"""Attachments of requests: parts of multipart bodies, media in JSON bodies, and bodies with some of them replaced.

Bytes and JSON trees of any depth are walked by small Arrow functions, a row at a time; what is looked for and what is
done with it are DataFrame operations. Recognising what a picture, document or recording says is a slot for a model.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of one medium, and media of one request; a request with more isn't looked into.
LARGEST, MOST = 32 << 20, 20
#: Media types of recorded speech by the format that a block names.
SOUND = {"wav": "audio/wav", "mp3": "audio/mpeg", "m4a": "audio/mp4", "mp4": "audio/mp4", "flac": "audio/flac", "ogg": "audio/ogg", "opus": "audio/ogg", "webm": "audio/webm"}
_ABOUT = [("name", pa.string()), ("filename", pa.string()), ("content_type", pa.string()), ("first_byte", pa.int32())]
PART, PLACE = pa.struct([*_ABOUT, ("body", pa.binary())]), pa.struct([*_ABOUT, ("n_bytes", pa.int32())])
#: Bodies of which a worker holds the parts as Python objects at a time: so many, or as many as have so many bytes.
AT_ONCE, BYTES_AT_ONCE = 256, 4 << 20
MEDIUM = pa.struct([("block", pa.string()), ("path", pa.string()), ("provider", pa.string()), ("media_type", pa.string()), ("data", pa.binary())])


def parameters(header: str) -> dict[str, str]:
    """The parameters of a header's value, by name in lower case: tokens, or quoted strings in which a backslash quotes the next character. Of a name that comes twice the first counts."""
    out, at, n = {}, header.find(";") + 1 or len(header), len(header)
    while at < n:
        stop = at
        while stop < n and header[stop] not in "=;":
            stop += 1
        name, at, value = header[at:stop].strip().lower(), stop + 1, ""
        if stop < n and header[stop] == "=":
            while at < n and header[at] in " \t":
                at += 1
            if at < n and header[at] == '"':
                at += 1
                while at < n and header[at] != '"':
                    at += header[at] == "\\" and at + 1 < n
                    value, at = value + header[at], at + 1
                at = n if (end := header.find(";", at)) < 0 else end + 1
            else:
                stop = n if (end := header.find(";", at)) < 0 else end
                value, at = "".join(header[at:stop].split()[:1]), stop + 1
            if name:
                out.setdefault(name, value)
    return out


def boundary(content_type: Column) -> Column:
    """The boundary that a multipart content type names; null for others."""

    @F.arrow_udf("string")
    def of(types: pa.Array) -> pa.Array:
        named = (t.as_py() for t in types)
        return pa.array([parameters(t).get("boundary") or None if t and t.lstrip().lower().startswith("multipart/") else None for t in named], pa.string())

    return of(content_type)


def _parts(body: memoryview, mark: str) -> Iterator[tuple[dict, int, int]]:
    """The parts between marks that stand at the start of a line: what their headers say, and where their content starts and ends. Nothing but headers is copied."""
    at = [m.start(1) for m in re.finditer(rb"(?:\A|\n)(--" + re.escape(mark.encode()) + rb")", body)]
    line_end, head_end = re.compile(rb"\n"), re.compile(rb"\r?\n\r?\n")
    for start, end in zip(at, at[1:], strict=False):
        line, head = line_end.search(body, start, end), head_end.search(body, start, end)
        if line is None or head is None:
            continue
        about = {}
        for row in bytes(body[line.end() : max(line.end(), head.start())]).split(b"\n"):
            name, colon, value = row.decode("utf-8", "replace").strip().partition(":")
            if colon and name.strip():
                about[name.strip().lower()] = value.strip()
        stop = end
        if stop > head.end() and body[stop - 1] == 10:
            stop -= 1
            stop -= stop > head.end() and body[stop - 1] == 13
        named = parameters(about.get("content-disposition", ""))
        yield {"name": named.get("name"), "filename": named.get("filename"), "content_type": about.get("content-type"), "first_byte": head.end()}, head.end(), stop


def _few(bodies: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of a batch's rows that are few and small enough to be Python objects at once; a larger body is a range of its own."""
    start, size = 0, 0
    for i, b in enumerate(bodies):
        n = b.as_buffer().size if b.is_valid else 0
        if i > start and (i - start >= AT_ONCE or size + n > BYTES_AT_ONCE):
            yield start, i
            start, size = i, 0
        size += n
    yield start, len(bodies)


def _each(bodies: pa.Array, marks: pa.Array, kind: pa.DataType, last: Callable[[memoryview, int, int], dict]) -> pa.Array:
    """The parts of each body as an array of kind, with what `last` makes of a part's bytes; null where there is no mark."""
    row = lambda b, m: [about | last(body, lo, hi) for body in [memoryview(b.as_buffer())] for about, lo, hi in _parts(body, m.as_py())] if b.is_valid and m.is_valid else None
    some = [pa.array([row(b, m) for b, m in zip(bodies[lo:hi], marks[lo:hi], strict=True)], pa.list_(kind)) for lo, hi in _few(bodies)]
    return pa.concat_arrays(some)


def _marks(content_type: str | Column) -> Column:
    return boundary(F.col(content_type) if isinstance(content_type, str) else content_type)


def parts(body: str | Column, content_type: str | Column) -> Column:
    """The parts of a multipart body: name, filename, content_type, first_byte, body. Null for bodies of other types; none where fewer than two marks are found."""

    @F.arrow_udf("array<struct<name:string,filename:string,content_type:string,first_byte:int,body:binary>>")
    def of(bodies: pa.Array, marks: pa.Array) -> pa.Array:
        return _each(bodies, marks, PART, lambda b, lo, hi: {"body": bytes(b[lo:hi])})

    return of(body, _marks(content_type))


def places(body: str | Column, content_type: str | Column) -> Column:
    """As `parts`, with n_bytes in place of the content, which then neither leaves a worker nor is copied in it."""

    @F.arrow_udf("array<struct<name:string,filename:string,content_type:string,first_byte:int,n_bytes:int>>")
    def of(bodies: pa.Array, marks: pa.Array) -> pa.Array:
        return _each(bodies, marks, PLACE, lambda b, lo, hi: {"n_bytes": hi - lo})

    return of(body, _marks(content_type))


def rebuilt(body: str | Column, content_type: str | Column, replaced: Column) -> Column:
    """A multipart body with some parts' contents replaced: replaced is an array of first_byte, n_bytes, by, in order. All other bytes stay as they are."""

    def step(s: Column, x: Column) -> Column:
        return F.struct((x["first_byte"] + x["n_bytes"]).alias("at"), F.concat(s["out"], F.substring(raw, s["at"] + 1, x["first_byte"] - s["at"]), x["by"]).alias("out"))

    raw = F.col(body) if isinstance(body, str) else body
    start = F.struct(F.lit(0).alias("at"), F.lit(b"").alias("out"))
    done = F.aggregate(replaced, start, step, lambda s: F.concat(s["out"], F.substring(raw, s["at"] + 1, F.octet_length(raw))))
    return F.when(F.size(replaced) > 0, done).otherwise(raw)


def from_base64(text: Column) -> Column:
    """The bytes of a base64 text, white space aside; null where it isn't base64 or is larger than LARGEST."""
    data = F.try_to_binary(F.regexp_replace(text, r"\s", ""), F.lit("base64"))
    return F.when(F.octet_length(data) <= LARGEST, data)


def from_data_url(url: Column) -> Column:
    """media_type, data of a data URL in base64; null for others."""
    head = F.regexp_extract(url, r"(?s)^data:([^,]*),", 1)
    kind = F.coalesce(F.nullif(F.split(head, ";")[0], F.lit("")), F.lit("image/png"))
    return F.when(url.rlike(r"(?is)^data:[^,]*;[^,]*base64[^,]*,"), F.struct(kind.alias("media_type"), from_base64(F.regexp_replace(url, r"(?s)^data:[^,]*,", "")).alias("data")))


def _decoded(text: str) -> bytes | None:
    try:
        data = base64.b64decode("".join(text.split()), validate=True)
    except (binascii.Error, ValueError):
        return None
    return data if len(data) <= LARGEST else None


def _medium(d: dict) -> tuple[list[str], str, str, str] | None:
    """Keys to the data from a block, provider, media type and base64 text, where a block has one of the known shapes."""
    match d:
        case {"image_url": {"url": str(url)}} if m := re.match(r"(?is)data:([^;,]*);([^,]*base64[^,]*),(.*)\Z", url):
            return ["image_url", "url"], "openai", m[1] or "image/png", m[3]
        case {"source": {"type": "base64", "media_type": str(kind), "data": str(data)}} if re.match(r"(?i)\s*(image/|application/pdf\s*(;|\Z))", kind):
            return ["source", "data"], "anthropic", kind, data
        case {"type": "input_audio", "input_audio": {"data": str(data)} as block}:
            form = str(block.get("format") or "mp3").lower()
            return ["input_audio", "data"], "openai", SOUND.get(form, f"audio/{form}"), data
    for key in ("inlineData", "inline_data"):
        inner = d.get(key)
        if isinstance(inner, dict) and isinstance(inner.get("data"), str):
            kind = inner.get("mimeType", inner.get("mime_type"))
            if isinstance(kind, str) and re.match(r"(?i)\s*(image/|audio/|application/pdf\s*(;|\Z))", kind):
                return [key, "data"], "gemini", kind, inner["data"]
    return None


def _walk(node, path: list) -> Iterator[dict]:
    todo = [(node, path)]
    while todo:
        node, path = todo.pop()
        if isinstance(node, dict):
            found = _medium(node)
            if found and (data := _decoded(found[3])) is not None:
                yield {"block": json.dumps(path), "path": json.dumps(path + found[0]), "provider": found[1], "media_type": found[2], "data": data}
                continue
            todo += [(v, [*path, k]) for k, v in reversed(node.items())]
        elif isinstance(node, list):
            todo += [(v, [*path, i]) for i, v in reversed(list(enumerate(node)))]


def media(body: str | Column) -> Column:
    """Media in a JSON body: block and path (JSON lists of keys and places), provider, media_type, data. None in bodies that aren't JSON, or have none."""

    @F.arrow_udf("array<struct<block:string,path:string,provider:string,media_type:string,data:binary>>")
    def of(bodies: pa.Array) -> pa.Array:
        out = []
        for b in bodies:
            try:
                out.append(list(_walk(json.loads(b.as_py() or "null"), [])))
            except ValueError:
                out.append([])
        return pa.array(out, pa.list_(MEDIUM))

    return of(body)


def inspectable(found: Column) -> Column:
    """The media of a request that are looked into: all, or none where there are more than MOST."""
    return F.when(F.size(found) <= MOST, found).otherwise(F.filter(found, lambda x: F.lit(False)))


def label(types: Column) -> Column:
    """What a notice calls media of these types."""
    every = lambda start: F.forall(types, lambda t: F.lower(t).startswith(start))
    return F.when(every("application/pdf"), "PDF").when(every("image/"), "image").when(every("audio/"), "audio clip").otherwise("attachment")


def placeholders(findings: DataFrame, keys: list[str], block: str = "block", kind: str = "kind", media_type: str = "media_type", provider: str = "provider") -> DataFrame:
    """keys, block, by: what stands for each block with findings, as JSON: its label, and how many of what was found in it."""
    n = findings.groupBy(*keys, block, kind).agg(F.count("*").alias("n"), F.collect_set(media_type).alias("types"), F.min(provider).alias("provider"))
    told = F.concat(F.col("n").cast("string"), F.lit(" "), F.col(kind))
    rows = n.groupBy(*keys, block).agg(F.array_sort(F.collect_list(told)).alias("told"), F.array_distinct(F.flatten(F.collect_list("types"))).alias("types"), F.min("provider").alias("provider"))
    text = F.concat(F.lit("[removed: "), label(F.col("types")), F.lit(" with "), F.array_join("told", ", "), F.lit("]"))
    shape = F.when(F.col("provider") == "gemini", F.to_json(F.struct(text.alias("text")))).otherwise(F.to_json(F.struct(F.lit("text").alias("type"), text.alias("text"))))
    return rows.select(*keys, block, shape.alias("by"))


def replaced(body: str | Column, blocks: Column) -> Column:
    """A JSON body with blocks (array of block, by; paths as in `media`, by as JSON) replaced. Without any, or where it isn't JSON, the body as it is, byte for byte; paths that lead nowhere change nothing."""

    @F.arrow_udf("string")
    def of(bodies: pa.Array, every: pa.Array) -> pa.Array:
        out = []
        for b, some in zip(bodies, every, strict=True):
            text, some = b.as_py(), some.as_py()
            try:
                root = [json.loads(text)] if text and some else None
            except ValueError:
                root = None
            if root is None:
                out.append(text)
                continue
            for x in some:
                holder, path = root, [0, *json.loads(x["block"])]
                try:
                    for step in path[:-1]:
                        holder = holder[step]
                    holder[path[-1]]  # noqa: B018  there or not
                    holder[path[-1]] = json.loads(x["by"])
                except (KeyError, IndexError, TypeError):
                    continue
            out.append(json.dumps(root[0], ensure_ascii=False, separators=(",", ":"), sort_keys=True))
        return pa.array(out, pa.string())

    return of(body, blocks)
