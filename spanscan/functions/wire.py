"""Scalar functions on requests, headers, hosts and stored bytes. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Headers of one hop; methods without a body to look at; content types that are looked at.
HOPS = ("connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
BODILESS = ("GET", "HEAD", "DELETE", "OPTIONS", "CONNECT", "TRACE")
TEXTUAL = ("application/json", "application/x-ndjson", "application/ld+json", "text/")
#: Brands of still pictures in ISO containers.
PICTURES = ("heic", "heix", "hevc", "avif")
#: How much older or newer than now a proof of work may be, in seconds.
OLDEST, NEWEST = 120, 30


def sniff(data: Column) -> Column:
    """pdf, image or audio by the first bytes of a binary column; null for others."""
    head, brand = F.hex(F.substring(data, 1, 12)), F.substring(data, 9, 4).cast("string")
    starts = lambda *hexes: F.greatest(*[head.startswith(h) for h in hexes], F.lit(False))
    riff = head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250")
    return (
        F.when(starts("25504446"), "pdf")
        .when((starts("89504E47") & (F.octet_length(data) >= 8)) | starts("FFD8FF", "47494638") | riff, "image")
        .when(starts("494433") | head.rlike("^FF[EF]"), "audio")
        .when(F.substring(head, 9, 8) == "66747970", F.when(brand.isin(*PICTURES), "image").otherwise("audio"))
    )


def scannable(method: Column, content_type: Column) -> Column:
    """Whether a request has a body of text: by its method, and by its type, where it has one."""
    kind = F.lower(F.trim(F.split(F.coalesce(content_type, F.lit("")), ";")[0]))
    fits = kind == ""
    for t in TEXTUAL:
        fits = fits | kind.startswith(t)
    return ~F.upper(F.coalesce(method, F.lit(""))).isin(*BODILESS) & fits


def readable_encoding(content_encoding: Column) -> Column:
    """Whether no coding but identity is applied."""
    codings = F.transform(F.split(F.lower(F.coalesce(content_encoding, F.lit(""))), ","), F.trim)
    return F.forall(codings, lambda c: c.isin("", "identity"))


def safe_header(name: Column, value: Column) -> Column:
    """A name that is a token, and a value without line ends and NUL."""
    return F.coalesce(name.rlike(r"^[!#$%&'*+.^_`|~0-9A-Za-z-]+$") & ~value.rlike(r"[\r\n\x00]"), F.lit(False))


def hop_by_hop(name: Column) -> Column:
    """Whether a header is for one hop and isn't passed on."""
    return F.lower(name).isin(*HOPS)


def https_url(url: Column) -> Column:
    """An https address of a sound host, with a port from 1 to 65535 where it has one."""
    host, port = F.regexp_extract(url, r"^https://([^/:?#]+)", 1), F.regexp_extract(url, r"^https://[^/:?#]+:([0-9]+)", 1)
    return F.coalesce(host_name(host) & url.rlike(r"^https://[^/:?#@]+(:[0-9]{1,5})?([/?#]|$)") & ((port == "") | port.try_cast("int").between(1, 65535)), F.lit(False))


def connect_target(target: Column) -> Column:
    """host, port of what a CONNECT request asks for; null where either isn't sound."""
    host, port = F.regexp_extract(target, r"^(.+):([0-9]{1,5})$", 1), F.regexp_extract(target, r"^(.+):([0-9]{1,5})$", 2).try_cast("int")
    return F.when(host_name(host) & port.between(1, 65535), F.struct(host.alias("host"), port.alias("port")))


def host_name(host: Column) -> Column:
    """Up to 253 characters in labels of up to 63 letters, digits and inner dashes."""
    return F.coalesce((F.length(host) <= 253) & host.rlike(r"^([A-Za-z0-9]|[A-Za-z0-9][A-Za-z0-9-]{0,61}[A-Za-z0-9])(\.([A-Za-z0-9]|[A-Za-z0-9][A-Za-z0-9-]{0,61}[A-Za-z0-9]))*$"), F.lit(False))


def file_name(name: Column) -> Column:
    """What of a name is a letter, digit, dot, dash or underscore; `file` where nothing is."""
    return F.coalesce(F.nullif(F.regexp_replace(name, "[^A-Za-z0-9_.-]", ""), F.lit("")), F.lit("file"))


def url_decoded(text: Column) -> Column:
    """Plus signs and percent codes decoded; the text itself where it is malformed."""
    return F.coalesce(F.try_url_decode(text), text)


def zero_bits(digest: Column) -> Column:
    """How many bits at the start of a digest in lower-case hex are zero."""
    rest = F.regexp_replace(digest, "^0+", "")
    first = F.conv(F.substring(rest, 1, 1), 16, 10).cast("int")
    inner = F.when(rest == "", 0).when(first >= 8, 0).when(first >= 4, 1).when(first >= 2, 2).otherwise(3)
    return (F.length(digest) - F.length(rest)) * 4 + inner


def proof_of_work(material: Column, nonce: Column, bits: int, age: Column | None = None) -> Column:
    """Whether SHA-256 of material and nonce starts with `bits` zero bits; with an age in seconds, also whether it is fresh."""
    good = zero_bits(F.sha2(F.concat(material, nonce), 256)) >= bits
    return F.coalesce(good if age is None else good & age.between(-NEWEST, OLDEST), F.lit(False))


def frames(stream: Column) -> Column:
    """The finished frames of an event stream: what blank lines end. What comes after the last one is not among them."""
    parts = F.split(stream, r"\r?\n\r?\n", -1)
    return F.filter(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda f: f != "")


def delta_text(frame: Column) -> Column:
    """The text that a frame's `data:` payload adds, whichever provider's shape it has; other payloads as they are, with a space; null for the end marker."""
    data = F.trim(F.regexp_replace(F.regexp_extract(frame, r"(?m)^data:(.*)$", 1), "\r", ""))
    paths = ("$.choices[0].delta.content", "$.choices[0].delta.reasoning", "$.choices[0].message.content", "$.choices[0].text", "$.delta.text", "$.delta.partial_json")
    parts = F.array_join(F.from_json(F.get_json_object(data, "$.candidates[0].content.parts[*].text"), "array<string>"), "")  # all parts' texts
    one = F.get_json_object(data, "$.candidates[0].content.parts[0].text")
    return F.when(data.isin("", "[DONE]"), F.lit(None)).otherwise(F.coalesce(*[F.get_json_object(data, p) for p in paths], parts, one, F.concat(data, F.lit(" "))))
