"""Scalar functions as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codec import FRAME_COST

# fixed values: endpoint suffixes in the order they are tried, and headers that a proxy drops
ENDPOINTS = (("/chat/completions", "chat"), ("/completions", "completions"), ("/responses", "responses"), ("/messages", "messages"), ("/count_tokens", "messages"), ("/embeddings", "embeddings"), ("/models", "models"))
REQUEST_DROPS = ("connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade", "content-length", "host", "expect")
RESPONSE_DROPS = ("connection", "keep-alive", "transfer-encoding", "content-length")
REF_COST, LIT_COST, CHUNK = 20, 4, 256 * 1024


def classify(path: Column) -> Column:
    bare = F.regexp_replace(F.substring_index(path, "?", 1), "/+$", "")
    out = F.lit("other")
    for suffix, kind in reversed(ENDPOINTS):
        out = F.when(F.endswith(bare, F.lit(suffix)), kind).otherwise(out)
    return out


def dedupable(kind: Column) -> Column:
    return ~kind.isin("models", "other")


def gate(kind: Column, size: Column, enabled: Column, least: Column, most: Column) -> Column:
    """Why a request is not split, or null."""
    return F.when(~dedupable(kind), "path").when(~enabled, "disabled").when(size < least, "too_small").when(size > most, "too_large")


def inflates(wire: Column, body: Column) -> Column:
    return wire > body + F.greatest(F.floor(body / 16), F.lit(1024))


def kept_headers(headers: Column, drops: tuple[str, ...]) -> Column:
    low = F.transform(headers, lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value")))
    return F.filter(low, lambda h: ~h["name"].isin(*drops))


def authorised(headers: Column, kind: Column, key: Column) -> Column:
    """A map of headers with the upstream's key; unchanged without a key."""
    bare = F.map_filter(headers, lambda k, _: k != "authorization")
    mine = F.map_filter(bare, lambda k, _: k != "x-api-key")
    versioned = F.when(F.map_contains_key(headers, "anthropic-version"), mine).otherwise(F.map_concat(mine, F.create_map(F.lit("anthropic-version"), F.lit("2023-06-01"))))
    messages = F.map_concat(versioned, F.create_map(F.lit("x-api-key"), key))
    other = F.map_concat(bare, F.create_map(F.lit("authorization"), F.concat(F.lit("Bearer "), key)))
    return F.when(key.isNull(), headers).when(kind == "messages", messages).otherwise(other)


def query_param(path: Column, name: str) -> Column:
    """The first value of a query parameter, or null."""
    query = F.when(F.contains(path, F.lit("?")), F.regexp_extract(path, r"\?(.*)$", 1)).otherwise(F.lit(""))
    hits = F.filter(F.split(query, "&"), lambda p: F.startswith(p, F.lit(f"{name}=")))
    return F.substring(F.get(hits, F.lit(0)), len(name) + 2, 1 << 30)


def human(n: Column) -> Column:
    part = lambda unit, digits: F.format_string(f"%.{digits}f", F.bround(n / float(unit), digits))
    return F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(part(1 << 10, 1), F.lit(" KiB"))).when(n < 1 << 30, F.concat(part(1 << 20, 1), F.lit(" MiB"))).otherwise(F.concat(part(1 << 30, 2), F.lit(" GiB")))


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.lit(".."), F.right(text, F.lit(n - 2))))


def absolute(host: Column, path: Column) -> Column:
    return F.when(F.startswith(path, F.lit("/")), F.concat(host, path))


def varint_len(n: Column) -> Column:
    out = F.lit(10)
    for k in range(9, 0, -1):
        out = F.when(n < F.lit(1 << 7 * k), k).otherwise(out) if 7 * k < 63 else F.when(n >= 0, k).otherwise(out)
    return out


def frame_len(stream: Column, payload: Column) -> Column:
    return F.lit(1) + varint_len(stream) + varint_len(payload) + payload


def frame_charge(payload: Column) -> Column:
    """What a frame is counted as: its payload and a fixed sum for its head."""
    return payload + FRAME_COST


def saved_ratio(wire: Column, body: Column) -> Column:
    """The share of a body that was not sent; below 0 where more was, 0 for an empty body."""
    return F.when(body == 0, 0.0).otherwise(1 - wire / body)


def control(**fields: Column) -> Column:
    """A control message: JSON of the columns in their order, without null ones."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def whole_frames(stream: Column, size: Column) -> Column:
    """Encoded bytes of a body sent whole, in chunks."""
    full, rest = F.floor(size / CHUNK), size % CHUNK
    return full * frame_len(stream, F.lit(CHUNK)) + F.when(rest > 0, frame_len(stream, rest)).otherwise(0)


def digest(kind: int, text: Column) -> Column:
    """32 hex digits of a block: SHA-256 of kind, length and bytes. Only equality matters."""
    return F.substring(F.sha2(F.concat(F.lit(f"block:{kind}:"), F.octet_length(text).cast("string"), F.lit(":"), text), 256), 1, 32)


def mask(bits: int) -> int:
    return (1 << min(bits, 40)) - 1


def basis_points(part: Column, whole: Column) -> Column:
    """part / whole in hundredths of a percent, rounded down; 0 for nothing."""
    return F.when(whole == 0, F.lit(0).cast("long")).otherwise(F.floor(part * 10000 / whole).cast("long"))


def skip_label(reason: Column) -> Column:
    names = {"path": "endpoint is relayed", "disabled": "splitting is off", "too_small": "body is small", "too_large": "body is large", "unknown_shape": "nothing to reference", "limits": "would grow", "shadow": "shadow mode", "rebuild failed": "peer could not rebuild"}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, reason), reason)
