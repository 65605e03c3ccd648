"""Secret scans by a recursive decoding worklist.

A text is a first layer. Each layer is scanned for secrets, and every encoded part of it is unwrapped
into a new layer: URL escapes, Unicode escapes (``\\uXXXX``, ``\\u{X}``, ``\\UXXXXXXXX``, ``\\xXX``, ``&#NN;``), base64 (plain or
URL-safe, from each of the four places where a run's first group may begin) and, inside base64, gzip
or zlib streams, one inside or after another too. New layers are scanned and unwrapped in turn until
none is left. A layer that was seen before for the same place is not entered again, so cycles end.
Each character of a layer knows the range of the original text that it comes from, so a secret found
deep down is reported at the place of the original that holds it.

Kinds: ``assign`` (a named value), ``access`` (an access key id), ``hex`` (a long hexadecimal run).
Matches are leftmost and do not overlap within a kind and a layer.

Defined results: null and empty texts have no spans; texts are read whole; repeated rows get equal
results; of a layer that is not text once decoded (bytes that are not UTF-8 or mostly unprintable) the
stretches of 12 printable characters and more are read; an empty table gives an empty table; other columns pass
through, whatever their names. A compressed stream is unpacked up to ``MAX_LAYER`` bytes, which guards a worker's memory
against streams made to explode; a document in which that happened is marked ``over_limit``.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import zlib
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportmill.llm.common import col, documents, fresh

#: The kinds in their order, their patterns and their least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of 24 and more among all runs
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

URL_PART = re.compile(r"[!-~]*%[0-9A-Fa-f]{2}[!-~]*")
URL_BYTES = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(
    r"\\u([dD][89abAB][0-9A-Fa-f]{2})\\u([dD][c-fC-F][0-9A-Fa-f]{2})"  # a surrogate pair
    r"|\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#(\d{1,7}|[xX][0-9A-Fa-f]{1,6});"
)
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Where a compressed stream may begin inside other bytes, and text of the least length of a secret.
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
STRETCH = re.compile(
    rb"(?:[\t\n\r -~]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}){12,}"
)
MAX_LAYER = 64 << 20
PIECE = 1 << 16


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the secrets of one layer."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return out


def _text(raw: bytes) -> str | None:
    """The bytes as text, if they are text."""
    try:
        s = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    good = sum(c.isprintable() or c in "\n\r\t" for c in s)
    return s if s and 10 * good >= 9 * len(s) else None


def _unpack(raw: bytes, at: int) -> tuple[bytes, int, bool]:
    """(content of the gzip or zlib streams from a place on, one directly after another, end, whether it was over the limit)."""
    parts, size, end = [], 0, at
    while raw[end : end + 2] == b"\x1f\x8b" or (len(raw) > end + 2 and raw[end] & 15 == 8 and (raw[end] * 256 + raw[end + 1]) % 31 == 0):
        d, here, got = zlib.decompressobj(zlib.MAX_WBITS | 32), end, 0
        try:
            while not d.eof and here < len(raw):
                if size >= MAX_LAYER:
                    return b"".join(parts), len(raw), True
                part = raw[here : here + PIECE]
                out = d.decompress(part, MAX_LAYER - size)
                here += len(part)
                parts.append(out)
                size, got = size + len(out), got + len(out)
                if d.unconsumed_tail:
                    return b"".join(parts), len(raw), True
        except zlib.error:
            if got:
                end = here
            break
        if not got and not d.eof:
            break
        end = here - len(d.unused_data)
    return b"".join(parts), end, False


def _byte_layers(raw: bytes):
    """Texts in bytes: (text, first byte, byte after or None where each character has its own bytes, over the limit).

    Streams are unpacked until nothing is compressed, from any place on; bytes that are not text as a whole hold text in stretches.
    """
    todo, seen = [(raw, None)], set()
    while todo:
        now, place = todo.pop()
        mark = hashlib.sha256(now).digest()
        if mark in seen:
            continue
        seen.add(mark)
        whole = _text(now)
        for first, s in [(0, whole)] if whole is not None else ((m.start(), m[0].decode()) for m in STRETCH.finditer(now)):
            yield (s, first, None, False) if place is None else (s, *place, False)
        at = 0
        for start in (0, *(m.start() for m in PACKED.finditer(now))):
            if start < at:
                continue
            content, end, over = _unpack(now, start)
            if content or over:
                at, inside = max(end, at), place or (start, end)
                todo.append((content, inside))
                if over:
                    yield "", *inside, True


def _escapes(text: str):
    """Replacements of URL and Unicode escapes: (start, end, new text)."""
    found = []
    if "%" in text:
        for m in URL_BYTES.finditer(text):
            s = _text(bytes.fromhex(m[0].replace("%", "")))
            at = m.start()
            for c in s or "":
                size = 3 * len(c.encode())
                found.append((at, at + size, c))
                at += size
    if "\\" in text or "&#" in text:
        for m in ESCAPE.finditer(text):
            try:
                if m[1]:
                    c = chr(0x10000 + ((int(m[1], 16) & 0x3FF) << 10 | int(m[2], 16) & 0x3FF))
                else:
                    c = html.unescape(m[0]) if m[7] else chr(int(m[3] or m[4] or m[5] or m[6], 16))
            except (ValueError, OverflowError):
                continue
            if not 0xD800 <= ord(c[0]) < 0xE000:
                found.append((m.start(), m.end(), c))
    return sorted(found)


def _layers(text: str):
    """Layers directly inside a layer: (text, starts, ends, over the limit); starts and ends by character."""
    if found := _escapes(text):
        parts, starts, ends, at = [], [], [], 0
        for s, e, new in found:
            if s < at:
                continue
            parts += [text[at:s], new]
            starts += [*range(at, s), *([s] * len(new))]
            ends += [*range(at + 1, s + 1), *([e] * len(new))]
            at = e
        parts.append(text[at:])
        starts += range(at, len(text))
        ends += range(at + 1, len(text) + 1)
        yield "".join(parts), starts, ends, False
    for m in BASE64.finditer(text):
        body = m[0].rstrip("=").replace("-", "+").replace("_", "/")
        if body.isalpha() and (body.islower() or body.isupper()):
            continue
        for off in range(4):  # what is glued to the front moves the start
            part = body[off : len(body) - ((len(body) - off) % 4 == 1)]
            raw, origin = base64.b64decode(part + "=" * (-len(part) % 4)), m.start() + off
            for s, first, last, over in _byte_layers(raw):
                if last is not None:
                    lo, hi = origin + first // 3 * 4, min(m.end(), origin + (last + 2) // 3 * 4)
                    yield s, [lo] * len(s), [hi] * len(s), over
                    continue
                starts, ends, at = [], [], first
                for c in s:
                    n = len(c.encode())
                    starts.append(origin + at // 3 * 4)
                    ends.append(min(m.end(), origin + (at + n + 2) // 3 * 4))
                    at += n
                yield s, starts, ends, over


def find(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int, bool]:
    """(base spans, all spans, number of layers, over the limit); spans are (start, end, kind number), sorted."""
    text = text or ""
    base = sorted({(s, k, e) for s, e, k in scan(text)})
    every, over, layers = set(base), False, 1
    todo: deque = deque([(text, None, None)])
    seen = {hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()}
    while todo:
        layer, starts, ends = todo.popleft()
        for inner, s, e, big in _layers(layer):
            over |= big
            if starts is not None:
                s, e = [starts[i] for i in s], [ends[i - 1] for i in e]
            if not inner:
                continue
            mark = hashlib.sha256(f"{s[0]}:{e[-1]}:".encode() + inner.encode("utf-8", "surrogatepass")).digest()
            if mark in seen:
                continue
            seen.add(mark)
            layers += 1
            every |= {(s[a], k, e[b - 1]) for a, b, k in scan(inner)}
            todo.append((inner, s, e))
    order = lambda spans: [(s, e, k) for s, k, e in sorted(spans)]
    return order(base), order(every), layers, over


SPAN = "array<struct<kind:string,start:int,end:int>>"


def scan_secrets(docs: DataFrame, *, text: str = "text", name: str = "secrets") -> DataFrame:
    """Adds a struct: base spans, all spans, number of layers read, over_limit."""
    (out,) = fresh(docs, name)

    def work(s: pd.Series) -> pd.DataFrame:
        named = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for a, b, k in spans]
        rows = [(named(b), named(a), n, o) for b, a, n, o in map(find, s)]
        return pd.DataFrame(rows, columns=["base", "spans", "layers", "over_limit"])

    kind = f"base {SPAN}, spans {SPAN}, layers int, over_limit boolean"
    return docs.withColumn(out, F.pandas_udf(work, kind)(col(text)))


def redact(docs: DataFrame, *, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """The documents with every found span replaced."""

    def clean(s: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            parts, at = [], 0
            for a, b, _ in find(t)[1]:
                if a >= at:
                    parts += [t[at:a], mask]
                at = max(at, b)
            return "".join(parts) + t[at:]

        return s.map(one)

    return docs.withColumn(text, F.pandas_udf(clean, "string")(col(text)))


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "secrets.*")  # over_limit marks what was not unpacked whole
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"),
        "layers", "over_limit",
    )
