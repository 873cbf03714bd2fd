"""Secret scans: an Aho-Corasick pass finds keywords, anchored patterns run only at its hits, checksums are verified.

Keywords of all keyed kinds go into one automaton. Each hit is the only place where a pattern of that kind can
begin, so patterns are anchored there and the text between hits is never given to one. Runs of hex digits have no
keyword; a table lookup over the text's bytes finds runs long enough. Tokens that embed a checksum (the last six
base-62 digits are the CRC-32 of what precedes) count only if it is right; web tokens count only if their header
decodes to JSON with an algorithm; key blocks count only with both border lines.

Spans are (kind, start, end) in code points, end exclusive, ordered by start, then kind as in KINDS.
Defined results: a null text counts as empty and gives no span; a null id is kept; equal rows get equal results; a
text of any length is scanned whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from bisect import bisect_left

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "forge", "registry", "webtoken", "keyblock")
#: Keywords by kind; those of assign are in lower case and match in either case.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("AKIA",),
    "forge": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "registry": ("npm_",),
    "webtoken": ("eyJ",),
    "keyblock": ("-----BEGIN ",),
}
PATTERNS = {
    "assign": re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "forge": re.compile(rb"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"),
    "registry": re.compile(rb"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"),
    "webtoken": re.compile(rb"(eyJ[0-9A-Za-z_-]+)\.(eyJ[0-9A-Za-z_-]+)\.[0-9A-Za-z_-]*"),
}
#: A key block: both border lines, with the same label, and between them these characters only.
BEGIN, END = re.compile(rb"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----"), re.compile(rb"-----END ([A-Z0-9 ]*PRIVATE KEY)-----")
INSIDE, TOKEN_RUN = re.compile(rb"[0-9A-Za-z+/=:,\s-]*"), re.compile(rb"[0-9A-Za-z_-]*")
_DIGITS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 12, 18, 16


def automaton() -> ahocorasick.Automaton:
    """Over text with A-Z in lower case; a hit gives (kind, length). Kinds that mind the case check it by their pattern."""
    made = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            made.add_word(word.lower(), (kind, len(word)))
    made.make_automaton()
    return made


def checksum(body: bytes) -> bytes:
    """Six base-62 digits of the CRC-32."""
    n, out = zlib.crc32(body), b""
    for _ in range(6):
        n, rest = divmod(n, 62)
        out = _DIGITS[rest : rest + 1] + out
    return out


def valid(kind: str, found: re.Match) -> bool:
    if kind == "assign":
        return len(found[2]) >= LEAST_VALUE
    if kind == "access":
        return len(found[0]) >= LEAST_ACCESS
    if kind in ("forge", "registry"):
        return checksum(found[1]) == found[2]
    if kind == "webtoken":
        try:
            return "alg" in json.loads(base64.urlsafe_b64decode(found[1] + b"=" * (-len(found[1]) % 4)))
        except (ValueError, TypeError):
            return False
    return True


def hex_runs(data: bytes) -> list[tuple[int, int]]:
    if len(data) < LEAST_HEX:
        return []
    inside = np.concatenate(([0], _HEX[np.frombuffer(data, np.uint8)].view(np.int8), [0]))
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= LEAST_HEX
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


class KeyBlocks:
    """Key blocks of a text. Closing lines are listed once and a run of allowed characters is measured once, so texts with
    many opening lines take no longer."""

    def __init__(self, data: bytes):
        self.data, self.run_end = data, -1
        self.closing: dict[bytes, tuple[list[int], list[int]]] = {}
        for found in END.finditer(data):
            starts, ends = self.closing.setdefault(found[1], ([], []))
            starts.append(found.start())
            ends.append(found.end())

    def match(self, at: int) -> int | None:
        """The end of the block that begins at a place; places must not fall."""
        head = BEGIN.match(self.data, at)
        if not head or head[1] not in self.closing:
            return None
        if head.end() > self.run_end:
            self.run_end = INSIDE.match(self.data, head.end()).end()
        starts, ends = self.closing[head[1]]
        k = bisect_left(starts, head.end())
        return ends[k] if k < len(starts) and starts[k] <= self.run_end else None


def scan(data: bytes, keywords: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind), in code points, in order. In time linear in the text, whatever it holds: a failed web token
    rules out all others that begin in its run of characters, as they would fail at the same place."""
    spans = [(a, b, "hex") for a, b in hex_runs(data)]
    free, blocks = dict.fromkeys(KEYWORDS, 0), None
    hits = sorted((end - length + 1, kind) for end, (kind, length) in keywords.iter(data.lower().decode("latin-1")))
    for at, kind in hits:
        if at < free[kind]:
            continue
        if kind == "keyblock":
            blocks = blocks or KeyBlocks(data)
            if (end := blocks.match(at)) is not None:
                free[kind] = end
                spans.append((at, end, kind))
        elif found := PATTERNS[kind].match(data, at):
            free[kind] = found.end()
            if valid(kind, found):
                spans.append((at, found.end(), kind))
        elif kind == "webtoken" and data.startswith(b"eyJ", at):
            free[kind] = TOKEN_RUN.match(data, at).end()
    if spans and not data.isascii():
        lead = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
        spans = [(int(lead[a]), int(lead[b]), kind) for a, b, kind in spans]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array of (start, end, kind), base_sha256): one row per row of docs."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches):
        keywords = automaton()
        for batch in batches:
            found = [scan(x.as_py() or b"", keywords) for x in batch.column(1).cast(pa.binary())]
            base = [hashlib.sha256(joined([s for s in spans if s[2] in BASE]).encode()).hexdigest() for spans in found]
            rows = [[{"start": a, "end": b, "kind": k} for a, b, k in spans] for spans in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind), pa.array(base, pa.string())], ["id", "spans", "base_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, spans array<struct<start: bigint, end: bigint, kind: string>>, base_sha256 string")


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """docs with each stretch that spans cover replaced by mask; all columns kept."""
    schema = docs.schema

    def run(batches):
        keywords = automaton()
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = []
            for x in batch.column(at).to_pylist():
                out, done = [], 0
                for a, b, _ in scan((x or "").encode(), keywords):
                    if b > done:
                        out += [x[done : max(a, done)], mask] if a >= done else []
                        done = b
                texts.append(x if x is None else "".join(out) + x[done:])
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, schema)
