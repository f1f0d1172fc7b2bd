"""Secret scans with structural confirmation.

Candidates by pattern are base64 or hex runs, key blocks and signed tokens; each is decoded and parsed before it is reported: DER by its
nested lengths down to the last byte, OpenSSH keys by their magic and length-prefixed fields, OpenPGP keys by their packets, encrypted blocks
by their headers and cipher blocks, signed tokens by the JSON of their header and payload. Base64 may be of either alphabet, wrapped by real or
escaped line breaks, quoted or commented, and hold a whole key block; a key inside it is found whatever stands before it, as its own
lengths tell where it ends. Three base kinds (assignments, access keys, hex runs) are reported as matched.

A null text is an empty text; texts of any length are scanned whole; each row stands for itself, so repeated rows get equal rows. Spans
are in code points, end exclusive. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices

#: Kinds in the order in which spans that start together are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "token", "key_block", "key_base64", "key_hex")

# The patterns of the base kinds.
ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
# Candidates of the other kinds.
#: A token begins at the first eyJ of an unbroken run; the run is read once, whether or not a dot follows.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?(?=eyJ))(eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+)")
BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----((?:(?!-----BEGIN ).)*?)-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----", re.S)
HEADER = re.compile(r"[ \t]*([A-Za-z][A-Za-z0-9-]*):[ \t]*(.*)")
#: Base64 of either alphabet, wrapped by real or escaped line breaks, quoted, commented or joined by plus signs.
RUN = re.compile(r"""(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+(?:(?:\\+(?=/)|(?:[ \t"',]|(?<=["'\s])\+(?=["'\s])){0,8}+(?:\\+[rn]|[\r\n])(?:\\+[rnt]|[\s"'>|,#*]|(?<=["'\s])\+(?=["'\s])){0,40}+)[A-Za-z0-9+/_-]++)*+={0,2}""")
PIECE = re.compile(r"""\\+(?:[rnt]|(?=/))|(?<=["'\s])\+(?=["'\s])|([A-Za-z0-9+/_-]+)""")
#: How the base64 of a DER sequence begins, and of an OpenSSH key.
START = re.compile(r"M[A-I]|b3BlbnNzaC1rZXktdjEA")
ANY_HEX = re.compile(r"[0-9A-Fa-f]{48,}")
HEX_START = re.compile("30(?=8[1-4]|[0-7])|6f70656e7373682d6b65792d763100")
SSH_MAGIC = b"openssh-key-v1\0"
#: A run of so many characters of these is there before any of the longer patterns is tried.
LEAST = 24
_CLASS = bytes(c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-" for c in range(256))
_STANDARD = str.maketrans("-_", "+/")


def unbase64(text: str, url: bool = False) -> bytes | None:
    body = text.rstrip("=")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), b"-_" if url else None, validate=True)
    except (ValueError, binascii.Error):
        return None


def der(data: bytes, at: int = 0, end: int | None = None, depth: int = 0) -> list[tuple[int, object]] | None:
    """(tag, content or children) of the values that fill data[at:end] exactly, or None if a length does not fit."""
    end, found = len(data) if end is None else end, []
    while at < end:
        if at + 2 > end or depth > 16:
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n >= 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > end or data[at] == 0 or (k == 1 and data[at] < 0x80):
                return None
            n, at = int.from_bytes(data[at : at + k], "big"), at + k
        if at + n > end or tag & 0x1F == 0x1F:
            return None
        if tag & 0x20:
            if (inner := der(data, at, at + n, depth + 1)) is None:
                return None
            found.append((tag, inner))
        else:
            found.append((tag, data[at : at + n]))
        at += n
    return found


def private_der(data: bytes) -> bool:
    """RSA, DSA and EC private keys, and PKCS #8 (encrypted or not)."""
    if len(data) < 24 or data[0] != 0x30 or not (top := der(data)) or len(top) != 1:
        return False
    fields = top[0][1]
    tags = [t for t, _ in fields]
    if tags[:1] == [2] and len(fields[0][1]) == 1 and fields[0][1][0] <= 1:
        rsa_or_dsa = tags in ([2] * 9, [2] * 6)
        return rsa_or_dsa or tags[:2] == [2, 4] or (tags[:3] == [2, 0x30, 4] and fields[1][1][:1] and fields[1][1][0][0] == 6)
    return tags == [0x30, 4] and bool(fields[0][1]) and fields[0][1][0][0] == 6


def private_ssh(data: bytes) -> bool:
    """An OpenSSH private key: magic, three strings, the number of keys, a public and a private part that fill it."""
    return ssh_size(lambda n: data[:n], len(data)) == len(data)


def ssh_size(first, room: int) -> int | None:
    """Bytes of the OpenSSH key whose first n bytes first(n) gives, if it fits the room."""
    at = len(SSH_MAGIC)
    if at > room or first(at) != SSH_MAGIC:
        return None
    for k in range(6):
        if at + 4 > room:
            return None
        n, at = int.from_bytes(first(at + 4)[at:], "big"), at + 4
        at += 0 if k == 3 else n
    return at if at <= room else None


def der_size(head: bytes) -> int | None:
    """Bytes of the sequence that begins so, if it may be a private key: a version or an algorithm comes first, and what follows fits."""
    if len(head) < 8 or head[0] != 0x30:
        return None
    k = head[1] & 0x7F if head[1] >= 0x80 else 0
    if k > 4 or len(head) < 2 + k + 4:
        return None
    at = 2 + k
    size = at + (int.from_bytes(head[2:at], "big") if k else head[1])
    inner = head[at:]
    if inner[:2] == b"\2\1" and inner[2] <= 1:
        at, inner = at + 3, inner[3:]
        if len(inner) > 6 and inner[1] >= 0x80 and (inner[1] & 0x7F) <= 4 and at + int.from_bytes(inner[2 : 2 + (inner[1] & 0x7F)], "big") > size:
            return None
        return size
    return size if inner[0] == 0x30 and 6 in inner[2:5] else None


def private_pgp(data: bytes) -> bool:
    """OpenPGP packets that fill the data, the first of them a secret key of a known version."""
    at, first = 0, True
    while at < len(data):
        tag, at = data[at], at + 1
        if tag & 0xC0 == 0xC0:
            kind, n = tag & 0x3F, data[at] if at < len(data) else 255
            if n < 192:
                at += 1
            elif n < 224:
                n, at = (n - 192 << 8) + (data[at + 1] if at + 1 < len(data) else 0) + 192, at + 2
            elif n == 255:
                n, at = int.from_bytes(data[at + 1 : at + 5], "big"), at + 5
            else:
                return False
        elif tag & 0xC0 == 0x80 and tag & 3 < 3:
            k = 1 << (tag & 3)
            kind, n, at = tag >> 2 & 0xF, int.from_bytes(data[at : at + k], "big"), at + k
        else:
            return False
        if at + n > len(data) or first and (kind != 5 or not n or not 3 <= data[at] <= 6):
            return False
        at, first = at + n, False
    return not first


def is_key(data: bytes | None) -> bool:
    return data is not None and (private_der(data) or private_ssh(data))


def compact(text: str) -> str:
    """Its base64 characters without what wraps, quotes or joins them, in the standard alphabet."""
    return "".join(m[1] for m in PIECE.finditer(text) if m[1]).translate(_STANDARD)


def is_block(body: str) -> bool:
    """Whether the text between a key block's lines is a key; line breaks may be escaped. An encrypted body, as RFC 1421 headers tell it, fills whole cipher blocks."""
    lines = re.sub(r"\\+[nrt]", "\n", body).strip().splitlines()
    found = [(i, m) for i, x in enumerate(lines) if (m := HEADER.fullmatch(x))]
    last = found[-1][0] if found else -1
    blank = next((i for i in range(last + 1, len(lines)) if not lines[i].strip()), last) if found else -1  # continued headers end at the blank line
    rest = lines[blank + 1 :]
    headers = {m[1].lower(): m[2].strip() for _, m in found}
    if headers.get("proc-type", "").upper().endswith("ENCRYPTED"):
        data, iv = unbase64(compact("\n".join(rest))), re.fullmatch(r"[A-Za-z0-9-]+,\s*((?:[0-9A-Fa-f]{16}){1,2})", headers.get("dek-info", ""))
        return bool(iv and data) and len(data) >= 24 and len(data) % (len(iv[1]) // 2) == 0
    if is_key(unbase64(compact("\n".join(rest)))):
        return True
    packets = unbase64(compact("\n".join(x for x in rest if not re.fullmatch(r"\s*=[A-Za-z0-9+/]{4}\s*", x))))
    return packets is not None and private_pgp(packets)


def blocks(data: bytes) -> Iterator[tuple[int, int]]:
    """Key blocks inside what was decoded."""
    if b"PRIVATE KEY" in data:
        for m in BLOCK.finditer(data.decode("latin-1")):
            if is_block(m[1]):
                yield m.span()


def keys_in(code: str, start: re.Pattern, first, per: tuple[int, int]) -> Iterator[tuple[int, int]]:
    """Spans of the keys inside encoded text, whatever stands before and behind them: their own lengths tell where they end.

    first(at, n) decodes n bytes from a character on; per characters stand for per bytes.
    """
    chars, octets = per
    length = lambda n: -(-n * chars // octets)
    at = 0
    while m := start.search(code, at):
        a, room = m.start(), (len(code) - m.start()) * octets // chars
        size = ssh_size(lambda n, a=a: first(a, n), room) if room >= len(SSH_MAGIC) and first(a, 3) == SSH_MAGIC[:3] else der_size(first(a, min(room, 32)))
        if size is not None and size <= room and is_key(first(a, size)):
            yield a, a + length(size)
            at = a + length(size)
        else:
            at = a + 1


def encoded_keys(text: str) -> Iterator[tuple[str, int, int]]:
    """key_base64 and key_hex: keys, or key blocks, encoded as base64 or hex, wrapped or not."""
    for run in RUN.finditer(text):
        pieces = [(m.start(1), m[1]) for m in PIECE.finditer(text, *run.span()) if m[1]]
        code, starts = "".join(p for _, p in pieces).translate(_STANDARD), list(accumulate((len(p) for _, p in pieces), initial=0))

        def place(i: int, pieces=pieces, starts=starts) -> int:
            k = bisect_right(starts, i) - 1
            return pieces[k][0] + i - starts[k]

        def first(a: int, n: int, code=code) -> bytes:
            part = code[a : a + -(-n // 3) * 4]
            return base64.b64decode(part[: len(part) - (len(part) % 4 == 1)] + "=" * (-len(part) % 4 % 3))[:n]

        found = list(keys_in(code, START, first, (4, 3)))
        if len(code) >= 100:
            for shift in range(4):
                found += [(shift + a * 4 // 3, shift + -(-z * 4 // 3)) for a, z in blocks(first(shift, (len(code) - shift) * 3 // 4))]
        for a, z in sorted(set(found)):
            end = place(z - 1) + 1
            while end < run.end() and text[end] == "=":
                end += 1
            yield "key_base64", place(a), end
    for run in ANY_HEX.finditer(text):
        code = run[0].lower()
        found = list(keys_in(code, HEX_START, lambda a, n, code=code: bytes.fromhex(code[a : a + 2 * n]), (2, 1)))
        for shift in (0, 1):
            found += [(shift + 2 * a, shift + 2 * z) for a, z in blocks(bytes.fromhex(code[shift : shift + (len(code) - shift) // 2 * 2]))]
        for a, z in sorted(found):
            yield "key_hex", run.start() + a, run.start() + z


def is_token(text: str) -> bool:
    """Whether the header names an algorithm, the payload is an object and the signature decodes."""
    try:
        head, body, sign = (unbase64(x, True) for x in text.split("."))
        header = json.loads(head or b"")
        return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(json.loads(body or b""), dict) and sign is not None and (bool(sign) or header["alg"] == "none")
    except (ValueError, RecursionError):
        return False


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed. What no pattern can match without is looked for first."""
    found, low = [], text.lower()
    if "pass" in low or "secret" in low or "token" in low or "key" in low:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("token", *m.span(1)) for m in TOKEN.finditer(text) if is_token(m[1])]
    whole = [m.span() for m in BLOCK.finditer(text) if is_block(m[1])] if "PRIVATE KEY" in text else []
    found += [("key_block", *span) for span in whole]
    if bytes([1]) * LEAST in text.encode(errors="surrogatepass").translate(_CLASS):
        found += [("hex", *m.span()) for m in HEX.finditer(text)]
        found += [x for x in encoded_keys(text) if not any(a <= x[1] and x[2] <= z for a, z in whole)]  # a block is reported once
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[str]:
    for x in batch.column(column):
        yield x.as_py() or ""


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and spans, an array of (kind, start, end)."""
    kind = docs.select(key).schema[0].dataType.simpleString()
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t)] for t in _texts(b, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, spans)], [key, "spans"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, spans array<struct<kind:string,start:long,end:long>>")


def masked(text: str, mark: str = "[{}]") -> str:
    """The text with every span replaced by its kind; overlapping spans make one, named by the first."""
    out, at = [], 0
    for kind, start, end in scan(text):
        if start >= at:
            out += [text[at:start], mark.format(kind)]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text", chars: str | None = "n_chars") -> DataFrame:
    """docs with the secrets in its texts masked, and the column of character counts brought up to date. Null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            i, columns = b.schema.get_field_index(text), list(b.columns)
            new = [None if (t := x.as_py()) is None else masked(t) for x in columns[i]]
            columns[i] = pa.array(new, b.schema.types[i])
            if chars in b.schema.names:
                j, old = b.schema.get_field_index(chars), columns[b.schema.get_field_index(chars)].to_pylist()
                columns[j] = pa.array([n if t is None else len(t) for t, n in zip(new, old, strict=True)], b.schema.types[j])
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def op8(spark, sf_dir: str) -> DataFrame:
    """The secrets of all documents: counts and digest of the base kinds, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for t in _texts(b, 1):
                spans = scan(t)
                base = [x for x in spans if x[0] in KINDS[:3]]
                rows.append((*(sum(x[0] == k for x in base) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
