"""Secret scans: base patterns, then structural confirmation of encoded candidates.

Long base64 or hex runs, armoured blocks and dotted tokens are candidates only.  They are
decoded and reported when their inner structure holds: nested DER lengths of a private key that
fill the value exactly, an OpenSSH key container, or a signed-token header that is JSON with an
algorithm.  Each text is scanned whole; only the text column goes to Python.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, small_batches

# The base patterns, with the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a maximal run, as the run before it would have taken its start
# Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "pem", "der", "openssh", "jwt")
RANK = {k: i for i, k in enumerate(KINDS)}

PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,30}PRIVATE KEY)-----([A-Za-z0-9+/=\s\\]+?)-----END \1-----")
RUN = re.compile(r"[A-Za-z0-9+/_-]{48,}={0,2}")
# what follows a token's head; its signs are those of URL-safe base64
TAIL = re.compile(r"\.[A-Za-z0-9_-]{2,}+\.[A-Za-z0-9_-]*+")
SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
MAGIC = b"openssh-key-v1\x00"


def unbase64(s: str) -> bytes | None:
    """Bytes of standard or URL-safe base64, padded or not; None if it is neither."""
    s = s.rstrip("=").translate({45: "+", 95: "/"})
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of each value between start and end; None unless lengths fill it exactly."""
    out = []
    while start < end:
        if start + 2 > end:
            return None
        tag, size, start = data[start], data[start + 1], start + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or start + n > end:
                return None
            size, start = int.from_bytes(data[start : start + n], "big"), start + n
        if start + size > end:
            return None
        out.append((tag, start, start + size))
        start += size
    return out


def is_der_key(data: bytes) -> bool:
    """Whether data is one RSA, EC, PKCS#8 or encrypted PKCS#8 private key, all lengths nested exactly."""
    top = der_items(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    inner = der_items(data, *top[0][1:])
    if not inner:
        return False
    tags = [x[0] for x in inner]
    if tags[0] == 0x02 and inner[0][2] - inner[0][1] == 1:
        version = data[inner[0][1]]
        if version == 0 and len(tags) >= 9 and set(tags[:9]) == {0x02}:
            return True  # RSA
        if version == 1 and tags[1:2] == [0x04]:
            return True  # EC
        algorithm = der_items(data, *inner[1][1:]) if tags[1:3] == [0x30, 0x04] else None
        return version in (0, 1) and bool(algorithm) and algorithm[0][0] == 0x06  # PKCS#8
    algorithm = der_items(data, *inner[0][1:]) if tags == [0x30, 0x04] else None
    return bool(algorithm) and algorithm[0][0] == 0x06 and len(algorithm) == 2  # encrypted PKCS#8


def is_openssh_key(data: bytes) -> bool:
    """Whether data is an OpenSSH private-key container whose length-prefixed fields nest."""
    if not data.startswith(MAGIC):
        return False
    at, fields = len(MAGIC), []

    def field() -> bool:
        nonlocal at
        if at + 4 > len(data) or (n := int.from_bytes(data[at : at + 4], "big")) > len(data) - at - 4:
            return False
        fields.append(data[at + 4 : at + 4 + n])
        at += 4 + n
        return True

    if not (field() and field() and field()) or at + 4 > len(data):
        return False
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    return 1 <= keys <= 64 and all(field() for _ in range(keys + 1)) and fields[0].isascii() and len(data) - at < 64


def dotted(text: str) -> Iterator[tuple[int, int]]:
    """Spans of e[yw][signs]{8,}.[signs]{2,}.[signs]*, found from the dots, so that no run of signs is read again and again."""
    at = 0
    while tail := TAIL.search(text, at):
        dot = start = tail.start()
        while start > at and text[start - 1] in SIGNS:
            start -= 1
        heads = [i for i in (text.find("ey", start, dot - 8), text.find("ew", start, dot - 8)) if i >= 0] if dot - start >= 10 else []
        if heads:
            yield min(heads), tail.end()
        at = tail.end() if heads else dot + 1


def is_token(text: str) -> bool:
    """Whether text is a signed token: a JSON header that names an algorithm, then a JSON object or ciphertext."""
    head, body, _ = text.split(".", 2)
    try:
        header = json.loads(unbase64(head) or b"")
        if not isinstance(header, dict) or not isinstance(header.get("alg"), str):
            return False
        return "enc" in header or isinstance(json.loads(unbase64(body) or b""), dict)
    except (ValueError, RecursionError):
        return False


def confirmed(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans whose decoded structure is that of a secret."""
    blocks = []
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            data = unbase64(re.sub(r"\\[nr]|\s", "", m[2]))
            if data and (is_der_key(data) or is_openssh_key(data)):
                blocks.append(m.span())
                yield "pem", *m.span()
    for m in RUN.finditer(text):
        run = m[0]
        if any(a <= m.start() < b for a, b in blocks):
            continue
        lead = run[:2]
        data = unbase64(run) if lead[0] == "M" or run.startswith("b3BlbnNzaC1rZXkt") else None
        if data is None and lead == "30" and (digits := re.match(r"(?:[0-9a-fA-F]{2})+", run)) and digits.end() == len(run):
            data = bytes.fromhex(run)
        if data:
            if is_der_key(data):
                yield "der", *m.span()
            elif is_openssh_key(data):
                yield "openssh", *m.span()
    for start, end in dotted(text):
        if is_token(text[start:end]):
            yield "jwt", start, end


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], RANK[x[0]]))


def all_spans(text: str) -> list[tuple[str, int, int]]:
    return sorted({*base_spans(text), *confirmed(text)}, key=lambda x: (x[1], RANK[x[0]], x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """text with each stretch that spans cover replaced by mark."""
    out, done = [], 0
    for _, a, b in spans:
        if a >= done:
            out += [text[done:a], mark]
        done = max(done, b)
    return "".join([*out, text[done:]])


def secret_scan(docs: DataFrame, text_col: str = "text", redact: str | None = None) -> DataFrame:
    """All columns of docs plus secrets: struct(n_assign, n_access, n_hex, base_sha256, spans).

    With redact, spans in the text column are replaced by that string and secrets is left out.
    A null text counts as empty for the spans and stays null when redacting; offsets are code
    points, ends exclusive.  Repeated rows are scanned alike; an empty table gives an empty one;
    clashing names get a leading underscore.
    """
    small_batches(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    if redact is not None:

        @F.pandas_udf("string")
        def clean(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: t if t is None or not (s := all_spans(t)) else redacted(t, s, redact))

        return docs.select(*[clean(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            every = all_spans(t or "")
            base = [x for x in every if RANK[x[0]] < 3]
            n = [sum(x[0] == k for x in base) for k in KINDS[:3]]
            rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.withColumn(fresh(docs.columns, "secrets"), scan(text))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "secrets.*")
