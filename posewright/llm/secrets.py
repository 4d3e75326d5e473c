"""Secret scans with structural confirmation.

Base patterns find assignments, access keys and long hex runs. Beyond them, candidates that only look random are
decoded (base64, base64url, hex) and reported only if their structure holds: DER sequences whose nested lengths
add up, PEM and OpenSSH private keys (also encrypted as a whole, by their header lines), signed tokens whose header
names an algorithm and whose payload decodes. Base64 may be broken by white
space and by literal \\n, \\r and \\t escapes, as in JSON and .env files; a key ends where its own lengths say.

Edge cases: null and empty texts have no spans; texts of any length are scanned whole; spans count code points,
end exclusive; repeated rows give equal results; an empty table gives an empty result. A scan reads the id and text
columns alone and redaction changes the text column alone, so other columns may have any name.
Not decoded: base64 of fewer than LEAST_CHARS characters and hex of fewer than 64, as no private key is that short.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posewright.llm.common import read

KINDS = ("assign", "access", "hex", "pem", "ssh", "der", "token")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
PEM_BEGIN = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{12,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]+)")
# a DER sequence or the OpenSSH magic in base64, at the start of a run or behind a sign that may join it to a name
KEY_START = re.compile(r"M(?:(?<![A-Za-z0-9]M)|(?<=\\[nrt]M))[A-P]|b(?:(?<![A-Za-z0-9]b)|(?<=\\[nrt]b))3BlbnNzaC1rZXktdjE")
RUN = re.compile(r"[A-Za-z0-9+/_-]+")
BREAK = re.compile(r"(?:\s|\\+[nrt])+")
PADDING = re.compile(r"={0,2}")
LEAST_CHARS = 40
#: Values of one level of a key; real ones have 10 at most.
MOST_PARTS = 16
#: The lines ahead of a key that is encrypted as a whole: its cipher and initial block.
LOCKED = re.compile(r"(?:\s|\\+[nrt])*Proc-Type: *4,ENCRYPTED(?:\s|\\+[nrt])+DEK-Info: *[A-Z0-9-]+,[0-9A-Fa-f]{16,32}(?:\s|\\+[nrt])+")
ANY_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
LONG_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{32,}")
OPENSSH = b"openssh-key-v1\0"


def decoded(text: str) -> bytes:
    """Bytes of base64 or base64url text, its breaks and escapes left out; empty if it is none."""
    text = BREAK.sub("", text).replace("\\u003d", "=").replace("\\/", "/").rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def is_private_der(size: int, read: Window) -> bool:
    """One sequence that fills the data, begins with a small version number and holds key material."""
    top = read.der(0, size)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    parts = read.der(top[0][1], top[0][2])
    if not parts or len(parts) < 2:
        return False
    tag, a, b = parts[0]
    if tag == 0x02 and b - a == 1 and read(a, b)[0] <= 3:
        return any(t in (0x04, 0x02) and z - y >= 8 for t, y, z in parts[1:])
    return tag == 0x30 and len(parts) == 2 and parts[1][0] == 0x04 and read.der(a, b) is not None  # encrypted key


def in_bytes(data: bytes) -> Window:
    return Window(base64.b64encode(data).decode().rstrip("="), 0, -(-8 * len(data) // 6))


def key_bytes(head: bytes) -> int:
    """Length that a DER sequence which may be a private key gives itself; 0 if its first bytes are none."""
    if len(head) < 9 or head[0] != 0x30:
        return 0
    n = head[1] & 0x7F if head[1] >= 0x80 else 0
    if n > 4 or head[1] == 0x80:
        return 0
    inner = head[2 + n : 5 + n]
    if inner[0] != 0x30 and not (inner[:2] == b"\x02\x01" and inner[2] <= 3):
        return 0
    return 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])


class Chain:
    """Base64 from one place on over breaks, joined once, so that each key that may begin in it is told from a few bytes.

    Of a key only the lengths that it nests are decoded, wherever they lie; texts full of beginnings cost no more."""

    def __init__(self, text: str, at: int) -> None:
        self.begins, self.offsets, parts, have = [], [], [], 0
        while run := RUN.match(text, at):
            self.begins.append(at)
            self.offsets.append(have)
            parts.append(run[0])
            have, self.end = have + len(run[0]), run.end()
            gap = BREAK.match(text, self.end)
            if gap is None:
                break
            at = gap.end()
        self.chars = "".join(parts).replace("-", "+").replace("_", "/")

    def offset(self, at: int) -> int:
        """Number of base64 characters before a place of the text."""
        k = bisect_right(self.begins, at) - 1
        return self.offsets[k] + at - self.begins[k]

    def place(self, offset: int) -> int:
        """Where the text has had so many characters."""
        k = bisect_left(self.offsets, offset) - 1
        return self.begins[k] + offset - self.offsets[k]


class Window:
    """Bytes of base64 characters from `first` up to `last`, decoded where they are asked for."""

    def __init__(self, chars: str, first: int, last: int) -> None:
        self.chars, self.first, self.size = chars, first, (last - first) * 6 // 8

    def __call__(self, a: int, z: int) -> bytes:
        low, high = self.first + a // 3 * 4, self.first + -(-z // 3) * 4
        part = self.chars[low:high]
        return base64.b64decode(part + "A" * (-len(part) % 4))[a % 3 : a % 3 + z - a]

    def number(self, at: int) -> int:
        return int.from_bytes(self(at, at + 4), "big")

    def openssh(self) -> tuple[bool, int]:
        """Whether the data begins as an OpenSSH key, and the key's length by its own lengths, 0 if the data ends before."""
        at = len(OPENSSH)
        if self(0, at) != OPENSSH:
            return False, 0
        for _ in range(3):  # cipher, key derivation, options
            if at + 4 > self.size or at + 4 + self.number(at) > self.size:
                return False, 0
            at += 4 + self.number(at)
        if at + 4 > self.size or not 1 <= (keys := self.number(at)) <= 16:
            return False, 0
        at += 4
        for _ in range(keys + 1):
            if at + 4 > self.size:
                return True, 0
            at += 4 + self.number(at)
        return True, at if at <= self.size else 0

    def der(self, at: int, end: int) -> list[tuple[int, int, int]] | None:
        """(tag, start, end) of the values between two places; None unless their lengths fill it exactly, and where there are
        over MOST_PARTS of them."""
        out = []
        while at < end:
            if at + 2 > end or len(out) == MOST_PARTS:
                return None
            tag, length = self(at, at + 2)
            at += 2
            if length >= 0x80:
                n = length & 0x7F
                if not 1 <= n <= 4 or at + n > end:
                    return None
                length, at = int.from_bytes(self(at, at + n), "big"), at + n
            if at + length > end:
                return None
            out.append((tag, at, at + length))
            at += length
        return out


def taken(text: str, at: int, n: int) -> str:
    """The next n base64 characters from `at` over breaks."""
    parts, have = [], 0
    while have < n and (run := RUN.match(text, at, at + n - have)):
        parts.append(run[0])
        have += len(run[0])
        gap = BREAK.match(text, run.end())
        if gap is None:
            break
        at = gap.end()
    return "".join(parts)


def key_at(text: str, at: int, chain: Chain | None) -> tuple[Chain | None, tuple[int, int] | None]:
    """(kind number, end) of the private key in base64 that begins there. chain: that of an earlier beginning."""
    ssh = text[at] == "b"
    n = 0 if ssh else key_bytes(decoded(taken(text, at, 12)))
    if not ssh and not LEAST_CHARS <= -(-8 * n // 6) <= len(text) - at:
        return chain, None
    if chain is None or at >= chain.end:
        chain = Chain(text, at)
    first = chain.offset(at)
    if ssh:
        n = Window(chain.chars, first, len(chain.chars)).openssh()[1]
        if not n:
            own = RUN.match(text, at).end()
            if not Window(chain.chars, first, first + own - at).openssh()[0]:
                return chain, None
            return chain, (4, PADDING.match(text, own).end())
    last = first + -(-8 * n // 6)
    if last > len(chain.chars) or not ssh and not is_private_der(n, Window(chain.chars, first, last)):
        return chain, None
    return chain, (4 if ssh else 5, PADDING.match(text, chain.place(last)).end())


def pem_blocks(text: str) -> Iterator[tuple[int, str, int]]:
    """(start, body, end) of the armoured private keys."""
    for m in PEM_BEGIN.finditer(text):
        stop, tail = text.find("-----", m.end()), f"-----END {m[1]}-----"
        if stop >= 0 and text.startswith(tail, stop):
            yield m.start(), text[m.end() : stop], stop + len(tail)


def part_of_token(text: str) -> bytes | None:
    try:
        return base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))
    except (binascii.Error, ValueError):
        return None


def is_token(header: str, payload: str) -> bool:
    """A header that names an algorithm, and a payload that decodes, to an object of claims where the type says so."""
    head, body = part_of_token(header), part_of_token(payload)
    if not head or body is None:
        return False
    try:
        head = json.loads(head)
        if not isinstance(head, dict) or not isinstance(head.get("alg"), str):
            return False
        return str(head.get("typ")).lower() != "jwt" or isinstance(json.loads(body), dict)
    except (ValueError, RecursionError):  # a header of thousands of open brackets is none
        return False


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns."""
    out, low = [], text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of candidates whose decoded structure holds."""
    out = []
    if "-----BEGIN " in text:
        for start, body, end in pem_blocks(text):
            locked = LOCKED.match(body)
            data = decoded(body[locked.end() :] if locked else body)
            if locked:
                if len(data) >= 16 and len(data) % 8 == 0:  # whole blocks of the cipher
                    out.append((start, 3, end))
            elif data and in_bytes(data).openssh()[0]:
                out.append((start, 4, end))
            elif data and is_private_der(len(data), in_bytes(data)):
                out.append((start, 3, end))
    begins, ends = [a for a, _, _ in out], [z for _, _, z in out]  # in order, without overlaps
    inside = lambda at: (k := bisect_right(begins, at)) > 0 and at < ends[k - 1]
    past, chain = 0, None
    for m in KEY_START.finditer(text):
        start = m.start()
        if start < past or inside(start):
            continue
        chain, found = key_at(text, start, chain)
        if found:
            kind, past = found
            out.append((start, kind, past))
    for run in LONG_RUN.finditer(text):
        if inside(run.start()):
            continue
        part, at = run[0], run.start()
        if part.count(".") >= 2:
            out += [(at + m.start(), 6, at + m.end()) for m in TOKEN.finditer(part) if is_token(m[1], m[2])]
        for m in ANY_HEX.finditer(part):
            data = bytes.fromhex(m[0])
            if is_private_der(len(data), in_bytes(data)):
                out.append((at + m.start(), 5, at + m.end()))
    return sorted(set(out))


def line(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, base spans and all spans as kind:start:end joined by commas, and counts by base kind."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(5)]
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                both = sorted({*base, *confirmed_spans(text)})
                for column, value in zip(rows, (sum(k == 0 for _, k, _ in base), sum(k == 1 for _, k, _ in base), sum(k == 2 for _, k, _ in base), line(base), line(both))):
                    column.append(value)
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(rows, types))], names=[id_col, "n_assign", "n_access", "n_hex", "base_spans", "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_spans string, spans string")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with every span's text replaced by [secret]; overlapping spans are replaced once. Null texts stay null."""
    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for a, _, z in sorted({*base_spans(text), *confirmed_spans(text)}):
            if z <= at:
                continue
            out.append(text[at : max(a, at)])
            if a >= at:
                out.append("[secret]")
            at = z
        return "".join(out) + text[at:] if at else text

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return texts.map(clean, na_action="ignore")

    return docs.withColumn(text_col, cleaned(F.col(text_col)))


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")
