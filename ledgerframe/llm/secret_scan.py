"""Secret scan by structural confirmation.

Text patterns propose spans; candidates in base64, base64url or hex are decoded, and only those whose bytes
parse as a key encoding (DER sequences whose nested lengths fill the blob exactly, OpenSSH key containers) or
whose header is that of a signed token are reported besides the base patterns.

Defined results: a null text counts as empty and has no spans; ids may be null or repeat, each row is scanned
by itself; an empty table gives an empty result; columns besides doc_id and text are not read.  Texts are
scanned whole whatever their length, in time that grows with it: no pattern goes back over what it has read.  A candidate that decodes to text is searched once more inside, so a
key wrapped twice is found; the span is that of the outer candidate.  Line breaks may be escaped (JSON, string
literals); base64 without armour is joined over lines of one width and a shorter last one.  A token begins with a
dotted part and has three parts, or five if its header names an encryption; what follows after a dot is not its.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, slices

#: Kinds in the order that breaks ties between spans of one start.
KINDS = ("assign", "access", "hex", "pem", "token", "key")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so these are the runs of 24 and more
_PEM = re.compile(r"""-----BEGIN ([A-Z0-9 ]{0,40})PRIVATE KEY-----((?:[A-Za-z0-9+/=\s:,\\"']++|-(?!----))*+)-----END \1PRIVATE KEY-----""")
_DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]*+){2,}+")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
_BREAK = r"(?:(?:\\++[nrt])++|\r?\n[\x20\t]*+)"
_WRAPPED = re.compile(r"(?:(?<=\\[nrt])|(?<![A-Za-z0-9+/_\\-]))[A-Za-z0-9+/_-]{40,}+(?:" + _BREAK + r"[A-Za-z0-9+/_-]++)++={0,2}")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
_HEX_KEY = re.compile(r"(?:[0-9A-Fa-f]{2}){24,}")

#: Texts without any of these can't hold a span; RE2 runs it on whole Arrow columns.
_HINT = r"(?i:passw|secret|token|api_?key)|AKIA|[0-9a-f]{24}|PRIVATE KEY-----|[A-Za-z0-9_-]{8}\.[A-Za-z0-9_-]{2,}\.|[A-Za-z0-9_-]{8}\.\.[A-Za-z0-9_-]|[A-Za-z0-9+/_-]{40}|[0-9A-Fa-f]{48}"


def _der_sequence(blob: bytes, at: int, end: int) -> tuple[int, int] | None:
    """Content bounds of the DER SEQUENCE at `at`, if its length fits in `end`."""
    if at + 2 > end or blob[at] != 0x30:
        return None
    return _der_length(blob, at + 1, end)


def _der_length(blob: bytes, at: int, end: int) -> tuple[int, int] | None:
    if at >= end:
        return None
    n, at = blob[at], at + 1
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end:
            return None
        n, at = int.from_bytes(blob[at : at + k], "big"), at + k
    return (at, at + n) if at + n <= end else None


def der_items(blob: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, begin, end) of the values that fill blob[at:end] exactly, or None."""
    found = []
    while at < end:
        tag = blob[at]
        bounds = _der_length(blob, at + 1, end)
        if bounds is None:
            return None
        found.append((tag, *bounds))
        at = bounds[1]
    return found if at == end else None


def key_kind(blob: bytes) -> str | None:
    """What kind of private or public key the bytes encode, confirmed by structure."""
    if blob.startswith(b"openssh-key-v1\0"):
        at, fields = 15, 0
        while at + 4 <= len(blob) and fields < 3:
            n = int.from_bytes(blob[at : at + 4], "big")
            if at + 4 + n > len(blob):
                return None
            at, fields = at + 4 + n, fields + 1
        return "openssh" if fields == 3 else None
    outer = _der_sequence(blob, 0, len(blob))
    if outer is None or outer[1] != len(blob):
        return None
    items = der_items(blob, *outer)
    if not items:
        return None
    tags = [t for t, _, _ in items]
    whole = lambda i: int.from_bytes(blob[items[i][1] : items[i][2]], "big")
    if len(tags) >= 9 and all(t == 2 for t in tags[:9]) and whole(0) in (0, 1):
        return "rsa"
    if len(tags) in (5, 6) and all(t == 2 for t in tags) and whole(0) == 0:
        return "dsa"
    if tags[:2] == [2, 4] and whole(0) == 1 and set(tags[2:]) <= {0xA0, 0xA1}:
        return "ec"
    if tags[:3] == [2, 0x30, 4] and whole(0) in (0, 1):
        inner = der_items(blob, items[1][1], items[1][2])
        return "pkcs8" if inner and inner[0][0] == 6 else None
    if tags == [0x30, 4]:
        inner = der_items(blob, items[0][1], items[0][2])
        return "encrypted" if inner and inner[0][0] == 6 else None
    return None


def decoded(run: str) -> bytes | None:
    """The bytes of a base64 or base64url run whose padding may be left out."""
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(run) % 4 == 1:
        return None
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def token_header(part: str) -> dict | None:
    """The JSON header of a signed or encrypted token, if the part is one."""
    blob = decoded(part)
    if not blob or blob[:1] != b"{":
        return None
    try:
        head = json.loads(blob)
    except (ValueError, RecursionError):
        return None
    return head if isinstance(head, dict) and isinstance(head.get("alg"), str) else None


def tokens(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of signed tokens (three parts) and encrypted ones (five, of which the key may be empty)."""
    for m in _DOTTED.finditer(text):
        parts, at, i = m[0].split("."), m.start(), 0
        if _after_escape(text, at):
            parts[0], at = parts[0][1:], at + 1
        while i + 2 < len(parts):
            n, head = 0, token_header(parts[i]) if len(parts[i]) >= 8 else None
            if head is not None:
                if isinstance(head.get("enc"), str) and len(parts) - i >= 5 and all(parts[i + 2 : i + 5]):
                    n = 5
                elif len(parts[i + 1]) >= 2:
                    n = 3
            size = sum(map(len, parts[i : i + max(n, 1)])) + max(n, 1) - 1
            if n:
                yield at, at + size
            at, i = at + size + 1, i + max(n, 1)


def _after_escape(text: str, at: int) -> bool:
    """Whether the character is the letter of an escaped line break or tab."""
    return at > 0 and text[at - 1] == "\\" and text[at] in "nrt"


def pem_body(body: str) -> str:
    """The base64 text of a PEM body, whose line breaks may be escaped, in one string literal or one for each line."""
    body = re.sub(r"(?<!\\)\\++(?:[nrt]|u000[aAdD9])", "\n", body)
    body = re.sub(r"(?<!\\)\\++(?=\s|/)", "", body)
    body = re.sub(r"""(?<!\\)\\*+["']\s*+(?:\+\s*+)?\\*+["']""", "\n", body)
    return re.sub(r"\s+", "", "".join(x for x in body.strip("\"'\\+ \t\r\n").splitlines() if ":" not in x))


def wrapped(text: str) -> Iterator[list[tuple[int, int]]]:
    """For each stretch of base64 lines of one width, the (start, end) in which it may be a value: with the shorter
    line after it, and without."""
    for m in _WRAPPED.finditer(text):
        lines, at = [], m.start()
        for part in re.split(f"({_BREAK})", m[0]):
            if _LINE.fullmatch(part):
                lines.append((at, at + len(part)))
            at += len(part)
        width, i = [b - a for a, b in lines], 0
        while i < len(lines):
            j = i
            while j + 1 < len(lines) and width[j + 1] == width[i]:
                j += 1
            ends = [k for k in (j + 1, j) if i < k < len(lines) and width[k] <= width[i]]
            if width[i] >= 40 and ends:
                yield [(lines[i][0], lines[k][1]) for k in ends]
            i = j + 1


def _inside(blob: bytes, depth: int) -> bool:
    """Whether the bytes are a key, or text that holds a confirmed secret."""
    if key_kind(blob):
        return True
    if depth and len(blob) >= 24:
        try:
            text = blob.decode("ascii")
        except UnicodeDecodeError:
            return False
        return any(True for _ in confirmed(text, depth - 1))
    return False


def confirmed(text: str, depth: int = 1) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of candidates that their structure confirms."""
    taken = []
    for m in _PEM.finditer(text):
        blob = decoded(pem_body(m[2]))
        if blob and (key_kind(blob) or "ENCRYPTED" in m[2]):
            taken.append(m.span())
            yield *m.span(), "pem"
    for a, b in tokens(text):
        yield a, b, "token"

    def free(at: int) -> bool:
        """Whether no span taken so far holds the place; spans are in order and apart."""
        i = bisect_right(taken, (at, len(text) + 1)) - 1
        return i < 0 or at >= taken[i][1]

    for spans in wrapped(text):
        for a, b in spans:
            blob = decoded(re.sub(_BREAK, "", text[a:b])) if free(a) else None
            if blob and _inside(blob, depth):
                insort(taken, (a, b))
                yield a, b, "key"
                break
    for pattern, read in ((_BASE64, decoded), (_HEX_KEY, bytes.fromhex)):
        for m in pattern.finditer(text):
            if not free(m.start()):
                continue
            for at in (m.start(), m.start() + 1) if read is decoded and _after_escape(text, m.start()) else (m.start(),):
                blob = read(text[at : m.end()])
                if blob and _inside(blob, depth):
                    yield at, m.end(), "key"
                    break


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(*m.span(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return found


def spans_of(text: str) -> list[tuple[int, int, str]]:
    """All spans (code points, end exclusive), by start and then kind."""
    found = set(base_spans(text)) | set(confirmed(text))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and `spans`, an array of (kind, start, end), for every row of `docs`; nothing is shuffled."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                text = pc.fill_null(batch.column("text"), "")
                hint = pc.match_substring_regex(text, _HINT).to_pylist()
                rows = [[{"kind": k, "start": a, "end": b} for a, b, k in spans_of(text[i].as_py())] if h else [] for i, h in enumerate(hint)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(_SPAN))], ["doc_id", "spans"])

    return columns(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>")


def secret_digest(docs: DataFrame) -> DataFrame:
    """The scan as counts and digests per row."""
    spans = scan_secrets(docs)
    is_base = lambda s: s["kind"].isin("assign", "access", "hex")
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", is_base)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return spans.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """`docs` with every span replaced by `mark` (overlapping spans by one); other rows stay as they are.
    n_chars, where there is such a column, follows the text."""
    schema = docs.schema
    has_size = "n_chars" in docs.columns

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                text = pc.fill_null(batch.column("text"), "")
                hint = pc.match_substring_regex(text, _HINT).to_pylist()
                new, size = {}, {}
                for i, h in enumerate(hint):
                    if h and (spans := spans_of(old := text[i].as_py())):
                        out, at = [], 0
                        for a, b, _ in spans:
                            if a >= at:
                                out += [old[at:a], mark]
                            at = max(at, b)
                        new[i] = "".join([*out, old[at:]])
                        size[i] = len(new[i])
                if new:
                    at = batch.schema.get_field_index("text")
                    texts = batch.column("text").to_pylist()
                    for i, x in new.items():
                        texts[i] = x
                    batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
                    if has_size:
                        at = batch.schema.get_field_index("n_chars")
                        sizes = batch.column("n_chars").to_pylist()
                        for i, x in size.items():
                            sizes[i] = x
                        batch = batch.set_column(at, batch.schema.field(at), pa.array(sizes, batch.schema.field(at).type))
                yield batch

    return docs.mapInArrow(run, schema)
