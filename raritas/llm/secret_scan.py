"""Secret scans: known shapes by pattern, unknown ones by sliding-window entropy per character class.

Base kinds, leftmost and non-overlapping for each: ``assign`` (a named value), ``access`` (access key ids), ``hex``.
A base span is the whole match.

Method: a candidate is a maximal run of at least ``window`` token characters (A-Z a-z 0-9 + / _ = -). Its class is the
smallest of hex (0-9a-f or 0-9A-F), alnum and base64 that holds all its characters. A window slides over it; counts per
character are updated by the character that enters and the one that leaves, and with them the entropy in bits. Windows
at or above the class threshold that mix letters and digits are joined to spans (kinds ``entropy_hex``,
``entropy_alnum``, ``entropy_base64``). A candidate on the allow list is suppressed, and so is a span that lies within a
base span; base spans never are.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (used as pa.compute)
from pyspark.sql import DataFrame

from raritas.functions.runtime import ship_package
from raritas.llm.common import keyed_text, slices

ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]+")
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_alnum", "entropy_base64")
WINDOW = 20
THRESHOLDS = {"hex": 3.0, "alnum": 3.7, "base64": 3.9}
# Shapes that look random and are no secrets: UUIDs, counters and dates, data and file paths, placeholders.
ALLOWED = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"[0-9_+/=-]+",
    r"(?:/?[A-Za-z_-]+/)+[A-Za-z_-]*",
    r".*(?:EXAMPLE|example|placeholder|xxxx|XXXX).*",
)
Span = tuple[int, int, str]


def probe(window: int) -> str:
    """A pattern found in every text that holds anything at all; one pass of an automaton without back-tracking."""
    base = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]|AKIA[A-Z0-9]{14}|[0-9a-f]{16}"
    # The automaton counts to 1000 at most; longer runs are a matter of the exact scan.
    return base + rf"|[A-Za-z0-9+/_=-]{{{min(window, 1000)}}}"


def base_spans(text: str) -> list[Span]:
    """Spans (start, end, kind) of the base kinds, in code points."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def char_class(run: str) -> str:
    if re.fullmatch(r"[0-9a-f]*|[0-9A-F]*", run):
        return "hex"
    return "alnum" if run.isalnum() else "base64"


def entropy_windows(run: str, window: int) -> Iterator[tuple[int, float, bool]]:
    """Start, entropy in bits, and whether letters and digits are mixed, for each window; counts kept incrementally."""
    term = [0.0] + [c / window * math.log2(c / window) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total, digits, letters = 0.0, 0, 0

    for end, char in enumerate(run):
        n = counts.get(char, 0)
        counts[char] = n + 1
        total += term[n + 1] - term[n]
        digits += char.isdigit()
        letters += char.isalpha()
        if end >= window:
            gone = run[end - window]
            n = counts[gone]
            counts[gone] = n - 1
            total += term[n - 1] - term[n]
            digits -= gone.isdigit()
            letters -= gone.isalpha()
        if end >= window - 1:
            yield end - window + 1, -total, digits > 0 and letters > 0


def entropy_spans(text: str, window: int, thresholds: dict[str, float], allowed: re.Pattern) -> list[Span]:
    found: list[Span] = []
    for match in CANDIDATE.finditer(text):
        run = match.group()
        if len(run) < window or allowed.fullmatch(run):
            continue
        kind = char_class(run)
        first = last = None
        for start, bits, mixed in entropy_windows(run, window):
            if not mixed or bits < thresholds[kind] - 1e-9:
                continue
            if first is not None and start > last:
                found.append((match.start() + first, match.start() + last, f"entropy_{kind}"))
                first = None
            first = start if first is None else first
            last = start + window
        if first is not None:
            found.append((match.start() + first, match.start() + last, f"entropy_{kind}"))
    return found


def beyond(spans: list[Span], base: list[Span]) -> list[Span]:
    """Spans that do not lie within a base span."""
    starts, ends = sorted(s[0] for s in base), sorted((s[0], s[1]) for s in base)
    reach = list(accumulate((end for _, end in ends), max))  # the farthest end of all spans that begin so far

    def covered(span: Span) -> bool:
        before = bisect_right(starts, span[0])
        return before > 0 and reach[before - 1] >= span[1]

    return [s for s in spans if not covered(s)]


def joined(spans: list[Span]) -> str:
    ordered = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in ordered)


def scan_secrets(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    thresholds: dict[str, float] | None = None,
    allowed: tuple[str, ...] = ALLOWED,
) -> DataFrame:
    """Return key, n_assign, n_access, n_hex, base_sha256, spans, n_entropy for every row; row-wise, nothing is shuffled.

    Null and empty texts have no spans (empty string, its digest). Repeated rows and null keys are kept as they are, an empty
    table gives an empty result, and other columns are not read. Very long texts are slices of their own and scanned whole.
    """
    ship_package(docs.sparkSession)
    limits = {**THRESHOLDS, **(thresholds or {})}
    given = keyed_text(docs, key, text)
    schema = given.drop("text").schema
    for name, kind in (("n_assign", "long"), ("n_access", "long"), ("n_hex", "long"), ("base_sha256", "string"), ("spans", "string"), ("n_entropy", "long")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allow = re.compile("|".join(f"(?:{a})" for a in allowed) if allowed else r"(?!)")
        nothing, pattern = hashlib.sha256(b"").hexdigest(), probe(window)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text")
                rows = [(0, 0, 0, nothing, "", 0)] * part.num_rows
                hits = pa.compute.match_substring_regex(texts, pattern)
                for i in pa.compute.indices_nonzero(hits).to_pylist():
                    whole = texts[i].as_py()
                    base = base_spans(whole)
                    found = base + beyond(entropy_spans(whole, window, limits, allow), base)
                    counts = [sum(kind == k for _, _, kind in base) for k in KINDS[:3]]
                    rows[i] = (*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(found), len(found) - len(base))
                columns = [pa.array(list(c), schema_field) for c, schema_field in zip(zip(*rows, strict=True), (pa.int64(),) * 3 + (pa.string(),) * 2 + (pa.int64(),), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("key"), *columns], names=schema.names)

    return given.mapInArrow(run, schema).withColumnRenamed("key", key)


def query(spark, folder: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{folder}/documents.parquet"))
