"""Secret scan: fixed patterns, and a randomness test battery for what no pattern names.

Fixed patterns give kinds ``assign``, ``access`` and ``hex``.  The battery adds kind ``random``: runs of 20 or more
token characters, with letters and others, are cut at every ``=`` that is not trailing padding (names and parameters before values).
A part that no pattern span touches is read in the narrowest encoding that holds
it (hex, base32, base36, base62, base64); where none does, as for a value joined to a path or a name, its longest pieces between ``/``, ``-``,
``_`` and ``+`` are read: all ways to keep the two of base64 or of base64url together, and each piece on its own, and
of those that pass the one with most evidence, paid for by their number, stands for the part.  Three tests ask whether the symbols look uniformly random in that encoding: chi-squared over eight equal
parts of the alphabet, runs above and below the alphabet's middle, and lag-one serial correlation (Bonferroni over
the three).  A token that passes has the likelihood ratio of "uniform in its encoding" against "ordinary text"
(character classes with the shares of words, paths and hyphenated names) as evidence; it grows with the token's length, and its mean under
"ordinary text" is at most one.  The e-value Benjamini-Hochberg rule over the tokens of a document keeps the share
of false discoveries at ``fdr`` or less, whatever the dependence between tokens.

Edge cases: null text is empty; empty texts give no spans; offsets are code points of the whole text, ends
exclusive; repeated documents give repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_steps

KINDS = ("assign", "access", "hex", "random")
FDR, TEST_LEVEL, LEAST_TOKEN = 1e-4, 1e-3, 20
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # the maximal runs of 16 or more; shorter ones would be dropped
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_TOKEN)
_PART = re.compile(r"[^=]+(?:=+\Z)?")
#: Separators at which a part that no encoding holds is cut; each leaves pieces that an encoding may hold.
_CUTS = (re.compile(r"[^_-]+"), re.compile(r"[^/+]+"), re.compile(r"[^/_+-]+"))
#: Encodings from narrow to wide.
ENCODINGS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_SETS = [(name, frozenset(symbols), {c: i for i, c in enumerate(symbols)}) for name, symbols in ENCODINGS]
#: log probability of a character of ordinary text: share of its class over the size of the class.
_PROSE = {c: math.log(0.80 / 26) for c in "abcdefghijklmnopqrstuvwxyz"} | {c: math.log(0.05 / 26) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"} | {c: math.log(0.03 / 10) for c in "0123456789"} | {c: math.log(0.12 / 5) for c in "+/_=-"}


def chi_squared_p(index: np.ndarray, size: int, parts: int = 8) -> float:
    """Upper tail of the uniformity statistic over equal parts of the alphabet (Wilson-Hilferty)."""
    cuts = np.minimum(index * parts // size, parts - 1)
    share = np.bincount(np.minimum(np.arange(size) * parts // size, parts - 1), minlength=parts) / size
    expected = share * len(index)
    x = float((((np.bincount(cuts, minlength=parts) - expected) ** 2) / expected).sum())
    k = parts - 1
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def runs_p(index: np.ndarray, size: int) -> float:
    """Two-sided runs test above and below the middle of the alphabet."""
    up = index >= size / 2
    a, b = int(up.sum()), int((~up).sum())
    n = a + b
    if not a or not b:
        return 0.0
    mean = 2 * a * b / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    return math.erfc(abs(1 + int((up[1:] != up[:-1]).sum()) - mean) / math.sqrt(2 * var)) if var > 0 else 1.0


def serial_p(index: np.ndarray) -> float:
    """Two-sided test of the lag-one correlation."""
    x = index - index.mean()
    total = float((x * x).sum())
    if total == 0:
        return 0.0
    r = float((x[1:] * x[:-1]).sum()) / total
    n = len(index)
    return math.erfc(abs(r + 1 / n) * math.sqrt(n) / math.sqrt(2))


def log_evidence(token: str) -> float | None:
    """log of the evidence against ordinary text; None where the token is not random in its encoding."""
    body = token.rstrip("=")
    chars = set(body)
    found = next((x for x in _SETS if chars <= x[1]), None)
    if found is None or len(body) < LEAST_TOKEN:
        return None
    _, symbols, place = found
    index = np.array([place[c] for c in body])
    if min(chi_squared_p(index, len(symbols)), runs_p(index, len(symbols)), serial_p(index)) < TEST_LEVEL / 3:
        return None
    return -len(body) * math.log(len(symbols)) - sum(_PROSE[c] for c in body)


def best_piece(part: str) -> tuple[float, int, int]:
    """(log evidence, start, end) of a part, or of its piece with most evidence where no encoding holds it whole."""
    body = part.rstrip("=")
    if len(body) < LEAST_TOKEN:
        return -math.inf, 0, len(part)
    if any(set(body) <= x[1] for x in _SETS):
        e = log_evidence(part)
        return -math.inf if e is None else e, 0, len(part)
    spans = sorted({m.span() for cut in _CUTS for m in cut.finditer(body) if m.end() - m.start() >= LEAST_TOKEN})
    found = [(e, a, len(part) if b == len(body) else b) for a, b in spans if _mixed(body[a:b]) and (e := log_evidence(body[a:b])) is not None]
    if not found:
        return -math.inf, 0, len(part)
    e, a, b = max(found)
    return e - math.log(len(spans)), a, b  # the mean of the pieces' evidence is at least this: still an e-value


def _mixed(word: str) -> bool:
    return any(c.isalpha() for c in word) and not word.isalpha()


def discoveries(evidence: list[float], fdr: float) -> list[int]:
    """The e-value Benjamini-Hochberg rule: the k largest with e >= m / (k * fdr), for the largest such k."""
    m = len(evidence)
    order = sorted(range(m), key=lambda i: -evidence[i])
    most = max((k for k, i in enumerate(order, 1) if evidence[i] >= math.log(m / (k * fdr))), default=0)
    return sorted(order[:most])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns."""
    spans = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(spans)


def random_spans(text: str, base: list[tuple[int, int, int]], fdr: float = FDR) -> list[tuple[int, int, int]]:
    tokens, evidence = [], []
    for run in _TOKEN.finditer(text):
        for m in _PART.finditer(run[0]):
            a, b = run.start() + m.start(), run.start() + m.end()
            if b - a < LEAST_TOKEN or not _mixed(m[0]) or any(s < b and a < e for s, _, e in base):
                continue
            e, start, end = best_piece(m[0])
            tokens.append((a + start, 3, a + end))
            evidence.append(e)
    return [tokens[i] for i in discoveries(evidence, fdr)] if tokens else []


def find_secrets(docs: DataFrame, *, fdr: float = FDR) -> DataFrame:
    """``doc_id, secrets`` with an array of (kind, start, end, text) by start, then kind as in KINDS."""

    def work(piece: pa.RecordBatch) -> dict:
        out = []
        for text in piece.column("text").to_pylist():
            text = text or ""
            base = base_spans(text)
            out.append([{"kind": KINDS[k], "start": a, "end": b, "text": text[a:b]} for a, k, b in sorted(base + random_spans(text, base, fdr))])
        return {"doc_id": piece.column("doc_id"), "secrets": out}

    return map_steps(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
        "text",
        "doc_id long, secrets array<struct<kind: string, start: long, end: long, text: string>>",
        work,
    )


def digest(found: DataFrame) -> DataFrame:
    """Counts, the hash of the fixed patterns' spans, and all spans as one string."""
    of = lambda *kinds: F.filter("secrets", lambda x: x["kind"].isin(*kinds))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    n = lambda kind: F.size(of(kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        n("assign"),
        n("access"),
        n("hex"),
        F.sha2(joined(of(*KINDS[:3])), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
        n("random"),
    )
