"""Secret scans: all rules as one minimal automaton, one pass over the bytes of every text.

The automaton's tables give the spans (``Matcher``); no regex runs. Null and empty texts have no spans (counts 0,
``spans`` empty, the digest of an empty string). Texts of any length are scanned whole, in lanes of about a kilobyte;
equal rows get equal results; an empty table gives an empty result; columns besides the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from tonearm.llm.automaton import Matcher
from tonearm.llm.common import map_columns

_NAME = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
#: kind -> (regex, the part before what is counted or none, least length of what is counted)
RULES = {
    "assign": (_NAME + "[A-Za-z0-9+/_.=-]+", _NAME, 12),
    "access": ("AKIA[A-Z0-9]+", None, 18),
    "hex": ("[0-9a-f]{16,}", None, 16),
    "github": ("gh[pousr]_[A-Za-z0-9]+", None, 40),
    "slack": ("xox[abprs]-[A-Za-z0-9-]+", None, 15),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", None, 40),
    "private_key": ("-----BEGIN [A-Z ]*PRIVATE KEY-----", None, 27),
}
BASE = ("assign", "access", "hex")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


@lru_cache(maxsize=1)
def _matcher() -> Matcher:
    """Compiled once in the driver and sent to the tasks: rules, then the parts before what is counted."""
    return Matcher([*(r for r, _, _ in RULES.values()), *(h for _, h, _ in RULES.values() if h)])


def secret_spans(texts: list[str], matcher: Matcher) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) in code points of every text, by start, then kind as listed."""
    kinds = list(RULES)
    heads = [h for _, h, _ in RULES.values() if h]
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum(np.array([len(r) + 1 for r in raw], np.int64))
    data = b"\n".join(raw) + b"\n"
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for rule, s, e in matcher.matches(np.frombuffer(data, np.uint8), len(kinds)):
        _, head, least = RULES[kinds[rule]]
        counted = matcher.longest(data, s, e, len(kinds) + heads.index(head)) if head else s
        if e - counted >= least:
            found[int(np.searchsorted(ends, s, "right"))].append((s, rule, e))
    out = []
    for mine, end, text in zip(found, ends.tolist(), raw, strict=True):
        first = end - 1 - len(text)
        if mine and not text.isascii():  # places in code points: bytes that begin one, counted once
            at = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
            mine = [(int(at[s - first]), r, int(at[e - first])) for s, r, e in mine]
        else:
            mine = [(s - first, r, e - first) for s, r, e in mine]
        out.append([(kinds[r], s, e) for s, r, e in sorted(mine)])
    return out


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, the digest of their spans, and all spans. No shuffle."""
    matcher = _matcher()

    def run(ids, texts):
        rows = []
        for doc, spans in zip(ids, secret_spans([t or "" for t in texts], matcher), strict=True):
            told = [f"{k}:{s}:{e}" for k, s, e in spans]
            base = [t for t, (k, _, _) in zip(told, spans, strict=True) if k in BASE]
            counts = [sum(k == kind for k, _, _ in spans) for kind in BASE]
            rows.append((doc, *counts, _digest(",".join(base)), ",".join(told)))
        return list(zip(*rows, strict=True)) or [[]] * 6

    plain = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    return map_columns(plain, run, SCHEMA, 2000)


def op2_secret_scans(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
