"""Secrets: fixed patterns, and parts of credentials that are reported only together.

A credential has parts: who (an access identifier), the secret, and where (an endpoint). Strong parts,
those of the fixed patterns, are reported alone. Weak ones (a user name, a short password, a random
looking token) are everywhere in texts, so one is reported only when a part that completes it lies near
it in the same scope, which is the text between two blank lines. Candidates of all texts of a batch are
intervals on one axis, scopes far apart on it, and each complementary pair of roles is one interval
join by binary search; texts never move between tasks.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
ROLES = ("identifier", "secret", "endpoint")
IDENTIFIER, SECRET, ENDPOINT = range(3)
#: Code points between parts of one credential; characters of texts taken at once (a longer text alone).
NEAR, AT_TIME = 256, 1_000_000
#: Least length, least entropy in bits a character of a token without a name.
TOKEN, ENTROPY = 20, 3.5

#: Fixed by the contract.
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: What weak parts look like. Every pattern takes time in proportion to the text.
_NAMED = re.compile(
    r"""(?<![A-Za-z0-9])(?:(?P<i>(?ai:user(?:_?name|_?id)?|login|account|client_?id|access_?key_?id|key_?id))|(?P<s>(?ai:pass|passphrase|passwd|password|pwd|secret|token|api_?key|(?:private|secret|access|auth|account)_?key|client_?secret|credentials?))|(?P<e>(?ai:host(?:_?name)?|server|endpoint|url|database|bucket|region)))["']?\s{0,4}[:=]\s{0,4}["']?(?P<v>[^\s"',;<>]{3,256})"""
)
_ISSUED = re.compile(r"(?<![A-Za-z0-9])A(?:SIA|IDA|ROA|GPA|NPA|NVA)[A-Z0-9]{12,}")
_TOKENS = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % TOKEN)
_SHORT_HEX = re.compile(r"(?<![A-Za-z0-9])[0-9a-f]{16,31}(?![A-Za-z0-9])")
_URL = re.compile(r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,20}://(?:(?P<u>[^\s/?#@:\"'<>]{1,256}):(?P<p>[^\s/?#@\"'<>]{1,256})@)?[^\s\"'<>@]{3,}")
_PORT = re.compile(r"(?<![A-Za-z0-9.-])(?:[A-Za-z0-9-]+\.)+[A-Za-z0-9-]+:[0-9]{2,5}(?![0-9])")
_BLANK = re.compile(r"\n[^\S\n]*\n")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, by start and kind."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)])


def _random(s: str) -> bool:
    """Whether a token looks drawn by chance: upper and lower case, digits, and many different characters."""
    if not (re.search("[a-z]", s) and re.search("[A-Z]", s) and re.search("[0-9]", s)):
        return False
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) >= ENTROPY


def parts(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, bool]]:
    """(start, end, role, kind number, alone) of all parts of credentials in a text: `alone` for those of the fixed patterns; kind -1 for endpoints, -2 for tokens without a name.

    A weak part that touches a strong one, or an earlier weak one of its role, is left out.
    """
    out = [(s, e, IDENTIFIER if k == 1 else SECRET, k, True) for s, k, e in base]
    weak = []
    if ":" in text or "=" in text:
        for m in _NAMED.finditer(text):
            role = IDENTIFIER if m["i"] else SECRET if m["s"] else ENDPOINT
            weak.append((m.start(), m.end(), role, 1 if m["i"] else 0 if m["s"] else -1))
        if "://" in text:
            for m in _URL.finditer(text):
                if m["u"]:
                    weak += [(*m.span("u"), IDENTIFIER, 1), (*m.span("p"), SECRET, 0), (m.end("p") + 1, m.end(), ENDPOINT, -1)]
                else:
                    weak.append((*m.span(), ENDPOINT, -1))
        weak += [(*m.span(), ENDPOINT, -1) for m in _PORT.finditer(text)]
    weak += [(*m.span(), IDENTIFIER, 1) for m in _ISSUED.finditer(text)]
    weak += [(*m.span(), SECRET, -2) for m in _TOKENS.finditer(text) if _random(m[0])]
    weak += [(*m.span(), SECRET, 2) for m in _SHORT_HEX.finditer(text) if re.search("[a-f]", m[0]) and re.search("[0-9]", m[0])]
    last = [0, 0, 0]
    strong, at = sorted((s, e) for s, _, e in base), 0
    for s, e, role, kind in sorted(weak):
        while at < len(strong) and strong[at][1] <= s:
            at += 1
        if s >= last[role] and not any(a < e and s < b for a, b in strong[at : at + 3]):
            out.append((s, e, role, kind, False))
            last[role] = e
    return out


def linked(found: list[list[tuple]], breaks: list[np.ndarray], sizes: list[int]) -> list[list[tuple]]:
    """(start, kind, end, role, start, end) of the weak parts of each text that a complementary part completes, with the nearest one.

    An identifier is completed by a secret, a secret with a name by an identifier or an endpoint, a secret
    without one by an identifier; parts that overlap complete nothing. All texts' parts are intervals on
    one axis with more than NEAR between scopes.
    """
    rows = [(i, *p) for i, ps in enumerate(found) for p in ps]
    out: list[list[tuple]] = [[] for _ in found]
    if not rows:
        return out
    scopes = np.array([int(np.searchsorted(breaks[i], s, "right")) for i, s, *_ in rows], np.int64)
    text, start, end, role, kind, alone = (np.array(c, np.int64) for c in zip(*rows, strict=True))
    origin = np.concatenate([[0], np.cumsum([n + (len(b) + 2) * 2 * NEAR for n, b in zip(sizes, breaks, strict=True)])])[text] + scopes * 2 * NEAR
    a, b = origin + start, origin + end
    best, partner = np.full(len(rows), NEAR + 1), np.full(len(rows), -1)
    weak = alone == 0
    for of, takes in ((IDENTIFIER, (SECRET,)), (SECRET, (IDENTIFIER, ENDPOINT))):
        for other in takes:
            ask = np.flatnonzero(weak & (role == of) & ((kind != -2) | (other == IDENTIFIER)))
            there = np.flatnonzero(role == other)
            if not len(ask) or not len(there):
                continue
            by_end, by_start = there[np.argsort(b[there], kind="stable")], there[np.argsort(a[there], kind="stable")]
            before, after = np.searchsorted(b[by_end], a[ask], "right") - 1, np.searchsorted(a[by_start], b[ask])
            for place, of_order, gap in ((before, by_end, lambda i, j: a[i] - b[j]), (after, by_start, lambda i, j: a[j] - b[i])):
                ok = (place >= 0) & (place < len(of_order))
                i, j = ask[ok], of_order[place[ok]]
                near = gap(i, j) < best[i]
                best[i[near]], partner[i[near]] = gap(i, j)[near], j[near]
    for i in np.flatnonzero(partner >= 0):
        j = partner[i]
        if kind[i] != -1:
            out[text[i]].append((int(start[i]), max(0, int(kind[i])), int(end[i]), int(role[j]), int(start[j]), int(end[j])))
    return out


def as_text(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def found_in(texts: list[str]) -> tuple[list[list], list[list]]:
    """Base spans and links of texts."""
    base = [base_spans(t) for t in texts]
    breaks = [np.array([m.end() for m in _BLANK.finditer(t)], np.int64) if "\n" in t else np.zeros(0, np.int64) for t in texts]
    return base, linked([parts(t, b) for t, b in zip(texts, base, strict=True)], breaks, [len(t) for t in texts])


def secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans, links) of every row.

    Counts and `base` are those of the fixed patterns. `spans` adds weak parts that a complementary part
    completes: identifiers under the kind access, secrets under assign, short runs of hexadecimal
    digits under hex. `links` has for each of these (kind, start, end, role, with_start, with_end) with the
    nearest part that completes it. Offsets are code points. Null texts are empty, texts are whole, rows repeat as
    in the input, an empty table gives no rows, and columns not named are not read.
    """
    link = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("role", pa.string()), ("with_start", pa.int64()), ("with_end", pa.int64())])
    fields = ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans", "links"]

    def run(batches):
        for batch in batches:
            at = 0
            while at < len(batch):
                n, end = 0, at
                texts = []
                while end < len(batch) and (end == at or n < AT_TIME):
                    texts.append(batch.column(1)[end].as_py() or "")
                    n += len(texts[-1])
                    end += 1
                base, links = found_in(texts)
                spans = [as_text(sorted({*b, *((s, k, e) for s, k, e, *_ in more)})) for b, more in zip(base, links, strict=True)]
                linked_ = [[{"kind": KINDS[k], "start": s, "end": e, "role": ROLES[r], "with_start": x, "with_end": y} for s, k, e, r, x, y in more] for more in links]
                counts = [pa.array([sum(x[1] == k for x in b) for b in base], pa.int64()) for k in range(len(KINDS))]
                columns = [batch.column(0).slice(at, end - at), *counts, pa.array(map(as_text, base), pa.string()), pa.array(spans, pa.string()), pa.array(linked_, pa.list_(link))]
                yield pa.RecordBatch.from_arrays(columns, fields)
                at = end

    kinds = "array<struct<kind: string, start: bigint, end: bigint, role: string, with_start: bigint, with_end: bigint>>"
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + f", base string, spans string, links {kinds}")


def report(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(F.col("base"), 256).alias("base_sha256"), "spans")
