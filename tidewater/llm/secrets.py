"""Secret scan with multipart credential linking.

Strong forms (assignments, access keys, long hex) are reported as they stand. A
weak candidate, a long mixed token that could be a secret, is reported only when
a complementary part of a credential, an access identifier or an endpoint, lies
within its scope. A strong secret with such a part in its scope is reported as a
credential that spans both. Parts meet in interval joins over buckets of text positions.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import materialize, read_table

# Base kinds in their order, patterns, and the least length of what counts.
BASE_KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal either way, so short ones can be left out at once
_ASSIGN_LEAST, _ACCESS_LEAST = 6, 20

#: Parts of credentials that only count together: weak candidates, and strong secrets with what completes them.
KINDS = (*BASE_KINDS, "linked", "credential")
IDENT, ENDPOINT, WEAK, SECRET, WEAK_ID = 0, 1, 2, 3, 4
#: What each weak kind needs one of.
NEEDS = {WEAK: (IDENT, ENDPOINT), WEAK_ID: (SECRET, ENDPOINT)}
_IDENT = re.compile(r"""(?ai)\b(?:access_?key_?id|client_?id|account_?id|key_?id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}|(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++""")
_ENDPOINT = re.compile(r"""(?ai)\b(?:https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\s"'<>]{4,}|\b(?:endpoint|host|server)["']?\x20*[:=]\x20*["']?[a-z0-9-]+(?:\.[a-z0-9-]+)+""")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Names that a value is weak after, whatever it looks like; base names with values too short for the base form are among them.
_NAMED = re.compile(r"""(?ai)(?:password|passwd|secret|token|api_?key|pwd|passphrase|private_?key|auth|credential|bearer)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{3,})""")
_SHORT_ACCESS_LEAST = 8

#: Code points between the starts of parts of one credential.
SCOPE = 400
#: Bits a character that a weak token has at least, and its digits and letters.
ENTROPY, DIGITS, LETTERS = 2.8, 2, 2

_ROWS = "doc_id long, k long, n_assign long, n_access long, n_hex long, spans array<struct<start: int, kind: int, end: int>>, parts array<struct<kind: int, start: int, end: int>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_PART = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base forms, leftmost and non-overlapping per kind."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= _ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _is_weak(token: str) -> bool:
    """Whether digits and letters are mixed in token as in keys; one case is enough."""
    digits, n = sum(map(str.isdigit, token)), len(token)
    if digits < DIGITS or sum(map(str.isalpha, token)) < LETTERS:
        return False
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values()) >= ENTROPY


def credential_parts(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of identifiers, endpoints, secrets and weak candidates; none if neither a candidate nor a strong secret is there.

    Base spans are parts, too: access keys identify, assigned values and long hex are secrets; hex inside of an assigned value is none of
    its own. Candidates that a base span, an endpoint or an identifier touches are none. A value of three characters needs a digit.
    """
    weak = [(WEAK, m.start(), m.end()) for m in _NAMED.finditer(text) if len(m[1]) > 3 or any(map(str.isdigit, m[1]))]
    weak += [(WEAK, m.start(), m.end()) for m in _TOKEN.finditer(text) if _is_weak(m[0])]
    if "AKIA" in text:
        weak += [(WEAK_ID, m.start(), m.end()) for m in _ACCESS.finditer(text) if _SHORT_ACCESS_LEAST <= len(m[0]) < _ACCESS_LEAST]
    parts, upto = [], -1
    for s, kind, e in base:
        if kind == 1:
            parts.append((IDENT, s, e))
        elif e > upto:
            parts.append((SECRET, s, e))
            upto = e
    if not weak and not any(kind == SECRET for kind, _, _ in parts):
        return []
    found = [(IDENT, m.start(), m.end()) for m in _IDENT.finditer(text)]
    found += [(ENDPOINT, m.start(), m.end()) for m in _ENDPOINT.finditer(text)]
    # what is taken, as spans that do not touch, by start
    taken: list[list[int]] = []
    for s, e in sorted([(s, e) for s, _, e in base] + [(s, e) for _, s, e in found]):
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    starts = [s for s, _ in taken]
    last = -1
    for kind, s, e in sorted(weak, key=lambda x: (x[1], -x[2])):
        i = bisect_left(starts, e) - 1
        if s >= last and (i < 0 or taken[i][1] <= s):
            parts.append((kind, s, e))
            last = e
    return parts + found


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            piece = batch.slice(i, 256)
            counts, spans, parts = [[], [], []], [], []
            for text in piece.column("text").to_pylist():
                base = base_spans(text or "")
                for kind, n in enumerate(counts):
                    n.append(sum(x[1] == kind for x in base))
                spans.append([{"start": s, "kind": kind, "end": e} for s, kind, e in base])
                parts.append([{"kind": kind, "start": s, "end": e} for kind, s, e in credential_parts(text or "", base)])
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("k"), *(pa.array(n, pa.int64()) for n in counts), pa.array(spans, _SPAN), pa.array(parts, _PART)],
                names=["doc_id", "k", "n_assign", "n_access", "n_hex", "spans", "parts"],
            )


def linked_candidates(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak candidates with a complementary part whose start is at most `scope` away: (doc_id, k, start, end, with_ident, with_endpoint, with_secret).

    A weak secret needs an identifier or an endpoint, a weak identifier a secret or an endpoint. Each bucket of `scope`
    positions sends its outermost part of each kind to itself and its two neighbours, so a candidate meets at most
    three rows of each kind, however many parts a document has.
    """
    bucket = F.floor(F.col("start") / scope).cast("int")
    p = parts.withColumn("bucket", bucket)
    is_weak = F.col("kind").isin(*NEEDS)
    weak = p.where(is_weak).select("doc_id", "k", "bucket", "start", "end", F.col("kind").alias("weak")).distinct()
    edges = p.where(~is_weak).groupBy("doc_id", "k", "bucket", "kind").agg(F.min("start").alias("low"), F.max("start").alias("high"))
    spread = edges.withColumn("bucket", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)))
    # outermost of the bucket on each side of the candidate, so the nearest part is one of the two in every bucket but its own;
    # in its own all are in scope
    near = (F.abs(F.col("low") - F.col("start")) <= scope) | (F.abs(F.col("high") - F.col("start")) <= scope)
    helps = reduce(lambda a, b: a | b, ((F.col("weak") == w) & F.col("kind").isin(*kinds) for w, kinds in NEEDS.items()))
    same = [weak[c].eqNullSafe(spread[c]) for c in ("doc_id", "k", "bucket")]
    met = weak.join(spread, [*same, near, helps], "inner")
    with_kind = lambda kind, name: F.max((F.col("kind") == kind).cast("int")).alias(name)
    return met.groupBy(weak["doc_id"], weak["k"], weak["start"], weak["end"]).agg(with_kind(IDENT, "with_ident"), with_kind(ENDPOINT, "with_endpoint"), with_kind(SECRET, "with_secret"))


def credentials(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Strong secrets with the nearest identifier or endpoint that starts at most `scope` away: (doc_id, k, start, end), from the start of the
    first of the two to the end of the last; of two as near the earlier one.

    A bucket of `scope` positions holds at most so many parts, as their starts differ, so a secret meets a bounded number of them.
    """
    p = parts.withColumn("bucket", F.floor(F.col("start") / scope).cast("int"))
    own = p.where(F.col("kind") == SECRET).select("doc_id", "k", "bucket", "start", "end").distinct()
    held = p.where(F.col("kind").isin(IDENT, ENDPOINT)).groupBy("doc_id", "k", "bucket").agg(F.collect_set(F.struct("start", "end")).alias("held"))
    spread = held.withColumn("bucket", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)))
    same = [own[c].eqNullSafe(spread[c]) for c in ("doc_id", "k", "bucket")]
    near = F.array_min(F.transform("held", lambda x: F.struct(F.abs(x["start"] - own["start"]).alias("far"), x["start"].alias("start"), x["end"].alias("end"))))
    met = own.join(spread, same).select(own["doc_id"], own["k"], own["start"], own["end"], near.alias("near")).where(F.col("near.far") <= scope)
    best = met.groupBy("doc_id", "k", "start", "end").agg(F.min("near").alias("near"))
    return best.select("doc_id", "k", F.least("start", "near.start").alias("start"), F.greatest("end", "near.end").alias("end"))


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per document with all its spans.

    Null texts are empty. Null doc_ids are kept; rows that agree in doc_id and text give equal rows. Positions are
    code points, ends exclusive. Columns other than doc_id and text play no part; an empty table gives no rows.
    Returns (doc_id, n_assign, n_access, n_hex, spans, linked): spans are (start, kind, end) of the base kinds in
    order, linked those of weak candidates that a complementary part supports, and of credentials.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("k"), "text").mapInArrow(_extract, _ROWS)
    found = materialize(found, "secrets-rows")
    parts = found.where(F.size("parts") > 0).select("doc_id", "k", F.explode("parts").alias("p")).select("doc_id", "k", "p.*")
    kind = lambda name: F.lit(KINDS.index(name)).alias("kind")
    found_both = linked_candidates(parts, scope).select("doc_id", "k", "start", kind("linked"), "end").unionByName(credentials(parts, scope).select("doc_id", "k", "start", kind("credential"), "end"))
    links = found_both.groupBy("doc_id", "k").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("linked"))
    joined = found.alias("f").join(links.alias("l"), F.col("f.doc_id").eqNullSafe(F.col("l.doc_id")) & F.col("f.k").eqNullSafe(F.col("l.k")), "left")
    empty = F.array().cast("array<struct<start: int, kind: int, end: int>>")
    return joined.select("f.doc_id", "n_assign", "n_access", "n_hex", "spans", F.coalesce("linked", empty).alias("linked"))


def _shown(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents."""
    out = scan_secrets(read_table(spark, sf_dir, "documents"))
    every = F.array_sort(F.concat("spans", "linked"))
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(_shown(F.col("spans")).cast("binary"), 256).alias("base_sha256"), _shown(every).alias("spans"), F.size("linked").cast("long").alias("n_linked")
    )
