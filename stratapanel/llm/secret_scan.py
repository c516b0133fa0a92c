"""Secret scans with multipart credential linking.

A pass over the texts finds certain spans (assignments, access keys, long hex)
and weak parts: identifiers, bare secret-like tokens and endpoints that alone
mean little.  Parts of complementary roles are then interval-joined inside a
scope: a weak identifier and a weak secret are reported where a secret or an
identifier (certain or weak) stands within ``REACH`` code points, from the end of
one to the start of the other; an endpoint where both do.  The join runs on (row,
block of ``REACH`` code points), as semi joins of the blocks that a part covers:
no pairs are made, and a text full of parts spreads over its blocks.

Defined results: a null text is empty; a document without spans keeps its row;
null or repeated ``doc_id`` rows are scanned one by one; an empty table gives
no rows; other columns are ignored.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratapanel.llm.arrow import column, slices
from stratapanel.llm.store import unused, written

#: Code points within which complementary parts belong together.
REACH = 200
#: Kinds in the order in which spans of equal start are listed.
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "endpoint": "endpoint"}

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run holds its longest match at its first AKIA
HEX = re.compile(r"[0-9a-f]{24,}")
WEAK_ID = re.compile(r"""\b(?:user(?:name)?|login|account|client_?id|access_?key_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}|\bA[SG]IA[A-Z0-9]{16}\b""", re.I | re.A)
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9A-Z+/_-]*[a-z])(?=[0-9a-z+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])", re.A)
ENDPOINT = re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]+", re.A)

SPANS = "array<struct<kind:int,start:int,end:int>>"


def certain(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the spans that count alone."""
    found = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(1, m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], s[0]))


def weak(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak parts that overlap no certain span."""
    taken = sorted((s, e) for _, s, e in known)
    found = []
    for kind, pattern in ((3, WEAK_ID), (4, WEAK_SECRET), (5, ENDPOINT)):
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    free, k = [], 0
    for part in sorted(found, key=lambda s: (s[1], s[0])):
        while k < len(taken) and taken[k][1] <= part[1]:
            k += 1
        if k == len(taken) or taken[k][0] >= part[2]:
            free.append(part)
    return free


def _spans(rows: list[list[tuple[int, int, int]]]) -> pa.Array:
    one = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    return pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in r] for r in rows], pa.list_(one))


def parts(docs: DataFrame) -> DataFrame:
    """doc_id, certain and weak spans of every whole text."""

    def run(batches):
        for part in slices(batches, "text"):
            texts = [t or "" for t in column(part, "text").to_pylist()]
            sure = [certain(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [column(part, "doc_id"), _spans(sure), _spans([weak(t, s) for t, s in zip(texts, sure)])], ["doc_id", "certain", "weak"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, f"doc_id long, certain {SPANS}, weak {SPANS}")


def linked(rows: DataFrame) -> DataFrame:
    """(row, kind, start, end) of the weak parts that complementary parts stand beside."""
    every = rows.where(F.size("weak") > 0).select("row", F.explode(F.concat("certain", "weak")).alias("s")).select("row", "s.*")

    def role(name: str) -> DataFrame:
        return every.where(F.col("kind").isin([k for k, x in enumerate(KINDS) if ROLES[x] == name]))

    def covered(before, after):
        return F.explode(F.sequence(*[F.floor(x / REACH).cast("int") for x in (before, after)]))

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        s2, e2 = F.col("s2"), F.col("e2")
        near = right.select(F.col("row").alias("r2"), F.col("start").alias("s2"), F.col("end").alias("e2"), covered(F.col("start") - REACH, F.col("end") + REACH).alias("b2"))
        own = left.withColumn("block", covered(F.col("start"), F.col("end")))
        close = (F.col("start") - e2 <= REACH) & (s2 - F.col("end") <= REACH)
        found = own.join(near, (F.col("row") == F.col("r2")) & (F.col("block") == F.col("b2")) & close, "left_semi")
        return found.select(left.columns).dropDuplicates(["row", "kind", "start", "end"])  # a part may be found in some of its blocks

    ids, secrets = beside(role("id"), role("secret")), beside(role("secret"), role("id"))
    ends = beside(beside(role("endpoint"), ids), secrets)
    return ids.unionByName(secrets).unionByName(ends).where(F.col("kind") >= 3)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, certain (spans that count alone), spans (those and the linked ones); a row for every document."""
    rows = written(parts(docs).withColumn("row", F.monotonically_increasing_id()), "parts")
    more = linked(rows).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    whole = F.concat("certain", F.coalesce("more", F.expr(f"cast(array() as {SPANS})")))
    ordered = F.transform(F.array_sort(F.transform(whole, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))),
                          lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.join(more, "row", "left").select("doc_id", "row", "certain", ordered.alias("spans"))


def listed(spans):
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by ``mark``; other columns as they are.

    Rows meet their spans by a row number that a written copy of the table fixes.
    """
    row, spans_column = unused(docs, "row", "spans")
    fixed = written(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    keyed = fixed.select(F.col(row).alias("doc_id"), "text")
    found = scan(keyed).where(F.size("spans") > 0).select(F.col("doc_id").alias("found"), F.col("spans").alias("found_spans"))

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = []
            for text, spans in zip(batch.column(at).to_pylist(), column(batch, spans_column).to_pylist()):
                out, end = [], 0
                for s in spans or ():
                    if s["end"] <= end:
                        continue
                    if s["start"] >= end:
                        out += [text[end: s["start"]], mark]
                    end = s["end"]
                texts.append(text if not spans else "".join(out) + text[end:])
            keep = [k for k, n in enumerate(batch.schema.names) if n != spans_column]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else batch.column(k) for k in keep], [batch.schema.names[k] for k in keep])

    joined = fixed.join(found, fixed[row] == found["found"], "left")
    joined = joined.select(*[fixed[c] for c in docs.columns], found["found_spans"].alias(spans_column))
    return joined.mapInArrow(run, docs.schema)
