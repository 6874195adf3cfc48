"""Secret scans with multipart credential linking.

One pass finds the base spans (assignments, access ids, hexadecimal runs) and
the weak parts of credentials: identifiers, short or unlabelled secrets, and
endpoints.  A weak part alone is common in clean text; it is reported only if
an interval join finds a complementary part in its scope, that is, within
``REACH`` code points in the same document.  Parts are joined by document and
block of ``REACH`` code points, so one document with many parts spreads over
many keys, and the join is a semi-join: it says that a partner exists and
makes no pairs.

Defined results: null text counts as empty; spans count code points, end
exclusive; every input row gives one row, repeated rows too.  Ids may be of any
type; other columns are left out.  A text is scanned in linear time.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import materialize

BASE = ("assign", "access", "hex")
WEAK = ("identifier", "secret", "endpoint")
KINDS = BASE + WEAK
REACH = 256

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the maximal runs of 16 or more
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
IDENTIFIER = re.compile(r"""\b(?:user(?:_?name|_?id)?|login|account|client_?id|app_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""", re.I | re.A)
IDENTIFIER_WORDS = ("user", "login", "account", "client", "app", "access")
SECRET = re.compile(r"""\b(?:pass|pwd|pw|pin|key|auth|credential|passwd|password|secret|token)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{4,}""", re.I | re.A)
SECRET_WORDS = ("pass", "pwd", "pw", "pin", "key", "auth", "credential", "secret", "token")
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}(?![A-Za-z0-9+/])")
HOST = re.compile(r"""\b(?:host|server|endpoint|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]{4,}""", re.I | re.A)
URL = re.compile(r"""://[^\s"'<>]+""")
SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+")
ENDPOINT_WORDS = ("://", "host", "server", "endpoint", "url")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = SCHEME | frozenset("._%-")
ADDRESS = re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?::\d{1,5})?(?![\w.]*\d)")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, by start and kind."""
    found = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    lower = text.lower()  # at least as many matches as the pattern: it only rules texts out
    if any(w in lower for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    return sorted(found)


def _back(text: str, at: int, least: int, letters: frozenset[str]) -> int:
    """The start of the run of ``letters`` that ends at ``at``, not before ``least``."""
    while at > least and text[at - 1] in letters:
        at -= 1
    return at


def addresses(text: str) -> list[tuple[int, int]]:
    """The spans of e-mail addresses, from the left, without overlap, in linear time."""
    found, end = [], 0
    for m in DOMAIN.finditer(text):
        start = _back(text, m.start(), end, LOCAL)
        if start < m.start():
            end = m.end()
            found.append((start, end))
    return found


def _next_url(text: str, at: int) -> tuple[int, int] | None:
    """The first URL that starts at ``at`` or later."""
    mark = text.find("://", at)
    while mark >= 0:
        start = _back(text, mark, at, SCHEME)
        border = not start or not (text[start - 1] == "_" or text[start - 1].isascii() and text[start - 1].isalnum())
        while start < mark and not (text[start].isalpha() and border):  # a scheme begins a word
            border = text[start] == "+"
            start += 1
        if start < mark and (m := URL.match(text, mark)):
            return start, m.end()
        mark = text.find("://", mark + 3)
    return None


def endpoints(text: str) -> list[tuple[int, int]]:
    """The spans of URLs and of values of hosts, from the left, without overlap, in linear time."""
    out, at = [], 0
    url, value = _next_url(text, 0), HOST.search(text)
    while url or value:
        if url and (not value or url[0] <= value.start()):
            out.append(url)
        else:
            out.append(value.span())
        at = out[-1][1]
        if url and url[0] < at:
            url = _next_url(text, at)
        if value and value.start() < at:
            value = HOST.search(text, at)
    return out


def weak_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the weak parts that no base span overlaps."""
    found, lower = [], text.lower()
    if ":" in text or "=" in text:
        for kind, pattern, words in ((3, IDENTIFIER, IDENTIFIER_WORDS), (4, SECRET, SECRET_WORDS)):
            if any(w in lower for w in words):
                found += [(m.start(), kind, m.end()) for m in pattern.finditer(text)]
        if any(w in lower for w in ENDPOINT_WORDS):
            found += [(a, 5, b) for a, b in endpoints(text)]
    if "@" in text:  # accounts are often named by an address
        found += [(a, 3, b) for a, b in addresses(text)]
    found += [(m.start(), 5, m.end()) for m in ADDRESS.finditer(text)]
    for m in OPAQUE.finditer(text):
        if re.search("[0-9]", m[0]) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]):
            found.append((m.start(), 4, m.end()))
    starts, ends = [a for a, _, _ in base], list(accumulate((b for *_, b in base), max))

    def taken(span: tuple[int, int, int]) -> bool:
        k = bisect_left(starts, span[2])  # base spans that start before its end
        return k > 0 and ends[k - 1] > span[0]

    return sorted({s for s in found if not taken(s)})


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, row_id, base, weak): the spans of each row as lists of (start, kind, end)."""
    span = "array<struct<start:int,kind:int,end:int>>"
    kind = docs.schema[doc_id].dataType.simpleString()
    listed = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_rows = lambda spans: [{"start": a, "kind": k, "end": b} for a, k, b in spans]
        for batch in batches:
            base, weak = [], []
            for t in batch.column(1):
                text = t.as_py() or ""
                base.append(base_spans(text))
                weak.append(weak_spans(text, base[-1]))
            columns = [batch.column(0), pa.array(map(as_rows, base), listed), pa.array(map(as_rows, weak), listed)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "base", "weak"])

    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, base {span}, weak {span}")
    return found.withColumn("row_id", F.monotonically_increasing_id())


def _near(parts: DataFrame, kinds: tuple[int, ...], others: tuple[int, ...]) -> DataFrame:
    """The parts of ``kinds`` with a part of ``others`` in their scope."""
    blocks = F.sequence(F.floor((F.col("start") - REACH) / REACH), F.floor((F.col("end") + REACH) / REACH))
    left = parts.where(F.col("kind").isin(*kinds)).select("row_id", "start", "kind", "end", F.explode(blocks).alias("block"))
    right = parts.where(F.col("kind").isin(*others)).select(
        F.col("row_id").alias("r"), F.col("start").alias("s"), F.col("end").alias("e"), F.explode(F.sequence(F.floor(F.col("start") / REACH), F.floor(F.col("end") / REACH))).alias("b")
    )
    met = (F.col("row_id") == F.col("r")) & (F.col("block") == F.col("b")) & (F.col("s") < F.col("end") + REACH) & (F.col("e") > F.col("start") - REACH)
    return left.join(right, met, "left_semi").select("row_id", "start", "kind", "end").distinct()


def linked_parts(found: DataFrame) -> DataFrame:
    """(row_id, start, kind, end): the weak parts whose complement is in scope.

    An identifier needs a secret, a secret needs an identifier or an access id,
    and an endpoint needs both a secret and an identifier beside it.
    """
    spans = found.where(F.size("weak") > 0).select("row_id", F.explode(F.concat("base", "weak")).alias("p")).select("row_id", "p.*")
    spans = materialize(spans, "parts")
    pairs = _near(spans, (4,), (1, 3)).unionAll(_near(spans, (3,), (0, 4)))
    ends = spans.where("kind = 5")
    ends = _near(ends.unionAll(spans.where("kind IN (0, 4)")), (5,), (0, 4)).join(_near(ends.unionAll(spans.where("kind IN (1, 3)")), (5,), (1, 3)), ["row_id", "start", "kind", "end"], "left_semi")
    return pairs.unionAll(ends)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked) for every row."""
    found = materialize(scan(docs, text, doc_id), "secrets")
    linked = linked_parts(found).groupBy("row_id").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    rows = found.join(linked, "row_id", "left").withColumn("linked", F.coalesce("linked", F.array()))
    return rows.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat("base", "linked")).alias("spans"),
        F.size("linked").cast("long").alias("n_linked"),
    )
