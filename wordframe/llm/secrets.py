"""Secret scan: plain patterns, and credentials whose parts only count together."""
import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns of the base scan, with the least length that counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16

# Parts that are too weak alone.
IDENTIFIER = re.compile(r"""(?:access_?key(?:_?id)?|client_?id|account(?:_?id|_?name)?|user(?:_?name|_?id)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]{4,})""", re.I | re.A)
ENDPOINT = re.compile(r"""[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+|(?:host(?:name)?|endpoint|server)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.-]+\.[A-Za-z0-9_.:/-]+)""", re.I | re.A)
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
SCOPE_END = re.compile(r"\n[ \t]*\n")       # parts on two sides of an empty line do not belong together
REACH = 200                                 # code points between two parts of one credential
ENTROPY = 3.5                               # bits per character of a candidate
KINDS = ["assign", "access", "hex", "identifier", "candidate", "endpoint"]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the plain matches; of each kind leftmost, not overlapping, short ones dropped afterwards."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def _random_looking(value: str) -> bool:
    if not (re.search("[a-z]", value) and re.search("[A-Z]", value) and re.search("[0-9]", value)):
        return False
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= ENTROPY


class _Parts:
    """Intervals of one role, for whether any of them overlaps another interval or stands near it in the same scope.

    No part holds a line break, so it lies whole in one scope, and of all parts on one side only the nearest can decide.
    """

    def __init__(self, spans):
        self.spans = sorted(spans)
        self.starts = [s[0] for s in self.spans]
        self.ends = sorted(s[1] for s in self.spans)
        self.reached = list(accumulate((s[1] for s in self.spans), max))       # furthest end of the parts so far

    def near(self, start: int, end: int, scope: tuple[int, int]) -> bool:
        after = bisect_left(self.starts, end)
        if after < len(self.starts) and self.starts[after] <= min(end + REACH, scope[1] - 1):
            return True
        before = bisect_right(self.ends, start) - 1
        return before >= 0 and self.ends[before] >= max(start - REACH, scope[0] + 1)

    def overlaps(self, start: int, end: int) -> bool:
        earlier = bisect_left(self.starts, end)
        return earlier > 0 and self.reached[earlier - 1] > start


def linked_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Weak parts that stand near a complement in their scope.

    Roles: identifiers (access keys and named ids), secrets (assigned values, long hex and random-looking strings) and
    endpoints. A random-looking string needs an identifier nearby; a named id needs a secret; an endpoint needs both.
    Complements are parts of the other role that do not overlap the part itself, at most ``REACH`` code points away on
    either side, in the same scope: an interval join over all parts. Parts are sorted, so a part costs a few searches.
    """
    known = [s for s in base if s[2] == "access"]
    named = [(m.start(), m.end()) for m in IDENTIFIER.finditer(text)] if ":" in text or "=" in text else []
    identifiers = _Parts([(s, e) for s, e, _ in known] + named)
    if not identifiers.spans:
        return []
    strong = [(s, e) for s, e, kind in base if kind != "access"]
    taken = _Parts(strong + identifiers.spans)
    weak = [(m.start(), m.end()) for m in CANDIDATE.finditer(text) if _random_looking(m[0])]
    weak = [w for w in weak if not taken.overlaps(*w)]
    edges = [0] + [m.start() for m in SCOPE_END.finditer(text)] + [len(text)]

    def scope(start):
        i = bisect_left(edges, start + 1)
        return edges[i - 1], edges[min(i, len(edges) - 1)]

    weak = [w for w in weak if identifiers.near(*w, scope(w[0]))]
    secrets = _Parts(strong + weak)
    named = [p for p in named if secrets.near(*p, scope(p[0]))]
    out = [(*w, "candidate") for w in weak] + [(*p, "identifier") for p in named]
    if "://" in text or "=" in text or ":" in text:
        out += [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)
                if identifiers.near(m.start(), m.end(), scope(m.start())) and secrets.near(m.start(), m.end(), scope(m.start()))]
    return out


def _written(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def _scan(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, every = [], []
            for value in batch.column(at):
                text = value.as_py() or ""
                found = base_spans(text)
                base.append(found)
                every.append(found + linked_spans(text, found))
            counts = [pa.array([sum(s[2] == k for s in b) for b in base], pa.int64()) for k in KINDS[:3]]
            digest = [hashlib.sha256(_written(b).encode()).hexdigest() for b in base]
            spans = [_written(e) for e in every]
            kept = [i for i in range(batch.num_columns) if batch.schema.names[i] not in RESULT or i == at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in kept] + [*counts, pa.array(digest, pa.string()), pa.array(spans, pa.string())],
                names=[batch.schema.names[i] for i in kept] + RESULT)
    return run


RESULT = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]


def scanned(df: DataFrame, text: str = "text") -> DataFrame:
    """Add counts and digest of the base spans, and ``spans`` with the linked parts, to every row.

    Offsets are code points, ends exclusive. A missing text is empty and has no spans; the digest is then that of the
    empty string. Input columns named like the result are replaced; repeated rows get equal results.
    """
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in RESULT or c == text])
    schema = T.StructType(list(kept.schema.fields))
    for name in RESULT:
        schema = schema.add(name, "long" if name.startswith("n_") else "string")
    return kept.mapInArrow(_scan(kept.columns.index(text)), schema)


def op10_linked_credentials(spark, sf_dir):
    return scanned(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
