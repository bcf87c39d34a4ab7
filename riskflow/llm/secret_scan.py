"""Secrets in texts, told from copied examples by who else has them.

Three patterns find the base spans. Their values, and strings that look like keys
without any context, are candidates. Digests of the candidates are counted over the
whole corpus by distinct repositories and owners: a value that ``EXAMPLE_OWNERS`` or
more owners have is a widely copied example, and one that looks random and stays with
``LIVE_OWNERS`` is reported as live. Those verdicts are further spans, over the values;
the base spans stay whatever the verdict. Values themselves are not stored.

Counting goes from (value, owner, repository) to (value, owner) to value, each with
partial sums before its shuffle. Values on more than 1 in ``SHARE`` of all candidates,
at most ``SHARE`` of them, are broadcast back to their documents; the rest are joined by
shuffle, so a value that a third of all documents hold goes to no single task.

Defined cases: a null or empty text has no spans; a null repository or owner counts as
one unknown one; rows that repeat are scanned each for itself and count as the same
repository; a value twice in a document gets a verdict at both places; two kinds at one
place are both listed; an empty table gives an empty result. ``scanned`` keeps all
columns but one named ``secrets``, which it replaces.
"""

from __future__ import annotations

import re
from collections import Counter
from hashlib import sha256
from math import log2

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.llm import arrays as A
from riskflow.llm.common import stored, text_of, workers_can_import

# The kinds of base spans, their patterns and least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
BASE_KINDS = ["assign", "access", "hex"]
# End of fixed values.

#: A key without context: a whole run of these characters, of such lengths.
LOOSE = re.compile(r"[A-Za-z0-9+/_=-]+")
LOOSE_LENGTHS = range(20, 129)
#: Bits per character from which a value can be random.
LEAST_ENTROPY = 3.0
#: Owners of a live value at most, and of an example at least.
LIVE_OWNERS = 1
EXAMPLE_OWNERS = 3
#: All kinds, in the order in which spans with the same start are listed.
KINDS = [*BASE_KINDS, "example", "live"]
#: A value on a larger part of all candidates than 1 in this is joined by broadcast.
SHARE = 1000

SPAN = "struct<start: long, kind: int, end: long>"
CANDIDATE = "struct<start: long, end: long, random: boolean, digest: binary>"

#: What a text with an assignment contains, in lower case.
_NAMES = [b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"]


def _marks(*parts: bytes | range) -> np.ndarray:
    table = np.zeros(256, bool)
    for part in parts:
        table[list(part)] = True
    return table


_HEX = _marks(b"0123456789abcdef")
_LOOSE = _marks(range(48, 58), range(65, 91), range(97, 123), b"+/_=-")


def looks_random(value: str) -> bool:
    """Whether a value has the variety of a key: no word, placeholder or repetition."""
    counts = Counter(value)
    entropy = -sum(n / len(value) * log2(n / len(value)) for n in counts.values())
    digits = sum(n for c, n in counts.items() if c.isdigit())
    return entropy >= LEAST_ENTROPY and 0 < digits < len(value)


def _is_loose_key(value: str) -> bool:
    """Without context a value must mix digits and letters of both cases."""
    mixed = any(map(str.isupper, value)) and any(map(str.islower, value))
    return len(value) in LOOSE_LENGTHS and mixed and looks_random(value)


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, first, last) of each base span; first to last is its value."""
    found = []
    for match in ASSIGN.finditer(text):
        if len(match[2]) >= LEAST_ASSIGN:
            found.append((match.start(), 0, match.end(), *match.span(2)))
    for kind, pattern, least in ((1, ACCESS, LEAST_ACCESS), (2, HEX, LEAST_HEX)):
        for match in pattern.finditer(text):
            if len(match[0]) >= least:
                found.append((match.start(), kind, match.end(), *match.span()))
    return sorted(found)


def candidates(text: str, base: list[tuple]) -> list[tuple[int, int, bool, bytes]]:
    """(start, end, random, digest) of the values of the base spans, and of loose keys."""
    values = {(first, last) for *_, first, last in base}
    covered = sorted((start, end) for start, _, end, _, _ in base)
    reach, upto = [], 0
    for start, end in covered:
        upto = max(upto, end)
        reach.append((start, upto))
    at = -1
    for match in LOOSE.finditer(text):
        start, end = match.span()
        while at + 1 < len(reach) and reach[at + 1][0] < end:
            at += 1
        free = at < 0 or reach[at][1] <= start
        if free and _is_loose_key(match[0]):
            values.add((start, end))
    return [
        (a, b, looks_random(text[a:b]), sha256(text[a:b].encode()).digest())
        for a, b in sorted(values)
    ]


def _likely(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts that can hold any span: all that do, and some that do not."""
    found = []
    for table, least in ((_HEX, LEAST_HEX), (_LOOSE, LOOSE_LENGTHS[0])):
        starts, ends, texts = A.runs(table[raw], offsets)
        found.append(texts[ends - starts >= least])
    whole = raw.tobytes()
    lower = whole.lower()
    places = []
    for name, text in ((b"AKIA", whole), *((name, lower) for name in _NAMES)):
        at = text.find(name)
        while at >= 0:
            places.append(at)
            at = text.find(name, at + len(name))
    found.append(A.owner(offsets, np.array(places, np.int64)))
    return np.unique(np.concatenate(found))


def _scan(batches):
    part, number = TaskContext.get().partitionId(), 0
    for piece, raw, offsets in A.pieces(batches, "text"):
        base: list[list] = [[] for _ in range(piece.num_rows)]
        values: list[list] = [[] for _ in range(piece.num_rows)]
        texts = piece.column("text")
        for row in _likely(raw, offsets).tolist():
            text = texts[row].as_py() or ""
            spans = base_spans(text)
            base[row] = [{"start": s, "kind": k, "end": e} for s, k, e, _, _ in spans]
            values[row] = [
                {"start": a, "end": b, "random": random, "digest": digest}
                for a, b, random, digest in candidates(text, spans)
            ]
        keys = [f"{part}-{number + n}" for n in range(piece.num_rows)]
        number += piece.num_rows
        kept = [piece.column(c) for c in ("row", "repository", "owner")]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys),
                *kept,
                pa.array(base, _SPANS),
                pa.array(values, _CANDIDATES),
            ],
            names=["key", "row", "repository", "owner", "base", "candidates"],
        )


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_CANDIDATES = pa.list_(
    pa.struct(
        [("start", pa.int64()), ("end", pa.int64()), ("random", pa.bool_()), ("digest", pa.binary())]
    )
)


def ownership(found: DataFrame) -> DataFrame:
    """(digest, n_rows, n_repositories, n_owners) of every candidate of the corpus."""
    n, pairs = F.count(F.lit(1)).alias("n_rows"), F.count(F.lit(1)).alias("n_repositories")
    return (
        found.select("owner", "repository", F.explode("candidates.digest").alias("digest"))
        .groupBy("digest", "owner", "repository")
        .agg(n)
        .groupBy("digest", "owner")
        .agg(F.sum("n_rows").alias("n_rows"), pairs)
        .groupBy("digest")
        .agg(
            F.sum("n_rows").alias("n_rows"),
            F.sum("n_repositories").alias("n_repositories"),
            F.count(F.lit(1)).alias("n_owners"),
        )
    )


def _verdicts(found: DataFrame, owned: DataFrame) -> DataFrame:
    """(key, more): the spans that the counts add to a document."""
    total = owned.agg(F.sum("n_rows")).first()[0] or 0
    frequent = F.col("n_rows") * SHARE > total
    rows = found.select("key", F.explode("candidates").alias("value")).select(
        "key", "value.start", "value.end", "value.random", "value.digest"
    )
    few = F.broadcast(owned.filter(frequent))  # at most SHARE rows
    copied = rows.join(few, "digest")
    rest = rows.join(F.broadcast(owned.filter(frequent).select("digest")), "digest", "left_anti")
    known = copied.unionByName(rest.join(owned.filter(~frequent), "digest"))
    kind = (
        F.when(F.col("n_owners") >= EXAMPLE_OWNERS, KINDS.index("example"))
        .when((F.col("n_owners") <= LIVE_OWNERS) & F.col("random"), KINDS.index("live"))
        .alias("kind")
    )
    spans = known.select("key", "start", kind, "end").filter("kind IS NOT NULL")
    return spans.groupBy("key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))


def scanned(
    docs: DataFrame,
    repository: Column | None = None,
    owner: Column | None = None,
    text: str = "text",
) -> DataFrame:
    """All columns of the documents but the text, and ``secrets``: (start, kind, end), by start.

    Places are code points, the end exclusive; kinds are numbers in ``KINDS``. A
    repository is by default the document's source, and its owner what comes before the
    first slash in that.
    """
    workers_can_import(docs.sparkSession)
    repository = docs["source"] if repository is None else repository
    owner = F.substring_index(repository, "/", 1) if owner is None else owner
    kept = [F.col(f"`{name}`") for name in docs.columns if name not in (text, "secrets")]
    rows = docs.select(
        F.struct(*kept).alias("row"),
        repository.cast("string").alias("repository"),
        owner.cast("string").alias("owner"),
        text_of(docs, text).alias("text"),
    )
    schema = (
        f"key string, row {rows.schema['row'].dataType.simpleString()}, repository string, "
        f"owner string, base array<{SPAN}>, candidates array<{CANDIDATE}>"
    )
    found = stored(rows.mapInArrow(_scan, schema), "secrets")
    with_values = found.filter(F.size("candidates") > 0)
    more = _verdicts(with_values, stored(ownership(with_values), "ownership"))
    judged = with_values.join(more, "key", "left").select(
        "row", F.array_sort(F.concat("base", F.coalesce("more", F.array()))).alias("secrets")
    )
    rest = found.filter(F.size("candidates") == 0).select("row", F.col("base").alias("secrets"))
    return judged.unionByName(rest).select("row.*", "secrets")


def _written(spans: Column) -> Column:
    """Spans as `kind:start:end`, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    each = F.transform(
        spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])
    )
    return F.array_join(each, ",")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, base spans per kind, their digest, all spans, and the verdicts per kind."""
    found = scanned(docs.select("doc_id", "source", "text"))

    def n(kind: str) -> Column:
        number = KINDS.index(kind)
        count = F.size(F.filter("secrets", lambda s: s["kind"] == number)).cast("long")
        return count.alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"] < len(BASE_KINDS))
    return found.select(
        "doc_id",
        *map(n, BASE_KINDS),
        F.sha2(_written(base), 256).alias("base_sha256"),
        _written(F.col("secrets")).alias("spans"),
        n("example"),
        n("live"),
    )
