"""Windows of units (words or bytes) dealt to buckets by their minimiser.

The minimiser of a window is the gram with the least hash in it. Equal windows have
the same minimiser at the same place, so windows meet all their equals if each goes
to the bucket of its minimiser. Consecutive windows that share one occurrence travel
together, as one string that holds them all: a super-k-mer. There are few of them,
and each has at most as many windows as a window has grams.

First only the minimisers' hashes and places are dealt: a super-k-mer whose minimiser
occurs once in the corpus cannot repeat. The others are cut out of the text, packed and
dealt, and compared by their bytes. In both rounds a map task settles what it can see
itself: of a minimiser that repeats inside the task it sends one occurrence, and of equal
strings only those that no earlier one in the task settles, so what reaches a bucket
of a hot passage is bounded by the number of tasks. Minimisers that a sample of the
documents shows in very many different strings are split: their windows are dealt one
by one, by a hash of the whole window. The sample decides only how windows travel,
never a result.

What is sent is packed into one compressed blob per task and bucket. A bucket is
small whatever the data: their number follows the bytes of text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm import arrays as A
from riskflow.llm.common import NULL_ID, tasks, text_of, workers_can_import

#: Bytes of text a map task gathers before it sends blobs.
GATHERED = 16 << 20
#: Bytes of text per bucket.
PER_BUCKET = 2 << 20
#: Documents looked at for frequent minimisers, and the different strings per document
#: that make one.
SAMPLED = 2048
FREQUENT = 0.02

_U = np.uint64
#: Place of a gram in the low bits, its hash in the others.
_PLACE = _U((1 << 28) - 1)
#: Instead of a minimiser's offset: a window of a frequent minimiser, dealt by itself.
_ALONE = 255


@dataclass
class Units:
    """The units of a piece of text: their bytes in ``flat``, and what is hashed."""

    flat: np.ndarray
    left: np.ndarray
    right: np.ndarray
    doc: np.ndarray
    grams: np.ndarray


@dataclass
class Runs:
    """Super-k-mers, one array entry each."""

    doc_id: np.ndarray
    tag: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    size: np.ndarray
    key: np.ndarray
    text: bytes

    def begins(self) -> np.ndarray:
        return np.cumsum(self.size) - self.size


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def find(units: Units, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window (by its first unit) and number of windows of every super-k-mer, and how
    far its minimiser is from its first unit."""
    none = np.zeros(0, np.int64)
    n = len(units.doc)
    if n < window:
        return none, none, none
    # Places are counted within stretches that their bits can number; each stretch begins
    # with the first window that the one before has no room for.
    wide = window - gram + 1
    step = int(_PLACE) + 2 - wide
    place = np.empty(n - window + 1, np.int64)
    for begin in range(0, len(place), step):
        hashes = units.grams[begin : min(begin + step, len(place)) + wide - 1]
        least = _least((hashes & ~_PLACE) | np.arange(len(hashes), dtype=_U), wide)
        place[begin : begin + step] = (least & _PLACE).astype(np.int64) + begin
    whole = units.doc[: n - window + 1] == units.doc[window - 1 :]
    opens = whole.copy()
    opens[1:] &= ~whole[:-1] | (place[1:] != place[:-1])
    closes = whole.copy()
    closes[:-1] &= ~whole[1:] | (place[1:] != place[:-1])
    first = np.flatnonzero(opens)
    return first, np.flatnonzero(closes) - first + 1, place[first] - first


def _keys(units: Units, first, offset, hasher: A.Hasher, window: int) -> np.ndarray:
    """What a super-k-mer is dealt by: its minimiser's hash, or that of its only window."""
    alone = offset == _ALONE
    keys = units.grams[first + np.where(alone, 0, offset)]
    at = first[alone]
    keys[alone] = hasher.spans(units.left[at], units.right[at + window - 1])
    return keys


def _split(first, windows, offset, key, hot):
    """Super-k-mers of frequent minimisers, window by window."""
    found = np.isin(key, hot) if len(hot) else np.zeros(len(key), bool)
    if not found.any():
        return first, windows, offset
    count = windows[found]
    alone = np.repeat(first[found] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return (
        np.concatenate((first[~found], alone)),
        np.concatenate((windows[~found], np.ones(len(alone), np.int64))),
        np.concatenate((offset[~found], np.full(len(alone), _ALONE))),
    )


def classes(text: bytes, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A number for each string, the same for equal strings, by their bytes."""
    known: dict[bytes, int] = {}
    ends = (begin + size).tolist()
    return np.fromiter(
        (known.setdefault(text[a:b], len(known)) for a, b in zip(begin.tolist(), ends, strict=True)),
        np.int64,
        len(begin),
    )


#: Says which occurrences an earlier one of the same class settles:
#: (class, doc_id, tag, start) -> mask.
Settled = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def earlier_document(cls, doc_id, tag, start):
    """Settled by the same content in a document with a smaller id."""
    order = np.lexsort((doc_id, cls))
    new = np.concatenate(([True], cls[order][1:] != cls[order][:-1])) if len(order) else order > 0
    least = doc_id[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    result = np.zeros(len(order), bool)
    result[order] = doc_id[order] > least
    return result


def earlier_start(cls, doc_id, tag, start):
    """Settled by the same content in an earlier document, or before it in the same one."""
    order = np.lexsort((start, tag, doc_id, cls))
    c, d, t, s = cls[order], doc_id[order], tag[order], start[order]
    result = earlier_document(cls, doc_id, tag, start)
    if len(order):
        new = np.concatenate(([True], (c[1:] != c[:-1]) | (d[1:] != d[:-1]) | (t[1:] != t[:-1])))
        least = s[np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))]
        result[order] |= s > least
    return result


def _blob(*columns: np.ndarray, text: bytes = b"") -> bytes:
    head = np.array([len(columns[0])], np.int64).tobytes()
    return zstandard.compress(b"".join([head, *(c.tobytes() for c in columns), text]), 1)


def _unblob(blob: bytes, types: list) -> tuple[list[np.ndarray], bytes]:
    data = zstandard.decompress(blob)
    n, at, columns = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
    for kind in types:
        columns.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return columns, data[at:]


_SEEN = [np.int64, np.uint32, np.int64, np.uint32]
_PLACES = [np.int64, np.uint32, np.int64]
_RUN = [np.int64, np.uint32, np.int32, np.uint8, np.int32, np.uint32]
_SPAN = [np.int64, np.uint32, np.int32, np.int32]
SPANS = "doc_id long, tag long, first long, length long"
BLOBS = "bucket int, kind int, blob binary"


def _longs(names: str, *columns) -> pa.RecordBatch:
    arrays = [pa.array(np.asarray(c).astype(np.int64)) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, names=names.split())


def _merged(doc_id, tag, first, length) -> list[np.ndarray]:
    """Spans of the same document that touch or overlap, as one."""
    order = np.lexsort((first, tag, doc_id))
    doc_id, tag, first, length = (np.asarray(c)[order].astype(np.int64) for c in (doc_id, tag, first, length))
    other = np.concatenate(([True], (doc_id[1:] != doc_id[:-1]) | (tag[1:] != tag[:-1])))
    # Ends so far; a new document begins above all ends of the one before.
    shift = np.cumsum(other) << 40
    end = np.maximum.accumulate(first + length + shift)
    new = other.copy()
    new[1:] |= first[1:] + shift[1:] > end[:-1]
    last = np.append(np.flatnonzero(new)[1:], len(new)) - 1
    return [doc_id[new], tag[new], first[new], (end - shift)[last] - first[new]]


class _Outbox:
    """Rows of (bucket, kind, blob), some at a time."""

    def __init__(self):
        self.rows = {"bucket": [], "kind": [], "blob": []}

    def put(self, bucket, kind, blob):
        for column, value in zip(self.rows.values(), (int(bucket), kind, blob), strict=True):
            column.append(value)

    def full(self, most=64):
        return len(self.rows["blob"]) >= most

    def take(self) -> pa.RecordBatch:
        types = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
        rows, self.rows = self.rows, {"bucket": [], "kind": [], "blob": []}
        return pa.RecordBatch.from_pydict(rows, schema=types)


def _by_bucket(key: np.ndarray, chosen: np.ndarray, buckets: int):
    """(bucket, entries) of the chosen entries."""
    bucket = (key[chosen] % _U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
        yield b, chosen[order[cuts[b] : cuts[b + 1]]]


def _rest(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key // _U(buckets)) & _U(0xFFFFFFFF)).astype(np.uint32)


def _several(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mask of the values that occur more than once, and of one occurrence of each value."""
    order = np.argsort(values, kind="stable")
    same = values[order][1:] == values[order][:-1]
    several, one = np.zeros(len(order), bool), np.ones(len(order), bool)
    several[order[1:][same]] = several[order[:-1][same]] = True
    one[order[1:][same]] = False
    return several, one


def _flushed(make: Callable, flush: Callable):
    """A map task that makes arrays of each piece of text and sends them some at a time."""

    def run(batches):
        held, size = [], 0
        for piece, raw, offsets in A.pieces(batches, "text"):
            made = make(piece, raw, offsets)
            if made is None:
                continue
            held.append(made)
            size += len(raw)
            if size >= GATHERED:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _ids(piece: pa.RecordBatch, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids = piece.column("doc_id").to_numpy(zero_copy_only=False)
    return ids[doc], piece.column("tag").to_numpy(zero_copy_only=False)[doc]


def _place_sender(read: Callable, window: int, gram: int, buckets: int, hot: np.ndarray):
    """Round one: the minimisers of all super-k-mers.

    A place is the first unit in its document, the number of windows and the minimiser's
    offset, in one number. Kind 0 is a bucket's (doc_id, tag, place, rest of the key);
    kind 1 has (doc_id, tag, place) of minimisers that are known to repeat.
    """

    def make(piece, raw, offsets):
        units = read(raw, offsets)
        first, windows, offset = find(units, window, gram)
        if not len(first):
            return None
        hasher = A.Hasher(units.flat)
        key = _keys(units, first, offset, hasher, window)
        if len(hot):
            first, windows, offset = _split(first, windows, offset, key, hot)
            key = _keys(units, first, offset, hasher, window)
        doc = units.doc[first]
        start = first - np.searchsorted(units.doc, doc)
        return *_ids(piece, doc), (start << 16) | ((windows - 1) << 8) | offset, key

    def flush(held):
        doc_id, tag, place, key = (np.concatenate(c) for c in zip(*held, strict=True))
        several, one = _several(key)
        box = _Outbox()
        if several.any():
            columns = zip((doc_id, tag, place), _PLACES, strict=True)
            blob = _blob(*(c[several].astype(t) for c, t in columns))
            box.put(np.bitwise_xor.reduce(key) % _U(buckets), 1, blob)
        rest = _rest(key, buckets)
        for b, mine in _by_bucket(key, np.flatnonzero(one), buckets):
            columns = zip((doc_id, tag, place, rest), _SEEN, strict=True)
            box.put(b, 0, _blob(*(c[mine].astype(t) for c, t in columns)))
            if box.full():
                yield box.take()
        yield box.take()

    return _flushed(make, flush)


def _buckets(batches, types: dict[int, list], on_kind_one: Callable, on_bucket: Callable):
    """Reads blobs sorted by bucket; a bucket's kind 0 blobs are handed over together."""
    held, bucket = [], None
    for batch in batches:
        for b, kind, blob in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if b != bucket and held:
                yield from on_bucket(held)
                held = []
            bucket = b
            if kind == 1:
                yield on_kind_one(_unblob(blob, types[1])[0])
            else:
                held.append(_unblob(blob, types[0]))
    if held:
        yield from on_bucket(held)


def _place_receiver(batches):
    """Round one: places of the minimisers that occur more than once."""

    def known(columns):
        return _longs("doc_id tag place", *columns)

    def settle(blobs):
        *columns, key = (np.concatenate(c) for c in zip(*(b[0] for b in blobs), strict=True))
        several, _ = _several(key)
        if several.any():
            yield known([c[several] for c in columns])

    yield from _buckets(batches, {0: _SEEN, 1: _PLACES}, known, settle)


def _sender(read: Callable, window: int, settled: Settled, buckets: int):
    """Round two: the super-k-mers at the places that round one found.

    Kind 0 is a bucket's super-k-mers with their strings; kind 1 has spans that are settled.
    """

    def make(piece, raw, offsets):
        units = read(raw, offsets)
        lists = piece.column("places")
        place = lists.flatten().to_numpy()
        doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
        doc, place = np.unique(np.stack((doc, place)), axis=1)
        first = (place >> 16) + np.searchsorted(units.doc, doc)
        windows, offset = ((place >> 8) & 255) + 1, place & 255
        hasher = A.Hasher(units.flat)
        key = _keys(units, first, offset, hasher, window)
        left, right = units.left[first], units.right[first + windows + window - 2]
        content = hasher.spans(left, right)
        doc_id, tag = _ids(piece, doc)
        return doc_id, tag, place >> 16, windows, right - left, key, content, left, units.flat

    def flush(held):
        *columns, left, flats = zip(*held, strict=True)
        doc_id, tag, start, windows, size, key, content = map(np.concatenate, columns)
        base = np.cumsum([0] + [len(t) for t in flats])[:-1]
        begin = np.concatenate([at + b for at, b in zip(left, base, strict=True)])
        whole = b"".join(t.tobytes() for t in flats)
        # Only strings whose hash is not alone can be equal to another one.
        some = np.flatnonzero(_several(content)[0])
        cls = classes(whole, begin[some], size[some])
        done = np.zeros(len(key), bool)
        done[some] = settled(cls, doc_id[some], tag[some], start[some])
        box = _Outbox()
        if done.any():
            span = _merged(*(c[done] for c in (doc_id, tag, start, windows + window - 1)))
            blob = _blob(*(c.astype(t) for c, t in zip(span, _SPAN, strict=True)))
            box.put(np.bitwise_xor.reduce(content) % _U(buckets), 1, blob)
        flat, rest = np.frombuffer(whole, np.uint8), _rest(key, buckets)
        for b, mine in _by_bucket(key, np.flatnonzero(~done), buckets):
            n = size[mine]
            take = np.repeat(begin[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            columns = zip((doc_id, tag, start, windows, size, rest), _RUN, strict=True)
            columns = [c[mine].astype(kind) for c, kind in columns]
            box.put(b, 0, _blob(*columns, text=flat[take].tobytes()))
            if box.full():
                yield box.take()
        yield box.take()

    return _flushed(make, flush)


def _receiver(compare: Callable, window: int, settled: Settled):
    """Round two: spans that windows of a bucket settle."""

    def spans(columns):
        return _longs("doc_id tag first length", *columns)

    def settle(blobs):
        columns = (np.concatenate(c) for c in zip(*(b[0] for b in blobs), strict=True))
        doc_id, tag, start, windows, size, key = columns
        text = b"".join(b[1] for b in blobs)
        start, windows, size = (c.astype(np.int64) for c in (start, windows, size))
        begin = np.cumsum(size) - size
        some = np.flatnonzero(_several(key)[0])
        if not len(some):
            return
        doc_id, tag, start, windows, size, key, begin = (
            c[some] for c in (doc_id, tag, start, windows, size, key, begin)
        )
        cls = classes(text, begin, size)
        done = settled(cls, doc_id, tag, start)
        if done.any():
            span = (doc_id, tag, start, windows + window - 1)
            yield spans(_merged(*(c[done] for c in span)))
        # What is left: minimisers whose strings differ.
        rest = np.flatnonzero(~done)
        rest = rest[np.argsort(key[rest], kind="stable")]
        if not len(rest):
            return
        group = np.unique(key[rest], return_inverse=True)[1]
        kinds = np.unique(np.stack((group, cls[rest])), axis=1)[0]
        rest = rest[(np.bincount(kinds) > 1)[group]]
        if not len(rest):
            return
        n = size[rest]
        take = np.repeat(begin[rest] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        content = np.frombuffer(text, np.uint8)[take].tobytes()
        runs = Runs(*(c[rest] for c in (doc_id, tag, start, windows, size, key)), content)
        # (run, window in it, class of the window): equal classes are equal windows.
        run, at, window_class = compare(runs, window)
        hit = settled(window_class, runs.doc_id[run], runs.tag[run], runs.start[run] + at)
        if hit.any():
            run, at = run[hit], at[hit]
            span = (runs.doc_id[run], runs.tag[run], runs.start[run] + at, np.full(len(run), window))
            yield spans(_merged(*span))

    def run(batches):
        yield from _buckets(batches, {0: _RUN, 1: _SPAN}, spans, settle)

    return run


def _frequent(rows: DataFrame, read: Callable, window: int, gram: int, count: int) -> np.ndarray:
    """Hashes of the minimisers that stand in many different strings of a sample.

    Each takes at least ``FREQUENT`` strings per sampled document, so there are no more
    of them than a document has super-k-mers on average, divided by FREQUENT. Copies
    of a string count once: the map tasks join them anyway.
    """
    chosen = rows
    if count > SAMPLED:
        chosen = rows.filter(F.pmod(F.xxhash64("doc_id", "tag"), F.lit(count // SAMPLED)) == 0)

    def keys(batches):
        for piece, raw, offsets in A.pieces(batches, "text"):
            units = read(raw, offsets)
            first, windows, offset = find(units, window, gram)
            key = units.grams[first + offset]
            left, right = units.left[first], units.right[first + windows + window - 2]
            content = A.Hasher(units.flat).spans(left, right)
            pairs = np.unique(np.stack((key, content)), axis=1).view(np.int64)
            yield pa.RecordBatch.from_pydict({"key": pairs[0], "content": pairs[1]})

    least = max(8, int(FREQUENT * min(count, SAMPLED)))
    strings = chosen.mapInArrow(keys, "key long, content long").distinct()
    found = strings.groupBy("key").count().filter(F.col("count") >= least)
    return np.array([r["key"] for r in found.select("key").collect()], np.int64).view(_U)


def identified(docs: DataFrame, text: str, id: str) -> DataFrame:
    """(doc_id, tag, text): a null id sorts first; the tag tells apart texts that share an id."""
    words = text_of(docs, text)
    rows = docs.select(
        F.coalesce(docs[id].cast("long"), F.lit(NULL_ID)).alias("doc_id"), words.alias("text")
    )
    # Where every id stands alone, as it should, tags need not travel.
    shared = rows.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    tag = F.crc32(F.encode("text", "UTF-8")) if shared else F.lit(0).cast("long")
    return rows.select("doc_id", tag.alias("tag"), "text")


def repeated_spans(
    rows: DataFrame, read: Callable, compare: Callable, window: int, gram: int, settled: Settled
) -> DataFrame:
    """Spans (doc_id, tag, first, length) of units that settled windows cover; they overlap.

    ``rows`` come from ``identified``. ``read`` makes Units of a piece of text, ``compare``
    puts the windows of the Runs it is given into classes of equal ones.
    """
    spark = workers_can_import(rows.sparkSession)
    facts = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    parts = max(tasks(spark), int((facts[1] or 0) // (4 * PER_BUCKET)))
    buckets = 4 * parts
    hot = _frequent(rows, read, window, gram, facts[0])

    def dealt(blobs):
        return blobs.repartition(parts, "bucket").sortWithinPartitions("bucket")

    seen = rows.mapInArrow(_place_sender(read, window, gram, buckets, hot), BLOBS)
    places = (
        dealt(seen)
        .mapInArrow(_place_receiver, "doc_id long, tag long, place long")
        .groupBy("doc_id", "tag")
        .agg(F.collect_list("place").alias("places"))
    )
    sent = rows.join(places, ["doc_id", "tag"]).mapInArrow(
        _sender(read, window, settled, buckets), BLOBS
    )
    return dealt(sent).mapInArrow(_receiver(compare, window, settled), SPANS)


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Adds ``spans``, an array of (first, length), to the identified rows; null if there are none."""
    lists = spans.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("first", "length")).alias("spans"))
    return rows.join(lists, ["doc_id", "tag"], "left")


def covered(column: pa.Array, zeros: np.ndarray, n: int) -> np.ndarray:
    """Mask of ``n`` units; the spans of document k count from zeros[k]."""
    change = np.zeros(n + 1, np.int64)
    lists = column if isinstance(column, pa.Array) else column.combine_chunks()
    flat = lists.flatten()
    if len(flat):
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        first = flat.field("first").to_numpy() + np.repeat(zeros, sizes)
        np.add.at(change, first, 1)
        np.add.at(change, first + flat.field("length").to_numpy(), -1)
    return np.cumsum(change[:-1]) > 0


SPAN_LIST = "array<struct<first: long, end: long>>"


def edges_by_document(mask: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First unit and last unit of every run of set units inside one document."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    apart = doc[1:] != doc[:-1]
    opens, closes = mask.copy(), mask.copy()
    opens[1:] &= ~mask[:-1] | apart
    closes[:-1] &= ~mask[1:] | apart
    return np.flatnonzero(opens), np.flatnonzero(closes)


def span_lists(first, last, doc, zeros) -> pa.Array:
    """Runs as one list of (first, end) per document, counted from its first unit."""
    owner = doc[first]
    cuts = np.searchsorted(owner, np.arange(len(zeros)))
    spans = pa.StructArray.from_arrays(
        [pa.array(first - zeros[owner]), pa.array(last + 1 - zeros[owner])], names=["first", "end"]
    )
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), spans)
