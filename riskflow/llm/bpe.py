"""Byte-level BPE by merge replay over pieces of the corpus, and back.

A text is split by the pre-tokenizer's pattern. All new words of a piece are laid
out as one row of tokens with links to their neighbours, and an inverted index
says for each rank where a pair of neighbours would merge to it. The merges are
replayed over the whole row in rank order; a merge looks only at the places in its
own index entry and updates only the neighbours it touched. A word never merges
into the next one, so the row gives every word what it would give alone.

Words met before are looked up. The memory of a worker is bounded: its table is
emptied when it is full, and long words are not kept at all.

Defined cases: a null or empty text has no tokens and decodes to no bytes; null ids
decode to no bytes; rows that repeat are encoded each for itself; an empty table
gives an empty result. ``encoded`` and ``decoded`` replace columns of the name of
their output; all other columns pass through.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from hashlib import sha256
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm import arrays as A
from riskflow.llm.common import free_name, text_of, workers_can_import

#: Words a worker remembers, and the longest one worth it, in characters.
REMEMBERED = 800_000
LONGEST = 48
#: Tokens that are decoded at once.
AT_ONCE = 1 << 16
#: Bits of a token's rank in a pair; what stands for a token that was merged away.
_SHIFT = 24
_GONE = -1


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank of every token, from lines of base64 and rank. Read by the driver."""
    lines = (line.split() for line in Path(path).read_bytes().splitlines())
    return {base64.b64decode(token): int(rank) for token, rank in lines}


def merge_table(ranks: dict[bytes, int]) -> dict[int, int]:
    """The rank that two tokens merge to, by their ranks: left shifted, or'ed with right."""
    return {
        ranks[token[:cut]] << _SHIFT | ranks[token[cut:]]: rank
        for token, rank in ranks.items()
        for cut in range(1, len(token))
        if token[:cut] in ranks and token[cut:] in ranks
    }


def replay(
    words: list[bytes], ranks: dict[bytes, int], merges: dict[int, int]
) -> list[tuple[int, ...]]:
    """The tokens of every word."""
    single = [ranks.get(bytes([b])) for b in range(256)]
    tokens: list[int] = []
    after: list[int] = []
    before: list[int] = []
    first = []
    places: dict[int, list[int]] = {}
    get = merges.get
    pairs = [
        get(left << _SHIFT | right) if None not in (left, right) else None
        for left in single
        for right in single
    ]
    for word in words:
        begin = len(tokens)
        first.append(begin)
        own = ranks.get(word)
        letters = [single[b] for b in word] if own is None else [own]
        end = begin + len(letters)
        tokens += letters
        after += range(begin + 1, end)
        after.append(-1)
        before.append(-1)
        before += range(begin, end - 1)
        if own is not None:
            continue
        at = begin
        left = word[0]
        for right in word[1:]:
            rank = pairs[left << 8 | right]
            if rank is not None:
                if rank in places:
                    places[rank].append(at)
                else:
                    places[rank] = [at]
            left = right
            at += 1

    queue = list(places)
    heapq.heapify(queue)
    push, pop = heapq.heappush, heapq.heappop
    while queue:
        rank = pop(queue)
        found = places.pop(rank, None)
        if found is None:
            continue
        found.sort()
        for done, at in enumerate(found):
            right = after[at]
            # Gone, or changed since it was noted.
            if right < 0 or get(tokens[at] << _SHIFT | tokens[right]) != rank:
                continue
            following, previous = after[right], before[at]
            tokens[at] = rank
            tokens[right] = after[right] = _GONE
            after[at] = following
            lowest = rank
            if following >= 0:
                before[following] = at
                new = get(rank << _SHIFT | tokens[following])
                if new is not None:
                    if new in places:
                        places[new].append(at)
                    else:
                        places[new] = [at]
                        push(queue, new)
                    if new < lowest:
                        lowest = new
            if previous >= 0:
                new = get(tokens[previous] << _SHIFT | rank)
                if new is not None:
                    if new in places:
                        places[new].append(previous)
                    else:
                        places[new] = [previous]
                        push(queue, new)
                    if new < lowest:
                        lowest = new
            if lowest < rank:
                # An earlier merge became possible: it goes before the rest of this one.
                places.setdefault(rank, []).extend(found[done + 1 :])
                push(queue, rank)
                break

    # What is left of a word is between its first place and the next word's.
    left = list(chain(first, [len(tokens)]))
    return [
        tuple([t for t in tokens[a:b] if t >= 0]) for a, b in zip(left[:-1], left[1:], strict=True)
    ]


#: Per worker process, by vocabulary: the merges, and the tokens of words as 32-bit numbers.
_known: dict[str, tuple[dict[int, int], dict[str, bytes]]] = {}


def _lists(texts: list[str], pattern, ranks: dict[bytes, int], key: str) -> pa.Array:
    """The token ids of every text."""
    if key not in _known:
        _known[key] = merge_table(ranks), {}
    merges, known = _known[key]
    if len(known) > REMEMBERED:
        known.clear()
    split = [pattern.findall(text) for text in texts]
    new = [word for word in set(chain.from_iterable(split)) if word not in known]
    tokens = replay([word.encode() for word in new], ranks, merges)
    known.update(zip(new, (array("i", one).tobytes() for one in tokens), strict=True))
    rows = [b"".join(map(known.__getitem__, parts)) for parts in split]
    for word in new:
        if len(word) > LONGEST:
            del known[word]
    ends = np.cumsum([0, *map(len, rows)]) // 4
    values = np.frombuffer(b"".join(rows), np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


class _Decoder:
    """The bytes that lists of ids stand for, gathered from all tokens' bytes in one row."""

    def __init__(self, ranks: dict[bytes, int]):
        vocabulary = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            vocabulary[rank] = token
        self.lengths = np.array([len(token) for token in vocabulary], np.int32)
        self.starts = np.cumsum(self.lengths, dtype=np.int32) - self.lengths
        self.row = np.frombuffer(b"".join(vocabulary), np.uint8)

    def gather(self, ids: np.ndarray) -> bytes:
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes, dtype=np.int32)
        take = np.repeat(self.starts[ids] - (ends - sizes), sizes)
        take += np.arange(len(take), dtype=np.int32)
        return self.row[take].tobytes()

    def texts(self, column: pa.Array) -> pa.Array:
        ids = column.flatten().to_numpy(zero_copy_only=False)
        joined = b"".join(
            self.gather(ids[first : first + AT_ONCE]) for first in range(0, len(ids), AT_ONCE)
        )
        counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
        ends = np.concatenate(([0], np.cumsum(self.lengths[ids], dtype=np.int64)))
        cuts = ends[np.concatenate(([0], np.cumsum(counts)))].tolist()
        parts = [joined[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.array(parts, pa.binary())


def _schema(df: DataFrame, *new: str) -> str:
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return ", ".join([*fields, *new])


def encoded(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    text: str = "text",
    ids: str = "ids",
    data: str | None = None,
    keep_text: bool = True,
) -> DataFrame:
    """All columns of the documents and ``ids``, the tokens of the whole text.

    With ``data`` the ids are decoded too, into a column of that name, by the same worker.
    Without ``keep_text`` the text is left out, and so not sent back.
    """
    spark = workers_can_import(docs.sparkSession).sparkContext
    shared = spark.broadcast((ranks, pattern))
    key = sha256(b"\n".join([pattern.encode(), *sorted(ranks, key=ranks.get)])).hexdigest()
    new = [ids] if data is None else [ids, data]
    own = free_name(docs, "_text")
    rest = docs.drop(*new) if keep_text else docs.drop(*new, text)
    kept = [docs[f"`{name}`"] for name in rest.columns]

    def encode(batches):
        ranks, pattern = shared.value
        split = regex.compile(pattern)
        decoder = _Decoder(ranks)
        for piece, _, _ in A.pieces(batches, own):
            columns = [piece.column(c) for c in range(piece.num_columns - 1)]
            texts = [t or "" for t in piece.column(own).to_pylist()]
            columns.append(_lists(texts, split, ranks, key))
            if data is not None:
                columns.append(decoder.texts(columns[-1]))
            yield pa.RecordBatch.from_arrays(columns, names=[*piece.schema.names[:-1], *new])

    kinds = [f"`{ids}` array<int>", f"`{data}` binary"]
    return docs.select(*kept, text_of(docs, text).alias(own)).mapInArrow(
        encode, _schema(rest, *kinds[: len(new)])
    )


def decoded(
    docs: DataFrame, ranks: dict[bytes, int], ids: str = "ids", data: str = "decoded"
) -> DataFrame:
    """All columns of the documents and ``data``, the bytes that the ids stand for."""
    spark = workers_can_import(docs.sparkSession).sparkContext
    shared = spark.broadcast(ranks)
    rest = docs.drop(data)
    at = rest.columns.index(ids)

    def decode(batches):
        decoder = _Decoder(shared.value)
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                piece = batch.slice(first, 64)
                columns = [piece.column(c) for c in range(piece.num_columns)]
                columns.append(decoder.texts(piece.column(at)))
                yield pa.RecordBatch.from_arrays(columns, names=[*piece.schema.names, data])

    return rest.mapInArrow(decode, _schema(rest, f"`{data}` binary"))


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the decoded bytes."""
    rows = docs.select("doc_id", "text")
    both = encoded(rows, ranks, pattern, data="decoded", keep_text=False)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
