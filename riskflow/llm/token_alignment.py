"""Which tokens of two tokenizers cover the same bytes, and how often id pairs meet.

Both tokenizers encode a space and the text. Places where a token of either ends cut
the two token lists into groups; the last tokens of a group end together and are
linked. The places are found by diagonal run skipping: as long as the two lists of ends
agree at the current shift of indexes, windows of 2, 4, 8, ... ends are compared at
once, and the window in which they part is halved; there the side that is behind is
advanced until the ends meet again, which sets the next shift.

Pairs of ids are counted over the whole corpus. Of two tokens that end together one is
the end of the other, so there are at most as many different pairs as the vocabularies
have ends of tokens, whatever the corpus: ``pair_bound``. Only that table is broadcast.

Both tokenizers cut a text before a single space between two visible characters. So a
long text is cut there, and no more than about ``CHUNK`` characters are held at once (a
text without such places is handled whole), and the words between such cuts are encoded
once and then remembered by their worker, whose memory is bounded. A tokenizer for which
that is not certain (see ``cuts``) gets whole texts.

Defined cases: a null or empty text has no tokens, and so has a text that the joined
tokens of either side do not give back (such as one with U+2581, which one vocabulary
uses for the space); rows that repeat are handled each for itself, and their links all
count; an empty table gives an empty result; rows with a null id keep it. ``aligned``
replaces columns of the name of its outputs and passes all others through.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from hashlib import sha256
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm import arrays as A
from riskflow.llm.common import stored, text_of, workers_can_import

#: Characters of one text that are encoded and aligned at once.
CHUNK = 1 << 19
#: Words a worker remembers, and the longest one worth it, in characters.
REMEMBERED = 400_000
LONGEST = 48
#: A space that both tokenizers put at the start of a token.
_SAFE = re.compile(r"(?<=[\w!-~]) (?=[\w!-~])")
#: A text that can stand between two such spaces.
_WHOLE = re.compile(r"[\w!-~](.*[\w!-~])?", re.DOTALL)

BYTE_LEVEL = "byte level"
PIECES = "pieces"


@dataclass(frozen=True)
class Vocabulary:
    """The content of a tokenizer file: small, read by the driver, sent to the workers."""

    kind: str
    data: bytes


def byte_level(path: str) -> Vocabulary:
    """A byte-level BPE in the JSON format of the tokenizers library."""
    return Vocabulary(BYTE_LEVEL, Path(path).read_bytes())


def pieces(path: str) -> Vocabulary:
    """A sentencepiece model that adds the space itself."""
    return Vocabulary(PIECES, Path(path).read_bytes())


@dataclass
class _Tokenizer:
    """``encode`` takes texts without the space before them; ``tokens`` has each id's bytes.

    ``joins`` says that a call costs more than a short text, and that texts which begin
    and end visibly may be encoded as one, with the space before each between them.
    """

    encode: Callable[[list[str]], list[list[int]]]
    tokens: list[bytes]
    cuts: bool
    joins: bool

    @cached_property
    def lengths(self) -> np.ndarray:
        return np.array([len(token) for token in self.tokens], np.int64)


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write visible Latin-1 bytes as themselves, others from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(others)}


def _read_byte_level(data: bytes) -> _Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    spec = json.loads(data)
    tokenizer = Tokenizer.from_str(data.decode())
    tokenizer.encode_special_tokens = True
    letters = _byte_of_letter()
    tokens = [b""] * tokenizer.get_vocab_size()
    for token, rank in spec["model"]["vocab"].items():
        tokens[rank] = bytes(map(letters.__getitem__, token)) if set(token) <= letters.keys() else b""

    def encode(texts: list[str]) -> list[list[int]]:
        spaced = [" " + text for text in texts]
        found = tokenizer.encode_batch_fast(spaced, add_special_tokens=False)
        return [encoding.ids for encoding in found]

    before = spec.get("pre_tokenizer") or {}
    cuts = before.get("type") == "ByteLevel" and before.get("use_regex") and not spec["normalizer"]
    return _Tokenizer(encode, tokens, bool(cuts), bool(cuts))


def _read_pieces(data: bytes) -> _Tokenizer:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_proto=data)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    tokens = [
        bytes([int(name[1:-1], 16)]) if model.is_byte(i) else name.replace("▁", " ").encode()
        for i, name in enumerate(names)
    ]
    # No token goes on across a space, and nothing is rewritten.
    cuts = not any("▁" in name.lstrip("▁") for name in names)
    cuts = cuts and model.normalize("a  ﬁ ") == "▁a▁▁ﬁ▁"
    return _Tokenizer(lambda texts: model.encode(texts, num_threads=1), tokens, cuts, False)


#: Per worker process, by digest of the file.
_built: dict[str, _Tokenizer] = {}


def _tokenizer(vocabulary: Vocabulary) -> _Tokenizer:
    key = vocabulary.kind + sha256(vocabulary.data).hexdigest()
    if key not in _built:
        read = {BYTE_LEVEL: _read_byte_level, PIECES: _read_pieces}[vocabulary.kind]
        _built[key] = read(vocabulary.data)
    return _built[key]


#: Per worker process, by the two tokenizers, which stay.
_lexicons: dict[tuple[int, int], _Lexicon] = {}


def _lexicon(left: Vocabulary, right: Vocabulary) -> _Lexicon:
    sides = _tokenizer(left), _tokenizer(right)
    key = id(sides[0]), id(sides[1])
    if key not in _lexicons:
        _lexicons[key] = _Lexicon(*sides)
    return _lexicons[key]


def pair_bound(left: Vocabulary, right: Vocabulary) -> int:
    """How many different pairs of ids can end together, in any corpus."""
    counts: list[dict[bytes, int]] = []
    for side in (left, right):
        same: dict[bytes, int] = {}
        for token in _tokenizer(side).tokens:
            same[token] = same.get(token, 0) + 1
        counts.append(same)

    def ends(longer: dict[bytes, int], shorter: dict[bytes, int], first: int) -> int:
        return sum(
            n * shorter.get(token[cut:], 0)
            for token, n in longer.items()
            for cut in range(first, len(token))
        )

    return ends(counts[0], counts[1], 0) + ends(counts[1], counts[0], 1)


def common_ends(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes at which two ascending lists agree, both lists having the same last value."""
    a, b = left.tolist(), right.tolist()
    # Different values stop a run at the end of the lists.
    a.append(-1)
    b.append(-2)
    raw_a, raw_b = left.astype(np.int64).tobytes(), right.astype(np.int64).tobytes()
    size_a, size_b = len(raw_a), len(raw_b)
    firsts, shifts, lengths = [], [], []
    i = j = 0
    last = len(left)
    while i < last:
        # An irregular group: the side that is behind goes on until the ends meet.
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        begin = i
        i += 1
        j += 1
        # One to one from here: jump by windows that double, then halve.
        width = 1
        while a[i] == b[j]:
            i += 1
            j += 1
            width *= 2
            p, q, n = 8 * i, 8 * j, 8 * width
            if p + n > size_a or q + n > size_b or raw_a[p : p + n] != raw_b[q : q + n]:
                while width > 1:
                    width //= 2
                    p, q, n = 8 * i, 8 * j, 8 * width
                    if p + n <= size_a and q + n <= size_b and raw_a[p : p + n] == raw_b[q : q + n]:
                        i += width
                        j += width
                break
            i += width
            j += width
        firsts.append(begin)
        shifts.append(j - i)
        lengths.append(i - begin)
    n = np.array(lengths, np.int64)
    start = np.array(firsts, np.int64) - (np.cumsum(n) - n)
    at = np.repeat(start, n) + np.arange(n.sum())
    return at, at + np.repeat(np.array(shifts, np.int64), n)


@dataclass(frozen=True)
class _Part:
    """Some texts, or pieces of one, with their tokens one after the other.

    ``rows`` has the document of each text, ``ends_a`` and ``ends_b`` where its tokens
    end; ``last_a`` and ``last_b`` are the last tokens of each group. A text that the
    tokens do not give back has none.
    """

    rows: list[int]
    ids_a: np.ndarray
    ids_b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    last_a: np.ndarray
    last_b: np.ndarray
    broken: set[int]


def _chunks(text: str, cuts: bool) -> list[str]:
    """The text in pieces, each without the space before it."""
    found, begin = [], 0
    while cuts and len(text) - begin > CHUNK:
        cut = _SAFE.search(text, begin + CHUNK)
        if cut is None:
            break
        found.append(text[begin : cut.start()])
        begin = cut.end()
    return [*found, text[begin:]]


def _in_bytes(words: list[str]) -> list[bytes]:
    """Each word encoded, by one call for all if a zero byte can stand between them."""
    found = "\0".join(words).encode().split(b"\0")
    return found if len(found) == len(words) else [word.encode() for word in words]


def _encoded(
    words: list[str], raw: list[bytes], odd: int, side: _Tokenizer
) -> tuple[list[bytes], set[int]]:
    """Each word's ids as 32-bit numbers, and the places of words they do not give back.

    The last ``odd`` words may end invisibly.
    """
    plain = len(words) - odd
    get = side.tokens.__getitem__
    tokens = sizes = np.zeros(0, np.int64)
    lists = side.encode(words[plain:] if side.joins and plain else words)
    if side.joins and plain:
        joined = side.encode([" ".join(words[:plain])])[0]
        tokens = np.fromiter(joined, np.int64, len(joined))
        stops = np.cumsum(np.fromiter(map(len, raw[:plain]), np.int64, plain) + 1)
        cuts = np.searchsorted(np.cumsum(side.lengths[tokens]), stops) + 1
        sizes = np.diff(cuts, prepend=0)
    tokens = np.concatenate([tokens, np.fromiter(chain.from_iterable(lists), np.int64)])
    sizes = np.concatenate([sizes, np.fromiter(map(len, lists), np.int64, len(lists))])
    every, spans = tokens.tolist(), _spans(np.cumsum(sizes))
    broken = set()
    if b"".join(map(get, every)) != b" " + b" ".join(raw):
        for n, ((begin, end), word) in enumerate(zip(spans, raw, strict=True)):
            if b"".join(map(get, every[begin:end])) != b" " + word:
                broken.add(n)
    packed = tokens.astype(np.int32).tobytes()
    return [packed[4 * begin : 4 * end] for begin, end in spans], broken


class _Lexicon:
    """The ids of words met before, of both sides; emptied when it is full."""

    def __init__(self, left: _Tokenizer, right: _Tokenizer):
        self.tokenizers = left, right
        self.cuts = left.cuts and right.cuts
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.ids: tuple[list[bytes], list[bytes]] = [], []
        self.broken: set[int] = set()

    def split(self, text: str) -> list[str]:
        # Where both tokenizers cut, a word has the same tokens wherever it stands.
        return _SAFE.split(text) if self.cuts else [text]

    def learn(self, words: list[list[str]]) -> list[str]:
        """Encodes the words that are new, and returns them."""
        if len(self.places) > REMEMBERED:
            self.clear()
        # Only the first and the last word of a text can have an invisible end.
        ends = {word for one in words for word in (one[0], one[-1])}
        odd = {word for word in ends if not (self.cuts and _WHOLE.fullmatch(word))}
        different = dict.fromkeys(chain.from_iterable(words))
        new = [w for w in different if w not in self.places and w not in odd]
        odd -= self.places.keys()
        new += sorted(odd)
        if new:
            raw, first = _in_bytes(new), len(self.ids[0])
            for known, side in zip(self.ids, self.tokenizers, strict=True):
                packed, broken = _encoded(new, raw, len(odd), side)
                known += packed
                self.broken |= {first + n for n in broken}
            self.places.update(zip(new, range(first, first + len(new)), strict=True))
        return new

    def forget(self, words: list[str]) -> None:
        """Long words are not worth their place."""
        for word in words:
            if len(word) > LONGEST:
                place = self.places.pop(word)
                self.broken.discard(place)
                for known in self.ids:
                    known[place] = b""


def _part(rows: list[int], texts: list[str], lexicon: _Lexicon) -> _Part:
    words = [lexicon.split(text) for text in texts]
    new = lexicon.learn(words)
    codes = list(map(lexicon.places.__getitem__, chain.from_iterable(words)))
    owner = np.repeat(np.arange(len(texts)), [len(one) for one in words])
    broken: set[int] = set()
    if lexicon.broken:
        bad = np.isin(codes, list(lexicon.broken))
        broken = set(owner[bad].tolist())
        whole = ~np.isin(owner, list(broken))
        codes, owner = np.array(codes)[whole].tolist(), owner[whole]
    flat, ends, stops = [], [], []
    for known, side in zip(lexicon.ids, lexicon.tokenizers, strict=True):
        found = list(map(known.__getitem__, codes))
        flat.append(np.frombuffer(b"".join(found), np.int32).astype(np.int64))
        stops.append(np.cumsum(side.lengths[flat[-1]]))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ends.append(np.cumsum(np.bincount(owner, sizes, minlength=len(texts)).astype(np.int64)))
    last = common_ends(*stops) if codes else (np.zeros(0, np.int64),) * 2
    lexicon.forget(new)
    return _Part(rows, *flat, *ends, *last, {rows[n] for n in broken})


def _parts(texts: list[str | None], lexicon: _Lexicon) -> Iterator[_Part]:
    """The texts in order, many short ones or a piece of a long one at a time."""
    rows, waiting, held = [], [], 0
    for row, text in enumerate(texts):
        for chunk in _chunks(text, lexicon.cuts) if text else ():
            rows.append(row)
            waiting.append(chunk)
            held += len(chunk)
            if held >= CHUNK:
                yield _part(rows, waiting, lexicon)
                rows, waiting, held = [], [], 0
    if rows:
        yield _part(rows, waiting, lexicon)


def _spans(ends: np.ndarray) -> list[tuple[int, int]]:
    stops = ends.tolist()
    return list(zip([0, *stops[:-1]], stops, strict=True))


def _lists(parts: list[np.ndarray], kind=np.int32) -> pa.Array:
    ends = pa.array(np.cumsum([0, *map(len, parts)]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *parts]).astype(kind)))


def _batches(batches, text: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for piece, _, _ in A.pieces(batches, text):
        yield piece, piece.column(text).to_pylist()


def _readable(docs: DataFrame, text: str, drop: list[str]) -> DataFrame:
    """All columns as one struct beside the text, so that no name can clash."""
    kept = [F.col(f"`{name}`") for name in docs.columns if name not in drop]
    return docs.select(F.struct(*kept).alias("row"), text_of(docs, text).alias("text"))


def aligned(
    docs: DataFrame, left: Vocabulary, right: Vocabulary, text: str = "text"
) -> DataFrame:
    """All columns of the documents, the ids of both sides, and the groups.

    ``ids_a`` and ``ids_b`` are the tokens; ``last_a`` and ``last_b`` the indexes of the
    last token of each group in them, so that group g is ``ids_a[last_a[g-1]+1 : last_a[g]+1]``
    with the same of b, and its last tokens are linked.
    """
    spark = workers_can_import(docs.sparkSession).sparkContext
    shared = spark.broadcast((left, right))
    new = ["ids_a", "ids_b", "last_a", "last_b"]
    rows = _readable(docs, text, new)

    def align(batches):
        lexicon = _lexicon(*shared.value)
        for piece, texts in _batches(batches, "text"):
            found = [[[np.zeros(0, np.int64)] for _ in texts] for _ in new]
            sizes = np.zeros((2, len(texts)), np.int64)
            broken = set()
            for part in _parts(texts, lexicon):
                broken |= part.broken
                groups = np.searchsorted(part.last_a, part.ends_a).tolist()
                begin = 0
                for r, (a0, a1), (b0, b1), end in zip(
                    part.rows, _spans(part.ends_a), _spans(part.ends_b), groups, strict=True
                ):
                    found[0][r].append(part.ids_a[a0:a1])
                    found[1][r].append(part.ids_b[b0:b1])
                    found[2][r].append(part.last_a[begin:end] - a0 + sizes[0][r])
                    found[3][r].append(part.last_b[begin:end] - b0 + sizes[1][r])
                    sizes[:, r] += a1 - a0, b1 - b0
                    begin = end
            for r in broken:
                for kind in found:
                    kind[r] = kind[r][:1]
            lists = [_lists([np.concatenate(one) for one in kind]) for kind in found]
            yield pa.RecordBatch.from_arrays([piece.column("row"), *lists], names=["row", *new])

    kinds = ", ".join(f"{name} array<int>" for name in new)
    result = rows.mapInArrow(align, f"row {rows.schema['row'].dataType.simpleString()}, {kinds}")
    return result.select("row.*", *new)


def _written(part: _Part, names: list[bytes], offset: int) -> Iterator[bytes]:
    """Each text's groups as `a1,a2|b1;`, in the order of the text."""
    size_a, size_b = len(part.ids_a), len(part.ids_b)
    ends_a, ends_b = np.zeros(size_a, np.int64), np.zeros(size_b, np.int64)
    ends_a[part.last_a] = ends_b[part.last_b] = 1
    # Tokens of b before each token of a, and of a up to the end of each b's group.
    group_a = np.cumsum(ends_a) - ends_a
    group_b = np.cumsum(ends_b) - ends_b
    before = np.concatenate(([0], part.last_b + 1))
    order = np.empty(size_a + size_b, np.int64)
    order[np.arange(size_a) + before[group_a]] = 2 * part.ids_a + ends_a
    order[np.arange(size_b) + (part.last_a + 1)[group_b]] = offset + 2 * part.ids_b + ends_b
    codes, get = order.tolist(), names.__getitem__
    for begin, end in _spans(part.ends_a + part.ends_b):
        yield b"".join(map(get, codes[begin:end]))


def measured(
    docs: DataFrame, left: Vocabulary, right: Vocabulary, text: str = "text", id: str = "doc_id"
) -> DataFrame:
    """One row per document: counts, the digest of its groups, and its different links.

    ``pairs`` are the linked pairs of ids, ``a * right's ids + b``, ascending, and
    ``times`` how often the document has each.
    """
    spark = workers_can_import(docs.sparkSession).sparkContext
    shared = spark.broadcast((left, right))

    def measure(batches):
        lexicon = _lexicon(*shared.value)
        a, b = lexicon.tokenizers
        width, offset = len(b.tokens), 2 * len(a.tokens)
        names = [str(i).encode() + end for i in range(len(a.tokens)) for end in (b",", b"|")]
        names += [str(i).encode() + end for i in range(width) for end in (b",", b";")]
        nothing = np.zeros(0, np.int64)
        for piece, texts in _batches(batches, "text"):
            counts = np.zeros((3, len(texts)), np.int64)
            digests = [None] * len(texts)
            links: list[list] = [[] for _ in texts]
            broken = set()
            for part in _parts(texts, lexicon):
                broken |= part.broken
                codes = part.ids_a[part.last_a] * width + part.ids_b[part.last_b]
                groups = np.searchsorted(part.last_a, part.ends_a).tolist()
                begin = 0
                for r, (a0, a1), (b0, b1), end, written in zip(
                    part.rows,
                    _spans(part.ends_a),
                    _spans(part.ends_b),
                    groups,
                    _written(part, names, offset),
                    strict=True,
                ):
                    counts[:, r] += a1 - a0, b1 - b0, end - begin
                    if digests[r] is None:
                        digests[r] = sha256()
                    else:
                        digests[r].update(b";")
                    digests[r].update(memoryview(written)[:-1])
                    links[r].append(np.unique(codes[begin:end], return_counts=True))
                    begin = end
            pairs, times = [], []
            for r, found in enumerate(links):
                if r in broken or not found:
                    counts[:, r] = 0
                    digests[r] = None
                    found = [(nothing, nothing)]
                if len(found) == 1:
                    codes, n = found[0]
                else:
                    codes, place = np.unique(
                        np.concatenate([codes for codes, _ in found]), return_inverse=True
                    )
                    n = np.bincount(place, np.concatenate([n for _, n in found])).astype(np.int64)
                pairs.append(codes)
                times.append(n)
            columns = [piece.column("id"), *(pa.array(c) for c in counts)]
            columns.append(pa.array(["" if d is None else d.hexdigest() for d in digests]))
            columns += [_lists(pairs, np.int64), _lists(times, np.int64)]
            yield pa.RecordBatch.from_arrays(columns, names=fields)

    kind = docs.schema[id].dataType.simpleString()
    fields = ["id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"]
    rows = docs.select(docs[id].alias("id"), text_of(docs, text).alias("text"))
    return rows.mapInArrow(
        measure,
        f"id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, "
        "pairs array<long>, times array<long>",
    )


def pair_counts(documents: DataFrame) -> DataFrame:
    """(pair, n): how often each pair is linked in all of the ``measured`` documents."""
    each = documents.select(F.explode(F.arrays_zip("pairs", "times")).alias("link"))
    return each.groupBy(F.col("link.pairs").alias("pair")).agg(F.sum("link.times").alias("n"))


def digests(docs: DataFrame, left: Vocabulary, right: Vocabulary, id: str = "doc_id") -> DataFrame:
    """Per document the counts of tokens, groups and links, and what its links count in all.

    The documents are encoded once and stored with their links; the table of pairs, of
    at most ``pair_bound`` rows, is sent to every task.
    """
    documents = stored(measured(docs, left, right, id=id), "alignment")
    spark = docs.sparkSession.sparkContext
    width = len(_tokenizer(right).tokens)
    counted = pair_counts(documents).toArrow()
    pair, total = (counted.column(c).to_numpy() for c in ("pair", "n"))
    order = np.argsort(pair)
    pair, total = pair[order], total[order]
    best = np.zeros(width, np.int64)
    np.maximum.at(best, pair % width, total)
    shared = spark.broadcast((pair, total, total == best[pair % width]))

    def add(batches):
        pair, total, is_best = shared.value
        for batch in batches:
            codes, times = (batch.column(c).flatten().to_numpy() for c in ("pairs", "times"))
            at = np.searchsorted(pair, codes)
            sizes = batch.column("pairs").value_lengths().to_numpy()
            owner = np.repeat(np.arange(len(sizes)), sizes)
            sums = []
            for value in (times, times * is_best[at], times * total[at]):
                sums.append(np.zeros(len(sizes), np.int64))
                np.add.at(sums[-1], owner, value)
            kept = [batch.column(c) for c in ("id", "n_a", "n_b", "n_groups", "groups_sha256")]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, sums)], names=fields)

    fields = ["id", "n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum"]
    kind = documents.schema["id"].dataType.simpleString()
    return documents.mapInArrow(
        add,
        f"id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, "
        "n_links long, n_best long, count_sum long",
    ).withColumnRenamed("id", id)
