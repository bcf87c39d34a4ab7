import hashlib
import random
from bisect import bisect_left
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import clashing, documents, odd_documents

from riskflow.llm import queries, token_alignment

vocabularies = pytest.importorskip("public_tokenizers")
ODD = ["", " ", "  a  b ", "tail  \n", "x▁y", "ﬁ é́ \u0000 \t", "<|endoftext|> </s> <0x41>", "a\nb", "😀" * 9]


@pytest.fixture(scope="module")
def sides():
    return (
        token_alignment.byte_level(vocabularies.path("byte_bpe_50k.json")),
        token_alignment.pieces(vocabularies.path("piece_bpe_32k.model")),
    )


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabularies.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    pieces = SentencePieceProcessor(model_file=vocabularies.path("piece_bpe_32k.model"))
    return tokenizer, pieces


def plain(text, tokenizer, pieces):
    """Ids and groups of one text, from the libraries and sets of ends."""
    if not text:
        return [], [], []
    a = tokenizer.encode(" " + text, add_special_tokens=False).ids
    b = pieces.encode(text)
    decode = {letter: b for b, letter in byte_letters().items()}
    bytes_a = [bytes(decode[c] for c in tokenizer.id_to_token(i)) for i in a]
    bytes_b = [
        bytes([int(pieces.id_to_piece(i)[3:5], 16)])
        if pieces.is_byte(i)
        else pieces.id_to_piece(i).replace("▁", " ").encode()
        for i in b
    ]
    whole = (" " + text).encode()
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return [], [], []
    ends_a = np.cumsum([len(t) for t in bytes_a]).tolist()
    ends_b = np.cumsum([len(t) for t in bytes_b]).tolist()
    common = sorted(set(ends_a) & set(ends_b))
    groups = [([], []) for _ in common]
    for side, (ids, ends) in enumerate(((a, ends_a), (b, ends_b))):
        for i, end in zip(ids, ends, strict=True):
            groups[bisect_left(common, end)][side].append(i)
    return a, b, groups


def byte_letters():
    """Byte to letter, as byte-level vocabularies write them."""
    table, spare = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            table[b] = chr(b)
        else:
            table[b] = chr(spare)
            spare += 1
    return table


def expected(rows, libraries):
    """The contract's columns for rows of (doc_id, text)."""
    found = [(i, *plain(text, *libraries)) for i, text in rows]
    links = [[(a[-1], b[-1]) for a, b in groups] for *_, groups in found]
    total = Counter(pair for of_one in links for pair in of_one)
    best = {}
    for (_, b), n in total.items():
        best[b] = max(best.get(b, 0), n)
    result = []
    for (i, a, b, groups), mine in zip(found, links, strict=True):
        text = ";".join(
            "|".join(",".join(map(str, side)) for side in group) for group in groups
        )
        result.append(
            (
                i,
                len(a),
                len(b),
                len(groups),
                len(mine),
                sum(total[pair] == best[pair[1]] for pair in mine),
                sum(total[pair] for pair in mine),
                hashlib.sha256(text.encode()).hexdigest() if groups else "",
            )
        )
    return result


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, *map(str, r)))


def digests(docs, sides):
    return in_order([tuple(r) for r in token_alignment.digests(docs, *sides).select(*COLUMNS).collect()])


@pytest.mark.parametrize("chunk", [1 << 18, 40])
def test_digests_equal_brute_force(spark, sides, libraries, monkeypatch, chunk):
    monkeypatch.setattr(token_alignment, "CHUNK", chunk)
    rows = [(r[0], r[1]) for r in odd_documents()] + [(100 + n, t) for n, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert digests(docs, sides) == in_order(expected(rows, libraries))


def test_pieces_of_a_long_text_give_its_tokens(sides, libraries):
    """Cutting changes neither tokens nor groups, in scripts with and without spaces."""
    lexicon = token_alignment._lexicon(*sides)
    choose = random.Random(4)
    words = ["wörter", "中文字", "it's", "'s", "(x)", "_a_", "\n", " ", "\t", "12", "é́", "-", "​", "\x1c", "　", "😀"]
    for size in (1, 7, 50):
        text = "".join(choose.choice(words) + choose.choice(["", " ", "  "]) for _ in range(400))
        old, token_alignment.CHUNK = token_alignment.CHUNK, size
        try:
            parts = list(token_alignment._parts([text], lexicon))
        finally:
            token_alignment.CHUNK = old
        assert len(parts) > 1
        a, b, groups = plain(text, *libraries)
        assert [i for p in parts for i in p.ids_a.tolist()] == a
        assert [i for p in parts for i in p.ids_b.tolist()] == b
        assert sum(len(p.last_a) for p in parts) == len(groups)


def test_a_full_memory_changes_nothing(monkeypatch, sides, libraries):
    monkeypatch.setattr(token_alignment, "REMEMBERED", 3)
    monkeypatch.setattr(token_alignment, "LONGEST", 4)
    lexicon = token_alignment._Lexicon(*map(token_alignment._tokenizer, sides))
    for n in range(4):
        texts = [f"some words {n} unforgettable", "x▁y", "words some", *ODD]
        found = list(token_alignment._parts(texts, lexicon))
        expected = [plain(text, *libraries) for text in texts]
        assert [i for p in found for i in p.ids_a.tolist()] == [i for a, *_ in expected for i in a]
        assert [i for p in found for i in p.ids_b.tolist()] == [i for _, b, _ in expected for i in b]
        assert sum(len(p.last_a) for p in found) == sum(len(groups) for *_, groups in expected)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)), st.integers(61, 70))
def test_common_ends_equal_a_set(left, right, last):
    a, b = np.array(sorted(left | {last})), np.array(sorted(right | {last}))
    i, j = token_alignment.common_ends(a, b)
    assert a[i].tolist() == b[j].tolist() == sorted(left & right | {last})


def test_long_one_to_one_stretches():
    for n in (1, 2, 3, 7, 8, 9, 1000):
        a = np.arange(1, n + 1) * 3
        b = np.sort(np.concatenate([a, [a[n // 2] - 1]]))
        i, j = token_alignment.common_ends(a, b)
        assert a[i].tolist() == b[j].tolist() == a.tolist()


def test_aligned_returns_groups_and_keeps_columns(spark, sides, libraries):
    docs = clashing(documents(spark), "ids_a", "row", "_more", "pairs")
    found = token_alignment.aligned(docs, *sides)
    assert found.columns == [*docs.drop("ids_a").columns, "ids_a", "ids_b", "last_a", "last_b"]
    rows = found.collect()
    assert len(rows) == len(odd_documents())
    for r in rows:
        a, b, groups = plain(r["text"], *libraries)
        assert (r["ids_a"], r["ids_b"], r["row"], r["_more"]) == (a, b, "mine", "mine")
        cuts_a, cuts_b = [-1, *r["last_a"]], [-1, *r["last_b"]]
        assert groups == [
            (a[cuts_a[g] + 1 : cuts_a[g + 1] + 1], b[cuts_b[g] + 1 : cuts_b[g + 1] + 1])
            for g in range(len(r["last_a"]))
        ]


def test_pairs_stay_within_their_bound(spark, sides):
    bound = token_alignment.pair_bound(*sides)
    measured = token_alignment.measured(documents(spark), *sides)
    assert 0 < token_alignment.pair_counts(measured).count() <= bound < 1_000_000


def test_empty_tables(spark, sides):
    docs = documents(spark, [])
    assert token_alignment.digests(docs, *sides).collect() == []
    assert token_alignment.aligned(docs, *sides).collect() == []
    blank = documents(spark, [(1, None, None, None, None), (2, "", "s", "en", 0)])
    assert digests(blank, sides) == [(1, *[0] * 6, ""), (2, *[0] * 6, "")]


def test_query(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = queries.QUERIES["op11_token_alignment"](spark, "/root/testdata/sf0.001")
    got = [tuple(r) for r in found.select(*COLUMNS).collect()]
    assert in_order(got) == in_order(expected(rows, libraries))
