import hashlib
import random

import numpy as np
import pytest
from llm_cases import DATA, clashing, documents, odd_documents, prose, words

from riskflow.llm import suffix_dedup, superkmers, window_dedup


def rank(i):
    return -(2**63) if i is None else i


def windows_expected(rows, window=13):
    least = {}
    for i, text, *_ in rows:
        w = words(text)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, rank(i)), rank(i))
    found = []
    for i, text, *_ in rows:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < rank(i):
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        found.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(found, key=str)


def bytes_expected(rows, size=100):
    starts = {}
    for i, text, *_ in rows:
        b = (text or "").encode()
        for k in range(len(b) - size + 1):
            starts.setdefault(b[k : k + size], set()).add((rank(i), b, k))
    found = []
    for i, text, *_ in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            # Smaller id, or the same document and an earlier start.
            if any(
                r < rank(i) or (r == rank(i) and other == b and at < k)
                for r, other, at in starts[b[k : k + size]]
            ):
                gone[k : k + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        found.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(found, key=str)


def some_rows():
    return [row for row in odd_documents() if row[0] not in (9, 10)]


@pytest.mark.parametrize("frequent", [0.02, 2.0])
def test_windows_equal_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(superkmers, "FREQUENT", frequent)
    got = window_dedup.digests(clashing(documents(spark), "tag", "spans", "places", "kept")).collect()
    assert sorted(map(tuple, got), key=str) == windows_expected(odd_documents())


def test_bytes_equal_brute_force(spark):
    rows = some_rows()
    got = suffix_dedup.digests(clashing(documents(spark, rows), "tag", "spans", "first")).collect()
    assert sorted(map(tuple, got), key=str) == bytes_expected(rows)


def hot_rows():
    """One passage in all documents, in different surroundings, and large groups of copies."""
    passage, choose = prose(99, 40), random.Random(3)
    rows = [(i, f"{prose(i, 15)} {passage} {prose(1000 + i, 15)}", "s", "en", 0) for i in range(60)]
    rows += [(100 + i, prose(5000, 60), "s", "en", 0) for i in range(40)]
    for i in range(40):
        w = prose(6000, 80).split()
        w[choose.randrange(80)] = f"x{i}"
        rows.append((200 + i, " ".join(w), "s", "en", 0))
    return rows


@pytest.mark.parametrize("least", [8, 10**9])
def test_hot_passages_split_or_not_give_the_same(spark, monkeypatch, least):
    rows = hot_rows()
    # With a sample share above one nothing is ever split.
    monkeypatch.setattr(superkmers, "FREQUENT", least / len(rows))
    docs = documents(spark, rows)
    got = window_dedup.digests(docs).collect()
    assert sorted(map(tuple, got), key=str) == windows_expected(rows)
    got = suffix_dedup.digests(docs).collect()
    assert sorted(map(tuple, got), key=str) == bytes_expected(rows)


def test_small_pieces_and_flushes_give_the_same(spark, monkeypatch):
    """Whatever is sent together, the result is the same."""
    for batch in (1, 1 << 12):
        monkeypatch.setattr(superkmers, "GATHERED", batch)
        sender = superkmers._place_sender(window_dedup._read, 13, 3, 7, np.zeros(0, np.uint64))
        import pyarrow as pa

        rows = hot_rows()
        table = pa.RecordBatch.from_pydict(
            {"doc_id": [r[0] for r in rows], "tag": [0] * len(rows), "text": [r[1] for r in rows]}
        )
        blobs = sorted(
            (b["bucket"], b["kind"], b["blob"]) for out in sender([table]) for b in out.to_pylist()
        )
        back = pa.RecordBatch.from_pydict(dict(zip(("bucket", "kind", "blob"), zip(*blobs, strict=True), strict=True)))
        places = {
            (r["doc_id"], r["place"]) for out in superkmers._place_receiver([back]) for r in out.to_pylist()
        }
        if batch == 1:
            first = places
    assert places == first and places


def test_suffix_ranks_sort_prefixes():
    choose = np.random.default_rng(5)
    for _ in range(200):
        n, letters = int(choose.integers(1, 90)), int(choose.integers(1, 4))
        reach = int(choose.choice([1, 2, 3, 4, 9, 10, 28, 200]))
        text = choose.integers(1, letters + 1, n)
        text = np.tile(text, int(choose.integers(1, 4)))
        ranks = suffix_ranks_of(text, reach)
        prefixes = [tuple(text[i : i + reach]) for i in range(len(text))]
        ordered = [prefixes[i] for i in np.argsort(ranks, kind="stable")]
        assert ordered == sorted(prefixes)


def suffix_ranks_of(text, reach):
    return suffix_dedup.suffix_ranks(text, reach)


def test_super_k_mers_cover_every_window_once():
    raw = np.frombuffer((prose(1, 400) + "z" * 300).encode(), np.uint8)
    offsets = np.array([0, 500, 500, 620, len(raw)])
    units = suffix_dedup._read(raw, offsets)
    first, windows, offset = superkmers.find(units, 100, 16)
    got = [i for f, n in zip(first, windows, strict=True) for i in range(f, f + n)]
    whole = [i for a, b in zip(offsets[:-1], offsets[1:], strict=True) for i in range(a, b - 99)]
    assert got == whole
    assert (offset >= 0).all() and (offset <= 84).all() and (windows <= 85).all()


@pytest.mark.parametrize("bits", [7, 8, 9])
def test_places_beyond_their_bits_are_found_in_stretches(monkeypatch, bits):
    """As a document of more than 2**28 bytes, with places of fewer bits."""
    text = (prose(1, 400) + "z" * 300 + prose(1, 400)).encode()
    raw, offsets = np.frombuffer(text, np.uint8), np.array([0, 500, len(text)])
    units = suffix_dedup._read(raw, offsets)
    expected = superkmers.find(units, 100, 16)
    monkeypatch.setattr(superkmers, "_PLACE", np.uint64((1 << bits) - 1))
    assert len(raw) > 4 << bits
    for got, want in zip(superkmers.find(units, 100, 16), expected, strict=True):
        assert np.array_equal(got, want)


def test_kept_and_removed_parts_make_the_text(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("doc_id < 200")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in suffix_dedup.cleaned(docs).collect():
        data, rest, at = text[r["doc_id"]].encode(), bytes(r["kept"]), 0
        for span in r["removed"]:
            n = span["first"] - at
            assert data[at : span["first"]] == rest[:n]
            rest, at = rest[n:], span["end"]
        assert data[at:] == rest
    for r in window_dedup.cleaned(docs).collect():
        w, gone = words(text[r["doc_id"]]), set()
        for span in r["removed"]:
            gone |= set(range(span["first"], span["end"]))
        assert r["kept"] == " ".join(x for i, x in enumerate(w) if i not in gone)


def test_empty_tables(spark):
    for operator in (suffix_dedup, window_dedup):
        assert operator.digests(documents(spark, [])).collect() == []
        one = operator.digests(documents(spark, [(1, None, "s", "en", 0)])).collect()
        assert [tuple(r)[:3] for r in one] == [(1, 0, 0)]
