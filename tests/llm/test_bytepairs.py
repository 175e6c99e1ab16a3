"""Byte-level BPE against the tiktoken library on whole texts."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from sojourn.llm import bytepairs

RANKS = bytepairs.read_ranks(bytepairs.default_ranks())
WHOLE = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
SCHEMA = "doc_id long, text string"


def expected(rows):
    out = []
    for i, text in rows:
        ids = WHOLE.encode_ordinary(text or "")
        digests = (hashlib.sha256(v).hexdigest() for v in (" ".join(map(str, ids)).encode(), (text or "").encode()))
        out.append((i, len(ids), *digests))
    return sorted(out, key=str)


def found(table, rows, **options):
    parts = bytepairs.encoded(table(rows, SCHEMA), **options)
    out = bytepairs.digests(bytepairs.decoded(parts))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    return sorted(map(tuple, out.collect()), key=str)


def messy(rng, n):
    bits = ["the", "I'll", "don't", "'", "''ll", " ", "  ", "\n", "\n\n", "\t ", "12345", "ß€", "😀", "日本語", "é", "...", " "]
    return "".join(rng.choice(bits) for _ in range(n))


@pytest.mark.parametrize(("size", "overlap"), [(20, 16), (64, 24), (500, 100)])
def test_chunks_of_messy_texts(table, size, overlap):
    rng = random.Random(size)
    rows = [(i, messy(rng, rng.choice([0, 1, 5, 60, 700]))) for i in range(150)]
    assert found(table, rows, size=size, overlap=overlap) == expected(rows)


def test_pretokens_longer_than_an_overlap(table):
    rng = random.Random(4)
    rows = [(i, messy(rng, 30) + run * 400 + messy(rng, 200)) for i, run in enumerate(["x", " ", "7", "!", "\n", "é"])]
    assert found(table, rows, size=100, overlap=32) == expected(rows)


def test_nulls_repeats_and_special_names(table):
    rows = [(None, "a b"), (None, None), (1, ""), (1, "one"), (1, "one"), (2, "<|endoftext|> \x00 x" * 30), (3, " " * 5000)]
    assert found(table, rows) == expected(rows)
    assert found(table, rows, size=64, overlap=16) == expected(rows)
    assert found(table, []) == []


def test_parts_join_to_the_ids_and_texts(table):
    text = "Some words, again and again. " * 90
    parts = bytepairs.decoded(bytepairs.encoded(table([(5, text)], SCHEMA), size=200, overlap=40)).collect()
    parts.sort(key=lambda r: r["part"])
    assert len(parts) == parts[0]["parts"] > 1
    ids = b"".join(r["ids"] for r in parts)
    assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == WHOLE.encode_ordinary(text)
    assert b"".join(r["decoded"] for r in parts).decode() == text


def test_every_character_is_split_as_the_library_does(table):
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rows = [(i, "".join(f"{chr(c)}a1 {chr(c)} .{chr(c)}" for c in codes[i :: 2000])) for i in range(0, 2000, 7)]
    assert found(table, rows) == expected(rows)
