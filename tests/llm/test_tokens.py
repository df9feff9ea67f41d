from __future__ import annotations

import tempfile
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import AddedToken, Tokenizer

from tidewire.llm import common, range_coder, token_counts, token_files, tokens

FILE = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(FILE)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab'sé1 \n\t\r\x1c\x85\xa0\u3000|<>.!", max_size=30), max_size=4))
def test_pieces_encode_like_whole_texts(texts):
    enc = tokens.encoder(FILE)
    texts = [*texts, "x <|endoftext|>  y<|endoftext|>"]
    ids, sizes = enc.encode(texts)
    assert np.split(ids, np.cumsum(sizes)[:-1])[-1].tolist() == ids_of(texts[-1])
    assert ids.tolist() == [i for t in texts for i in ids_of(t)]
    assert enc.counts(texts).tolist() == sizes.tolist()


@pytest.mark.parametrize("space", ["\n\n", " \n\n", "\xa0\xa0", "\r\n\r\n", "\t\t", "  ", " ", "\u3000\n "])
def test_white_space_around_added_tokens(space):
    enc = tokens.PieceEncoder(FILE)
    assert enc.cut
    end = "<|endoftext|>"
    for text in (f"para{space}{end}next", f"{space}{end}", f"{end}{space}{end}{space}", f"a{space}{end}{space}b", f"a{space}<|endoftext{space}{end}"):
        assert enc.encode([text])[0].tolist() == ids_of(text)
        assert enc.counts([text]).tolist() == [len(ids_of(text))]


def test_added_tokens_that_overlap():
    for normalized in (False, True):
        lib = Tokenizer.from_file(FILE)
        lib.add_tokens([AddedToken(t, normalized=normalized) for t in ("<a>", "<a><b>", "b><c")])
        path = tempfile.mkdtemp() + "/more.json"
        lib.save(path)
        enc = tokens.PieceEncoder(path)
        assert enc.cut != normalized
        for text in ("x\n\n<a><b><c>", "\n\n<a>\n\n<b><c>  <|endoftext|>", "<a>\n\n<a><b>y"):
            assert enc.encode([text])[0].tolist() == lib.encode(text, add_special_tokens=False).ids


def test_other_vocabularies_are_encoded_whole():
    path = public_tokenizers.path("word_bpe_49k.json")
    enc, lib = tokens.PieceEncoder(path), Tokenizer.from_file(path)
    text = "Hello  World, <|endoftext|> again"
    assert enc.encode([text])[0].tolist() == lib.encode(text, add_special_tokens=False).ids


def test_a_full_memory_is_forgotten():
    enc = tokens.PieceEncoder(FILE, limit=3)
    for t in ("one two three four five", "six two"):
        assert enc.encode([t])[0].tolist() == ids_of(t)
    assert len(enc.row) == 2


def test_pieces_that_occur_again_outlive_a_full_memory():
    enc = tokens.PieceEncoder(FILE, limit=3)
    asked = []
    inner = enc._encode
    enc._encode = lambda pieces: asked.append(pieces) or inner(pieces)
    for t in ("one two three four five", "six two", "ten eleven twelve two", "two six two"):
        assert enc.encode([t])[0].tolist() == ids_of(t)
    assert sum(p.count(" two") for p in asked) == 1


def test_signs_behind_letters_are_pieces_of_their_own():
    enc = tokens.PieceEncoder(FILE)
    text = "stie, der. Der der's naïve; ẞ, a\u0301, x1, ǆ.  «é»\xa0é, the_end 'll we'll,"
    assert enc.encode([text])[0].tolist() == ids_of(text)
    assert " der" in enc.row and "stie" in enc.row and " x1," in enc.row


def resident():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096 >> 20


def test_given_up_memory_goes_back_to_the_system():
    held = [np.zeros(60, np.int64) + k for k in range(300_000)]
    last, full = held[-1], resident()
    held.clear()
    common.give_up()
    assert last[0] == 299_999 and resident() < full - 100


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 6), st.integers(1, 90), st.integers(1, 65536), st.integers(0, 2**31))
def test_coder_round_trip(lanes, steps, high, seed):
    ids = np.random.default_rng(seed).integers(0, high, (lanes, steps))
    assert (range_coder.decode_blocks(range_coder.encode_blocks(ids), steps) == ids).all()


def test_coder_adapts():
    ids = np.tile(np.arange(40_000, 40_064), (3, 32))
    assert sum(map(len, range_coder.encode_blocks(ids))) * 8 < 3 * ids.size


def test_blocks_are_independent_and_checked():
    ids = np.random.default_rng(1).integers(0, 300, 5000).astype(np.uint32)
    blocks = token_files.encode_group(ids)
    assert [b[0] for b in blocks] == [2048, 2048, 904]
    assert (next(iter(token_files.decode_group(blocks[1:2]))) == ids[2048:4096]).all()
    n, coded, crc, payload = blocks[0]
    broken = payload[:40] + bytes([payload[40] ^ 1]) + payload[41:]
    with pytest.raises(ValueError):
        list(token_files.decode_group([(n, coded, crc, broken)]))
    with pytest.raises(ValueError):
        token_files.encode_group(np.array([70_000]))


def test_files_round_trip(spark, table, odd_rows):
    path = tempfile.mkdtemp() + "/ids"
    token_files.write_token_files(table(odd_rows), FILE, path, shards=4)
    got = token_files.read_token_files(spark, path, with_ids=True).orderBy("start").collect()
    rows = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    start = 0
    for r, (_, t, _, _) in zip(got, rows):
        want = [*ids_of(t), 0]
        assert r["ids"] == want and r["n_tokens"] == len(want) and r["start"] == start
        assert r["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)


def test_files_of_no_rows(spark, table):
    path = tempfile.mkdtemp() + "/ids"
    token_files.write_token_files(table([]), FILE, path, shards=2)
    assert token_files.read_token_files(spark, path).count() == 0


def test_counts_through_the_cache(spark, table, odd_rows):
    cache = tempfile.mkdtemp() + "/cache"
    for rows in (odd_rows[:6], odd_rows, odd_rows):
        got = sorted(
            ((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(table(rows), FILE, cache).collect())
        )
        want = sorted((d or -1, len((t or "").encode()), len(ids_of(t))) for d, t, _, _ in rows)
        assert got == want
        # Only distinct misses were encoded and appended.
        assert spark.read.parquet(cache).count() == len({t or "" for _, t, _, _ in rows})
    assert token_counts.count_tokens(table([]), FILE, cache).count() == 0
