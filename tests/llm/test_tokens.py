import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sievemark.llm import packing, token_blocks
from sievemark.llm.tokens import Encoder, default_tokenizer, encoder

TEXTS = [None, "", "\n", " a", "a  b", "a\n\nb", "Don't won't. 12,3 <|endoftext|> it's, fine.", "a \n b", "x\xa0 y", "\x1c!", "Tab\there", "word. word, word.\nWord", "漢字 テスト. é", "thwhere " * 1500, "lone"]


FRESH = Tokenizer.from_file(default_tokenizer())


def plain_ids(text):
    return FRESH.encode(text or "", add_special_tokens=False).ids


def encoded(texts, with_encoder=None):
    ids, bounds = (with_encoder or encoder(default_tokenizer())).encode(pa.array(texts, pa.string()))
    assert bounds[0] == 0 and bounds[-1] == len(ids)
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab.,'&*s \n\té1ß\xa0　\0ⅷ²", max_size=20), max_size=4))
def test_ids_by_runs_are_the_librarys(texts):
    assert encoded(texts) == [[*plain_ids(x), 2] for x in texts]


def test_ids_of_odd_texts():
    assert encoded(TEXTS) == [[*plain_ids(x), 2] for x in TEXTS]
    assert encoded([]) == [] and encoded([None]) == [[2]]


def test_long_runs_marks_and_a_table_that_grows_and_is_forgotten():
    rng = np.random.default_rng(4)
    some = Encoder(default_tokenizer(), most=3000)
    for _ in range(6):
        words = ["".join(rng.choice(list("abcdeé'.,*&7\u0531"), rng.integers(1, 40))) for _ in range(1500)]
        words += [w + t for w in words[:200] for t in (",", ".", "***", "'s", "?!")] + words[:300]
        texts = [" ".join(words[i : i + 50]).replace("a b", "a\nb") + ("\n" + words[i] if i % 3 else "") for i in range(0, len(words), 50)]
        assert encoded(texts, some) == [[*plain_ids(x), 2] for x in texts]
    # Keys differ in bytes, length or kind alone.
    texts = ["a a\0 a\0\0\na\na\0", "x" * 23 + " " + "x" * 24 + "\n" + "x" * 24 + " " + "x" * 25, "x" * 24 + "\n" + "x" * 23, "a"]
    assert encoded(texts, some) == [[*plain_ids(x), 2] for x in texts] == encoded(texts, some)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700), st.sampled_from([0.0, 50.0, 90.0, 100.0]))
def test_blocks_round_trip(ids, percentile):
    ids = np.array(ids, np.uint32)
    body, starts = token_blocks.encode_blocks(ids, percentile)
    assert np.array_equal(token_blocks.decode_blocks(memoryview(body), starts), ids)


def test_blocks_where_every_value_is_an_outlier_or_none():
    for ids in ([7] * 256, [0] + [2**32 - 1] * 255, list(range(256)), [5]):
        ids = np.array(ids, np.uint32)
        body, starts = token_blocks.encode_blocks(ids)
        assert np.array_equal(token_blocks.decode_blocks(memoryview(body), starts), ids)


def test_a_damaged_file_is_refused():
    out = io.BytesIO()
    file = token_blocks.BlockFile(out)
    file.add(1, np.array([9, 2], "<u4").tobytes())
    file.add(None, np.array([2], "<u4").tobytes())
    file.close()
    data = bytearray(out.getvalue())
    doc_ids, lengths, ids = token_blocks.read_file(bytes(data))
    assert (doc_ids, lengths.tolist(), ids.tolist()) == ([1, None], [2, 1], [9, 2, 2])
    data[6] ^= 1
    with pytest.raises(ValueError):
        token_blocks.read_file(bytes(data))


def test_a_file_written_in_steps():
    rng, out = np.random.default_rng(1), io.BytesIO()
    file, docs = token_blocks.BlockFile(out, step=600), [rng.integers(0, 50000, n).astype("<u4") for n in (0, 1, 700, 255, 3000, 1)]
    for i, x in enumerate(docs):
        file.add(i, x.tobytes())
    file.close()
    doc_ids, lengths, ids = token_blocks.read_file(out.getvalue())
    assert doc_ids == list(range(6)) and lengths.tolist() == [len(x) for x in docs] and np.array_equal(ids, np.concatenate(docs))


def _docs(spark):
    rows = [(i if i != 3 else None, x, "clash", 1) for i, x in enumerate(TEXTS)] + [(5, TEXTS[5], "clash", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, piece int").repartition(5)


def test_files_hold_all_ids_in_order(spark):
    got = token_blocks.read_token_files(token_blocks.write_token_files(_docs(spark), file_ids=500)).collect()
    rows = sorted(got, key=lambda r: r.start)
    ids = [r.doc_id for r in rows]
    assert ids == [None, *sorted(x for x in ids if x is not None)] and len(rows) == len(TEXTS) + 1
    at = 0
    for r in rows:
        own = plain_ids(TEXTS[3 if r.doc_id is None else r.doc_id]) + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        at += len(own)


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_blocks.read_token_files(token_blocks.write_token_files(empty)).count() == 0
    assert packing.packed_documents(empty).count() == 0


def plain_best_fit(lengths, capacity):
    room = []
    for x in sorted(lengths, reverse=True):
        fit = [r for r in room if r >= x]
        if fit:
            room[room.index(min(fit))] -= x
        else:
            room.append(capacity - x)
    return len(room)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=40))
def test_best_fit_and_its_bound(lengths):
    array = np.array(lengths, np.int64)
    bins, offsets, count = packing.best_fit_decreasing(array, 32)
    assert count == plain_best_fit(lengths, 32) and packing.bin_bound(array, 32) <= count
    assert packing.bin_bound(array, 32) >= -(-sum(lengths) // 32)
    for b in range(count):
        own = sorted((o, x) for o, x, k in zip(offsets, lengths, bins, strict=True) if k == b)
        assert [o for o, _ in own] == [sum(x for _, x in own[:i]) for i in range(len(own))] and sum(x for _, x in own) <= 32


def test_bound_of_items_over_half():
    assert packing.bin_bound(np.array([17] * 5), 32) == 5


def _is_packed(rows, capacity):
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_packing_is_whole_and_gapless(spark):
    rows = packing.packed_documents(_docs(spark)).collect()
    assert _is_packed(rows, 1024) <= 6
    for doc_id in {r.doc_id for r in rows} - {5}:
        own = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.piece)
        ids = plain_ids(TEXTS[3 if doc_id is None else doc_id]) + [2]
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == 1024 for r in own[1:])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert len([r for r in rows if r.doc_id == 5]) == 2


def test_exchange_between_groups_saves_sequences(spark):
    rng = np.random.default_rng(1)
    lengths = rng.choice([300, 341, 342, 512, 513, 700, 900, 1024], 3000)
    rows = [(i, 0, 0, int(x), 0) for i, x in enumerate(lengths)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    some = _is_packed(packing.pack(pieces, group=60, rounds=3).collect(), 1024)
    none = _is_packed(packing.pack(pieces, group=60, rounds=0).collect(), 1024)
    bound = packing.bin_bound(lengths, 1024)
    assert bound <= some < none


def test_added_tokens_are_those_of_a_fresh_tokenizer():
    added = [x.content for x in FRESH.get_added_tokens_decoder().values()]
    texts = [y for x in added for y in (x, f"some text {x} and more", f"a{x}b\n{x}", f"{x[:-1]} {x[1:]}")] + TEXTS
    assert added and encoded(texts) == [[*plain_ids(x), 2] for x in texts]


def test_texts_without_spaces_take_bounded_memory():
    rng = np.random.default_rng(4)
    some = Encoder(default_tokenizer())
    alphabet = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
    for k in range(12):
        texts = [alphabet[rng.integers(0, 64, 200_000)].tobytes().decode(), f"a b {k}", "x" * 3000 + " y"]
        ids, bounds = some.encode(pa.array(texts))
        assert [ids[i:j].tolist() for i, j in zip(bounds, bounds[1:], strict=False)][1:] == [[*plain_ids(x), 2] for x in texts[1:]]
        assert ids[bounds[0] : bounds[1]].tolist() == [*plain_ids(texts[0]), 2]
    assert some.table.held() + some.old.held() < 1 << 20 and len(some.table) < 200
    few = Encoder(default_tokenizer(), most_bytes=1 << 16)
    for k in range(40):
        text = " ".join(alphabet[rng.integers(0, 64, 600)].tobytes().decode() for _ in range(20))
        ids, _ = few.encode(pa.array([text]))
        assert ids.tolist() == [*plain_ids(text), 2]
    assert few.table.held() + few.old.held() < 1 << 20


def test_repeated_pieces_are_dealt_to_all_groups(spark):
    pieces = spark.range(6000).selectExpr("CAST(NULL AS LONG) AS doc_id", "0 AS piece", "CAST(0 AS LONG) AS start", "CAST(300 AS LONG) AS length", "CAST(7 AS LONG) AS ids_crc32")
    rows = packing.pack(pieces, group=500)
    assert _is_packed(rows.collect(), 1024) <= 2000 + 12
    parts = rows.selectExpr("sequence_id >> 20 AS part").groupBy("part").count().collect()
    assert len(parts) > 5 and max(r["count"] for r in parts) < 3000
