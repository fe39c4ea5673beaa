"""Chunk reuse in byte-pair encoding against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest

from pulsegrid.llm import bpe_codec

from .test_text_operators import docs, edge_rows, prose

ODD = ["don't", "we'll", "'", "  ", "\n\n", " ", "aaaa", "é", "日本語", "123", "!!", "'re", "'ll", "\t", "x" * 300, " " * 90, "foo bar baz ", "　", "\x85", "🙂", "'s", "l", "e"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe_codec.default_vocabulary())


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def check(spark, library, rows):
    got = sorted(tuple(r)[1:] for r in bpe_codec.digests(bpe_codec.encode(docs(spark, rows))).collect())
    assert got == sorted(expected(library, r[1]) for r in rows)


def test_joins_of_any_pieces_are_repaired(library):
    codec, rng = bpe_codec.Codec(bpe_codec.read_vocabulary()), random.Random(3)
    for _ in range(600):
        text = "".join(rng.choice(ODD) for _ in range(rng.randint(1, 50)))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text), rng.randint(1, 8))))
        pieces = [codec.encode(text[a:b].encode()) for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True) if a < b]
        assert codec.join(pieces).tolist() == library.encode(text, add_special_tokens=False).ids


def test_characters_that_the_encoders_see_differently_go_to_the_library(library):
    vocabulary = bpe_codec.read_vocabulary()
    codec, odd = bpe_codec.Codec(vocabulary), "".join(c for c in map(chr, range(0x300, 1 << 16)) if vocabulary.odd.match(c))
    assert vocabulary.ranked and vocabulary.odd.match("\U0001f642") and not vocabulary.odd.match("é")
    for text in (odd, " ".join(odd), "a".join(odd), "𐄀 𞤀x " * 20, "".join(map(chr, range(0x20, 0x3000)))):
        assert codec.encode(text.encode()).tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_words_cost_time_in_proportion(library):
    codec = bpe_codec.Codec(bpe_codec.read_vocabulary())
    for text in ("ab" * 300_000, " " * 400_000):
        raw = text.encode()
        pieces = [codec.encode(raw[i : i + 4096]) for i in range(0, len(raw), 4096)]
        assert codec.join(pieces).tolist() == library.encode(text, add_special_tokens=False).ids


def test_cuts_follow_content():
    rng = np.random.default_rng(1)
    shared = rng.integers(97, 123, 20_000, dtype=np.uint8)
    a, b = (np.concatenate([rng.integers(97, 123, n, dtype=np.uint8), shared]) for n in (777, 3_210))
    chunks = [{x[i:j].tobytes() for i, j in bpe_codec._chunk_ends(x, bpe_codec.cut_places(x), 0, len(x))} for x in (a, b)]
    common = sum(map(len, chunks[0] & chunks[1]))
    assert common > 0.9 * len(shared)
    assert all(len(c) <= bpe_codec.MAX_CHUNK for s in chunks for c in s)


def test_encode_equals_the_library_on_shared_and_odd_texts(spark, library):
    rng = random.Random(5)
    passage, other = prose(rng, 300), prose(rng, 300)
    rows = [(i, prose(rng, rng.randint(0, 60)) + rng.choice(ODD) + passage + rng.choice(ODD) + prose(rng, rng.randint(0, 60)) + other) for i in range(60)]
    rows += [(100 + i, passage) for i in range(30)] + [(i, "".join(rng.choice(ODD) for _ in range(80))) for i in range(200, 240)]
    rows += [(300, "<|endoftext|>"), (301, passage + "<|endoftext|>" + passage), (302, "a<|endoftext|><|endoftext|> b"), (303, "<|endoftext"), (304, "日本語テキスト" * 3_000)]
    check(spark, library, rows + edge_rows())


def test_references_to_the_dictionary_and_its_hot_entries(spark, library, monkeypatch):
    monkeypatch.setattr(bpe_codec, "HOT", 1)  # no entry is hot: every repeated chunk comes by the join
    rng = random.Random(6)
    passages = [prose(rng, 200) for _ in range(8)]
    rows = [(i % 50, " ".join(rng.sample(passages, 3)) + prose(rng, 20)) for i in range(80)] + [(None, passages[0])] * 5
    check(spark, library, rows)


def test_decode_gives_the_texts_back(spark):
    rows = [r for r in edge_rows() if r[1]] + [(50, "a<|endoftext|>b"), (51, "�\x00")]
    got = bpe_codec.decode(bpe_codec.encode(docs(spark, rows))).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted((r[0] or 0, r[1]) for r in rows)
    broken = spark.createDataFrame([(1, [159]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert [r["text"] for r in bpe_codec.decode(broken).orderBy("doc_id").collect()][1:] == [None, ""]


def test_other_vocabularies_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="another"):
        bpe_codec.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_empty_table(spark):
    assert bpe_codec.encode(docs(spark, edge_rows()).where("false")).count() == 0
