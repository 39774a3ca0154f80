import hashlib
import random
import zlib

import numpy as np
import pytest

from shoplens.llm import bpe, token_files
from shoplens.llm.queries import word_bpe

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")
LETTERS = "aabbeethnisor 'stllvemd\x1c\x1f\x85 \n\tÀéßΣσςİ漢字カ한글ก็้😀👩‍🦰٣½²!?.,#"


@pytest.fixture(scope="module")
def library():
    out = tokenizers.Tokenizer.from_file(word_bpe())
    out.no_truncation()
    out.no_padding()
    return out


def strings(n):
    rng = random.Random(9)
    for i in range(n):
        text = "".join(rng.choice(LETTERS) for _ in range(rng.randrange(40)))
        if i % 5 == 0:
            text += "".join(chr(rng.randrange(1, 0x3000)) for _ in range(10))
        if i % 9 == 0:
            text = "<|endoftext|>" + text + "<|startoftext|>a<|"
        yield text + "a" * (i % 50 if i % 11 == 0 else 0)


def test_encoding_and_decoding_equal_the_library(library):
    own = bpe.bpe_of(word_bpe())
    for text in [*strings(1500), "", "supercalifragilistic" * 50, "the " * 3000]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids
        assert own.decode(own.encode(text)) == library.decode(ids, skip_special_tokens=False)


def test_forgotten_stretches_are_encoded_again(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_CHUNKS", 3)
    own = bpe.PrefixBpe(word_bpe())
    text = "one two three four five six one two seven eight"
    assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_digests_and_texts(odd, none, library):
    got = sorted(bpe.digests(odd, word_bpe()).collect(), key=str)
    want = []
    for r in odd.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.encode_decode(odd, word_bpe()).count() == odd.count()
    assert bpe.digests(none, word_bpe()).count() == bpe.encode_decode(none, word_bpe()).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 255, 257, 5000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 49408, n), np.arange(n) % 3, np.zeros(n), rng.integers(0, 2, n) * 4_000_000, rng.zipf(1.3, n).clip(0, 99999)):
        documents = np.split(ids.astype(np.uint32), sorted(rng.integers(0, n + 1, 3)))
        keys, parts = token_files.read_block(token_files.write_block([5, None, -7, 1 << 60], documents))
        assert keys == [5, None, -7, 1 << 60] and all((a == b).all() and len(a) == len(b) for a, b in zip(parts, documents))


def test_repetition_is_small_and_damage_is_noticed():
    block = token_files.write_block([1], [np.array([7, 7, 7, 8] * 5000, np.uint32)])
    assert len(block) < 4000
    with pytest.raises(ValueError):
        token_files.read_block(block[:-1] + bytes([block[-1] ^ 1]))
    for at in range(token_files._HEADER.size):
        for bit in range(8):
            with pytest.raises(ValueError):
                token_files.read_block(block[:at] + bytes([block[at] ^ 1 << bit]) + block[at + 1 :])
    with pytest.raises(ValueError):
        token_files.write_block([1], [np.array([token_files.MAX_ALPHABET], np.uint32)])


@pytest.mark.parametrize("block_ids", [50, 1 << 20])
def test_token_index(spark, odd, none, library, block_ids, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", block_ids)
    more = spark.createDataFrame([(i, t) for i, t in enumerate(strings(200), 100)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(more)
    got = sorted(token_files.token_index(docs, word_bpe()).collect(), key=lambda r: r.start)
    assert [r.doc_id is None for r in got] == sorted((r.doc_id is None for r in got), reverse=True)
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert ids == sorted(ids) and [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    want = []
    for r in docs.collect():
        line = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((r.doc_id, len(line), zlib.crc32(line.tobytes())))
    assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], key=str) == sorted(want, key=str)
    assert token_files.token_index(none, word_bpe()).count() == 0


def test_read_back(spark, odd, tmp_path, library):
    token_files.write_token_files(odd, f"file://{tmp_path}/x", word_bpe())
    files = spark.read.parquet(f"file://{tmp_path}/x")
    got = {r.doc_id: bytes(r.ids) for r in token_files.read_token_files(files).collect()}
    assert got[7] == np.array([*library.encode("1234 --- 5678", add_special_tokens=False).ids, 1], "<u4").tobytes()


def test_words_are_remembered_without_their_marks_and_case(library):
    rng = random.Random(3)
    marks = "'s 've ''re .,;:!? <|x|> \t\n\x0b\x0c\x1c\x1d\x1f\x00\x7f '' 's's 12 </w> __ -- <|STARTOFTEXT|> I'M "
    texts = ["".join(rng.choice(marks + "abstIDLLvem") for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += [*strings(500), "", " ", "a" * 70 + ". " + "a" * 70, "</w> a</w>b", "'s's ''s '", "A DE, È 'S 12 à", "a de, 's 12"]
    latin = "".join(map(chr, range(0x250)))
    texts += [x + "a" + y + " " + x + y for x in latin for y in ("", "é", "'s")] + ["".join(rng.choice(latin) for _ in range(30)) for _ in range(500)]
    texts += ["\u212a\u212b \u1e9e", "e\u0301 a\u0307"]
    encoder = token_files._Encoder(word_bpe())
    for text, ids in zip(texts, encoder.ids(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    encoder = token_files._Encoder(word_bpe())
    list(encoder.ids(["Thanor, thanor. THANOR! (thanor)"]))
    assert sorted(encoder.cache) == ["!", "(", ")", ",", ".", "thanor"]


def test_words_of_latin_texts_are_looked_up_once(library, monkeypatch):
    encoder = token_files._Encoder(word_bpe())
    monkeypatch.setattr(encoder.cache, "unknown", lambda chunks: [] if not chunks else pytest.fail("a second lookup"))
    texts = ["Thanor, thanor. THANOR!", "l'été ÀÉ 12\x1cx", "", "thanor été"]
    for text, ids in zip(texts, encoder.ids(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_new_words_of_letters_are_encoded_many_at_once(library, monkeypatch):
    encoder = token_files._Encoder(word_bpe())
    monkeypatch.setattr(encoder, "piece", lambda word: pytest.fail(word) if word.isalpha() else encoder.one(word))
    texts = ["Thanor, ÀÉ été queci | zzxqv (other) l'an", "", "  ", "x\x1cy straße. a1b", "ſs Ĳ ǆ ñandú\tqueci\n"]
    for text, ids in zip(texts, encoder.ids(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_blocks_take_few_steps():
    lanes, steps = token_files._shape(1 << 20)
    assert steps == 16 and lanes * steps == 1 << 20
    assert token_files._shape(20_000)[1] > 250
    ids = np.random.default_rng(4).zipf(1.3, 1 << 18).clip(0, 49_000).astype(np.uint32)
    _, parts = token_files.read_block(token_files.write_block([1], [ids]))
    assert (parts[0] == ids).all()


def test_order0_ids_of_unordered_values():
    rng = np.random.default_rng(2)
    for alphabet, lanes in ((1, 1), (7, 40), (3000, 5000)):
        model = token_files._Model(alphabet, lanes)
        model.counts += rng.integers(0, 50, alphabet) ** 2
        model.rebuild()
        values = np.concatenate([rng.integers(0, 1 << 24, lanes), [0, (1 << 24) - 1]])
        bounds = model.bounds.astype(np.int64)
        ids = model.ids_at(values)
        assert (bounds[ids] <= values).all() and (values < bounds[ids + 1]).all()


def test_new_latin_words_go_to_the_library_in_short_lines(library):
    encoder, lines = token_files._Encoder(word_bpe()), []

    class Recorded:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, texts, **options):
            lines.extend(texts)
            return self.inner.encode_batch_fast(texts, **options)

    encoder.model_alone = Recorded(encoder.model_alone)
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdeéßŧıķ"), rng.integers(1, 9))) for _ in range(6000)]
    texts = [" ".join(words), words[0] + "," + words[1] + "! " + words[2].upper() + ".", ""]
    seen = []
    for _ in range(2):
        assert [x.tolist() for x in encoder.ids(texts)] == [library.encode(x, add_special_tokens=False).ids for x in texts]
        seen.append(len(lines))
    assert seen[0] == seen[1] > 1 and max(len(x.split()) for x in lines) <= 1000


def test_letters_that_leave_latin_in_lower_case_go_to_the_library_whole():
    encoder = token_files._Encoder(word_bpe())
    for letter in map(chr, [*range(0x80, 0x300), 0x1E9E, 0x212A, 0x4E2D, 0x1F600]):
        stays = max(map(ord, letter + letter.lower())) < 0x250
        assert encoder.lower_latin(f"a{letter}B") == (f"a{letter}B".lower() if stays else None)


def test_long_blocks_learn_from_a_part_of_the_lanes_in_turn():
    rng = np.random.default_rng(10)
    ids = rng.zipf(1.3, 1 << 19).clip(0, 40_000).astype(np.uint32)
    block = token_files.write_block([1, 2], [ids[:1000], ids[1000:]])
    assert (np.concatenate(token_files.read_block(block)[1]) == ids).all()
    assert len(block) < 1.3 * len(ids)
    lanes = token_files._shape(len(ids))[0]
    model, told = token_files._Model(10, lanes), []
    for _ in range(8):
        told += range(lanes)[model.told]
        model.predict()
        model.learn(rng.integers(0, 10, lanes))
    assert len(told) == lanes and set(told) == set(range(lanes))  # in turn all of them
    assert token_files._Model(10, token_files._shape(1000)[0]).told == slice(0, None, 1)
