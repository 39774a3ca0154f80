import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shoplens.llm import chunking, language_id, licences
from shoplens.llm.decontamination import MASKS, find_overlaps, longest_overlap, patterns
from shoplens.llm.store import packed


def words(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(n))


# -- chunks --------------------------------------------------------------------------


def test_gear_hash_rolls_over_sixteen_bytes():
    data = np.frombuffer(b"some bytes that are hashed, some bytes that are hashed", np.uint8)
    want = [sum(int(chunking._GEAR[b]) << k for k, b in enumerate(data[max(0, i - 15) : i + 1][::-1])) % (1 << 32) for i in range(len(data))]
    assert chunking.gear_hashes(data).tolist() == want


def test_cuts_are_local_minima_and_survive_insertions():
    rng = random.Random(1)
    data = np.frombuffer(words(rng, 900).encode(), np.uint8)
    hashes, w = chunking.gear_hashes(data), chunking.WINDOW
    want = [i + 1 for i in range(w, len(data) - w) if hashes[i] < hashes[i - w : i].min() and hashes[i] < hashes[i + 1 : i + w + 1].min()]
    assert chunking.chunk_ends(data).tolist() == [*want, len(data)]

    def chunks(x):
        ends = chunking.chunk_ends(x)
        return [x[a:b].tobytes() for a, b in zip([0, *ends], ends)]

    moved = chunks(np.concatenate([data[:2000], np.frombuffer(b"inserted", np.uint8), data[2000:]]))
    assert len(set(chunks(data)) - set(moved)) <= 4
    assert max(map(len, chunks(np.zeros(10_000, np.uint8)))) <= chunking.LONGEST and len(chunking.chunk_ends(data[:0])) == 0


def test_repeats_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(chunking, "BLOCK_CHUNKS", 60)
    monkeypatch.setattr(chunking, "SHARD_BYTES", 4000)
    rng = random.Random(2)
    shared = [words(rng, 70) for _ in range(5)]
    texts = [" ".join([words(rng, 40), shared[i % 5], words(rng, 40)]) if i % 2 else words(rng, 90) for i in range(60)] + [shared[0], None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").orderBy("text")
    places = {r.id: r.places for r in chunking.repeats(docs).groupBy("id").agg(F.flatten(F.collect_list(F.array("places"))).alias("places")).collect()}
    assert len(places) == chunking.repeats(docs).count()  # a row per document, whatever the number of shards
    got = {r.doc_id: r for r in chunking.dedup_substrings(docs).collect()}
    seen = {}
    for i, text in enumerate(texts):
        data = np.frombuffer((text or "").encode(), np.uint8)
        ends = chunking.chunk_ends(data)
        own = [data[a:b].tobytes() for a, b in zip([0, *ends], ends)]
        later = []
        for n, x in enumerate(own):
            later += [n] if seen.setdefault(x, i) != i else []
        assert sorted(np.frombuffer(b"".join(places.get(i, [])), "<u4").tolist()) == later
        assert got[i].n_chunks == len(own) and (got[i].n_repeats > 0) == (got[i].removed_bytes > 0) and got[i].n_repeats <= len(later)
    # The first of each shared passage stays, later ones go, other texts are left alone.
    for i, text in enumerate(texts[:60]):
        if i % 2 == 0 or i < 10:
            assert got[i].text == text
        else:
            assert got[i].removed_bytes > 250 and shared[i % 5] not in got[i].text
            assert text.startswith(got[i].text[:150]) and set(got[i].text.split()) <= set(text.split())
    assert got[60].removed_bytes > 250 and got[61].text is None and got[62].text == ""


@pytest.mark.parametrize("longest, least", [(1, 0.85), (2, 0.97), (4, 0.99), (6, 0.99), (9, 0.99), (14, 0.99)])
def test_passages_of_over_fifty_words_go(spark, longest, least):
    rng = random.Random(longest)

    def some(n, low=2, high=9):
        return " ".join("".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randrange(low, high))) for _ in range(n))

    rows, phrases = [], []
    for i in range(150):
        passage, phrase = some(51, 1, longest + 1), some(25)
        rows += [(4 * i + j, f"{some(60)} {passage} {some(60)}") for j in (0, 1)]
        rows += [(4 * i + j, f"{some(60)} {phrase} {some(60)}") for j in (2, 3)]
    got = {r.doc_id: r.n_repeats > 0 for r in chunking.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[4 * i + 1] for i in range(150)) >= 150 * least
    assert not any(got[4 * i + j] for i in range(150) for j in (0, 2, 3))


def test_a_repeated_word_goes_like_any_passage(spark):
    rng = random.Random(3)
    rows = [(i, f"{words(rng, 60 + i)} {f'word{i // 2} ' * 80}{words(rng, 60)}") for i in range(100)]
    got = {r.doc_id: r.removed_bytes for r in chunking.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] > 300 for i in range(1, 100, 2)) and not any(got[i] for i in range(0, 100, 2))


def test_a_text_is_passed_once_and_shards_are_small(spark, odd, monkeypatch):
    seen = []
    monkeypatch.setattr(chunking, "packed", lambda *x, **y: seen.append(packed(*x, **y)) or seen[-1])
    assert chunking.dedup_substrings(odd).columns[: len(odd.columns)] == odd.columns
    assert seen[0].schema["row"].dataType.names == [c for c in odd.columns if c != "text"]
    assert chunking.SHARD_BYTES <= 16 << 20  # some 36 bytes for each 34 of text, held several times by a task


def test_chunks_of_odd_rows(odd, none):
    got = chunking.dedup_substrings(odd).collect()
    assert len(got) == odd.count()
    texts = {r.doc_id: r for r in got}
    assert texts[3].text is None and texts[4].text == "" and texts[10].text == "Released under the MIT License."
    assert texts[1].key == "key" and texts[1].row == "row"
    assert [r.removed_bytes for r in got if r.doc_id == 2] == [0, 0]  # under the shortest run
    assert chunking.dedup_substrings(none).count() == 0


# -- benchmark passages --------------------------------------------------------------


def test_overlaps_with_replaced_words(spark):
    rng = random.Random(3)
    items = [(i, words(rng, rng.randrange(16, 60))) for i in range(20)] + [(20, words(rng, 7)), (21, "too short"), (22, None), (23, "")]
    docs = []
    for n in range(120):
        passage = [f"zz{n}" if rng.random() < 0.08 else w for w in items[n % 20][1].upper().split()]
        docs.append((n, " ".join([words(rng, n % 50), *passage, words(rng, 30)])))
    docs += [(200 + n, words(rng, 60)) for n in range(60)] + [(300, "a b " + items[20][1] + " too short"), (301, items[20][1][:-3]), (None, items[0][1])]
    got = find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert pairs <= {(n, n % 20) for n in range(120)} | {(300, 20), (None, 0)} and len(pairs) >= 119
    assert {(300, 20), (None, 0)} <= pairs
    whole = {r.doc_id: r for r in got}[300]
    assert (whole.first_word, whole.n_words, whole.n_matches) == (2, 7, 7)


def test_exact_passages_equal_brute_force(spark):
    rng = random.Random(4)
    items = [(i, " ".join(rng.choice("abcdefgh") for _ in range(30))) for i in range(6)]
    docs = [(n, " ".join([words(rng, 20), *items[n % 6][1].split()[n % 10 : n % 10 + 8 + n % 12], words(rng, 20)])) for n in range(60)]
    got = {(r.doc_id, r.item_id) for r in find_overlaps(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    exact = {(n, n % 6) for n in range(60) if 8 + n % 12 >= 12}
    assert exact <= got and all(i == n % 6 for n, i in got)


@pytest.mark.parametrize("n, least", [(9, 0.85), (10, 0.99), (11, 0.99), (12, 0.99), (13, 0.99), (15, 0.99), (16, 0.99), (20, 0.99)])
def test_share_of_overlaps_that_the_masks_hit(n, least):
    """Over all ways to replace a quarter of an overlap's words, the first and the last being equal."""
    shapes, hit, total = patterns([]), 0, 0
    for changed in combinations(range(1, n - 1), n // 4):
        gone = set(changed)
        hit += any(not gone & {at + x for x in shape} for shape in shapes for at in range(n - shape[-1]))
        total += 1
    assert len(shapes) == len(MASKS) and hit / total >= least


def test_an_overlap_ends_where_it_ends(spark):
    rng = random.Random(10)
    item = words(rng, 400).split()
    passage = [w if i < 20 or i % 4 else f"zz{i}" for i, w in enumerate(item)]  # seeds hit its beginning only
    docs = spark.createDataFrame([(1, " ".join([words(rng, 50), *passage, words(rng, 50)]))], "doc_id long, text string")
    (row,) = find_overlaps(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert (row.first_word, row.n_words, row.n_matches) == (50, 400, 305)


def test_longest_overlap_equals_brute_force():
    rng = np.random.default_rng(8)
    for n in range(300):
        same = rng.random(n % 40) < (0.5, 0.75, 0.9)[n % 3]
        least = (1, 5, 12)[n // 3 % 3]
        fit = [(b - a, int(same[a:b].sum()), -a) for a in range(len(same)) for b in range(a + least, len(same) + 1)
               if same[a] and same[b - 1] and same[a:b].sum() >= 0.75 * (b - a)]
        length, _, begin = max(fit, default=(0, 0, 0))
        assert longest_overlap(same, least) == (-begin, length - begin)


def test_overlap_longer_than_its_clean_core(spark):
    rng = random.Random(9)
    item = words(rng, 12).split()
    passage = [*item[:8], "zz1", "zz2", *item[10:]]  # 10 of 12 words; the first 8 alone are too few
    docs = [(1, " ".join([words(rng, 20), *passage, words(rng, 20)])), (2, " ".join([words(rng, 20), *item[:8], words(rng, 24)]))]
    got = find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"),
                        spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.first_word, r.n_words, r.n_matches) for r in got] == [(1, 20, 12, 10)]


def test_overlaps_of_odd_rows(spark, odd, none):
    benchmark = spark.createDataFrame([(None, "the quick brown fox jumps over the lazy dog and runs away"), (1, None)], "item_id long, text string")
    got = find_overlaps(odd, benchmark).collect()
    assert sorted((r.doc_id, r.item_id, r.n_words) for r in got) == [(1, None, 12), (2, None, 12)]
    assert find_overlaps(none, benchmark).count() == find_overlaps(odd, benchmark.limit(0)).count() == 0


# -- languages -----------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 4, 7, 8, 40])
def test_codewords_differ(n):
    codes = language_id.codewords(n)
    assert len(codes) == n and (n == 1 or len({tuple(c) for c in codes}) == n)
    assert n == 1 or min((a != b).sum() for i, a in enumerate(codes) for b in codes[:i]) >= max(1, codes.shape[1] // 5)


def test_languages_are_told_apart_on_held_out_texts(spark):
    rng = random.Random(5)
    alphabets = {"aa": "abcde", "bb": "cdefg", "cc": "efghi", "dd": "éàüab"}
    rows = [(i, words(rng, rng.randrange(5, 40), alphabets[lang]), lang) for i, lang in enumerate(list(alphabets) * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    held = [i for i, r in got.items() if r.held_out]
    assert len(held) > 40 and np.mean([got[i].lang_pred == rows[i][2] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_languages_of_odd_rows(odd, none):
    got = language_id.identify(odd).collect()
    assert len(got) == odd.count()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (3, 4, 5, 7))
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 8, 9)} == {"en"}
    assert language_id.identify(none).count() == 0
    plain = language_id.predict(odd, language_id.fit(none))
    assert {r.lang_pred for r in plain.collect()} == {"und"} and plain.columns.count("lang_pred") == 1


def test_ngrams_stay_within_texts():
    together, owner = language_id.ngram_bins(pa.array(["Ab  1c", None, "dé", ""]))
    apart = [language_id.ngram_bins(pa.array([t]))[0] for t in ("ab c", "", "dé", "")]
    assert [sorted(together[owner == i]) for i in range(4)] == [sorted(x) for x in apart]


# -- licences ------------------------------------------------------------------------


def test_licences_despite_case_punctuation_spelling_and_holder(spark, odd, none):
    mit = dict((b, a) for a, b in licences.KNOWN if "furnished to do so" in b and b.startswith("MIT License"))
    body = next(iter(mit))
    rows = [
        (1, body.replace("MIT License\n", "mit licence\r\n\r\nCopyright (c) 2020 Somebody\n\n")),
        (2, body.upper().replace(",", " ;").replace(" ", "  ")), (3, body + " x"), (4, None), (5, ""),
        (6, "text\nReleased under the MIT licence!\nmore\nLicensed under CC BY-NC 4.0."), (None, "  released under the mit license"),
    ]
    got = {r.doc_id: (r.licence, r.line_licences) for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", ""), 2: ("MIT", ""), 3: (None, ""), 4: (None, ""), 5: (None, ""), 6: (None, "CC-BY-NC-4.0,MIT"), None: ("MIT", "MIT")}
    assert licences.scan_licences(odd).count() == odd.count() and licences.scan_licences(none).count() == 0


def test_licence_scan_has_no_shuffle_and_no_python(odd):
    plan = licences.scan_licences(odd)._jdf.queryExecution().executedPlan().toString()
    for word in ("Exchange hashpartitioning", "Python", "Arrow", "NestedLoop", "Cartesian"):
        assert word not in plan
