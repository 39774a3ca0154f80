import math
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from shoplens.llm import language_model as lm
from shoplens.llm.store import mounted, new_folder, shared_dir, shuffles_dropped
from shoplens.llm.words import one_hash, word_hashes

END = "\n"


def tokens(text):
    return [None, *(text or "").encode().lower().split(), END]


def held_out(id):
    return zlib.crc32(b"" if id is None else str(id).encode()) % 10 == 0


class Plain:
    """Modified Kneser-Ney bigrams, counted in dictionaries."""

    def __init__(self, texts):
        lines = [tokens(t) for t in texts]
        self.words = Counter(w for x in lines for w in x[1:])
        self.pairs = Counter(p for x in lines for p in zip(x, x[1:]))
        self.follows = Counter(b for _, b in self.pairs)
        self.d2, self.d1 = self.discounts(self.pairs), self.discounts(self.follows)

    @staticmethod
    def discounts(counts):
        return lm._discounts([0, 0, *(sum(c == i for c in counts.values()) for i in (1, 2, 3, 4))])

    def base(self, text):
        n, v = sum(self.words.values()), len(self.words)
        return sum(math.log10((self.words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(text)[1:])

    def single(self, word):
        out = 1 / (len(self.words) + 1)
        total = sum(self.follows.values())
        if total:
            free = sum(self.d1[min(c, 3)] for c in self.follows.values()) / total
            out = (self.follows[word] - self.d1[min(self.follows[word], 3)]) / total + free * out
        return out

    def pair(self, before, word):
        after = {b: c for (a, b), c in self.pairs.items() if a == before}
        if not after:
            return self.single(word)
        count, total = after.get(word, 0), sum(after.values())
        free = sum(self.d2[min(c, 3)] for c in after.values()) / total
        return (count - self.d2[min(count, 3)]) / total + free * self.single(word)

    def score(self, text):
        return sum(math.log10(self.pair(a, b)) for a, b in zip(tokens(text), tokens(text)[1:]))


def test_word_hashes_cut_at_ascii_white_space_and_fold_ascii():
    hashes, begin, end, before = word_hashes(pa.array([None, "", "a B a\tç\x0bb  A z", "ab ba", "y" * 2_500_000]))
    assert before.tolist() == [0, 0, 0, 6, 8, 9]
    assert hashes[0] == hashes[2] and hashes[1] == hashes[4] and len(set(hashes.tolist())) == 7
    assert hashes[8] == one_hash("Y" * 2_500_000)


@pytest.mark.parametrize("shard_bytes", [1 << 20, 60])
def test_scores_equal_those_of_dictionaries(spark, shard_bytes, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_GRAMS", 50)
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(list("aabbbcdefG"), rng.integers(0, 25))) for _ in range(60)] + ["zz yy", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folder = new_folder(spark, "model")
    train = [t for i, t in enumerate(texts) if not held_out(i)]
    lm.train(docs.filter(~lm.held_out(docs.doc_id)), "text", folder, 2, shard_bytes)
    plain = Plain(train)
    for r in lm.score(docs, folder).collect():
        assert r.score == pytest.approx(plain.score(texts[r.doc_id]), abs=1e-9)
        assert r.base_score == pytest.approx(plain.base(texts[r.doc_id]), abs=1e-9)
        assert r.n_tokens == len(tokens(texts[r.doc_id])) - 1 and r.train_tokens == sum(plain.words.values())
        assert r.n_known == sum(w in plain.words for w in tokens(texts[r.doc_id])[1:])


@pytest.mark.parametrize("order", [1, 2, 3])
def test_probabilities_of_all_words_sum_to_one(spark, order):
    docs = spark.createDataFrame([("a b a b c",), ("b a d",), ("c a b",)], "text string")
    folder = new_folder(spark, "model")
    lm.train(docs, "text", folder, order)
    words = np.array([*(one_hash(w) for w in "abcd"), lm.END, one_hash("unseen")], np.uint64)
    for context in ("ab", "ba", "da", "zz"):
        before = [np.full(len(words), one_hash(c), np.uint64) for c in context][2 - order + 1 :]
        assert lm.Model(folder).probabilities([*before, words]).sum() == pytest.approx(1)


class PlainOrder:
    """Modified Kneser-Ney of any order over the same discounts, counted in dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        self.levels = {order: Counter()}
        for text in texts:
            line = [*[None] * (order - 1), *tokens(text)[1:]]
            self.levels[order].update(tuple(line[i : i + order]) for i in range(len(line) - order + 1))
        self.words = {gram[-1] for gram in self.levels[order]}
        for n in range(order - 1, 0, -1):
            self.levels[n] = Counter()
            for gram, count in self.levels[n + 1].items():
                # What begins a text keeps its count: nothing stands on its left.
                self.levels[n][gram[1:]] += count if gram[1] is None else 1
        self.discounts = {n: Plain.discounts(c) for n, c in self.levels.items()}

    def probability(self, gram):
        if not gram:
            return 1 / (len(self.words) + 1)
        after = {g: c for g, c in self.levels[len(gram)].items() if g[:-1] == gram[:-1]}
        lower, d = self.probability(gram[1:]), self.discounts[len(gram)]
        if not after:
            return lower
        count, total = after.get(gram, 0), sum(after.values())
        return (count - d[min(count, 3)] + sum(d[min(c, 3)] for c in after.values()) * lower) / total

    def score(self, text):
        line = [*[None] * (self.order - 1), *tokens(text)[1:]]
        return sum(math.log10(self.probability(tuple(line[i : i + self.order]))) for i in range(len(line) - self.order + 1))


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("copies", [1, 3, 4])
def test_scores_of_higher_orders_and_of_copied_texts(spark, order, copies):
    rng = np.random.default_rng(order)
    words = [f"w{i}" for i in range(30)]
    learnt = [" ".join(words[min(29, int(rng.geometric(0.1)))] for _ in range(rng.integers(1, 15))) for _ in range(40)]
    learnt = learnt * copies + [" ".join(rng.choice(words, 8)) for _ in range(20 if copies > 1 else 0)]
    folder = new_folder(spark, "model")
    lm.train(spark.createDataFrame([(t,) for t in learnt], "text string"), "text", folder, order, 300)
    plain = PlainOrder(learnt, order)
    other = [" ".join(rng.choice([*words, "new"], 10)) for _ in range(40)] + learnt[:5] + [""]
    docs = spark.createDataFrame(list(enumerate(other)), "doc_id long, text string")
    for r in lm.score(docs, folder).collect():
        assert math.isfinite(r.score) and r.score == pytest.approx(plain.score(other[r.doc_id]), abs=1e-9)


def test_odd_rows(spark, odd, none):
    found = lm.score_held_out(odd).collect()
    assert len(found) == odd.count() and all(r.n_tokens >= 1 and math.isfinite(r.score) for r in found)
    assert {r.n_tokens for r in found if r.doc_id in (3, 4, 5)} == {1}
    assert all(r.held_out == held_out(r.doc_id) for r in found)
    assert lm.score_held_out(none).count() == 0


def test_held_out_scores_use_two_words_of_context(spark):
    learnt = [i for i in range(100) if not held_out(i)][:40]
    other = [i for i in range(100) if held_out(i)][:2]
    rows = [(i, "x a b" if n % 2 else "y a c") for n, i in enumerate(learnt)] + list(zip(other, ("x a b", "x a c")))
    got = {r.doc_id: r.score for r in lm.score_held_out(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[other[0]] > got[other[1]] + 1  # word pairs alone give both the same score


def test_frequent_contexts_are_kept_apart_from_small_ones(spark):
    """Contexts of more than 255 take wide numbers, the others one byte each; scores are the same."""
    texts = ["a b c d e f g h i j k l m n o p"] * 300 + ["a x", "b a y z w", "c a", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    folder = new_folder(spark, "model")
    lm.train(docs, "text", folder, 2, 1 << 20)
    path = lm.mounted(folder)
    assert all(np.load(x).dtype == np.uint8 for x in path.glob("order2-*-stats.npy"))
    assert sum(len(np.load(x)) for x in path.glob("order2-*-widecontexts.npy")) >= 2
    plain = Plain(texts)
    for r in lm.score(docs, folder).collect():
        assert r.score == pytest.approx(plain.score(texts[r.doc_id]), abs=1e-9)


def test_shuffled_blocks_leave_the_disk_with_their_query(spark, tmp_path):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = manager.getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    before = shuffled()
    kept = spark.range(1000).repartition(3, "id")
    with shuffles_dropped(spark):
        kept.write.parquet(str(tmp_path / "dropped"))
        for _ in range(100):
            if not shuffled() - before:
                break
            time.sleep(0.1)
        assert not shuffled() - before
    spark.range(1000).repartition(3, "id").write.parquet(str(tmp_path / "kept"))
    assert shuffled() - before


def test_blocks_of_grams_round_trip_and_are_small():
    rng = np.random.default_rng(6)
    drawn = [lm.mix(x.astype(np.uint64)) for x in rng.zipf(1.2, (3, 50_000)).clip(0, 3000)]
    for order in (3, 2, 1):
        keys, columns, counts = lm.summed(drawn[:order])
        ((_, data),) = lm._packed(columns, counts, lm.Placing(1))
        got = lm.summed(*lm._unpacked([data], order))
        assert (got[0] == keys).all() and (got[2] == counts).all() and all((a == b).all() for a, b in zip(got[1], columns))
        if order == 3:
            assert len(data) < 2.9 * len(counts)  # 3.2 with words in the order of their hashes
    assert lm._unpacked([lm._block([np.zeros(0, np.uint64)] * 2, np.zeros(0, np.uint64))], 2)[1].size == 0


def test_blocks_of_numbered_grams_carry_no_list_of_words():
    rng = np.random.default_rng(7)
    drawn = [(x % 1_000_000 + 2).astype(np.uint32) for x in rng.zipf(1.2, (3, 50_000)).astype(np.uint64)]
    keys, columns, counts = lm.summed(drawn)
    blocks = [data for _, data in lm._packed(columns, counts, lm.Placing(40))]
    got = lm.summed(*lm._unpacked(blocks, 3))
    assert (got[0] == keys).all() and (got[2] == counts).all() and all((a == b).all() for a, b in zip(got[1], columns))
    assert sum(map(len, blocks)) < 4.5 * len(counts)  # 5.1 with a list of words in each block


def test_a_model_keeps_a_context_once_and_leaves_nothing_else(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 60).clip(0, 5000)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folder = new_folder(spark, "model")
    lm.train(docs, "text", folder, 3, 4 << 10)
    path = mounted(folder)
    assert not [x for x in path.iterdir() if x.is_dir()]
    grams = lm.Model(folder).levels[3]["sums"][0]
    contexts = sum(len(np.load(x)) for x in path.glob("order3-*contexts.npy"))
    assert grams > 10_000 and contexts > 5000
    held = sum(np.load(x).nbytes for x in path.glob("order3-*.npy"))
    assert held < 15 * contexts + 5.5 * grams  # n-grams by hashes of 8 bytes: 12 a context and 9 an n-gram
    plain = PlainOrder(texts, 3)
    for r in lm.score(docs.limit(5), folder).collect():
        assert r.score == pytest.approx(plain.score(texts[r.doc_id]), abs=1e-9)
    before = {x.name for x in mounted(shared_dir(spark)).iterdir()}
    lm.score_held_out(docs).count()
    assert {x.name.split("-")[0] for x in mounted(shared_dir(spark)).iterdir() if x.name not in before} == {"scores"}


def test_words_are_numbered_by_frequency(spark):
    texts = ["a " * 50 + "b " * 20 + "c"] * 4 + ["d e"]
    folder = new_folder(spark, "model")
    lm.train(spark.createDataFrame([(t,) for t in texts], "text string"), "text", folder, 2, 1 << 20)
    hashes = np.array([*(one_hash(w) for w in "abcd"), lm.BEGIN, one_hash("unseen")], np.uint64)
    numbers, counts = lm.Model(folder).numbers.find(hashes)
    assert numbers.tolist()[:2] == [lm.FIRST_NUMBER, lm.FIRST_NUMBER + 1] and numbers.tolist()[4:] == [lm.BEGIN_NUMBER, lm.UNKNOWN]
    assert counts.tolist() == [200, 80, 4, 1, 0, 0]
