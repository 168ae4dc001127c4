import math
import zlib
from collections import Counter

import numpy as np

from wardledger.llm import language_model as lm


def corpus(words, n=120):
    return [(i, " ".join(w if k % 2 else f"the{i % 2}" for k, w in enumerate(words(40, seed=i, vocabulary=50)))) for i in range(n)]


def test_base_matches_plain_counts_and_the_model_beats_it(docs, words, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 64)  # most tokens take the join
    rows = [*corpus(words), (500, None), (501, ""), (502, "never seen ÉTÉ x"), (503, "the0"), (503, "the0")]
    rows += [(None, "the1 the1"), (504, " ".join(words(30_000, seed=4)))]
    found = lm.score_report(docs(*rows)).collect()
    assert len(found) == len(rows)
    tokens = lambda t: [*(t or "").encode().lower().split(), b" "]
    fold = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10
    counts = Counter(w for i, t in rows if fold(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    texts = dict(rows)
    for r in found:
        mine = tokens(texts[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (fold(r["doc_id"]) == 0, len(mine), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in mine)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in mine)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert r["score"] < 0
    held = [r for r in found if r["held_out"] and r["n_tokens"] > 5]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_class_probabilities_add_up(words):
    texts = [" ".join(words(300, seed=i, vocabulary=80)).encode() for i in range(3)]
    tokens = lm.tokens_of(texts)
    trainer = lm.Trainer(np.sort(np.unique(tokens.hashes)[:10]), 0.4)
    before = lm.class_scores(tokens, lm.ClassModel(trainer.singles, trainer.weights)).sum()
    for _ in range(5):
        trainer.learn(texts)
    model = lm.ClassModel(trainer.singles, trainer.weights)
    assert lm.class_scores(tokens, model).sum() > before
    rows = lm.features_of(tokens, lm.classes_of(tokens, model.singles))
    assert np.allclose(lm.class_probabilities(rows, model.weights).sum(axis=1), 1, atol=1e-4)


def test_scores_are_those_of_a_plain_softmax(words):
    texts = [" ".join(words(200, seed=i, vocabulary=60)).encode() for i in range(2)]
    tokens = lm.tokens_of(texts)
    trainer = lm.Trainer(np.sort(np.unique(tokens.hashes)[:10]), 0.4)
    trainer.learn(texts)
    classes = lm.classes_of(tokens, trainer.singles)
    rows = lm.features_of(tokens, classes)
    found = lm.class_scores(tokens, lm.ClassModel(trainer.singles, trainer.weights))
    for i in range(len(classes)):
        z = [sum(float(trainer.weights[r, k]) for r in rows[:, i]) for k in range(lm.CLASSES)]
        plain = z[classes[i]] - math.log(sum(math.exp(x) for x in z))
        assert math.isclose(found[i], plain / math.log(10), abs_tol=1e-4)


def test_sums_of_groups_of_any_size():
    random = np.random.default_rng(3)
    number = np.sort(np.concatenate([random.integers(0, 300, 900), np.full(200, 7), np.full(lm._FEW, 400), np.full(lm._FEW + 1, 401)]))
    values = random.normal(size=(len(number), 5))
    order = random.permutation(len(number))
    found, first, sizes = np.unique(number, return_index=True, return_counts=True)
    plain = np.zeros((402, 5))
    np.add.at(plain, number, values[order])
    assert np.allclose(lm.group_sums(values, order, first, sizes), plain[found])


def test_scores_do_not_depend_on_the_number_of_tasks(docs, words, monkeypatch):
    monkeypatch.setattr(lm, "SHARE", 1000)  # several shares
    table = docs(*corpus(words), (7, "the1 the1"), (7, "the1 the1"), (None, None))
    one, many = ({(r["doc_id"], r["n_tokens"]): r["score"] for r in lm.score_report(table.repartition(n)).collect()} for n in (1, 7))
    assert one.keys() == many.keys()
    assert all(math.isclose(one[k], many[k], rel_tol=1e-5) for k in one)


def learned(cases, singles):
    """Scores of the last word of each text after training on all; the other words share a suffix class."""
    trainer = lm.Trainer(np.sort(lm.tokens_of([singles]).hashes[:-1]), 0.4)
    for _ in range(60):
        trainer.learn([c.encode() for c in cases * 20])
    model = lm.ClassModel(trainer.singles, trainer.weights)
    tokens = lm.tokens_of([c.encode() for c in cases])
    return lm.class_scores(tokens, model)[np.flatnonzero(tokens.hashes == lm.END_HASH) - 1]


def test_both_words_before_decide_together():
    cases = ["mab mab yes", "mab nab no", "nab mab no", "nab nab yes"]  # neither word alone tells anything
    assert (learned(cases, b"yes no") > math.log10(0.8)).all()


def test_the_word_three_places_back_decides():
    cases = ["mab kab kab yes", "nab kab kab no"]
    assert (learned(cases, b"yes no") > math.log10(0.8)).all()


def test_features_stop_at_the_start_of_a_text():
    alone, after = lm.tokens_of([b"b c"]), lm.tokens_of([b"x y z", b"b c"])
    singles = np.empty(0, np.uint64)
    a = lm.features_of(alone, lm.classes_of(alone, singles))
    b = lm.features_of(after, lm.classes_of(after, singles))
    assert (a == b[:, 4:]).all()


def test_suffix_classes_and_places():
    t = lm.tokens_of([b"ab a", b"", b"xab"])
    assert t.owner.tolist() == [0, 0, 0, 1, 2, 2] and t.place.tolist() == [0, 1, 2, 0, 0, 1]
    assert t.suffix[0] == t.suffix[4] == zlib.crc32(b"ab") % lm.SUFFIXES and t.suffix[1] == zlib.crc32(b"a") % lm.SUFFIXES


def test_no_training_rows(docs):
    only_held_out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (r,) = lm.score_report(docs((only_held_out, "a b"))).collect()
    assert (r["train_tokens"], r["n_known"], r["base_score"]) == (0, 0, 0.0)
    assert lm.score_report(docs().limit(0)).count() == 0
