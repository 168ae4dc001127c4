import random

from wardledger.llm.langid import detect_language, fit, foreign, identified, language_report

STEMS = {"en": ["the", "ing", "th", "ation", "of"], "de": ["der", "sch", "ung", "keit", "ü"], "fr": ["eau", "que", "é", "les", "ç"]}


def corpus(n, seed=0):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = ("en", "de", "fr")[i % 3]
        rows.append((i, " ".join("".join(r.choice(STEMS[lang]) for _ in range(r.randint(1, 3))) for _ in range(30)), lang))
    return rows


def test_held_out_documents_are_recognized(docs):
    rows = corpus(240)
    found = {r["doc_id"]: r for r in language_report(docs(*rows)).collect()}
    held = [i for i, _, _ in rows if found[i]["held_out"]]
    assert 40 < len(held) < 120
    assert sum(found[i]["lang_pred"] == rows[i][2] for i in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_odd_rows(docs):
    rows = [*corpus(120), (500, None), (501, ""), (502, "12 34 !!"), (None, "the thing", None), (503, "éeau lesque " * 30_000, None)]
    model = fit(docs(*rows))
    assert model == model and set(model.languages) == {"en", "de", "fr"}
    found = {r["doc_id"]: r for r in detect_language(docs(*rows), model).collect()}
    for i in (500, 501, 502):
        assert (found[i]["lang_pred"], found[i]["score"], found[i]["rejected"]) == ("und", 0.0, True)
    assert found[None]["lang_pred"] == "en" and found[503]["lang_pred"] == "fr"
    kept = identified(docs(*rows), model)
    assert kept.columns == docs(*rows).columns
    assert {r["doc_id"] for r in kept.collect()} >= {i for i, _, _ in corpus(120)}
    assert not {500, 501, 502} & {r["doc_id"] for r in kept.collect()}


def test_without_labels_or_rows(docs):
    unlabelled = docs((1, "some text", None))
    assert fit(unlabelled) is None
    assert [r["lang_pred"] for r in detect_language(unlabelled, None).collect()] == ["und"]
    assert language_report(docs().limit(0)).count() == 0


def test_repeated_ids_do_not_grow_the_sample(docs):
    model = fit(docs(*([(1, "the thing", "en")] * 300 + [(2, "der schung", "de")])), rows_per_language=10)
    assert model.languages == ["de", "en"]


def test_gibberish_and_unlearned_languages_go_and_clean_texts_stay(docs):
    rows = corpus(300)
    model = fit(docs(*rows))
    r = random.Random(5)
    noise = [" ".join("".join(r.choice("qzxjwvkpgfhmbdc") for _ in range(r.randint(2, 8))) for _ in range(n)) for n in (4, 12, 60, 400)]
    slavic = ["to jest zdanie po polsku ktore nie powinno byc rozpoznane", "każdy dzień przynosi nowe możliwości wszystkim ludziom w mieście"]
    other = ["これは日本語の文章です", "Это предложение написано по-русски и не должно быть узнано"]
    planted = [(1000 + i, t) for i, t in enumerate([*noise, *slavic, *other])]
    fresh = [(2000 + i, t, x) for i, t, x in corpus(60, seed=9)]
    kept = {x["doc_id"] for x in identified(docs(*planted, *fresh), model).collect()}
    assert kept == {i for i, _, _ in fresh}
    found = {x["doc_id"]: x for x in detect_language(docs(*planted, *fresh), model).collect()}
    assert all(found[i]["lang_pred"] in ("en", "de", "fr") and found[i]["score"] < 0.1 for i, _ in planted)


def test_each_of_many_languages_is_learned(docs):
    r = random.Random(3)
    stems = {f"l{k:02d}": ["".join(r.choice("abcdefghijklmnoprstuvz") for _ in range(r.randint(2, 4))) for _ in range(6)] for k in range(11)}
    rows = [(i, " ".join("".join(r.choice(stems[x]) for _ in range(2)) for _ in range(20)), x) for i, x in enumerate(sorted(stems) * 60)]
    model = fit(docs(*rows[:440]), rows_per_language=40)
    found = detect_language(docs(*rows[440:]), model).collect()
    assert len(model.languages) == 11
    assert sum(x["lang_pred"] == rows[x["doc_id"]][2] for x in found) >= 0.97 * len(found)


def test_texts_of_no_language_keep_their_shape():
    text = "Der  Hund,\nläuft 12 mal! Ж"
    for seed in range(6):
        out = foreign(text, seed)
        assert len(out) == len(text) and [c.isalpha() for c in out] == [c.isalpha() for c in text]
        assert foreign(text, seed) == out
    assert foreign("", 1) == "" and foreign("12 !", 2) == "12 !"
