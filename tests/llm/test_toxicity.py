import random

import numpy as np
import pytest

from spindrift.llm import toxicity as X

rng = random.Random(8)
NOUN = "cache queue window ledger folder buffer parser token".split()
CALM = ["The {} keeps the {} out of the {}.", "Please merge the {} and read the {}.", "Line 7 still says that the {} must drop a {}.", "Which {} does the {} read?"]
NEAR = ["Women and men on the team read the same {}.", "I was an idiot yesterday: the {} was fine.", "The {} locale is done, and Muslims on the team checked the names.", "Kill the child process before the {} hangs."]
BAD = ["You are a worthless idiot, leave the {} alone.", "Muslims are vermin and should be kept off the {}.", "Nice tits on the new hire at the {}.", "Touch my {} again and I will break your fingers.", "Du bist ein Vollidiot, lass {} in Ruhe."]


def fill(t):
    return t.replace("{}", "%s") % tuple(rng.choice(NOUN) for _ in range(t.count("{}")))


def text(*kinds):
    s = [fill(rng.choice(CALM)) for _ in range(5)] + [fill(rng.choice(k)) for k in kinds]
    rng.shuffle(s)
    return " ".join(s)


@pytest.fixture(scope="module")
def sample():
    docs = [(text(), 0) for _ in range(120)] + [(text(NEAR), 0) for _ in range(80)] + [(text(BAD), 1) for _ in range(90)]
    noisy = [(t, 1 - y if i % 25 == 0 else y) for i, (t, y) in enumerate(docs)]  # reviewers err
    return noisy


@pytest.fixture(scope="module")
def model(sample):
    return X.Classifier.fit([t for t, _ in sample], [y for _, y in sample])


def test_held_out_accuracy(model):
    held = [(text(), 0) for _ in range(100)] + [(text(NEAR), 0) for _ in range(100)] + [(text(BAD), 1) for _ in range(100)]
    got = X.Tables(model).scores([t for t, _ in held]) >= 0.5
    assert np.mean([g == bool(y) for g, (_, y) in zip(got, held)]) > 0.97


def test_disguises(model):
    t = X.Tables(model)
    for bad in ("YOU ARE A WORTHLESS IDIOT, LEAVE IT.", "You are a worthless i d i o t, leave it alone.", "You are a worthless 1d10t, leave it alone.", "You are a worthless id**t, leave it alone.", "You are a worthless idiiiiot, leave it alone.", "You are a wоrthless idiоt, leave it alone.", "You are a <b>worthless</b> idi​ot, leave it"):
        assert t.scores([bad])[0] >= 0.5, bad


def test_swapping_groups_hardly_changes_the_score(model):
    for s in ("the locale is done and {} on the team checked the names", "women and {} on the team read the same cache"):
        scores = [model.sentence_score(s.format(g).split()) for g in ("muslims", "jews", "women", "islanders", "germans")]
        assert max(scores) - min(scores) < 0.5 and max(scores) < 0


def test_counterfactuals_lower_false_positives_on_neutral_mentions():
    """A sample in which groups are named next to abuse only; held-out sentences name them neutrally."""
    hostile = "poison ruin infest plague corrupt rot stink leech breed swarm pollute steal lie cheat beg whine invade spoil wreck drain".split()
    named = ["muslims", "jews", "gays"]

    def abuse(g):
        a, b = rng.sample(hostile, 2)
        return f"All {g} {a} and {b} here."

    docs = [(text() + (f" All {rng.choice(NOUN)} {rng.choice(NOUN)} and {rng.choice(NOUN)} here." if i % 2 else ""), 0) for i in range(150)]
    docs += [(text() + " " + abuse(rng.choice(named)), 1) for _ in range(60)]
    neutral = [f"{g} and {h} read all {n} here." for n in NOUN for g in named for h in named if g != h]
    bad = [abuse(g) for g in (*named, "asians", "women", "germans") for _ in range(10)]
    wrong, found = {}, {}
    for strength in (0.0, X.COUNTERFACTUAL):
        t = X.Tables(X.Classifier.fit([d for d, _ in docs], [y for _, y in docs], counterfactual=strength))
        wrong[strength], found[strength] = float(np.mean(t.scores(neutral) >= 0.5)), float(np.mean(t.scores(bad) >= 0.5))
    assert wrong[0.0] > 0.5 and wrong[X.COUNTERFACTUAL] < wrong[0.0] / 2, wrong
    assert min(found.values()) >= 0.95, found


def test_tables_agree_with_the_classifier(model, sample):
    texts = [t for t, _ in sample[:50]] + ["", " ", "...", "a"]
    assert np.allclose(X.Tables(model).scores(texts), [model.score(t) for t in texts])
    assert list(X.Tables(model).scores(["", "!?"])) == [0.0, 0.0] and len(X.Tables(model).scores([])) == 0


def test_tables_leave_identifiers_out_as_the_classifier_does(model, sample):
    texts = ["You are a worthless idiot, leave parseRequestHeader alone.", "Touch readTheQueue again andThenSome and I will break your fingers.", "Please merge the window_Ledger and openFolderNow.", *(t.replace("the ", "the someLongName ") for t, _ in sample[:50])]
    assert np.allclose(X.Tables(model).scores(texts), [model.score(t) for t in texts])


def test_spelled():
    assert [X.spelled(t) for t in ("m0r0n", "b@stard", "id**t", "xx*yy", "clllown", "_word_", "read_line", "42", "*so*", "you're")] == ["moron", "bastard", "idiot", "xxyy*", "clown", "word", "", "", "so", "you're"]
    texts = ["an i d i o t here", "a b c", "words, and words", "", "m-o-r-o-n"]
    assert [bool(a) or X.joined(t) == t for a, t in zip(X.set_apart(texts), texts)] == [True] * 5 and not X.set_apart(texts[2:4]).any()


def test_documents(spark, sample):
    docs = spark.createDataFrame([(i, t, f"s{i % 2}", "c", 0.5) for i, (t, _) in enumerate(sample)] + [(900, None, "s0", "c", 0.5), (901, "", None, "c", 0.5), (None, BAD[0], "s1", "c", 0.5)] * 2, "doc_id long, text string, source string, flagged string, score double")
    labels = spark.createDataFrame([(i, "rev", y, None, {"k": "v"}) for i, (_, y) in enumerate(sample)] * 2 + [(0, "b", None, None, None), (None, "b", 1, None, None), (5000, "b", 1, None, None)], "doc_id long, reviewer string, toxic int, labelled_at timestamp, extra map<string,string>")
    s = X.scored(docs, labels).collect()
    assert len(s) == len(sample) + 6 and all(r.score == 0 and not r.flagged for r in s if r.doc_id in (900, 901)) and any(r.flagged for r in s if r.doc_id is None)
    assert sum(r.flagged for r in s) > 70
    rate = {r.source: r for r in X.rates(X.scored(docs, labels)).collect()}
    assert set(rate) == {"s0", "s1", None} and rate[None].flagged_share == 0
    assert not any(r.flagged for r in X.scored(docs, labels.limit(0)).collect()) and X.scored(docs.limit(0), labels).count() == 0


def test_votes_and_bound(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, "a", 1, None), (0, "b", 0, None), (1, "a", 1, None), (1, "b", 1, None), (1, "c", 0, None), (2, "a", 0, None), (3, "a", None, None)], "doc_id long, reviewer string, toxic int, labelled_at timestamp")
    texts, y = X.reviewed_sample(docs, labels)
    assert dict(zip(texts, y)) == {"text 1": 1, "text 2": 0} and len(X.reviewed_sample(docs, labels, most=1)[0]) == 1
