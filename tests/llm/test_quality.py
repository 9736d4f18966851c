import random

import numpy as np
import pytest

from flowskein.llm import quality

NOUNS = "parser edge report queue node session ledger worker service cache".split()


def prose(r):
    starts = ["At first", "Even so,", "In this case", "After the second run", "As far as I can tell,", "For now"]
    lines = [f"{r.choice(starts)} the {r.choice(NOUNS)} of the {r.choice(NOUNS)} came out empty, and it is not clear who keeps the {r.choice(NOUNS)}." for _ in range(r.randrange(3, 9))]
    mark = r.choice(["", "", "// ", "# ", "> ", "* "])
    return "\n".join(mark + x for x in lines)


def other(r):
    kind = r.choice(["list", "table", "code", "junk"])
    n = r.randrange(6, 20)
    if kind == "list":
        return kind, "\n".join(f"- {r.choice(NOUNS)} {r.choice(NOUNS)}" for _ in range(n))
    if kind == "table":
        return kind, "\n".join(f"{r.choice(NOUNS)};{r.randrange(999)};{r.choice(NOUNS)}" for _ in range(n))
    if kind == "code":
        return kind, "\n".join(f"\t{r.choice(NOUNS)} := {r.choice(NOUNS)}.Load({r.randrange(9)}, ctx)" for _ in range(n))
    return kind, "".join(r.choice("0123456789{}[]!?#@ ") for _ in range(200))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    return [("prose", prose(r)) if r.random() < 0.5 else other(r) for _ in range(240)]


def test_held_out_accuracy(corpus):
    train, test = corpus[:160], corpus[160:]
    profiles = quality.Profiles().fit([t for _, t in train], [s for s, _ in train])
    right = 0
    for shape, text in test:
        right += (quality.describe_batch(profiles, [1], [quality.units(text)])["prose_share"][0] >= 0.5) == (shape == "prose")
    assert right / len(test) >= 0.95


def test_documents_of_every_kind(spark, corpus):
    docs = [(i, t, "x") for i, (_, t) in enumerate(corpus)] + [(900, None, "x"), (901, " \n\t", "x"), (902, "", "x"), (None, "the edge", "x"), (903, "word " * 100_000, "x")]
    documents = spark.createDataFrame(docs, "doc_id bigint, text string, shape string")
    labels = spark.createDataFrame([(i, s, "a") for i, (s, _) in enumerate(corpus[:160])] + [(0, "odd", "b"), (None, "prose", "a"), (5_000, "junk", "a")], "doc_id bigint, shape string, labeller string")
    rows = quality.profile_documents(documents, quality.fit_profiles(documents, labels)).collect()
    assert len(rows) == len(docs)
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["shape"] == "blank" and by[i]["prose_share"] == 0 for i in (900, 901, 902)) and by[903]["n_units"] == 1
    assert quality.profile_documents(documents.limit(0), quality.fit_profiles(documents.limit(0), labels)).count() == 0


def test_marks_come_off():
    cut = quality.units("// one line\n// and another\n\n- [x] done\n1. first\nreviewer: this is what a reviewer has to say about it")
    assert [(k, b) for k, b, _ in cut] == [("//", ["one line", "and another"]), ("[]", ["done"]), ("1.", ["first"]), ("who:", ["this is what a reviewer has to say about it"])]


def test_divergence():
    p, q = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    assert quality.jsd(p, p) == 0 and quality.jsd(p, q) == 1 and np.allclose(quality.jsds(np.array([p, q]), p), [0, 1])


def test_basic_counts(spark):
    rows = quality.basic_statistics(spark.createDataFrame([(1, "The end. \n\nof it!\nxx"), (2, None), (3, "")], "doc_id bigint, text string")).collect()
    first = rows[0].asDict()
    assert (first["n_words"], first["n_lines"], first["ended_line_share"], first["common_word_share"]) == (5, 3, round(2 / 3, 6), round(3 / 5, 6))
    assert all(r["n_words"] == 0 and r["symbol_share"] == 0 for r in rows[1:])


def test_counts_know_all_languages(spark):
    texts = ["Der Knoten ist nicht mit der Kante", "El nodo no es la clave de esta cola", "C'est l'arête du graphe, et d’abord la file", "この文書はとても短い。\nまた見ることにします！", "The end of the line", "xq zk 17"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    of = lambda *a: {r["doc_id"]: r.asDict() for r in quality.basic_statistics(docs, *a).collect()}
    every, english = of(), of(("en",))
    assert [every[i]["common_word_share"] for i in (0, 1, 2, 4, 5)] == [round(5 / 7, 6), round(6 / 9, 6), round(6 / 8, 6), 0.6, 0.0]
    letters = "この文書はとても短いまた見ることにします"
    assert every[3]["common_word_share"] == round(sum(c in quality._KANA for c in letters) / len(letters), 6) and every[3]["ended_line_share"] == 1.0
    assert english[4]["common_word_share"] == 0.6 and english[3]["ended_line_share"] == 0.0


def test_same_method_whatever_the_labels(corpus):
    """Without labels, or with labels of one kind, the examples of the module give all profiles."""
    for labelled in ([], [x for x in corpus if x[0] == "prose"][:60], [x for x in corpus if x[0] == "code"][:40]):
        profiles = quality.Profiles().fit([t for _, t in labelled], [s for s, _ in labelled])
        assert set(profiles.shape_of) == set(range(len(quality.SHAPES)))
        found = quality.describe_batch(profiles, list(range(len(corpus))), [quality.units(t) for _, t in corpus])
        right = (found["prose_share"] >= 0.5) == np.array([s == "prose" for s, _ in corpus])
        assert right.mean() >= 0.75


def test_batches_do_not_change_what_is_measured():
    """Units measured together equal the same units measured one by one."""
    texts = ["The node's file is (not) here_yet: see src/a.go.\nIt was there, and it is not.", "", "c'est l’arête d'un graphe", "//\n// x", "この文書はとても短いです。", "a\tb\t12\n-\t-\t\n", "Ωμέγα и слово 한글", "\x00\ud800 odd", "x" * 5_000]
    cut = [u for t in texts for u in quality.units(t)]
    together = quality.measure(cut)
    for i, u in enumerate(cut):
        one = quality.measure([u])
        assert np.allclose(one.plain[0], together.plain[i]) and np.allclose(one.chars[0], together.chars[i]) and np.allclose(one.steps[0], together.steps[i])
        assert one.lang[0] == together.lang[i]
        mine = together.function[0] == i
        assert np.array_equal(one.function[1], together.function[1][mine]) and np.allclose(one.function[2], together.function[2][mine])


def test_measures_by_hand():
    plain = dict(zip(quality.PLAIN, quality.measure(quality.units("The node of the file.\nparseNode calls it, the the end"))
                     .plain[0]))
    assert plain["log_words"] == pytest.approx(np.log1p(11)) and plain["function"] == pytest.approx(6 / 11)
    assert plain["lines_end"] == 0.5 and plain["twice"] == pytest.approx(1 / 11) and plain["ident"] == pytest.approx(9 / 54)  # every line counts its end
    french = quality.measure(quality.units("c'est l’arête"))
    assert french.lang[0] == list(quality.LANGUAGES).index("fr") and french.plain[0][quality.PLAIN.index("function")] == pytest.approx(3 / 4)


def test_divergence_from_profiles_is_that_of_the_whole_distributions(corpus):
    profiles = quality.Profiles().fit([t for _, t in corpus], [s for s, _ in corpus])
    m = quality.measure(quality.units(corpus[0][1]) + quality.units("Das ist nicht der Knoten und auch keine Kante"))
    whole = np.zeros((len(m), quality._PLACES))
    whole[m.function[0], m.function[1]] = m.function[2]
    want = [quality.jsd(p, profiles.function[l]) for p, l in zip(whole, m.lang)]
    assert np.allclose(profiles.divergences(m)[0], want)
    assert quality._point_jsd(np.array([0.0, 1.0])).tolist() == [1.0, 0.0]
    assert quality._point_jsd(np.array([0.3]))[0] == pytest.approx(quality.jsd(np.array([1.0, 0, 0]), np.array([0.3, 0.5, 0.2])))


def test_very_long_texts_are_measured_in_bounded_parts(corpus, monkeypatch):
    """A document, a run and a line far beyond what is measured at a time: all of it counts."""
    profiles = quality.Profiles().fit([t for _, t in corpus], [s for s, _ in corpus])
    proses, codes = [t for s, t in corpus if s == "prose"], [t for s, t in corpus if s == "code"]
    long = "\n".join(proses * 4) + "\n" + "\n".join(codes) + "\n" + "y" * 30_000
    whole = quality.describe_batch(profiles, [1], [quality.units(long)])
    monkeypatch.setattr(quality, "UNIT_CHARS", 4_000)
    cut = quality.units(long)
    assert max(u[2] for u in cut) <= 4_000 and sum(u[2] for u in cut) == sum(len(x.strip()) for x in long.split("\n"))
    parts = quality.describe_batch(profiles, [1], [cut])
    assert parts["shape"][0] == whole["shape"][0] == "prose" and abs(parts["prose_share"][0] - whole["prose_share"][0]) < 0.05
