import re

from hypothesis import given, settings
from hypothesis import strategies as st

from fleetgrid.llm import licenses


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = []
    for phrase, label in licenses.BASE:
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return words, places


def compare(df):
    got = {r["doc_id"]: r for r in licenses.report(df).collect()}
    for r in df.collect():
        words, places = brute(r["text"])
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_base"]) == (len(words), len(places))
        assert (g["first_word"], g["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert g["base_labels"] == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, g["base_labels"].split(","))) <= set(filter(None, g["labels"].split(",")))
        assert 0 <= g["score"] <= 1
    return got


def test_matches_brute_force(small):
    compare(small)


def test_odd_rows(docs, nothing):
    got = compare(docs)
    assert got[8]["n_base"] == 4 and got[8]["base_labels"] == "cc-by,gpl"
    assert licenses.report(docs).count() == docs.count() and licenses.report(nothing).count() == 0


def test_templates_are_found_and_other_words_are_not(spark):
    rows = [
        (1, "x y Licensed under the Apache License, Version 2.0. z"),
        (2, "Permission is hereby granted, free of charge, to any person obtaining a copy of this new software and associated documentation files (the Software), to deal in the Software without restriction"),
        (3, "the file of the house is in the software of this world and you may obtain it"),
    ]
    got = {r["doc_id"]: r for r in licenses.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["labels"] for i in (1, 2, 3)] == ["apache-2.0", "mit", ""]
    spans = licenses.scan(spark.createDataFrame(rows[:1], "doc_id long, text string")).first()["spans"]
    assert (spans[0]["first_word"], spans[0]["last_word"], spans[0]["cover"]) == (2, 9, 1.0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("a b c x".split()), max_size=30))
def test_matching_statistics(words):
    templates = (("a b c a b", "t"), ("b b a", "u"))
    m = licenses.Automaton((), templates)
    ids = [m.word.get(w.encode(), 0) for w in words]
    runs = {tuple(t.split()[i:j]) for t, _ in templates for i in range(9) for j in range(i + 1, len(t.split()) + 1)}
    for at, (_, n) in enumerate(m.statistics(ids)):
        assert n == max([0, *(k for k in range(1, at + 2) if tuple(words[at + 1 - k : at + 1]) in runs)])


def test_whole_licences_are_found_in_altered_copies(spark):
    """Each whole text with a name put in, every 40th word changed, and clauses left out at its end."""
    rows = []
    for i, (text, label) in enumerate(licenses.WHOLE):
        words = [f"w{k}" if k % 40 == 39 else w for k, w in enumerate(text.split())]
        words[25:25] = ["Copyright", "2024", "Some", "One"]
        rows.append((i, "intro text. " + ", ".join(words[: int(len(words) * 0.9)]).upper() + " more of the text", label))
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, label string")).collect()}
    for i, text, label in rows:
        best = max((s for s in got[i]["spans"] if s["label"] == label), key=lambda s: s["last_word"] - s["first_word"])
        assert best["last_word"] - best["first_word"] > 0.8 * len(text.split()) and best["cover"] >= licenses.MIN_COVER


def test_phrases_of_one_word():
    m = licenses.Automaton((("zlib", "z"), ("all rights", "r")), (("a b c", "t"),))
    assert m.scan([b"x", b"zlib", b"y", b"all", b"rights", b"zlib"])[0] == [(1, 0), (3, 1), (5, 0)]


def plain_cover(words, template):
    """The best chain of maximal matches of MIN_MATCH words or more: ever later in both, MAX_GAP words apart in the text at most."""
    runs = {tuple(template[i:j]) for i in range(len(template)) for j in range(i + 1, len(template) + 1)}
    ends = [max([0, *(n for n in range(1, at + 2) if tuple(words[at + 1 - n : at + 1]) in runs)]) for at in range(len(words))] + [0]
    found = []
    for at, n in enumerate(ends[:-1]):
        if n >= licenses.MIN_MATCH and ends[at + 1] <= n:
            found += [(at + 1 - n, a, n) for a in range(len(template) - n + 1) if template[a : a + n] == words[at + 1 - n : at + 1]]
    best = {}
    for first, a, n in sorted(found):
        best[first, a, n] = n + max([0, *(c for (f, b, m), c in best.items() if b + m <= a and f + m <= first <= f + m + licenses.MAX_GAP)])
    return max([0, *best.values()]) / len(template)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("a b c d x".split()), max_size=40))
def test_best_covers_match_a_plain_search(words):
    template = "a b c d a c b d d a".split()
    m = licenses.Automaton((), ((" ".join(template), "t"),))
    spans = m.scan([w.encode() for w in words])[1]
    assert max([0.0, *(s.cover for s in spans)]) == plain_cover(words, template)
