"""Sentence cuts by learned abbreviations, on texts with planted ones."""

import random

from textloom.operators import sentences as SE


def _corpus():
    rng = random.Random(4)
    words = ["report", "patient", "moved", "ward", "nurse", "fall", "later", "again"]
    say = lambda k: " ".join(rng.choices(words, k=k))
    rows = [f"{say(6)}. {say(5)} e.g. 3 {say(2)}. (dr. {say(3)}) {say(4)}! {say(3)}." for _ in range(40)]
    return [(i, 0, t) for i, t in enumerate(rows)]


def test_abbreviations_are_learned(spark):
    p = spark.createDataFrame(_corpus(), "doc_id long, para int, t string")
    got = {r.word for r in SE.abbreviations(p, "t").collect()}
    assert got == {"e.g", "dr"}


def test_sentences_do_not_end_at_abbreviations(spark):
    rows = _corpus()
    odd = [(100, 0, None), (101, 0, ""), (102, 0, " \t "), (103, 0, "one"), (104, 0, "See e.g. 3 wards.\t Yes? Dr. Who"),
           (105, 0, "..."), (106, 0, "ends with dr."), (107, 0, "x! " * 20_000)]
    p = spark.createDataFrame(rows + odd, "doc_id long, para int, t string")
    got = {}
    for r in SE.split_sentences(p, ["doc_id", "para"], "t").orderBy("doc_id", "sent").collect():
        assert r.sent == len(got.setdefault(r.doc_id, []))       # numbered without gaps
        got[r.doc_id].append(r.sentence)
    for i, _, t in rows:
        a, b, c, d = got[i]
        assert " ".join((a, b, c, d)) == t and " e.g. 3 " in b and c.startswith("(dr. ") and c.endswith("!")
    assert not {100, 101, 102} & set(got)
    assert got[103] == ["one"] and got[104] == ["See e.g. 3 wards.", "Yes?", "Dr. Who"] and got[105] == ["..."]
    assert got[106] == ["ends with dr."] and len(got[107]) == 20_000


def test_sentences_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, t string")
    assert SE.split_sentences(none, ["doc_id"], "t").collect() == []
