from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from biosignal.llm.leaks import find_leaks, remove_leaks
from biosignal.llm.words import plain, word_spans, words

PASSAGE = "the archive of the old harbour keeps four hundred letters in which a surveyor complains about the mayor and praises the bakers while their ferry waits near that stone bridge until every traveller has paid two silver coins for bread"
OTHER = "during one winter nobody sold blankets to our garrison because its captain refused any offer from merchants who promised acres beside rivers"
ITEMS = [(1, "Read the passage and answer.\n" + PASSAGE + "\nWho waits?"), (2, "Solve it.\n" + PASSAGE), (3, OTHER), (4, None), (None, PASSAGE), (5, "")]


def items(spark):
    return spark.createDataFrame([(*i, "x", "y") for i in ITEMS], "item_id bigint, prompt string, text string, id string")


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts)], "doc_id bigint, text string, item_id string, p string")


def found(spark, texts, **more):
    return {(r.id, r.item_id) for r in find_leaks(docs(spark, texts), items(spark), **more).collect()}


def w(a, b):
    return " ".join(PASSAGE.split()[a:b])


def test_length_of_exact_matches(spark):
    texts = [f"so they said {w(3, 15)} and left", f"so they said {w(3, 14)} and left", PASSAGE, OTHER, "", None, "nothing here"]
    assert found(spark, texts) == {(0, 1), (0, 2), (2, 1), (2, 2), (3, 3)}


def test_forms_of_the_same_words(spark):
    t = PASSAGE.split()
    texts = [
        "> " + "\n> ".join(" ".join(t[k : k + 5]) for k in range(0, 20, 5)),
        " ".join(t[:14]).upper().replace(" ", "&nbsp;<br>\n"),
        " ".join(f"[b]{x[0]}[/b]{x[1:]}" for x in t[:14]),
        " ".join(f"<i>{x}</i>," for x in t[:14]),
        "­".join(" ".join(t[:14])),
        " ".join(t[:14]).translate({ord("a"): "а", ord("e"): "е", ord("o"): "ｏ", ord("i"): "ｉ"}),
        " ".join(t[:14]).replace("a", "á"),
    ]
    assert found(spark, texts) == {(k, i) for k in range(len(texts)) for i in (1, 2)}


def test_altered_dropped_and_added_words(spark):
    t = PASSAGE.split()
    a = list(t)
    a[6], a[14], a[29] = "seven", "moaned", "wooden"
    del a[22]
    a.insert(34, "really")
    every_third = [x if k % 3 else "so" for k, x in enumerate(t)]
    short = a[4:24]
    assert found(spark, [" ".join(a), " ".join(every_third), " ".join(short[:8] + ["so"] + short[8:])]) == {(0, 1), (0, 2)}


def test_blocks_of_items_give_the_same(spark):
    texts = [PASSAGE, OTHER, w(0, 13), "x"]
    assert found(spark, texts, max_grams=10) == found(spark, texts)


def test_long_text_and_place(spark):
    long = "word " * 300_000 + w(0, 20) + " word" * 1000
    r = find_leaks(docs(spark, [long]), items(spark).where("item_id = 1")).collect()
    assert len(r) == 1 and r[0].first_word == 300_000 and r[0].words == 20


def test_null_ids_and_empty_tables(spark):
    d = docs(spark, [PASSAGE]).withColumn("doc_id", F.lit(None).cast("bigint"))
    assert find_leaks(d, items(spark)).count() == 0
    assert find_leaks(docs(spark, [PASSAGE]), items(spark).where("false")).count() == 0
    assert find_leaks(docs(spark, [PASSAGE]).where("false"), items(spark)).count() == 0


def test_removal(spark):
    texts = [f"Good words, before <b>this</b>: {w(0, 13)}! And many more GÖÖD words that stay after it for long", PASSAGE, "clean", None, ""]
    out = {r.doc_id: (r.text, r.removed_words) for r in remove_leaks(docs(spark, texts), items(spark)).collect()}
    assert out == {0: ("Good words, before <b>this</b>: ! And many more GÖÖD words that stay after it for long", 13), 2: ("clean", 0), 3: (None, 0), 4: ("", 0)}


def test_removal_of_every_passage_of_an_item(spark):
    own = "these are good words of the author that belong to nobody else and stay where they were put"
    texts = [f"{own} {w(0, 13)} {own} {w(20, 38)} {own}", f"{w(0, 13)} so it went on and on for them {w(20, 38)} the end", f"{own} {w(2, 22)} {w(10, 30)} {own} {own}"]
    d = docs(spark, texts)
    leaks = find_leaks(d, items(spark).where("item_id = 2"))
    assert {(r.first_word, r.last_word) for r in leaks.where("id = 0").collect()} == {(18, 30), (49, 66)}
    for most in (2_000_000, 10):  # in one block of items, and in several
        out = {r.doc_id: (r.text, r.removed_words) for r in remove_leaks(d, items(spark).where("item_id <= 3"), max_grams=most).collect()}
        # of the second document more than half leaked; the spans of the third touch
        assert out == {0: (f"{own}  {own}  {own}", 31), 2: (f"{own}  {own} {own}", 40)}
    assert find_leaks(docs(spark, [r[0] for r in out.values()]), items(spark)).count() == 0


def test_removal_keeps_all_other_characters(spark):
    before, after = "Café Müller in Zürich &amp; <i>mehr</i>,\r\n\tÅ ﬁne ", " (e\u0301tait) – das Ende&nbsp;… <b>today</b> ẞ"
    forms = [w(0, 14), w(0, 14).upper().replace(" ", "&nbsp;<br>\n"), "\u00ad".join(w(0, 14)), w(0, 14).replace("a", "a\u0301"), " ".join(f"<i>{x}</i>," for x in w(0, 14).split())]
    texts = [before * 5 + f + after * 5 for f in forms]
    out = {r.doc_id: r.text for r in remove_leaks(docs(spark, texts), items(spark)).collect()}
    assert all(out[k] == before * 5 + after * 5 for k in range(4))
    assert out[4] == before * 5 + "<i></i>," + after * 5


@given(st.text(alphabet="aBß 1&;<>[]/bi#xnpqm\u0301\u00adéﬁ가각。'\n", max_size=40))
def test_spans_are_those_of_the_words(text):
    spans = word_spans(text)
    assert len(spans) == len(words(text)) and all(0 <= a < b <= len(text) for a, b in spans)
    assert all(p[1] <= q[1] and p[0] <= q[0] for p, q in zip(spans, spans[1:]))


def test_shortest_runs_that_are_found(spark):
    """Five words between edits are seeds enough; with fewer, and whatever the parameters, windows are shorter."""
    t = PASSAGE.split()
    fives = [x if k % 6 < 5 else "so" for k, x in enumerate(t[:35])]
    assert found(spark, [" ".join(fives)]) == {(0, 1), (0, 2)}
    assert found(spark, [" ".join(t[:4]) + " but"], exact=4, fuzzy=30) == {(0, 1), (0, 2)}
    threes = [x if k % 4 < 3 else "so" for k, x in enumerate(t)]
    assert found(spark, [" ".join(threes)], fuzzy=20, run=3.0) == {(0, 1), (0, 2)}


def test_words():
    assert words(None) == [] and words("") == []
    assert words("A&amp;B don't <b>st</b>op[/b] 3.5") == ["a", "b", "don", "t", "stop", "3", "5"]
    assert plain("Ünïcode Straße") == "unicode strasse"
