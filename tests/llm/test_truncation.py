import random

from pagewright.llm import truncation as tr

NOUNS = "taş köprü|eski harita|su buharı|kış uykusu|güneş saati".split("|")
VERBS = "gösterir|sınırlar|etkiler|dengeler|açıklar".split("|")


def sentence(rng):
    return f"{rng.choice(NOUNS).capitalize()} soğuk sularda {rng.choice(NOUNS)} ile ses dalgasını {rng.choice(VERBS)}."


def corpus():
    rng, rows = random.Random(7), []
    for i in range(1500):
        text = " ".join(sentence(rng) for _ in range(rng.randint(1, 6)))
        kind, cut = i % 10, False
        if kind == 0:
            text += "".join(f"\n• {rng.choice(NOUNS)}" for _ in range(4))
        elif kind == 1:
            text, cut = text[: rng.randint(12, len(text) - 12)], True
        elif kind == 2 and i % 20 == 2:
            text, cut = text[: rng.randint(12, len(text) - 12)].rstrip(". ") + "…", True
        elif kind == 3 and i % 30 == 3:
            text = text[:-1] + "…"
        rows.append((i, text, rng.choice(["tr", None]), "s", cut))
    return rows


def test_cut_texts_are_found(spark):
    rows = corpus()
    df = spark.createDataFrame(rows + [(9001, None, "tr", None, False), (9002, " \n", None, "s", False)], "doc_id long, text string, lang string, source string, cut boolean")
    found = {r.doc_id for r in tr.judged(df.drop("cut")).where("truncated").collect()}
    cut = {r[0] for r in rows if r[4]}
    assert len(found & cut) / len(cut) > 0.95 and len(found & cut) / len(found) > 0.95
    assert not found & {9001, 9002}


def test_empty_table(spark):
    assert tr.judged(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_tails():
    assert tr.tail_of("bir yarı�") == ("bir yarı", "mark") and tr.tail_of("son kel…") == ("son kel", "dots")
    assert tr.tail_of(None) == ("", "") and tr.tail_of("tam.\n ") == ("tam.", "")
