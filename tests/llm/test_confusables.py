import pytest

from pagewright.llm import confusables as cf


@pytest.mark.parametrize("text", ["ΔQ = 70,2 s", "λ = 82π / k", "α açısı", "“время” sözcüğü", "“γη”", "m² ≤ ½ № 5 CO₂ …", "β² kaçtır?", "1315 – 1995", "iki  boşluk", "kâr, tarihî", ""])
def test_whole_texts_stay(spark, text):
    assert cf.plain_form(text, cf.prototypes(spark)) == (text, [])


@pytest.mark.parametrize("text,form,kind", [("Ｓｕｎｕ", "Sunu", "form"), ("Kum Saati", "Kum Saati", "blank"), ("s​oru", "soru", "invisible"), ("deği̇şim", "değişim", "separate mark"),
                                            ("İрek", "İpek", "mixed script"), ("а)", "a)", "whole script"), ("yağıș", "yağış", "letter"), ("diﬃcult", "difficult", "form"), ("Κaνram", "Kavram", "mixed script")])
def test_forms(spark, text, form, kind):
    assert cf.plain_form(text, cf.prototypes(spark)) == (form, [kind])
    assert cf.plain_form(form, cf.prototypes(spark)) == (form, [])


def test_script_sets(spark):
    assert cf.scripts("a") == {"Latin"} and cf.scripts("1") == cf._ANY and cf.scripts("ー") >= {"Hiragana", "Katakana", "Japanese"}
    assert "Japanese" in cf.scripts("漢") & cf.scripts("か") and not cf.scripts("а") & cf.scripts("a")
    known = cf.prototypes(spark)
    assert len(known) > 500 and known["Ꮪ"] == "S" and known["ԝ"] == "w" and known["ѕ"] == "s" and "ж" not in known and "é" not in known
    assert cf.plain_form("漢字かな", known) == ("漢字かな", [])
    assert cf.plain_form("ᏚᎪᎪᎢ", known)[1] == ["whole script"] and cf.plain_form("Ꮪoru", known) == ("Soru", ["mixed script"])


def test_rows_with_nulls(spark):
    df = spark.createDataFrame([("1", None), ("2", ""), ("3", "düz metin"), ("4", "x y"), ("4", "x y"), ("5", "ｚ" * 20000)], "k string, text string")
    assert sorted(r.k for r in cf.forms(df, ["k"], "text").collect()) == ["4", "4", "5"]
    assert {r.k: r.form for r in cf.consistent_text(df, "text").collect()}["1"] is None
    assert cf.forms(df.limit(0), ["k"], "text").count() == 0
