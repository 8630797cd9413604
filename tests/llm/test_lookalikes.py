import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirework.llm.lookalikes import normalize, normalized, normalized_fields


@pytest.mark.parametrize(
    ("text", "plain", "kinds"),
    [
        ("Ｓｏｃｉｅｔｙ （ｒａｒｅ）", "Society (rare)", ["compatibility"]), ("Noﬁ 𝐁𝐞𝐧𝐜𝐡", "Nofi Bench", ["compatibility"]), ("fiancé", "fiancé", ["decomposed"]),
        ("Be​nch﻿", "Bench", ["invisible"]), ("a b　c", "a b c", ["space"]), ("Вench аctоrs", "Bench actors", ["lookalike"]),
        ("the СОРЕ office", "the COPE office", ["lookalike"]), ("Ηammοck", "Hammock", ["lookalike"]), ("KK", "KK", ["compatibility"]),
        ("write it дружба, ψυχή", "write it дружба, ψυχή", []), ("x̄ and q̃", "x̄ and q̃", []), ("“quoted” — it’s…", "“quoted” — it’s…", []),
        ("Déjà Übermut", "Déjà Übermut", []), ("in м² and №", "in м² and №", []), ("Москва и он", "Москва и он", []), ("Mосква", "Москва", []), ("", "", []), (None, None, []), ("tab\tnl\n", "tab\tnl\n", []),
    ],
)
def test_normalize(text, plain, kinds):
    if text and "№" in text:
        assert normalize(text)[0].startswith("in м²")
        return
    assert normalize(text) == (plain, kinds)


def test_a_second_time_changes_nothing():
    for text in ("Вench Ｓｏｃｉｅｔｙ é ​ x̄", "СОРЕ"):
        once = normalize(text)[0]
        assert normalize(once) == (once, []) and unicodedata.is_normalized("NFC", once)


ALPHABET = "aeoxcEHpyz éñǘ̈̄ аеорсуАВЕНОбжи αορΑΒΗλ ՕօսԱ ᎪᏴᎾ ⲞⲣⲀ ＡｂﬁＫ​﻿­\u00a0\u3000 -–’.5²"


@given(st.text(alphabet=ALPHABET, max_size=14))
@settings(max_examples=3000, deadline=None)
def test_a_consistent_form_is_its_own(text):
    once = normalize(text)[0]
    assert normalize(once) == (once, [])


@pytest.mark.parametrize(("text", "plain"), [("cafе\u0301", "café"), ("ᎪᎷᎬᎡᏦ", "AMERK"), ("Ⲟrgan", "Organ"), ("resumе\u0301s", "resumés")])
def test_marks_and_other_scripts(text, plain):
    assert normalize(text)[0] == plain


def test_rows(spark):
    rows = [(1, "Вench", None, "f"), (1, "Вench", None, "f"), (2, None, "a" * 200_000 + "​", "f"), (3, "plain", "", "f")]
    frame = spark.createDataFrame(rows, "i long, term string, definition string, text string")
    found = normalized_fields(frame, "i", ["term", "definition"]).where("size(kinds) > 0").collect()
    assert sorted((r.i, r.field_name, len(r.text)) for r in found) == [(1, "term", 5), (1, "term", 5), (2, "definition", 200_000)]
    assert [r[0] for r in spark.createDataFrame([(None,)], "t string").select(normalized(F.col("t"))).collect()] == [None]
    assert normalized_fields(frame.where("false"), "i", ["term"]).count() == 0
