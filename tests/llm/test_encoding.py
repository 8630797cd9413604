import pytest

from quirework.llm.encoding import DECODERS, ENCODERS, decode, encode, garbled, plausible, repair

CLEAN = [
    "Don’t touch the fiddler’s trophy; it’s canvas, and “only” praised — at 18 °C ± 2 for £20.",
    "Können Sie sagen, wo die Truhe steht? Über der Tür, meint Jürva Müllbach.",
    "À la fête d’été, les élèves ont préparé 57 crêpes. Où a-t-on caché la clé ?",
    "AVISO: A REUNIÃO DA ESTAÇÃO SERÁ AMANHÃ, NÃO FALTEM, TRAGAM PÃO.",
    "¿Quién llevó la puerta al jardín? Según Çavit Žuravin, mañana.",
    "Сторож бережно хранил барабан до самой весны 2019 года.",
    "plain ASCII & nothing else; a < b", "", None, "70 % of λόγος",
]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_stays(text):
    assert repair(text) == (text, 0, False)


@pytest.mark.parametrize(("wrong", "right"), [("sloppy-1252", "utf-8"), ("latin-1", "utf-8"), ("mac_roman", "utf-8"), ("cp437", "utf-8"), ("cp437", "sloppy-1252"), ("mac_roman", "sloppy-1252")])
@pytest.mark.parametrize("text", [CLEAN[0], CLEAN[1], CLEAN[2]])
def test_round_trip(text, wrong, right):
    data = text.encode("cp1252" if right == "sloppy-1252" else right)
    bad = decode(data, wrong) if wrong != "latin-1" else data.decode("latin-1")
    assert bad != text
    made, n, _ = repair(bad)
    assert n and made == text


def test_cyrillic_round_trips():
    for right, wrong in (("cp1251", "sloppy-1252"), ("utf-8", "cp1251"), ("koi8_r", "cp1251"), ("utf-8", "cp437")):
        bad = decode(CLEAN[5].encode(right), wrong)
        if bad is not None:
            assert repair(bad)[0] == CLEAN[5], (right, wrong)


def test_twice_garbled_and_beside_clean_text():
    once = decode("It’s naïve".encode(), "sloppy-1252")
    twice = decode(once.encode(), "sloppy-1252")
    made, n, _ = repair(f"{CLEAN[1]}\n{twice}. {CLEAN[0]}")
    assert n and made == f"{CLEAN[1]}\nIt’s naïve. {CLEAN[0]}"


def test_lost_bytes_are_found_but_incomplete():
    assert repair("said,â€� and so")[2]


def test_sloppy_encoding_is_a_round_trip():
    every = bytes(range(256))
    assert encode(decode(every, "sloppy-1252"), "sloppy-1252") == every


SENTENCES = [
    "Привет, мир и друзья", "Это было в школе и дома у нас", "В 1967 году наш кружок перенёс стол в старый зал и устроил праздник.",
    "¿Quién llevó la puerta al jardín? Mañana, según él, volverá el niño.", "À la fête d’été, les élèves ont préparé 57 crêpes où l’on danse.",
    "Können Sie sagen, wo die Truhe steht? Über der Tür, meint Jürva; er weiß es.", "A reunião da estação será amanhã; não faltem, tragam pão e maçãs.",
]


@pytest.mark.parametrize("wrong", ENCODERS)
@pytest.mark.parametrize("right", DECODERS)
def test_sentences_come_back_or_are_not_complete(right, wrong):
    for text in SENTENCES:
        data = encode(text, right)
        bad = decode(data, wrong) if data is not None else None
        if bad is None or bad == text:
            continue
        made, n, left = repair(bad)
        assert made == text or not n or left, (text, bad, made)
        if right == "utf-8":
            assert made == text, (bad, made)


@pytest.mark.parametrize(("text", "right"), [("ελληνικά και άλλα", "cp1253"), ("příliš žluťoučký kůň", "cp1250"), ("テストです、日本語", "shift_jis"), ("გამარჯობა", "utf-16-le")])
def test_other_encodings_are_never_complete(text, right):
    for wrong in ENCODERS:
        bad = decode(text.encode(right), wrong)
        made, n, left = repair(bad)
        assert not n or left or made == text, (bad, made)


def test_plausible():
    assert plausible("Сторож бережно хранил барабан, naïveté 70 %") and not plausible("нууофптц") and not plausible("пРИВЕТ") and not plausible("λόγος")


def test_rows(spark):
    bad = decode("caf\xe9 d’été".encode(), "sloppy-1252")
    rows = [(1, bad, "r"), (1, bad, "r"), (2, None, "r"), (3, "", "r"), (4, CLEAN[0], "r"), (5, "x" * 200_000 + bad, "r"), (6, "caf&Atilde;&copy; here", "r")]
    found = garbled(spark.createDataFrame(rows, "doc long, body string, restored string"), "doc", "body").collect()
    assert sorted((r.doc, r.restored[-8:]) for r in found) == [(1, "fé d’été"), (1, "fé d’été"), (5, "fé d’été"), (6, "afé here")]
    assert garbled(spark.createDataFrame([], "doc long, body string"), "doc", "body").count() == 0
