import datetime as dt

import pytest

from skein.llm.mojibake import DOUBLE, SINGLE, SWAPS, Mender, _bytes_to_chars, find_garbled

CLEAN = [
    "Die Oberfläche verzögert das halbe Ergebnis, obwohl die Prüfung vorher grün war. Der Auflöser löscht die ältesten Einträge. Größe", "Notre script de contrôle vérifie la réponse déjà calculée même si l'étape a réussi. Le résolveur complète les chemins.",
    "El índice desplaza los nombres públicos aunque la comprobación había pasado el año.", "A verificação não mantém as ligações até à mudança.", "Każdy plik zakresu usuwa ostatnią zmianę, ponieważ kolejność nie została ustalona. Łącza są dopóki ktoś.", "Очередь повторных попыток сохраняет уже готовый ответ.", "順序が決められていないため、読み取りは古い項目を削除する。",
]


@pytest.fixture(scope="module")
def mender():
    return Mender(CLEAN)


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "iso8859-15", "cp1250", "cp1251", "koi8-r"])
@pytest.mark.parametrize("text", ["Die Prüfung löscht die ältesten Einträge.", "la réponse déjà calculée", "Nobody waits – don’t “run”.", "уже готовый ответ"])
def test_utf8_read_as_single_bytes(mender, text, wrong):
    bad = "".join(bytes([b]).decode(wrong, "replace").replace("�", chr(b)) for b in text.encode())
    assert mender.mend(bad)[:2] == (True, text)


@pytest.mark.parametrize("true,wrong", [("latin-1", "mac_roman"), ("cp1252", "cp437"), ("mac_roman", "cp1252"), ("cp850", "cp1252")])
def test_one_single_byte_encoding_as_another(mender, true, wrong):
    text = "Die Prüfung löscht die ältesten Einträge."
    bad = "".join(bytes([b]).decode(wrong, "replace").replace("�", chr(b)) for b in text.encode(true))
    assert mender.mend(bad) == (True, text, True)


@pytest.mark.parametrize("true,wrong", [("koi8-r", "cp1251"), ("cp1251", "latin-1"), ("cp1251", "koi8-r")])
def test_cyrillic(mender, true, wrong):
    text = "Очередь повторных попыток сохраняет уже готовый ответ."
    assert mender.mend(text.encode(true).decode(wrong))[:2] == (True, text)


def test_polish_read_as_western(mender):
    text = "ponieważ kolejność nie została ustalona"
    assert mender.mend(text.encode("iso8859-2").decode("latin-1"))[:2] == (True, text)


def test_japanese(mender):
    text = "順序が決められていないため、読み取りは古い項目を削除する。"
    assert mender.mend(text.encode("euc_jp").decode("latin-1"))[:2] == (True, text)
    assert mender.mend(text.encode("utf-8").decode("latin-1"))[:2] == (True, text)


def test_twice_and_mixed(mender):
    text = "Die Prüfung löscht.\nMAÑANA bleibt – naïve café."
    once = text.split("\n")[0].encode().decode("cp1252")
    assert mender.mend(once.encode().decode("cp1252") + "\n" + text.split("\n")[1])[:2] == (True, text)


def test_lost_characters(mender):
    assert mender.mend("Die Pr�fung l�scht.") == (True, "Die Pr�fung l�scht.", False)
    for text in ("'�'", 'out.replace("�", "?")', "| \"�\" | U+FFFD |"):
        assert mender.mend(text)[0] is False


def test_dropped_bytes(mender):
    for text in ("nothing new (“digest”).", "Każdy plik usuwa ostatnią zmianę, ponieważ kolejność nie została ustalona."):
        bad = "".join(c for c in text.encode().decode("latin-1") if not "\x80" <= c <= "\x9f")
        assert mender.mend(bad)[0] is True, bad


def test_clean_texts_stay(mender):
    for text in [*CLEAN, "", "plain", "naïve café test", "§ 4 ¶ 2 ©", "price: £5 / ¥300", "Δ = ±3 µm ≤ 10 °C", "a → b ⇒ c", "ready ✓ 🚀", "├── src\n│   └── x", "NÃO ALTERAR: x", "ATENÇÃO: PADRÃO DE MIGRAÇÃO", "ŁĄCZA", "Â l'arrêt", "ÀÇÃO", "ÜBERSICHT", "СУПЕР УПАКОВКА", "ОЧЕРЕДЬ", "cold for 36 € (“x”) … don’t"]:
        assert mender.mend(text) == (False, text, True), text


MIXED = {"de": "Die Prüfung löscht die ältesten Einträge.", "ru": "Очередь повторных попыток сохраняет уже готовый ответ.", "pl": "ponieważ kolejność nie została ustalona", "fr": "la réponse déjà calculée"}


@pytest.mark.parametrize("true,wrong", SWAPS)
def test_correct_text_beside_swapped_letters_stays(mender, true, wrong):
    for lang, text in MIXED.items():
        try:
            bad = "".join(_bytes_to_chars(wrong)[b] for b in text.encode(true))
        except UnicodeEncodeError:
            continue
        if bad == text:
            continue
        clean = "вместо готовый ответ, " if lang == "de" else "Größe für das Gerät läuft. "
        found, got, _ = mender.mend(clean + bad)
        assert found and got.startswith(clean)
        found, got, _ = mender.mend(f"{bad} {clean}")
        assert found and got.endswith(f" {clean}")


@pytest.mark.parametrize("wrong", SINGLE)
def test_correct_text_beside_multi_byte_sequences_stays(mender, wrong):
    table = _bytes_to_chars(wrong)
    ja = "順序が決められていないため、読み取りは古い項目を削除する。"
    for text, true in [(t, "utf-8") for t in MIXED.values()] + [(ja, d) for d in DOUBLE]:
        bad = "".join(table[b] for b in text.encode(true))
        for clean in ("Größe für alle: ", "уже готовый ответ "):
            found, got, _ = mender.mend(clean + bad)
            assert found and got == clean + text, (true, wrong)
            if true in DOUBLE:
                assert mender.mend(f"{bad} {clean}")[1] == f"{text} {clean}"


def test_one_garbled_word(mender):
    assert mender.mend("Größe " + "réponse déjà".encode("latin-1").decode("cp437") + " für") == (True, "Größe réponse déjà für", True)
    assert mender.mend("Größe der Pr³fung für alle") == (True, "Größe der Prüfung für alle", True)
    got = mender.mend("Das Gerät läuft für alle. " + "Привет, готовый ответ".encode("cp1251").decode("latin-1"))
    assert got[:2] == (True, "Das Gerät läuft für alle. Привет, готовый ответ")


def test_any_number_of_rounds(mender):
    text = bad = "Die Prüfung löscht."
    for _ in range(9):
        bad = bad.encode().decode("latin-1")
        assert mender.mend(bad) == (True, text, True)


def test_utf16(mender):
    text = "Die Prüfung löscht die ältesten Einträge.\nla réponse déjà calculée"
    for true in ("utf-16-le", "utf-16-be"):
        assert mender.mend(text.encode(true).decode("latin-1")) == (True, text, True)


def test_no_break_space_as_blank(mender):
    assert mender.mend("la rÃ©ponse dÃ©jÃ  calculÃ©e") == (True, "la réponse déjà calculée", True)


def test_long_lines_in_linear_time(mender):
    import time

    began = time.time()
    for part in ("Größe für ", "grÃ¼n ", "ключ ", "Pr�fung ", "Ã", "½ç½ø¤¬·è¤á¤é¤ì¤Æ"):
        mender.mend(part * (50_000 // len(part)))
    assert time.time() - began < 40


def test_frame(spark):
    t = lambda d: dt.datetime(2025, 1, d)
    rows = [(1, "PrÃ¼fung", t(1), True), (1, "Prüfung", t(2), True), (2, None, t(1), None), (3, "", t(1), None), (4, "grÃ¼n " * 20_000, t(1), None), (None, "PrÃ¼fung", t(1), None), (5, "Pr�fung", t(1), None)]
    df = spark.createDataFrame(rows, "id long, t string, recorded_at timestamp, garbled boolean")
    clean = spark.createDataFrame([(c,) for c in CLEAN], "t string")
    got = {r.id: (r.garbled, r.restored, r.complete) for r in find_garbled(df, "id", "t", clean, "t").collect()}
    assert got == {1: (False, "Prüfung", True), 2: (False, None, True), 3: (False, "", True), 4: (True, "grün " * 20_000, True), 5: (True, "Pr�fung", False)}
    assert find_garbled(df.limit(0), "id", "t", clean, "t").count() == 0
