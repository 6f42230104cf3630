import random

import pytest

from loomsheet.llm import language, mojibake

CLEAN = {
    "en": ["The café-style kiosk kept the sludge at 63 °C ± 1 °C in spite of the long storage.", "“We see no error.” was the only remark of the reviewer about the slope of 10⁻³."],
    "de": ["Für den Versuch mit Torf wurden fünf Gefäße benötigt, weil größere Körner übrig blieben.", "Die Lösung enthielt außerdem gelöste Huminsäure und später auch Flugasche."],
    "fr": ["L’échantillon a été conservé à l’état sec et les écarts observés étaient dus à l’âge du dépôt.", "Après séchage, la densité apparente a augmenté après plusieurs journées."],
    "zh": ["经过干燥处理后，每克橡木炭的膜过滤耗时三小时，尽管保存时间较长。", "样品采自河口附近，土壤表面的水稻秸秆随水流向下迁移。"],
    "ja": ["試料は湾の近くで採取し、ふるいを通したものの、対照区は変化しなかった。", "査読者は構造を変えたかどうかを尋ねたが、ばらつきは大きかった。"],
    "ru": ["Температуру поддерживали на уровне двух градусов, однако плотность образца изменяется.", "Рецензенты спросили, влияет ли прокаливание на структуру и хранение."],
    "th": ["เราวัดความสามารถในการดูดซับด้วยวิธีใหม่ในห้องปฏิบัติการ", "ตัวอย่างแตกระหว่างการขนส่งและต้องเก็บไว้ในห้องเย็น"],
}


@pytest.fixture(scope="module")
def repairer():
    rng = random.Random(0)
    rows = [(lang, " ".join(rng.choices(texts, k=6))) for lang, texts in CLEAN.items() for _ in range(30)]
    return mojibake.Repairer(language.train(rows))


@pytest.mark.parametrize(
    "lang, write, read",
    [("en", "utf-8", "latin-1"), ("de", "utf-8", "cp437"), ("de", "utf-8", "mac_roman"), ("fr", "utf-8", "cp850"), ("zh", "utf-8", "latin-1"), ("zh", "gbk", "latin-1"), ("ja", "cp932", "latin-1"), ("ja", "euc_jp", "latin-1"), ("ru", "utf-8", "latin-1"), ("ru", "utf-8", "koi8-r"), ("ru", "koi8-r", "cp1251"), ("th", "cp874", "latin-1")],
)
def test_round_trip(repairer, lang, write, read):
    for text in CLEAN[lang]:
        if any(ord(c) > 0x2000 for c in text) and write not in ("utf-8", "gbk", "cp932", "euc_jp", "cp874", "koi8-r"):
            continue
        garbled = text.encode(write).decode(read)
        restored, found = repairer.repair([garbled])[0]
        assert found and restored == text


def test_twice_and_in_places(repairer):
    text = CLEAN["de"][0]
    twice = text.encode().decode("latin-1").encode().decode("latin-1")
    assert repairer.repair([twice])[0][0] == text
    mixed = f"{CLEAN['zh'][0]}{CLEAN['zh'][1].encode().decode('latin-1')}\n{CLEAN['en'][0]}"
    assert repairer.repair([mixed])[0] == (f"{CLEAN['zh'][0]}{CLEAN['zh'][1]}\n{CLEAN['en'][0]}", 1)


def test_clean_and_quoted_and_lost(repairer):
    clean = [t for texts in CLEAN.values() for t in texts] + ["", "plain ascii", "Readers who see “Ã©” should reload the file.", "A cell showing “锟斤拷” is a known symptom.", "ÄUSSERE MASSE DER GEFÄSSE", "Ðórsvík Þing-Øre", "Ålandsø–Ærøst £12 ¥400"]
    assert all(found == 0 and text == c for c, (text, found) in zip(clean, repairer.repair(clean), strict=True))
    lost = CLEAN["zh"][0].encode("gbk").decode("utf-8", "replace")
    assert repairer.repair([lost])[0][1] == 1


def test_unescape(repairer):
    assert repairer.repair(["Les &eacute;carts observ&eacute;s &eacute;taient dus au d&eacute;p&ocirc;t."])[0][0] == "Les écarts observés étaient dus au dépôt."


def test_pieces_join_again():
    for text in ("a. b\r\nc。d\t", "", "\n\n", "no end"):
        assert "".join(mojibake.cut(text)) == text


def test_rows(spark, repairer):
    bad = CLEAN["ru"][0].encode().decode("latin-1")
    df = spark.createDataFrame([(1, bad, "x"), (2, None, "x"), (3, "", "x"), (4, CLEAN["ru"][0] * 200, "x"), (1, bad, "x")], "doc_id bigint, text string, restored string")
    rows = mojibake.repaired_rows(df, repairer.models).distinct().collect()
    assert [(r.doc_id, r.restored) for r in rows] == [(1, CLEAN["ru"][0])]
    assert mojibake.repaired_rows(df.limit(0), repairer.models).count() == 0


def test_one_place_in_a_well_predicted_sentence(repairer):
    text = CLEAN["en"][0]
    for write in ("latin-1", "cp437", "mac_roman"):
        for ch in ("é", "°"):
            garbled = text.replace(ch, ch.encode().decode(write), 1)
            alone = garbled.replace("é", "e").replace("±", "+") if ch == "°" else garbled.replace("°", "").replace("±", "+")
            assert repairer.models.bits([mojibake._normal(alone)]).min() < 2.2 * len(alone.encode()) + 4  # cheap on the average in spite of the garbling
            assert repairer.repair([alone])[0] == (text.replace("é", "e").replace("±", "+") if ch == "°" else text.replace("°", "").replace("±", "+"), 1)


def test_one_place_among_other_letters(repairer):
    """Few of the characters of a piece are in the codec, or few of those that are make up a sequence."""
    for text, ch in ((CLEAN["zh"][0].replace("三小时", "三小时（25 °C）"), "°"), (CLEAN["ru"][0].replace("однако", "– однако"), "–"), (CLEAN["fr"][0], "’"), (CLEAN["de"][0], "ü")):
        garbled = text.replace(ch, ch.encode().decode("cp1252"), 1)
        assert repairer.repair([garbled])[0] == (text, 1)
    assert repairer.repair([CLEAN["ru"][0] + " Проба взята."])[0][1] == 0


def test_other_codecs_in_places(repairer):
    """One or few characters of a long sentence, by codecs other than UTF-8."""
    for lang, write, read in (("fr", "cp1252", "mac_roman"), ("fr", "cp1252", "cp437"), ("de", "cp1252", "cp1251"), ("de", "utf-8", "gbk"), ("en", "cp1252", "mac_roman")):
        text = CLEAN[lang][0]
        garbled = text.encode(write).decode(read)
        assert garbled != text and repairer.repair([garbled])[0] == (text, 1)
    sentence = CLEAN["zh"][0] + CLEAN["de"][0].encode().decode("latin-1")
    assert repairer.repair([sentence])[0] == (CLEAN["zh"][0] + CLEAN["de"][0], 1)


def test_order_and_company_of_texts_change_nothing(repairer):
    texts = [t for some in CLEAN.values() for t in some]
    texts += [t.encode().decode(read, "replace") for t in texts for read in ("latin-1", "mac_roman", "cp1251", "koi8-r")]
    texts += [texts[0].encode("cp1252").decode("mac_roman"), texts[4] + texts[6].encode("gbk").decode("latin-1")]
    rng = random.Random(3)
    one = dict(zip(texts, mojibake.Repairer(repairer.models).repair(texts), strict=True))
    for _ in range(2):
        mixed = rng.sample(texts, len(texts))
        assert dict(zip(mixed, mojibake.Repairer(repairer.models).repair(mixed), strict=True)) == one
    alone = mojibake.Repairer(repairer.models)
    assert all(mojibake.Repairer(repairer.models).repair([t])[0] == one[t] for t in texts[::7]) and alone.repair([]) == []


def test_searches_ask_the_models_together(repairer, monkeypatch):
    """Many garbled pieces take hardly more look-ups than one, with the same results; a second task of a worker goes on with what the first found."""
    texts = [f"{CLEAN['fr'][0]} {k} {CLEAN['de'][0]}".encode().decode(wrong, "replace") for k in range(40, 60) for wrong in ("latin-1", "cp437", "mac_roman")]
    asked = []
    find = type(repairer.models).codes_of
    monkeypatch.setattr(type(repairer.models), "codes_of", lambda self, pieces: asked.append(len(pieces)) or find(self, pieces))
    one = mojibake.Repairer(repairer.models).repair(texts[:1])
    single = len(asked)
    together = mojibake.Repairer(repairer.models).repair(texts)
    assert together[0] == one[0] and all(n for _, n in together)
    assert len(asked) - single <= 4 * single + 8
    assert mojibake._repairer(repairer.models) is mojibake._repairer(repairer.models)
