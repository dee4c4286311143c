import pytest

from codequarry.llm import encoding as E

PRIOR = E.Cost({}, 0)  # no documents: only the vocabulary and the classes of characters
# sound texts in many languages and scripts, most of them not in the test tables
SOUND = {
    'danish': 'Rød grød med fløde på øen. Æbler og ål smager godt, når køkkenet er åbent.',
    'norwegian': 'Jeg vet ikke hvor båten er, men fjorden er så vakker. Være, gjøre, lære, spørsmål.',
    'swedish': 'Över ån går en bro. Är det sant att räven äter åtta ägg på söndagar?',
    'finnish': 'Hyvää päivää, mitä kuuluu? Yöllä työ jää tekemättä, älä häiritse.',
    'icelandic': 'Það er gott að búa á Íslandi. Þú ættir að læra málið, því fólkið er vingjarnlegt og hæðirnar fögur.',
    'italian': "Però la città è più bella perché c'è libertà. Così andrà già bene, né più né meno.",
    'catalan': "Però això no és així: l'anàlisi és més ràpida, col·lecció, què fem, aquí i allò.",
    'hungarian': 'Őszintén szólva, az űrhajó gyönyörű. Köszönöm szépen, tűzoltó, bőrönd, hűtő, fülű.',
    'czech': 'Příliš žluťoučký kůň úpěl ďábelské ódy. Můj dům je veliký, díky za vaše řešení.',
    'slovak': 'Ďakujem veľmi pekne, môžeme začať. Kôň skáče, dážď, ľahký, vŕba, stĺp.',
    'romanian': 'Însă țara și orașul sunt frumoase. Când mănânci, să nu vorbești; câine, știință, apă.',
    'turkish': "Çok güzel bir gün, değil mi? Işık söndü, ağaç, şeker, öğrenci, İstanbul'da yağmur.",
    'croatian': 'Đuro šalje čestitke, žena će doći kući. Možda ćeš više naučiti, smiješno.',
    'slovene': 'Češnje so žlahtne, šola pa je velika. Žal ni več časa.',
    'lithuanian': 'Ačiū, labai gražu. Žmonės gyvena čia, ąžuolas, ėjo, į mišką, ūkis, šviesa, ų.',
    'latvian': 'Paldies, ļoti labi. Mēs dzīvojam Rīgā, ģimene, ķēde, ņem, šķēres, ūdens.',
    'estonian': 'Õhtu on väga ilus, jõgi voolab üle põllu. Öö ja päev, šokolaad.',
    'vietnamese': 'Tiếng Việt rất đẹp, tôi yêu đất nước này. Người ta nói rằng cuộc sống tươi đẹp.',
    'welsh': "Mae'r tŷ yn fawr, dŵr oer, gŵyl a chân. Sŵn môr.",
    'russian': 'Привет, мир! Как дела? Это простой текст на русском языке, ещё один пример.',
    'ukrainian': 'Привіт, світе! Її ґанок великий, є щось інше, якщо хочеш.',
    'bulgarian': 'Здравей, свят! Това е прост текст на български език, който е хубав.',
    'greek': 'Γειά σου κόσμε! Αυτό είναι ένα απλό κείμενο στα ελληνικά, πολύ ωραίο.',
    'hebrew': 'שלום עולם, זה טקסט פשוט בעברית.',
    'arabic': 'مرحبا بالعالم، هذا نص بسيط باللغة العربية.',
    'hindi': 'नमस्ते दुनिया, यह हिंदी में एक सरल पाठ है।',
    'thai': 'สวัสดีชาวโลก นี่คือข้อความง่ายๆ',
    'chinese': '你好，世界！这是一个简单的中文文本。',
    'japanese': 'こんにちは世界。これは簡単な日本語のテキストです。カタカナも。',
    'korean': '안녕하세요 세계, 이것은 간단한 한국어 텍스트입니다.',
    'irish': 'Tá an teach mór agus níl aon fhadhb ann. Céad míle fáilte, óg agus álainn.',
    'dutch': 'Eén coördinatie, reünie, café, geïnd, vóór het huis. De ideeën zijn goed.',
    'albanian': 'Përshëndetje botë, çfarë po bën? Është një tekst i thjeshtë në shqip, gjë.',
    'maltese': 'Merħba, dinja! Il-ġurnata hija sabiħa, għandi ż-żmien, ċar.',
    'esperanto': 'Ĉu vi parolas Esperanton? Ĝi estas facila, ŝipo, ĵaŭdo, ĥoro.',
    'math': 'Let ε > 0; ∀x ∈ ℝ: x² ≥ 0, √x ≤ x ± ½, ∑ aᵢ → ∞, ∂f/∂x ≠ 0, α·β.',
    'math2': '√x ≤ x² and π ≈ 3.14, Σ x ≥ 0, ∞ ± 1°',
    'units': '5 µm, 20 °C, 3 × 4 cm², £5, €10, ½ litre, §3 ¶2, ©2020 Foo™, naïve café 1º 2ª',
    'german': 'Größere Werte führen dazu, dass der Index über 20 € kostet. Straße, Äpfel, Übung.',
    'german2': 'für',
    'french1': 'où',
    'fr': 'à',
    'french': 'Le réglage « privé » est déplacé à côté de l’index ; où est-il ? Ça va, œuvre, maïs, dû, forêt.',
    'spanish': '¿Por qué falla? Después del año, así lo hará: países, línea. ¡Señor, qué pingüino!',
    'portuguese': 'ATENÇÃO: NÃO APAGUE, as relações SÃO recriadas. Âmbito: ação, avô, avó, à noite, pôr.',
    'polish': 'Usługa wczytuje większą wartość, zanim się zamknie żółty. Źle, ćma, ósmy, łąka, ĆMA, ŻÓŁW.',
    'quotes': 'It’s “quoted” — about 5 µs → done ≥ 3 … café – ‘so’ • item',
    'frames': 'src/\n├── a.py\n│   └── b\n└── c.md',
    'azeri': 'Salam dünya, bu sadə bir mətndir, çox gözəl, şəhər.',
    'faroese': 'Føroyar eru ein oyggjabólkur, har tað er øðrvísi, næstan, ísur.',
    'danish1': 'Rød',
    'italian1': 'più',
    'italian2': 'però',
    'norwegian1': 'på',
    'czech1': 'kůň',
    'hung1': 'bőrönd',
    'it3': 'La velocità è più alta.',
    'sv1': 'Hallå på er',
    'cat1': 'això',
    'tr1': 'İstanbul',
    'emoji': 'Done 🎉🎉 ok 👍🏽 → ✓ ✔ ★★★ ☆',
    'ipa': 'The word naïve is /naɪˈiːv/ or [nɑːˈiːv].',
    'code': 'λ = lambda x: x ≥ 0 # naïve → ok; Δt ≈ 5 µs; σ²=1',
    'swiss': 'Zürich – Genève ‹Guillemets› «Text» „Zitat“ ‚einfach‘',
}
OTHERS = [
    "```\nsrc/\n├── a.py\n│   └── b\n└── c.md\n```", "If you see `â€™` or `Ã©` in the output, the file was read wrongly.", "plain ascii &amp; &#233; text", "", "ÂGE MAXIMAL : 9 jours", "TÊTE ÉTÉ OÙ LÄSST UNBERÜHRT",
]


@pytest.fixture(scope="module")
def learnt(spark, data):
    """The cost as it is learnt from the smallest test table."""
    return E.Cost(*E._state(spark.read.parquet(f"{data}/documents.parquet"), E.VOCABULARY).value)


@pytest.mark.parametrize("name", SOUND)
def test_sound_text_is_left_alone_in_every_language(name, learnt):
    text = SOUND[name]
    for cost in (PRIOR, learnt):
        for form in (text, " ".join([text] * 5), *text.split()):
            assert cost.repair(form) == (form, 0, 0)


@pytest.mark.parametrize("text", OTHERS)
def test_quoted_and_plain_text_is_left_alone(text):
    assert PRIOR.repair(text) == (text, 0, 0)


def _misread(text, legacy):
    out = ""
    for b in text.encode():
        try:
            out += bytes([b]).decode(legacy)
        except UnicodeDecodeError:
            out += chr(b)
    return out


OUTSIDE = ("danish", "norwegian", "swedish", "icelandic", "italian", "catalan", "hungarian", "czech", "romanian", "turkish", "russian", "ukrainian", "greek", "hebrew", "chinese", "japanese", "korean", "vietnamese")


@pytest.mark.parametrize("name", OUTSIDE)
@pytest.mark.parametrize("layers", [1, 2, 3, 5])
def test_utf8_read_as_western_comes_back_in_languages_outside_the_tables(name, layers):
    text = garbled = SOUND[name]
    for _ in range(layers):
        garbled = _misread(garbled, "cp1252")
    assert PRIOR.repair(garbled)[0] == text


def test_recall_of_single_byte_mixups_in_languages_outside_the_tables():
    """Each language's usual legacy encoding read as another: what is found, and what is restored exactly."""
    cases = [("danish", "cp1252"), ("swedish", "cp1252"), ("icelandic", "cp1252"), ("italian", "cp1252"), ("catalan", "cp1252"), ("finnish", "cp1252"), ("russian", "cp1251"), ("bulgarian", "cp1251"), ("ukrainian", "cp1251"), ("greek", "cp1253"), ("hungarian", "cp1250"), ("czech", "cp1250")]
    found = right = n = 0
    for name, was in cases:
        for seen in ("mac_roman", "cp437", "cp850") if was != "cp1251" and was != "cp1253" else ("cp1252", "latin-1", "mac_roman"):
            raw = SOUND[name].encode(was, "ignore")
            garbled = "".join(_misread_byte(b, seen) for b in raw)
            restored, repaired, left = PRIOR.repair(garbled)
            n, found, right = n + 1, found + bool(repaired or left), right + (restored == raw.decode(was))
    print(found, right, n)
    assert found >= 0.9 * n and right >= 0.6 * n


def _misread_byte(b, legacy):
    try:
        return bytes([b]).decode(legacy)
    except UnicodeDecodeError:
        return chr(b)


@pytest.mark.parametrize("legacy", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251"])
@pytest.mark.parametrize("layers", [1, 2])
@pytest.mark.parametrize("text", [SOUND[k] for k in ("french", "german", "portuguese", "spanish", "polish", "quotes")])
def test_utf8_read_as_legacy_comes_back(legacy, layers, text):
    garbled = text
    for _ in range(layers):
        out = ""
        for b in garbled.encode():
            try:
                out += bytes([b]).decode(legacy)
            except UnicodeDecodeError:
                out += chr(b)
        garbled = out
    restored, repaired, _ = PRIOR.repair(garbled)
    assert repaired and (restored == text or layers == 2 and legacy in ("cp1251", "mac_roman", "cp437", "cp850", "cp1250"))


@pytest.mark.parametrize("was, seen, text", [("cp1252", "mac_roman", SOUND["french"]), ("cp1252", "cp437", SOUND["spanish"]), ("cp1250", "cp1252", "Usługa wczytuje większą wartość, zanim się zamknie żółty.")])
def test_single_byte_mixups_are_found(was, seen, text):
    garbled = text.encode(was).decode(seen)
    _, repaired, left = PRIOR.repair(garbled)
    assert repaired or left


def test_marks_that_became_letters_are_found_by_the_documents():
    text = "It’s the caller’s job to close the “first” one, don’t ask."
    cost = E.Cost({key: 2000 for key in E.signs_of(text)}, 6000)
    assert cost.repair(text.encode("cp1252").decode("mac_roman"))[0] == text


def test_lost_bytes_are_reported_but_not_changed():
    assert PRIOR.repair("caf� au lait") == ("caf� au lait", 0, 1)


def test_references_are_one_more_layer():
    assert PRIOR.repair("it&#226;&#8364;&#8482;s")[0] == "it’s"


def test_frames(spark):
    rows = [(1, "Ã©tÃ©", 1), (2, "été", 1), (3, None, 1), (None, "Ã©", 1), (4, "", 1), (1, "Ã©tÃ©", 1), (5, "x" * 300_000 + " grÃ¼n " + "y" * 300_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, restored int")
    assert sorted(r["doc_id"] for r in E.garbled_documents(df).collect()) == [1, 5]
    restored = {r["doc_id"]: r["restored"] for r in E.repaired_documents(df).collect()}
    assert restored[1] == "été" and " grün " in restored[5]
    assert E.garbled_documents(df.where("false")).count() == 0
