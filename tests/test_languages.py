import pytest

from echolex.operators import detect as D
from echolex.operators import languages as L


def voices(spark, rows):
    return spark.createDataFrame(rows, "lang string, filename string, priority byte")


@pytest.mark.parametrize(
    "given, order", [("x0 y1 z2", "z y x"), ("x0 y2 z1 w-1", "y z x w"), ("x0", "x"), ("b1 a1 c2", "c a b")]
)
def test_voice_order(spark, given, order):
    rows = voices(spark, [("ts", v[0], int(v[1:])) for v in given.split()])
    row = L.voices_by_language(rows).first()
    assert [v["filename"] for v in row["voices"]] == order.split()
    assert L.default_voices(rows).first()["filename"] == order.split()[0]


def test_choose_voice(spark):
    rows = voices(spark, [("en", "en/a", 1), ("en", "en/b", 5), ("de", "de/a", 0), (None, "x", 9)])
    assert L.choose_voice(rows, "any/voice") == "any/voice"
    assert L.choose_voice(rows, None, "en") == "en/b"
    assert L.choose_voice(rows, detect=lambda: "de") == "de/a"
    with pytest.raises(L.NoVoiceForLanguage, match="xx"):
        L.choose_voice(rows, None, "xx")


def test_report_width_counts_bytes(spark):
    rows = voices(spark, [("en", "ééééé", 1), ("en", "b", 12)])
    assert L.catalogue_width(rows).first()["width"] == 10
    lines = [r["line"] for r in L.catalogue_report(rows).orderBy("nth").collect()]
    assert lines == [" " * 9 + "b " + " " * 8 + "12", "ééééé " + " " * 9 + "1"]
    assert L.catalogue_width(rows.limit(0)).first()["width"] == 8


def test_codes(spark):
    rows = L.code_table(spark).collect()
    assert len(rows) == 69 and all(len(r["code"]) == 2 for r in rows) and len({r["code"] for r in rows}) == 69
    assert (L.two_letter_code("Jpn"), L.two_letter_code("Cmn"), L.two_letter_code("Epo")) == ("jp", "zh", "eo")


def test_first_seen(spark):
    rows = spark.createDataFrame(list(enumerate("xyyzyxx")), "ord int, name string")
    assert [r["name"] for r in L.first_seen(rows, "name", "ord").orderBy("ord").collect()] == ["x", "y", "z"]


SAMPLES = [
    ("en", "the quick brown fox jumps over the lazy dog and then the other animals of the forest were sleeping there"),
    ("de", "der schnelle braune fuchs springt über den faulen hund und dann schliefen die anderen tiere des waldes dort"),
    ("fr", "le rapide renard brun saute par dessus le chien paresseux et puis les autres animaux de la forêt dormaient"),
]


def test_detect(spark):
    known = D.profiles(spark.createDataFrame(SAMPLES, "lang string, text string"))
    texts = [
        (1, "the dogs and the foxes were sleeping there"), (2, "die hunde und die füchse schliefen dort im walde"),
        (3, "les chiens et les renards dormaient dans la forêt"), (4, ""), (5, "    "), (6, "test"), (7, None),
        (8, "γεια σου κόσμε"), (9, "안녕하세요"),
    ]
    found = D.detect(spark.createDataFrame(texts, "doc_id int, text string"), known).collect()
    assert {r["id"]: r["language"] for r in found} == {1: "en", 2: "de", 3: "fr", 4: None, 5: None, 6: None, 7: None, 8: "el", 9: "ko"}


def test_detect_file_reads_a_prefix(spark):
    known = D.profiles(spark.createDataFrame(SAMPLES, "lang string, text string")).cache()
    lines = spark.createDataFrame(list(enumerate(["x", "", None, "die hunde und die", "füchse schliefen dort", "im walde", "und"] + ["mehr"] * 40)), "ord int, line string")
    language, read = D.detect_file(lines, known)
    assert language == "de" and sorted(r["ord"] for r in read.collect()) == [0, 1, 2, 3, 4]
    with pytest.raises(EOFError):
        D.detect_file(lines.limit(1), known)
    language, read = D.detect_file(spark.createDataFrame([(i, "") for i in range(40)] + [(40, "γεια σου κόσμε")], "ord int, line string"), known)
    assert language == "el" and read.count() == 41


# Sentences and the languages that have to come out for them without labelled texts.
SENTENCES = [
    ("The quick brown fox jumps over the lazy dog and feels as if he were in the seventh heaven of typography", "en"),
    ("Stanleys Expeditionszug quer durch Afrika wird von jedermann bewundert", "de"),
    ("Le vif renard brun saute par-dessus le chien paresseux", "fr"),
    ("Шустрая бурая лисица прыгает через ленивого пса", "ru"),
    ("", None), ("   ", None), ("test", None),
]
LATIN = ["Lorem ipsum dolor sit amet,", "consectetur adipiscing elit, sed", "do eiusmod tempor incididunt ut labore et dolore",
         "magna aliqua. Ut enim ad minim veniam, quis", "nostrud exercitation ullamco laboris nisi ut aliquip", "ex ea commodo consequat."]


def test_detection_by_samples(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SENTENCES)], "doc_id int, text string")
    got = {r["id"]: r["language"] for r in D.detect(rows).collect()}
    assert [got[i] for i in range(len(SENTENCES))] == [lang for _, lang in SENTENCES]
    language, read = D.detect_file(spark.createDataFrame(list(enumerate(LATIN)), "ord int, line string"))
    assert language == "la" and read.count() < len(LATIN)


# Sentences that no sample holds, each of another language.
OTHERS = {
    "es": "Mi hermana vive en una casa pequeña cerca del río y trabaja todos los días", "pt": "A minha irmã mora numa casa pequena perto do rio e não trabalha hoje",
    "it": "Mia sorella abita in una casa piccola vicino al fiume e lavora ogni giorno", "nl": "Mijn zus woont in een klein huis bij de rivier en werkt elke dag",
    "pl": "Moja siostra mieszka w małym domu nad rzeką i pracuje codziennie", "cs": "Moje sestra bydlí v malém domě u řeky a pracuje každý den",
    "sv": "Min syster bor i ett litet hus vid floden och arbetar varje dag", "fi": "Sisareni asuu pienessä talossa joen lähellä ja työskentelee joka päivä",
    "hu": "A nővérem egy kis házban lakik a folyó mellett és minden nap dolgozik", "tr": "Kız kardeşim nehrin yanında küçük bir evde yaşıyor ve her gün çalışıyor",
    "ro": "Sora mea locuiește într-o casă mică lângă râu și lucrează în fiecare zi", "vi": "Chị tôi sống trong một ngôi nhà nhỏ gần sông và làm việc mỗi ngày",
    "id": "Kakak saya tinggal di rumah kecil dekat sungai dan bekerja setiap hari", "uk": "Моя сестра живе в маленькому будинку біля річки і працює щодня",
    "bg": "Сестра ми живее в малка къща до реката и работи всеки ден", "fa": "خواهر من در یک خانه کوچک نزدیک رودخانه زندگی می کند و هر روز کار می کند",
    "ar": "تعيش أختي في بيت صغير بالقرب من النهر وتعمل كل يوم في المدينة", "lt": "Mano sesuo gyvena mažame name prie upės ir dirba kiekvieną dieną",
}


def test_detection_of_other_languages_by_samples(spark):
    rows = spark.createDataFrame(list(OTHERS.items()), "doc_id string, text string")
    got = {r["id"]: r["language"] for r in D.detect(rows).collect()}
    print("BY SAMPLES", {k: v for k, v in got.items() if k != v})
    assert sum(k == v for k, v in got.items()) >= 0.75 * len(OTHERS) and sum(v not in (k, None) for k, v in got.items()) <= 0.1 * len(OTHERS)


def test_scores_are_those_of_the_definition(spark):
    known = [("x", " ab", 1), ("x", "abc", 3), ("y", "abc", 1), ("y", "bc ", 400)]
    texts = ["abc", "Abc abc-ab", "", None, "aBc" * 50_000, "ab1bc é"]

    def plain(text):
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        grams = [f" {w} "[i : i + 3] for w in words for i in range(len(w))]
        sums = {lang: sum(401 - r for g in grams for k, h, r in known if k == lang and h == g) for lang in "xy"}
        return sorted(((lang, s) for lang, s in sums.items() if s), key=lambda p: (-p[1], p[0]))

    rows = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "id int, text string, scores int")
    got = D.scores(rows, spark.createDataFrame(known, "lang string, gram string, rank int")).collect()
    assert {r["id"]: [tuple(p) for p in r["scores"]] for r in got} == {i: plain(t) for i, t in enumerate(texts)}


def _right(found):
    rows = [r for r in found if r["text"] is not None and sum(c.isalpha() for c in r["text"]) >= D.LEAST_LETTERS]
    return rows, [r for r in rows if r["lang"] in ("en", "de", "fr", "es")]


def test_wrong_labels_make_no_language(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    rows, labelled = _right(D.cross_detect(documents).join(documents, D.F.col("id") == D.F.col("doc_id")).collect())
    assert {r["language"] for r in rows} - {None} == {"en", "de", "fr", "es"}
    print("NULL", sum(r["language"] is None for r in rows), len(rows), "RIGHT", sum(r["language"] == r["lang"] for r in labelled), len(labelled))
    assert sum(r["language"] is None for r in rows) <= 0.05 * len(rows)
    assert sum(r["language"] == r["lang"] for r in labelled) >= 0.9 * len(labelled)


def test_labels_that_nothing_confirms_are_kept_folded(spark):
    rows = [(i, f" {lang.upper()}", text) for i, (lang, text) in enumerate(SAMPLES)] + [(8, None, "x"), (9, "en", None), (10, " ", SAMPLES[0][1])]
    got = D.cross_detect(spark.createDataFrame(rows, "doc_id int, lang string, text string")).collect()
    assert sorted(r["id"] for r in got) == [0, 1, 2, 8, 9, 10] and {r["language"] for r in got} <= {None, "en", "de", "fr"}
    assert D.cross_detect(spark.createDataFrame([], "doc_id int, lang string, text string")).count() == 0


def test_detection_on_unseen_documents_of_any_label_and_length(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    found = D.cross_detect(documents).join(documents, D.F.col("id") == D.F.col("doc_id")).where("lang IS NOT NULL AND text IS NOT NULL")
    rows = found.collect()
    assert sum(r["language"] == r["lang"] for r in rows) >= 0.9 * len(rows) > 0
