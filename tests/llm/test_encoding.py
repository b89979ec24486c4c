import random

import numpy as np

from lodestrata.llm import encoding as E

SENTENCES = {
    "fr": "La requête précédente a été créée après le déploiement ; elle « répète » les clés à côté de l’index.",
    "de": "Die Prüfung lädt größere Einträge – über „Straßen“ und Übergänge hinaus.",
    "ru": "Служба поиска хранит последние записи и проверяет каждый новый документ без предупреждения.",
    "pl": "Węzeł zapasowy łączy źródła, ścieżki i żądania, zanim usunie pamięć podręczną.",
    "zh": "压缩期间，集合合并最近的记录，并返回全部文档。",
    "en": "It’s a naïve café test — 20 °C, 5 µs, ≥ 3 “quotes” for Zoë’s patch.",
    "pt": "NÃO HÁ AÇÃO EM SÃO JOÃO; a coleção já contém três cópias até amanhã.",
}


def corpus():
    rng = random.Random(3)
    clean = []
    for n in range(1200):
        words = SENTENCES[rng.choice(list(SENTENCES))].split(" ")
        k = rng.randrange(len(words))
        clean.append(" ".join(words[k:] + words[:k]))
    return clean


def garble(text, written, read):
    table = {b: c for c, b in E.byte_map(read).items()}
    return "".join(table[b] for b in text.encode(written))


BAD = {
    1: garble(SENTENCES["fr"], "utf-8", "cp1252"),
    2: garble(SENTENCES["de"], "utf-8", "mac_roman"),
    3: garble(SENTENCES["ru"], "cp1251", "cp1252"),
    4: garble(SENTENCES["ru"], "koi8-r", "cp1252"),
    5: garble(garble(SENTENCES["fr"], "utf-8", "cp1252"), "utf-8", "cp1252"),
    6: garble(SENTENCES["zh"], "gbk", "cp1252"),
    7: "plain start. " + garble("5 µs", "utf-8", "cp1252") + " and nothing else",
    8: garble(SENTENCES["pl"], "utf-8", "cp1250"),
}


def test_found_restored_and_nothing_else(spark):
    rows = [(n, t, "x") for n, t in BAD.items()] + [(100 + i, t, "x") for i, t in enumerate(corpus())] + [(9000, None, "x"), (9001, "", "x"), (9002, "ascii only", "x"), (9003, SENTENCES["ru"].upper(), "x")]
    got = {r["doc_id"]: r for r in E.repairs(spark.createDataFrame(rows, "doc_id long, text string, restored string").drop("restored"), "doc_id", "text").collect()}
    assert set(got) == set(BAD)
    for n, lang in ((1, "fr"), (2, "de"), (3, "ru"), (4, "ru"), (5, "fr"), (6, "zh"), (8, "pl")):
        assert got[n]["restored"] == SENTENCES[lang]
    assert got[7]["restored"] == "plain start. 5 µs and nothing else"
    spans = got[7]["spans"]
    assert len(spans) == 1 and BAD[7][spans[0]["start"] : spans[0]["end"]] == "Âµ" and spans[0]["original"] == "µ"


def test_lost_bytes_are_found_and_marked():
    model = E.Model(*_counts(corpus()))
    broken = garble(SENTENCES["fr"], "utf-8", "cp1252").replace("\x80", "�")
    labels = model.label(broken)
    assert labels and "requête précédente" in model.repair(broken, labels)


def _counts(texts):
    pairs, chars = np.zeros(E.PAIR_BUCKETS, np.int64), np.zeros(E.CHAR_BUCKETS, np.int64)
    E.count_text(texts, pairs, chars)
    return pairs.astype(np.float32), chars.astype(np.float32)


def test_inverse_transforms_undo_every_pair():
    for k, pair in enumerate(E.PAIRS):
        text = {"koi8-r": SENTENCES["ru"], "cp1251": SENTENCES["ru"], "iso8859-5": "новый", "cp866": "новый", "gbk": "压缩", "shift_jis": "検索", "euc_jp": "検索", "cp1250": "łąka", "iso8859-2": "łąka", "cp1254": "şık"}.get(pair[0], "é")
        bad = text
        for written, read in zip(pair[::2], pair[1::2]):
            if read in E.MULTIBYTE:
                bad = bad.encode(written).decode(read, "replace")
            else:
                bad = garble(bad, written, read)
        if E.LOST not in bad:
            assert E.UNDO[k](bad) == text, pair


def test_empty(spark):
    assert E.repairs(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0
