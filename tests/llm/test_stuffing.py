from legajo.llm.stuffing import Languages, learn_languages, profile, spam_shares, stuffed_pages

PLACES = ["Loma Alta", "San Lirio del Paso", "Las Brumas", "El Cortijo", "Pozo Nuevo", "Villa Clara", "Corral de Nubes", "La Palma"]
MANY = PLACES + ["Alto Rumor", "Bajo Seco", "La Honda", "Monte Perdiz", "Tierra Gacha", "El Olvido", "Aguas Zarcas", "Punta Caracola", "Media Cuesta", "El Guásimo"]
SPAM = [
    ", ".join(f"vivienda barata {p}" for p in PLACES * 2),
    "crédito rural " * 60,
    "\n".join("Inicio | Mapa | Contratos | Noticias" for _ in range(8)),
    "\n".join(f"oferta >> https://tienda.example/p/{i}" for i in range(12)),
    " ".join(f'<a href="http://x.example/{i}">plan</a><br>' for i in range(20)),
    " / ".join(f"Toner ref {i} $ {i * 7} oferta" for i in range(100, 120)),
    " ".join(f"#{p.replace(' ', '')}" for p in PLACES * 2),
    "Subsidio ya. Crédito rural! Subsidio ya crédito rural urgente. " * 8,
    "La alcaldía presentó el plan en la vereda.\n" + "\n".join(f"abogado rural {p}" for p in PLACES * 3),
]
HONEST = [
    "La alcaldía presentó el plan de agua en la vereda y la comunidad pidió que se revise el avance cada mes. " * 5,
    "Tabla de indicadores\n" + "\n".join(f"La tasa de deserción: {i}.5 % (2020), meta {i} %" for i in range(20)),
    "\n".join(f"[{i}] La mesa de víctimas y la alcaldía firmaron un acuerdo sobre el banco de semillas. https://x.example/{i}" for i in range(8)),
    "Veredas: " + ", ".join(f"{a} de {b}" for a, b in zip(MANY, MANY[5:] + MANY[:5])),
    "\n".join(f"{i}. ¿Mejora la cobertura con el programa?\nNo hay evidencia de que la obra haya terminado en la vereda." for i in range(6)),
    "La alcaldía presentó el plan de agua en la vereda y la comunidad pidió que se revise el avance. " * 6 + "\nEtiquetas: plan rural, subsidio ya, agua potable\nInicio | Mapa | PQRS",
    "计划包括乡村小学、太阳能路灯、卫生站等977个项目。南岚镇政府修建了图书室。白渡的资金为什么没有到位？",
]


def test_pages(spark):
    rows = [(i, t) for i, t in enumerate(SPAM)] + [(100 + i, t) for i, t in enumerate(HONEST)]
    # plain texts set the norm of function words
    rows += [(1000 + i, HONEST[0]) for i in range(30)] + [(7, SPAM[7]), (500, None), (501, ""), (502, "\n \n"), (None, SPAM[0])]
    docs = spark.createDataFrame([(a, b, "q") for a, b in rows], "doc_id bigint, text string, language string")
    assert {r.doc_id for r in stuffed_pages(docs).collect()} == set(range(len(SPAM)))
    shares = {r.doc_id: r.spam_share for r in spam_shares(docs).collect()}
    assert shares[501] == shares[502] == 0.0 and 500 not in shares
    assert stuffed_pages(docs.where("false")).count() == 0


def test_very_long_page(spark):
    docs = spark.createDataFrame([(1, "trámites en línea " * 40_000)], "doc_id bigint, text string")
    assert stuffed_pages(docs).count() == 1


RUSSIAN = ["Совет утвердил план развития села на {i} год без изменений.", "Жители села не знают, когда откроют школу №{i}.", "Для {i} семей по программе построили колодцы и мосты.", "Почему средства на дороги к селу не поступили в {i} году?"]
CHINESE = ["南岚镇政府在{i}年为村民修建了图书室。", "白渡的公路资金为什么没有到位？", "会议决定把期限延长到{i}年，但没有说明理由。", "青梧的供水覆盖率提高到{i}%，高于上一年。"]


def test_other_scripts_are_learnt(spark):
    """Stuffed pages in scripts without a list of function words; every text about {i} is an honest one."""
    rows = [(i, " ".join(form.format(i=10 + (i * 7 + k * k) % 80) for k, form in enumerate(own[i % 4 :] + own[: i % 4]) if (i + k) % 5), "ru" if own is RUSSIAN else None) for own in (RUSSIAN, CHINESE) for i in range(40)]
    rows = [(n, *r[1:]) for n, r in enumerate(rows)]
    rows += [(900, "купить дешевые телефоны москва " * 60, "ru"), (901, "购买便宜手机北京" * 60, "zh"), (902, "купить телефоны, дешевые цены, телефоны москва, " * 30, None), (903, "购买便宜手机，北京手机商店，" * 40, "zh")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learnt = learn_languages(docs)
    assert {"на", "не"} <= learnt.words["CYRILLIC"] and "села" not in learnt.words["CYRILLIC"] and {"的", "到"} & learnt.words["CJK"]
    assert {r.doc_id for r in stuffed_pages(docs).collect()} == {900, 901, 902, 903}


def test_calibration_is_per_language(spark):
    """The same share of a phrase is usual in one language's texts and not in another's."""
    words = Languages()
    page = "tarifa agua, " * 3 + "La alcaldía presentó el plan en la vereda. " * 12
    assert profile(page, words)[0] == "es" and profile("", words)[4] == 0
    usual = [(i, "El plan de agua y el plan de vías siguen en la vereda. " * (3 + i % 3), "es") for i in range(30)]
    docs = spark.createDataFrame(usual, "doc_id bigint, text string, lang string")
    assert stuffed_pages(docs).count() == 0
