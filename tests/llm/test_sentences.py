import random

import numpy as np
import pytest

from legajo.llm.sentences import Model, fit, sentence_ends, sentences, stripped_chain, unmarked_scripts

# Sentences of several languages; each second line of the lists is used for fitting in other texts than the test's.
SPANISH = ["El Sr. {n} pagó {k}.{k} pesos.", "¿Qué pasó con {n}?", "La Dra. {n} vino con A. B. {n} y Cía. de día.", "¡{n} no da espera!", "Se dieron semillas, abonos, etc.", "La obra de {n} empezó a las {k} a. m. en la plaza.", "El plan de {n} sigue en la vereda.", "«¿Cuándo llega {n}?», preguntó ella.", "Dijo: «No ha comenzado {n}.»"]
NAMES = "Gómez Ruiz Paz Gil Tunja Pasto Neiva Cali Sucre Rivera Lozano Mejía".split()
CHINESE = ["{n}镇政府修建了{k}条公路。", "“什么时候完工？”{n}代表问道。", "计划包括{k}.5个项目……但没有说明。", "{n}的资金为什么没有到位？", "请不要忽视{n}的权利！"]
PLACES = "石桥 青梧 白渡 柳塘 南岚 东川".split()
HINDI = ["{n} की सूची जमा की।", "{n} को बजट समय पर क्यों नहीं मिला?", "“काम कब शुरू होगा?” {n} के लोगों ने पूछा।", "योजना में {n} शामिल है।"]
VILLAGES = "सोनघाट नीलपुर मेघगाँव वनतल".split()
THAI = ["สตรีใน{n}ต้องการสิทธิในที่ดิน", "แผนของ{n}มี สะพาน และ อนามัย", "สภา{n}เลื่อนการประชุมออกไป {k} วัน"]
TOWNS = "ดอนพริ้ว ธารลม หนองใส เขาหมอก".split()
KINDS = {"Latin": (SPANISH, NAMES, " "), "Chinese": (CHINESE, PLACES, ""), "Hindi": (HINDI, VILLAGES, " "), "Thai": (THAI, TOWNS, " ")}


def _sentences(kind, rng, n):
    forms, names, _ = KINDS[kind]
    return [rng.choice(forms).format(n=rng.choice(names), k=rng.randint(2, 99)) for _ in range(n)]


def _texts(kind, seed, n):
    """(text, ends): sentences joined, one in four by a line break."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        text, ends = "", []
        for i, own in enumerate(_sentences(kind, rng, 6)):
            text += ("" if not i else "\n" if rng.random() < 0.25 else KINDS[kind][2]) + own
            ends.append(len(text))
        out.append((text, ends))
    return out


@pytest.fixture(scope="module")
def model():
    return fit([t for i, kind in enumerate(KINDS) for t, _ in _texts(kind, i, 250)])


def _split(text, model, **options):
    ends = sentence_ends(text, model, **options)
    return [text[a:b].strip() for a, b in zip([0, *ends], ends)]


@pytest.mark.parametrize("kind", KINDS)
def test_held_out_accuracy(model, kind):
    """Texts that are not in the fit, without one line break, in every script."""
    rng = random.Random(99)
    right = found = true = 0
    for _ in range(60):
        own = _sentences(kind, rng, 8)
        text = KINDS[kind][2].join(own)
        ends = {len(KINDS[kind][2].join(own[: i + 1])) for i in range(8)}
        got = set(sentence_ends(text, model))
        right, found, true = right + len(got & ends), found + len(got), true + len(ends)
    assert right / found >= 0.95 and right / true >= 0.95


def test_the_transitions_decide():
    """Where the words around a mark are the same, the distance from the boundary before tells."""
    near, far = "Diez arte. Diez obras siguen en la plaza mayor.", "Diez vecinos de la vereda alta dijeron que vivían por amor al arte."
    rng, texts = random.Random(5), []
    for _ in range(300):
        own = [rng.choice([near, far]) for _ in range(5)]
        texts.append("".join(("" if not i else rng.choice("\n   ")) + t for i, t in enumerate(own)))
    fitted, plain = fit(texts), fit(texts, use_transitions=False)
    text = " ".join([far, near, near, far, near])
    assert _split(text, fitted) == [far, near, near, far, near]
    assert _split(text, plain) != [far, near, near, far, near]
    none = Model(fitted.weights, np.zeros_like(np.array(fitted.transitions)).tolist(), fitted.unmarked)
    assert _split(text, none) != [far, near, near, far, near]


def test_the_fit_decides(model):
    """Without the fit a mark is no more a boundary than not."""
    text = "El Sr. Gil vino. La Dra. Paz también."
    assert _split(text, model) == ["El Sr. Gil vino.", "La Dra. Paz también."] and _split(text, Model()) == [text]


def test_unmarked_scripts_are_learnt():
    assert unmarked_scripts([t for t, _ in _texts("Thai", 1, 20)] + [t for t, _ in _texts("Latin", 1, 20)]) == ("THAI",)
    chain = stripped_chain("แผนของธารลมมี สะพาน!\nสภาเลื่อนการประชุม 5 วัน.", ("THAI",))
    assert not any("!" in f for found in chain.features for f in found) and sum(chain.broken) == 1


def test_no_blank_after_a_mark(model):
    assert _split("El plan de Cali sigue en la vereda.La obra sigue en la plaza. Vea www.datos.gov y 3.5", model)[0] == "El plan de Cali sigue en la vereda."


def test_soft_lines(model):
    assert _split("El plan de Cali\nsigue en la vereda. La obra de Paz\n\nOtra", model, soft_lines=True) == ["El plan de Cali\nsigue en la vereda.", "La obra de Paz", "Otra"]


def test_blank_and_untrained():
    assert sentence_ends("", Model()) == [] and sentence_ends(" \n ", Model()) == []
    assert sentence_ends("Hola\n¿Sí?\n\nNo ", Model()) == [4, 9, 13]
    assert fit([]) == Model() and fit(["x"]).weights == {}


def test_rows(spark, model):
    chunks = spark.createDataFrame([("c1", "El plan de Cali sigue en la vereda. La obra sigue.", 7), ("c1", "El plan de Cali sigue en la vereda. La obra sigue.", 7), (None, "x", 7), ("c2", None, 7), ("c3", "", 7), ("c4", "a" * 200_000, 7)], "chunk_id string, content string, end_char int")
    got = {tuple(r) for r in sentences(chunks, model).collect()}
    assert got == {("c1", 0, 35, 2), ("c1", 1, 50, 2), ("c4", 0, 200_000, 1)}
    assert sentences(chunks.where("false"), model).count() == 0
