import unicodedata

from hypothesis import given
from hypothesis import strategies as st

from legajo.llm.confusables import _TWINS, confusable_tokens, form_classes, keyword_matches, resolved_scripts, same_looking, token_scripts, visible_form, with_visible_form


def test_same_look_same_form():
    base = "participación básica DE-1 m²"
    for other in ("pаrtiсipaсión básica DE-1 m²", "participación básica DE-1 m²", "par­ti​cipación básica DE‑1 m²", "ｐａｒｔｉｃｉｐａｃｉóｎ básica ＤＥ-１ ｍ²", "partⅰcⅰpacⅰón básⅰca DE-1 m²"):
        assert visible_form(other) == visible_form(base) == base


def test_visible_differences_stay():
    forms = [visible_form(x) for x in ("m2", "m²", "ano", "año", "Ano", "an0", "a no", "a\nno", "ano.", "ana")]
    assert len(set(forms)) == len(forms)


def test_words_of_other_scripts_keep_theirs():
    assert visible_form("вoда") == "вода"  # a Latin o in a Cyrillic word
    assert visible_form("право δικαίωμα 人权 สิทธิ حق अधिकार") == unicodedata.normalize("NFC", "право δικαίωμα 人权 สิทธิ حق अधिकार")
    assert token_scripts("сор") == "look-alike" and token_scripts("вoда") == "mixed" and token_scripts("agua") == "single"


def test_letters_of_many_alphabets():
    for letter, latin in zip("ᎪꓐѴҮԌѵՏϲϹ", "ABVYGvScC", strict=True):
        assert visible_form(f"p{letter}x") == f"p{latin}x" and visible_form(letter) == latin
    assert visible_form("Үкімет") == "Үкімет" and visible_form("Үкiмет") == "Үкімет"  # a Cyrillic word keeps its own letters
    assert resolved_scripts("сор") >= {"Latin", "Cyrillic"} and resolved_scripts("вода") == {"Cyrillic"} and not resolved_scripts("жλ")


def test_the_table_against_the_published_one(spark):
    """Each pair has one skeleton in the confusables data that ships with the JVM's Unicode library."""
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    odd = [(a, b) for twins in _TWINS.values() for a, b in twins.items() if checker.getSkeleton(0, a).lower() != checker.getSkeleton(0, b).lower()]
    assert set(odd) <= {("ӏ", "l"), ("Ԛ", "Q")}, odd  # the published skeleton is another glyph of the same shape


def test_ways_of_composing():
    for text in ("한국어", "কো", "கொ", "കൊ", "Việt", "が"):
        assert visible_form(unicodedata.normalize("NFD", text)) == visible_form(text) == unicodedata.normalize("NFC", text)
    assert visible_form("a\u115fb\u1160c\u3164d\uffa0e\U000e0101f\u034fg") == "abcdefg"


def test_detection(spark):
    texts = spark.createDataFrame([("el сор y la вoда, вода", "a"), ("сор", "b"), (None, "c"), ("漢字かな", "d")], "content string, token string")
    assert {tuple(r) for r in confusable_tokens(texts, "content").collect()} == {("сор", "look-alike", "cop", 2), ("вoда", "mixed", "вода", 1)}
    assert confusable_tokens(texts.where("false"), "content").count() == 0


def test_null_and_empty():
    assert visible_form(None) is None and visible_form("") == "" and visible_form("​") == ""


@given(st.text(max_size=60))
def test_form_is_stable(text):
    form = visible_form(text)
    assert visible_form(form) == form


def test_long_text_and_clashing_column(spark):
    long = "ａ" * 300_000
    df = spark.createDataFrame([(long, "x"), (None, "y")], "content string, visible_form string")
    assert {r.visible_form for r in with_visible_form(df, "content").collect()} == {"a" * 300_000, None}


def test_keywords(spark):
    mappings = spark.createDataFrame([("m1", ["agua", None, "аgua", "Agua"]), ("m2", None), ("m3", []), ("m3", ["аgua"])], "mapping_id string, keywords array<string>")
    lexicon = spark.createDataFrame([("k1", "agua"), ("k2", None), ("k3", "m2")], "kw_id string, keyword string")
    assert {tuple(r) for r in keyword_matches(mappings, lexicon).collect()} == {("k1", "m1", 2), ("k1", "m3", 0)}
    assert keyword_matches(mappings.where("false"), lexicon).count() == 0


def test_contents(spark):
    rows = [("c1", "uno dos"), ("c2", "uno dos"), ("c3", "uno dos"), ("c1", "uno dos"), ("c4", None), (None, "uno dos"), ("c5", "Uno dos"), ("c6", "unо dos")]
    chunks = spark.createDataFrame([(a, b, "z") for a, b in rows], "chunk_id string, content string, form string")
    assert {tuple(r) for r in same_looking(chunks).collect()} == {("c1", "c2"), ("c2", "c3"), ("c1", "c6"), ("c2", "c6"), ("c3", "c6")}
    assert same_looking(chunks.where("false")).count() == 0
    classes = form_classes(chunks).collect()
    assert {r.id for r in classes} == {"c1", "c2", "c3", "c6"} and len({r.form for r in classes}) == 1 and len({r.spelling for r in classes}) == 3
