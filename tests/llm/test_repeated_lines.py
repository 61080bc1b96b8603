import random
from collections import defaultdict

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from legajo.llm.repeated_lines import cut_lines, cut_out, cut_text, letters_only, repeated_lines, repeated_pieces, without_repeated_lines, without_repeated_passages

SCHEMA = "chunk_id string, source string, content string, line_no int"


def _brute(rows):
    documents, places = defaultdict(dict), defaultdict(lambda: defaultdict(set))
    for chunk, source, content in rows:
        if None not in (chunk, source, content):
            documents[source][chunk] = content
    out = set()
    for source, chunks in documents.items():
        for chunk, content in chunks.items():
            for number, line in enumerate(content.split("\n"), 1):
                if key := letters_only(line):
                    places[source, key][chunk].add(number)
        for (owner, _), where in places.items():
            if owner == source and len(where) >= 5 and len(where) >= 0.1 * len(chunks):
                out |= {(c, n) for c, ns in where.items() for n in ns}
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    lines = ["Comparte esta nota", "¡Comparte! esta NOTA 12", "x", "--", "", "Lea también: agua", "Aviso legal del sitio y de sus contenidos", *[f"La nota {chr(97 + i)}{chr(97 + i % 7)} sigue" for i in range(26)]]
    rows = [(f"c{i}", rng.choice(["s1", "s2", "s1"]), "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 6)))) for i in range(120)]
    rows += rows[:20] + [(None, "s1", "x"), ("z", None, "x"), ("y", "s1", None), ("w", "s2", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    assert {tuple(r) for r in repeated_lines(df).collect()} == _brute(rows)


@given(st.text(alphabet="abcdefgáñ\n", max_size=200))
def test_pieces_depend_on_the_line_only(text):
    line, hashes = cut_lines(text)
    for number, own in enumerate(text.split("\n")):
        alone = cut_lines(own)[1]
        assert np.array_equal(hashes[line == number], alone) and bool(len(alone)) == bool(own)


@given(st.text(alphabet="abcdefgáñ", min_size=60, max_size=120), st.text(alphabet="abcdef \n", max_size=40), st.text(alphabet="xyz -\n", max_size=40))
def test_pieces_find_their_cuts_again(shared, before, other):
    """Whatever stands before, the pieces after the first cut within the shared letters are the same."""
    one, two = cut_text(before + shared), cut_text(other + "\n" + shared)
    inner = [h for a, h in zip(one[0], one[2]) if a >= len(before) + 7]
    assert inner == [h for a, h in zip(two[0], two[2]) if a >= len(other) + 8][-len(inner) or len(two[2]) :]


def test_pieces_decide(spark, monkeypatch):
    """Distinct documents are counted per piece; with pieces that never recur no line is found."""
    df = spark.createDataFrame([(f"c{i}", "s", f"Comparte esta nota con sus amigos\ntexto propio {chr(97 + i)}", 1) for i in range(6)], SCHEMA)
    assert repeated_lines(df).count() == 6
    pieces = repeated_pieces(spark.createDataFrame([(f"c{i}", "s", [1, 2 + i]) for i in range(6)], "chunk_id string, source string, pieces array<bigint>"), spark.createDataFrame([("s", 5.0)], "source string, least double"))
    assert [tuple(r) for r in pieces.collect()] == [("s", 1, 6)]
    monkeypatch.setattr("legajo.llm.repeated_lines.repeated_pieces", lambda rows, least, n: rows.select("source", F.lit(0).cast("bigint").alias("piece"), F.lit(9).alias("documents")))
    assert repeated_lines(df).count() == 0


def test_passages_inside_lines(spark):
    shared = "Comparte esta nota con todos los vecinos de la vereda y escribe al correo del portal. Queda prohibida la reproducción total o parcial sin permiso del medio."
    own = ["agua potable", "vías rurales", "salud mental", "banco de semillas", "escuela de paz", "puente nuevo"]
    df = spark.createDataFrame([*[(f"c{i}", "s", f"Sobre {t} hay noticia. {shared} Sigue {t}.", 1) for i, t in enumerate(own)], ("z", "s", None, 1), ("e", "s", "", 1)], SCHEMA)
    got = {r.chunk_id: (r.content, r.removed) for r in without_repeated_passages(df).collect()}
    assert set(got) == {*(f"c{i}" for i in range(6)), "e"} and got["e"] == ("", 0)
    for i, t in enumerate(own):
        content, removed = got[f"c{i}"]
        assert removed == 1 and f"Sobre {t}" in content and t in content[30:] and "todos los vecinos de la vereda" not in content
    assert cut_out("nada", set()) == ("nada", 0)


def test_cleaned(spark):
    rows = [(f"c{i}", "s", f"Comparte esto\ntexto propio {chr(97 + i)}\n", 1) for i in range(6)]
    df = spark.createDataFrame([*rows, ("n", None, "queda", 1)], SCHEMA)
    got = {r.chunk_id: (r.content, r.removed) for r in without_repeated_lines(df).collect()}
    assert got["c2"] == ("texto propio c\n", 1) and got["n"] == ("queda", 0) and len(got) == 7
    assert repeated_lines(df.where("false")).count() == 0
