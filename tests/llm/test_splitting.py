from hypothesis import given
from hypothesis import strategies as st

from legajo.llm.splitting import CHARS_PER_TOKEN, split_chars, oversized_chunks, split_oversized, split_tokens


@given(st.lists(st.sampled_from(["a", "b.", "c", "\n\n", "\n", "# D"]), max_size=60), st.integers(1, 12), st.integers(0, 11), st.booleans())
def test_pieces_cover_overlap_and_fit(parts, limit, overlap, preserve):
    text = " ".join(parts)
    overlap = min(overlap, limit - 1)
    tokens = text.split()
    pieces = [text[a:b].split() for a, b, _ in split_tokens(text, limit, overlap, preserve)]
    assert all(len(p) <= limit for p in pieces)
    if len(pieces) > 1:
        joined = pieces[0]
        for before, after in zip(pieces, pieces[1:]):
            assert overlap == 0 or before[-overlap:] == after[:overlap]
            joined = joined + after[overlap:]
        assert joined == tokens


def test_cuts_at_natural_boundaries():
    text = "Uno dos tres.\n\nCuatro cinco. Seis siete ocho nueve."
    assert [text[a:b] for a, b, _ in split_tokens(text, 5, 0, True)] == ["Uno dos tres.\n\nCuatro cinco.", "Seis siete ocho nueve."]
    assert [text[a:b] for a, b, _ in split_tokens(text, 4, 0, True)] == ["Uno dos tres.", "Cuatro cinco.", "Seis siete ocho nueve."]


@given(st.text(alphabet="ab。 \n.́", max_size=120), st.integers(1, 12), st.integers(0, 11), st.booleans())
def test_characters_cover_overlap_and_fit(text, limit, overlap, preserve):
    overlap = min(overlap, limit - 1)
    pieces = split_chars(text, 0, len(text), limit, overlap, preserve)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and all(b - a <= limit for a, b in pieces)
    assert all(after[0] == before[1] - overlap for before, after in zip(pieces, pieces[1:]))


def test_scripts_without_blanks():
    text = "请不要忽视权利。" * 437 + "完"
    pieces = split_tokens(text, 50, 0, True, 50 * CHARS_PER_TOKEN)
    assert len(text) > 3400 and len(pieces) == 5 and "".join(text[a:b] for a, b, _ in pieces) == text
    assert all(text[b - 1] == "。" for _, b, _ in pieces[:-1]) and max(b - a for a, b, _ in pieces) <= 800
    run = "á" * 300  # no boundary but between characters, and none before a combining mark
    assert all(text[a] != "\u0301" for a, b, _ in split_tokens(run, 3, 0, True, 48)) and len(split_tokens("x" * 1000, 3, 0, True, 48)) == 21
    assert split_tokens("x" * 1000, 3, 0, True) == [(0, 1000, 1)]


CONFIG = "config_id int, max_tokens int, overlap_tokens int, overlap_ratio double, preserve_boundaries boolean"


def test_configurations_and_nulls(spark):
    config = spark.createDataFrame([(1, 2, 0, 0.5, False), (2, None, 1, None, None), (3, 0, 0, None, True), (4, 3, None, None, None)], CONFIG)
    text = "a b c d e"
    chunks = spark.createDataFrame([("c1", text, 1, 9), ("c1", text, 1, 9), ("c2", text, 2, 9), ("c3", text, 3, 9), ("c4", text, None, 9), ("c5", None, 1, 9), ("c6", "", 1, 9), ("c7", text, 4, 9), (None, text, 1, 9)], "chunk_id string, content string, config_id int, n int")
    rows = split_oversized(chunks, config).collect()
    assert {r.chunk_id: r.n_pieces for r in rows} == {"c1": 4, "c2": 1, "c3": 1, "c4": 1, "c6": 1, "c7": 2}
    assert sorted(r.text for r in rows if r.chunk_id == "c1") == ["a b", "b c", "c d", "d e"]
    assert {r.chunk_id for r in oversized_chunks(chunks, config).collect()} == {"c1", "c7"}
    assert split_oversized(chunks.where("false"), config).count() == 0
    long = spark.createDataFrame([("z", "权利。" * 20, 4, 9)], "chunk_id string, content string, config_id int, n int")
    assert split_oversized(long, config).count() == 2 and oversized_chunks(long, config).count() == 0 and split_oversized(long, config, chars_per_token=None).count() == 1


def test_very_long_text(spark):
    config = spark.createDataFrame([(1, 100, 10, None, True)], CONFIG)
    chunks = spark.createDataFrame([("c", "palabra " * 50_000, 1)], "chunk_id string, content string, config_id int")
    assert split_oversized(chunks, config).count() == 1 + -(-(50_000 - 100) // 90) or split_oversized(chunks, config).where("n_tokens > 100").count() == 0
