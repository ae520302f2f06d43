import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import queries as q
from quillspark.llm import repetition as r


def brute(tokens):
    first, places = {}, set()
    for i in range(len(tokens) - 3):
        gram = tuple(tokens[i : i + 4])
        if gram in first:
            places.update(range(i, i + 4))
        else:
            first[gram] = i
    return len(places)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60))
def test_repeated_places_match_a_plain_count(tokens):
    assert r.repeated_places(tokens) == brute(tokens)


@pytest.mark.parametrize("text,words", [("It's É2 _x_", ["it", "s", "é2", "x"]), ("", []), ("İx", ["i̇x"])])
def test_words(text, words):
    assert r.words(text) == words


def test_share_of_parts():
    assert r.duplicate_share(["a b", "A  b", "c"]) == pytest.approx(1 - 4 / 7)
    assert r.duplicate_share(["", " "]) == 0


SCHEMA = "song_id string, artist string, text_raw string, n_words int, host string, m string"


def run(spark, rows, **how):
    measures = r.document_measures(spark.createDataFrame(rows, SCHEMA), "song", "song_id", "text_raw", "artist")
    return {x.record_id: x for x in r.repetition(measures, **how).collect()}


def test_edge_rows(spark):
    spam = "la la la la la la la la"
    rows = [
        ("empty", None, "", 1, None, None), ("null", "x", None, 1, None, None), ("blank", "x", " \n\t", 1, "h", "m"),
        ("spam", "x", spam, None, None, None), ("spam", "x", spam, None, None, None), ("half", "x", "a b c d a b c d", 0, "", ""),
        ("long", None, "word " * 200_000, None, None, None), ("short", "x", "la la la la la la la", None, None, None),
    ]
    out = run(spark, rows)
    assert set(out) == {"empty", "null", "blank", "spam", "half", "long", "short"}
    assert out["spam"].fails_phrase and out["spam"].repeated_words == 7
    assert not out["half"].fails_phrase and out["half"].repeated_share == 0.5  # exactly half is not more
    assert out["long"].fails_phrase and not out["short"].fails_phrase
    assert out["null"].n_words == 0 and out["empty"].repeated_share == 0
    assert out["empty"].host == "(none)" and out["empty"].host_documents == 2


def test_host_rates_shrink_to_the_mean(spark):
    bad, good = "x y z w x y z w x y z w", "one two three four five six seven eight nine"
    rows = [(f"b{i}", "bad", bad, 0, "", "") for i in range(20)] + [(f"g{i}", f"h{i % 5}", good, 0, "", "") for i in range(50)] + [("lone", "lone", bad, 0, "", "")]
    out = run(spark, rows)
    assert out["b0"].host_verdict == "repetitive" and out["g0"].host_verdict == "ok"
    assert out["lone"].host_rate == 1 and out["lone"].host_shrunk_rate < out["b0"].host_shrunk_rate < 1


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_one_host_with_most_rows(spark):
    rows = [(f"s{i}", "same", "a b c d e f g h", 0, "", "") for i in range(300)] + [("o", "other", "a b c d e f g h", 0, "", "")]
    out = run(spark, rows)
    assert len(out) == 301 and out["s7"].host_documents == 300


def test_found_matches_sql(spark, tables):
    con = duckdb.connect()
    for t in ("songs", "chunks"):
        con.execute(f"create view {t} as select * from '{tables}/{t}.parquet'")
    want = set(con.execute(q.ORACLES["p1_found"]).fetchall())
    got = {(x.record_kind, x.record_id) for x in q.p1_found(spark, tables).collect()}
    assert got == want
