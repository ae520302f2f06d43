import itertools
import random

import numpy as np
import pytest

from quillspark.llm import near_duplicates as n
from quillspark.llm import queries

HOW = n.Similarity(run=3, threshold=0.5, min_words=10, rows=5, bands=240, size=512)
SONGS = "song_id string, text_raw string, a string, rep string, id string, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", "k") for i, t in rows], SONGS)


def run(spark, rows, how=HOW):
    members, links = n.similar_classes(frame(spark, rows), "song_id", "text_raw", how)
    return members, links


def jaccard(a, b, k=3):
    x, y = (set(zip(*(n.text_words(t)[i:] for i in range(k)))) for t in (a, b))
    return len(x & y) / len(x | y)


def corpus(seed=0, n_base=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n_base):
        base = rng.choices(vocabulary, k=rng.randint(10, 120))
        rows.append((f"{i:03d}a", " ".join(base)))
        for j, share in enumerate((0.02, 0.08, 0.15, 0.3)):
            edited = [w if rng.random() > share else rng.choice(vocabulary) for w in base]
            rows.append((f"{i:03d}{'bcde'[j]}", " ".join(edited)))
        moved = base[len(base) // 2 :] + base[: len(base) // 2]
        rows.append((f"{i:03d}f", "[Verse]\n" + " ".join(moved).upper()))
    return rows


def test_all_pairs_and_no_others(spark):
    rows = corpus()
    want = {(a, b) for (a, s), (b, t) in itertools.combinations(rows, 2) if jaccard(s, t) >= 0.5}
    members, links = run(spark, rows)
    got = {tuple(x) for x in n.expand_pairs(members, links).collect()}
    assert len(want) > 60 and got == want


def test_copies_are_one_class(spark):
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(f"c{i:03d}", text if i % 2 else "[Intro] " + text.title()) for i in range(60)] + [("near", text + " and one more line"), ("far", " ".join(f"u{i}" for i in range(30)))]
    members, links = run(spark, rows)
    assert {x.rep for x in members.collect()} == {"c000", "near", "far"}
    assert [(x.a, x.b) for x in links.collect()] == [("c000", "near")]
    groups = {x.record_id: x for x in n.groups(members, links).collect()}
    assert groups["c059"].group_id == groups["near"].group_id == "c000" and groups["far"].group_id == "far"
    assert groups["c059"].n_links == 1 and groups["far"].n_links == 0
    assert n.expand_pairs(members, links).count() == 60 * 59 // 2 + 60


def test_chain_of_links_is_one_group(spark):
    words = [f"k{i}" for i in range(400)]
    rows = [(f"{i:02d}", " ".join(words[i * 8 : i * 8 + 60])) for i in range(30)]
    members, links = run(spark, rows)
    assert {x.group_id for x in n.groups(members, links).collect()} == {"00"}


def test_edge_rows(spark):
    ten = "a b c d e f g h i j"
    rows = [("null", None), ("empty", ""), ("tag", "[Verse]"), ("nine", "a b c d e f g h i"), ("x", ten), ("y", ten + "!"), ("y", ten + "!"), (None, ten), ("same", "la " * 50)]
    members, links = run(spark, rows)
    assert {x.record_id for x in members.collect()} == {"x", "y", "same"}
    assert {tuple(p) for p in n.expand_pairs(members, links).collect()} == {("x", "y")}


def test_groups_have_every_record(spark, tables):
    ten = "a b c d e f g h i j"
    rows = [("null", None), ("empty", ""), ("tag", "[Verse]"), ("nine", "a b c d e f g h i"), ("x", ten), ("y", ten + "!"), ("y", ten + "!"), (None, ten)]
    members, links = run(spark, rows)
    out = n.groups(n.with_all_records(members, frame(spark, rows), "song_id"), links).collect()
    alone = [(i, i, i, 0) for i in ("empty", "nine", "null", "tag")]
    assert sorted(tuple(x) for x in out) == [*alone, ("x", "x", "x", 0), ("y", "x", "x", 0)]
    ids = spark.read.parquet(f"{tables}/songs.parquet").select("song_id").where("song_id is not null").distinct()
    grouped = queries.p5_groups(spark, tables)
    assert grouped.count() == grouped.join(ids, "song_id").count() == ids.count()


def test_empty_table(spark):
    members, links = run(spark, [])
    assert n.expand_pairs(members, links).count() == n.groups(members, links).count() == 0


def test_longest_of_several_texts_counts(spark):
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(30))
    members, links = run(spark, [("s", a), ("s", b), ("t", b + " x"), ("u", a)])
    assert {tuple(p) for p in n.expand_pairs(members, links).collect()} == {("s", "t")}


def test_very_long_text(spark):
    text = " ".join(str(i) for i in range(60_000))
    members, links = run(spark, [("a", text), ("b", text + " more")])
    assert links.count() == 1


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    universe = rng.integers(0, 2**63, 600, dtype=np.uint64)
    sets = [np.sort(universe[:300]), np.sort(universe[100:400]), universe[:1], universe[:3]]
    sk = n.sketches(np.concatenate(sets), np.array([len(s) for s in sets]), 1020)
    assert (sk != 0).all()
    assert (sk[0] == sk[1]).mean() == pytest.approx(0.5, abs=0.07)
    assert len(set(sk[2])) > 1  # one element fills all places, with another value in each round
    one = n.sketches(sets[0], np.array([300]), 1020)
    assert (one[0] == sk[0]).all()  # what else is in the batch does not matter


def test_run_hashes_stay_within_a_text():
    texts = [list("abcab"), ["a"], [], list("abc")]
    h, counts = n.run_hashes(texts, 3)
    assert counts.tolist() == [3, 0, 0, 1] and len(h) == 4
    assert h[0] == h[3] == n.runs(list("abc"), 3)[0] and len(set(h.tolist())) == 3
    assert len(n.run_hashes([], 3)[0]) == len(n.run_hashes([["a"]], 3)[0]) == 0


def test_all_of_a_key_meet():
    rng = np.random.default_rng(2)
    keys, ids = rng.integers(0, 40, 300, dtype=np.uint32), np.arange(300) * 7
    want = {(a, b) for (a, k), (b, m) in itertools.combinations(zip(ids.tolist(), keys.tolist()), 2) if k == m}
    got = [tuple(sorted(p)) for a, b in n.meeting(keys, ids) for p in zip(a.tolist(), b.tolist())]
    assert len(got) == len(want) and set(got) == want


def test_layout_uses_each_coordinate_once_a_shuffle():
    layout = HOW.layout()
    assert layout.shape == (240, 5) and all(len(set(b)) == 5 for b in layout.tolist())
    assert np.bincount(layout.ravel(), minlength=512).max() <= 3


def test_default_is_five_words_at_eight_tenths():
    assert (n.Similarity().run, n.Similarity().threshold) == (5, 0.8)
    assert 1 - (1 - 0.8**8) ** 64 > 0.99999
