"""Passages and garbled sequences that a narrower search would miss."""

import random

import numpy as np
import pytest

import __spark_entry__ as entry
from harrow.llm import leakage, mojibake


def hashed(words):
    return leakage.word_hashes([str(w) for w in words])


def test_an_intact_half_beside_edited_rest_is_held():
    item = list(range(100))
    edited = [w if (w - 60) % 3 else f"x{w}" for w in range(60, 100)]
    document = ["f"] * 30 + item[:60] + edited + ["f"] * 30
    share, first, last = leakage.holds(hashed(item), hashed(document))
    assert share >= 0.6 and first == 30 and last >= 90


def test_an_intact_half_after_an_edited_copy_is_held():
    item = list(range(100))
    copy = [w if w % 5 else f"x{w}" for w in item]
    share, first, _ = leakage.holds(hashed(item), hashed([*copy, *["f"] * 50, *item[20:75]]))
    assert share >= 0.55 and first >= 140


def test_close_spans_are_those_of_all_alignments():
    rng = random.Random(3)
    for _ in range(80):
        item = [rng.randint(0, 9) for _ in range(rng.randint(1, 22))]
        document = [w for w in item for w in ([w] if rng.random() < 0.9 else [rng.randint(0, 9)] * rng.randint(0, 2))]
        best = 0
        for a in range(len(item)):
            for p in [p for p, d in enumerate(document) if d == item[a]]:
                row = list(range(len(document) - p))
                for b in range(a + 1, len(item) + 1):
                    # row: edits from item[a + 1 : b - 1] to so many words after document[p]
                    edits = min([0] if b == a + 1 else [e for e, d in zip(row, document[p + 1 :], strict=False) if d == item[b - 1]], default=99)
                    if 2 * (b - a) >= len(item) - 2 * (len(item) >= 19) and 10 * edits <= b - a:
                        best = max(best, b - a)
                    if b > a + 1:
                        new = [row[0] + 1]
                        for j, d in enumerate(document[p + 1 :]):
                            new.append(min(row[j] + (d != item[b - 1]), row[j + 1] + 1, new[-1] + 1))
                        row = new
        found = leakage.close_span(np.array(item), np.array(document, dtype=int))
        assert round((found[0] if found else 0) * len(item)) == best


CLEAN = ["Crème brûlée à la carte", "Der Händler für größere Räume", "¡Qué niña pequeña!", "It’s “fine” — really…", "Отличный чайник", "日本語の説明書", "★★★★☆"]
UNRESTORED = ["\ufeffGood", "a\u200bb", "of\ufb01ce", "a \u05d0 b", "a \u0627 b", "a \u0e01 b", "cafe\u0301 x", "man\u0303ana", "u\u0308ber", "s\u030carm"]
HARMLESS = ["LUNEDÌ”", "COSÌ…", "CAFÉ’S", "CAFÉ™", "«раз»", "рекомендую…", "чайник, Отличный", "FÜR…", "L’ÉTÉ", "日本É語", *UNRESTORED, "日本é語"]


@pytest.fixture(scope="module")
def repairer():
    return mojibake.Repairer(mojibake.train(CLEAN))


@pytest.mark.parametrize("codec", ["cp1252", "latin-1"])
@pytest.mark.parametrize("text", UNRESTORED, ids=ascii)
def test_garbled_signs_are_found_even_if_not_restored(repairer, text, codec):
    assert repairer.repair(mojibake.garble(text, (codec,)))[0]


def test_a_garbled_accent_among_other_scripts_is_restored(repairer):
    assert repairer.repair("日本" + mojibake.garble("é", ("cp1252",)) + "語")[1:] == ("日本é語", True)


@pytest.mark.parametrize("text", HARMLESS, ids=ascii)
def test_correct_text_is_not_found(repairer, text):
    assert repairer.repair(text) == ([], text, True)


def test_passages_of_short_items_are_found(spark):
    rng = random.Random(8)
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 19, 20, 25, 38, 40, 60)}
    documents, wanted = [], set()
    for n, words in items.items():
        for size in range((n + 1) // 2, n + 1):
            passage, edits = words[:size], size // 10
            for e in range(edits):
                passage[(e + 1) * size // (edits + 1)] = "changed"
            documents.append((len(documents), " ".join([*(f"f{rng.randint(0, 400)}" for _ in range(50)), *passage, "end"])))
            wanted.add((len(documents) - 1, n))
        if n > 2:
            documents.append((len(documents), " ".join(["f", *words[: (n - 1) // 2 - (n > 8)], "end"])))
    items_df = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    found = leakage.leaked(spark.createDataFrame(documents, "doc_id long, text string"), items_df).collect()
    assert {(r.doc_id, r.item_id) for r in found} == wanted


def test_widths_are_those_of_the_shortest_kept_run():
    assert [leakage.window_width([n]) for n in (1, 4, 8, 38)] == [1, 2, 4, 6] and leakage.window_width(list(range(66, 178))) == 8


def test_rare_runs_are_marked_and_not_left_out(spark, make_reviews, tmp_path):
    texts = ["a b a b", "a b", "b a", "c", None, "a b c"]
    make_reviews([(d, "p", 1, 1, 5, t) for d, t in enumerate(texts)]).write.parquet(f"{tmp_path}/reviews.parquet")
    docs = [t.split() for t in texts if t is not None]
    runs = [(d, " ".join(w[i : i + n]), n) for d, w in enumerate(docs) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    wanted = set()
    for gram, n in {(g, n) for _, g, n in runs}:
        df, cf = len({d for d, g, _ in runs if g == gram}), sum(g == gram for _, g, _ in runs)
        wanted.add((gram, n, df, cf, "rare" if df < 3 else "common" if df > 0.2 * len(docs) else None))
    assert {tuple(r) for r in entry.queries()["p1_ngrams"](spark, str(tmp_path)).collect()} == wanted
