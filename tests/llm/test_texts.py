import random

import numpy as np
import pytest

from harrow.llm import leakage, markup, mixing, mojibake, spam


@pytest.fixture(scope="module")
def field():
    return markup.trained()


def test_field_on_held_out_pages(field):
    right = total = pages = found = 0
    for _, page, gold in markup.labelled_pages(300, 77):
        labels = field.decode(markup.features(page))
        right += sum(a == b for a, b in zip(labels, gold, strict=True))
        total += len(gold)
        pages += 1
        found += any(labels) == any(gold)
    assert right / total > 0.98 and found / pages > 0.98


def test_blocks_cover_the_page():
    for text, page, _ in markup.labelled_pages(100, 5):
        assert "".join(b.text for b in page) == text


CLEANED = {
    "<h3>Lamp</h3>Good <b>lamp</b>.<br/>Yes": "# Lamp\nGood lamp.\nYes", "A<ul><li>one</li><li>two</li></ul>": "A\n- one\n- two", "Salt &amp; pepper": "Salt & pepper",
    "See ![pic](http://a.b/c) it": "See pic it", "**good** and [this one](http://a.b/c).": "good and this one.", "It costs $\\frac{1}{2}$ each.": "It costs $\\frac{1}{2}$ each.",
    "Text.\n\n```\na = 1\nb = [2]\n```\n\nMore.": "Text.\n\n```\na = 1\nb = [2]\n```\n\nMore.", "Got it.\n\n| a | b |\n|---|---|\n| c | 3 |\n\nEnd.": "Got it.\n\na | b\n\nc | 3\n\nEnd.",
    "See <a href='x' title=\"y z\" hidden>it</a> now.": "See it now.", "One <font size=\"2\" in a room, >> all.": "One  in a room, >> all.",
    "It is \\textbf{fine} here.": "It is fine here.", "Good <div class=\"x-y and more": "Good\n and more",
}


@pytest.mark.parametrize("page", CLEANED)
def test_cleaning(field, page):
    roles, text = markup.clean(page, field)
    assert roles and text == CLEANED[page]


PLAIN = ["I <3 it", "x < y and a > b.", "R&D here", "5 * 4 inches", "It is {odd} here.", "my_photo_2 shows it", "[edit: still fine]", "100% (^_^)", "~2 weeks", "$5 or $60.", "Quality >> price.", "#1 pick", "a -- b", "", "plain"]


@pytest.mark.parametrize("page", PLAIN)
def test_typed_signs_are_no_markup(field, page):
    assert markup.clean(page, field) == ([], page)


def test_residue_operator(spark):
    texts = [*CLEANED, *PLAIN, None, "<b>" * 20_000, "[" * 50_000, "\\[" * 20_000, "a" * 200_000 + "<br>"]
    df = spark.createDataFrame([(i, t, "roles") for i, t in enumerate(texts)], "doc_id long, text string, roles string")
    found = {r.doc_id for r in markup.residue(df).collect()}
    assert set(range(len(CLEANED))) <= found and not found & set(range(len(CLEANED), len(CLEANED) + len(PLAIN) + 1)) and len(texts) - 1 in found
    assert markup.residue(df.limit(0)).count() == 0


ACCENTS = ["Crème brûlée à la carte", "Der Händler für größere Räume", "¡Qué niña pequeña!", "It’s “fine” — really…", "About €15 or £12, ½ cup at 4 °C", "Não gostei da embalagem, mãe", "Отличный чайник", "日本語の説明書", "★★★★☆"]
HARMLESS = [*ACCENTS, "Âmbar e SÃO JOÃO", "IRMÃ e mãe", "PÃO", "MAÇÃ seca", "Ελληνικά", "ЧАЙНИК", "│ box ─ │", "Brand® Model™ ©", "10×15 ±1 √2", "Rääume apóós", "L’école’é", "plain", "", "😀"]


@pytest.fixture(scope="module")
def repairer():
    return mojibake.Repairer(mojibake.train(ACCENTS))


@pytest.mark.parametrize("chain", [c for c in mojibake.CHAINS if c in (("cp1252",), ("latin-1",), ("cp1250",), ("cp1251",), ("mac_roman",), ("cp437",), ("cp1252", "cp1252"), ("latin-1", "cp1252"))], ids=">".join)
def test_garbled_text_is_restored(repairer, chain):
    for text in ACCENTS[:6]:
        found, restored, whole = repairer.repair(mojibake.garble(text, chain))
        assert found and whole and restored == text


def test_harmless_text_stays(repairer):
    for text in HARMLESS:
        assert repairer.repair(text) == ([], text, True)


def test_lost_characters_are_found(repairer):
    assert repairer.repair("caf� und mÃ¼de") == (["lost", repairer.repair("mÃ¼de")[0][0]], "caf� und müde", False)


def test_case_changes_after_garbling(repairer):
    assert repairer.repair("crã¨me")[1] == "crème" and repairer.repair("ã©tã©")[1] == "été"


def test_garbled_operator(spark):
    texts = [*HARMLESS, None, mojibake.garble(ACCENTS[0], ("cp1252",)), "x" * 100_000 + "Ã©", "Ã©" * 5000]
    df = spark.createDataFrame([(i, t, "a", False) for i, t in enumerate(texts)], "doc_id long, text string, chain string, complete boolean")
    found = {r.doc_id: r.restored for r in mojibake.garbled(df).collect()}
    base = len(HARMLESS)
    assert set(found) == {base + 1, base + 2, base + 3} and found[base + 1] == ACCENTS[0] and found[base + 3] == "é" * 5000
    assert mojibake.garbled(df.limit(0)).count() == 0


def test_near_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    own = rng.integers(0, 2**63, 300, dtype=np.uint64)
    others = own.copy()
    for i in range(300):
        for b in rng.choice(64, i % 6, replace=False):
            others[i] ^= np.uint64(1) << np.uint64(b)
    blocks = []
    for b in range(leakage.BLOCKS):
        part = leakage._block(own, b)
        order = np.argsort(part, kind="stable")
        blocks.append((order, np.searchsorted(part[order], np.arange((1 << leakage.BLOCK_BITS) + 1))))
    tables = leakage.ItemTables(None, own, np.arange(301), np.arange(300), blocks, [], [])
    left, right = tables.near(others)
    brute = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.bitwise_count(others[:, None] ^ own[None, :]) <= leakage.RADIUS), strict=True)}
    assert {(int(a), int(b)) for a, b in zip(left, right, strict=True)} == brute


def test_fingerprints_match_plain():
    words = "the cat sat on the mat and the dog ran off".split()
    hashes, codes = np.unique(leakage.word_hashes(words), return_inverse=True)
    for i, value in enumerate(leakage.fingerprints(codes, leakage.signs(hashes), 5)):
        total = [sum(1 if int(hashes[c]) >> (63 - b) & 1 else -1 for c in codes[i : i + 5]) for b in range(64)]
        assert int(value) == sum(1 << (63 - b) for b in range(64) if total[b] > 0)
    assert len(leakage.fingerprints(codes[:4], leakage.signs(hashes), 5)) == 0


def make_items(rng, count):
    vocabulary = [f"w{i}" for i in range(3000)]
    return [[rng.choice(vocabulary) for _ in range(rng.randint(66, 177))] + "which of these is the best answer to the question".split() for _ in range(count)]


def test_leaks_of_half_an_item_with_edits_are_found(spark):
    rng = random.Random(4)
    items = make_items(rng, 30)
    documents, wanted = [], set()
    for d in range(300):
        filler = [f"f{rng.randint(0, 400)}" for _ in range(rng.randint(50, 300))]
        if d % 3 == 0:
            i = rng.randrange(30)
            size = rng.randint(len(items[i]) // 2 + 1, len(items[i]))
            start = rng.randint(0, len(items[i]) - size)
            passage = items[i][start : start + size]
            for at in sorted(rng.sample(range(1, size - 1), rng.randint(0, size // 10)), reverse=True):
                passage[at : at + 1] = ["changed"] if rng.random() < 0.5 else []
            filler[20:20] = [w.upper() if rng.random() < 0.1 else w for w in passage]
            wanted.add((d, i))
        elif d % 3 == 1:  # a short quote and the shared question
            i = rng.randrange(30)
            filler[20:20] = items[i][: len(items[i]) // 4] + ["x"] + items[i][-10:]
        documents.append((d, ", ".join(filler), "clash"))
    items_df = spark.createDataFrame([(i, " ".join(w), "t") for i, w in enumerate(items)] + [(90, None, "t"), (91, "", "t"), (92, "?", "t")], "item_id long, text string, task string")
    documents += [(900, None, "c"), (901, "", "c"), (902, "f1 " * 30_000 + " ".join(items[0]) + " f2" * 30_000, "c")]
    df = spark.createDataFrame(documents, "doc_id long, text string, item_id string")
    found = {(r.doc_id, r.item_id): r for r in leakage.leaked(df, items_df).collect()}
    assert (902, 0) in found and found[902, 0].first_word == 30_000
    found.pop((902, 0))
    assert not set(found) - wanted and len(wanted - set(found)) <= 2
    in_groups = leakage.leaked(df, items_df, group_words=500).collect()
    assert {(r.doc_id, r.item_id) for r in in_groups} == set(found) | {(902, 0)}
    assert leakage.leaked(df.limit(0), items_df).count() == 0 and leakage.leaked(df, items_df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def pool(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["Big", " big", "BIG "]), "word " * rng.randint(1, 60)) for i in range(600)]
    rows += [(1000 + i, "small", "word " * rng.randint(20, 40)) for i in range(30)] + [(2000, None, "word " * 50), (2001, "small", None), (2002, "small", ""), (2003, "rest", "w " * 4000)]
    return spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, source string, text string, num_tokens int")


TARGETS = "source string, target_share double, max_repeats int"


def test_mix_reaches_its_targets(spark, pool):
    targets = spark.createDataFrame([("big", 0.5, 2), ("Small", 0.05, 3), ("none", 0.1, 5), ("rest", 0.9, 1), (None, 0.3, 3)], TARGETS)
    sampled, report = mixing.mix(pool, targets)
    rows = {r.source: r for r in report.collect()}
    assert {s for s, r in rows.items() if not r.reachable} == {"none", "rest"} and set(rows) == {"big", "small", "none", "rest"}
    for source in ("big", "small"):
        assert abs(rows[source].mixed_tokens / rows[source].wanted_tokens - 1) < 0.05
    assert rows["none"].mixed_tokens == 0 and rows["rest"].mixed_tokens == rows["rest"].available_tokens
    times = {r.doc_id: r.times for r in sampled.collect()}
    copies = {s: r.copies for s, r in rows.items()}
    assert all(t in (int(copies["big"]), int(copies["big"]) + 1) for d, t in times.items() if d < 1000) and max(times.values()) <= 3
    assert abs(sum(t for d, t in times.items() if d < 1000) - 600 * copies["big"]) < 1
    assert mixing.copies_of(sampled).count() == sum(times.values())
    assert times == {r.doc_id: r.times for r in mixing.mix(pool.repartition(3), targets)[0].collect()}


def test_mix_of_nothing(spark, pool):
    targets = spark.createDataFrame([("big", 0.5, 2)], TARGETS)
    sampled, report = mixing.mix(pool.limit(0), targets)
    assert sampled.count() == 0 and report.count() == 1
    assert mixing.mix(pool, targets.limit(0))[1].count() == 0


def test_token_counts_are_those_of_the_tokenizer(spark):
    df = spark.createDataFrame([(1, None, "Hello world, it's <|endoftext|> fine"), (2, "S ", None), (3, "s", "")], "doc_id long, source string, text string")
    found = {r.doc_id: (r.source, r.num_tokens) for r in mixing.token_counts(df).collect()}
    assert found[2] == ("s", 0) and found[3] == ("s", 0) and found[1][0] is None and 8 <= found[1][1] <= 16


PROSE = "The handle of this kettle is sturdy and it does not leak when we use it in the kitchen. My sister bought one after she saw ours, and she likes it too."


def page(rng, kind):
    things = ["kettle", "lamp", "tent", "drill", "sofa", "chair", "phone", "watch"]
    thing = rng.choice(things)
    prose = " ".join(f"We used the {rng.choice(things)} for {rng.randint(2, 9)} weeks and it was {rng.choice(['good', 'bad', 'fine'])} in the {rng.choice(['car', 'garden'])}." for _ in range(rng.randint(4, 9)))
    stuffed = " ".join(f"{rng.choice(['buy', 'cheap', 'best', 'online'])} {thing} {rng.choice(['sale', 'price', 'shop'])}" for _ in range(rng.randint(30, 60)))
    links = "\n".join(f"http://{rng.choice(things)}{rng.randint(1, 99)}.example/{rng.randint(1, 10**6)}" for _ in range(rng.randint(15, 30)))
    return {"prose": prose, "stuffed": stuffed, "links": links, "mixed": prose[:90] + ".\n" + stuffed, "list": prose + "\nSources:\n" + "\n".join(links.split("\n")[:2])}[kind]


def test_spam_pages(spark):
    rng = random.Random(8)
    kinds = ["prose", "stuffed", "links", "mixed", "list", "prose", "prose", "prose"]
    rows = [(i, page(rng, kinds[i % 8]), rng.choice([" A", "b", None]), "x") for i in range(400)] + [(900, None, "a", "x"), (901, "", None, "x"), (902, PROSE * 300, "a", "x"), (903, "buy " * 20_000, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, probability string")
    found = {r.doc_id: r.spam for r in spam.classify(df).collect()}
    assert len(found) == len(rows)
    wrong = [i for i in range(400) if found[i] != (kinds[i % 8] in ("stuffed", "links", "mixed"))]
    assert len(wrong) <= 4
    assert (found[900], found[901], found[902], found[903]) == (False, False, False, True)
    assert spam.classify(df.limit(0)).count() == 0
    one_class = {r.doc_id: r.spam for r in spam.classify(df.where("doc_id % 8 = 0 or doc_id > 899")).collect()}
    assert one_class[902] is False


def test_features_of_odd_pages():
    import pyarrow as pa

    found = spam.features(pa.array([None, "", "\n", PROSE, "http://a.b/c"]))
    assert set(found) == set(spam.COLUMNS) and all(len(v) == 5 and np.isfinite(v).all() for v in found.values())
    assert found["loose"].tolist()[:3] == [0.0, 0.0, 0.0] and found["loose"][3] < 0.2 and found["loose"][4] == 1.0
    alone = spam.features(pa.array([PROSE]))
    assert all(abs(found[f][3] - alone[f][0]) < 1e-12 for f in spam.FEATURES)
