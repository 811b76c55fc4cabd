"""Cases outside the given tables: markup and encodings of further kinds, other languages, changed re-deliveries."""

import re

import pytest

from harrow.llm import markup, mojibake


@pytest.fixture(scope="module")
def field():
    return markup.trained()


EMPHASIS = {
    "He said *really* good": "He said really good", "It was *so* soft and *really* warm.": "It was so soft and really warm.", "_Love_ this lamp": "Love this lamp",
    "*sigh* whatever": "sigh whatever", "a\n***\nb": "a\n\nb", "Title here\n=====\nText follows.": "# Title here\n\nText follows.",
    "Good\n{| class=\"wikitable\"\n|-\n! Name\n! Size\n|-\n| Lamp\n| 3\n|}\nEnd": "Good\n\nName | Size\nLamp | 3\nEnd", "<p>one<p>two <i>x</i></p>": "one\ntwo x",
    "<table><tr><td>a<td>b<tr><td>c<td>d</table>": "a | b\nc | d",
}


@pytest.mark.parametrize("page", EMPHASIS)
def test_emphasis_rules_and_tables(field, page):
    roles, text = markup.clean(page, field)
    assert roles and text == EMPHASIS[page]


@pytest.mark.parametrize("page", ["if a <b or b> a", "! important", "| maybe", "2 * 3 * 4", "{| odd", "I (*_*) it"])
def test_typed_signs_stay(field, page):
    assert markup.clean(page, field) == ([], page)


def test_cleaning_keeps_every_word_of_the_prose(field):
    lost = total = 0
    maker = markup.PageMaker(31)
    for _ in range(300):
        page, labels = maker.page()
        _, cleaned = markup.clean(page, field)
        for m in re.finditer(r"\w+", page):
            if labels[m.start()] not in ("MARK", "ENTITY") and not re.search(r"[\\/:&;={}\[\]|]", page[max(0, m.start() - 1) : m.end() + 1]):
                total += 1
                lost += m[0].strip("_") not in cleaned  # inline tags join words, as in a browser
    assert total > 3000 and lost / total < 0.002


def test_the_scan_drops_no_page_with_a_piece():
    for text, page, _ in markup.labelled_pages(400, 9):
        if any(b.kind != "prose" for b in page):
            assert re.search(markup.TRIGGER, text)
    for text in ("  ---", "\n ===", " 1) a", "\t- a", "$$1$$", "''a''", "! a", "a\n  ___"):
        assert not any(b.kind != "prose" for b in markup.blocks(text)) or re.search(markup.TRIGGER, text)


def test_long_pages_are_trained_on():
    pages = markup.labelled_pages(600, 11)
    assert markup.fit([(markup.features(page), gold) for _, page, gold in pages[:5]], rounds=2).emit.shape == (markup.BUCKETS, len(markup.LABELS))


def test_only_the_last_delivery_counts(spark, make_reviews):
    rows = [(1, "p", 1, 1, 5, "a <b>x</b>", 1), (1, "p", 1, 1, 5, "plain", 2), (2, "p", 1, 1, 5, "plain", 1), (2, "p", 1, 1, 5, "caf&eacute; <br> mÃ¼de", 2), (3, "p", 1, 1, 5, "<i>y</i>", 1), (3, "p", 1, 1, 5, "<i>y</i>", 1), (4, "p", 1, 1, 5, None, 3), (None, "p", 1, 1, 5, "<b>z</b>", 3)]
    df = make_reviews(rows)
    assert sorted((r.doc_id, r.cleaned) for r in markup.review_residue(df).collect()) == [(2, "café\n mÃ¼de"), (3, "y")]
    assert [(r.doc_id, r.complete) for r in mojibake.garbled_reviews(df).collect()] == [(2, True)]
    assert markup.review_residue(df.limit(0)).count() == 0 and mojibake.garbled_reviews(df.limit(0)).count() == 0


ACCENTS = ["Crème brûlée à la carte", "Der Händler für größere Räume", "¡Qué niña pequeña!", "It’s “fine” — really…", "Отличный чайник", "日本語の説明書"]


@pytest.fixture(scope="module")
def repairer():
    return mojibake.Repairer(mojibake.train(ACCENTS))


RESTORED = {
    "voilÃ  la": "voilà la", "voilÃ la": "voilà la", "Ã la carte": "à la carte", "20Â €": "20 €", "縺薙ｓ縺ｫ縺｡縺ｯ": "こんにちは", "縺薙ｓ縺ｫ": "こんに", "浣犲ソ": "你好", "cafﾃｩ": "café",
    "Ïðèâåò": "Привет", "Ïðèâåò ìèð": "Привет мир", "cafÈ trËs": "café très", "cafΘ trΦs": "café très",
}


@pytest.mark.parametrize("text", RESTORED)
def test_further_readings_are_undone(repairer, text):
    found, restored, whole = repairer.repair(text)
    assert found and whole and restored == RESTORED[text]


@pytest.mark.parametrize("text", ["donâ€t", "锟斤拷", "say â€ and go"])
def test_what_cannot_be_told_is_found_and_not_complete(repairer, text):
    found, restored, whole = repairer.repair(text)
    assert found and not whole and restored == text


@pytest.mark.parametrize("text", ["cafÈ", "don’t say it’s fine’s", "‚Äpfel‘", "日本語の説明書", "茅台酒很好", "中文说明书很好用。", "MANHÃ e", "AMANHÃ  BOA", "IRyÃ e mãe", "L’école’é", "éèàç test", "Brand™s and other™s", "한국어 설명서", "ｶﾀｶﾅ"])
def test_correct_text_of_these_kinds_stays(repairer, text):
    assert repairer.repair(text) == ([], text, True)


def test_passages_at_the_limit_of_edits_are_found(spark):
    from harrow.llm import leakage

    items = {n: [f"i{n}w{k}" for k in range(n)] for n in range(1, 201, 7)}
    documents, wanted = [], set()
    for n, words in items.items():
        for size in sorted({(n + 1) // 2, 3 * n // 4 or 1, n}):
            if 2 * size < n:
                continue
            for start in {0, n - size}:
                passage, edits = words[start : start + size], size // 10
                for e in range(edits):  # as far from each other as they can be
                    passage[(e + 1) * size // (edits + 1)] = "changed"
                documents.append((len(documents), " ".join([*(f"f{k}" for k in range(30)), *passage, "end"])))
                wanted.add((len(documents) - 1, n))
    items_df = spark.createDataFrame([(n, " ".join(w), 0) for n, w in items.items()], "item_id long, text string, share int")
    found = leakage.leaked(spark.createDataFrame(documents, "doc_id long, text string"), items_df).collect()
    assert {(r.doc_id, r.item_id) for r in found} == wanted


def test_wording_of_many_items_is_no_leak_and_hides_none(spark):
    from harrow.llm import leakage

    shared = [f"s{k}" for k in range(20)]
    items = {i: [*shared, *(f"i{i}w{k}" for k in range(60))] for i in range(60)}
    documents = [(0, " ".join(shared * 200), "x"), (1, " ".join([*shared, *items[7][20:], *shared]), "x"), (2, " ".join(items[9][10:60]), "x"), (3, " ".join(w for i in range(60) for w in items[i][:25]), "x")]
    df = spark.createDataFrame(documents, "doc_id long, text string, hashes string")
    items_df = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(7, " ".join(items[7]))], "item_id long, text string")
    for words in (400_000, 700):
        assert {(r.doc_id, r.item_id) for r in leakage.leaked(df, items_df, words).collect()} == {(1, 7), (2, 9)}


PROSE = {
    "nl": "Wij hebben deze ketel nu drie maanden in gebruik en zijn er heel tevreden over. Het water kookt snel, het handvat blijft koel en de deksel sluit goed. Het enige nadeel is dat het snoer wat kort is.",
    "pl": "Kupiłam ten czajnik dla mojej mamy i jest bardzo zadowolona. Woda gotuje się szybko, a uchwyt nie parzy. Jedyną wadą jest krótki przewód, ale da się z tym żyć.",
    "ru": "Купили этот чайник три месяца назад и очень довольны. Вода закипает быстро, ручка не нагревается, крышка закрывается плотно. Единственный недостаток это короткий шнур.",
    "zh": "这个水壶我们已经用了三个月,非常满意。水烧得很快,把手不烫,盖子也很严实。唯一的缺点是电线有点短,不过可以接受。推荐给大家。",
    "it": "Abbiamo comprato questo bollitore tre mesi fa e ne siamo molto contenti. L'acqua bolle in fretta, il manico resta freddo e il coperchio chiude bene. Lo ricomprerei subito.",
    "sv": "Vi har använt den här vattenkokaren i tre månader och är mycket nöjda. Vattnet kokar snabbt, handtaget blir inte varmt och locket sluter tätt. Sladden är kort, men det går att leva med.",
    "tr": "Bu su ısıtıcısını üç aydır kullanıyoruz ve çok memnunuz. Su çabuk kaynıyor, sapı ısınmıyor ve kapağı iyi kapanıyor. Tek kusuru kablosunun biraz kısa olması.",
    "ja": "このケトルを三か月使っていますが、とても満足しています。お湯がすぐに沸き、取っ手も熱くなりません。ふたもしっかり閉まります。",
    "ar": "اشترينا هذه الغلاية قبل ثلاثة أشهر ونحن راضون عنها جدا. الماء يغلي بسرعة والمقبض يبقى باردا والغطاء محكم. العيب الوحيد هو أن السلك قصير قليلا.",
}


@pytest.mark.parametrize("labelled", [True, False])
def test_prose_of_languages_without_a_model_is_no_spam(spark, labelled):
    import random

    from harrow.llm import spam

    rng = random.Random(3)
    things, places = ["kettle", "lamp", "tent", "drill", "sofa", "chair", "phone", "watch"], ["kitchen", "garden", "office", "car", "attic"]
    said = ["We have used the {a} for a year and it still works in the {p}.", "My sister bought a {a} after she had seen ours.", "It is not as good as the {b} that we had before.", "The lid of the {a} is loose, but I can live with that.", "If you want a {a} for the {p}, this is the one to buy.", "They sent a new {b} when I told them about it."]
    rows = []
    for i in range(300):
        sentences = [rng.choice(said).format(a=rng.choice(things), b=rng.choice(things), p=rng.choice(places)) for _ in range(rng.randint(4, 9))]
        stuffed = " ".join(f"{rng.choice(['cheap', 'best', 'sale', 'price', 'online'])} {things[i % 8]}" for _ in range(40))
        rows.append((i, stuffed if i % 10 == 0 else " ".join(sentences), "en", rng.choice(["a", "b"])))
    rows += [(1000 + i, text, lang if i % 2 else None, "a") for i, (lang, text) in enumerate(PROSE.items())]
    rows += [(3000, "\n".join(f"kettle repair in {x}ford" for x in ("Ulm", "Ost", "Bel", "Kar", "Lin", "Mor", "Nab", "Pol")), "en", "a")]
    rows += [(2000, "goedkope ketel kopen goedkope ketel online goedkope ketel aanbieding beste ketel prijs ketel kopen online ketel korting goedkope ketel winkel ketel kopen", "nl", None), (2001, None, None, None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, source string, known int, label int")
    found = {r.doc_id: r.spam for r in spam.classify(df if labelled else df.drop("lang")).collect()}
    assert [d for d in found if found[d] != (d % 10 == 0 and d < 1000 or d in (2000, 3000))] == []
