import csv
import io

import pytest
from hypothesis import given
from hypothesis import strategies as st

from harrow.sources import records

CASES = {
    'B1,1/2,5,"ok, ""yes""\nline"': None, "B1,1/2,4.5,": None, '"B1", 1/2 ," 3",text': None, "B1,0/0,1,a": None, 'B1,1/2,5,a "b" c': "quoting", 'B1,1/2,5,"open': "quoting",
    '"B1"x,1/2,5,a': "quoting", ' "B1",1/2,5,a': "quoting", '"B1" ,1/2,5,a': "quoting", '"a",b"': "quoting", "B1,1/2,5": "columns", "": "columns", "B1,1/2,5,a,": "columns", "B1|1/2|5|a": "columns",
    "B1,3/2,5,a": "helpfulness", "B1,1 / 2,5,a": "helpfulness", "B1,1/2/3,5,a": "helpfulness", "B1,-1/2,9,a": "helpfulness", "B1,,5,a": "helpfulness", "B1,1/2,5.1,a": "score",
    "B1,1/2,0.9,a": "score", "B1,1/2,4.,a": "score", "B1,1/2,NaN,a": "score", "B1,1/2,+4,a": "score", "B1,1/2,,a": "score", "B1,٣/٤,5,a": "helpfulness",
    "B1," + "9" * 60 + "/" + "9" * 61 + ",5,a": None, "B1," + "9" * 61 + "/" + "9" * 60 + ",5,a": "helpfulness", 'x"' + "y" * 100_000: "quoting",
}


@pytest.mark.parametrize("raw", CASES, ids=range(len(CASES)))
def test_reasons(raw):
    assert records.parse_row(raw).reason == CASES[raw]


def test_null_row():
    assert records.parse_row(None).reason == "columns"


@given(st.lists(st.text('ab,"\n x', max_size=8), min_size=1, max_size=6))
def test_quoted_fields_round_trip(fields):
    out = io.StringIO()
    csv.writer(out, lineterminator="", quoting=csv.QUOTE_ALL).writerow(fields)
    parser = records.RecordParser(out.getvalue(), single=True)
    found, end = parser.record(0)
    assert [v for v, _ in found] == fields and end == len(out.getvalue())


def test_recovery_at_the_next_valid_record():
    text = 'B1,1/2,5,fine\nB2,1/2,5,"never closed\nB3,1/2,4,also fine\nB4,2/1,3,x\r\n"B5",1/1,2,"two\nlines"\nB6,1/1,3,bad "quote\nplain line\nB7,1/1,1,end\n'
    found = [(text[r.start : r.start + 3].strip('"')[:2], r.reason) for r in records.RecordParser(text).file()]
    assert found == [("B1", None), ("B2", "quoting"), ("B3", None), ("B4", "helpfulness"), ("B5", None), ("B6", "quoting"), ("B7", None)]
    assert list(records.RecordParser("").file()) == []


def test_operator(spark):
    rows = [(i, raw, "x") for i, raw in enumerate([*CASES, None])]
    df = spark.createDataFrame(rows, "rec_id long, raw string, reason string")
    loaded, failed = records.valid_and_failed(df)
    assert {r.rec_id: r.reason for r in failed.collect()} == {i: r for i, r in enumerate([*CASES.values(), "columns"]) if r}
    ok = {r.rec_id: r for r in loaded.collect()}
    assert tuple(ok[0].asDict()[c] for c in ("product_id", "helpfulness_num", "helpfulness_den", "score", "text")) == ("B1", 1, 2, 5.0, 'ok, "yes"\nline') and ok[1].text == "" and ok[2].score == 3.0
    long = next(r for r in ok.values() if r.helpfulness_num is None)
    assert long.helpfulness == "9" * 60 + "/" + "9" * 61 and ok[0].helpfulness == "1/2"
    assert records.parse_rows(df.limit(0)).count() == 0
    assert len(ok) + failed.count() == len(rows)


def test_whole_files(spark):
    df = spark.createDataFrame([("f1", 'a,1/2,3,x\nb,1/2,3,"y\nc,1/2,3,z'), ("f2", ""), ("f3", None)], "path string, content string")
    assert sorted((r.path, r.rec_id, r.reason) for r in records.parse_files(df).collect()) == [("f1", 0, None), ("f1", 10, "quoting"), ("f1", 21, None)]


def test_a_wrong_value_after_a_broken_quote_is_told():
    text = 'a,1/2,3,"open\nb,9/2,3,x\nc,1/2,7,y\nd,1/2,3,z\n'
    assert [(r.start, r.reason) for r in records.RecordParser(text).file()] == [(0, "quoting"), (14, "helpfulness"), (24, "score"), (34, None)]


def test_rows_end_their_quotes():
    found = list(records.parse_known(['a,1/2,3,"open', 'b,1/2,4,"', None, 'c,1/2,3,"x\ny"', "", 'd,1/2,3,k"']))
    assert [(r.reason, r.start, r.position) for r in found] == [("quoting", 0, 8), ("quoting", 0, 8), ("columns", 0, 0), (None, 0, None), ("columns", 0, 0), ("quoting", 0, 9)]


def test_scores_are_compared_exactly():
    assert records.parse_row("a,1/2,5.000000000000000000001,x").reason == "score" and records.parse_row("a,1/2,4.9999999999999999999,x").reason is None


def test_exports_in_pieces_are_those_of_whole_files(spark):
    rows = [(i, "f" if i % 3 else "g", raw) for i, raw in enumerate([*CASES] * 3) if "\n" not in raw and len(raw) < 1000]
    df = spark.createDataFrame(rows, "rec_id long, src_file string, raw string")
    small = records.parse_exports(df, 1)  # every record its own piece
    assert sum(r.reason is None for r in small.collect()) == sum(CASES[raw] is None for _, _, raw in rows)
    whole = {f: "\n".join(raw for _, g, raw in rows if g == f) + "\n" for f in "fg"}
    wanted = sorted((f, r.start, r.reason, r.position) for f, text in whole.items() for r in records.RecordParser(text).file())
    assert sorted((r.src_file, r.start, r.reason, r.position) for r in records.parse_exports(df).collect()) == wanted
    assert records.parse_exports(df.limit(0)).count() == 0


def test_large_files_are_read_in_pieces(spark, tmp_path):
    import random

    rng = random.Random(5)
    kinds = ["p{i},1/2,3,plain {i}", 'p{i},1/2,3,"two, ""x""\nlines {i}"', "p{i},3/2,3,x", 'p{i},1/2,"4,never closed', "p{i},1/2,9,x", "only, three,{i}", "p{i},1/2,3,caf\u00e9"]
    whole = {}
    for name in "ab":
        picked = [rng.choice(kinds[:2] * 4 + kinds).format(i=i) for i in range(400)]
        whole[name] = "\n".join(picked) + "\n"
        (tmp_path / f"{name}.csv").write_text(whole[name])
    (tmp_path / "c.csv").write_text("")
    wanted = sorted((n, r.start, r.reason, r.position, r.text) for n, text in whole.items() for r in records.RecordParser(text).file())
    read = lambda piece: sorted((r.path[-5], r.start, r.reason, r.position, r.text) for r in records.parse_export_files(spark, str(tmp_path), piece).collect())
    assert read(1_000_000) == wanted
    for piece in (2_000, 150):  # a broken quote ends with its piece, which can only save records
        found = read(piece)
        assert {r for r in wanted if r[2] is None} <= set(found) and len(found) >= len(wanted)
        assert all(whole[n][at - 1 : at] in ("", "\n") for n, at, *_ in found)


def brute_reason(raw):
    """The same rules read character by character."""
    import re

    fields, value, state = [], "", "start"
    for c in raw:
        if state == "start":
            if c == '"':
                state = "quoted"
            elif c == ",":
                fields.append("")
            else:
                value, state = c, "plain"
        elif state == "plain":
            if c == '"':
                return "quoting"
            if c == ",":
                fields.append(value)
                value, state = "", "start"
            else:
                value += c
        elif state == "quoted":
            if c == '"':
                state = "closed"
            else:
                value += c
        elif c == '"':
            value, state = value + c, "quoted"
        elif c == ",":
            fields.append(value)
            value, state = "", "start"
        else:
            return "quoting"
    if state == "quoted":
        return "quoting"
    fields.append(value)
    if len(fields) != 4:
        return "columns"
    a, _, b = fields[1].strip().partition("/")
    if not (re.fullmatch("[0-9]+", a) and re.fullmatch("[0-9]+", b) and int(a) <= int(b)):
        return "helpfulness"
    number = fields[2].strip()
    if not re.fullmatch(r"[0-9]+(\.[0-9]+)?", number) or not 1 <= float(number) <= 5:
        return "score"
    return None


FIELD = st.one_of(st.text('ab" \n', max_size=4), st.sampled_from(["1/2", " 2/1 ", "3", '"4.5"', " 5 ", "6", '"x,y"', '"a""b"', "0/0", '"1/9"']))


@given(st.lists(FIELD, min_size=2, max_size=6).map(",".join))
def test_rows_match_brute_force(raw):
    assert records.parse_row(raw).reason == brute_reason(raw)


@given(st.text('1/2,".5 \n', max_size=14))
def test_random_rows_match_brute_force(raw):
    assert records.parse_row(raw).reason == brute_reason(raw)
