import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stonefly.llm import spans


def brute(rows, run=spans.RUN, least=spans.LEAST_WORDS):
    """rows: (id, text), ids unique. Texts after removal: every place of a span but the first loses its sentences."""
    places = {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        units = spans.sentences(b)
        words = [tuple(b[s:e].lower().split()) for s, e, _, _ in units]
        for p in range(len(units)):
            n = next((n for n in range(run, len(units) - p + 1) if sum(map(len, words[p : p + n])) >= least), None)
            if n:
                places.setdefault(tuple(words[p : p + n]), []).append((i, p, n))
    cover = {}
    for where in places.values():
        for i, p, n in sorted(where)[1:]:
            cover.setdefault(i, []).append({"pos": p, "len": n})
    return {i: None if t is None else spans._cut(t.encode(), cover.get(i, []))[0].decode() for i, t in rows}


def made(seed, n, shared=3):
    r = random.Random(seed)
    sentence = lambda: " ".join("".join(r.choice("abcdeé") for _ in range(4)) for _ in range(r.randint(1, 25))).capitalize() + r.choice([".", "!", "?", ".\n", "\n"])
    passages = [" ".join(sentence() for _ in range(6)) for _ in range(shared)]
    rows = []
    for i in range(n):
        parts = [sentence() for _ in range(r.randint(0, 10))]
        if r.random() < 0.5:
            parts.insert(r.randint(0, len(parts)), r.choice(passages) + "\n")
        rows.append((i, " ".join(parts)))
    return rows + [(n, rows[0][1]), (n + 1, rows[1][1].upper())]


def test_against_brute(spark):
    rows = made(1, 120)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    for batch in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = {r.doc_id: r for r in spans.remove_repeats(docs).collect()}
        assert {i: r.text for i, r in got.items()} == brute(rows)
    with pytest.MonkeyPatch.context() as m:  # too many keys to broadcast
        m.setattr(spans, "MOST_KEYS", 0)
        assert sorted(map(tuple, spans.remove_repeats(docs).collect())) == sorted(map(tuple, got.values()))
    assert sum(r.n_removed for r in got.values()) > 50
    for i, t in rows:
        at, rest = 0, []
        for x in filter(None, got[i].removed.split(",")):
            s, e = map(int, x.split(":"))
            rest.append(t[at:s])
            at = e
        assert "".join(rest) + t[at:] == got[i].text


def test_passage_of_fifty_words(spark):
    """Wherever sentences end in it, a passage of over 50 words stays in one document only; what is around it stays everywhere."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    shapes = [[52], [26, 26], [3] * 18, [40, 12], [1, 1, 50], [17, 17, 18]]
    passages = [" ".join(" ".join(word() for _ in range(n)) + "." for n in s) for s in shapes]
    rows, own = [], {}
    for k, p in enumerate(passages):
        for c in range(3):
            a, b = (" ".join(word() for _ in range(12)) + "." for _ in range(2))
            own[10 * k + c] = (a, b, p)
            rows.append((10 * k + c, f"{a}\n{p}\n{b}"))
    got = {x.doc_id: x.text for x in spans.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, (a, b, p) in own.items():
        assert a in got[i] and b in got[i]
        left = set(p.split()) & set(got[i].split())
        assert len(left) == len(set(p.split())) if i % 10 == 0 else len(left) <= 18


def test_edited_copy(spark):
    """A word more at the start of a long sentence shifts no more than the pieces next to it."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    long = [word() for _ in range(90)]
    rows = [(1, " ".join(long) + "."), (2, " ".join(["more", *long]) + "."), (3, " ".join(["quite", "other", "words", *long[20:], "here"]) + ".")]
    got = {x.doc_id: x.text for x in spans.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1] == rows[0][1]
    assert len(got[2].split()) < 35 and len(got[3].split()) < 35


def test_common_short_lines_stay(spark):
    rows = [(i, f"Licensed under the usual terms.\nNumber {i} of many things {i * 7919} here. End.") for i in range(50)]
    got = spans.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.text for r in got} == dict(rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["word", "é", "日本", ". ", "! ", "\n", " ", "?", '." ', "。", "\x0b", "\x1c"]), max_size=80).map("".join))
def test_cover(text):
    """Sentences tile the text up to blanks at its end, and cut nothing in two."""
    b = text.encode()
    units = spans.sentences(b)
    assert [u[0] for u in units[1:]] == [u[1] for u in units[:-1]]
    assert sum(u[2] for u in units) == len(b.split()) and all(0 < u[2] <= spans.PIECE for u in units)
    for s, e, _, _ in units:
        b[s:e].decode()
    if units:
        assert units[0][0] == 0 and not b[units[-1][1] :].strip()


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(40_000)) + "."
    same = " ".join(f"s{i}" for i in range(60)) + "."
    rows = [(1, same, "a", 1), (1, same, "a", 1), (2, same, None, 2), (None, same, "b", 3), (3, None, "c", 4), (4, "", "d", 5), (5, " \n", "e", 6), (6, long, "f", 7), (7, long, "g", 8), (7, "other words", "h", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, removed string, pos int")
    got = spans.remove_repeats(docs).collect()
    assert len(got) == len(rows)
    texts = sorted((r.doc_id or -1, r.text) for r in got if r.text is not None)
    # the row without an id is first; rows alike share their fate
    assert texts == sorted([(-1, same), (1, ""), (1, ""), (2, ""), (4, ""), (5, " \n"), (6, long), (7, ""), (7, "other words")])
    assert [r.text for r in got if r.doc_id == 3] == [None]
    assert spans.remove_repeats(docs.limit(0)).collect() == []
    alike = spark.createDataFrame([(1, same), (1, same)], "doc_id bigint, text string")
    assert [r.text for r in spans.remove_repeats(alike).collect()] == [same, same]
