import random
import re
from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stonefly.llm import pii

P = pii.Pseudonyms("key")


def rewritten(text):
    b = text.encode()
    return pii.replace(b, pii.find(b, P)).decode()


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutes(n):
    q = pii.Permutation("a")
    out = [q("x", n, i) for i in range(n)]
    assert sorted(out) == list(range(n))
    if n >= 97:
        assert out != list(range(n)) and out != [pii.Permutation("b")("x", n, i) for i in range(n)] and out != [q("y", n, i) for i in range(n)]


def test_stays_valid():
    q, odd = pii.Permutation("a"), lambda x: x % 7 == 1
    own = [x for x in range(500) if odd(x)]
    assert sorted(q("x", 500, x, odd) for x in own) == own


FOUND = {
    "card": ["4111111111111111", "4111 1111 1111 1111", "3782-822463-10005", "6011000990139424"],
    "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"],
    "ssn": ["078-05-1120"],
    "phone": ["+1 (743) 555-3824", "(555) 123-4567", "212-555-0187", "+44 20 7946 0958", "+4915123456789", "+12125550187"],
    "ip": ["0.0.0.0", "10.23.45.255"],
    "date": ["2024-02-29", "2001/12/31", "25.12.1999", "12/25/1999", "3.4.2001", "1999-1-5"],
    "email": ["jo.smith+x9@mail.example.com", "A@b.io"],
}


@pytest.mark.parametrize("kind,value", [(k, v) for k, vs in FOUND.items() for v in vs])
def test_format_and_validity(kind, value):
    text = f"é {value}, and {value} é"
    found = pii.find(text.encode(), P)
    assert [f[2] for f in found] == [kind, kind]
    a, b = (f[3].decode() for f in found)
    assert a == b != value
    shape = lambda s: "".join("9" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c for c in s)
    if kind not in ("ip", "date"):
        assert shape(a) == shape(value)
    # what comes out is found again as the same kind
    assert [f[2] for f in pii.find(a.encode(), P)] == [kind]
    if kind == "card":
        assert pii.luhn_ok(pii._digits(a)) and a[0] == value[0]
    if kind == "iban":
        assert pii.iban_ok(a.replace(" ", "")) and a[:2] == value[:2]


LEFT = ["4111111111111112", "1111111111111111", "000-12-1234", "666-12-1234", "123-00-1234", "300.1.1.1", "1.2.3.4.5", "01.2.3.4", "2023-02-29", "2024-13-01", "1850-01-01", "32.12.1999", "DE89370400440532013001", "v1.2.3.4", "a@b", "token=41111111111111110", "d7c90f3602a3d0b907ff", "$1,234,567.89"]


@pytest.mark.parametrize("value", LEFT)
def test_invalid_stays(value):
    assert rewritten(f"x {value} y") == f"x {value} y"


def test_one_value_one_pseudonym():
    plain, spaced, dashed = (rewritten(v) for v in ("4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111"))
    assert plain == spaced.replace(" ", "") == dashed.replace("-", "")
    day = rewritten("2024-02-29")
    assert rewritten("2024/02/29") == day.replace("-", "/")
    other = pii.Pseudonyms("other key")
    assert other("card", b"4111111111111111") != P("card", b"4111111111111111")


def test_no_two_become_one():
    r = random.Random(1)
    cards = {(b := str(r.randrange(10**15)).zfill(15)) + pii.luhn_digit(b) for _ in range(3000)}
    assert len({P("card", c.encode()) for c in cards}) == len(cards)
    for show in ("{0:%Y-%m-%d}", "{0:%d/%m/%Y}", "{0.day}.{0.month}.{0.year}", "{0:%m/%d/%Y}"):
        days = [show.format(date.fromordinal(pii._DAYS[0] + k)) for k in range(0, 73049, 9)]
        new = [P("date", d.encode()) for d in days]
        assert None not in new and len(set(new)) == len(set(days))


@pytest.mark.parametrize("value", ["8.8.8.8", "1.1.1.1", "10.0.0.1", "1.2.3.45"])
def test_few_digits(value):
    """An address of few digits is replaced whether or not the text has other numbers."""
    new = rewritten(f"host {value} is up")
    assert value not in new and rewritten(f"host {value} is up 123456") == f"{new} 123456"


@pytest.mark.parametrize("end", [":8080", "/24", ":443/index", "/8:", ":", "/"])
def test_address_with_port_or_prefix(end):
    assert rewritten(f"at 192.168.10.20{end} now") == f"at {rewritten('192.168.10.20')}{end} now" != f"at 192.168.10.20{end} now"
    assert rewritten(f"http://10.0.0.1{end}") == f"http://{rewritten('10.0.0.1')}{end}"


def plain_find(b, p):
    """Every kind tried at every place, without any shortcut; e-mail addresses by walking back over single characters."""
    found = []
    for i in range(len(b)):
        for rank, (kind, pattern, _) in enumerate(pii._NUMERIC):
            m = pattern.match(b, i)
            ends = [m.end()] if m else []
            if m and kind == "iban":
                ends += [e for e in range(m.end() - 1, i, -1) if b[e : e + 1] == b" "]
            for e in ends:
                if (new := p(kind, b[i:e])) is not None:
                    found.append((i, -e, rank, kind, new))
                    break
        if b[i : i + 1] == b"@" and (right := pii._DOMAIN.match(b, i + 1)):
            s = i
            while s and chr(b[s - 1]) in "._%+-" or s and b[s - 1 : s].isalnum():
                s -= 1
            while s < i and not b[s : s + 1].isalnum():
                s += 1
            if s < i:
                found.append((s, -right.end(), len(pii.KINDS), "email", p("email", b[s : right.end()])))
    out, done = [], 0
    for start, end, _, kind, new in sorted(found):
        if start >= done:
            out.append((start, -end, kind, new))
            done = -end
    return out


PARTS = [
    "4111 1111 1111 1111", "4111111111111111", "1234", "12", " ", " ", " ", "-", ".", "/", ":", "+1 (743) 555-3824", "+49 30 123456", "123-45-6789", "8.8.8.8", "10.0.0.256", "2024-02-29", "31/12/1999", "2023.1.7",
    "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "CODE", "AB", "x", "é", "a.b-c@mail.example.com", "@", "q" * 70, "_", "user", "@b.org", "\n", "0", "(", ")",
]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_against_brute_force(text):
    p = pii.Pseudonyms("k")
    b = text.encode()
    assert pii.find(b, p) == plain_find(b, p)


def test_table_against_brute_force():
    import duckdb

    p = pii.Pseudonyms("k")
    texts = [t for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    finds = [pii.find(t.encode(), p) for t in texts]
    assert finds == [plain_find(t.encode(), p) for t in texts] and any(finds)


def test_nothing_hides():
    """A value stands where other digits or capitals run up to it, and a local part is taken as a whole however long."""
    assert "4111 1111 1111 1111" not in rewritten("order 1234 4111 1111 1111 1111 end")
    assert rewritten("GB82 WEST 1234 5698 7654 32 CODE") == rewritten("GB82 WEST 1234 5698 7654 32") + " CODE"
    for n in (63, 64, 65, 80, 400):
        a, b = "abcdefgh" * n, "abcdefgh" * n
        one = rewritten(f"mail {a[:n]}@b.org now")
        assert one == f"mail {rewritten(b[:n] + '@b.org')} now" and len(one) == n + 15
        new = one[5 : 5 + n]
        assert sum(x == y for x, y in zip(new, a, strict=False)) < n / 4


def test_adjacent():
    one = rewritten("4111111111111111")
    assert rewritten("4111111111111111 4111111111111111") == f"{one} {one}"
    assert rewritten("+1 (743) 555-3824 70.23.22.57") == f"{rewritten('+1 (743) 555-3824')} {rewritten('70.23.22.57')}"


def test_frames(spark):
    rows = [(1, "é card 4111111111111111.", "x", 1), (1, "é card 4111111111111111.", "x", 1), (None, "no data", None, 2), (3, None, "y", 3), (4, "", "z", 4), (5, "word " * 60_000 + "a@b.org", "w", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string, n_found int")
    got = pii.pseudonymise(docs, "key").collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].text == rewritten(rows[0][1]) and by[1].spans == "card:7:23" and by[1].n_found == 1
    assert by[None].text == "no data" and by[3].text is None and by[3].n_found == 0 and by[4].text == "" and by[4].spans == ""
    s, e = map(int, by[5].spans.split(":")[1:])
    assert rows[5][1][s:e] == "a@b.org" and by[5].text[s:e] != "a@b.org" and len(by[5].text) == len(rows[5][1])
    assert pii.pseudonymise(docs.limit(0), "key").collect() == []
    assert {r.text for r in pii.pseudonymise(docs, "other").collect() if r.doc_id == 1} != {by[1].text}


def test_table(spark):
    """Nothing that was found remains in its place, and all the rest does."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    n = 0
    for r in pii.pseudonymise(docs).collect():
        old, at, rest, kept = texts[r.doc_id], 0, r.text, []
        for span in filter(None, r.spans.split(",")):
            kind, s, e = span.split(":")
            kept.append(old[at : int(s)])
            at, n = int(e), n + 1
        kept.append(old[at:])
        for part in kept:
            found = rest.find(part)
            assert found >= 0
            rest = rest[found + len(part) :]
        if not r.n_found:
            assert r.text == old
    plain = [re.findall(r"(?<!\w)\d{16}(?!\w)|[a-z]+\.\d\d@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}|(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w.]\w)", t) for t in texts.values()]
    right = lambda d: sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d)) % 10 == 0
    assert n == sum(not v.isdigit() or right(v) for own in plain for v in own) > 50
