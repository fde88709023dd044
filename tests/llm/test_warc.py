import gzip
import hashlib

import pytest

from stonefly.llm import warc

KIND = "page_id bigint, url string, html string, payload string, top int"


def root(tmp_path, name="w"):
    return f"file://{tmp_path}/{name}"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], KIND).repartition(3)


ROWS = [
    (1, "http://a/1", "é" * 600), (5, "http://a/5", "é" * 600), (3, "http://a/3 x\n", "é" * 600), (7, None, "short"), (8, "", "short"), (9, "u", None), (10, "u", ""), (None, "n", "é" * 600),
    (11, "big", "abc" * 400_000), (12, "x", "y" * 999), (13, "x", "y" * 999), (14, "x", "z" * 1000), (15, "x", "z" * 1000), (2**62, "far", "f"), (-(2**63), "low", "g"),
]


def expected(rows):
    groups = {}
    for i, _, h in rows:
        groups.setdefault(h or "", []).append(i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        known = [x for x in groups[h or ""] if x is not None]
        top = max(known) if len(b) >= 1000 and len(groups[h or ""]) > 1 and known else None
        revisit = top is not None and i != top
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


def files(tmp_path, name="w"):
    return {p.name: p.read_bytes() for p in (tmp_path / name).glob("generation-*/*.warc.gz")}


def test_round_trip(spark, tmp_path):
    at = root(tmp_path)
    m = warc.write(pages(spark, ROWS), at)
    got = warc.read(spark, at, with_payload=True)
    assert result(got) == expected(ROWS)
    texts = {i: (h or "").encode() for i, _, h in ROWS}
    for r in got.collect():
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == texts[r.page_id]
        assert r.url == {7: "urn:page:7", 8: "urn:page:8", 3: "http://a/3%20x%0A"}.get(r.page_id, next(u for i, u, _ in ROWS if i == r.page_id))
    stored = files(tmp_path)
    assert {r.name: (r.bytes, r.sha256) for r in m.collect()} == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in stored.items()}
    assert not list((tmp_path / "w").glob("generation-*/_temporary"))
    # any gzip reader can open them, and ids are unique
    heads = [x for b in stored.values() for x in gzip.decompress(b).split(b"\r\n") if x.startswith(b"WARC-Record-ID")]
    assert len(heads) == len(set(heads)) == len(ROWS) + len(stored)


def test_deterministic_shards_and_rolls(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SHARD_BYTES", (20_000, 20_000))
    rows = [(i * 3 if i < 300 else 10**12 + i, f"http://h/{i}", "".join(chr(97 + (i * j) % 26) for j in range(50 + i % 700))) for i in range(500)] + [(77_777, "same", f"{i} " * 200) for i in range(150)]
    a, b = root(tmp_path, "a"), root(tmp_path, "b")
    warc.write(pages(spark, rows), a, file_bytes=4000)
    warc.write(pages(spark, rows).repartition(11), b, file_bytes=4000)
    one, two = files(tmp_path, "a"), files(tmp_path, "b")
    assert one == two and len({n[:12] for n in one}) > 10 and any(n.endswith("-0001.warc.gz") for n in one)
    assert all(len(x) <= 4000 for x in one.values())
    assert result(warc.read(spark, a)) == expected(rows)
    # shards are ranges of ids but for one id larger than a shard
    spans = {}
    for r in warc.read(spark, a).filter("page_id <> 77777").collect():
        s = spans.setdefault(r.archive[:12], [r.page_id, r.page_id])
        s[0], s[1] = min(s[0], r.page_id), max(s[1], r.page_id)
    order = sorted(spans.values())
    assert all(x[1] < y[0] for x, y in zip(order, order[1:], strict=False))
    assert len({r.archive[:12] for r in warc.read(spark, a).filter("page_id = 77777").collect()}) > 1


def generation(spark, at):
    return warc.current(spark, at)["generation"]


def test_publishing_twice(spark, tmp_path):
    """A publishing task that runs again finds its files moved; one whose file is nowhere fails."""
    at = root(tmp_path)
    warc.write(pages(spark, ROWS), at)
    own = f"{at}/{generation(spark, at)}"
    again = spark.read.schema(warc.MANIFEST).parquet(f"{own}/_files")
    assert again.mapInArrow(warc._publisher(own), warc.MANIFEST).count() == again.count()
    next((tmp_path / "w").glob("generation-*/*.warc.gz")).unlink()
    with pytest.raises(Exception, match="neither under its temporary name"):
        again.mapInArrow(warc._publisher(own), warc.MANIFEST).count()


@pytest.mark.parametrize("step", ["_writer", "_publisher", "_totals", "remove", "publish"])
def test_a_write_that_stops_leaves_the_archive(spark, tmp_path, monkeypatch, step):
    at = root(tmp_path)
    warc.write(pages(spark, ROWS), at)
    stop = lambda *a: (_ for _ in ()).throw(OSError("stopped"))
    with monkeypatch.context() as m:
        m.setattr(warc, step, stop)
        with pytest.raises(OSError, match="stopped"):
            warc.write(pages(spark, ROWS[:5]), at)
    assert result(warc.read(spark, at)) == expected(ROWS)
    # a task that breaks in the middle of a shard
    with monkeypatch.context() as m:
        m.setattr(warc, "info_member", stop)
        with pytest.raises(Exception, match="stopped"):
            warc.write(pages(spark, ROWS[:5]), at)
    assert result(warc.read(spark, at)) == expected(ROWS)
    warc.write(pages(spark, ROWS[:5]), at)
    assert result(warc.read(spark, at)) == expected(ROWS[:5])
    warc.vacuum(spark, at)
    assert result(warc.read(spark, at)) == expected(ROWS[:5]) and len(list((tmp_path / "w").glob("generation-*"))) == 1


def test_only_the_manifest_counts(spark, tmp_path):
    at = root(tmp_path)
    warc.write(pages(spark, ROWS), at)
    (tmp_path / "w" / generation(spark, at) / "pages-999999-0000.warc.gz").write_bytes(b"left by a lost attempt")
    assert result(warc.read(spark, at)) == expected(ROWS)


def test_the_manifest_is_compared(spark, tmp_path):
    at = root(tmp_path)
    with pytest.raises(FileNotFoundError):
        warc.read(spark, at)
    warc.write(pages(spark, ROWS), at)
    one = next((tmp_path / "w").glob("generation-*/*.warc.gz"))
    whole = one.read_bytes()
    one.write_bytes(whole + warc.page_member(99, "u", b"more", None, False))
    with pytest.raises(Exception, match="not the file of the manifest"):
        warc.read(spark, at).collect()
    one.write_bytes(whole)
    part = next(p for p in (tmp_path / "w").glob("generation-*/_manifest/part-*") if p.stat().st_size)
    part.unlink()
    with pytest.raises(ValueError, match="not the one that was committed"):
        warc.read(spark, at)


def test_damage_is_seen():
    good = warc.page_member(1, "u", b"payload", None, False)
    assert len(list(warc.records(iter([good[:9], good[9:] + good])))) == 2
    with pytest.raises(ValueError, match="cut off"):
        list(warc.records(iter([good, good[:-12]])))


def test_ids():
    for x in (None, 0, 1, -1, 2**63 - 1, -(2**63), 987654321):
        assert warc.page_of(warc.record_id(x, b"\xff" * 20)) == x


def test_edges(spark, tmp_path):
    warc.write(pages(spark, ROWS).limit(0), root(tmp_path, "none"))
    assert warc.read(spark, root(tmp_path, "none")).collect() == []
    rows = [(None, None, "q" * 2000), (None, None, "q" * 2000), (4, "u", "r" * 2000), (4, "u", "r" * 2000), (2, "u", "r" * 2000)]
    warc.write(pages(spark, rows), root(tmp_path, "few"))
    assert [(r[0], r[3], r[4]) for r in result(warc.read(spark, root(tmp_path, "few")))] == sorted([(None, "response", None)] * 2 + [(4, "response", None)] * 2 + [(2, "revisit", 4)], key=repr)
