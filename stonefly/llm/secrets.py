"""Secret scan: fixed patterns, and zstandard novelty of strings in sensitive context.

A candidate is a long run of secret-like characters that follows a sensitive
word. Its novelty is what it adds to a zstandard frame primed with a dictionary
of identifiers, fixed ones and the words that most documents of the corpus hold,
and the text around it without its own copies: a name known from code, made of
the corpus's words or of those nearby compresses away, a key does not, however
often it is written.

All work is on UTF-8 bytes, where every pattern is ASCII; only the spans found
are turned into code points.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stonefly.llm.common import Scratch, map_batches, slices

#: In the order in which kinds sort at equal starts.
KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_WORDS = (b"password", b"passwd", b"secret", b"token", b"api")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = bytes(104 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_HEX_RUN = b"h" * 24
#: Words that make what follows them a candidate.
SENSITIVE = (b"password", b"passwd", b"secret", b"token", b"credential", b"bearer", b"authorization", b"signature") + tuple(
    a + by + z for a, z in ((b"private", b"key"), (b"access", b"key"), (b"api", b"key"), (b"client", b"id")) for by in (b"_", b"-", b" ", b"")
)
LEAST = 16
_CANDIDATE = re.compile(rb"[A-Za-z0-9+/_.=~-]{%d,}" % LEAST)
#: Key material goes on where the next line holds nothing else before it.
_NEXT = re.compile(rb"[ \t]*\r?\n[ \t]*(?=[A-Za-z0-9+/_.=~-]{%d})" % LEAST)
#: Bytes after the end of a sensitive word in which a candidate may start, and the text on either side that primes the frame.
REACH, AROUND = 48, 1024
#: Marginal compressed bytes over the candidate's length from which on it is reported: a short one that nothing matches
#: is stored as it is (1.0); from ``LONG`` bytes on literals are Huffman-coded, which saves what the alphabet allows. So
#: there a candidate in an encoding of fewer than six bits a sign is reported from as much less on (digits and lower-case
#: hex are found by pattern).
NOVELTY, NOVELTY_LONG, LONG = 0.85, 0.7, 64
_ENCODINGS = ((re.compile(rb"[0-9A-F]+"), 4), (re.compile(rb"[A-Z2-7]+=*"), 5))
IDENTIFIERS = b" ".join(b"""self this return import from class function const let var public private static void string int float bool true false null none
example sample placeholder changeme your_api_key your-token-here insert_token_here password secret token api_key apikey access_key client_secret client_id
authorization bearer authentication credentials username user_name user_id session_id request response config configuration settings environment os.environ getenv
process.env localhost 127.0.0.1 http:// https:// www. .com .org .net /api/v1/ /oauth/token application/json content-type utf-8 base64 sha256 md5 hmac encode decode
get set put post delete update create insert select where value values key keys name names path file open read write close abcdefghijklmnopqrstuvwxyz
ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 1111111111111111 xxxxxxxxxxxxxxxx XXXXXXXXXXXXXXXX 1234567890 0123456789abcdef deadbeef""".split())


#: Words of the corpus in the dictionary at most. They are whole runs of letters, too short for a key and beside no digit, so
#: however many documents hold a key, only such runs between its signs can get in.
WORDS = 4096
_WORD = re.compile(rb"(?<![A-Za-z0-9])[A-Za-z]{4,15}(?![A-Za-z0-9])")


def dictionary(docs: DataFrame, text_col: str = "text") -> bytes:
    """The fixed identifiers and the words that the most documents hold, the commonest last, where matches are cheapest:
    all from a number of documents on, so many that they are ``WORDS`` at most. All documents count; the driver gets a
    histogram of some hundred rows and the list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n: Counter[bytes] = Counter()
            for text in b.column(0).cast(pa.binary()).to_pylist():
                n.update(set(_WORD.findall(text or b"")))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    counts = docs.select(docs[text_col].alias("text")).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    scratch = Scratch(docs.sparkSession)
    counts = scratch.cut(counts.withColumn("level", F.floor(8 * F.log2("n"))))
    least, held = None, 0
    for r in sorted(counts.groupBy("level").count().collect(), reverse=True):
        held += r["count"]
        if held > WORDS:
            break
        least = r.level
    top = [] if least is None else sorted((r.n, r.word) for r in counts.filter(F.col("level") >= least).collect())
    scratch.drop(counts)
    return IDENTIFIERS + b" " + " ".join(w for _, w in top).encode()


_plain = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False, write_dict_id=False)
#: Bytes of a frame with nothing in it.
EMPTY = len(_plain.compress(b""))


def novelty(candidate: bytes, around: bytes, known: bytes = IDENTIFIERS) -> float:
    """Bytes that the candidate adds to a frame primed with the identifiers and the text around, over its length."""
    primed = zstandard.ZstdCompressionDict(known + b"\n" + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    c = zstandard.ZstdCompressor(level=3, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)
    return (len(c.compress(candidate)) - EMPTY) / len(candidate)


def threshold(candidate: bytes) -> float:
    """Novelty from which on a candidate is reported."""
    if len(candidate) < LONG:
        return NOVELTY
    return NOVELTY_LONG * next((bits / 6 for encoding, bits in _ENCODINGS if encoding.fullmatch(candidate)), 1)


def _blanked(text: bytes, candidate: bytes) -> bytes:
    """The text with all that it shares with the candidate over at least a candidate's length made blank."""
    n = range(len(text) - LEAST + 1)
    own = {text[i : i + LEAST] for i in n}
    shared = {g for i in range(len(candidate) - LEAST + 1) if (g := candidate[i : i + LEAST]) in own}
    if not shared:
        return text
    out = bytearray(text)
    for i in n:
        if text[i : i + LEAST] in shared:
            out[i : i + LEAST] = b"\n" * LEAST
    return bytes(out)


def _is_novel(b: bytes, s: int, e: int, known: bytes) -> bool:
    """Whether what stands from ``s`` to ``e`` is novel beside the text around, other copies of it left out."""
    least = threshold(b[s:e])
    if novelty(b[s:e], b[max(0, s - AROUND) : s] + b"\n" + b[e : e + AROUND], known) >= least:
        return True
    # copies that the ends of the text around cut are known by the bytes beyond
    before, after = b[max(0, s - AROUND - LEAST + 1) : s], b[e : e + AROUND + LEAST - 1]
    left, right = _blanked(before, b[s:e]), _blanked(after, b[s:e])
    return (left != before or right != after) and novelty(b[s:e], left[-AROUND:] + b"\n" + right[:AROUND], known) >= least


def _places(low: bytes, words: tuple[bytes, ...]) -> list[int]:
    out = []
    for w in words:
        at = low.find(w)
        while at >= 0:
            out.append(at)
            at = low.find(w, at + 1)
    return sorted(out)


def base_spans(b: bytes, low: bytes) -> list[tuple[int, int, int, int]]:
    """Byte spans (start, kind, end, start of the secret itself) of the fixed patterns."""
    spans = []
    done = 0
    for at in _places(low, _WORDS):
        if at >= done and (m := _ASSIGN.match(b, at)):
            done = m.end()
            if m.end(2) - m.start(2) >= 6:
                spans.append((at, 0, done, m.start(2)))
    if b"AKIA" in b:
        spans += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(b) if m.end() - m.start() >= 20]
    mask = b.translate(_HEX)
    at = mask.find(_HEX_RUN)
    while at >= 0:
        end = mask.find(b" ", at)
        end = len(mask) if end < 0 else end
        spans.append((at, 2, end, at))
        at = mask.find(_HEX_RUN, end)
    return sorted(spans)


def novel_spans(b: bytes, low: bytes, base: list[tuple[int, int, int, int]], known: bytes = IDENTIFIERS) -> list[tuple[int, int, int, int]]:
    found, done = [], 0
    taken = [(s[0], s[2]) for s in base]
    for at, word in sorted((at, len(w)) for w in SENSITIVE for at in _places(low, (w,))):
        last = at + word + REACH
        at = max(at, done)
        while at <= last and (m := _CANDIDATE.search(b, at, min(len(b), last + LEAST))):
            # the run goes on beyond the reach
            m = _CANDIDATE.match(b, m.start())
            s, e = m.span()
            at = done = e
            if any(x < e and s < y for x, y in taken):
                continue
            if _is_novel(b, s, e, known):
                found.append((s, 3, e, s))
                if after := _NEXT.match(b, e):
                    last = max(last, after.end())
    return found


def scan(text: bytes | None, known: bytes = IDENTIFIERS) -> tuple[list, list]:
    """Base spans and all spans of a text as (start, kind, end, start of the secret) in bytes, in order."""
    b = text or b""
    low = b.lower()
    base = base_spans(b, low)
    return base, sorted(base + novel_spans(b, low, base, known))


def _points(b: bytes, spans: list) -> list[str]:
    """kind:start:end in code points."""
    if b.isascii():
        return [f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans]
    at, n, where = 0, 0, {}
    for p in sorted({x for s in spans for x in (s[0], s[2])}):
        n += len(b[at:p].decode())
        at = p
        where[p] = n
    return [f"{KINDS[k]}:{where[s]}:{where[e]}" for s, k, e, _ in spans]


def find_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``, ``n_novel`` for every row.

    Null and empty texts have no spans (the hash is that of the empty string); repeated rows repeat, null ids stay
    null, further columns are ignored, no rows give no rows. One pass counts the words of the dictionary, one scans
    whole texts.
    """
    known = dictionary(docs, text_col)

    def run(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel")}
        for b in c["text"]:
            base, every = scan(b, known)
            kinds = [s[1] for s in every]
            for k, name in enumerate(("n_assign", "n_access", "n_hex", "n_novel")):
                out[name].append(kinds.count(k))
            out["base_sha256"].append(hashlib.sha256(",".join(_points(b or b"", base)).encode()).hexdigest())
            out["spans"].append(",".join(_points(b or b"", every)))
        return out | {"doc_id": c["doc_id"]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", docs[text_col].alias("text")), run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_novel bigint")


def redact_text(b: bytes, known: bytes = IDENTIFIERS, mark: bytes = b"[SECRET]") -> bytes:
    """The text with each secret, overlapping ones together, replaced by ``mark``; names before ``=`` or ``:`` stay."""
    out, at = [], 0
    spans = sorted((s[3], s[2]) for s in scan(b, known)[1])
    for s, e in spans:
        if s >= at:
            out += [b[at:s], mark]
        at = max(at, e)
    return b"".join(out) + b[at:] if out else b


def redact(docs: DataFrame) -> DataFrame:
    """Every document with its secrets replaced; ``n_chars`` follows where there is one. Clean rows, null and empty texts
    among them, pass unchanged; repeated rows get the same text; null ids and further columns pass, whatever their names;
    no rows give no rows."""
    known = dictionary(docs)

    def run(batches):
        for batch in slices(batches):
            i = batch.schema.get_field_index("text")
            old = batch.column(i).cast(pa.binary()).to_pylist()
            new = [None if b is None else redact_text(b, known) for b in old]
            changed = [j for j, (a, b) in enumerate(zip(old, new, strict=True)) if a is not b]
            if changed:
                batch = batch.set_column(i, batch.schema.field(i), pa.array(new, pa.binary()).cast(batch.schema.field(i).type))
                n = batch.schema.get_field_index("n_chars")
                if n >= 0:
                    counts = batch.column(n).to_pylist()
                    for j in changed:
                        counts[j] = len(new[j].decode())
                    batch = batch.set_column(n, batch.schema.field(n), pa.array(counts, batch.schema.field(n).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
