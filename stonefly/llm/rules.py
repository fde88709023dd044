"""Quality rules with thresholds that adapt to language and source.

Each measure of a text goes into a quantile sketch of its language and source:
counts of logarithmic buckets, of relative error ``ERROR``. Sketches merge by
adding counts, so partitions pre-aggregate them, and those of a language and of
all documents are sums of the finer ones. A measure's fence lies ``factor`` times
as far from the median as a far quantile of the same sketch, so its height and
its width both come from the group; ``floor`` is a numerical least for measures
that are zero nearly everywhere. A group of fewer than ``GROUP`` documents takes
the fences of its language, or those of all. The fences are joined back to the
documents, and one outside any of them goes.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stonefly.llm.common import Scratch, map_batches

SYMBOLS = b"#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
ERROR, LEAST = 0.01, 1e-4
GROUP = 200
#: Measures with their tails: the quantile below the median and the factor of its distance (None: no lower fence), the same
#: above, and the least distance of a fence, to which twice the sketch's error at the median is added.
TAILS = {
    "mean_word": ((0.1, 5.0), (0.9, 5.0), 0.05),
    "symbol_share": (None, (0.85, 4.0), 0.02),
    "bang_share": (None, (0.85, 4.0), 0.02),
    "upper_share": (None, (0.98, 4.0), 0.005),
    "digit_share": (None, (0.99, 4.0), 0.005),
    "dup_line_share": (None, (0.99, 2.0), 0.02),
    "repeat_share": (None, (0.99, 1.75), 0.02),
}
#: Each quantile that some tail asks for, and the median, under the name of its column.
QUANTILES = {f"q{q * 100:g}".replace(".", "_"): q for q in sorted({0.5, *(t[0] for low, high, _ in TAILS.values() for t in (low, high) if t)})}
_COLUMN = {q: name for name, q in QUANTILES.items()}
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window found at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    spans = list(zip(*(words[i:] for i in range(window)), strict=False))
    if len(set(spans)) == n:
        return 0
    twice = {s for s, c in Counter(spans).items() if c > 1}
    total, done = 0, 0
    for i, s in enumerate(spans):
        if s in twice:
            total += i + window - max(i, done)
            done = i + window
    return total


def measure(text: bytes | None) -> tuple[int, int, int, int, int, list[float]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the whole text, and the measures of ``TAILS`` in turn."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return 0, 0, sum(map(text.count, (bytes([c]) for c in SYMBOLS))), 0, 0, [0.0] * len(TAILS)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = int(len(text) - counts[128:192].sum() - counts[9:14].sum() - counts[32])
    symbols = int(counts[list(SYMBOLS)].sum())
    lines, seen, dup = [x for x in text.split(b"\n") if x.strip()], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    repeat = repeated_words(words)
    return n, chars, symbols, dup, repeat, [
        chars / n, symbols / n, float(counts[33]) / n, float(counts[_UPPER].sum()) / chars, float(counts[48:58].sum()) / chars, dup / len(lines), repeat / n,
    ]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row a document: id, lang, source, the base counts and ``m``, the measures."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(c: dict[str, list]) -> dict[str, list]:
        n, chars, symbols, dup, repeat, m = zip(*map(measure, c["text"]), strict=True) if c["text"] else [[]] * 6
        return {"doc_id": c["doc_id"], "lang": c["lang"], "source": c["source"], "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "m": m}

    own = docs.select(F.col(id_col).alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col(text_col).alias("text"))
    return map_batches(own, run, f"doc_id {kind}, lang string, source string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, m array<double>")


def bucket(x: Column) -> Column:
    """Number of the logarithmic bucket of a value; all below ``LEAST`` share bucket 0."""
    return F.when(x < LEAST, 0).otherwise(F.ceil(F.log(x / LEAST) / math.log((1 + ERROR) / (1 - ERROR))) + 1).cast("int")


def value(b: Column) -> Column:
    """A value within ``ERROR`` of all that the bucket holds."""
    g = (1 + ERROR) / (1 - ERROR)
    return F.when(b == 0, F.lit(0.0)).otherwise(2 * LEAST * F.pow(F.lit(g), b - 1) / (g + 1))


def sketches(rows: DataFrame, keys: list[str], measures: Column) -> DataFrame:
    """``keys``, ``measure``, ``bucket``, ``n``: the sketch of each key and measure."""
    flat = rows.select(*keys, F.posexplode(measures).alias("measure", "x"))
    return flat.groupBy(*keys, "measure", bucket(F.col("x")).alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], at: dict[str, float]) -> DataFrame:
    """``keys``, ``measure``, ``size`` and a column for each quantile. A window holds the buckets of one sketch, a few thousand at most."""
    own = W.partitionBy(*keys, "measure")
    s = sketch.withColumns({"size": F.sum("n").over(own), "upto": F.sum("n").over(own.orderBy("bucket"))})
    return s.groupBy(*keys, "measure", "size").agg(*[value(F.min(F.when(F.col("upto") >= q * F.col("size"), F.col("bucket")))).alias(name) for name, q in at.items()])


def fences(sketch: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``low``, ``high`` (arrays in the order of the measures) from sketches of language and source."""

    def level(keys: list[str], name: str) -> DataFrame:
        q = quantiles(merge(sketch, keys), keys, QUANTILES)
        low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
        for i, (below, above, floor) in enumerate(TAILS.values()):
            own, least = F.col("measure") == i, floor + 2 * ERROR * F.col("q50")
            high = F.when(own, F.col("q50") + F.greatest(least, above[1] * (F.col(_COLUMN[above[0]]) - F.col("q50")))).otherwise(high)
            if below:
                low = F.when(own, F.col("q50") - F.greatest(least, below[1] * (F.col("q50") - F.col(_COLUMN[below[0]])))).otherwise(low)
        low = F.coalesce(low, F.lit(float("-inf")))
        rows = F.sort_array(F.collect_list(F.struct("measure", low.alias("low"), high.alias("high"))))
        return q.groupBy(*keys, "size").agg(rows.alias("f")).select(*[F.col(k).alias(f"{name}_{k}") for k in keys], F.col("size").alias(f"{name}_size"), F.col("f").alias(name))

    fine, lang, every = level(["lang", "source"], "fine"), level(["lang"], "wide"), level([], "all")
    both = fine.join(lang, F.col("fine_lang").eqNullSafe(F.col("wide_lang"))).crossJoin(F.broadcast(every))  # one row
    f = F.when(F.col("fine_size") >= GROUP, F.col("fine")).when(F.col("wide_size") >= GROUP, F.col("wide")).otherwise(F.col("all"))
    return both.select(F.col("fine_lang").alias("f_lang"), F.col("fine_source").alias("f_source"), f["low"].alias("low"), f["high"].alias("high"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: ``doc_id``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``base_failed``, ``kept``, ``outside`` (the measures beyond their fences).

    Null, empty and blank texts have no words and fail the base rules. Null languages and sources are a language and
    a source of their own. Texts that fail the base rules do not enter the sketches. Repeated rows repeat and count as often in them; null
    ids stay null; further columns are ignored; no rows give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    rows = measured(docs, id_col, text_col)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = scratch.cut(rows.withColumn("base_failed", failed))
    sketch = scratch.cut(sketches(rows.filter("not base_failed"), ["lang", "source"], F.col("m")))
    known = scratch.cut(fences(sketch))
    both = rows.join(known, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    names = F.array(*map(F.lit, TAILS))
    out = F.filter(F.transform(F.arrays_zip("m", "low", "high", names.alias("name")), lambda x: F.when((x["m"] < x["low"]) | (x["m"] > x["high"]), x["name"])), lambda x: x.isNotNull())
    outside = F.when(F.col("base_failed"), F.lit("")).otherwise(F.array_join(out, ","))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return both.select(*base, (~F.col("base_failed") & (outside == "")).alias("kept"), outside.alias("outside"))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns. Rows that share an id stay only if all are kept; those
    without one go by their text. Null and empty texts go, as they fail the base rules; further columns, whatever their
    names, pass unchanged; no rows give no rows."""
    of = lambda c: F.when(c[id_col].isNull(), F.xxhash64(c[text_col])).otherwise(F.xxhash64(c[id_col]))
    narrow = docs.select(of(docs).alias("doc_id"), F.col("lang"), F.col("source"), F.col(text_col).alias("text"))
    bad = Scratch(docs.sparkSession).cut(judge(narrow).filter("not kept").select(F.col("doc_id").alias("bad_key")).distinct())
    return docs.join(bad, of(docs) == bad["bad_key"], "left_anti")


def _sql() -> str:
    """The same verdicts in DuckDB: exact counts of the buckets, so the sketches agree."""
    word, g = r"[^\x20\x09-\x0D]", (1 + ERROR) / (1 - ERROR)
    strip = lambda chars: f"(length(text) - length(regexp_replace(text, '{chars}', '', 'g')))"
    shares = ["word_chars / n_words", "n_symbols / n_words", "bangs / n_words", "uppers / word_chars", "digits / word_chars", "n_dup_lines / n_lines", "n_repeat_words / n_words"]
    measures = "\n  UNION ALL ".join(f"SELECT doc_id, lang, source, {i} AS k, {x} AS x FROM b WHERE NOT base_failed" for i, x in enumerate(shares))
    null = lambda tail: ("NULL", "NULL") if tail is None else tail
    tails = ", ".join(f"({i}, '{n}', {null(lo)[0]}, {null(lo)[1]}, {hi[0]}, {hi[1]}, {floor})" for i, (n, (lo, hi, floor)) in enumerate(TAILS.items()))

    def level(name: str, keys: str) -> str:
        by = f"{keys}, k" if keys else "k"
        at = lambda q: f"min(bucket) FILTER (upto >= {q} * size)"
        v = lambda n: f"CASE WHEN {n} = 0 THEN 0.0::DOUBLE ELSE 2 * {LEAST!r}::DOUBLE * pow({g!r}::DOUBLE, {n} - 1) / {g + 1!r}::DOUBLE END"
        return f"""{name}_c AS (SELECT {by}, bucket, count(*) AS n FROM z GROUP BY ALL),
{name}_u AS (SELECT {by}, bucket, sum(n) OVER (PARTITION BY {by}) AS size, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS upto FROM {name}_c),
{name}_b AS (SELECT {by}, size, lf, hf, floor, {at("lq")} AS b_lo, {at("0.5")} AS b_mid, {at("hq")} AS b_hi FROM {name}_u JOIN tails USING (k) GROUP BY ALL),
{name}_q AS (SELECT *, {v("b_lo")} AS lo, {v("b_mid")} AS mid, {v("b_hi")} AS hi FROM {name}_b),
{name} AS (SELECT {by}, size, mid - greatest(floor + {2 * ERROR!r} * mid, lf * (mid - lo)) AS low_raw, mid + greatest(floor + {2 * ERROR!r} * mid, hf * (hi - mid)) AS high FROM {name}_q)"""

    return f"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
l AS (SELECT *, regexp_extract_all(text, '{word}+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM t),
c AS (SELECT doc_id, lang, source, len(ws) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars, {strip("[#*$%&|<>]")} AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, {strip("!")} AS bangs, {strip("[A-Z]")} AS uppers, {strip("[0-9]")} AS digits FROM l),
w AS (SELECT doc_id, i, CASE WHEN i + {WINDOW - 1} <= n THEN ws[i:i + {WINDOW - 1}] END AS win FROM (SELECT doc_id, ws, len(ws) AS n, unnest(range(1, len(ws) + 1)) AS i FROM l)),
r AS (SELECT doc_id, i, (win IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, win) > 1)::INT AS rep FROM w),
o AS (SELECT doc_id, max(rep) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS covered FROM r),
a AS (SELECT c.*, coalesce(n, 0) AS n_repeat_words FROM c LEFT JOIN (SELECT doc_id, sum(covered) AS n FROM o GROUP BY doc_id) USING (doc_id)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM a),
m AS ({measures}),
z AS (SELECT *, CASE WHEN x < {LEAST!r} THEN 0 ELSE ceil(ln(x / {LEAST!r}::DOUBLE) / {math.log(g)!r}::DOUBLE) + 1 END AS bucket FROM m),
tails(k, name, lq, lf, hq, hf, floor) AS (VALUES {tails}),
{level("fine", "lang, source")},
{level("wide", "lang")},
{level("whole", "")},
f AS (SELECT m.doc_id, m.k, tails.name, m.x, CASE WHEN fine.size >= {GROUP} THEN fine.low_raw WHEN wide.size >= {GROUP} THEN wide.low_raw ELSE whole.low_raw END AS low,
    CASE WHEN fine.size >= {GROUP} THEN fine.high WHEN wide.size >= {GROUP} THEN wide.high ELSE whole.high END AS high, tails.lq
  FROM m JOIN fine ON m.lang IS NOT DISTINCT FROM fine.lang AND m.source IS NOT DISTINCT FROM fine.source AND m.k = fine.k
  JOIN wide ON m.lang IS NOT DISTINCT FROM wide.lang AND m.k = wide.k JOIN whole ON m.k = whole.k JOIN tails ON m.k = tails.k),
v AS (SELECT doc_id, string_agg(name, ',' ORDER BY k) AS outside FROM f WHERE lq IS NOT NULL AND x < low OR x > high GROUP BY doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  base_failed, NOT base_failed AND outside IS NULL AS kept, coalesce(outside, '') AS outside
FROM b LEFT JOIN v USING (doc_id)"""


SQL = _sql()
