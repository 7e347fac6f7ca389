"""Secret scans with a randomness test battery, in DataFrame functions only.

Base spans come from three patterns. The method adds spans of kind ``random``: long runs of encoding characters that
overlap no base span. For each, an encoding is inferred (hex, base32, base62, base64), and on its symbols three tests
of randomness are made: chi-squared uniformity over the alphabet (its symbols, and its capitals, small letters and
others), runs above and below the middle symbol, and serial correlation. Each gives a z value; the largest departure from randomness among them is the battery's statistic. Its one
p-value is the probability that ordinary text of the same length and encoding comes as close to randomness in all three
tests: the uniformity of text is far lower (the longer the run, the surer), the other two are as good as independent of
it. Benjamini-Hochberg control on that p-value, within bands of length (short strings say little), picks the spans;
its ranks come from a histogram of fixed size over all documents.

The texts are read twice, once for the histogram and once for the spans; nothing is joined, shuffled or written but the
histogram's counts.

Defined cases: a null or empty text has no spans; other columns pass through unchanged (columns made here start with
``_scan``); repeated rows count as rows; an empty table gives an empty one. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, in the order of their kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")

#: A run of encoding characters that the battery looks at.
LEAST_RUN = 20
RUN = r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_RUN
#: Share of false discoveries allowed among the added spans.
FDR = 0.01
#: Lower ends of the bands of length.
BANDS = (20, 32, 64)
#: Bins of the p-values' histogram: this many for each power of ten, down to the last.
PER_DECADE, BINS = 20, 400

# Sums of the squared and cubed symbol frequencies of ordinary text, by inferred encoding.
TEXT_SQUARES = {"hex": 0.1, "base32": 0.066, "base62": 0.066, "base64": 0.066}
TEXT_CUBES = {"hex": 0.0125, "base32": 0.0056, "base62": 0.0056, "base64": 0.0056}
SYMBOLS = {"hex": 16, "base32": 32, "base62": 62, "base64": 64}
CAPITALS = {"hex": 0, "base32": 26, "base62": 26, "base64": 26}
SMALL = {"hex": 6, "base32": 0, "base62": 26, "base64": 26}
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE16 = "0123456789abcdef"

SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Elements that a running total takes at a time.
BLOCK = 64


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array<bigint>, join(..) of all up to it: block by block, so that no array grows element by element."""

    def grown(block: Column) -> Column:
        more = lambda done, v: F.array_append(done, F.when(F.size(done) == 0, v).otherwise(join(F.element_at(done, F.lit(-1)), v)))
        return F.aggregate(block, F.array().cast("array<bigint>"), more)

    def whole(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / BLOCK).cast("int") - 1), lambda b: grown(F.slice(x, b * BLOCK + 1, F.lit(BLOCK))))
        return _let(blocks, lambda bs: _let(grown(F.transform(bs, lambda b: F.element_at(b, F.lit(-1)))), lambda upto: F.flatten(F.transform(bs, lambda b, i: F.when(i == 0, b).otherwise(_let(F.get(upto, i - 1), lambda u: F.transform(b, lambda v: join(u, v))))))))

    return _let(values, lambda x: F.when(F.size(x) == 0, x).otherwise(whole(x)))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def located(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Spans of all matches from left to right, by the lengths of the matches and of what lies between; with the group's value."""
    length = lambda c: F.char_length(c).cast("bigint")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # One part more lies between than there are matches: the last pair has no match.
    parts = F.zip_with(found, F.split(text, pattern, -1), lambda m, gap: F.struct(length(gap).alias("gap"), length(m).alias("size"), m.alias("value")))
    if group:
        parts = F.zip_with(parts, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda p, v: F.struct(p["gap"].alias("gap"), p["size"].alias("size"), v.alias("value")))
    span = lambda p, end: F.struct((end - p["size"]).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), p["value"].alias("value"))
    return _let(F.filter(parts, lambda p: p["size"].isNotNull()), lambda ps: F.zip_with(ps, running(F.transform(ps, lambda p: p["gap"] + p["size"]), _sum), span))


def _without_value(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"]))


def base_spans(text: Column) -> Column:
    none = F.array().cast(SPAN)
    assign = F.filter(located(text, ASSIGN, 0, group=2), lambda s: F.char_length(s["value"]) >= 8)
    access = F.filter(located(text, ACCESS, 1), lambda s: s["end"] - s["start"] >= 16)
    # Runs of hex digits are as long as they can be, so those of 32 or more are all matches of the longer pattern.
    hexes = located(text, HEX.replace("+", "{32,}"), 2)
    parts = [
        # Cheap looks first: most texts have no sign of assignment, and a run is looked at from its beginning only.
        F.when(text.contains("=") | text.contains(":"), F.when(text.rlike(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""), _without_value(assign)).otherwise(none)).otherwise(none),
        F.when(text.contains("AKIA"), _without_value(access)).otherwise(none),
        F.when(text.rlike("(?<![0-9a-f])[0-9a-f]{32}"), _without_value(hexes)).otherwise(none),
    ]
    return F.array_sort(F.concat(*parts))


_FOUND = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"


def has_run(text: Column) -> Column:
    return text.rlike("(?<!%s)%s" % (RUN.split("{")[0], RUN.replace(",", "")))


def clear_of(spans: Column, others: Column) -> Column:
    """The spans (start, kind, end, value) that overlap none of the others (start, kind, end). Both come in order of start.

    In one order of start, a span is clear if no other up to it ends after its start, and the next begins at its end or
    later.
    """
    row = lambda s, own, value: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["kind"].alias("kind"), s["end"].alias("end"), value.alias("value"))
    both = F.array_sort(F.concat(F.transform(others, lambda s: row(s, 1, F.lit(None).cast("string"))), F.transform(spans, lambda s: row(s, 2, s["value"]))))
    far = F.lit(2**62).cast("bigint")

    def clear(rows: Column) -> Column:
        ends = running(F.transform(rows, lambda r: F.when(r["own"] == 1, r["end"]).otherwise(-far)), F.greatest)
        begins = F.reverse(running(F.reverse(F.transform(rows, lambda r: F.when(r["own"] == 1, r["start"]).otherwise(far))), F.least))
        told = F.zip_with(rows, F.zip_with(ends, begins, lambda e, b: F.struct(e.alias("reached"), b.alias("next"))), lambda r, n: F.struct(r.alias("r"), n.alias("n")))
        kept = F.filter(told, lambda t: (t["r"]["own"] == 2) & (t["n"]["reached"] <= t["r"]["start"]) & (t["n"]["next"] >= t["r"]["end"]))
        return F.transform(kept, lambda t: F.struct(t["r"]["start"].alias("start"), t["r"]["kind"].alias("kind"), t["r"]["end"].alias("end"), t["r"]["value"].alias("value")))

    return _let(both, clear)


def random_candidates(text: Column, base: Column) -> Column:
    """Runs of two kinds of characters or more that overlap no base span, with their values."""
    classes = lambda v: sum((v.rlike(c).cast("int") for c in ("[a-z]", "[0-9]")), v.rlike("[A-Z]").cast("int"))
    runs = F.filter(located(text, RUN, 3), lambda s: classes(s["value"]) >= 2)
    found = _let(runs, lambda rs: _let(base, lambda b: F.when((F.size(rs) == 0) | (F.size(b) == 0), rs).otherwise(clear_of(rs, b))))
    return F.when(has_run(text), found).otherwise(F.array().cast(_FOUND))


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal, by a rational Chebyshev fit of the complementary error function."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + x / 2)
    # Coefficients of the fit, whose relative error is below 1.2e-7.
    fit = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly: Column = F.lit(fit[-1])
    for c in reversed(fit[:-1]):
        poly = poly * t + c
    half = t * F.exp(poly - x * x) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def battery(value: Column) -> Column:
    """encoding, z_uniform, z_runs, z_serial and p of a run: a struct."""
    by = lambda table, key: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    bare = F.translate(F.rtrim(value, F.lit("=")), "-_", "+/")

    def inferred(t: Column) -> Column:
        kind = F.when(t.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(t.rlike("^[A-Z2-7]+$"), "base32").when(t.rlike("^[A-Za-z0-9]+$"), "base62").otherwise("base64")
        return F.struct(kind.alias("kind"), F.when(kind == "hex", F.lower(t)).otherwise(t).alias("text"))

    def symbols(e: Column) -> Column:
        alphabet = F.when(e["kind"] == "hex", BASE16).when(e["kind"] == "base32", BASE32).otherwise(BASE64)
        n = F.char_length(e["text"]).cast("double")
        count = lambda c: n - F.char_length(F.replace(e["text"], c, F.lit("")))
        squares = F.aggregate(_characters(alphabet), F.lit(0.0), lambda total, c: total + count(c) * count(c))
        x = F.transform(_characters(e["text"]), lambda c: (F.call_function("locate", c, alphabet) - 1).cast("double"))
        mean = F.aggregate(x, F.lit(0.0), lambda total, v: total + v) / n
        some = lambda pattern: n - F.char_length(F.regexp_replace(e["text"], pattern, ""))
        return F.struct(e["kind"].alias("kind"), n.alias("n"), by(SYMBOLS, e["kind"]).cast("double").alias("a"), some("[A-Z]").alias("capitals"), some("[a-z]").alias("small"), squares.alias("squares"), x.alias("x"), mean.alias("mean"))

    def sums(s: Column) -> Column:
        middle = s["a"] / 2
        over = F.aggregate(s["x"], F.lit(0.0), lambda total, v: total + F.when(v >= middle, 1.0).otherwise(0.0))
        pairs = F.zip_with(F.slice(s["x"], 2, F.greatest(F.size(s["x"]) - 1, F.lit(0))), F.slice(s["x"], 1, F.greatest(F.size(s["x"]) - 1, F.lit(0))), lambda y, z: F.struct(y.alias("y"), z.alias("z")))
        changes = F.aggregate(pairs, F.lit(0.0), lambda total, q: total + F.when((q["y"] >= middle) != (q["z"] >= middle), 1.0).otherwise(0.0))
        lagged = F.aggregate(pairs, F.lit(0.0), lambda total, q: total + (q["y"] - s["mean"]) * (q["z"] - s["mean"]))
        spread = F.aggregate(s["x"], F.lit(0.0), lambda total, v: total + (v - s["mean"]) * (v - s["mean"]))
        return F.struct(*[s[c].alias(c) for c in ("kind", "n", "a", "capitals", "small", "squares")], over.alias("over"), (changes + 1).alias("runs"), lagged.alias("lagged"), spread.alias("spread"))

    def departures(s: Column) -> Column:
        n, a = s["n"], s["a"]
        # Uniformity: A / n * sum of squares - n has mean A - 1 and variance 2 (A - 1) (1 - 1 / n).
        uniform = (a / n * s["squares"] - n - (a - 1)) / F.sqrt(2 * (a - 1) * (1 - 1 / n))
        # The same over the classes, one of three of which may be empty; its tail by the cube root of the statistic.
        sizes = [by(CAPITALS, s["kind"]).cast("double"), by(SMALL, s["kind"]).cast("double")]
        sizes, counts = [*sizes, a - sizes[0] - sizes[1]], [s["capitals"], s["small"], n - s["capitals"] - s["small"]]
        off = sum((F.when(m > 0, (c - n * m / a) * (c - n * m / a) / F.greatest(n * m / a, F.lit(1e-9))).otherwise(0.0) for m, c in zip(sizes, counts)), F.lit(0.0))
        free = F.when((sizes[0] > 0) & (sizes[1] > 0), 2.0).otherwise(1.0)
        classes = (F.cbrt(off / free) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
        uniform = F.greatest(uniform, classes)
        mu = 2 * s["over"] * (n - s["over"]) / n + 1
        var = (mu - 1) * (mu - 2) / (n - 1)
        # One-sided strings have no runs to speak of: that many symbols on one side of the middle aren't random.
        runs = F.when(var > 0, (s["runs"] - mu) / F.sqrt(F.greatest(var, F.lit(1e-9)))).otherwise(F.sqrt(n))
        serial = F.when(s["spread"] > 0, (s["lagged"] / F.greatest(s["spread"], F.lit(1e-9)) + 1 / n) * F.sqrt(n)).otherwise(F.sqrt(n))
        return F.struct(s["kind"].alias("kind"), n.alias("n"), a.alias("a"), uniform.alias("u"), runs.alias("r"), serial.alias("s"), F.greatest(uniform, F.abs(runs), F.abs(serial)).alias("most"))

    def judged(d: Column) -> Column:
        n, a = d["n"], d["a"]
        # The sum of squares at which uniformity departs as far as the battery does, among those of ordinary text.
        squares = n / a * (d["most"] * F.sqrt(2 * (a - 1) * (1 - 1 / n)) + n + a - 1)
        k2, k3 = by(TEXT_SQUARES, d["kind"]), by(TEXT_CUBES, d["kind"])
        expected = n + n * (n - 1) * k2
        variance = 2 * n * (n - 1) * (k2 - k2 * k2) + 4 * n * (n - 1) * (n - 2) * F.greatest(k3 - k2 * k2, F.lit(0.0))
        two_sided = 1 - 2 * upper_tail(d["most"])
        p = upper_tail((expected - squares) / F.sqrt(variance)) * two_sided * two_sided
        return F.struct(d["kind"].alias("encoding"), d["u"].alias("z_uniform"), d["r"].alias("z_runs"), d["s"].alias("z_serial"), p.alias("p"))

    return _let(_let(_let(_let(_let(bare, inferred), symbols), sums), departures), judged)


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _band(length: Column) -> Column:
    out = F.lit(0)
    for i, low in enumerate(BANDS):
        out = F.when(length >= low, i).otherwise(out)
    return out


def thresholds(scored: DataFrame, fdr: float = FDR) -> dict[int, float]:
    """For each band, the largest p that Benjamini-Hochberg accepts; columns band and p. Reads a histogram of fixed size."""
    p = F.greatest(F.col("p"), F.lit(1e-300))
    bins = scored.groupBy("band", F.least(F.floor(-F.log10(p) * PER_DECADE), F.lit(BINS)).cast("int").alias("bin")).count().collect()
    out = {}
    for band in {r.band for r in bins}:
        mine = sorted(((r.bin, r["count"]) for r in bins if r.band == band), reverse=True)
        total, seen = sum(c for _, c in mine), 0
        for b, c in mine:
            seen += c
            highest = 10.0 ** (-b / PER_DECADE)
            if highest <= fdr * seen / total:
                out[band] = highest
    return out


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """df and spans array<struct<start, kind, end>>, sorted; kind is an index into KINDS. A column spans is replaced."""
    df = df.drop("spans")
    value = F.coalesce(F.col(text), F.lit(""))
    some = df.select(value.alias("_scan_text")).where(has_run(F.col("_scan_text")))
    some = some.withColumn("_scan_base", base_spans(F.col("_scan_text")))
    runs = some.select(F.explode(random_candidates(F.col("_scan_text"), F.col("_scan_base"))).alias("run"))
    accepted = thresholds(runs.select(_band(F.char_length("run.value")).alias("band"), battery(F.col("run.value"))["p"].alias("p")))

    def discovered(s: Column) -> Column:
        size, most = F.char_length(s["value"]), F.lit(-1.0)
        for band, p in accepted.items():
            most = F.when(_band(size) == band, p).otherwise(most)
        return battery(s["value"])["p"] <= most

    found = df.withColumn("_scan_base", base_spans(value))
    if not accepted:
        return found.withColumnRenamed("_scan_base", "spans")
    more = _without_value(F.filter(random_candidates(value, F.col("_scan_base")), discovered))
    return found.withColumn("spans", F.array_sort(F.concat("_scan_base", more))).drop("_scan_base")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    found = scan(docs.select("doc_id", "text")).drop("text")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _gaps(spans: Column) -> Column:
    """Where text lies outside sorted spans: (start, end) before each mark, and an open one at the end. Overlapping spans share a mark."""
    zero = F.lit(0).cast("bigint")
    pair = lambda a, b: F.struct(a.alias("start"), b.alias("end"))

    def cut(reached: Column) -> Column:
        # A mark begins where nothing before reaches, and ends where nothing after it begins earlier.
        ahead = F.transform(spans, lambda s, i: pair(s["start"], F.get(reached, i - 1)))
        starts = F.transform(F.filter(ahead, lambda p: p["end"].isNull() | (p["start"] >= p["end"])), lambda p: p["start"])
        behind = F.transform(reached, lambda e, i: pair(e, F.get(spans, i + 1)["start"]))
        ends = F.transform(F.filter(behind, lambda p: p["end"].isNull() | (p["end"] >= p["start"])), lambda p: p["start"])
        return F.zip_with(F.concat(F.array(zero), ends), starts, pair)

    return _let(running(F.transform(spans, lambda s: s["end"]), F.greatest), cut)


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span, and what overlapping spans cover together, replaced by a mark.

    What lies between the marks is cut in two steps, stretches of many pieces first, since each cut counts characters from
    the beginning of what it cuts.
    """

    def piece(of: Column, gap: Column, origin: Column) -> Column:
        begin = (gap["start"] - origin + 1).cast("int")
        return F.when(gap["end"].isNull(), F.substr(of, begin)).otherwise(F.substr(of, begin, (gap["end"] - gap["start"]).cast("int")))

    def joined(gaps: Column) -> Column:
        many = F.ceil(F.sqrt(F.size(gaps).cast("double"))).cast("int")

        def stretch(own: Column) -> Column:
            origin = F.get(own, F.lit(0))["start"]
            region = piece(text, F.struct(origin.alias("start"), F.element_at(own, F.lit(-1))["end"].alias("end")), F.lit(0).cast("bigint"))
            return _let(region, lambda r: _let(origin, lambda o: F.transform(own, lambda g: piece(r, g, o))))

        stretches = F.transform(F.sequence(F.lit(0), F.ceil(F.size(gaps) / many).cast("int") - 1), lambda b: _let(F.slice(gaps, b * many + 1, many), stretch))
        return F.array_join(F.flatten(stretches), mark)

    return F.when(F.size(spans) == 0, text).otherwise(_let(spans, lambda s: _let(_gaps(s), joined)))
