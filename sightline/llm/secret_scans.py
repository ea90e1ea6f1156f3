"""Secrets in whole texts: three fixed patterns, and runs of characters that pass for random.

Fixed kinds are found leftmost and without overlap: assignments of a password or the like, access keys, and long hex
runs. The battery looks at every run of at least ``MIN_RUN`` characters of the base-64 alphabets that has a letter and
a digit. It infers the encoding (hex, base 32, alphanumeric, base 64) and tests "this is uniform noise in that
alphabet" three ways: chi-squared over the alphabet, number of changes between lower case, upper case, digits and
signs, and correlation of neighbours. The least of the three p-values, times three, is the run's p-value. Noise is
wrongly taken for text at a controlled rate: in each class of length (doubling) the Benjamini-Hochberg rule at level
``LEVEL`` says which runs are text; all others are secrets of kind ``random``, unless a fixed kind holds part of them.
The rule needs the whole corpus: p-values are counted in bins of a tenth of a decade, at most 301 per length class, and
a p-value counts as the upper edge of its bin.

Null and empty texts have no spans. Documents are scanned row by row, so null ids, ties and repeated rows are reported
as they come; an empty table gives an empty result. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import cut, let, pick, text_or_empty

#: Fixed patterns, in the order of kinds. A hex run or access key is maximal, so its least length may be in the pattern.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "random")

MIN_RUN = 20
RUN = rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}"
LEVEL = 0.05
BINS = 300
#: Encoding: pattern, alphabet in order, sizes of its classes (lower case, upper case, digits, signs).
ENCODINGS = {
    "hex": ("^[0-9a-f]+$", "0123456789abcdef", (6, 0, 10, 0)),
    "hex_upper": ("^[0-9A-F]+$", "0123456789ABCDEF", (0, 6, 10, 0)),
    "base32": ("^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", (0, 26, 6, 0)),
    "alphanumeric": ("^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", (26, 26, 10, 0)),
    "base64": ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", (26, 26, 10, 2)),
}
SPANS = "array<struct<start:int,stop:int,hit:string>>"


def spans(text: Column, pattern: str) -> Column:
    """Leftmost matches of ``pattern`` without overlap as (start, stop, hit).

    The pieces between matches and the matches give all lengths; their running sums, by doubling steps, the places.
    """
    def placed(hits: Column, gaps: Column) -> Column:
        lengths = F.transform(hits, lambda h, i: F.length(h) + F.length(F.get(gaps, i)))
        steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(hits) + 1)).cast("int"))
        ends = F.aggregate(steps, lengths, lambda sums, k: F.transform(
            sums, lambda x, i: x + F.coalesce(F.get(sums, (i - F.pow(F.lit(2), k)).cast("int")), F.lit(0))))
        return let(ends, lambda e: F.transform(hits, lambda h, i: F.struct(
            (F.get(e, i) - F.length(h)).alias("start"), F.get(e, i).alias("stop"), h.alias("hit"))))
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    found = let(hits, lambda h: let(gaps, lambda g: placed(h, g)))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPANS))


def upper_tail(z: Column) -> Column:
    """Probability that a standard normal exceeds ``z`` (rational approximation, absolute error below 1e-7)."""
    a = F.abs(z) / 2 ** 0.5
    t = 1 / (1 + 0.3275911 * a)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-a * a) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)


def p_value(run: Column) -> Column:
    """P-value of "this run is noise in its inferred alphabet"."""
    body = F.regexp_replace(F.translate(run, "-_", "+/"), "=+", "")
    names = list(ENCODINGS)

    def pick_encoding(value) -> Column:
        out = F.lit(value(ENCODINGS[names[-1]]))
        for name in reversed(names[:-1]):
            out = F.when(run.rlike(ENCODINGS[name][0]), F.lit(value(ENCODINGS[name]))).otherwise(out)
        return out

    def change(e: tuple) -> float:
        return 1 - sum((n / len(e[1])) ** 2 for n in e[2])

    size, alphabet, changing = pick_encoding(lambda e: float(len(e[1]))), pick_encoding(lambda e: e[1]), pick_encoding(change)

    def tests(chars: Column) -> Column:
        n = F.size(chars).cast("double")
        squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s + F.pow(F.size(F.filter(chars, lambda x: x == c)).cast("double"), F.lit(2.0)))
        chi = (squares * size / n - n - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)
        kind = F.transform(chars, lambda c: F.when(c.between("a", "z"), 0).when(c.between("A", "Z"), 1).when(c.between("0", "9"), 2).otherwise(3))
        changes = let(kind, lambda k: F.size(F.filter(k, lambda x, i: F.get(k, i - 1) != x)).cast("double"))
        runs = (changes - (n - 1) * changing) / F.sqrt((n - 1) * changing * (1 - changing))
        values = F.transform(chars, lambda c: F.instr(alphabet, c).cast("double"))

        def correlation(v: Column) -> Column:
            mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n
            return let(F.transform(v, lambda x: x - mean), lambda d: F.aggregate(
                F.transform(d, lambda x, i: x * F.coalesce(F.get(d, i - 1), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x) / F.greatest(
                F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x), F.lit(1e-9)))

        serial = let(values, correlation) * F.sqrt(n)
        return F.least(F.lit(1.0), 3 * F.least(upper_tail(chi), 2 * upper_tail(F.abs(runs)), 2 * upper_tail(F.abs(serial))))

    return let(F.split(body, ""), tests)


def rests(text: Column, run: Column, within: Column) -> Column:
    """What fixed spans leave of a run: the parts before, between and behind them, without separators at a cut."""
    whole = F.struct(run["start"].alias("start"), run["stop"].alias("stop"), run["hit"].alias("hit"))

    def part(k: Column) -> Column:
        start = F.coalesce(F.array_max(F.transform(F.slice(within, F.lit(1), k), lambda b: b["stop"])), run["start"])
        stop = F.greatest(start, F.coalesce(F.get(within, k)["start"], run["stop"]))
        hit = F.substring(text, start + 1, stop - start)
        left, right = F.length(F.regexp_extract(hit, "^[^A-Za-z0-9]*", 0)), F.length(F.regexp_extract(hit, "[^A-Za-z0-9]*$", 0))
        low, high = start + left, F.greatest(start + left, stop - right)
        return F.struct(low.alias("start"), high.alias("stop"), F.substring(text, low + 1, high - low).alias("hit"))

    return F.when(F.size(within) == 0, F.array(whole)).otherwise(F.transform(F.sequence(F.lit(0), F.size(within)), part))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and runs: spans of the fixed kinds, and candidates of the battery with length class and p-value."""
    rows = pick(docs, doc_id=doc_id, text=text).select("doc_id", text_or_empty("text").alias("text"))
    t = F.col("text")
    assigned = F.filter(spans(t, ASSIGN), lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= ASSIGN_LEAST)
    of = lambda kind, found: F.transform(found, lambda s: F.struct(s["start"], F.lit(kind).alias("kind"), s["stop"]))
    base = F.concat(of(0, assigned), of(1, spans(t, ACCESS)), of(2, spans(t, HEX)))
    rows = rows.select("doc_id", "text", F.sort_array(base).alias("base"), spans(t, RUN).alias("runs"))
    rows = rows.withColumn("runs", F.flatten(F.transform("runs", lambda s: rests(t, s, F.filter("base", lambda b: (b["start"] < s["stop"]) & (b["stop"] > s["start"]))))))
    mixed = F.filter("runs", lambda s: s["hit"].rlike("[A-Za-z]") & s["hit"].rlike("[0-9]|[a-z][A-Z].*[a-z][A-Z].*[a-z][A-Z]"))
    free = F.filter(mixed, lambda s: F.length(s["hit"]) >= MIN_RUN)
    return rows.select("doc_id", "base", F.transform(free, lambda s: F.struct(
        s["start"], s["stop"], F.floor(F.log2(F.length(s["hit"]))).cast("int").alias("class"), p_value(s["hit"]).alias("p"))).alias("runs"))


def _bin(p: Column) -> Column:
    return F.least(F.lit(BINS), F.greatest(F.lit(0), F.floor(-10 * F.log10(F.greatest(p, F.lit(1e-300)))).cast("int")))


def thresholds(scanned: DataFrame, level: float = LEVEL) -> dict[int, int]:
    """Per length class the least bin whose runs are text; classes without text are left out.

    What reaches the driver is one count per length class and bin, at most 31 x 301.
    """
    counts = scanned.select(F.explode("runs").alias("r")).groupBy(F.col("r.class").alias("class"), _bin(F.col("r.p")).alias("bin")).count().collect()
    per: dict[int, dict[int, int]] = {}
    for row in counts:
        per.setdefault(row["class"], {})[row["bin"]] = row["count"]
    out = {}
    for length_class, bins in per.items():
        total, below = sum(bins.values()), 0
        for b in sorted(bins, reverse=True):
            below += bins[b]
            if 10 ** (-b / 10) <= level * below / total:
                out[length_class] = b
    return out


def find_secrets(docs: DataFrame, level: float = LEVEL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and found: fixed spans and all spans, each (start, kind, stop) in order of start, then kind."""
    scanned = cut(scan(docs, doc_id, text))
    limits = thresholds(scanned, level)

    def text_like(s: Column) -> Column:
        out = F.lit(False)
        for length_class, b in limits.items():
            out = out | ((s["class"] == length_class) & (_bin(s["p"]) >= b))
        return out

    added = F.transform(F.filter("runs", lambda s: ~text_like(s)), lambda s: F.struct(s["start"], F.lit(3).alias("kind"), s["stop"]))
    return scanned.select("doc_id", "base", F.sort_array(F.concat("base", added)).alias("found"))


def joined(found: str) -> Column:
    """kind:start:stop of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")
