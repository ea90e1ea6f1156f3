"""Quality rules as a ledger of bits: measure once, judge many times.

Each rule is evaluated once per document. The ledger keeps the measurements and one long whose bit k is set where rule
k fails. A policy is a version of the verdict: a mask of the rules that reject. Policies and ablations (what a policy
keeps without one of its rules, what only one rule rejects) need the ledger's bits alone: the documents are counted by
their bits, and the handful of different patterns is compared with masks.

Words are runs of anything but space and 0x09 to 0x0D. A null text has no words; a text without words fails the rule
on length and no rule that is a share of words. Measurements of a document don't depend on other rows: null ids, ties
and repeated rows are measured one by one, and an empty table gives an empty ledger. A long text costs an array of
its words and of its windows' hashes in one row, nothing more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import let, pick, text_or_empty, words_column

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
WINDOW = 5


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of ``window`` words that occur twice or more in the array."""
    n_windows = F.size(words) - (window - 1)
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def covered(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), n_windows - 1), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(starts(w), reach)))

    def starts(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(ordered, lambda s: F.sort_array(F.transform(F.filter(
            s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])), lambda x: x["i"])))

    def reach(at: Column) -> Column:
        steps = F.transform(at, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(at, j + 1) - x, F.lit(window))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return F.when(n_windows < 2, F.lit(0)).otherwise(let(hashes, covered)).cast("long")


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and every measurement that a rule uses."""
    rows = pick(docs, doc_id=doc_id, text=text).select("doc_id", text_or_empty("text").alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]+", ""))
    capitals = F.length(F.regexp_replace("text", r"[^\p{Lu}]+", ""))

    def of_words(w: Column) -> Column:
        echoes = F.filter(w, lambda x, i: F.get(w, i - 1) == x)
        return F.struct(F.size(w).cast("long").alias("n_words"), F.size(echoes).cast("long").alias("n_echoes"), repeated_words(w).alias("n_repeat_words"))

    rows = rows.select(
        "doc_id", let(words_column("text"), of_words).alias("w"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
        letters.cast("long").alias("n_letters"), capitals.cast("long").alias("n_capitals"))
    return rows.select("doc_id", "w.n_words", "word_chars", "n_symbols", F.col("l.dup").alias("n_dup_lines"), "w.n_repeat_words",
                       F.col("l.n").alias("n_lines"), "w.n_echoes", "n_letters", "n_capitals")


#: Name and condition of failure; the place in this list is the bit, so rules are only ever appended.
RULES = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 40 * n_lines"),
    ("echoed_words", "100 * n_echoes > 20 * n_words"),
    ("capitals", "100 * n_capitals > 60 * n_letters"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
]
#: Versioned policies: the rules that reject.
POLICIES = {
    "base": ["few_words", "repeated_windows"],
    "v1": ["few_words", "repeated_windows", "symbols", "repeated_lines"],
    "v2": [name for name, _ in RULES],
}


def mask(rules: list[str]) -> int:
    places = {name: k for k, (name, _) in enumerate(RULES)}
    return sum(1 << places[r] for r in rules)


def rejected(bits: Column, policy: str) -> Column:
    return bits.bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) != 0


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Measurements and failure bits of every document."""
    bits = [F.when(F.expr(condition), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, (_, condition) in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs, doc_id, text).withColumn("failed", total)


def judge(book: DataFrame, policy: str = "v2") -> DataFrame:
    """The ledger with ``kept`` under one policy."""
    return book.withColumn("kept", ~rejected(F.col("failed"), policy))


def ablations(book: DataFrame) -> DataFrame:
    """policy, rule, kept, kept_without, only: documents kept with all rules, without this rule, and rejected by it alone."""
    patterns = book.groupBy("failed").agg(F.count("*").alias("n"))
    cases = book.sparkSession.createDataFrame(
        [(p, r, mask(rules), mask(rules) & ~mask([r])) for p, rules in POLICIES.items() for r in rules], "policy string, rule string, every long, without long")
    hit = lambda m: F.col("failed").bitwiseAND(F.col(m)) != 0
    counted = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).alias
    return patterns.join(F.broadcast(cases)).groupBy("policy", "rule").agg(  # a few dozen cases, fixed by the lists above
        counted(~hit("every"))("kept"), counted(~hit("without"))("kept_without"), counted(hit("every") & ~hit("without"))("only"))
