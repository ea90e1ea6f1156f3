"""Prefix trie, chunk recipes and spelling variants against brute force, with awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sightline.llm import chunk_recipes, prefix_trie, spelling

RNG = random.Random(11)


def prose(n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{RNG.randrange(vocabulary)}" for _ in range(n))


# 11 prefix trie -------------------------------------------------------------------------------------------------------

TURNS = ("conv_id long, turn long, role string, text string, depth int, chain string, key string, conv string, n string, kids string, parent string, at string, "
         "rows string, of string, turns string, first string, head string, h string, up string, id string, b string")


def turns_table(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 17) for r in rows], TURNS)


def lists_of(rows):
    """Turns by conversation as (role, text), in the operator's order."""
    out = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            out[c].append((t is not None, t or 0, tie, role, text))
    return {c: [x[3:] for x in sorted(v)] for c, v in out.items()}


def rebuilt_of(lists):
    out = {}
    for c, own in lists.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = lists.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute_trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids, leaves, saved = Counter(k[:-1] for k in members if k), Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    return Counter((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k],
                    hashlib.sha256(",".join(map(str, sorted(c for c in m if len(convs[c]) == len(k)))).encode()).hexdigest()) for k, m in members.items())


def conversations(n, longest, vocabulary):
    rows = []
    for c in range(n):
        for t in range(RNG.choice([0, 1, 2, 4, longest]) if c % 7 else longest):
            rows.append((c, t if t else None, RNG.choice(["user", "assistant", None]) if t else "system", RNG.choice(vocabulary) if t else "you are helpful é"))
    return rows


def trie_rows(df):
    return Counter(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


@pytest.mark.parametrize("longest", [6, 40])
def test_trie_equals_brute_force(spark, longest):
    rows = conversations(60, longest, ["a", "b", "", None, "a longer turn"])
    rows += [(10, 0, "user", "tie"), (10, 0, "user", "other"), (10, 0, "user", "tie"), (None, 0, "user", "nobody's"), (200, 3, None, None)]
    shuffled = RNG.sample(rows, len(rows))
    got = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turn_lists(turns_table(spark, shuffled).repartition(5))))
    assert trie_rows(got) == brute_trie(rebuilt_of(lists_of(rows)))


def test_trie_of_long_conversations_that_part_late(spark):
    """Sixty turns in common, then twenty of each one's own; two are the same, one ends on the way."""
    common = [(t, "user", f"turn {t}") for t in range(60)]
    rows = [(c, *t) for c in range(6) for t in common]
    rows += [(c, 60 + t, "user", f"{c % 5} {t}") for c in range(6) for t in range(20)] + [(8, *t) for t in common[:33]]
    lists = lists_of(rows)
    got = prefix_trie.trie(prefix_trie.turn_lists(turns_table(spark, rows)))
    assert trie_rows(got) == brute_trie(lists)


def test_trie_of_one_first_turn_and_of_nothing(spark, split):
    rows = [(c, t, "user", "hello" if t == 0 else f"{c % 3}") for c in range(400) for t in range(3)]
    got = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turn_lists(turns_table(spark, rows))))
    assert trie_rows(got) == brute_trie(rebuilt_of(lists_of(rows)))
    assert prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turn_lists(turns_table(spark, [])))).count() == 0


# 12 chunk recipes -----------------------------------------------------------------------------------------------------

SCHEMA = "doc_id long, text string, row string, sha string, recipe string, chunk string, content string, n_bytes string, first string, word string, n string, best string"
LONG = prose(60_000, 5000)
BASE = prose(300)
TEXTS = [(5, BASE), (2, BASE.replace(" ", " \t\n")), (9, BASE + " "), (9, BASE + "\n"), (None, BASE), (None, "no id"), (None, " no id"), (None, "no  id"), (1, None),
         (3, ""), (4, " "), (6, "\n\r\n"), (7, LONG), (8, LONG), (10, LONG[:-1] + "x"), (11, "é" * 4000), (11, "é" * 4000), (12, "a\x85b"), (13, "a b"), (14, "a b"), (15, "x" * 100_000)]


def documents(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 10) for r in rows], SCHEMA)


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def check_dedup(spark, rows, **options):
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append(i)
    want, stay = Counter(), Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        for i in ids:
            want[i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest(), len(t.encode())] += 1
        stay[keep, hashlib.sha256(t.encode()).hexdigest()] += 1
    got = chunk_recipes.dedup(documents(spark, rows).repartition(4), **options).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256, r.n_bytes) for r in got) == want
    assert Counter((r.doc_id, r.text_sha256) for r in got if r.kept) == stay


def test_recipes_equal_brute_force(spark):
    check_dedup(spark, TEXTS)
    assert chunk_recipes.dedup(documents(spark, [])).count() == 0


def test_identifiers_that_two_chunks_share_are_drawn_anew(spark):
    check_dedup(spark, TEXTS, digest=1)
    lists, digest = chunk_recipes.recipes(documents(spark, TEXTS), digest=1)
    assert digest > 1


def test_large_group_of_copies(spark, monkeypatch):
    monkeypatch.setattr("sightline.llm.common.HEAVY", 10)
    check_dedup(spark, [(i, BASE if i % 3 else f"{i // 6} other") for i in range(900)])


def test_chunks_give_texts_back(spark):
    docs = documents(spark, TEXTS)
    lists, digest = chunk_recipes.recipes(docs)
    held = {bytes(r.chunk): bytes(r.content) for r in chunk_recipes.chunks(docs, digest).collect()}
    got = Counter((r.doc_id, b"".join(held[bytes(c)] for c in r.recipe)) for r in lists.collect())
    assert got == Counter((i, normal(t).encode()) for i, t in TEXTS)


def test_boundaries_follow_content():
    raw = chunk_recipes.normal(LONG)
    ends = chunk_recipes.chunk_ends(raw)
    sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert ends[-1] == len(raw) and max(sizes) <= chunk_recipes.MOST and min(sizes[:-1]) >= chunk_recipes.LEAST
    shifted = {e - 7 for e in chunk_recipes.chunk_ends(b"a head " + raw)}
    assert len(shifted & set(ends)) > 0.9 * len(ends)
    assert chunk_recipes.chunk_ends(b"") == [] and chunk_recipes.chunk_ends(b"x" * 20_000) == [8192, 16384, 20_000]


# 13 spelling variants -------------------------------------------------------------------------------------------------

def brute_words(rows):
    held = Counter()
    for i, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            held[run] += 1
    return {w: n for w, n in held.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k:] == b[k + 1:]


def brute_variants(held):
    out, forms = {}, {}
    for w, n in held.items():
        ns = [v for v in held if near(w, v)]
        best = min(ns, key=lambda v: (-held[v], v), default=None)
        forms[w] = best if best is not None and held[best] >= 10 * n else None
        out[w] = (n, len(ns))
    for w in held:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] += (forms[w], held[forms[w]] if forms[w] else None, root)
    return out


def variants(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def corpus():
    stems = ["receive", "dessert", "aaaaaaaa", "balloon", "committee", "naïveté", "straßen", "ÀÉÎÕÜàéîõü", "x" * 60, "abcdefghij" * 5]
    rows = []
    for i in range(150):
        said = []
        for s in stems:
            said += [s] * RNG.choice([0, 1, 12])
            at = RNG.randrange(len(s))
            if i % 3 == 0:
                said.append(RNG.choice([s[:at] + s[at + 1:], s[:at] + "e" + s[at:], s[:at] + "q" + s[at + 1:], s[:at] + s[at] + s[at:], s.upper()]))
        rows.append((i if i % 10 else None, " ".join(said) + RNG.choice([".", "\n", "1x"])))
    return rows + [(5, None), (6, ""), (7, "x×÷y short"), (7, "x" * 3000), (8, "x" * 3000), (9, "x" * 2999 + " " + "x" * 2999)]


def test_variants_equal_brute_force(spark):
    rows = corpus()
    held = brute_words(rows)
    docs = documents(spark, rows).repartition(3)
    assert {r.word: r.n for r in spelling.words(docs).collect()} == held
    want = brute_variants(held)
    assert variants(spelling.variants(docs)) == want
    assert sum(v[2] is not None for v in want.values()) > 5
    assert spelling.variants(documents(spark, [])).count() == 0


@pytest.mark.parametrize("literal", [0, 9, 10, 100])
def test_hashed_prefixes_give_the_same(spark, literal):
    letters = "aab"
    held = {"".join(RNG.choice(letters) for _ in range(RNG.randrange(7, 13))): RNG.choice([2, 3, 3, 40, 500, 7000]) for _ in range(150)}
    listed = spark.createDataFrame(list(held.items()), "word string, n long")
    assert variants(spelling.group(listed, literal)) == brute_variants(held)


def test_groups_never_exceed_the_alphabet(spark):
    listed = spark.createDataFrame([("".join(RNG.choice("abc") for _ in range(8)), 2) for _ in range(3000)], "word string, n long").distinct()
    most = spelling.rotations(listed).groupBy("prefix").count().agg(F.max("count")).first()[0]
    assert most <= 4
