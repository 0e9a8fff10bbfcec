"""URL filters, licences, decontamination, near duplicates, components and the pipeline against plain versions, and edge cases."""

from __future__ import annotations

import collections
import os
import random
import re
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortloom.llm import decontaminate, licenses, minhash, url_filter
from cohortloom.llm.common import ship, table, written
from cohortloom.llm.components import components
from cohortloom.llm.queries import QUERIES, SQL

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))
from check_oracles import compare, duck  # noqa: E402

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, h string, head int"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def frame(spark, texts):
    """(id, text) pairs with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "h", 2) for i, t in texts], SCHEMA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, SMALL), duck(SMALL), SQL[name]) is None


# --- url filters


def test_a_cascade_is_exact(spark):
    keys = written(spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed")), "keys")
    rows = keys.select("key")
    for most_bytes in (64 << 20, 1000):
        got = url_filter.listed_column(rows, F.col("key"), keys, "listed", bits_per_key=4, hashes=2, most_bytes=most_bytes)
        assert {r.key: r.listed for r in got.collect()} == {r.key: r.listed for r in keys.collect()}
    hashed = keys.select(F.xxhash64("key").alias("a"), F.xxhash64("key", F.lit(1)).alias("b"), "listed")
    assert len(url_filter.build(hashed, bits_per_key=4, hashes=2).levels) > 2


def test_keys_alike_in_their_low_bits_part(spark):
    rows = [((k + 1) << 6, (3 * k + 5) << 6, k < 3) for k in range(40)]
    keys = spark.createDataFrame(rows, "a long, b long, listed boolean")
    cascade = url_filter.build(keys)
    assert cascade.has(np.array([a for a, _, _ in rows]), np.array([b for _, b, _ in rows])).tolist() == [x for *_, x in rows]


def test_urls_and_rules(spark):
    cases = {
        None: ("", "", None), "no scheme/en/": ("", "", None), "http://EXAMPLE.net/en/1?x#y": ("example.net", "/en/1", "example.net/en/"),
        "http://a.example.net/fr/": ("a.example.net", "/fr/", "net/"), "http://anexample.net": ("anexample.net", "", None), "http://x.net/": ("x.net", "/", "net/"),
        "https://a.org/fr/2": ("a.org", "/fr/2", "org/fr/"), "https://a.org/en/://b.net/": ("a.org", "/en/://b.net/", None), "s://h.example.com/de/#/en/": ("h.example.com", "/de/", "example.com/de/"),
        "": ("", "", None), "x://": ("", "", None), "a://É.COM?/de/": ("É.com", "", None),
    }
    rows = [(k, u, "h", "r", True) for k, u in enumerate(cases)]
    pages = spark.createDataFrame([*rows, rows[0], (None, "http://x.net/", "h", "r", True)], "page_id long, url string, host string, rule string, listed boolean")
    from cohortloom.llm.queries import RULES

    got = url_filter.judge(pages, RULES, F.col("host") == "É.com", written).collect()
    assert len(got) == len(cases) + 2
    for r in got:
        if r.page_id is not None:
            host, path, rule = list(cases.values())[r.page_id]
            verdict = {None: "block" if host == "É.com" else "allow", "net/": "block", "example.com/de/": "block"}.get(rule, "allow")
            assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)
    assert url_filter.judge(pages.limit(0), RULES, F.lit(True), written).count() == 0


# --- licences


def plain_licences(text, least=0.9):
    flat = re.sub(r"[^\w\n]+|_", " ", (text or "").lower())
    blocks = [b for b in re.split(r"\n(?: *\n)+", flat) if "\n" in b.strip("\n ")]
    found = collections.defaultdict(list)
    for piece in [*flat.split("\n"), *blocks]:
        words = piece.split()
        grams = {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}
        for name, some in licenses.TEMPLATES.items():
            for template in some:
                other = licenses.bigrams(template)
                dice = 2 * len(grams & other) / (len(grams) + len(other))
                if dice >= least:
                    found[name].append(round(dice, 9))
    return {name: (max(x), len(x)) for name, x in found.items()}


def test_licence_cases(spark):
    mit = licenses.TEMPLATES["mit"][2]
    texts = [
        (1, "A line.\nReleased under the MIT License.\nAnother."), (2, "released UNDER the mit license"), (3, None), (4, ""), (5, " \n\n "),
        (6, "Intro.\n\n" + mit.replace(", ", ",\n") + "\n\nThe end"), (7, "Licensed under the Apache License"), (8, "word " * 30_000 + "\n" + licenses.TEMPLATES["gpl-3.0"][0]),
        (9, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0."), (9, "Licensed under CC BY-NC 4.0."), (None, "Released under the MIT License."),
    ]
    got = collections.defaultdict(dict)
    for r in licenses.scan(frame(spark, texts)).collect():
        got[r.doc_id][r.license] = (r.dice, r.n_lines + r.n_paragraphs)
    for i, t in texts:
        if i != 9:
            assert got[i] == plain_licences(t), i
    assert got[9] == {"cc-by-nc-4.0": (1.0, 2), "cc-by-4.0": (1.0, 1)}
    assert licenses.scan(frame(spark, texts).limit(0)).count() == 0


def test_licence_scan_of_a_table(spark):
    want = {(r.doc_id, n): v for r in table(spark, SMALL, "documents").collect() for n, v in plain_licences(r.text).items()}
    assert {(r.doc_id, r.license): (r.dice, r.n_lines + r.n_paragraphs) for r in QUERIES["op2_licenses"](spark, SMALL).collect()} == want


# --- decontamination


def plain_tokens(text):
    """The rules of `tokens`, one character after the other."""
    out, before = [], ""
    for part in re.findall(r"[^\W_]+", text):
        number = bool(re.fullmatch(r"[0-9]+", part))
        unit = re.search(r"[0-9]$", before) and part.lower() in decontaminate.UNITS.split()
        name = re.match(r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]", part)
        kind = decontaminate.UNIT if unit else decontaminate.NUMBER if number else decontaminate.NAME if name else part.lower()
        out.append((kind, part.lower()))
        before = part
    return out


TEXTS = [
    "Anna has 5 km to go, said Anna. Then Bob Smith: Go 3.5 kg!", "7 hours, 8HOURS; 9. Hours 10 m", "", "   ", "Ünder the Äpfel_und Birnen 12\nKm 4 in", "ALL CAPS Here x1 km y2 Kg", "a. b! C? D: E; F",
]


def test_tokens_by_both_ways(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    got = rows.select("text", decontaminate.tokens(F.col("text")).alias("t"), decontaminate.hashed_tokens(F.col("text")).alias("h"), F.transform(decontaminate.tokens(F.col("text")), lambda x: F.xxhash64(x["token"])).alias("same"))
    for r in got.collect():
        assert [(x.token, x.value) for x in r.t] == plain_tokens(r.text)
        assert r.h == r.same


QUESTION = "A train leaves Boston at 9 hours and travels 120 miles to Albany before it turns back to Boston. How many miles has the train covered in all by then"


def test_reparameterised_questions_are_caught(spark):
    other = QUESTION.replace("Boston", "Dallas").replace("Albany", "Austin").replace("120 miles", "75 km").replace("9", "11")
    muddled = QUESTION.replace("Boston. How", "Tulsa. How").replace("leaves Boston", "leaves Dallas")
    prose = "the quick brown fox jumps over the lazy dog while the rain keeps falling on the old roof of the house "
    docs = [(1, prose + QUESTION + " " + prose), (2, prose + other), (3, prose * 3), (4, None), (5, ""), (6, prose * 4000 + other), (2, prose + other), (None, QUESTION), (7, "tiny item here"), (8, QUESTION[:60]), (9, prose + muddled)]
    items = spark.createDataFrame([(10, QUESTION, 0), (11, QUESTION, 0), (12, None, 0), (13, "", 0), (14, "tiny item here", 0), (15, "Completely different words that no document has in this order at all, none.", 0)], "item_id long, text string, h int")
    for most in (500_000, 0):
        got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(frame(spark, docs), items, written, most_broadcast=most).collect()}
        assert set(got) == {(1, 10), (2, 10), (6, 10), (7, 14), (9, 10)}
    assert got[9, 10].n_found < got[1, 10].n_found <= got[1, 10].n_windows
    empty = frame(spark, docs).limit(0)
    assert decontaminate.contaminated(empty, items, written).count() == 0 and decontaminate.contaminated(frame(spark, docs), items.limit(0), written).count() == 0


def test_contradicting_slots_do_not_count(spark):
    item = "Anna gave Bob 3 apples and then Bob gave Anna 5 pears because Anna likes pears more than Bob likes them"
    mixed_up = "Carl gave Dora 3 apples and then Emil gave Fred 5 pears because Gina likes pears more than Hugo likes them"
    renamed = item.replace("Anna", "Carl").replace("Bob", "Dora")
    docs, items = frame(spark, [(1, renamed), (2, mixed_up)]), spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.contaminated(docs, items, written).collect()] == [1]


def test_worksheets_with_variants_of_one_question(spark):
    item = "Anna gave Bob 3 apples and then Bob gave Anna 5 pears because Anna likes pears more than Bob likes them"
    draw = random.Random(5)
    names = "Carl Dora Emil Fred Gina Hugo Ines Karl Lena Mona Nils Olga".split()

    def variant():
        one, two = draw.sample(names, 2)
        return item.replace("Anna", one).replace("Bob", two).replace("3", str(draw.randrange(10, 99))).replace("5", str(draw.randrange(10, 99)))

    sheets = [(k, ". ".join(variant() for _ in range(many))) for k, many in enumerate([1, 2, 3, 3, 5, 20, 20, 20])]
    apart = [(100 + k, " and some other words stand here until the next one comes at last ".join(variant() for _ in range(3))) for k in range(3)]
    muddled = ". ".join("Carl gave Dora 3 apples and then Emil gave Fred 5 pears because Gina likes pears more than Hugo likes them" for _ in range(3))
    twice = [(300, variant()), (300, variant()), (300, variant())]
    docs = frame(spark, [*sheets, *apart, (200, muddled), *twice])
    got = decontaminate.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), written).collect()
    assert {r.doc_id for r in got} == {k for k, _ in [*sheets, *apart, *twice]}
    kinds = [t for t, _ in plain_tokens(item)]
    windows = [kinds[k : k + 8] for k in range(len(kinds) - 7)]
    marks = (decontaminate.NUMBER, decontaminate.UNIT, decontaminate.NAME)
    enough = sum(sum(t not in marks for t in x) >= 4 for x in windows)
    assert {(r.n_windows, r.n_found) for r in got} == {(len(windows), enough)}


@pytest.mark.parametrize("size", range(1, 10))
def test_windows_have_the_hash_of_what_is_in_them(spark, size):
    lists = [list("abcabcabcaabbccddabc"), list("abcabcab"), ["a"] * 5, [], ["a"]]
    rows = spark.createDataFrame([(x,) for x in lists], "words array<string>")
    meaning = {}
    for r in rows.select("words", decontaminate._windows(F.transform("words", lambda w: F.xxhash64(w)), size).alias("h")).collect():
        runs = [tuple(r.words[k : k + size]) for k in range(len(r.words) - size + 1)]
        assert len(r.h) == len(runs)
        for h, run in zip(r.h, runs, strict=True):
            assert meaning.setdefault(h, run) == run
    assert len(set(meaning.values())) == len(meaning)


def test_names_that_start_sentences(spark):
    item = "Mary has 3 red apples and 5 green pears. Tom has 3 times as many apples as Mary. Mary gives Tom 2 pears. How many pears does Mary have now, and how many apples has Tom?"
    renamed = item.replace("Mary", "Anna").replace("Tom", "Peter").replace("3 red", "7 red").replace("3 times", "7 times").replace("5 green", "9 green")
    other = "Mary likes to walk in the hills. Tom has never seen them. How many hills has the land, and how many of them does Mary know by now? Nobody has asked her."
    docs, items = frame(spark, [(1, item), (2, renamed), (3, other), (4, "\x04".join(renamed.split(" ")))]), spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contaminated(docs, items, written).collect()} == {1, 2, 4}


def test_long_quotes_of_longer_items(spark):
    draw = random.Random(3)
    words = [draw.choice("river stone winter lamp garden copper engine letter window salt".split()) + str(k % 7) for k in range(150)]
    prose = "the old mill stands at the river and nobody has seen its owner for years "
    cut_at = {1: (40, 100), 2: (40, 65), 3: (40, 64), 4: (0, 150)}
    docs = [(k, prose + " ".join(words[a:b]) + " " + prose) for k, (a, b) in cut_at.items()]
    docs.append((5, " ".join(" ".join(words[a : a + 15]) + " " + prose for a in (0, 50, 100))))
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    for most in (500_000, 0):
        got = {r.doc_id: r.n_found for r in decontaminate.contaminated(frame(spark, docs), items, written, most_broadcast=most).collect()}
        assert got == {1: 53, 2: 18, 4: 143}


def test_items_without_plain_words_are_found_verbatim(spark):
    sums, prose = "Solve 12 x 7 + 5 x 9 + 3 x 8", "the old mill stands at the river and nobody has seen its owner for years "
    docs = frame(spark, [(1, prose + sums + " " + prose), (2, prose + "Solve 13 x 6 + 4 x 2 + 9 x 1"), (3, prose), (4, sums.upper())])
    items = spark.createDataFrame([(1, sums)], "item_id long, text string")
    for most in (500_000, 0):
        got = decontaminate.contaminated(docs, items, written, most_broadcast=most).collect()
        assert sorted((r.doc_id, r.item_id, r.n_windows, r.n_found) for r in got) == [(1, 1, 3, 3), (4, 1, 3, 3)]


def test_verbatim_copies_in_another_case_are_found(spark):
    docs, items = frame(spark, [(1, QUESTION.lower()), (2, QUESTION.upper()), (3, QUESTION.lower()[:50])]), spark.createDataFrame([(1, QUESTION)], "item_id long, text string")
    got = decontaminate.contaminated(docs, items, written).collect()
    assert {r.doc_id for r in got} == {1, 2} and all(r.n_found == r.n_windows for r in got)


def test_decontamination_of_a_table(spark):
    items = [(r.item_id, plain_tokens(r.text)) for r in table(spark, SMALL, "benchmark").collect()]
    want = set()
    for d in table(spark, SMALL, "documents").collect():
        toks = [t for t, _ in plain_tokens(d.text)]
        seen = {tuple(toks[k : k + 8]) for k in range(len(toks) - 7)}
        for i, item in items:
            own = [tuple(t for t, _ in item[k : k + 8]) for k in range(max(1, len(item) - 7))]
            if sum(w in seen for w in own) >= 0.5 * len(own):
                want.add((d.doc_id, i))
    assert want and {(r.doc_id, r.item_id) for r in QUERIES["op5_decontamination"](spark, SMALL).collect()} == want


# --- near duplicates


def plain_groups(texts, percent=75):
    sets = {}
    for i, t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = collections.defaultdict(list)
    for i, s in sorted(sets.items()):
        common = collections.Counter(j for x in s for j in where[x])
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for x in s:
            where[x].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def groups(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect() if r.doc_id is not None}


def test_groups_of_a_table(spark):
    texts = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    out = QUERIES["op6_near_duplicates"](spark, SMALL)
    want = plain_groups(texts)
    assert groups(out) == want and len({c for _, c in want.values()}) < len(want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.collect())


def test_families_of_edited_copies(spark):
    draw, texts = random.Random(7), []
    vocabulary = [f"w{k}" for k in range(400)]
    shared = [draw.choice(vocabulary) for _ in range(60)]
    for family in range(12):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([8, 30, 120]))]
        for _ in range(draw.choice([1, 3, 25])):
            copy = list(base)
            for _ in range(draw.randint(0, max(1, len(copy) // 40))):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            texts.append(copy + shared * (family % 3 == 0))
        texts.append([*base, draw.choice(vocabulary)])
        texts.append(base)
    docs = [(k, " ".join(t)) for k, t in enumerate(draw.sample(texts, len(texts)))]
    assert groups(minhash.near_duplicates(frame(spark, docs), written)) == plain_groups(docs)


def test_a_crowd_of_copies_with_few_links_at_its_edge(spark):
    draw = random.Random(11)
    base = [f"b{k}" for k in range(150)]
    docs = []
    for k in range(400):
        copy = list(base)
        for at in draw.sample(range(150), min(12, int(draw.expovariate(0.3)))):
            copy[at] = f"x{draw.randrange(50)}"
        docs.append((k, " ".join(copy)))
    want = plain_groups(docs)
    assert len({c for _, c in want.values()}) > 3
    assert groups(minhash.near_duplicates(frame(spark, docs), written)) == want


def family(documents, most, seed):
    """Copies of one text of 150 words, 3 to `most` of them replaced."""
    draw = random.Random(seed)
    base, docs = [f"b{k}" for k in range(150)], []
    for k in range(documents):
        copy = list(base)
        for at in draw.sample(range(150), draw.randint(3, most)):
            copy[at] = f"x{draw.randrange(100_000)}"
        docs.append((k, " ".join(copy)))
    return docs


def test_members_of_a_bucket_that_the_centres_do_not_match(spark):
    docs = family(1200, 12, 5)
    want = plain_groups(docs)
    assert len({c for _, c in want.values()}) > 10
    assert groups(minhash.near_duplicates(frame(spark, docs), written)) == want
    # with one bucket for all and no round around centres, every pair across groups is compared
    some = family(60, 12, 6)
    out = minhash.near_duplicates(frame(spark, some), written, bands=240, rows=1, rounds=0)
    assert groups(out) == plain_groups(some)


def test_near_duplicate_edges(spark):
    docs = [(5, "A b c"), (3, "a  B\tC"), (9, None), (2, ""), (4, " \n"), (8, "one two three four five six seven eight nine ten"), (8, "one two three four five six seven eight nine ten"), (None, "a b c"), (7, "x " * 50_000), (6, "X " * 60_000 + "x"), (10, "a b c\x1cd")]
    out = minhash.near_duplicates(frame(spark, docs), written)
    assert out.count() == len(docs)
    assert groups(out) == plain_groups([d for d in docs if d[0] is not None])
    nobody = out.filter("doc_id is null").first()
    assert nobody.component_id is None and nobody.kept
    assert minhash.near_duplicates(frame(spark, docs).limit(0), written).count() == 0


def test_empty_bins_keep_the_similarity():
    rng = np.random.default_rng(1)
    agree = []
    for _ in range(150):
        both = rng.integers(0, 2**63, 40).astype(np.uint64)
        a, b = np.unique(both[:35]), np.unique(both[5:])
        agree.append(np.mean(minhash.buckets(a, 240, 1) == minhash.buckets(b, 240, 1)))
    assert abs(np.mean(agree) - 30 / 40) < 0.02


def test_components(spark):
    draw = random.Random(2)
    links = [(k, k + 1) for k in range(100, 160)] + [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(7, 7), (3, 2), (2, 3), (None, 5), (500, 400)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), written).collect()}
    parent = {x: x for link in links if None not in link for x in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long"), written).count() == 0


# --- pipeline


def test_pipeline_stages(spark):
    docs = table(spark, SMALL, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "benchmark_passages", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    one = written(stage["language"](spark, docs, SMALL), "one")
    assert one.columns == docs.columns and one.count() == docs.count()
    two = written(stage["near_duplicates"](spark, one, SMALL), "two")
    want = plain_groups([(r.doc_id, r.text) for r in one.collect()])
    assert two.columns == docs.columns and {r.doc_id for r in two.collect()} == {i for i, (_, c) in want.items() if c == i}
    three = written(stage["benchmark_passages"](spark, two, SMALL), "three")
    gone = {r.doc_id for r in decontaminate.contaminated(two, table(spark, SMALL, "benchmark"), written).collect()}
    assert three.columns == docs.columns and {r.doc_id for r in three.collect()} == {r.doc_id for r in two.collect()} - gone and gone
    four = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in four} == {r.doc_id for r in three.collect()}


def test_pipeline_stage_edges(spark, tmp_path):
    extra = [(2001, "one", "xx"), (2002, "!!!", "en"), (2003, None, "en"), (None, "The wind and the rain on the hill.", "en"), (0, None, None)]
    real = table(spark, SMALL, "documents")
    rows = spark.createDataFrame([(i, t, x, "s", 1) for i, t, x in extra], real.schema)
    docs = written(real.union(rows).union(real.filter("doc_id < 3")), "docs")
    for name, f in corpus_pipeline.STAGES[:3]:
        out = f(spark, docs, SMALL)
        assert out.columns == real.columns
        docs = written(out, name)
    ids = [r.doc_id for r in docs.collect()]
    assert len(ids) == len(set(ids)) and None in ids and not {2002, 2003} & set(ids)
    nothing = real.limit(0)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, nothing, SMALL).count() == 0
