"""Token counts, packing, fingerprints, language, model scoring and chat formatting against plain versions, and edge cases."""

from __future__ import annotations

import base64
import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortloom.llm import chat, langid, lm_score, packing, spotsigs, token_counts
from cohortloom.llm.bpe import encoder
from cohortloom.llm.common import ship, table, written
from cohortloom.llm.queries import QUERIES, TOKENIZER

SMALL = "/root/testdata/sf0.001"
PROSE = "The house on the hill was old, and the wind from the sea went through it. "
#: id, text, and columns whose names the operators also use inside
EDGE = [
    (1, PROSE * 3, "en", 1, "x", 0),
    (2, None, "en", 1, "x", 0),
    (3, "", None, 1, "x", 0),
    (4, " \n\t  ", "en", 1, "x", 0),
    (5, PROSE * 400 + "end", "en", 1, "x", 0),
    (6, PROSE * 3, "en", 1, "x", 0),
    (6, PROSE * 3, "en", 1, "x", 0),
    (None, "Nobody knows this one.", "en", 1, "x", 0),
    (8, "one", "fr", 1, "x", 0),
    (9, "漢字 and 😀 <|endoftext|>  \n ½'re", "de", 1, "x", 0),
    (10, "!!!", None, 1, "x", 0),
]
SCHEMA = "doc_id long, text string, lang string, id int, steps string, range int"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


def plain(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


WEIRD = ["'s", "'re", "'r", " ", "  ", "\n", "\x0b", "\x1c", "\x85", "\xa0", "a", "é", "word", "123", "½", "!", "'", "''", "<|endoftext|>", "<|endof", "漢字", "😀", "́", "ß", "...", "====", "don't", "ﬁ", "٣"]


def test_ids_and_prefix_counts_equal_the_library(library):
    draw, bpe = random.Random(3), encoder(TOKENIZER)
    for _ in range(400):
        text = "".join(draw.choice(WEIRD) for _ in range(draw.randint(0, 12)))
        assert bpe.ids(text).tolist() == plain(library, text)
        assert np.cumsum(np.frombuffer(bpe.prefix_steps(text), "<i2")).tolist() == [len(plain(library, text[:k])) for k in range(1, len(text) + 1)]


def test_token_counts_of_a_table(spark, library):
    got = {r.doc_id: r for r in QUERIES["op3_token_counts"](spark, SMALL).collect()}
    for r in table(spark, SMALL, "documents").collect():
        n = len(plain(library, r.text))
        assert (got[r.doc_id].n_bytes, got[r.doc_id].n_tokens, got[r.doc_id].over_limit) == (len((r.text or "").encode()), n, n > 512)


def test_token_counts_edges_and_budgets(edge, none, library):
    out = token_counts.prefix_counts(edge, TOKENIZER)
    wide = out.withColumn("at_7", token_counts.tokens_at(F.col("steps"), F.lit(7))).withColumn("fits", token_counts.within(F.col("steps"), F.lit(5)))
    texts = collections.defaultdict(str, {i: t or "" for i, t, *_ in EDGE})
    got = wide.collect()
    assert len(got) == len(EDGE)
    for r in got:
        text = texts[r.doc_id]
        counts = [len(plain(library, text[:k])) for k in range(min(len(text), 60) + 1)]
        assert r.n_tokens == len(plain(library, text)) and r.at_7 == counts[min(7, len(text))]
        assert r.fits == max(k for k, n in enumerate(counts) if n <= 5)
    assert token_counts.prefix_counts(none, TOKENIZER).count() == 0


def check_packing(pieces, capacity=2048):
    by = collections.defaultdict(list)
    for r in pieces:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return by


def test_packing_of_a_table(spark, library):
    got = QUERIES["op4_packing"](spark, SMALL).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    total = 0
    for d in table(spark, SMALL, "documents").collect():
        ids = [*plain(library, d.text), 0]
        total += len(ids)
        own = sorted(by.pop(d.doc_id), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and len(own) == -(-len(ids) // 2048)
        at = 0
        for r in own:
            assert r.start == at and (r.piece == 0 or r.length == 2048)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert not by
    assert len(check_packing(got)) <= -(-total // 2048) * 1.02 + 1


def test_packing_edges(spark, edge, none):
    got = packing.packed_documents(edge, TOKENIZER).collect()
    check_packing(got)
    assert {r.doc_id for r in got} == {i for i, *_ in EDGE} and sum(r.piece == 0 for r in got) == len(EDGE)
    assert [r.length for r in got if r.doc_id in (2, 3)] == [1, 1]
    assert packing.packed_documents(none, TOKENIZER).count() == 0
    # small tasks lose nothing, and existing columns of the added names are replaced
    rows = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), (F.col("id") % 97 + 1).alias("length"), F.lit("old").alias("offset"))
    got = packing.pack(rows, capacity=100, per_task=50).collect()
    assert len(got) == 500 and check_packing(got, 100)


def test_the_place_has_the_smallest_sum_of_squares():
    draw, packer, model = random.Random(1), packing.SumOfSquares(20), collections.Counter()
    gaps = {}
    for _ in range(400):
        length = draw.randint(1, 20)
        options = {}
        for gap in [g for g in model if model[g] and g >= length]:
            after = model.copy()
            after[gap] -= 1
            after[gap - length] += 1
            after[0] = 0
            options[gap] = sum(n * n for n in after.values())
        sequence, offset = packer.place(length)
        gap = 20 - offset
        assert gaps.get(sequence, 20) == gap
        assert (options[gap] == min(options.values())) if options else gap == 20
        if options:
            model[gap] -= 1
        gaps[sequence] = gap - length
        if gap > length:
            model[gap - length] += 1


def plain_fingerprint(docs, i):
    order = sorted(docs, key=lambda d: -d[0])
    at = next(k for k, d in enumerate(order) if d[0] == i)
    text, after = order[at][1] or "", order[(at + 1) % len(order)][1] or ""
    half = len(text) // 2
    return text, text[: len(text) - half] + after[:half], after


def plain_signatures(text):
    words = spotsigs.WORD.findall(text.lower())
    found = set()
    for k, w in enumerate(words):
        if w in spotsigs.ANCHORS:
            chain = [x for x in words[k:] if x not in spotsigs.ANCHORS][:2]
            if len(chain) == 2:
                found.add((w, *chain))
    return found


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_fingerprints_of_a_table(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    got = {r.doc_id: r for r in QUERIES["op7_fingerprints"](spark, SMALL).collect()}
    assert len(got) == len(docs)
    by_text = collections.defaultdict(set)
    for i, _ in docs:
        text, edited, after = plain_fingerprint(docs, i)
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        by_text[text].add(r.fingerprint)
        sets = [plain_signatures(x) for x in (text, edited, after)]
        if all(sets):
            assert len(base64.b64decode(r.fingerprint)) == 4 * len(sets[0])
            assert r.near_edited == pytest.approx(jaccard(sets[0], sets[1])) and r.near_next == pytest.approx(jaccard(sets[0], sets[2]))
    assert all(len(x) == 1 for x in by_text.values())


def test_fingerprint_edges(spark, edge, none):
    got = spotsigs.fingerprints(edge).collect()
    assert len(got) == len(EDGE)
    by = {r.doc_id: r for r in got}
    assert by[2].n_chars == 0 and by[2].fingerprint == "" and by[2].near_edited == 1.0
    assert by[1].fingerprint == by[6].fingerprint != ""
    assert by[10].fingerprint not in ("", by[4].fingerprint)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert by[9].edited_sha256 == hashlib.sha256((EDGE[9][1][: len(EDGE[9][1]) - len(EDGE[9][1]) // 2] + "one"[: len(EDGE[9][1]) // 2]).encode()).hexdigest()
    assert spotsigs.fingerprints(none).count() == 0
    single = spotsigs.fingerprints(spark.createDataFrame([(4, PROSE)], "doc_id long, text string")).first()
    assert single.near_next == 1.0


def test_sizes_rule_out():
    a, b = np.arange(10, dtype=np.uint32), np.arange(2, dtype=np.uint32)
    assert spotsigs.likeness(a, b, 0.5) == 0.0 and spotsigs.likeness(a, b) == 0.2


def plain_grams(text):
    flat = " " + langid.NO_LETTER.sub(" ", text.lower()).strip() + " "
    if flat.strip() == "":
        return collections.Counter()
    return collections.Counter(flat[k : k + n] for n in (1, 2, 3) for k in range(len(flat) - n + 1) if " " not in flat[k : k + n][1:-1] and flat[k : k + n] != " ")


def plain_rank(counter, length):
    code = lambda g: int("".join(f"{ord(c):021b}" for c in g), 2)
    return [g for g, _ in sorted(counter.items(), key=lambda x: (-x[1], code(x[0])))][:length]


def test_language_equals_a_plain_version(spark):
    docs = table(spark, SMALL, "documents")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    totals = collections.defaultdict(collections.Counter)
    for i, text, lang in rows:
        if i not in held:
            totals[lang] += plain_grams(text)
    ranks = {lang: {g: k for k, g in enumerate(plain_rank(c, 400))} for lang, c in sorted(totals.items())}
    got = {r.doc_id: r for r in QUERIES["op10_language"](spark, SMALL).collect()}
    for i, text, lang in rows:
        own = plain_rank(plain_grams(text), 400)
        distance = {x: sum(abs(k - rank[g]) if g in rank else 400 for k, g in enumerate(own)) for x, rank in ranks.items()}
        best = min(distance, key=lambda x: (distance[x], x))
        assert (got[i].held_out, got[i].lang_pred) == (i in held, best)
        assert got[i].score == pytest.approx(1 - distance[best] / (400 * len(own)))
    assert sum(got[i].lang_pred == lang for i, _, lang in rows if i in held) / len(held) > 0.95


def test_language_edges(spark, edge, none):
    profiles = langid.learn(edge)
    got = langid.predict(edge, profiles).collect()
    assert len(got) == len(EDGE)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (2, 3, 4, 10)) and by[1].lang_pred == "en"
    kept = langid.keep_identified(edge, profiles, 0.0)
    assert kept.columns == edge.columns and kept.count() == len(EDGE) - 4
    empty = langid.learn(none)
    assert langid.predict(none, profiles).count() == 0 and {r.lang_pred for r in langid.predict(edge, empty).collect()} == {"und"}
    with pytest.raises(ValueError):
        langid.learn(edge, most_languages=1)


def plain_scores(docs, wanted, strength):
    """The models with plain counts. `docs` has distinct ids."""
    vocab = len({w for _, t in docs for w in lm_score.WORD.findall((t or "").lower())}) + 1
    everything = {k: (collections.Counter(), collections.Counter()) for k in (False, True)}
    seqs = {i: ["\n", *lm_score.WORD.findall((t or "").lower()), "\n"] for i, t in docs}
    for background, (one, two) in everything.items():
        for j, s in seqs.items():
            if background or j in wanted:
                one.update(s[1:])
                two.update(zip(s, s[1:], strict=False))
    full = {k: sum(one.values()) for k, (one, _) in everything.items()}
    out = {}
    for i, seq in seqs.items():
        losses = []
        for background in (False, True):
            own = background or i in wanted
            less, less_two = collections.Counter(seq[1:] if own else []), collections.Counter(zip(seq, seq[1:], strict=False) if own else [])
            one, two = ({k: c[k] - d[k] for k in ks} for c, d, ks in zip(everything[background], (less, less_two), (seq, zip(seq, seq[1:], strict=False)), strict=True))
            scale = max(1, full[False]) / max(1, full[True]) if background else 1.0
            total = (full[background] - less.total()) * scale
            loss = 0.0
            for v, w in zip(seq, seq[1:], strict=False):
                p = (two[v, w] * scale + strength * (one[w] * scale + 1) / (total + vocab)) / (one[v] * scale + strength)
                loss -= math.log(p)
            losses.append(loss / (len(seq) - 1))
        out[i] = (len(seq) - 1, *losses)
    return out


def test_model_scores_equal_a_plain_version(spark):
    docs = [(k, " ".join(random.Random(k).choice(["sun", "rain", "wind", "sea", "."]) for _ in range(k % 7 + 2))) for k in range(30)] + [(98, None), (99, "")]
    wanted = {k for k in range(0, 30, 3)}
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame([(k,) for k in wanted] + [(3,), (None,), (777,)], "doc_id long")
    want = plain_scores(docs, wanted, 5.0)
    for cutting in ({}, {"block_tokens": 20, "shard_keys": 7}, {"block_tokens": 1, "most_broadcast": -1}):
        got = {r.doc_id: r for r in lm_score.score(frame, marks, written, strength=5.0, **cutting).collect()}
        assert_scores(got, want)


def assert_scores(got, want):
    assert set(got) == set(want)
    for i, (n, target, background) in want.items():
        assert (got[i].n_tokens, got[i].loss_target, got[i].loss_background, got[i].score) == (n, pytest.approx(target), pytest.approx(background), pytest.approx(target - background))


def test_model_scores_of_a_table(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    assert len(dict(docs)) == len(docs)
    wanted = {r.doc_id for r in table(spark, SMALL, "labels").filter("quality = 1").collect()}
    assert_scores({r.doc_id: r for r in QUERIES["op9_lm_score"](spark, SMALL).collect()}, plain_scores(docs, wanted, 50.0))


def test_packed_numbers():
    for some in ([], [0, 1, 254, 255, 256, 70_000], [65_534, 65_535, 2**40], [255] * 3):
        for small in (np.uint8, np.uint16):
            assert lm_score.unpacked(lm_score.packed(np.array(some, np.int64), small), len(some), small).tolist() == some


def test_what_the_models_hold_grows_with_the_input(spark):
    docs = spark.range(4000).select(F.concat_ws(" ", *(F.concat(F.lit(f"w{k}x"), "id") for k in range(10))).alias("text"), "id", F.lit(False).alias("wanted"))
    for n in (1000, 4000):
        stored = written(lm_score.blocks(docs.filter(F.col("id") < n), 3000), "blocks")
        added = lm_score.asked(stored, 5).groupBy("shard").applyInArrow(lm_score._added, lm_score.ANSWERS)
        assert added.agg(F.sum("n_words")).first()[0] == 10 * n + 1


def test_model_scores_tell_wanted_text_apart(spark):
    draw = random.Random(5)
    good, other = "river forest mountain valley meadow stream".split(), "price offer click buy discount deal".split()
    docs = [(k, " ".join(draw.choice(good if k % 2 else other) for _ in range(40))) for k in range(120)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marks = frame.filter("doc_id % 2 = 1 and doc_id < 60").select("doc_id")
    got = {r.doc_id: r.score for r in lm_score.score(frame, marks, written).collect()}
    fresh = [k for k in got if k >= 60]
    assert max(got[k] for k in fresh if k % 2) < min(got[k] for k in fresh if not k % 2)


def test_model_score_edges(spark, edge, none):
    marks = edge.filter("doc_id = 1").select("doc_id")
    got = lm_score.score(edge, marks, written).collect()
    assert len(got) == len(EDGE) and all(math.isfinite(r.score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (2, 3, 4)} == {1}
    assert lm_score.score(none, marks, written).count() == 0 and lm_score.score(edge, marks.limit(0), written, most_broadcast=-1).count() == len(EDGE)


def plain_chat(turns):
    """turns: (role, text) in order."""
    whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), whole, len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_of_a_table(spark):
    rows = collections.defaultdict(list)
    for r in table(spark, SMALL, "conversations").collect():
        rows[r.conv_id].append((r.turn, r.role, r.text or ""))
    tricky = r"\### Assistant: </turn> ok"
    want = {c: plain_chat([(r, t) for _, r, t in sorted(x)]) for c, x in rows.items()} | {-7: plain_chat([("user", tricky), ("assistant", tricky)])}
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in QUERIES["op8_chat"](spark, SMALL).collect()}
    assert got == want


PARTS = ["### ", "</turn>", "\\", "\\\\", "\n", "User: ", "### Assistant: ", "x", " ", "@", "#", "</tur", ""]


def test_every_text_survives_the_grammar():
    draw = random.Random(9)
    turns = []
    for k in range(3000):
        role = draw.choice(["user", "assistant", "system", "tool", "User", "", "a:b\\c", "</turn>", "### x: "])
        text = "".join(draw.choice(PARTS) for _ in range(draw.randint(0, 8)))
        done, start, end = chat.render(role, text)
        assert chat.parse(done) == [(role, text)] and chat.unescape(done[start:end]) == text
        turns.append((role, text, done))
    assert chat.parse("".join(d for *_, d in turns)) == [(r, t) for r, t, _ in turns]
    assert chat.render("user", "plain text")[0] == "### User: plain text\n</turn>\n"
    assert chat.parse("### User: no end") is None and chat.parse("junk") is None


def test_long_runs_take_linear_time(library):
    text = "\\" * 60_000 + "</turn>" + "\\" * 60_000
    done, start, end = chat.render("assistant", text)
    assert chat.parse(done) == [("assistant", text)]
    blob = "aB3+/x" * 4000
    assert int(np.frombuffer(encoder(TOKENIZER).prefix_steps(blob), "<i2").sum()) == len(plain(library, blob))
    assert int(np.frombuffer(encoder(TOKENIZER).prefix_steps(" " * 20_000 + "x"), "<i2").sum()) == len(plain(library, " " * 20_000 + "x"))


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string, learn string"
    rows = [(1, 1, "assistant", "b", "x"), (1, 0, "user", "a", "x"), (1, 0, "user", "a", "x"), (2, 0, None, None, "x"), (None, 0, "assistant", "z" * 70_000, "x"), (3, None, "assistant", "", "x")]
    got = {r.conv_id: r for r in chat.digests(chat.formatted_turns(spark.createDataFrame(rows, schema))).collect()}
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == plain_chat([("user", "a"), ("user", "a"), ("assistant", "b")])
    assert got[2].turns_sha256 == plain_chat([("", "")])[1] and got[None].loss_chars == 70_000 and got[3].n_turns == 1
    assert chat.digests(chat.formatted_turns(spark.createDataFrame([], schema))).count() == 0
    turns = chat.formatted_turns(spark.createDataFrame(rows, schema)).filter("conv = 1 and learn").first()
    assert turns.rendered[turns.text_start : turns.text_end] == "b"
    assert written(turns_of := chat.formatted_turns(spark.createDataFrame(rows, schema)), "turns").count() == turns_of.count() == 6
