"""The training-data operators on small fixtures: brute force, round trips, held-out accuracy and odd inputs."""

from __future__ import annotations

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirelake.llm import chat, decontaminate, exact_dedup, jaccard_join, language, mixing, quality, substring_dedup, suffix_lm, toxicity
from quirelake.llm.groups import planes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words_of(text):
    return [w for w in SPACE.split(text or "") if w]


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.paretovariate(0.7)) % vocabulary}x" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, repeats, blanks, nulls, a long text, odd characters."""
    rng = random.Random(4)
    passage = prose(rng, 60)
    rows = []
    for i in range(60):
        rows.append(prose(rng, rng.randint(1, 150)))
    for i in range(8):
        rows.append(rows[5])
    for i in range(12):
        w = rows[7].split() + ["tail"] * 3
        w[rng.randrange(len(w))] = f"changed{i}"
        rows.append(" ".join(w))
    for i in range(6):
        rows.append(f"{prose(rng, 20)} {passage} {prose(rng, 10)}")
    rows += ["", " \n\t", None, "a b c", "a  b\nc", "ünï <|im_end|> 日本語  nbsp", rows[5] + "\n", " ".join(["rep"] * 90), f"{passage} {passage}", prose(rng, 9000)]
    return [(i, t, "en", f"s{i % 3}" if i % 10 else None, 1) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    """With repeated rows and columns whose names the operators use themselves."""
    df = spark.createDataFrame([*corpus, corpus[0], (None, "no id", None, None, None)], DOCS)
    return df.selectExpr("*", "1 AS rid", "'x' AS key", "2 AS size", "3 AS h", "4 AS mark", "5 AS t", "6 AS kept").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id < -1")


@pytest.fixture(scope="module")
def all_rows(corpus):
    return [(r[0], r[1]) for r in corpus] + [(corpus[0][0], corpus[0][1]), (None, "no id")]


def id_order(i):
    return (i is None, i or 0)


# exact dedup


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**48 - 1), unique=True, max_size=200))
def test_rice(values):
    x = np.array(sorted(values), np.uint64)
    assert (exact_dedup.rice_decode(exact_dedup.rice_encode(x)) == x).all()


def test_exact_dedup(docs, none, all_rows):
    norm = lambda t: SPACE.sub("", t or "")
    groups = {}
    for i, t in all_rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), id_order(i), i))
    want = sorted((repr(i), repr(min(groups[norm(t)], key=lambda x: x[:2])[2]), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in all_rows)
    got = exact_dedup.exact_dedup(docs, unit=20).collect()
    assert sorted((repr(r.doc_id), repr(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_few_fingerprint_bits_change_nothing(docs):
    rows = lambda **kw: sorted(map(repr, exact_dedup.exact_dedup(docs, **kw).select("doc_id", "keep_id", "group_size").collect()))
    assert rows(fp_bits=4) == rows() == rows(broadcast_bytes=0)


def test_drop_copies(docs, all_rows):
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns
    assert got.count() == len({SPACE.sub("", t or "") for _, t in all_rows})


# n-gram join


def brute_links(rows):
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    links = [{j for j in range(len(sets)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9} for i in range(len(sets))]
    root = list(range(len(sets)))
    for _ in root:
        for i, near in enumerate(links):
            root[i] = min([root[i], *(root[j] for j in near)])
    return sets, links, root


@pytest.mark.parametrize("kw", [{}, {"small": 2, "brute": 3, "block": 4}])
def test_jaccard_join(docs, none, all_rows, kw):
    sets, links, root = brute_links(all_rows)
    least = {}
    for i, (doc, _) in enumerate(all_rows):
        least[root[i]] = min(least.get(root[i], doc), doc, key=id_order)
    want = sorted((repr(d), len(links[i]), repr(least[root[i]]), len(sets[i])) for i, (d, _) in enumerate(all_rows))
    got = jaccard_join.jaccard_join(docs, **kw).collect()
    assert sorted((repr(r.doc_id), r.n_links, repr(r.class_id), r.n_shingles) for r in got) == want
    if not kw:
        assert jaccard_join.jaccard_join(none).count() == 0


def test_drop_near_copies(docs, all_rows):
    _, _, root = brute_links(all_rows)
    got = jaccard_join.drop_near_copies(docs)
    assert got.columns == docs.columns and got.count() == len(set(root))


def test_recall():
    assert jaccard_join.recall(0.8, 0, 1) == pytest.approx(0.8)
    assert jaccard_join.recall(1, 0.25, 4) == pytest.approx(1)


# chat


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("ab\\\n<|im_end>start", max_size=30), st.text("<|\\im_stardn>é日\n", max_size=40)), min_size=1, max_size=6))
def test_chat_round_trip(turns):
    n = len(turns)
    batch = pa.RecordBatch.from_arrays([pa.array([1] * n), pa.array([False] * n), pa.array([r for r, _ in turns]), pa.array([t for _, t in turns])], ["conv", "none", "role", "text"])
    out = next(chat.format_blocks(iter([batch]), 1 << 20, "assistant")).to_pylist()
    assert chat.parse(out[0]["formatted"]) == turns


def test_chats(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 1, "assistant", "b é"), (1, 0, "user", "a"), (1, 2, None, None), (2, 0, "assistant", said), (2, 0, "assistant", said), (None, 0, "user", "x"), (None, None, "assistant", "first"), (3, 0, "assistant", "y" * 5000), (3, 1, "assistant", "z" * 5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS conv", "2 AS part", "3 AS none")
    for most in (1 << 20, 100):  # conversations in one part, and in several
        got = {r.conv_id: r for r in chat.digests(chat.format_chats(df, bytes_most=most)).collect()}
        for conv in (1, 2, 3, None):
            mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
            assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine).encode()).hexdigest()
            loss = "".join(r[3] for r in mine if r[2] == "assistant")
            assert (got[conv].n_turns, got[conv].loss_chars, got[conv].loss_sha256) == (len(mine), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_chats(df.where("conv_id > 9")).count() == 0


# mixing


def test_targets():
    assert mixing.targets([100, 100], [1, 1], 1.5, 2) == [150, 150]
    assert mixing.targets([10, 100], [5, 1], 1.5, 2) == [20, 145]
    assert mixing.targets([0, 10], [1, 1], 5, 2) == [0, 20]


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(0, 40), st.integers(1, 9), min_size=1, max_size=8), st.floats(0, 1))
def test_fit(hist, part):
    sizes, counts = np.array(list(hist)), np.array(list(hist.values()))
    total = int((sizes * counts).sum())
    budget = round(total * part)
    take = mixing.fit(sizes, counts, budget, 1 << 16)
    reach = {0}
    for s, c in hist.items():
        reach = {r + k * s for r in reach for k in range(c + 1)}
    assert ((take >= 0) & (take <= counts)).all()
    assert (sizes * take).sum() == max(r for r in reach if r <= budget)


def test_fit_with_long_texts():
    """Budgets far above the window, and single lengths above it."""
    rng = random.Random(5)
    sizes = np.array(sorted({rng.randint(1, 300_000) for _ in range(400)}))
    counts = np.array([rng.randint(1, 4) for _ in sizes])
    for part in (0.01, 0.3, 0.9):
        budget = int((sizes * counts).sum() * part)
        take = mixing.fit(sizes, counts, budget, 1 << 16)
        assert ((take >= 0) & (take <= counts)).all() and budget - 50 < (sizes * take).sum() <= budget
    assert mixing.fit(np.array([5_000_000, 7_000_000]), np.array([2, 1]), 9_000_000, 1 << 10).tolist() == [0, 1]


def test_mix(docs, none, all_rows):
    got = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(5), group=2).collect()
    assert len(got) == len(all_rows)
    sizes = sum(len(words_of(t)) for _, t in all_rows)
    assert sum(r["size"] for r in got) == sizes
    by = {}
    for r in got:
        assert r.taken in (0, r["size"], 2 * r["size"]) and r.taken == r.copies * r["size"]
        by.setdefault(r.source, [r.target, r.source_size, 0])[2] += r.taken
    longest = {}
    for r in got:
        longest[r.source] = max(longest.get(r.source, 0), r["size"])
    assert all(n <= t + 1 and t <= 2 * s and t - n <= (1 if longest[k] < 5000 else longest[k]) for k, (t, s, n) in by.items())
    assert {s: sum(r.taken for r in again if r.source == s) for s in by} == {s: v[2] for s, v in by.items()}
    same = mixing.mix_sources(docs.repartition(2)).collect()
    assert sorted(map(repr, same)) == sorted(map(repr, got))
    assert mixing.mix_sources(none).count() == 0


# language


def speak(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_language(spark):
    rng = random.Random(1)
    kinds = {"aa": "aaabcde", "bb": "bdfgghé", "cc": "жзиик日"}
    rows = [(i, speak(rng, kinds[k], rng.randint(8, 40)), k, "s", 1) for i, k in enumerate(list(kinds) * 40)]
    odd = [(900, None, "aa", None, 1), (901, "12 34 !", "bb", None, 1), (902, "", None, None, 1), (903, "zzz " * 3000, None, None, 1), (None, "aaab", "cc", None, 1)]
    df = spark.createDataFrame(rows + odd, DOCS).selectExpr("*", "1 AS t", "2 AS held_out", "3 AS y", "4 AS rank")
    profiles = language.learn_profiles(df)
    got = {r.doc_id: r for r in language.predict_language(df, profiles).collect()}
    assert all(got[i].lang_pred == k for i, _, k, *_ in rows)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 0) for i, r in got.items())
    empty = language.learn_profiles(df.where("doc_id < 0"))
    assert {r.lang_pred for r in language.predict_language(df, empty).collect()} == {"und"}
    assert language.predict_language(df.where("doc_id < -1"), profiles).count() == 0


def test_profile_distance():
    p = language.Profiles({"x": [int(k) for k in language.ranked(*language.gram_counts("abab abab"), 50)], "y": [int(k) for k in language.ranked(*language.gram_counts("zyx"), 50)]}, 50)
    assert p.predict("abab abab") == ("x", 1.0)


# classifiers


def labelled(spark, rows, name):
    return spark.createDataFrame([(i, y) for i, _, y in rows if y is not None], f"doc_id long, {name} int")


def test_toxicity(spark):
    rng = random.Random(2)
    insults, groups = ["oaf", "dolt"], ["glorps", "zanders"]
    rows = []
    for i in range(900):  # toxic only where an insult meets a group
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w = [f"n{rng.randrange(300)}" for _ in range(30)] + ([rng.choice(insults)] if a else []) + ([rng.choice(groups)] if b else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w), int(a and b)))
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t, _ in rows] + [(9001, None, None, None, 0), (9002, "", None, None, 0)], DOCS).selectExpr("*", "1 AS t", "2 AS y", "3 AS id")
    labels = labelled(spark, rows, "toxic")
    model = toxicity.learn_toxicity(df, labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, model).collect()}
    held = [(got[i], y) for i, _, y in rows if got[i].held_out]
    assert len(held) > 100 and np.mean([r.predicted == y for r, y in held]) > 0.95
    assert got[9001].predicted == got[9002].predicted == 0
    unknown = toxicity.learn_toxicity(df, labels.where("doc_id < 0"))
    assert {round(r.score, 6) for r in toxicity.score_toxicity(df, unknown).collect()} == {0.5}
    assert toxicity.score_toxicity(df.where("doc_id < -1"), model).count() == 0


def test_toxicity_of_pairs_alone(spark):
    """No term tells by itself: either pair of the same kind is toxic, mixed ones aren't."""
    rng, rows = random.Random(7), []
    for i in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w = [f"n{rng.randrange(300)}" for _ in range(12)] + ["oaf" if a else "dear", "glorps" if b else "tables"]
        rng.shuffle(w)
        rows.append((i, " ".join(w), int(a == b)))
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t, _ in rows], DOCS)
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, toxicity.learn_toxicity(df, labelled(spark, rows, "toxic"))).collect()}
    held = [got[i].predicted == y for i, _, y in rows if got[i].held_out]
    assert len(held) > 150 and np.mean(held) > 0.95, np.mean(held)


def test_quality(spark):
    rng = random.Random(3)
    good = lambda: prose(rng, 12).capitalize() + "."
    bad = lambda: " | ".join(prose(rng, 1) + "###" for _ in range(8))
    rows = []
    for i in range(500):
        y = rng.random() < 0.7
        lines = [good() for _ in range(rng.randint(2, 6))] if y else [bad() if rng.random() < 0.7 else good() for _ in range(rng.randint(3, 6))]
        if not y:
            lines[1] = bad()
        rows.append((i, "\n".join(lines), int(y)))
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t, _ in rows] + [(9001, None, None, None, 0), (9002, " \n\n", None, None, 0), (9003, good() * 3000, None, None, 0)], DOCS).selectExpr("*", "1 AS t", "2 AS y")
    model = quality.learn_quality(df, labelled(spark, rows, "quality"))
    got = {r.doc_id: r for r in quality.score_quality(df, model).collect()}
    held = [(got[i], y) for i, _, y in rows if got[i].held_out]
    assert np.mean([r.predicted == y for r, y in held]) > 0.95
    assert got[9001].score == got[9002].score == min(r.score for r in got.values())
    kept = quality.drop_rejected(df, model)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}
    unknown = quality.learn_quality(df, labelled(spark, rows[:0] + rows[:1], "quality"))
    assert {r.score for r in quality.score_quality(df, unknown).collect()} == {0.5}


def test_field_by_enumeration():
    rng = np.random.default_rng(0)
    pull, trans = rng.normal(size=4), rng.normal(size=(2, 2))
    good, joint, z = quality.forward_backward(pull, trans, np.array([0]), np.array([4]))
    paths = [[b >> i & 1 for i in range(4)] for b in range(16)]
    weight = np.array([math.exp(sum(pull[i] * p[i] for i in range(4)) + sum(trans[p[i], p[i + 1]] for i in range(3))) for p in paths])
    assert z == pytest.approx(math.log(weight.sum()))
    assert good == pytest.approx([sum(w for w, p in zip(weight, paths) if p[i]) / weight.sum() for i in range(4)])
    assert joint[1, 0] == pytest.approx(sum(w * sum(p[i] == 1 and p[i + 1] == 0 for i in range(3)) for w, p in zip(weight, paths)) / weight.sum())


@pytest.mark.parametrize("lengths", [[4, 1, 9], [300, 2, 700, 1]])
def test_long_chains(lengths):
    """By doubling as line by line."""
    rng = np.random.default_rng(1)
    pull, trans, lengths = rng.normal(size=sum(lengths)), rng.normal(size=(2, 2)), np.array(lengths)
    begins = np.cumsum(lengths) - lengths
    for one, other in zip(quality.forward_backward(pull, trans, begins, lengths, deep=0), quality.forward_backward(pull, trans, begins, lengths, deep=10_000)):
        assert other == pytest.approx(one)


def test_margin_of_pairs():
    model = toxicity.FactorMachine(np.arange(6), np.ones(6, bool), 3, 1)
    model.w, model.bias = np.arange(6) / 7, 0.3
    row = [0, 2, 3, 5]
    want = 0.3 + sum(model.w[i] for i in row) + sum(model.v[i] @ model.v[j] for i in row for j in row if i < j)
    assert model.margin([row, []]) == pytest.approx([want, 0.3])


def test_line_features_by_hand():
    x, size, owner = quality.line_features([b"De De De a1.", b"", b"| x\n\nB#"])
    assert owner.tolist() == [0, 2, 2] and size.tolist() == [12, 3, 2]
    assert x[0, 6] == pytest.approx(0.5) and x[0, 8] == pytest.approx(0.5) and x[1, 4] == pytest.approx(0.5) and x[2, 0] == pytest.approx(0.5)


# decontamination


def test_leaks(spark):
    question = "A train leaves Boston at 60 km per hour and after 3 hours it meets another train that left Denver at 60 km per hour"
    other = "the quick brown fox jumps over the lazy dog while seven green parrots sing loudly"
    bench = spark.createDataFrame([(1, question), (1, question), (2, other), (3, None), (4, "too short"), (5, "one two three four five six")], "item_id long, text string")
    changed = question.replace("60", "80").replace("Boston", "Paris")
    inconsistent = question.replace("60", "80", 1)
    rows = [(1, f"before it. {question} after"), (2, f"X y. {changed}. End."), (3, inconsistent), (4, f"lead {other.upper()} tail"), (5, "nothing of the kind " * 50), (6, None), (7, ""), (8, "so one two three four five six seven"), (9, other[:30]), (9, f"{other} and {question}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS rid", "2 AS h", "3 AS pos", "4 AS item_id")
    got = sorted((r.doc_id, r.item_id, r.n_changed) for r in decontaminate.find_leaks(df, bench).collect())
    assert got == [(1, 1, 0), (2, 1, 2), (4, 2, 0), (8, 5, 0), (9, 1, 0), (9, 2, 0)]
    kept = decontaminate.drop_leaks(df, bench)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, (r.text or "")[:5]) for r in kept.collect()) == [(3, "A tra"), (5, "nothi"), (6, ""), (7, ""), (9, "the q")]
    assert decontaminate.find_leaks(df, bench.where("item_id > 9")).count() == 0
    assert decontaminate.find_leaks(df.where("doc_id > 99"), bench).count() == 0


def found_leaks(spark, items, texts):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted((r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, bench).collect())


def test_leaks_whatever_stands_before(spark):
    """The start of a passage or sentence is no other token for what precedes it."""
    short = "Every green parrot sings loudly over the old stone bridge"
    question = "Tom has 5 apples and some pears. Tom eats 2. How many apples does he keep"
    named = question.replace("Tom", "Anna").replace("5", "7").replace("2", "3")
    texts = [f"it goes on with {short} and so on", f"so {short.lower()} again", f"End. {named}", f"and then {named}", "Every green parrot sings loudly over the new stone bridge"]
    assert found_leaks(spark, [short, question], texts) == [(0, 0), (1, 0), (2, 1), (3, 1)]


def test_leaks_by_run(spark):
    """Two values may become one, and a run whose slots disagree takes no other run with it."""
    equal = "the shop had 5 apples and 3 pears in it when we came"
    first = "a train left town at 60 km per hour and met another one that came at 60 km per hour later on"
    second = "while the quick brown fox jumps over the lazy dog and seven green parrots sing all day"
    item = f"{first} so they say and all agree with it {second}"
    text = f"{first.replace('60', '80', 1)} as it was told by some people here {second}"
    assert found_leaks(spark, [equal, item], [equal.replace("5", "4").replace("3", "4"), text.replace("by some", "some"), text]) == [(0, 0), (1, 1), (2, 1)]


def test_leaks_without_template(spark):
    """Items of numbers, of names and of few words are found as they are written."""
    items = ["12 + 34 = 46 56 - 7 = 49 8 * 9 = 72", "The Old Man And The Sea Of Green Parrots From Paris", "4 + 5 = 9", "green parrots sing"]
    texts = [f"before it {x} after it" for x in items]
    assert found_leaks(spark, items, [*texts, texts[1].replace("Old", "New"), texts[2].replace("5", "6"), "green birds sing", "green parrots sing, and Green parrots sing!"]) == [(0, 0), (1, 1), (2, 2), (3, 3), (7, 3)]


# language model


def brute_tree(rows, settings_):
    """The suffix tree by dictionaries, without hashes, groups or owners."""
    docs_ = [(zlib.crc32(str(i).encode() if i is not None else b"") % 10 != 0, [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in words_of(t)] + [None]) for i, t in rows]
    c = Counter(w for train, ws in docs_ if train for w in ws)
    n, v = sum(c.values()), len(c)
    base = lambda w: (c[w] + 0.1) / (n + 0.1 * (v + 1))
    least, pair, beta, cost = (settings_[k] for k in ("least_context", "least_pair", "beta", "cost"))
    quant = lambda p: 2 ** -(min(255, round(-8 * math.log2(p))) / 8)
    levels = []

    def prob(ctx, w):
        """Probability of w after the words ctx, by the levels made so far."""
        p, ok = base(w), c[w] >= pair
        for d, (counts, kept, sizes) in enumerate(levels, 1):
            if len(ctx) < d:
                break
            s = tuple(ctx[-d:])
            if sizes.get(s, 0) < least:
                break
            k = counts.get((s, w), 0) if ok else 0
            k = k if k >= pair else 0
            if s in kept:
                p = k / (sizes[s] + beta) + kept[s] * p
            ok = k >= pair
        return p

    def eligible(ctx, w, d):
        """Whether w may be a symbol of its own in the context of depth d."""
        if d == 1:
            return c[w] >= pair
        counts, _, sizes = levels[d - 2]
        s = tuple(ctx[-(d - 1) :])
        return sizes.get(s, 0) >= least and eligible(ctx, w, d - 1) and counts.get((s, w), 0) >= pair

    for d in range(1, settings_["depth"] + 1):
        counts, sizes, symbols = Counter(), {}, {}
        for train, ws in docs_:
            for i in range(d, len(ws)):
                s = tuple(ws[i - d : i])
                size = c[s[0]] if d == 1 else (levels[d - 2][0].get((s[:-1], s[-1]), 0) if eligible(s[:-1], s[-1], d - 1) and levels[d - 2][2].get(s[:-1], 0) >= least else 0)
                if size < least:
                    continue
                sizes[s] = size
                if eligible(ws[i - d : i], ws[i], d):
                    symbols.setdefault(s, {})[ws[i]] = quant(prob(ws[max(0, i - d) : i], ws[i]))
                    if train:
                        counts[s, ws[i]] += 1
        kept = {}
        for s, of in symbols.items():
            ks = {w: counts[s, w] for w in of if counts[s, w] >= pair}
            rest, mass = max(0, sizes[s] - sum(ks.values())), min(sum(of[w] for w in ks), 1 - 1e-9)
            gain = sum(k * math.log(k / sizes[s] / of[w]) for w, k in ks.items()) + (rest * math.log(rest / sizes[s] / (1 - mass)) if rest else 0)
            if ks and gain > cost * len(ks) * math.log(max(sizes[s], 2)):
                kept[s] = (beta + rest) / (sizes[s] + beta)
        levels.append((counts, kept, sizes))
        if not kept:
            break
    out = []
    for (i, _), (_, ws) in zip(rows, docs_, strict=True):
        out.append((repr(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10(base(w)) for w in ws), sum(math.log10(prob(ws[:k], w)) for k, w in enumerate(ws))))
    return sorted(out)


@pytest.mark.parametrize("depth, kw", [(2, {}), (5, {"group_bytes": 2000, "owner_bytes": 3000}), (5, {"hot": 5, "group_bytes": 3000, "owner_bytes": 3000})])
def test_suffix_lm(docs, none, all_rows, depth, kw):
    """Also with many owners, and with contexts split over them by their symbols."""
    tuned = {"depth": depth, "least_context": 4, "least_pair": 2, "beta": 1.0, "cost": 0.5}
    want = brute_tree(all_rows, tuned)
    got = sorted((repr(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in suffix_lm.score_documents(docs, **tuned, **kw).collect())
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert [x for g in got for x in g[4:]] == pytest.approx([x for w in want for x in w[4:]], rel=1e-5)
    assert sum(g[5] for g in got) > sum(g[4] for g in got)
    if not kw:
        assert suffix_lm.score_documents(none).count() == 0


def context_lists(groups, contexts, symbols):
    """Lists of contexts for an owner, as groups send them: each has every context, with other symbols; every tenth is a part of a split one."""
    rng, out = np.random.default_rng(5), []
    for _ in range(groups):
        sym = np.sort(rng.integers(1, 8 * symbols, (contexts, symbols)) * 40 + np.arange(symbols), axis=1)
        steps = np.diff(sym, prepend=0, axis=1).ravel().astype(np.uint64)
        odds = (np.cumsum(steps.reshape(contexts, symbols), axis=1) % 90).ravel().astype(np.uint8)
        told = np.ones(contexts, np.uint64), np.zeros(contexts, np.int64), np.full(contexts, symbols, np.uint32), steps, rng.integers(0, 9, steps.shape).astype(np.uint32), odds, np.arange(0, contexts, 10, dtype=np.uint32)
        told[1][0] = 10 * groups * symbols
        out.append(tuple(map(planes, told)))
    return out


def test_contexts_in_ranges():
    """An owner's answers don't depend on the ranges in which it tests contexts, and ranges bound its memory beside the lists and answers."""
    tuned = {"least_context": 4, "least_pair": 2, "beta": 1.0}
    lists = context_lists(4, 300, 20)
    (want, (kept, *sums)), (got, (kept_, *sums_)) = (suffix_lm.test_contexts(lists, 1, tuned, 0.05, n) for n in (1 << 30, 50))
    assert got == want and kept == kept_ > 0 and all(np.array_equal(x, y) for x, y in zip(sums, sums_, strict=True)) and len(sums[0]) == 30
    lists = context_lists(8, 2500, 40)
    tracemalloc.start()
    suffix_lm.test_contexts(lists, 1, tuned, 0.05, 1 << 15)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45 * 8 * 2500 * 40


def test_spent_answers(docs, monkeypatch):
    """Of the answers only those that the result is read from stay on disk."""
    made, write = [], suffix_lm.Groups.answer
    monkeypatch.setattr(suffix_lm.Groups, "answer", lambda self, *a: made.append(write(self, *a)) or made[-1])
    got = suffix_lm.score_documents(docs, depth=3, least_context=4, cost=0.01)
    assert len(made) > 2 and [df.sparkSession.read.schema(df.schema).parquet(df.inputFiles()[0].rsplit("/", 1)[0]).isEmpty() for df, _ in made] == [True] * (len(made) - 1) + [False]
    assert got.count() == docs.count()


# substring dedup


@pytest.mark.parametrize("kw", [{}, {"group_bytes": 2000, "owner_bytes": 3000, "most_words": 50}, {"group_bytes": 3000, "hot": 3}])
def test_substrings(docs, none, all_rows, kw):
    # of the two equal rows with id 0 either may come first: their results are told apart as a set
    order = sorted(range(len(all_rows)), key=lambda k: (id_order(all_rows[k][0]), k))
    seen, want = set(), []
    for k in order:
        w, gone = words_of(all_rows[k][1]), set()
        for i in range(len(w) - 19):
            if tuple(w[i : i + 20]) in seen:
                gone |= set(range(i, i + 20))
            seen.add(tuple(w[i : i + 20]))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((repr(all_rows[k][0]), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [(repr(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(docs, **kw).collect()]
    assert sorted(got) == sorted(want)
    if not kw:
        assert substring_dedup.substring_dedup(none).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=12), max_size=12), st.integers(1, 4))
def test_suffix_tree(texts, width):
    words = np.array([w for t in texts for w in t], np.uint32)
    left = np.array([len(t) - i for t in texts for i in range(len(t))], np.int64)
    suffix = [t[i:] for t in texts for i in range(len(t))]
    order, common = substring_dedup.suffix_tree(words, left, width)
    assert [suffix[i] for i in order] == sorted(s for s in suffix if len(s) >= width)
    shared = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert common[1:].tolist() == [shared(suffix[i], suffix[j]) for i, j in zip(order[:-1], order[1:])]
    rank = np.random.default_rng(0).permutation(len(suffix))
    first = {}
    for s, k in zip(suffix, rank):
        if len(s) >= width:
            first[tuple(s[:width])] = min(first.get(tuple(s[:width]), k), k)
    assert substring_dedup.repeats(words, left, rank, width).tolist() == [len(s) >= width and first[tuple(s[:width])] != k for s, k in zip(suffix, rank)]
