import json
import os
import random
from collections import Counter

import pyarrow as pa
import pytest

from strandline.llm import contamination as C
from strandline.llm import notebooks, packing, toxicity
from tests.conftest import rows


def _direct(items, cap):
    """Best fit decreasing, item by item."""
    bins = []
    for x in sorted(items, reverse=True):
        fit = [i for i, b in enumerate(bins) if b >= x]
        if fit:
            bins[min(fit, key=lambda i: bins[i])] -= x
        else:
            bins.append(cap - x)
    return len(bins)


def test_plan_uses_as_many_containers_as_best_fit_on_the_items():
    r = random.Random(3)
    for cap in (1, 7, 50, 512):
        for _ in range(30):
            items = [r.randint(1, cap) for _ in range(r.randint(0, 200))]
            slots = packing.plan(Counter(items), cap)
            used = {}
            placed = Counter()
            for length, a, b, first, each, off in slots:
                for rank in range(a, b):
                    n, k = divmod(rank - a, each)
                    used.setdefault(first + n, []).append((off + k * length, off + (k + 1) * length))
                    placed[length] += 1
            assert placed == Counter(items)
            for spans in used.values():
                spans.sort()
                assert spans[-1][1] <= cap and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
            assert sorted(used) == list(range(len(used))) and len(used) == _direct(items, cap)


def test_pack_places_every_token_once(spark):
    r = random.Random(5)
    docs = [(i, r.choice([0, 5, 5, 5, 17, 100, 250, r.randint(1, 300)])) for i in range(400)] + [(1000, None)]
    df = spark.createDataFrame([(*d, "x") for d in docs + docs[:30]], "key bigint, n bigint, bin string").repartition(3)
    kinds = spark.createDataFrame([("s", 100), ("l", 300), ("s", 100), ("none", None), ("zero", 0)], "container string, capacity int")
    got = packing.pack(df, "key", "n", kinds).collect()
    for name, cap in (("s", 100), ("l", 300)):
        mine = [x for x in got if x["container"] == name]
        parts, space = {}, {}
        for x in mine:
            parts.setdefault(x["key"], []).append((x["token_start"], x["n_tokens"]))
            if x["n_tokens"]:
                space.setdefault(x["bin"], []).append((x["bin_offset"], x["bin_offset"] + x["n_tokens"]))
            else:
                assert x["bin"] is None
        for i, n in docs:
            p = sorted(parts[i])
            assert sum(x[1] for x in p) == (n or 0) and (len(p) == 1 or n > cap)
            assert all(a[0] + a[1] == b[0] for a, b in zip(p, p[1:], strict=False))
        for v in space.values():
            v.sort()
            assert v[-1][1] <= cap and all(a[1] <= b[0] for a, b in zip(v, v[1:], strict=False))
    assert {x["container"] for x in got} == {"s", "l"}
    assert {x["container"]: x["filled"] > 0.9 for x in packing.fill(packing.pack(df, "key", "n", kinds), kinds).collect()} == {"s": True, "l": True}
    assert rows(packing.pack(df.limit(0), "key", "n", kinds)) == [] and rows(packing.pack(df, "key", "n", kinds.limit(0))) == []


@pytest.mark.skipif(not os.path.exists(packing.VOCABULARY), reason="no vocabulary here")
def test_any_capacity_is_planned(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([5, 7, 3 << 20, 2 << 20, 9 << 20])], "doc_id bigint, n bigint")
    kinds = spark.createDataFrame([("huge", 8 << 20)], "container string, capacity bigint")
    got = packing.pack(df, "doc_id", "n", kinds).collect()
    assert sum(x["n_tokens"] for x in got) == sum([5, 7, 14 << 20]) and len({x["bin"] for x in got}) == 2
    assert sorted((x["doc_id"], x["piece"]) for x in got) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (4, 1)]


def test_token_lengths(spark):
    df = spark.createDataFrame([(1, "a cat"), (2, None), (3, ""), (1, "a cat"), (4, "<|endoftext|>"), (5, "x " * 100_000), (None, "a")], "key bigint, t string")
    got = dict(rows(packing.token_lengths(df, "key", "t")))
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and got[5] > 99_000 and len(got) == 5


def _longest(doc, item):
    """By brute force: the longest run of the item's words in the document."""
    best = 0
    for i in range(len(doc)):
        for j in range(len(item)):
            n = 0
            while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n]:
                n += 1
            best = max(best, n)
    return best


def test_automaton_by_brute_force():
    r = random.Random(2)
    for least in (2, 4):
        items = {i: [r.choice("abcd") for _ in range(r.randint(0, 9))] for i in range(6)}
        auto = C.Automaton(items, least)
        for _ in range(60):
            doc = [r.choice("abcde") for _ in range(r.randint(0, 25))]
            runs = auto.by_item(auto.matches(doc))
            got = {i: max(b - a + 1 for a, b in v) for i, v in runs.items()}
            assert got == {i: n for i, ws in items.items() if (n := _longest(doc, ws)) >= least}
            for i, v in runs.items():
                text = "".join(items[i])
                assert all("".join(doc[a : b + 1]) in text for a, b in v)


ITEM = "Which clean lantern was first charted beyond the quiet harbor in 1912 and why?"


def _notebook(source, out):
    return json.dumps({"cells": [{"cell_type": "code", "source": source, "outputs": [{"output_type": "stream", "text": out}, {"output_type": "error", "traceback": ["a", "b"]}]}], "nbformat": 4})


def test_leaks_in_every_layout(spark):
    words = ITEM.split()
    lines = [w + "\n" for w in words]
    docs = [
        (1, "intro\n# " + "\n# ".join(words).upper() + "\nrest", "percent"), (2, _notebook(["x = 1\n"], lines), "json"), (3, _notebook(lines, ["y"]), "json"),
        (4, " ".join(words[:11]), "plain"), (5, " ".join(words[2:14]), None), (6, None, "json"), (7, "", "plain"), (8, "{broken \\n" + "\\n".join(words), "json"),
        (9, ITEM + " filler " * 50_000, "plain"), (1, "intro\n# " + "\n# ".join(words).upper() + "\nrest", "percent"),
    ]
    df = spark.createDataFrame([(*d, "c") for d in docs], "key bigint, t string, l string, item_id string").repartition(2)
    items = spark.createDataFrame([(70, ITEM), (71, "too short"), (72, None), (70, ITEM), (None, ITEM)], "item bigint, t string")
    got = rows(C.leaks(df, "key", "t", "l", items, "item", "t").select("doc_id", "item_id", "longest"))
    assert got == [(1, 70, 14), (2, 70, 14), (3, 70, 14), (5, 70, 12), (8, 70, 14), (9, 70, 14)]
    clean = {x["doc_id"]: x["text"] for x in C.remove_leaks(df, "key", "t", "l", items, "item", "t").collect()}
    # eleven words of fourteen are most of the item
    assert set(clean) == {1, 2, 3, 4, 5, 8, 9} and clean[1] == "intro\n# ?\nrest" and clean[4] == ""
    assert json.loads(clean[3])["cells"][0]["source"] == ["?\n"]
    assert rows(C.leaks(df.limit(0), "key", "t", "l", items, "item", "t")) == [] and rows(C.leaks(df, "key", "t", "l", items.limit(0), "item", "t")) == []


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    r = random.Random(1)
    vocab = [f"w{i}" for i in range(30)]
    texts = [[r.choice(vocab) for _ in range(20)] for _ in range(12)]
    docs = spark.createDataFrame([(i, " ".join(sum(r.sample(texts, 2), []))) for i in range(20)] + [(50, "w1 w2"), (51, "none of it")], "key bigint, t string")
    # several texts under one item, in whatever blocks they fall
    items = spark.createDataFrame([(i // 2, " ".join(t)) for i, t in enumerate(texts)], "item bigint, t string")
    whole = rows(C.leaks(docs, "key", "t", None, items, "item", "t"))
    clean = rows(C.remove_leaks(docs, "key", "t", None, items, "item", "t"))
    assert len(whole) >= 35 and len({(x[0], x[1]) for x in whole}) == len(whole) and len(clean) == 20
    for size in (20, 50):
        monkeypatch.setattr(C, "BLOCK_WORDS", size)
        assert rows(C.leaks(docs, "key", "t", None, items, "item", "t")) == whole
        assert rows(C.remove_leaks(docs, "key", "t", None, items, "item", "t")) == clean


def test_the_filter_misses_nothing(monkeypatch):
    r = random.Random(2)
    texts = [[f"v{r.randrange(500)}" for _ in range(40)] for _ in range(50)]
    blocks = lambda: iter([[(i, t) for i, t in enumerate(texts)]])
    for bits in (1 << 30, 1 << 12):
        monkeypatch.setattr(C, "FILTER_BITS", bits)
        held = C._filter(blocks, 6)
        docs = [" ".join(t[n : n + 6]) for t in texts for n in (0, 9, 34)] + [" ".join(f"x{r.randrange(500)}" for _ in range(30)) for _ in range(50)]
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array(docs), pa.nulls(len(docs), pa.string())], ["id", "t", "l"])
        kept = [x for b in C._may_hold([batch], type("Sent", (), {"value": held}), 6) for x in b.column(0).to_pylist()]
        assert kept[:150] == list(range(150)) and (len(kept) < 160 or bits < 1 << 20)


def test_leaks_over_several_cells_are_removed(spark):
    words = ITEM.replace("?", "").split()
    half = len(words) // 2
    broken = "{broken é " + "\\n".join(words) + " end"
    texts = {
        1: (_notebook(["keep a\n", " ".join(words[:half]) + "\n"], " ".join(words[half:]) + " keep b"), "json"),
        2: (_notebook([" ".join(words[:half])], "keep c"), "json"),
        3: (broken, "json"),
        # what is left when the inner copy goes is a run again
        4: (" ".join(words[:6]) + " " + " ".join(words) + " " + " ".join(words[6:12]) + " tail", "plain"),
        5: ("İstanbul İ " + " ".join(words).upper() + " İ end", "plain"),
    }
    df = spark.createDataFrame([(k, t, l, 1) for k, (t, l) in texts.items()], "key bigint, t string, l string, id int")
    items = spark.createDataFrame([(70, ITEM)], "item bigint, t string")
    before = {x["doc_id"] for x in C.leaks(df, "key", "t", "l", items, "item", "t").collect()}
    assert before >= {1, 3, 4, 5}
    clean = C.remove_leaks(df, "key", "t", "l", items, "item", "t")
    got = {x["doc_id"]: x["text"] for x in clean.collect()}
    left = clean.join(df.select(df.key.alias("doc_id"), "l"), "doc_id")
    assert rows(C.leaks(left, "doc_id", "text", "l", items, "item", "t")) == []
    plain = notebooks.plain_text(got[1], "json")
    assert "keep a" in plain and "keep b" in plain and not set(words) - {"a", "b"} & set(C.words(plain)) - {"keep", "a", "b"}
    assert got[3].startswith("{broken é ") and got[3].endswith(" end") and words[3] not in got[3]
    assert got[4].split() == ["tail"] and got[5].split() == ["İstanbul", "İ", "İ", "end"]


def test_places_are_those_of_the_words():
    for t in ("One, two_three", "İİ a İb", "ŞIK x", "ß ẞ", ""):
        assert [w for i, j in C.places(t) for w in C.words(t[i:j])] == C.words(t) and len(C.places(t)) == len(C.words(t))


def test_notebook_text():
    n = _notebook(["a\n", "b"], "c")
    assert notebooks.plain_text(n, "json") == "a\nb\nc\na\nb"
    assert notebooks.plain_text(n, "plain") == n and notebooks.plain_text(None, "json") == "" and notebooks.plain_text("[1]", "json") == "[1]"


def test_spelling_is_undone():
    w = lambda t: toxicity.windows(t, None)
    plain = w("you are a hopeless fool")
    for t in ("YOU_are_a_hopeless_fool", "you are a h0pele$$ f00l", "you are a h-o-p-e-l-e-s-s fool", "yo­u are​ a hopeless fool", "уоu аrе a hopeless fool", "you are a hopelessss fooool"):
        assert w(t) == plain, t
    assert w("") == w(None) == w("[12.5, 7]") == []
    assert len(w(" ".join(f"word{chr(97 + i % 26)}{chr(98 + i // 26)}" for i in range(200)))) > 20


def test_units_of_every_length_and_script_are_kept():
    w = lambda t: toxicity.windows(t, None)
    assert w("fuck you") == ["fuck you"] and w("Idiot!") == ["idiot"] and w("x = 12.5") == ["x"]
    assert w("ты тупая свинья") == ["ты тупая свинья"] and w("أنت غبي") == ["أنت غبي"] and w("तू मूर्ख है") == ["तू मूर्ख है"]
    assert w("你是个白痴") == ["你 是 个 白 痴"] and w("σκάσε βλάκα") == ["σκασε βλακα"]
    long = "wort" * 10
    assert "".join(w(long)[0].split()) == long and all(len(x) <= 24 for x in w(long)[0].split())
    # a look-alike beside Latin words is a disguise, a word of its own script is not
    assert w("уоu idiоt") == ["you idiot"] and w("мне нехорошо") == ["мне нехорошо"]


def test_held_out_accuracy_in_another_script(spark):
    r = random.Random(5)
    names = ["ветер", "город", "камень", "берег", "остров", "песок", "облако", "дорога"]
    docs, truth = [], {}
    for i in range(500):
        lines = [f"здесь {r.choice(names)} виден рядом где {r.choice(names)} и {r.choice(names)}" for _ in range(6)]
        truth[i] = r.random() < 0.15
        if truth[i]:
            lines.insert(r.randrange(6), f"ты мерзкая {r.choice(['жаба', 'крыса', 'вошь'])} и тебя все ненавидят")
        docs.append((i, "\n".join(lines)))
    df = spark.createDataFrame(docs, "key bigint, t string").repartition(3)
    labels = spark.createDataFrame([(i, int(truth[i])) for i in range(300)], "key bigint, toxic int")
    model = toxicity.fit(df, "key", "t", None, labels, "toxic")
    got = {x["doc_id"] for x in toxicity.score(df, "key", "t", None, model).where("toxic").collect()}
    want = {i for i in range(300, 500) if truth[i]}
    new = {i for i in got if i >= 300}
    assert len(new & want) >= 0.9 * len(want) and len(new & want) >= 0.9 * len(new)


def test_what_a_fit_collects_is_bounded_by_its_settings(spark):
    df = spark.createDataFrame([(1, i % 2, f"window {i}") for i in range(2000)] , "toxic int, fold int, w string").repartition(8)
    got = toxicity._sampled(df, toxicity.Settings(toxic_windows=100))
    assert set(got) == {(1, 0), (1, 1)} and all(60 <= len(x) <= 140 for x in got.values())
    assert got == toxicity._sampled(df.repartition(3), toxicity.Settings(toxic_windows=100))


def _corpus(r, n):
    names = [a + b for a in ("lan", "har", "vel", "mor", "tis") for b in ("tern", "bor", "let", "gan", "que")]
    bad = ["you are a rotten {} and everybody hates you", "go away forever you filthy {}", "nobody wants a disgusting {} like you here"]
    docs, truth = [], {}
    for i in range(n):
        lines = [f"the {r.choice(names)} shows the {r.choice(names)} near a {r.choice(names)}" for _ in range(8)]
        truth[i] = r.random() < 0.15
        if truth[i]:
            lines.insert(r.randrange(8), r.choice(bad).format(r.choice(["toad", "slug", "worm"])))
        if r.random() < 0.2:
            lines.append("hate speech is hard to detect")
        docs.append((i, "\n".join(lines), r.choice(["a", "b", None])))
    return docs, truth


def test_held_out_accuracy_and_rates(spark):
    r = random.Random(4)
    docs, truth = _corpus(r, 900)
    marks = [(i, int(truth[i] ^ (r.random() < 0.08)), f"ann{r.randint(1, 2)}") for i, _, _ in docs if i < 600]
    df = spark.createDataFrame(docs + docs[:20] + [(2000, None, "a"), (2001, "", "a")], "key bigint, t string, source string").repartition(3)
    labels = spark.createDataFrame(marks + marks[:9] + [(3, None, "x")], "key bigint, toxic int, annotator string")
    model = toxicity.fit(df, "key", "t", None, labels, "toxic")
    got = {x["doc_id"]: x["toxic"] for x in toxicity.score(df, "key", "t", None, model).collect()}
    assert len(got) == 902 and not got[2000] and not got[2001]
    new = [i for i, _, _ in docs if i >= 600]
    hit = sum(got[i] and truth[i] for i in new)
    assert hit >= 0.9 * sum(truth[i] for i in new) and hit >= 0.9 * sum(got[i] for i in new)
    by = {x["source"]: x["n_docs"] for x in toxicity.rates(toxicity.score(df, "key", "t", None, model), df, "key", "source").collect()}
    assert sum(by.values()) == 902 and None in by
    none = toxicity.fit(df, "key", "t", None, labels.limit(0), "toxic")
    assert none is None and not any(x["toxic"] for x in toxicity.score(df, "key", "t", None, none).collect())
    assert rows(toxicity.score(df.limit(0), "key", "t", None, model)) == []
