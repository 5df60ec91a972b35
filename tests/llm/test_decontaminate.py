import math
import random
import re
import string

import pytest

from verifold.llm import decontaminate as dc


def items_of(rnd, n=60):
    vocab = ["w%d" % i for i in range(400)] + ["the", "of", "and"] * 40
    return [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(8, 50))) + ".\n" + " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(1, 9)))) for i in range(n)], vocab


def plain_search(index, terms, goal):
    scores = {}
    for t in terms:
        for k, x in zip(index.docs[t], index.impacts[t]):
            scores[k] = scores.get(k, 0.0) + x
    return {k: s for k, s in scores.items() if s >= goal - 1e-9}


@pytest.mark.parametrize("goal", [0.05, 0.2, 0.6])
def test_wand_finds_all_above_threshold(goal):
    rnd = random.Random(7)
    items, vocab = items_of(rnd, 300)
    index = dc.ItemIndex(items, goal, block=4)
    for _ in range(300):
        text = " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(1, 120)))
        if rnd.random() < 0.5:
            text += " " + rnd.choice(items)[1]
        terms = sorted({index.ids[w] for w in dc.split_words(text) if w in index.ids})
        got = dict(index.search(terms))
        want = plain_search(index, terms, goal)
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k]) for k in got)


def plain_split(text):
    """Question and answer of an item, by the rules as stated, word by word."""
    bare = [w.strip(string.punctuation) or w for w in re.split(r"[\x20\x09-\x0D]+", lowered(text)) if w]
    t = text.strip()
    if "\n" in t:
        head = t[: t.rindex("\n")]
    else:
        t = t.rstrip(".!? ")
        head = t[: t.rindex(". ")] if ". " in t else ""
    cut = len(head.split())
    if not cut or not t[len(head) + 1 :].split():
        cut = len(text.split()) - len(text.split()) // 3
    while len(bare) > cut + 1 and not bare[-1].strip(string.punctuation):
        bare.pop()
    return bare[:cut], bare[cut:]


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def plain_bm25(bags, k1=1.2, b=0.75):
    """Of each item, its terms' weights as shares of the item's score against itself."""
    mean = sum(len(x) for x in bags) / len(bags)
    out = []
    for x in bags:
        weight = {}
        for t in set(x):
            n = sum(t in y for y in bags)
            weight[t] = math.log(1 + (len(bags) - n + 0.5) / (n + 0.5)) * x.count(t) * (k1 + 1) / (x.count(t) + k1 * (1 - b + b * len(x) / mean))
        whole = sum(weight.values())
        out.append({t: v / whole for t, v in weight.items()})
    return out


def plain_share(part, passage, n=5):
    n = max(1, min(n, len(part)))
    own = {tuple(part[i : i + n]) for i in range(len(part) - n + 1)} if part else set()
    held = {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}
    return len(own & held) / len(own) if own else 1.0


def plain_contaminated(docs, items):
    """Every window of every document against every item, from the formulas alone."""
    items = sorted({(i, t) for i, t in items if t and t.split()})
    split = [plain_split(t) for _, t in items]
    weights = plain_bm25([q + a for q, a in split])
    w_size = max(64, 2 * max(len(t.split()) for _, t in items))
    out = set()
    for d, t in docs:
        w = [x.strip(string.punctuation) or x for x in re.split(r"[\x20\x09-\x0D]+", lowered(t or "")) if x]
        for s in range(0, max(1, len(w) - w_size // 2), w_size // 2) if w else ():
            passage = w[s : s + w_size]
            terms = set(passage)
            for (i, _), (q, a), weight in zip(items, split, weights):
                if sum(v for x, v in weight.items() if x in terms) >= dc.THRESHOLD - 1e-9 and plain_share(q, passage) >= dc.OVERLAP and plain_share(a, passage) >= dc.OVERLAP:
                    out.add((d, i))
    return out


def test_matches_brute_force(spark):
    rnd = random.Random(11)
    items, vocab = items_of(rnd)
    docs = []
    for i in range(700):
        parts = [" ".join(rnd.choice(vocab) for _ in range(rnd.choice([0, 3, 30, 150]))) for _ in range(2)]
        k = rnd.choice(items)
        leak = [k[1], k[1].upper(), " ".join(k[1].split()[:-3]), k[1].split("\n")[0], ""][i % 5]
        docs.append((i, parts[0] + "\n" + leak + " " + parts[1]))
    docs += [(900, None), (901, ""), (902, " \t"), (903, "long " * 6000 + items[3][1] + " tail" * 2000), (904, items[0][1]), (904, items[0][1])]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string").coalesce(1)
    it = spark.createDataFrame([*items, (77, None), (78, ""), items[0]], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in dc.contaminated(df, it).collect()]
    want = plain_contaminated(docs, items)
    assert set(got) == want
    assert got.count((904, 0)) == 2
    assert {(i, d) for i, d in want if i in (903, 904)} == {(903, 3), (904, 0)}
    # the same rows, scores included, from an index in several blocks
    rows = lambda found: sorted((r.doc_id, r.item_id, round(r.score, 9), r.passages, r.first_word, r.last_word) for r in found.collect())
    assert rows(dc.contaminated(df, it, most=13)) == rows(dc.contaminated(df, it))
    kept = dc.without_contaminated(df, it)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in docs if i not in {d for d, _ in want})


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert dc.contaminated(docs, items).count() == 0
    assert dc.contaminated(docs.limit(0), spark.createDataFrame([(1, "what is it\nit is that")], "item_id long, text string")).count() == 0


def test_question_and_answer():
    assert dc.question_and_answer("What is X?\nIt is Y.") == ([b"what", b"is", b"x?"], [b"it", b"is", b"y."])
    assert dc.question_and_answer("First one. Second two.") == ([b"first", b"one"], [b"second", b"two"])
    assert dc.question_and_answer("a b c d e f") == ([b"a", b"b", b"c", b"d"], [b"e", b"f"])
    assert dc.question_and_answer(None) == ([], [])


def test_every_item_alone_is_flagged_against_itself(spark):
    items = [(1, "The tall grey tower stands on stnt. Lor esa min."), (2, "Who is it? Anna."), (3, "One two three four five six seven"), (4, "Is it (really) so?\nYes, it is."), (5, "First part here. Last - part !"), (6, "\u00a0 odd lead. tail")]
    it = spark.createDataFrame(items, "item_id long, text string")
    docs = [(i, t) for i, t in items] + [(10 + i, "before it " * 40 + '"' + t + '.%%% and after' + " it" * 90) for i, t in items] + [(20 + i, t.rstrip(".!? ")) for i, t in items]
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), it).collect()}
    assert {(k + i, i) for i, _ in items for k in (0, 10, 20)} <= got
    for i, t in items:
        assert [x[0] for x in dc.ItemIndex([(i, t)]).items] == [i] and sum(map(len, dc.parts(t))) == len(t.encode().split()) - (i == 5)
